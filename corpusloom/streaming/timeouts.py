"""Idle limits of streamed replies, as a batch query and as a stream with state and timers.

A reply is ``asked`` for, sends ``chunk`` after ``chunk`` and is ``done``. It fails where the first chunk (or the end)
takes longer than one limit after the question, or the next one longer than another limit after the last. A reply fails
once; what comes after its failure or its end does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds to the first chunk, and between chunks.
FIRST_SECONDS, NEXT_SECONDS = 60.0, 30.0
KINDS = ["asked", "chunk", "done"]
PHASES = ("first", "next")
OUT = "reply string, failed_at timestamp, phase string, chunks long"


def _limit(kind: Column, first: float, after: float) -> Column:
    return F.when(kind == "asked", F.lit(round(first * 1e6))).otherwise(F.lit(round(after * 1e6)))


def late_replies(events: DataFrame, until: Column | None = None, first: float = FIRST_SECONDS, after: float = NEXT_SECONDS) -> DataFrame:
    """(reply, failed_at, phase, chunks) of the replies of ``events`` (reply, kind, at) that fail.

    ``failed_at`` is the moment a limit ran out, ``phase`` which one, ``chunks`` how many had come. A reply that is
    still open fails where ``until`` lies beyond its limit; without ``until`` it does not. Events of one moment count
    in the order of ``KINDS``; unknown kinds and nulls do not count.
    """
    known = events.filter(F.col("kind").isin(KINDS) & F.col("reply").isNotNull() & F.col("at").isNotNull()).select(
        F.col("reply").cast("string").alias("reply"), "kind", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("_k")
    )
    line = W.partitionBy("reply").orderBy("t", "_k")
    so_far = line.rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.unix_micros(until.cast("timestamp")) if until is not None else F.lit(None).cast("long")
    seen = known.withColumns({
        "due": F.col("t") + _limit(F.col("kind"), first, after), "next": F.coalesce(F.lead("t").over(line), end),
        "closed": F.max(F.col("kind") == "done").over(so_far), "n": F.sum((F.col("kind") == "chunk").cast("long")).over(so_far),
    })
    broken = seen.filter(~F.col("closed") & (F.col("next") > F.col("due")))
    phase = F.when(F.col("kind") == "asked", PHASES[0]).otherwise(PHASES[1])
    found = broken.groupBy("reply").agg(F.min_by(F.struct("due", phase.alias("phase"), "n"), F.struct("t", "_k")).alias("b"))
    return found.select("reply", F.timestamp_micros("b.due").alias("failed_at"), "b.phase", F.col("b.n").alias("chunks"))


class _Limits(StatefulProcessor):
    """State of one reply: events that the watermark has not passed yet, and where the reply stands."""

    def __init__(self, first: float, after: float):
        self.first, self.after = round(first * 1000), round(after * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, k int")
        self.stand = handle.getValueState("stand", "due long, phase string, chunks long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(t), int(k)) for pdf in rows for t, k in zip(pdf["t"], pdf["k"], strict=True)]
        self.waiting.appendList(new)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        # a timer fires once the watermark has reached it
        yield from self._advance(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def _advance(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Replays, in order, the events that nothing can precede any more; then looks at the limit itself."""
        events = sorted((int(t), int(k)) for t, k in self.waiting.get())
        due, phase, chunks, closed = self.stand.get() if self.stand.exists() else (None, None, 0, False)
        failed = None
        ready = [e for e in events if e[0] < now]
        for t, k in ready:
            if closed:
                break
            if due is not None and t > due:
                failed, closed = (due, phase, chunks), True
                break
            chunks += k == 1
            due, phase, closed = t + (self.first if k == 0 else self.after), PHASES[0 if k == 0 else 1], k == 2
        left = events[len(ready) :]
        if not closed and due is not None and due < now:
            failed, closed = (due, phase, chunks), True
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if closed:
            left = []
        elif left or due is not None:
            # one millisecond later the watermark has passed the event, or the limit
            self.handle.registerTimer(min([t for t, _ in left] + ([due] if due is not None else [])) + 1)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self.stand.update((due, phase, chunks, closed))
        if failed:
            yield pd.DataFrame({"reply": [key[0]], "failed_ms": [failed[0]], "phase": [failed[1]], "chunks": [failed[2]]})

    def close(self) -> None:
        pass


def late_replies_stream(events: DataFrame, late: str, first: float = FIRST_SECONDS, after: float = NEXT_SECONDS) -> DataFrame:
    """The same on a stream of (reply, kind, at), to the millisecond: one row for each reply that fails, once the
    watermark, ``late`` behind the latest event, has passed its limit.

    Events wait in the state until the watermark has passed them, so their order of arrival does not matter. The session
    needs the RocksDB state store. The state of a closed reply stays as one small row.
    """
    kinds = F.array(*map(F.lit, KINDS))
    known = events.filter(F.col("kind").isin(KINDS) & F.col("reply").isNotNull()).withWatermark("at", late)
    rows = known.select(F.col("reply").cast("string").alias("reply"), F.unix_millis("at").alias("t"), (F.array_position(kinds, F.col("kind")) - 1).cast("int").alias("k"), "at")
    out = rows.groupBy("reply").transformWithStateInPandas(_Limits(first, after), "reply string, failed_ms long, phase string, chunks long", "append", "EventTime")
    return out.select("reply", F.timestamp_millis("failed_ms").alias("failed_at"), "phase", "chunks")
