"""Idle limits with state and timers, and the chunk source, against their batch forms."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import gates
from corpusloom.sources.chunks import SCHEMA, ChunkReader, ChunkSource, LogFeed
from corpusloom.streaming import timeouts

START = datetime(2024, 5, 1, tzinfo=UTC)


def plain_failures(events, until, first=60, after=30):
    out = {}
    for reply in {e[0] for e in events}:
        line = sorted((at, timeouts.KINDS.index(kind)) for r, kind, at in events if r == reply and kind in timeouts.KINDS and at is not None)
        chunks = 0
        for i, (at, k) in enumerate(line):
            if k == 2:
                break
            chunks += k == 1
            due = at + (first if k == 0 else after)
            following = line[i + 1][0] if i + 1 < len(line) else until
            if following is not None and following > due:
                out[reply] = (due, timeouts.PHASES[0 if k == 0 else 1], chunks)
                break
    return out


def random_events(seed, replies):
    rng = random.Random(seed)
    events = []
    for r in range(replies):
        at = rng.randint(0, 300)
        events.append((f"r{r}", "asked", at))
        for _ in range(rng.randint(0, 6)):
            at += rng.choice([1, 5, 29, 30, 31, 60, 61])
            events.append((f"r{r}", "chunk", at))
        if rng.random() < 0.5:
            events.append((f"r{r}", "done", at + rng.choice([0, 30, 31])))
        if rng.random() < 0.2:
            events.append((f"r{r}", "chunk", at + 200))
    return events


def table(spark, events):
    rows = [(r, k, None if at is None else START + timedelta(seconds=at)) for r, k, at in events]
    return spark.createDataFrame(rows, "reply string, kind string, at timestamp")


def told(rows):
    return {r["reply"]: (int((r["failed_at"].replace(tzinfo=UTC) - START).total_seconds()), r["phase"], r["chunks"]) for r in rows}


@pytest.mark.parametrize("until", [None, 100, 2000])
def test_late_replies_against_a_plain_walk(spark, until):
    events = random_events(3, 60) + [("x", "other", 5), ("x", "asked", None), (None, "asked", 1)]
    end = None if until is None else F.lit(START + timedelta(seconds=until))
    assert told(timeouts.late_replies(table(spark, events), end).collect()) == plain_failures([e for e in events if e[0]], until)


def test_stream_of_limits_equals_the_batch(spark, tmp_path):
    events = random_events(8, 40)
    rng = random.Random(1)
    # events arrive up to 40 seconds out of order, in several batches; a last one moves the watermark past everything
    arrival = sorted(events, key=lambda e: e[2] + rng.random() * 40)
    source = tmp_path / "in"
    source.mkdir()
    size = len(arrival) // 3 + 1
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema("reply string, kind string, at timestamp").option("maxFilesPerTrigger", "1").parquet(str(source))
        late = timeouts.late_replies_stream(stream, "41 seconds")

        def run():
            query = late.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            assert query.awaitTermination(300)

        for i in range(3):
            table(spark, arrival[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(str(source))
            if i == 1:
                run()  # the rest follows after a restart
        table(spark, [("end", "done", 5000)]).coalesce(1).write.mode("append").parquet(str(source))
        run()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == len({r["reply"] for r in rows})
    until = 5000 - 41
    assert told(rows) == plain_failures(events, until) == told(timeouts.late_replies(table(spark, events), F.lit(START + timedelta(seconds=until))).collect())


def chunk_lines(reply, first, n, **last):
    rows = [{"reply": reply, "position": first + i, "at": (START + timedelta(seconds=first + i)).isoformat(), "kind": "chunk", "channel": "reasoning" if i % 3 == 0 else "text", "text": f"{reply}{first + i} "} for i in range(n)]
    rows[-1] |= last
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def test_chunk_source_reads_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(ChunkSource)
    lanes, out = tmp_path / "lanes", tmp_path / "out"
    lanes.mkdir()
    (lanes / "a.jsonl").write_text(chunk_lines("x", 0, 7) + '{"reply": "x", "posi')

    def run():
        stream = spark.readStream.format("reply_chunks").option("feed", "corpusloom.sources.chunks:LogFeed").option("root", str(lanes)).option("rows", "5").load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return spark.read.schema(SCHEMA).parquet(str(out))

    assert run().count() == 7  # the line that is not whole yet waits
    (lanes / "a.jsonl").write_text(chunk_lines("x", 0, 7) + chunk_lines("x", 7, 4, finish="stop", usage=9))
    (lanes / "b.jsonl").write_text(chunk_lines("y", 0, 12, finish="length"))
    rows = run()
    assert rows.count() == 23 and rows.select("reply", "position").distinct().count() == 23
    folded = {r["reply"]: r for r in gates.folded_replies(rows.withColumnRenamed("reply", "of").withColumnRenamed("of", "id"), ["id"], "position").withColumnRenamed("reply", "text").withColumnRenamed("id", "reply").collect()}
    assert folded["x"]["text"] == "".join(f"x{i} " for i in [1, 2, 4, 5, 8, 9]) and folded["x"]["reasoning"] == "".join(f"x{i} " for i in [0, 3, 6, 7, 10])
    assert (folded["x"]["finish"], folded["x"]["usage"], folded["x"]["chunks"], folded["y"]["finish"], folded["y"]["chunks"]) == ("stop", 9, 11, "length", 12)
    assert folded["x"]["reasoning_pct"] == round(len(folded["x"]["reasoning"]) * 100 / (len(folded["x"]["reasoning"]) + len(folded["x"]["text"])))


def test_offsets_move_lane_by_lane(tmp_path):
    (tmp_path / "a.jsonl").write_text(chunk_lines("x", 0, 7))
    (tmp_path / "b.jsonl").write_text("")
    reader = ChunkReader({"feed": "corpusloom.sources.chunks:LogFeed", "root": str(tmp_path), "rows": "3"})
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a.jsonl": 7, "b.jsonl": 0}
    parts = reader.partitions({"a.jsonl": 2}, {"a.jsonl": 7, "b.jsonl": 0})
    assert [(p.lane, p.start, p.end) for p in parts] == [("a.jsonl", 2, 5), ("a.jsonl", 5, 7)] and [r[1] for p in parts for r in reader.read(p)] == [2, 3, 4, 5, 6]
    assert reader.partitions({"a.jsonl": 6}, {"a.jsonl": 6}) == []
    assert LogFeed(str(tmp_path)).ends() == {"a.jsonl": 7, "b.jsonl": 0}
