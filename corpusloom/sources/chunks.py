"""A stream source of reply chunks: lanes of append-only events with positions as offsets.

``feed`` names a factory, ``package.module:function``, that is called with the other options and gives a ``Feed``. An
offset holds one position for each lane, however many replies pass through, so a restart reads on where the checkpoint
stands. A micro-batch reads what has come since, in partitions of ``rows`` events of one lane at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from importlib import import_module
from itertools import islice
from pathlib import Path
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: A chunk: its reply, place in it, moment, what it is (asked, chunk, done), channel (text, reasoning), piece of text,
#: and what the last ones carry.
SCHEMA = "reply string, position long, at timestamp, kind string, channel string, text string, finish string, usage long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ROWS = 10_000


class Feed(Protocol):
    """Where chunks come from. Lanes keep their names and their events; positions count from 0."""

    def ends(self) -> dict[str, int]:
        """Number of events of every lane so far."""
        ...

    def read(self, lane: str, start: int, end: int) -> Iterator[tuple]:
        """Events ``start`` to ``end`` (exclusive) of a lane, as tuples of the columns of ``SCHEMA``."""
        ...


def feed_of(options: dict[str, str]) -> Feed:
    module, _, name = options["feed"].partition(":")
    given = {k: v for k, v in options.items() if k not in ("feed", "rows", "path")}
    return getattr(import_module(module), name)(**given)


class LogFeed:
    """Lanes are the ``*.jsonl`` files of a folder that all machines mount: one event a line, appended only. A line
    without its line break is not there yet; fields that are absent are null."""

    def __init__(self, root: str):
        self.root = Path(root)

    def ends(self) -> dict[str, int]:
        return {p.name: sum(line.endswith(b"\n") for line in p.open("rb")) for p in sorted(self.root.glob("*.jsonl"))}

    def read(self, lane: str, start: int, end: int) -> Iterator[tuple]:
        with (self.root / lane).open("rb") as lines:
            for line in islice(lines, start, end):
                e = json.loads(line)
                at = datetime.fromisoformat(e["at"]) if e.get("at") else None
                yield tuple(at if c == "at" else e.get(c) for c in COLUMNS)


class Stretch(InputPartition):
    """Events of one lane."""

    def __init__(self, lane: str, start: int, end: int):
        super().__init__((lane, start, end))
        self.lane, self.start, self.end = lane, start, end


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.feed, self.rows = options, feed_of(options), int(options.get("rows", ROWS))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Ends of the lanes; nothing else is kept here, so a restart has only the checkpoint to go by."""
        return self.feed.ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Stretch(lane, at, min(at + self.rows, n)) for lane, n in sorted(end.items()) for at in range(start.get(lane, 0), n, self.rows)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return feed_of(self.options).read(partition.lane, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


class ChunkSource(DataSource):
    """``spark.dataSource.register(ChunkSource)``, then ``spark.readStream.format("reply_chunks").option("feed", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "reply_chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ChunkReader(dict(self.options))
