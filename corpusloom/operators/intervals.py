"""Ownership of lines, runs, slices and running depth: the window-shaped operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S


def next_owner(rows: DataFrame, key: str, order: list[str], owner: Column, fill_tail: bool = True) -> DataFrame:
    """Adds ``owner``: a row without one takes that of the next row that has one; the tail takes the last one's.

    Both frames grow from the start of their order, so a key costs one step a row, however many rows it has.
    """
    line, back = W.partitionBy(key).orderBy(*order), W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    ahead, behind = (F.last(owner, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) for w in (back, line))
    return rows.withColumn("owner", F.coalesce(ahead, behind) if fill_tail else ahead)


def runs(rows: DataFrame, key: str, order: list[str], value: str, position: str) -> DataFrame:
    """Maximal runs of an equal value: key, value, first and last position, length."""
    line = W.partitionBy(key).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(line)) | F.lag(F.lit(1)).over(line).isNull()).cast("long")
    marked = rows.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(line))
    return marked.groupBy(key, "_run", value).agg(
        F.min_by(position, F.struct(*order)).alias("first"), F.max_by(position, F.struct(*order)).alias("last"), F.count("*").alias("n")
    ).drop("_run")


def inside_span(rows: DataFrame, key: str, position: str, marked: Column) -> DataFrame:
    """Rows between the first and the last marked row of their key: the span is a window, not a second scan."""
    whole = W.partitionBy(key)
    low, high = F.min(F.when(marked, F.col(position))).over(whole), F.max(F.when(marked, F.col(position))).over(whole)
    return rows.withColumns({"_low": low, "_high": high}).filter(F.col(position).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def bracket_depth(text: Column, opening: str, closing: str) -> Column:
    """struct(final, deepest) of a depth that never falls below zero, folded over the brackets of a text."""
    marks = F.regexp_extract_all(text, F.lit(f"[{opening}{closing}]"), F.lit(0))

    def step(s: Column, m: Column) -> Column:
        now = F.greatest(F.lit(0), s["final"] + F.when(m == opening, F.lit(1)).otherwise(F.lit(-1)))
        return F.struct(now.alias("final"), F.greatest(s["deepest"], now).alias("deepest"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("final"), F.lit(0).alias("deepest")), step)


def line_table(docs: DataFrame, key: str) -> DataFrame:
    """(key, line number from 1, line)."""
    return docs.select(key, F.posexplode(S.lines(F.col("text"))).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_no"), "line")


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text, joined; what lies beyond its end is left out."""
    return F.array_join(F.slice(S.lines(text), start, end - start + 1), "\n")


def context(text: Column, pattern: str, following: int = 9, width: int = 240) -> Column:
    """The first line that matches and the lines after it, cut to ``width`` characters; null without a match."""

    def found(ls: Column) -> Column:
        at = F.get(F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull()), 0)
        return F.when(at.isNotNull(), F.left(F.array_join(F.slice(ls, at + 1, F.lit(following + 1)), "\n"), F.lit(width)))

    return F.element_at(F.transform(F.array(S.lines(text)), found), 1)


def covering(points: DataFrame, spans: DataFrame, on: list[str], position: str, start: str, end: str, stretch: int = 1 << 20) -> DataFrame:
    """Every point with every span of its key that covers it: columns of ``points``, then those of ``spans`` but ``on``.

    Keys are cut into stretches of ``stretch`` positions, so a key of any length spreads; a span is one row for each
    stretch that it touches, whatever its length, and is never taken apart into positions. Points and spans of a stretch
    are sorted together by Spark and read once: a batch joins its points to the spans that began in it or are still open,
    and only open spans are held. Spans may overlap; nulls and spans that end before they start cover nothing.
    """
    clash = set(points.columns) & (set(spans.columns) - set(on))
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    others = [c for c in spans.columns if c not in on]
    keys = [f"_key{i}" for i in range(len(on))]
    keyed = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    whole = lambda c: F.col(c).cast("long")
    given = F.lit(True)
    for c in on:
        given = given & F.col(c).isNotNull()
    p = points.filter(given & F.col(position).isNotNull()).select(*keyed, F.floor(whole(position) / stretch).alias("_stretch"), whole(position).alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_point"))
    touched = F.sequence(F.floor(whole(start) / stretch), F.floor(whole(end) / stretch))
    s = spans.filter(given & (F.col(start) <= F.col(end))).select(*keyed, F.explode(touched).alias("_stretch"), whole(start).alias("_at"), F.lit(0).alias("_side"), whole(end).alias("_end"), F.struct(*others).alias("_span"))
    rows = p.unionByName(s, allowMissingColumns=True).repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_at", "_side")
    fields = {f.name: f for f in rows.schema.fields}
    schema = type(rows.schema)([fields["_point"], fields["_span"]])
    return rows.mapInArrow(lambda batches: _met(batches, [*keys, "_stretch"]), schema).select("_point.*", "_span.*")


def _met(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Points with the spans around them, from rows sorted by ``keys``, position and side."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch], schema=held.schema)])
        rows = rows.combine_chunks()
        if not rows.num_rows:
            continue
        changed = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            column = rows.column(k)
            changed[1:] |= pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
        group = np.cumsum(changed)
        at, end = rows.column("_at").to_numpy(), pa.compute.fill_null(rows.column("_end"), 0).to_numpy()
        is_span = rows.column("_side").to_numpy() == 0
        spans, points = np.flatnonzero(is_span), np.flatnonzero(~is_span)
        # positions as ranks, so that (group, position) is one integer; held spans come first and are out of order
        places = np.unique(np.concatenate([at, end]))
        code = lambda g, v: g * (len(places) + 1) + np.searchsorted(places, v)
        line = code(group[points], at[points])
        first = np.searchsorted(line, code(group[spans], at[spans]), side="left")
        count = np.maximum(np.searchsorted(line, code(group[spans], end[spans]), side="right") - first, 0)
        of_span = np.repeat(spans, count)
        of_point = points[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())] if len(points) else of_span[:0]
        for k in range(0, len(of_point), 10_000):
            part = slice(k, k + 10_000)
            yield pa.record_batch({"_point": rows.column("_point").take(pa.array(of_point[part])).combine_chunks(), "_span": rows.column("_span").take(pa.array(of_span[part])).combine_chunks()})
        open_ = spans[(group[spans] == group[-1]) & (end[spans] >= at[-1])]
        held = rows.take(pa.array(open_))


def owned_lines(functions: DataFrame, lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunk of every line of a module's file, as ranges (module_id, chunk_no, file, start, end).

    ``functions`` has (module_id, file, name, line, end_line), ``lines`` (module_id, file, line), ``claims``
    (module_id, file, name, line, chunk_no). Function lines belong to the function's chunk; lines between functions go
    with the next one and lines after the last with the last, so the ranges cover every line of a file with functions.
    """
    spans = functions.join(claims.select("module_id", "file", "name", "line", "chunk_no"), ["module_id", "file", "name", "line"])
    body = spans.select("module_id", "file", F.explode(F.sequence("line", "end_line")).alias("line"), "chunk_no").groupBy("module_id", "file", "line").agg(F.min("chunk_no").alias("chunk_no"))
    filled = lines.join(body, ["module_id", "file", "line"], "left").withColumn("_file", F.struct("module_id", "file"))
    owned = next_owner(filled, "_file", ["line"], F.col("chunk_no")).drop("chunk_no")
    ranges = runs(owned, "_file", ["line"], "owner", "line")
    return ranges.select("_file.module_id", F.col("owner").alias("chunk_no"), "_file.file", F.col("first").alias("start"), F.col("last").alias("end"))
