"""Helpers shared by the training-data operators: staging, id ranges, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.staging import scope, shared_folder, staged

__all__ = ["bounded_sample", "id_ranges", "let", "long_table", "plain_names", "range_of", "scope", "shared_folder", "staged", "text_slices", "thinned", "with_columns"]

#: Ranges of ids that one range table may have, and sampled rows of each: at most a million longs reach the driver.
MAX_RANGES, SAMPLED = 65_536, 16
#: Distinct rows that a training sample is chosen from, for each row of it.
THINNED = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_ranges(df: DataFrame, column: str, rows_per_range: int) -> list[int | None]:
    """Upper boundaries (exclusive, nulls first) that cut ``column`` into ranges of about ``rows_per_range`` rows.

    Boundaries are quantiles of a seeded sample of ``SAMPLED`` rows a range. A value that fills several ranges comes as
    often among the boundaries. Beyond ``MAX_RANGES * rows_per_range`` rows the ranges grow: 65,536 of them hold 1.5 GB
    each of 100 TB.
    """
    n = df.count()
    parts = min(MAX_RANGES, max(1, -(-n // rows_per_range)))
    if parts == 1:
        return []
    share = min(1.0, SAMPLED * parts / n)
    ids = df.select(F.col(column).cast("long").alias("v"))
    drawn = (ids if share == 1 else ids.sample(share, seed=29)).toPandas()["v"]
    known = np.sort(drawn.dropna().to_numpy(dtype=np.int64))
    values = [None] * int(drawn.isna().sum()) + known.tolist()
    return [values[i * len(values) // parts] for i in range(1, parts)] if values else []


def long_table(values: list[int | None]) -> Column:
    """A constant array of longs, one literal however many there are."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def range_of(column: Column, cuts: list[int | None], tie: Column) -> Column:
    """Index of the range that holds ``column``: the number of boundaries at or below it.

    Rows of a value that fills several ranges spread over them by ``tie``, a hash of the row from 0 to 2 ** 63, so
    (column, tie) still ascends from range to range.
    """
    if not cuts:
        return F.lit(0)
    known = [c for c in cuts if c is not None]
    nulls, table = len(cuts) - len(known), long_table(known)
    steps = long_table([1 << b for b in reversed(range(len(known).bit_length()))])

    def below(fits: Callable[[Column], Column]) -> Column:
        def step(at: Column, by: Column) -> Column:
            return F.when((at + by <= len(known)) & fits(F.get(table, (at + by - 1).cast("int"))), at + by).otherwise(at)

        return F.aggregate(steps, F.lit(0).cast("bigint"), step) + F.lit(nulls)

    upper = F.when(column.isNull(), F.lit(nulls)).otherwise(below(lambda c: c <= column)).cast("int")
    if len(set(cuts)) == len(cuts):
        return upper

    def spread(up: Column) -> Column:
        low = F.when(column.isNull(), F.lit(0)).otherwise(below(lambda c: c < column)).cast("int")
        return F.when(up - low < 2, up).otherwise(low + F.floor((up - low + 1) * (tie / F.lit(float(1 << 63)))).cast("int"))

    return let(upper, spread)


def plain_names(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with columns other than ``keep`` renamed by position, so that none clashes with what an operator adds;
    ``toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[c if c in keep else f"column_{i}" for i, c in enumerate(df.columns)])


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 3_000_000
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not len(texts):
            continue
        sizes = np.asarray(
            pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64
        )
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def with_columns(
    df: DataFrame, fields: list[tuple[str, str]], compute: Callable[[pa.Array], dict[str, pa.Array]], text: str = "text", max_bytes: int = 3_000_000
) -> DataFrame:
    """All columns of ``df`` plus ``fields`` (name, DDL type), made from its text column batch by batch.

    A column of ``df`` that has the name of a new field is replaced.
    """
    spark = df.sparkSession
    df = df.drop(*[n for n, _ in fields])
    schema = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in fields)).schema
    out = type(df.schema)([*df.schema.fields, *schema.fields])
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, max_bytes):
            made = compute(part.column(part.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(made[n] for n in names)], names=[*part.schema.names, *names]
            )

    return df.mapInArrow(run, out)


def thinned(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows of ``df`` whose hashed ``keys`` are small: those of some ``THINNED * rows`` distinct keys, all rows where
    there are no more. Keys are counted (approximately) among the rows of ``df`` itself, so few rows stay whole whatever
    table they come from; what is ordered afterwards is small however large ``df`` is."""
    known = df.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()["n"]
    share = THINNED * rows / max(1, known)
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(F.lit(5), *keys), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)


def bounded_sample(df: DataFrame, rows: int, max_bytes: int) -> pd.DataFrame:
    """At most ``rows`` rows of ``df`` (doc_id, text, ...) with ``max_bytes`` of text together, sorted by id and text.

    Rows come in the order of a hash of id and text, the same on every run; rows equal in both count once. Only ids,
    hashes and sizes are ordered; then the chosen rows alone are fetched.
    """
    key = ["doc_id", "_hash"]
    marked = df.filter("doc_id IS NOT NULL").withColumns({"_hash": F.xxhash64("text"), "_bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    sizes = thinned(marked.select(*key, "_bytes"), key, rows).groupBy(*key).agg(F.max("_bytes").alias("_bytes"))
    first = sizes.orderBy(F.xxhash64(F.lit(17), *key), *key).limit(rows).toPandas()
    first = first[first["_bytes"].cumsum() <= max_bytes]
    chosen = df.sparkSession.createDataFrame([(int(d), int(h)) for d, h in zip(first["doc_id"], first["_hash"], strict=True)], "doc_id long, _hash long")
    others = [c for c in df.columns if c != "doc_id"]
    found = marked.join(F.broadcast(chosen), key).groupBy(*key).agg(F.min(F.struct(*others)).alias("_row"))
    return found.select("doc_id", "_row.*").toPandas().sort_values(["doc_id", "text"], kind="stable")
