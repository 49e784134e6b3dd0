"""Filter interaction audit: what every order of a few filters keeps, removes and loses, without running any order.

Each document becomes a mask of the filters that it fails, and Spark counts the documents of every (part, mask). The
subsets of the filters are then walked in Gray-code order: one filter is switched on or off at a time, each mask keeps
a counter of the active filters that it fails, and the survivors change by the masks whose counter leaves or reaches
zero. The survivors of all subsets are stored; a step of an order is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let, staged

#: White space between words, and the marks of filter D (fixed values).
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
FILTERS = "ABCDE"
#: Filters that one audit may hold: 7 have 5040 orders.
MOST_FILTERS = 7
COUNTS = ["docs", "good", "toxic"]


def text_failures(text: Column) -> Column:
    """Bits of the failed text filters: A (1) under 200 words, B (2) under half of the words distinct, C (4) over 2% of
    the characters in A-Z, D (8) holds one of the marks. A null text counts as empty and fails A alone."""

    def bits(words: Column) -> Column:
        n, upper = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]", ""))
        fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * upper > 2 * F.length(text), F.regexp_like(text, F.lit(MARKS))]
        return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))

    return let(F.filter(F.split(text, SPACE), lambda w: w != ""), bits)


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the filters that they fail, and how many of them are
    labelled quality = 1 and toxic = 1.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; a document counts as good or toxic where
    any label of its id says so. Filter E (16) fails where a smaller doc_id has the same text anywhere in the table;
    null and empty texts are the same text, a null doc_id is smaller than nothing and has nothing smaller, and of rows
    with one id none is smaller. A null source is the empty string. Other columns are ignored.

    Only hashes travel, never texts: a text's smallest id is an aggregation, and what meets it again is keyed by
    (text, doc_id), so a group of copies of any size spreads.
    """
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(
        F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text_failures(text).alias("bits"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"),
    )
    marked = staged(marked, "marked")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("quality <=> 1").alias("q"), F.expr("toxic <=> 1").alias("t")).filter("doc_id IS NOT NULL AND (q OR t)")
    said = said.groupBy("doc_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    known = marked.filter("doc_id IS NOT NULL")
    first = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = known.join(first, ["h1", "h2", "doc_id"], "left").join(said, "doc_id", "left")
    no = F.lit(False)
    rows = judged.select("part", F.when(F.col("first"), F.col("bits")).otherwise(F.col("bits") + 16).alias("mask"), F.coalesce("q", no).alias("q"), F.coalesce("t", no).alias("t")).unionByName(
        marked.filter("doc_id IS NULL").select("part", F.col("bits").alias("mask"), no.alias("q"), no.alias("t"))
    )
    return rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.count_if("q").alias("good"), F.count_if("t").alias("toxic"))


def survivors(cells: np.ndarray) -> np.ndarray:
    """What passes every subset of the filters: from counts [parts, masks, kinds] to [parts, subsets, kinds].

    Subset s applies the filters of its bits. One filter is switched at a time; a mask is out while its counter of
    active filters that it fails is above zero.
    """
    n = cells.shape[1]
    masks = np.arange(n)
    active = np.zeros(n, dtype=np.int64)
    out = np.empty_like(cells)
    now = cells.sum(axis=1)
    out[:, 0] = now
    state = 0
    for step in range(1, n):
        bit = (step & -step).bit_length() - 1
        state ^= 1 << bit
        touched = masks[(masks >> bit & 1) == 1]
        if state >> bit & 1:
            leaving = touched[active[touched] == 0]
            active[touched] += 1
            now = now - cells[:, leaving].sum(axis=1)
        else:
            active[touched] -= 1
            now = now + cells[:, touched[active[touched] == 0]].sum(axis=1)
        out[:, state] = now
    return out


def orders(filters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, subset before, filter number) of every step of every order."""
    at = {f: i for i, f in enumerate(filters)}
    out = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, before, at[f]))
            before |= 1 << at[f]
    return out


def filter_audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for every part of ``cells`` (part, mask, docs, good, toxic), order of ``filters`` and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A part
    is one row of arrays before it becomes rows, and a task handles a batch of parts at a time. No cells, no rows; a
    null mask counts nowhere.
    """
    if not 1 <= len(set(filters)) == len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} different filters")
    n = 1 << len(filters)
    sums = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}") for c in COUNTS for m in range(n)]
    wide = cells.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{c}_{m}" for m in range(n)]).alias(c) for c in COUNTS])
    plan = orders(filters)
    order, step = [p[0] for p in plan], np.array([p[1] for p in plan], dtype=np.int32)
    before, which = np.array([p[2] for p in plan]), np.array([p[3] for p in plan])
    bit = 1 << which
    failing = [np.flatnonzero(np.arange(n) >> f & 1) for f in range(len(filters))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 100):
                part = pdf.iloc[at : at + 100]
                counts = np.stack([np.stack(part[c].to_numpy()).astype(np.int64) for c in COUNTS], axis=2)
                left = survivors(counts)
                lost = left[:, before] - left[:, before | bit]
                total = np.stack([counts[:, f, 0].sum(axis=1) for f in failing], axis=1)
                by_filter = np.stack([lost[:, which == f, 0].sum(axis=1) for f in range(len(filters))], axis=1)
                removed = lost[:, :, 0]
                yield pd.DataFrame({
                    "part": np.repeat(part["part"].to_numpy(), len(plan)), "filter_order": order * len(part), "step": np.tile(step, len(part)),
                    "kept": left[:, before | bit, 0].ravel(), "removed": removed.ravel(), "redundant": (total[:, which] - removed).ravel(),
                    "unique_fails": counts[:, bit, 0].ravel(), "good_lost": lost[:, :, 1].ravel(), "toxic_lost": lost[:, :, 2].ravel(), "shapley": by_filter[:, which].ravel(),
                })

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return wide.mapInPandas(run, schema)
