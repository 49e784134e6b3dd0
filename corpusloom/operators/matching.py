"""One-to-one matching of findings to labelled truth, and scores by grade with hits on decoys.

Findings and truths of one group (a file and a class of defect) match where the place fits and the grades are at most
some grades apart. Groups fall into islands that no match crosses, so a task only ever holds one island. In an island
the matching is as large as possible, and both sides take precedence in their own order: an earlier finding (or truth)
stays unmatched only if no largest matching of those before it leaves room. Those two sets depend on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S


def best_pairs(near: list[list[int]], truths: int) -> list[int]:
    """Truth of each finding (-1 without one), from the truths near each finding, by augmenting paths.

    Findings are taken in order, and a finding once matched stays matched. Then truths are taken in order: along
    alternating paths an earlier truth takes the place of a later one, which leaves the matched findings as they are.
    """
    of_finding, of_truth = [-1] * len(near), [-1] * truths

    def join(start: int) -> bool:
        """Breadth first from a finding without truth to a free truth, then flip the path."""
        came: dict[int, int] = {}
        line = [start]
        for f in line:
            for t in near[f]:
                if t in came:
                    continue
                came[t] = f
                if of_truth[t] < 0:
                    while t >= 0:
                        f = came[t]
                        of_truth[t], of_finding[f], t = f, t, of_finding[f]
                    return True
                line.append(of_truth[t])
        return False

    for f in range(len(near)):
        join(f)
    around: list[list[int]] = [[] for _ in range(truths)]
    for f, ts in enumerate(near):
        for t in ts:
            around[t].append(f)
    for start in range(truths):
        if of_truth[start] >= 0:
            continue
        # a later truth that can give way; taking the latest one keeps all earlier ones
        came, line, last = {}, [start], -1
        for t in line:
            for f in around[t]:
                if of_finding[f] not in came and of_finding[f] >= 0:
                    came[of_finding[f]] = (t, f)
                    line.append(of_finding[f])
                    last = max(last, of_finding[f])
        if last > start:
            t, of_truth[last] = last, -1
            while t != start:
                t, f = came[t]
                of_finding[f], of_truth[t] = t, f
    return of_finding


def _islands(rows: DataFrame, on: list[str]) -> DataFrame:
    """Numbers the islands of each group: a row begins one where everything before it ends earlier."""
    line = W.partitionBy(*on).orderBy("_low", "_high", "_is_truth", "_order")
    before = F.max("_high").over(line.rowsBetween(W.unboundedPreceding, -1))
    starts = (before.isNull() | (F.col("_low") > before)).cast("long")
    return rows.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(line)).drop("_start")


def one_to_one(findings: DataFrame, truth: DataFrame, on: list[str], within: int = 0, grades: int | None = 1) -> DataFrame:
    """(on, finding, truth): one row for each finding and truth, matched ones together, others with null on one side.

    ``findings`` has ``on``, id, line, grade (int) and order; ``truth`` has ``on``, id, first_line, last_line, grade and
    order. Ids are unique in a group; ``order`` decides who goes first (ties by id), nulls last. A place fits within
    ``within`` lines of the labelled lines; ``grades`` None compares no grades, and a null line or grade fits nothing.
    Rows with a null in ``on`` match nothing and stay.
    """
    fits = F.lit(True) if grades is None else F.col("grade").isNotNull()
    f = findings.select(*on, F.lit(False).alias("_is_truth"), F.col("id").cast("string").alias("_id"), "line", "grade", "order", F.col("line").alias("_low"), F.col("line").alias("_high"), (F.col("line").isNotNull() & fits).alias("_can"))
    t = truth.select(
        *on, F.lit(True).alias("_is_truth"), F.col("id").cast("string").alias("_id"), F.lit(None).cast("long").alias("line"), "grade", "order", (F.col("first_line") - within).alias("_low"),
        (F.coalesce("last_line", "first_line") + within).alias("_high"), (F.col("first_line").isNotNull() & fits).alias("_can"),
    )
    sized = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("line", "grade", "_low", "_high")})
    rows = sized(f).unionByName(sized(t)).withColumn("order", F.col("order").cast("double"))
    able = F.col("_can")
    for c in on:
        able = able & F.col(c).isNotNull()
    left = rows.filter(~able)
    placed = _islands(rows.filter(able).withColumn("_order", F.coalesce("order", F.lit(float("inf")))), on).select(*on, "_island", "_is_truth", "_id", "line", "grade", "_low", "_high", "_order")
    keys = [*on, "_island"]

    def solve(island: list[tuple]) -> list[tuple]:
        """(finding, truth) of one island of (is_truth, id, line, grade, low, high, order)."""
        island = sorted(island, key=lambda r: (r[6], r[1]))
        fs, ts = [r for r in island if not r[0]], [r for r in island if r[0]]
        near = [[j for j, t in enumerate(ts) if t[4] <= f[2] <= t[5] and (grades is None or abs(t[3] - f[3]) <= grades)] for f in fs]
        pairs = best_pairs(near, len(ts))
        free = sorted(set(range(len(ts))) - set(pairs))
        return [(f[1], ts[t][1] if t >= 0 else None) for f, t in zip(fs, pairs, strict=True)] + [(None, ts[t][1]) for t in free]

    body = ["_is_truth", "_id", "line", "grade", "_low", "_high", "_order"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        island: list[tuple] = []
        for pdf in batches:
            done: list[tuple] = []
            for name, row in zip(zip(*(pdf[k] for k in keys), strict=True), zip(*(pdf[c] for c in body), strict=True), strict=True):
                if name != key:
                    done += [(*key[:-1], *pair) for pair in solve(island)] if key else []
                    key, island = name, []
                island.append(row)
            yield pd.DataFrame(done, columns=[*on, "finding", "truth"], dtype=object)
        if key:
            yield pd.DataFrame([(*key[:-1], *pair) for pair in solve(island)], columns=[*on, "finding", "truth"], dtype=object)

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in on) + ", finding string, truth string"
    # an island without truths or without findings has nothing to match and does not travel to Python
    both = F.min("_is_truth").over(W.partitionBy(*keys)) != F.max("_is_truth").over(W.partitionBy(*keys))
    marked = placed.withColumn("_both", both)
    alone = marked.filter(~F.col("_both")).select(*on, "_is_truth", "_id").unionByName(left.select(*on, "_is_truth", "_id"))
    matched = marked.filter("_both").drop("_both").sortWithinPartitions(*keys).mapInPandas(run, schema)
    return matched.unionByName(alone.select(*on, F.when(~F.col("_is_truth"), F.col("_id")).alias("finding"), F.when(F.col("_is_truth"), F.col("_id")).alias("truth")))


def decoy_hits(findings: DataFrame, decoys: DataFrame, pairs: DataFrame, on: list[str], place: list[str], within: int = 0) -> DataFrame:
    """``decoys`` (``place``, id, first_line, last_line) plus hits: findings without a truth that lie on them.

    ``pairs`` comes from ``one_to_one``; ``place`` are the columns of ``on`` that decoys have too, such as the file.
    """
    wrong = findings.withColumn("finding", F.col("id").cast("string")).join(pairs.filter("truth IS NOT NULL").select(*on, "finding"), [*on, "finding"], "left_anti")
    spans = decoys.select(*place, F.col("id").alias("_decoy"), (F.col("first_line") - within).alias("_low"), (F.coalesce("last_line", "first_line") + within).alias("_high"))
    counts = wrong.select(*place, "line").join(spans, place).filter(F.col("line").between(F.col("_low"), F.col("_high"))).groupBy(*place, "_decoy").agg(F.count("*").alias("hits"))
    return decoys.join(counts.withColumnRenamed("_decoy", "id"), [*place, "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def scores(findings: DataFrame, truth: DataFrame, pairs: DataFrame, on: list[str], decoys: DataFrame | None = None) -> DataFrame:
    """(grade, findings, right, truths, found, precision, recall, decoys, decoys_hit) by grade and, with a null grade, in
    all. Precision counts findings of a grade, recall truths of a grade; null where there are none. Decoys (with hits)
    have no grade and count in the total alone."""
    right = pairs.filter("finding IS NOT NULL AND truth IS NOT NULL")
    f = findings.withColumn("finding", F.col("id").cast("string")).join(right.select(*on, "finding", F.lit(1).alias("_hit")), [*on, "finding"], "left")
    t = truth.withColumn("truth", F.col("id").cast("string")).join(right.select(*on, "truth", F.lit(1).alias("_hit")), [*on, "truth"], "left")
    columns = ["findings", "right", "truths", "found", "decoys", "decoys_hit"]

    def counted(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(F.col("grade").cast("int").alias("grade"), *[given.get(c, F.lit(0)).cast("long").alias(c) for c in columns])

    hit = F.coalesce("_hit", F.lit(0))
    rows = counted(f, findings=F.lit(1), right=hit).unionByName(counted(t, truths=F.lit(1), found=hit))
    if decoys is not None:
        rows = rows.unionByName(counted(decoys.withColumn("grade", F.lit(None)), decoys=F.lit(1), decoys_hit=(F.col("hits") > 0).cast("int")))
    summed = rows.filter("grade IS NOT NULL").groupBy("grade").agg(*[F.sum(c).alias(c) for c in columns])
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).withColumn("grade", F.lit(None).cast("int"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    return summed.unionByName(total).withColumns({"precision": share("right", "findings"), "recall": share("found", "truths")})


def graded(severity: Column) -> Column:
    """Grade of a severity for ``one_to_one``: 0 for the worst, null outside the closed list."""
    return S.ranked(severity, S.SEVERITIES)
