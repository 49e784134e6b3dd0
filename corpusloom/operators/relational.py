"""Joins, first-wins choices, budgets and counts on keyed tables. Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S


def inventory(docs: DataFrame, group: str = "source") -> DataFrame:
    """One row per group, numbered by name: id, name, files, lines, chars, estimated_tokens.

    ASCII characters add up before the token estimate rounds once. The numbering window sees one row per group.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sums = docs.groupBy(group).agg(
        F.count("*").alias("files"), F.sum(S.line_count(text)).alias("lines"), F.sum(F.length(text)).alias("chars"), F.sum(S.ascii_chars(text)).alias("_ascii")
    )
    number = F.row_number().over(W.orderBy(group))
    return sums.select(
        F.format_string("M%02d", number).alias("id"), F.col(group).alias("name"), "files", "lines", "chars",
        S.token_estimate(F.col("_ascii"), F.col("chars")).alias("estimated_tokens"),
    )


def size_routes(modules: DataFrame, threshold: int) -> DataFrame:
    """Modules and lines on the small and the large route."""
    route = F.when(F.col("lines") > threshold, "large").otherwise("small")
    return modules.groupBy(route.alias("route")).agg(F.count("*").alias("modules"), F.sum("lines").alias("lines"))


def unanswered(items: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Items without an answer: the one predicate behind every completeness rule."""
    return items.join(answers.select(*on), on, "left_anti")


def concluded(items: DataFrame, answers: DataFrame, on: list[str], conclusion: Column, latest: Column) -> DataFrame:
    """Items with the conclusion of their latest answer, or the pending one."""
    last = answers.groupBy(*on).agg(F.max_by(conclusion, latest).alias("conclusion"))
    return items.join(last, on, "left").withColumn("conclusion", F.coalesce("conclusion", F.lit(S.PENDING)))


def resolved(uses: DataFrame, definitions: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(once, several, never): ``uses`` of names that ``definitions`` has once, several times, or not at all."""
    counts = definitions.groupBy(*on).agg(F.count("*").alias("_n"))
    looked = uses.join(counts, on, "left")
    return looked.filter("_n = 1").drop("_n"), looked.filter("_n > 1").drop("_n"), looked.filter("_n IS NULL").drop("_n")


def first_and_copies(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """(order, copies): the first row of each content and how often the content comes; only hashes travel."""
    keyed = rows.select(F.sha2(content, 256).alias("_content"), order)
    return keyed.groupBy("_content").agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("_content")


def graded_counts(rows: DataFrame, grade: str, order: list[str]) -> DataFrame:
    """(grade, n, rank): rows of each grade and its place in the closed list, null outside it."""
    return rows.groupBy(grade).agg(F.count("*").alias("n")).withColumn("rank", S.ranked(F.col(grade), order))


def urgent(rows: DataFrame, grade: str, grades: list[str], conclusion: Column, arrival: str) -> DataFrame:
    """(n, first) of the rows that stand and have one of the ``grades``: what a summary names first."""
    return rows.filter(F.col(grade).isin(grades) & conclusion).agg(F.count("*").alias("n"), F.min(arrival).alias("first"))


def sole_owner(definitions: DataFrame, name: str, owner: str) -> DataFrame:
    """Names defined by exactly one owner; names of several owners leave altogether."""
    return definitions.groupBy(name).agg(F.min(owner).alias("owner"), F.max(owner).alias("_other")).filter("owner = _other").drop("_other")


def foreign_uses(uses: DataFrame, index: DataFrame, name: str, module: str) -> DataFrame:
    """Uses of names that another module alone defines."""
    return uses.join(index, name).filter(F.col(module) != F.col("owner"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """First row of each key: an aggregation of one struct, so nothing is sorted and hot keys pre-aggregate."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def top_per_key(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key and whether more exist."""
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rn") <= limit + 1)
    more = F.max("rn").over(W.partitionBy(key)) > limit
    return ranked.withColumn("truncated", more).filter(F.col("rn") <= limit)


def within_budget(rows: DataFrame, key: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each key until ``budget`` is used up; the row that crosses it keeps the remainder: adds keep, truncated."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.withColumn("_before", before).filter(F.col("_before") < budget)
        .withColumns({"keep": F.least(size, budget - F.col("_before")).cast("long"), "truncated": size > budget - F.col("_before")})
        .drop("_before")
    )


def counts_by(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One count per value, zeros included, in one pass."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def report_order(rows: DataFrame, key: str, block: Column, severity: Column, arrival: str) -> DataFrame:
    """Position of each row in its report: block, then severity, then order of arrival."""
    order = W.partitionBy(key).orderBy(block, severity, arrival)
    return rows.withColumn("position", F.row_number().over(order).cast("long"))


def adjacency(edges: DataFrame, module: str) -> DataFrame:
    """Distinct callees of each caller, sorted and joined."""
    callees = F.array_join(F.sort_array(F.collect_set("dst")), "、")
    return edges.groupBy(module, "src").agg(callees.alias("callees"))


def setop_counts(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (op, n) for labelled key sets."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in named])


def layered(*layers: Column, builtin: Column) -> Column:
    """The uppermost layer that is set, blank counting as unset."""
    return F.coalesce(*[S.blank_free(c) for c in layers], builtin)


def fixed_width(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Each row as one line of cells padded to the widest value of its column."""
    padded = [F.rpad(F.col(c), rows.agg(F.max(F.length(c))).scalar(), F.lit(" ")) for c in columns]
    return rows.select(key, F.concat_ws("  ", *padded).alias("line"))


def close_matches(findings: DataFrame, truth: DataFrame, on: list[str], line: str, within: int, grade: str | None = None, grades: int = 1) -> DataFrame:
    """Pairs of a finding and a labelled row of the same place: at most ``within`` lines apart and, with a ``grade``
    column, at most ``grades`` grades. Adds _truth (and _grade), the labelled line (and grade)."""
    other = truth.withColumnRenamed(line, "_truth")
    if grade:
        other = other.withColumnRenamed(grade, "_grade")
    near = findings.join(other, on).filter(F.abs(F.col(line) - F.col("_truth")) <= within)
    return near.filter(F.abs(F.col(grade) - F.col("_grade")) <= grades) if grade else near
