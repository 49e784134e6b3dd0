"""Quality gates on model output: all-or-nothing, row by row, plan repair, and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S

#: Rows that a task joins and sorts: some 100 MB.
DEALT = 250_000


def first_problem(rows: DataFrame, module: str, position: str, problem: Column) -> DataFrame:
    """(module, reason) of modules with a bad row; the reason names the first one, counted from 1."""
    bad = rows.withColumn("_problem", problem).filter("_problem IS NOT NULL")
    text = F.concat(F.lit("第 "), F.col(position).cast("string"), F.lit(" 条："), F.col("_problem"))
    return bad.groupBy(module).agg(F.min_by(text, F.col(position)).alias("reason"))


def all_or_nothing(rows: DataFrame, module: str, position: str, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of sound modules, (module, reason) of failed ones): one bad row fails its module, others continue."""
    failed = first_problem(rows, module, position, problem)
    return rows.join(failed.select(module), module, "left_anti"), failed


def finding_problem() -> Column:
    """What is wrong with a finding, checked in this order; null if nothing is."""
    line = F.expr("try_cast(line AS bigint)")
    out = F.when(line.isNull() | (line < 1), F.lit("line 不是不小于 1 的整数"))
    out = out.when(~F.coalesce(F.col("severity").isin(S.SEVERITIES), F.lit(False)), F.lit("severity 不在允许的取值内"))
    for name in ("file", "description", "evidence", "suggestion"):
        out = out.when(S.blank_free(F.col(name)).isNull(), F.lit(f"{name} 为空"))
    return out


def dealt(rows: DataFrame, marks: DataFrame, keys: list[str], per_task: int = DEALT) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``marks`` dealt by ``keys`` over one number of partitions, which follows the count of ``rows``.

    A join by ``keys`` and a ``row_gate`` after it then sort some ``per_task`` rows in a task, however many there are. The
    rows are counted, so tables or staged rows should be given.
    """
    parts = max(-(-rows.count() // per_task), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys), marks.repartition(parts, *keys)


def row_gate(rows: DataFrame, keys: list[str], order: list[str], checks: list[tuple[Column, str]]) -> DataFrame:
    """Adds ``verdict``: the first failed check, ``duplicate`` for a later valid row of a key, else ``accepted``.

    Only valid rows compete, so a bad first copy does not block a good second one.
    """
    verdict = F.lit(None).cast("string")
    for holds, name in reversed(checks):
        verdict = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(verdict)
    judged = rows.withColumn("_bad", verdict)
    turn = F.row_number().over(W.partitionBy(*keys, F.col("_bad").isNull()).orderBy(*order))
    return judged.withColumn("verdict", F.coalesce("_bad", F.when(turn > 1, "duplicate").otherwise("accepted"))).drop("_bad")


def give_up(items: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Answers plus one pending row for every item still without one: nothing disappears."""
    missing = items.join(answers.select(*on), on, "left_anti").select(*on, F.lit(S.PENDING).alias("conclusion"), F.lit(S.NO_ANSWER).alias("reason"))
    return answers.select(*on, "conclusion", "reason").unionByName(missing)


def repaired_plan(claims: DataFrame, known: DataFrame, keys: list[str], order: list[Column], chunk: str, rest: str | Column = "残余") -> DataFrame:
    """One chunk for every known item: its first claim, or the residual chunk; claims of unknown items drop out."""
    first = claims.groupBy(*keys).agg(F.min_by(F.col(chunk), F.struct(*order)).alias("chunk"))
    return known.select(*keys).join(first, keys, "left").withColumn("chunk", F.coalesce("chunk", F.lit(rest) if isinstance(rest, str) else rest))


def split_groups(members: DataFrame, group: list[str], owner: str) -> DataFrame:
    """Groups whose members lie in more than one chunk: (group, owners)."""
    return members.groupBy(*group).agg(F.count_distinct(owner).alias("owners")).filter("owners > 1")


def unfinished(replies: DataFrame, module: str, order: Column, unit: Column, error: Column) -> DataFrame:
    """(module, kept, unfinished): how many units of a module were answered, and which were not and why; a failed unit
    takes nothing from the others."""
    failed = F.when(error.isNotNull(), F.struct(order.alias("o"), F.concat(unit, F.lit("："), error).alias("t")))
    texts = F.transform(F.sort_array(F.collect_list(failed)), lambda x: x["t"])
    open_ = F.when(F.count(error) > 0, F.array_join(texts, "；"))
    return replies.groupBy(module).agg(F.count_if(error.isNull()).alias("kept"), open_.alias("unfinished"))


def folded_replies(deltas: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, reply, finish, usage, chunks) of streamed replies (keys, position, text, finish, usage): texts joined in
    order, the last finish reason that is set, the first usage that is, and the number of chunks.

    Where ``deltas`` has a ``channel``, only pieces of other channels than ``reasoning`` are the reply; what was
    reasoning, and its share of all characters in whole percent (half to even, 0 of nothing), come in addition.
    """
    at, piece = F.col(position), F.coalesce("text", F.lit(""))

    def joined(keep: Column) -> Column:
        pieces = F.collect_list(F.when(keep, F.struct(position, piece.alias("t"))))
        return F.array_join(F.transform(F.sort_array(pieces), lambda x: x["t"]), "")

    last = F.max_by("finish", F.when(F.nullif(F.col("finish"), F.lit("")).isNotNull(), at)).alias("finish")
    told = [last, F.min_by("usage", F.when(F.col("usage").isNotNull(), at)).alias("usage"), F.count("*").alias("chunks")]
    if "channel" not in deltas.columns:
        return deltas.groupBy(*keys).agg(joined(F.lit(True)).alias("reply"), *told)
    thought = F.col("channel").eqNullSafe("reasoning")
    folded = deltas.groupBy(*keys).agg(joined(~thought).alias("reply"), *told, joined(thought).alias("reasoning"))
    total = F.length("reasoning") + F.length("reply")
    return folded.withColumn("reasoning_pct", F.when(total > 0, F.bround(F.length("reasoning") * 100 / total, 0)).otherwise(F.lit(0)).cast("int"))
