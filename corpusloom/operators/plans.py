"""Plans that cut a module into chunks: repair of a model's plan, sizes, and what a plan violates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import gates, intervals
from corpusloom.sources.staging import staged

#: Chunk names of the plan repair (fixed values).
REST, WHOLE, NUMBERED = "残余", "整模块", "子块"
#: What may be wrong with a plan, as the report says it (fixed values).
TOO_LONG, PARTED = "子块「%s」有 %d 行，超过 {limit} 行", "循环调用组分在几个子块里："
#: Order of the residual chunk among those of a plan.
_LAST = 1 << 20


def cut_by_plan(plans: DataFrame, functions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, owners, unknown) of ``plans`` (module_id, parsed), repaired.

    Unknown functions drop out and are listed in ``unknown`` (module_id, name), the first claim of a function wins,
    unclaimed functions form the residual chunk, chunks without a function vanish and unnamed ones are numbered. A
    module without functions is one chunk of all its lines. ``chunks`` has a row for each range (module_id, chunk_no,
    chunk, purpose, functions, file, start, end), ``owners`` the chunk_no of every function name.
    """
    claims = plans.select("module_id", F.posexplode("parsed.chunks").alias("pos", "c")).select(
        "module_id", "pos", S.blank_free(F.col("c.name")).alias("chunk"), F.coalesce("c.purpose", F.lit("")).alias("purpose"), F.posexplode("c.functions").alias("at", "name")
    )
    known = functions.select("module_id", "file", "name", "line", "end_line")
    unknown = claims.select("module_id", "name").distinct().join(known.select("module_id", "name").distinct(), ["module_id", "name"], "left_anti")
    claim = F.struct("pos", "chunk", "purpose")
    rest = F.struct(F.lit(_LAST).alias("pos"), F.lit(REST).alias("chunk"), F.lit("方案未认领的函数").alias("purpose"))
    named = claims.withColumn("claim", claim).join(known.select("module_id", "name").distinct(), ["module_id", "name"], "left_semi")
    owned = gates.repaired_plan(named, known.select("module_id", "name").distinct(), ["module_id", "name"], [F.col("pos"), F.col("at")], "claim", rest=rest)
    owned = owned.select("module_id", "name", F.col("chunk.*"))
    order = F.dense_rank().over(W.partitionBy("module_id").orderBy("pos")) - 1
    owned = staged(owned.withColumn("chunk_no", order).withColumn("chunk", F.coalesce("chunk", F.concat(F.lit(NUMBERED), (F.col("chunk_no") + 1).cast("string")))).drop("pos"), "owned")
    placed = known.join(owned.select("module_id", "name", "chunk_no"), ["module_id", "name"])
    spans = intervals.owned_lines(known, lines.filter(F.col("file").endswith(".c")).select("module_id", "file", F.col("line_no").alias("line")), placed)
    per_chunk = owned.groupBy("module_id", "chunk_no", "chunk", "purpose").agg(F.count("*").cast("int").alias("functions"))
    planned = spans.filter("chunk_no IS NOT NULL").join(per_chunk, ["module_id", "chunk_no"])
    whole = lines.join(plans.select("module_id"), "module_id", "left_semi").join(planned.select("module_id").distinct(), "module_id", "left_anti")
    one = whole.groupBy("module_id", "file").agg(F.max("line_no").alias("end")).select(
        "module_id", F.lit(0).alias("chunk_no"), F.lit(WHOLE).alias("chunk"), F.lit("没有可用的方案").alias("purpose"), F.lit(0).alias("functions"), "file", F.lit(1).alias("start"), "end",
    )
    columns = ["module_id", "chunk_no", "chunk", "purpose", "functions", "file", "start", "end"]
    return planned.select(*columns).unionByName(one.select(*columns)), owned.select("module_id", "name", "chunk_no"), unknown


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """(module_id, chunk_no, chunk, functions, lines): total lines of each chunk's ranges."""
    return chunks.groupBy("module_id", "chunk_no", "chunk", "functions").agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))


def plan_violations(chunks: DataFrame, owners: DataFrame, cycles: DataFrame, limit: int) -> DataFrame:
    """(module_id, violations) of plans with a chunk above ``limit`` lines or a call cycle in several chunks."""
    large = chunk_sizes(chunks).filter(F.col("lines") > limit)
    sizes = large.select("module_id", F.col("chunk_no").alias("o"), F.format_string(TOO_LONG.format(limit=limit), "chunk", "lines").alias("text"))
    members = cycles.select("module_id", "group_no", F.explode("members").alias("name")).join(owners, ["module_id", "name"])
    parted = gates.split_groups(members, ["module_id", "group_no"], "chunk_no").join(cycles, ["module_id", "group_no"])
    split = parted.select("module_id", (F.col("group_no") + _LAST).alias("o"), F.concat(F.lit(PARTED), F.array_join("members", "、")).alias("text"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("o", "text"))), lambda x: x["text"])
    return sizes.unionByName(split).groupBy("module_id").agg(each.alias("violations"))
