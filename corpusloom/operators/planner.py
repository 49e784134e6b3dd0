"""Plans without a model: call graphs packed into chunks of bounded size that keep cycles whole and hubs with callees.

Functions that call one another in a circle are one unit. A unit joins its callers' chunk where it has only one calling
unit (a hub keeps the callees that are its own), as long as the chunk stays within the limit. What results is packed
into chunks in the order of the source, each as full as the limit allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.sources.staging import staged

#: Name and purpose of planned chunks (fixed values).
NAME, PURPOSE = "子块", "按调用关系自动划分"


def units(functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, calls): (module_id, name, unit) of every function, a unit named by its smallest member, and the distinct
    (module_id, src, dst) between units.

    ``functions`` has (module_id, name, ...), ``edges`` (module_id, src, dst); calls of functions that are not listed
    do not count, functions of one name are one.
    """
    names = functions.select("module_id", "name").distinct()
    ends = [names.select("module_id", F.col("name").alias(c)) for c in ("src", "dst")]
    known = edges.select("module_id", "src", "dst").join(ends[0], ["module_id", "src"], "left_semi").join(ends[1], ["module_id", "dst"], "left_semi")
    # written module by module: what touches lies in one task as a rule, and calls are read twice
    known = staged(known.repartition("module_id"), "calls")
    labels = graph.strong_labels(known, "module_id").withColumnRenamed("node", "name")
    members = staged(names.join(labels, ["module_id", "name"], "left").select("module_id", "name", F.coalesce("label", "name").alias("unit")), "members")
    of = [labels.select("module_id", F.col("name").alias(c), F.col("label").alias(f"u_{c}")) for c in ("src", "dst")]
    units_of = known.join(of[0], ["module_id", "src"], "left").join(of[1], ["module_id", "dst"], "left").select("module_id", F.coalesce("u_src", "src").alias("src"), F.coalesce("u_dst", "dst").alias("dst"))
    calls = units_of.filter("src <> dst").distinct()
    return members, calls


def packed(functions: DataFrame, edges: DataFrame, limit: int, lines: DataFrame) -> DataFrame:
    """(module_id, name, unit, chunk_no) of every function of ``functions`` (module_id, file, name, line, end_line).

    The lines of a function are its own and those since the function before it in its file, and the last one has the
    rest of the file (``lines`` with module_id, file, line_no), so the ranges of the plan stay within ``limit`` too. A
    chunk is only larger than the limit where one unit is. Chunks are numbered by module in the order of the source; a task holds one module.
    """
    line = W.partitionBy("module_id", "file").orderBy("line", "end_line")
    ends = lines.groupBy("module_id", "file").agg(F.max("line_no").alias("tail"))
    before = F.coalesce(F.max("end_line").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    to = F.when(F.lead("line").over(line).isNull(), F.greatest("tail", "end_line")).otherwise(F.col("end_line"))
    placed = functions.select("module_id", "file", "name", "line", "end_line").join(ends, ["module_id", "file"], "left")
    sized = placed.withColumn("lines", F.greatest(F.lit(0), to - before)).withColumn("at", F.struct("file", "line"))
    members, calls = units(functions, edges)
    size = sized.groupBy("module_id", "name").agg(F.sum("lines").alias("lines"), F.min("at").alias("at")).join(members, ["module_id", "name"])
    nodes = size.groupBy("module_id", "unit").agg(F.sum("lines").alias("lines"), F.min("at").alias("at"))
    order = F.row_number().over(W.partitionBy("module_id").orderBy("at", "unit"))
    nodes = nodes.select("module_id", "unit", F.lit(None).cast("string").alias("dst"), F.col("lines").cast("long").alias("lines"), order.alias("no"))
    rows = nodes.unionByName(calls.select("module_id", F.col("src").alias("unit"), "dst"), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lines, nos, into = None, {}, {}, {}

        def solved() -> list[tuple]:
            ordered = sorted(lines, key=nos.get)
            return [(key, u, c) for u, c in chunks_of(ordered, lines, into, limit).items()] if key is not None else []

        for pdf in batches:
            done: list[tuple] = []
            for m, unit, dst, n, no in zip(pdf["module_id"], pdf["unit"], pdf["dst"], pdf["lines"], pdf["no"], strict=True):
                if m != key:
                    done += solved()
                    key, lines, nos, into = m, {}, {}, {}
                if dst is None:
                    lines[unit], nos[unit] = int(n), int(no)
                else:
                    into.setdefault(dst, []).append(unit)
            yield pd.DataFrame(done, columns=["module_id", "unit", "chunk_no"], dtype=object)
        yield pd.DataFrame(solved(), columns=["module_id", "unit", "chunk_no"], dtype=object)

    kind = dict(rows.dtypes)["module_id"]
    chunks = rows.repartition("module_id").sortWithinPartitions("module_id", "dst", "no").mapInPandas(run, f"module_id {kind}, unit string, chunk_no int")
    return members.join(chunks, ["module_id", "unit"]).select("module_id", "name", "unit", "chunk_no")


def chunks_of(order: list[str], lines: dict[str, int], callers: dict[str, list[str]], limit: int) -> dict[str, int]:
    """Chunk number of each unit: units with a single caller follow it while there is room, then groups are packed in
    ``order``, the first open chunk with room taking each."""
    head = {u: u for u in order}
    size = dict(lines)

    def top(u: str) -> str:
        while head[u] != u:
            head[u] = head[head[u]]
            u = head[u]
        return u

    for u in order:
        of = callers.get(u, [])
        if len(of) == 1 and of[0] in lines:
            a, b = top(of[0]), top(u)
            if a != b and size[a] + size[b] <= limit:
                head[b] = a
                size[a] += size[b]
    rooms: list[int] = []
    chunk: dict[str, int] = {}
    for u in order:
        t = top(u)
        if t not in chunk:
            at = next((i for i in range(max(0, len(rooms) - 8), len(rooms)) if rooms[i] >= size[t]), len(rooms))
            if at == len(rooms):
                rooms.append(limit)
            rooms[at] -= size[t]
            chunk[t] = at
        chunk[u] = chunk[t]
    return {u: chunk[u] for u in order}


def planned(functions: DataFrame, edges: DataFrame, limit: int, lines: DataFrame) -> DataFrame:
    """(module_id, parsed) as ``plans.cut_by_plan`` takes it: one named chunk after the other, functions by name."""
    by_chunk = packed(functions, edges, limit, lines).groupBy("module_id", "chunk_no").agg(F.sort_array(F.collect_set("name")).alias("functions"))
    chunk = F.struct(F.concat(F.lit(NAME), (F.col("chunk_no") + 1).cast("string")).alias("name"), F.lit(PURPOSE).alias("purpose"), "functions")
    listed = by_chunk.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", chunk.alias("c")))).alias("l"))
    none = F.array().cast("array<string>")
    parsed = F.struct(none.alias("patterns"), F.lit("").alias("summary"), F.lit(PURPOSE).alias("strategy"), F.transform("l", lambda x: x["c"]).alias("chunks"))
    return listed.select("module_id", parsed.alias("parsed"))
