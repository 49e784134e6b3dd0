"""Reachability and cyclic groups of call graphs, many modules at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.components import connected_components
from corpusloom.sources.staging import staged

#: Edges of a class that one task solves whole: some 20 MB of Python.
IN_TASK = 50_000
#: Edges of a class that one task closes, which may give the square of them as rows.
CLOSED_IN_TASK = 2_000
#: Edges that a task joins at a time, and nodes in the lists it gives out at a time: some 100 MB of Python.
IN_CHUNK = 500_000


def parted(edges: DataFrame, module: str) -> DataFrame:
    """Edges as (_m, src, dst, cls), written: edges that touch have one class, whatever else shares it.

    Tasks first join what touches among the edges they hold, ``IN_CHUNK`` at a time; only where a node lies in several
    such parts the parts are joined over tasks. So edges that come module by module, as a rule, move once, by the hash of
    their nodes, and no rounds depend on the length of paths. Nodes are compared by hashes: two that collide make a
    class larger, never smaller. An edge with a null is a class of its own.
    """
    whole = F.col("_m").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    at = lambda end: F.when(whole, F.xxhash64("_m", end)).otherwise(F.xxhash64("_m", "src", "dst")).alias(f"_{end}")
    ends = edges.select(F.col(module).alias("_m"), "src", "dst").select("_m", "src", "dst", at("src"), at("dst"))
    kinds = ", ".join(f"{c} {k}" for c, k in ends.dtypes[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= IN_CHUNK:
                yield from _parts(held)
                held, rows = [], 0
        if rows:
            yield from _parts(held)

    part = staged(ends.mapInArrow(run, f"{kinds}, _src bigint, _dst bigint, cls bigint"), "parts")
    places = part.select("cls", F.explode(F.array("_src", "_dst")).alias("node"))
    shared = staged(places.groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("node", "low"), "shared")
    part = part.drop("_src", "_dst")
    if shared.isEmpty():
        return part
    links = places.join(shared, "node").filter("cls <> low").select(F.col("cls").alias("u"), F.col("low").alias("v"))
    of = connected_components(links).withColumnRenamed("node", "cls")
    return staged(part.join(of, "cls", "left").select("_m", "src", "dst", F.coalesce("component", "cls").alias("cls")), "parts")


def _parts(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the smallest node hash of the part of each edge, where parts are what touches among them."""
    src, dst = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (3, 4))
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = place[: len(src)], place[len(src) :]
    top = np.arange(len(nodes))
    while True:
        # the tops of both ends hang below the lesser one, and nodes climb to their top
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            break
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
    cls, at = nodes[top[place[: len(src)]]], 0
    for b in held:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls[at : at + len(b)])], names=[*b.schema.names, "cls"])
        at += len(b)


def closure(edges: DataFrame, module: str, in_task: int = CLOSED_IN_TASK) -> DataFrame:
    """Every (module, src, dst) with a path from src to dst.

    Edges are parted into classes that no path crosses. Classes of at most ``in_task`` edges are closed inside tasks,
    many to a task, node by node, and the nodes reached leave as one list. In larger ones path lengths double, by joins,
    until nothing is new. A class's closure is bounded by the square of its own nodes. Nulls in an edge join nothing.
    """
    part = parted(edges, module)
    whole = "_m IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL"
    torn = part.filter(f"NOT ({whole})").select("_m", "src", "dst").distinct()
    part = part.filter(whole)
    large = staged(part.groupBy("_m", "cls").agg(F.count("*").alias("n")).filter(F.col("n") > in_task).select("_m", "cls"), "large")
    if large.isEmpty():
        found = _closed_in_tasks(part)
    else:
        found = _closed_in_tasks(part.join(large, ["_m", "cls"], "left_anti")).unionByName(_doubled(part.join(large, ["_m", "cls"], "left_semi")))
    return found.unionByName(torn).withColumnRenamed("_m", module)


def _closed_in_tasks(edges: DataFrame) -> DataFrame:
    """The closure of classes that are small enough: sorted by class, and closed one after the other as a stream."""
    kind = dict(edges.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_classes(batches):
            coded = pa.concat_arrays([rows.column(end).combine_chunks() for end in ("src", "dst")]).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            src, dst = codes[: len(rows)].tolist(), codes[len(rows) :].tolist()
            cuts = _starts(rows)
            heads, first, reached, sizes = [], [], [], [0]

            def told(heads: list[int], first: list[int], reached: list[int], sizes: list[int]) -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), coded.dictionary.take(pa.array(reached, pa.int32())))
                of = rows.column("_m").take(pa.array(first, pa.int64())).combine_chunks()
                return pa.RecordBatch.from_arrays([of, coded.dictionary.take(pa.array(heads, pa.int32())), lists], names=["_m", "src", "dst"])

            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                near: dict[int, list[int]] = {}
                for s, d in zip(src[a:b], dst[a:b], strict=True):
                    near.setdefault(s, []).append(d)
                for s in near:
                    seen = dict.fromkeys(near[s])
                    todo = list(seen)
                    for x in todo:
                        for y in near.get(x, ()):
                            if y not in seen:
                                seen[y] = None
                                todo.append(y)
                    heads.append(s)
                    first.append(a)
                    reached += todo
                    sizes.append(len(todo))
                    if len(reached) > IN_CHUNK:
                        yield told(heads, first, reached, sizes)
                        heads, first, reached, sizes = [], [], [], [0]
            if heads:
                yield told(heads, first, reached, sizes)

    lists = edges.repartition("_m", "cls").sortWithinPartitions("cls", "_m").mapInArrow(run, f"_m {kind['_m']}, src {kind['src']}, dst array<{kind['dst']}>")
    return lists.select("_m", "src", F.explode("dst").alias("dst"))


def _whole_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by class, as tables that end where a class ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < 10_000:
            continue
        table = pa.Table.from_batches(held)
        last = int(_starts(table)[-1])
        if last:
            yield table.slice(0, last)
        held, rows = table.slice(last).to_batches(), 0
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> list[int]:
    """Where the classes of sorted rows begin."""
    cls = table.column("cls").to_numpy()
    of = table.column("_m").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero((cls[1:] != cls[:-1]) | (of[1:] != of[:-1])) + 1).tolist()]


def _doubled(edges: DataFrame) -> DataFrame:
    """The closure of (_m, src, dst) by doubling path lengths; every round is a join by (_m, node)."""
    delta = staged(edges.select("_m", "src", "dst").distinct())
    parts = [delta]
    while True:
        # only paths with a new half can be new; what is known stays written as it is
        known = reduce(DataFrame.unionByName, parts)
        heads = [df.select("_m", F.col("dst").alias("src"), F.col("src").alias("_from")) for df in (delta, known)]
        longer = heads[0].join(known, ["_m", "src"]).unionByName(heads[1].join(delta, ["_m", "src"])) if len(parts) > 1 else heads[0].join(known, ["_m", "src"])
        delta = staged(longer.select("_m", F.col("_from").alias("src"), "dst").distinct().join(known, ["_m", "src", "dst"], "left_anti"))
        if delta.isEmpty():
            return known
        parts.append(delta)


def cycles(reach: DataFrame, module: str) -> DataFrame:
    """Groups of nodes that reach one another (a self-loop is a group), members sorted, from a closure."""
    back = reach.select(module, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = reach.join(back, [module, "src", "dst"], "left_semi")
    label = mutual.groupBy(module, "src").agg(F.min("dst").alias("label"))
    return label.groupBy(module, "label").agg(F.sort_array(F.collect_list("src")).alias("members")).select(module, "label", "members")


def strong_labels(edges: DataFrame, module: str, in_task: int = IN_TASK) -> DataFrame:
    """(module, node, label) of every node on a cycle; ``label`` is the smallest node of its cyclic group.

    Classes of edges that no group crosses (at first what touches, see ``parted``) are solved whole inside tasks, many to
    a task, while they have at most ``in_task`` edges. Larger ones are coloured: every node takes the least of a random
    order among all nodes that reach it, the nodes of a colour that reach its root are the root's group, and what is left
    falls into smaller classes, one for each colour. A round is one join with the edges, so work is linear in them;
    rounds grow with the longest shortest path of a large class. Nulls in an edge make it none.
    """
    known = edges.select(F.col(module).alias("_m"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).dropna()
    rest = parted(known, "_m").select("_m", F.col("cls").cast("string").alias("cls"), "src", "dst")
    found: list[DataFrame] = []
    loops = None
    while True:
        sized = rest.groupBy("_m", "cls").agg(F.count("*").alias("n"))
        large = staged(sized.filter(F.col("n") > in_task).select("_m", "cls"), "large")
        if large.isEmpty():
            found.append(_solved_in_tasks(rest))
            break
        found.append(_solved_in_tasks(rest.join(large, ["_m", "cls"], "left_anti")))
        over = rest.join(large, ["_m", "cls"], "left_semi")
        if loops is None:
            over = staged(over.distinct(), "over")
            loops = over.filter("src = dst").select("_m", F.col("src").alias("node"))
            over = over.filter("src <> dst")
        big = staged(_trimmed(over), "big")
        labels, rest = _coloured(big)
        rest = staged(rest, "classes")
        found.append(labels)
    grouped = staged(reduce(DataFrame.unionByName, found), "labels")
    if loops is not None:
        alone = loops.join(grouped.select("_m", "node"), ["_m", "node"], "left_anti").select("_m", "node", F.col("node").alias("label"))
        grouped = grouped.unionByName(alone)
    return grouped.withColumnRenamed("_m", module)


def _trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges without those that begin at a node nothing leads to or end at one that leads nowhere, a few layers deep."""
    key = ["_m", "cls"]
    for _ in range(rounds):
        edges = staged(edges, "trim")
        reached, leading = edges.select(*key, F.col("dst").alias("src")).distinct(), edges.select(*key, F.col("src").alias("dst")).distinct()
        edges = edges.join(reached, [*key, "src"], "left_semi").join(leading, [*key, "dst"], "left_semi")
    return edges.select(*key, "src", "dst")


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, edges left) of one round of colouring of (_m, cls, src, dst)."""
    key = ["_m", "cls"]
    own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
    nodes = edges.select(*key, F.col("src").alias("node")).union(edges.select(*key, F.col("dst").alias("node"))).distinct()
    colours = staged(nodes.select(*key, "node", own.alias("colour"), F.lit(True).alias("new")), "colours")
    while True:
        step = colours.filter("new").select(*key, F.col("node").alias("src"), F.col("colour").alias("from")).join(edges, [*key, "src"]).groupBy(*key, F.col("dst").alias("node")).agg(F.min("from").alias("from"))
        better = F.col("from").isNotNull() & (F.col("from") < F.col("colour"))
        colours = staged(colours.join(step, [*key, "node"], "left").select(*key, "node", F.when(better, F.col("from")).otherwise(F.col("colour")).alias("colour"), better.alias("new")), "colours")
        if colours.filter("new").isEmpty():
            break
    of = colours.select(*key, "node", F.col("colour.v").alias("colour"))
    ends = [of.select(*key, F.col("node").alias(n), F.col("colour").alias(f"c_{n}")) for n in ("src", "dst")]
    inside = staged(edges.join(ends[0], [*key, "src"]).join(ends[1], [*key, "dst"]).filter("c_src = c_dst").select(*key, F.col("c_src").alias("colour"), "src", "dst"), "inside")
    # backwards from the root of every colour, inside it
    front = staged(of.filter("node = colour").select(*key, "colour", "node"), "roots")
    marked = front
    while True:
        back = front.select(*key, "colour", F.col("node").alias("dst")).join(inside, [*key, "colour", "dst"]).select(*key, "colour", F.col("src").alias("node")).distinct()
        front = staged(back.join(marked, [*key, "colour", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        marked = staged(marked.unionByName(front), "marked")
    group = [*key, "colour"]
    least = marked.groupBy(*group).agg(F.min("node").alias("label"), F.count("*").alias("n")).filter("n > 1").drop("n")
    labels = staged(marked.join(least, group).select("_m", "node", "label"), "labels")
    gone = [marked.select(*group, F.col("node").alias(n)) for n in ("src", "dst")]
    left = inside.join(gone[0], [*group, "src"], "left_anti").join(gone[1], [*group, "dst"], "left_anti")
    return labels, left.select("_m", F.col("colour").alias("cls"), "src", "dst")


def _solved_in_tasks(edges: DataFrame) -> DataFrame:
    """Labels of classes that are small enough: sorted by class, and solved one after the other as a stream."""
    kind = dict(edges.dtypes)["_m"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, near = None, {}

        def solved() -> list[tuple]:
            return [(key[0], node, group[0]) for group in _strong(near) for node in group]

        for pdf in batches:
            done: list[tuple] = []
            for m, cls, s, d in zip(pdf["_m"], pdf["cls"], pdf["src"], pdf["dst"], strict=True):
                if (m, cls) != key:
                    done += solved()
                    key, near = (m, cls), {}
                near.setdefault(s, []).append(d)
            yield pd.DataFrame(done, columns=["_m", "node", "label"], dtype=object)
        yield pd.DataFrame(solved(), columns=["_m", "node", "label"], dtype=object)

    return edges.repartition("_m", "cls").sortWithinPartitions("cls", "_m").mapInPandas(run, f"_m {kind}, node string, label string")


def label_groups(labels: DataFrame, module: str) -> DataFrame:
    """(module, label, members) of ``strong_labels``, members sorted."""
    return labels.groupBy(module, "label").agg(F.sort_array(F.collect_list("node")).alias("members"))


def module_cycles(edges: DataFrame, module: str, in_task: int = IN_TASK) -> DataFrame:
    """(module, group_no, members): cyclic groups of every module, numbered by their smallest member."""
    groups = label_groups(strong_labels(edges, module, in_task), module)
    number = F.row_number().over(W.partitionBy(module).orderBy("label"))
    return groups.select(module, number.alias("group_no"), "members")


def _strong(graph: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected groups with a cycle, by an iterative depth-first search with low links."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in sorted(graph):
        if root in order:
            continue
        work = [(root, iter(graph.get(root, [])))]
        order[root] = low[root] = len(order)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for child in rest:
                if child not in order:
                    order[child] = low[child] = len(order)
                    held.append(child)
                    on.add(child)
                    work.append((child, iter(graph.get(child, []))))
                    break
                if child in on:
                    low[node] = min(low[node], order[child])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while True:
                        x = held.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    if len(group) > 1 or node in graph.get(node, []):
                        out.append(sorted(group))
    return out
