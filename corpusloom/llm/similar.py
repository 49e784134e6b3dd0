"""Near-duplicates by exact similarity of word-shingle sets, with SimHash and banded MinHash as candidate searches.

Documents link where the shingle sets have Jaccard similarity ``similarity`` or more; every link is verified on the
texts. Candidates share one of ``BANDS`` keys of ``BAND`` minima each, which a pair at 0.8 misses with probability
(1 - 0.8 ** 4) ** 16 = 0.0002, or are linked by SimHash. Equal sets form one class first. Each group of candidates is
compared with its smallest member; members that this leaves apart are compared with one another inside their tasks, so
no table holds all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.common import plain_names, staged, with_columns
from corpusloom.llm.components import connected_components

BANDS, BAND = 16, 4
#: Of all BANDS * BAND minima, how many must agree before two sets are intersected: a pair at 0.8 has 51 +- 3 of 64.
AGREEING = 38
#: Members that one task compares with their hub; shingles and members of one chunk of a group that is left apart.
STAR_ROWS, CELL_SHINGLES, CELL_ROWS = 2048, 400_000, 1024


def minima(hashes: np.ndarray, seed: int = 42) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes: the smallest of their upper halves under each of BANDS * BAND seeded
    permutations."""
    r = np.random.default_rng(seed)
    odd = r.integers(0, 1 << 31, (BANDS * BAND, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = r.integers(0, 1 << 32, (BANDS * BAND, 1), dtype=np.uint32)
    least = np.full(BANDS * BAND, np.iinfo(np.uint32).max, dtype=np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 2048):
        np.minimum(least, (upper[None, at : at + 2048] * odd + plus).min(axis=1), out=least)
    return least


def sketched(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """``docs`` with _fp (SimHash), _set (digest of the shingle set), _size (of that set) and _bands."""

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        fps, sets, sizes, bands = [], [], [], []
        for text in texts.to_pylist():
            hashes = simhash.shingle_hashes(text, shingle, seed)
            distinct = np.unique(hashes).astype(np.uint64)
            fps.append(simhash.majority(hashes))
            sets.append(xxhash.xxh64_intdigest(distinct.tobytes(), seed))
            sizes.append(len(distinct))
            low = minima(distinct, seed).reshape(BANDS, BAND)
            bands.append([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low)] if len(distinct) else [])
        flat = np.array([b for row in bands for b in row], dtype=np.uint64).view(np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        signed = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (fps, sets)]
        return {"_fp": signed[0], "_set": signed[1], "_size": pa.array(sizes, pa.int64()), "_bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

    return with_columns(docs, [("_fp", "bigint"), ("_set", "bigint"), ("_size", "bigint"), ("_bands", "array<bigint>")], compute)


def _set_of(text: str | None, shingle: int, seed: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, shingle, seed)).astype(np.uint64)


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted arrays) have the wanted similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= similarity


def alike_to_hub(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose texts in ``texts`` (node, text) have sets of the wanted similarity.

    A hub ``u`` meets its members in groups of about STAR_ROWS, so its text travels once for each group and a text of
    a member once for each of its hubs.
    """
    groups = pairs.groupBy("u").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("v"), F.col("groups")).cast("int")
    members = pairs.join(groups, "u").select("u", group.alias("g"), "v").join(texts.withColumnRenamed("node", "v"), "v")
    hubs = groups.select("u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    hubs = hubs.join(texts.withColumnRenamed("node", "u"), "u").select("u", "g", F.lit(None).cast("long").alias("v"), "text")
    rows = members.select("u", "g", "v", "text").unionByName(hubs).repartition("u", "g").sortWithinPartitions("u", "g", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for u, v, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                one = _set_of(text.as_py(), shingle, seed)
                if v is None:
                    own = one
                elif _alike(own, one, similarity):
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def cell_links(nodes: list[int], joined: np.ndarray, own: np.ndarray, bands: np.ndarray, band: int, sets: list[np.ndarray], across: bool, similarity: float, seed: int) -> list[tuple[int, int]]:
    """Links that join members of one cell: pairs with the wanted similarity that no link and no ``joined`` label has
    joined before, and that share no earlier band. With ``across`` only members of two chunks (``own``) meet."""
    signs, sizes = np.stack([minima(s, seed) for s in sets]), np.array([len(s) for s in sets])
    label, out = joined.copy(), []
    for i in range(len(nodes) - 1):
        rest = slice(i + 1, None)
        near = (label[rest] != label[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]))
        if across:
            near &= own[rest] != own[i]
        if band:
            near &= ~(bands[rest, :band] == bands[i, :band]).any(axis=1)
        at = np.flatnonzero(near) + i + 1
        at = at[(signs[at] == signs[i]).sum(axis=1) >= AGREEING]
        for j in at.tolist():
            if label[i] != label[j] and _alike(sets[i], sets[j], similarity):
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def alike_in_groups(left: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """Links (u, v) among the rows of ``left`` (band, key, node, at) of one (band, key) whose ``at`` differs.

    Groups fall into chunks of bounded size; every pair of chunks is one cell, which one task compares as a whole.
    """
    rows = left.join(classes.select(F.col("_row").alias("node"), F.col("_size").alias("size"), F.col("_bands").alias("bands")), "node")
    volume = F.greatest(F.count("*") / CELL_ROWS, F.sum("size") / CELL_SHINGLES)
    chunks = rows.groupBy("band", "key").agg(F.ceil(volume).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = rows.join(chunks, ["band", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = placed.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "at", "bands").join(texts, "node")
    order = ["band", "key", "a", "b"]
    cells = cells.select(*order, "own", "node", "at", "bands", "text").repartition(*order).sortWithinPartitions(*order, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def compared() -> pa.RecordBatch:
            nodes, at, own, bands, sets = zip(*held, strict=True)
            found = cell_links(list(nodes), np.array(at), np.array(own), np.array(bands), here[0], list(sets), here[2] != here[3], similarity, seed)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:7]]
            for k, (*cell, own, node, at) in enumerate(zip(*columns, strict=True)):
                if held and cell != here:
                    yield compared()
                here = cell
                held.append((node, at, own, batch.column(7)[k].as_py(), _set_of(batch.column(8)[k].as_py(), shingle, seed)))
        if held:
            yield compared()

    return cells.mapInArrow(run, "u long, v long")


def grouped(rows: DataFrame, shingle: int, similarity: float, radius: int, seed: int = 42) -> DataFrame:
    """(_fp, _set, component) of every class of ``rows`` (_row, text, _fp, _set, _size, _bands; rows that are staged).

    ``component`` is the smallest _row of the documents that links connect.
    """
    classes = staged(rows.groupBy("_fp", "_set").agg(F.min_by(F.struct("_row", "_size", "_bands"), "_row").alias("c")).select("_fp", "_set", "c.*"), "sets")
    keys = classes.select(F.col("_row").alias("node"), F.posexplode("_bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = staged(keys.join(hubs, ["band", "key"]), "members")
    prints = classes.groupBy("_fp").agg(F.min("_row").alias("rep")).select(F.col("_fp").alias("fp"), "rep")
    same = classes.join(prints.withColumnRenamed("fp", "_fp"), "_fp").filter("_row <> rep").select(F.col("rep").alias("u"), F.col("_row").alias("v"))
    close = simhash.fingerprint_links(staged(prints, "prints"), radius).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = members.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    pairs = staged(pairs.unionByName(same).unionByName(close).distinct(), "pairs")
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # what joins texts here and at the end grows with the documents, so it is sorted at every size
    texts = staged(rows.select(F.col("_row").alias("node"), "text").join(wanted.hint("merge"), "node", "left_semi"), "texts")
    links = staged(alike_to_hub(pairs, texts, shingle, similarity, seed), "links")
    # groups that the first round joined need no further pair
    now = members.select("band", "key", "node").join(connected_components(links), "node", "left")
    now = now.select("band", "key", "node", F.coalesce("component", "node").alias("at"))
    apart = now.groupBy("band", "key").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low <> high").select("band", "key")
    left = staged(now.join(apart, ["band", "key"]), "apart")
    more = staged(alike_in_groups(left, classes, texts, shingle, similarity, seed), "more")
    moved = connected_components(links.unionByName(more)).withColumnRenamed("node", "_row")
    return classes.join(moved, "_row", "left").select("_fp", "_set", F.coalesce("component", "_row").alias("component"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near-duplicates: of each group the row with the smallest doc_id.

    Rows with a null doc_id come last; of rows that repeat a doc_id any one may stand for its group. Texts without
    words form one group. All columns stay, whatever their names; an empty table gives no rows.
    """
    named = plain_names(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    rows = staged(sketched(named, shingle, seed), "rows")
    placed = rows.select("_fp", "_set", "_row", "doc_id").join(grouped(rows, shingle, similarity, radius, seed), ["_fp", "_set"])
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row")
    first = placed.groupBy("component").agg(F.min_by("_row", order).alias("_row")).select("_row")
    # a row stays where it is its group's first: no join by group, which may hold a third of all rows
    kept = rows.join(first.hint("merge"), "_row", "left_semi")
    return kept.drop("_row", "_fp", "_set", "_size", "_bands").toDF(*docs.columns)
