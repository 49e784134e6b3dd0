"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits recursively along random directions, one for each level, and both sides keep the vectors near the cut
(spill overlap), so close vectors part only with small probability in one tree and hardly ever in all. Splits are fitted
round by round: each leaf that is still too large gives a bounded sample of its vectors, chosen by hash, and the
sample's quantiles cut it further; all vectors then descend. Leaves are compared twice. First only the signs of
``SIGNS`` random projections travel, and a vector without any partner close enough in sign leaves; then the vectors
that are left are compared in double precision. A linked pair counts in the first leaf that both share, so degrees are
exact sums over leaves and no pair ever leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged
from corpusloom.llm.components import connected_components

TREES = 8
#: Share of pairs at the threshold that one tree may part in all its cuts; all trees miss such a pair with LOSS ** TREES.
LOSS = 0.4
#: Shares of a node's vectors below the cut that are tried, and of those that each side keeps beyond it.
CUTS, SPILLS = np.linspace(0.3, 0.7, 9), (0.01, 0.02, 0.035, 0.05, 0.07, 0.1, 0.14)
#: Vectors of one leaf that may fit its next splits, the fewest that may, and those whose pairs are looked at.
SAMPLE_ROWS, SAMPLE_LEAST, PAIR_ROWS = 2048, 64, 256
#: Vectors that one task compares with as many others at once; larger leaves are split into pairs of chunks.
LEAF_ROWS, CHUNK_ROWS = 1024, 4096
#: Splits that the driver and every worker hold (16 bytes each); leaves grow where the vectors would need more.
MAX_SPLITS = 16_000_000
#: Signs of one vector, and how many standard deviations more than expected may differ (a miss of 0.00003 each).
SIGNS, SLACK = 256, 4.0


@cache
def direction(seed: int, tree: int, level: int, dim: int) -> np.ndarray:
    """Random direction of one level of one tree; levels are below 60, so the cache is small."""
    return np.random.default_rng([seed, tree, level, dim]).standard_normal(dim)


@cache
def sign_planes(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, SIGNS))


def signs_of(x: np.ndarray, seed: int) -> np.ndarray:
    """Signs of ``SIGNS`` random projections of each row, packed into 64-bit words."""
    return np.packbits(x @ sign_planes(seed, x.shape[1]) > 0, axis=1).view(np.int64)


def sign_limit(threshold: float) -> int:
    """Differing signs that a pair at ``threshold`` exceeds hardly ever."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p)))


def _tail(z: np.ndarray) -> np.ndarray:
    """P(N(0, 1) > z), to three digits (a logistic fit)."""
    return 1 / (1 + np.exp(np.clip(1.5976 * z + 0.070566 * z**3, -60, 60)))


def parted_share(p: np.ndarray, low: float, high: float, sigma: float) -> float:
    """Share of pairs at the threshold that a cut parts: of vectors at ``p``, with a partner ``sigma`` away along a
    random direction, those that lie below ``low`` while the partner lies above ``high``, or the other way round."""
    return float((_tail((high - p[p < low]) / sigma).sum() + _tail((p[p > high] - low) / sigma).sum()) / len(p))


def fit_splits(x: np.ndarray, tree: int, node: int, size: int, seed: int, leaf_rows: int, threshold: float, loss: float) -> list[tuple[int, int, float, float]]:
    """Splits (tree, node, low, high) below ``node``, whose ``size`` vectors the sample ``x`` stands for.

    The narrowest overlap is taken for which some cut parts at most ``loss`` of the pairs at the threshold and of the
    sample's linked pairs; of such cuts the one that parts fewest. A node that no cut spares stays whole: cutting it
    would lose links, and its vectors are compared chunk by chunk.
    """
    out, stack = [], [(node, x, float(size))]
    sigma = math.sqrt(max(2 - 2 * threshold, 1e-12))
    while stack:
        at, rows, n = stack.pop()
        if n <= leaf_rows or len(rows) < SAMPLE_LEAST or at >= 1 << 56:
            continue
        p = rows @ direction(seed, tree, at.bit_length() - 1, x.shape[1])
        some = rows[:PAIR_ROWS]
        i, j = np.nonzero(np.triu(some @ some.T >= threshold, 1))
        near, far = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
        for spill in SPILLS:
            lows, highs = np.quantile(p, CUTS - spill), np.quantile(p, CUTS + spill)
            linked = ((near < lows[:, None]) & (far > highs[:, None])).sum(axis=1) / max(1, len(i))
            cost = np.maximum(linked, [parted_share(p, a, b, sigma) for a, b in zip(lows, highs, strict=True)])
            best = int(np.argmin(cost))
            if cost[best] <= loss:
                break
        else:
            continue
        low, high = lows[best], highs[best]
        out.append((tree, at, float(low), float(high)))
        for child, side in ((2 * at, p <= high), (2 * at + 1, p >= low)):
            if side.sum() < len(rows):
                stack.append((child, rows[side], n * side.mean()))
    return out


class Forest:
    """The splits so far, sorted by number of node and tree; a node without a split is a leaf."""

    def __init__(self, trees: int, seed: int):
        self.trees, self.seed = trees, seed
        self.keys, self.low, self.high = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.float32)

    def grown(self, splits: pa.Table) -> Forest:
        """The forest with more ``splits`` (tree, node, low, high): arrays throughout, 16 bytes a split."""
        out = Forest(self.trees, self.seed)
        keys = np.append(self.keys, splits["node"].to_numpy() * self.trees + splits["tree"].to_numpy())
        order = np.argsort(keys)
        low, high = (np.append(a, splits[k].to_numpy().astype(np.float32)) for k, a in (("low", self.low), ("high", self.high)))
        out.keys, out.low, out.high = keys[order], low[order], high[order]
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number, leaf code) of every leaf that a row of ``x`` (unit vectors) lies in; a code is node * trees + tree."""
        rows, codes = [], []
        for tree in range(self.trees):
            at, node, level = np.arange(len(x)), np.ones(len(x), np.int64), 0
            while len(at):
                key = node * self.trees + tree
                i = np.searchsorted(self.keys, key)
                i[i == len(self.keys)] = 0
                cut = self.keys[i] == key if len(self.keys) else np.zeros(len(at), bool)
                rows.append(at[~cut])
                codes.append(key[~cut])
                at, node, i = at[cut], node[cut], i[cut]
                p = (x @ direction(self.seed, tree, level, x.shape[1])).astype(np.float32)[at]
                left, right = p <= self.high[i], p >= self.low[i]
                at, node, level = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1]), level + 1
        return np.concatenate(rows), np.concatenate(codes)


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector length in the batch: (row numbers, unit vectors in double precision)."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, units(values[offsets[rows][:, None] + np.arange(dim)])


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fitter(weigh, trees: int, seed: int, leaf_rows: int, threshold: float, loss: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function that fits the splits of one leaf from its sample; ``weigh`` broadcasts the leaves' codes, sorted, and sizes."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # of vectors of several lengths the most frequent length fits the splits
        code, dims = int(pdf["code"].iloc[0]), pdf["x"].map(len)
        pdf = pdf[dims == dims.mode().iloc[0]].sort_values("draw", kind="stable")
        x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
        codes, sizes = weigh.value
        splits = fit_splits(x, code % trees, code // trees, int(sizes[np.searchsorted(codes, code)]), seed, leaf_rows, threshold, loss)
        return pd.DataFrame(splits, columns=["tree", "node", "low", "high"])

    return fit


def _fit(reps: DataFrame, rows: int, trees: int, seed: int, leaf_rows: int, threshold: float) -> Forest:
    """Rounds of splitting until no leaf is larger than ``leaf_rows`` or nothing can be split any more."""
    context, forest = reps.sparkSession.sparkContext, Forest(trees, seed)
    loss = 1 - (1 - LOSS) ** (1 / max(1, math.ceil(math.log2(max(1.0, rows / leaf_rows)))))
    while True:
        shared = context.broadcast(forest)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.leaves(x)[1] for _, x in unit_rows(batch.column(0))]
                codes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

        sizes = reps.select("v").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        # at most one row for each split that the forest may still get
        large = sizes.filter(F.col("n") > leaf_rows).toArrow()
        if not large.num_rows:
            break
        order = np.argsort(large["code"].to_numpy())
        codes, n = large["code"].to_numpy()[order], large["n"].to_numpy()[order]
        # so many vectors that even the last cuts see SAMPLE_LEAST of them
        share = np.minimum(1.0, np.minimum(SAMPLE_ROWS, 2 * SAMPLE_LEAST * 2.0 ** np.ceil(np.log2(n / leaf_rows))) / n)
        wanted, weigh = context.broadcast((codes, share)), context.broadcast((codes, n))

        def sample(batches: Iterator[pa.RecordBatch], shared=shared, wanted=wanted) -> Iterator[pa.RecordBatch]:
            keys, shares = wanted.value
            for batch in batches:
                draw = batch.column(1).to_numpy(zero_copy_only=False)
                for rows, x in unit_rows(batch.column(0)):
                    at, codes = shared.value.leaves(x)
                    i = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                    keep = (keys[i] == codes) & (draw[rows[at]] < shares[i])
                    at, codes = at[keep], codes[keep]
                    flat = pa.array(x[at].astype(np.float32).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(draw[rows[at]]), lists], names=["code", "draw", "x"])

        # a uniform number of each vector, the same on every run
        draw = (F.xxhash64(F.lit(seed), "rep").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("draw")
        sampled = reps.select("v", draw).mapInArrow(sample, "code long, draw double, x array<float>")
        new = sampled.groupBy("code").applyInPandas(_fitter(weigh, trees, seed, leaf_rows, threshold, loss), "tree long, node long, low double, high double").toArrow()
        for b in (shared, wanted, weigh):
            b.unpersist()
        if not new.num_rows:
            break
        forest = forest.grown(new)
    return forest


def leaf_links(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, codes: np.ndarray, code: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links that each row gains here, smallest id of its component here) among unit vectors ``x`` of one cell.

    A pair counts only if no smaller leaf code holds both. With ``side`` only pairs across its two values are compared.
    """
    n = len(x)
    gained, root = np.zeros(n), np.arange(n)
    # smaller codes of the cell as bits: a pair that shares one counts elsewhere
    smaller, at_code = np.unique(np.where(codes < code, codes, code), return_inverse=True)
    at_code = at_code.reshape(codes.shape)
    bits = np.zeros((n, len(smaller) // 64 + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        r = np.flatnonzero(smaller[at_code[:, k]] < code)
        bits[r, at_code[r, k] // 64] |= np.uint64(1) << (at_code[r, k] % 64).astype(np.uint64)
    first = np.arange(n) if side is None else np.flatnonzero(side == side.min())
    second = first if side is None else np.flatnonzero(side != side.min())
    for at in range(0, len(first), 256):
        q, t = first[at : at + 256], second[at:] if side is None else second
        hit = x[q] @ x[t].T >= threshold
        if side is None:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        i, j = q[i], t[j]
        for c in range(0, len(i), 50_000):
            a, b = i[c : c + 50_000], j[c : c + 50_000]
            earlier = np.zeros(len(a), dtype=bool)
            for k in range(bits.shape[1]):
                earlier |= (bits[a, k] & bits[b, k]) != 0
            a, b = a[~earlier], b[~earlier]
            gained += np.bincount(a, weights=weight[b], minlength=n) + np.bincount(b, weights=weight[a], minlength=n)
        # larger roots hook onto smaller ones until every pair of the block has one root
        i, j = root[i], root[j]
        while (apart := i != j).any():
            i, j = i[apart], j[apart]
            up = np.arange(n)
            np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
            while (up[up] != up).any():
                up = up[up]
            root, i, j = up[root], up[i], up[j]
    least = ids.copy()
    np.minimum.at(least, root, ids)
    return gained.astype(np.int64), least[root]


def _large_leaves(codes: DataFrame, leaf_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(``codes`` (rep, code) without leaves all of whose vectors lie in one large leaf, those dropped or None)."""
    sizes = staged(codes.groupBy("code").agg(F.count("*").alias("c")), "leaves")
    hot = sizes.filter(F.col("c") > 2 * leaf_rows)
    if hot.isEmpty():
        return codes, None
    inside = codes.join(hot.select(F.col("code").alias("large"), F.col("c").alias("n_large")).join(
        codes.withColumnsRenamed({"code": "large", "rep": "r"}), "large"), F.col("rep") == F.col("r")
    ).filter("code <> large").groupBy("code", "large", "n_large").agg(F.count("*").alias("n"))
    # of leaves with the same vectors the smallest code stays
    repeats = inside.join(sizes, "code").filter((F.col("n") == F.col("c")) & ((F.col("n_large") > F.col("c")) | (F.col("large") < F.col("code"))))
    repeats = staged(repeats.select("code").distinct(), "repeats")
    return codes.join(repeats, "code", "left_anti"), repeats


def _cells(rows: DataFrame, chunk_rows: float) -> DataFrame:
    """``rows`` (code, rep, ...) plus a, b, own: leaves of more than ``chunk_rows`` fall into pairs of chunks."""
    sizes = rows.groupBy("code").agg(F.count("*").alias("c")).filter(F.col("c") > chunk_rows)
    chunks = sizes.select("code", F.ceil(F.col("c") / chunk_rows).cast("int").alias("chunks"))
    own = F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("chunks"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    placed = rows.join(chunks, "code", "left").withColumn("own", own).withColumn("other", every).drop("chunks")
    return placed.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")


def _close_in_sign(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function that keeps the rows of a cell which differ in at most ``limit`` signs from another one."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [pdf[f"s{k}"].to_numpy(dtype=np.int64).view(np.uint64) for k in range(SIGNS // 64)]
        own, within = pdf["own"].to_numpy(), pdf["a"].iloc[0] == pdf["b"].iloc[0]
        live = np.zeros(len(pdf), dtype=bool)
        for at in range(0, len(pdf), 256):
            q = slice(at, min(len(pdf), at + 256))
            # pairs with earlier blocks have been looked at
            differ = np.zeros((q.stop - at, len(pdf) - at), dtype=np.uint16)
            for w in words:
                differ += np.bitwise_count(w[q, None] ^ w[None, at:])
            hit = differ <= limit
            hit[np.arange(q.stop - at), np.arange(q.stop - at)] = False
            if not within:
                hit &= own[q, None] != own[None, at:]
            live[q] |= hit.any(axis=1)
            live[at:] |= hit.any(axis=0)
        return pdf.loc[live, ["rep", "code"]]

    return keep


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 23) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Rows link at cosine ``threshold`` or more. Equal vectors form one class first, which the forest holds once, so
    copies are counted and never paired. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null vec_id, link with nothing (a null vec_id has a null component and is not kept). Vectors of
    different lengths never link. Other columns are not read; an empty table gives no rows. The candidate search is
    approximate: tests measure its recall against brute force.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    # equal vectors meet by 128 bits of their hashes, so vectors need not travel again at the end
    key: list[Column] = [F.xxhash64("v").alias("k0"), F.xxhash64(F.lit(seed), "v").alias("k1")]
    live = rows.filter(sound)
    classes = live.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v"))
    reps = staged(classes, "classes")
    n_reps = reps.count()
    leaf_rows = max(leaf_rows, math.ceil(n_reps * trees / MAX_SPLITS))
    forest = vectors.sparkSession.sparkContext.broadcast(_fit(reps, n_reps, trees, seed, leaf_rows, threshold))
    words = [f"s{k}" for k in range(SIGNS // 64)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for at, x in unit_rows(batch.column(0)):
                r, codes = forest.value.leaves(x)
                signs = signs_of(x, seed)[r]
                columns = [ids[at[r]], codes, np.full(len(r), x.shape[1], np.int32), *signs.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["rep", "code", "dim", *words])

    placed = staged(reps.select("v", "rep").mapInArrow(place, "rep long, code long, dim int, " + ", ".join(f"{w} long" for w in words)), "placed")
    _, repeats = _large_leaves(placed.select("rep", "code"), leaf_rows)
    if repeats is not None:
        placed = placed.join(repeats, "code", "left_anti")
    chunk_rows = CHUNK_ROWS * leaf_rows / LEAF_ROWS
    in_sign = _cells(placed, chunk_rows).groupBy("code", "dim", "a", "b").applyInPandas(_close_in_sign(sign_limit(threshold)), "rep long, code long")
    near = staged(in_sign.groupBy("rep").agg(F.sort_array(F.collect_set("code")).alias("codes")), "near")
    cells = _cells(near.select("*", F.explode("codes").alias("code")), chunk_rows).join(reps.select("rep", "n", "v"), "rep").withColumn("dim", F.size("v"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = units(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        lists = pdf["codes"].to_numpy()
        codes = np.full((len(pdf), max(map(len, lists))), np.iinfo(np.int64).max)
        for i, c in enumerate(lists):
            codes[i, : len(c)] = c
        ids = pdf["rep"].to_numpy()
        side = pdf["own"].to_numpy() if pdf["a"].iloc[0] != pdf["b"].iloc[0] else None
        gained, root = leaf_links(x, ids, pdf["n"].to_numpy(dtype=np.float64), codes, int(pdf["code"].iloc[0]), side, threshold)
        out = pd.DataFrame({"rep": ids, "gained": gained, "root": root})
        return out[(gained > 0) | (root != ids)]

    found = staged(cells.groupBy("code", "dim", "a", "b").applyInPandas(compare, "rep long, gained long, root long"), "found")
    degree = found.groupBy("rep").agg(F.sum("gained").alias("gained"))
    component = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    settled = reps.select("k0", "k1", "rep", "n").join(degree, "rep", "left").join(component, "rep", "left").select(
        "k0", "k1", (F.coalesce("gained", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = live.select("vec_id", *key).join(settled, ["k0", "k1"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
