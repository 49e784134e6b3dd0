"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison inside candidate cells, components.

Two fingerprints within ``radius`` bits agree on at least ``agree`` of ``radius + agree`` slices of the word, so each
fingerprint enters one group per choice of ``agree`` slices; no link can be missed. More agreeing slices make smaller
groups and more of them, so their number follows the number of distinct fingerprints (``slices_for``). Groups larger
than ``cell_rows`` are cut into chunks and every pair of chunks becomes its own cell. Inside a cell the bits are stored as vertical planes and
distances of many pairs advance together in carry-save counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged, text_slices
from corpusloom.llm.components import connected_components

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 hashes of the word shingles of one text; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=">u8")
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=">u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=">u8"
    )


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text over XXH64 hashes of its word shingles; 0 where it has no word."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id bigint, fp bigint: the 64 bits as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): bit i of plane b is bit b of fingerprint i."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(fps: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of queries: (query indices, boolean matrix of fingerprints within ``radius`` bits)."""
    n, planes = len(fps), planes_of(fps)
    real = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view("<u8")
    depth = radius.bit_length()
    start = (1 << depth) - 1 - radius
    for at in range(0, n, rows):
        live = np.arange(at, min(n, at + rows))
        counters = [np.full((len(live), planes.shape[1]), ALL if start >> d & 1 else 0, dtype=np.uint64) for d in range(depth)]
        over = np.zeros((len(live), planes.shape[1]), dtype=np.uint64)
        for b in range(64):
            flip = np.where(fps[live] >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))
            carry = planes[b][None, :] ^ flip[:, None]
            for c in counters:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
            if b % 16 == 15 and b < 63:
                # abandon queries for which every lane but their own exceeds the radius
                keep = np.bitwise_count(~over & real).sum(axis=1) > 1
                if not keep.all():
                    live, over = live[keep], over[keep]
                    counters = [c[keep] for c in counters]
                    if not len(live):
                        break
        if len(live):
            hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            yield live, hit


def local_roots(fps: np.ndarray, ids: np.ndarray, radius: int) -> np.ndarray:
    """For every fingerprint the smallest id of its component under links inside this block."""
    label = ids.copy()
    found = [(q, np.packbits(hit, axis=1)) for q, hit in within(fps, radius)]
    n, changed = len(fps), True
    top = np.iinfo(np.int64).max
    while changed and found:
        changed = False
        for q, packed in found:
            hit = np.unpackbits(packed, axis=1)[:, :n].astype(bool)
            least = np.where(hit, label[None, :], top).min(axis=1)
            if (least < label[q]).any():
                changed = True
                label[q] = np.minimum(label[q], least)
    return label


def slices_for(n: int, radius: int) -> int:
    """Fewest slices, 2 at least, that make a group hold some four of ``n`` random fingerprints at most."""
    agree = 2
    while agree < 8 and n > 4 * 2.0 ** (64 * agree / (radius + agree)):
        agree += 1
    return agree


def fingerprint_links(vertices: DataFrame, radius: int = 3, cell_rows: int = 2048, agree: int | None = None) -> DataFrame:
    """Edges (u, v) that join all fingerprints of ``vertices`` (fp bigint, rep bigint) linked within ``radius`` bits."""
    agree = agree or slices_for(vertices.count(), radius)
    slices = radius + agree
    edges = [round(i * 64 / slices) for i in range(slices + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(slices)]
    keys = []
    for t, pair in enumerate(combinations(range(slices), agree)):
        mask = sum(masks[i] for i in pair)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    rows = vertices.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.t", "k.key")
    hot = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    hot = hot.select("t", "key", F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    placed = (
        rows.join(hot, ["t", "key"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "rep")
        .repartition("t", "key", "a", "b")
        .sortWithinPartitions("t", "key", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(parts: list[np.ndarray]) -> pa.RecordBatch:
            block = np.concatenate(parts)
            fps, ids = block[:, 4].copy().view(np.uint64), block[:, 5].copy()
            root = local_roots(fps, ids, radius)
            linked = root != ids
            return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(root[linked])], names=["u", "v"])

        rest = np.empty((0, 6), dtype=np.int64)
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rest = np.concatenate([rest, rows])
            changes = np.flatnonzero((rest[1:, :4] != rest[:-1, :4]).any(axis=1)) + 1
            if not len(changes):
                continue
            done, begin, parts, held = rest[: changes[-1]], 0, [], 0
            for end in changes.tolist():
                parts.append(done[begin:end])
                held += end - begin
                begin = end
                if held >= 512:
                    yield compared(parts)
                    parts, held = [], 0
            if parts:
                yield compared(parts)
            rest = rest[changes[-1] :]
        if len(rest):
            yield compared([rest])

    return placed.mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, cell_rows: int = 2048, agree: int | None = None
) -> DataFrame:
    """Rows (doc_id, fingerprint: 16 hex digits, component_id) for every row of ``docs``.

    Documents link where their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest
    doc_id reachable. Null and empty texts have fingerprint zero and link like any other; a row with a null doc_id
    takes part in nothing and gets a null component unless documents with ids share its fingerprint. Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle, seed), "fingerprints")
    vertices = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "vertices")
    links = staged(fingerprint_links(vertices.filter("rep IS NOT NULL"), radius, cell_rows, agree), "links")
    moved = connected_components(links).withColumnRenamed("node", "rep")
    classes = vertices.join(moved, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
