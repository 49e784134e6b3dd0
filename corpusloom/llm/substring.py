"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words; repeated windows merge into removal intervals.

1. A task hashes every window of its documents by differences of prefix sums. A window that a smaller doc_id of the same
   slice holds is decided at once. The others travel once, packed: consecutive windows with the same anchor (the least
   hash of the shorter word grams inside) are one row, so equal windows of any documents meet in the anchor's group.
   Windows of anchors that are frequent in a sample travel one by one, keyed by anchor and hash, so no group is hot.
2. Each group is sorted by doc_id in Spark and read as a stream; a window that came with a smaller id is repeated. Runs of
   repeated windows become intervals.
3. Documents meet their intervals, and covered words drop out.

Windows compare by 112 bits (64 of the anchor, 48 of the window within the anchor's group).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import plain_names, text_slices

#: Bytes of text hashed together, and characters' hashes held at a time.
SLICE_BYTES, PIECE_BYTES = 3_000_000, 1 << 20
#: Documents that the search for frequent anchors samples, and the share of sampled runs from which an anchor is frequent
#: (so there are 20,000 of them at most). Both only change how work spreads, never a result.
SAMPLE_ROWS, FREQUENT = 50_000, 1 / 20_000
#: Bytes of a window's hash that travel.
WIDTH = 6

_BASE, _SEED = 0x9E3779B97F4A7C55, 0x51ED270B
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(_SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, grown on demand up to the longest array hashed at once."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


def spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp hash of every span of ``codes``: a difference of prefix sums, moved to the first power."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets); nulls are empty."""
    filled = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2], dtype=np.uint8) if filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of every word and the number of the first word of every text (one more for the end)."""
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[offsets < len(data)]
    begins[edge] = inside[edge]
    edge = offsets[(offsets > 0) & (offsets <= len(data))] - 1
    stops[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of every word's bytes, made piece by piece; a piece ends between two words."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, side="right")))
        low = starts[at]
        piece = _BYTE[data[low : ends[to - 1]]]
        out[at:to] = mixed(spans_hash(piece, starts[at:to] - low, ends[at:to] - low, powers) + (ends[at:to] - starts[at:to]).astype(np.uint64))
        at = to
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Windows:
    """Windows of the texts of one slice: hash, anchor, number of the text, and first word within it."""

    def __init__(self, texts: pa.Array, window: int, powers: Powers):
        data, offsets = flat_texts(texts)
        starts, ends, first = word_places(data, offsets)
        codes = word_codes(data, starts, ends, powers)
        gram = max(1, window // 5)
        counts = np.diff(first)
        whole = np.maximum(counts - window + 1, 0)
        self.text = np.repeat(np.arange(len(counts)), whole)
        self.word = np.arange(len(self.text)) - np.repeat(np.cumsum(whole) - whole, whole)
        at = first[:-1][self.text] + self.word
        if len(at):
            self.hash = mixed(spans_hash(codes, at, at + window, powers))
            grams = np.arange(len(codes) - gram + 1)
            self.anchor = sliding_least(mixed(spans_hash(codes, grams, grams + gram, powers) ^ np.uint64(_SEED)), window - gram + 1)[at]
        else:
            self.hash = self.anchor = np.zeros(0, np.uint64)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run begins: any of the columns differs from the row before."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_SPREAD = "key long, doc_id long, text_key long, first int, last int, hashes binary"


def _packed(ids: np.ndarray, keys: np.ndarray, w: Windows, frequent: np.ndarray) -> pa.RecordBatch:
    """Rows of one slice: intervals of windows known to be repeated (hashes null), and runs of the others."""
    rank = np.unique(ids, return_inverse=True)[1]
    # rows that repeat an id and a text are one document
    _, sole = np.unique(np.stack([ids, keys.view(np.int64)], axis=1), axis=0, return_index=True)
    is_sole = np.zeros(len(ids), dtype=bool)
    is_sole[sole] = True
    use = np.flatnonzero(is_sole[w.text])
    h, anchor, text, word = w.hash[use], w.anchor[use], w.text[use], w.word[use]
    order = np.argsort(h)
    group = _run_starts(h[order])
    known = np.zeros(len(h), dtype=bool)
    if len(h):
        least = np.minimum.reduceat(rank[text[order]], group)
        sizes = np.diff(np.append(group, len(h)))
        known[order] = rank[text[order]] > np.repeat(least, sizes)
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    hashes, lengths = [], []
    for decided in (True, False):
        at = np.flatnonzero(known == decided)
        if not len(at):
            continue
        step = np.append(False, np.diff(at) != 1)  # another row than the next window
        parts = [text[at], np.cumsum(step)]
        if not decided:
            hot = np.isin(anchor[at], frequent)
            parts += [anchor[at], np.where(hot, np.arange(len(at)), -1)]
        begin = _run_starts(*parts)
        size = np.diff(np.append(begin, len(at)))
        lead = at[begin]
        key = mixed(keys[text[lead]] ^ ids[text[lead]].view(np.uint64)) if decided else np.where(hot[begin], mixed(anchor[lead] ^ h[lead]), anchor[lead])
        for c, v in zip(columns, (key.view(np.int64), ids[text[lead]], keys[text[lead]].view(np.int64), word[lead], word[lead] + size - 1), strict=True):
            c.append(v)
        lengths.append(np.full(len(begin), -1) if decided else size)
        if not decided:
            hashes.append(np.ascontiguousarray(h[at].view(np.uint8).reshape(-1, 8)[:, :WIDTH]).ravel())
    if not lengths:
        return pa.RecordBatch.from_pydict({n.split()[0]: [] for n in _SPREAD.split(", ")}, schema=_schema())
    size = np.concatenate(lengths)
    ends = np.concatenate([[0], np.cumsum(np.maximum(size, 0) * WIDTH)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(size >= 0, bitorder="little").tobytes())
    body = np.concatenate(hashes) if hashes else np.zeros(0, np.uint8)
    blob = pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
    made = [np.concatenate(c) for c in columns]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in made[:3]), *(pa.array(c.astype(np.int32)) for c in made[3:]), blob], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("hashes", pa.binary())])


def _hashing(window: int, frequent: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in text_slices(batches, "text", SLICE_BYTES):
            ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = part.column(part.schema.get_field_index("text_key")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield _packed(ids, keys, Windows(part.column(part.schema.get_field_index("text")), window, powers), frequent())

    return run


def frequent_anchors(docs: DataFrame, window: int) -> np.ndarray:
    """Anchors that hold more than ``FREQUENT`` of the runs of some ``SAMPLE_ROWS`` documents (doc_id, text_key, text)."""
    n = docs.count()
    sample = docs if n <= SAMPLE_ROWS else docs.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text_key"), F.lit(1 << 30)) < max(1, SAMPLE_ROWS * (1 << 30) // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in text_slices(batches, "text", SLICE_BYTES):
            w = Windows(part.column(part.schema.get_field_index("text")), window, powers)
            found, counts = np.unique(w.anchor[_run_starts(w.text, w.anchor)], return_counts=True)
            yield pa.record_batch({"anchor": _longs(found), "n": pa.array(counts.astype(np.int64))})

    counted = sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    found = counted.filter((F.col("n") > 8) & (F.col("n") > total * FREQUENT)).select("anchor").toPandas()["anchor"]
    return np.sort(found.to_numpy(dtype=np.int64).view(np.uint64))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of windows that came with a smaller id, from runs sorted by (key, doc_id); between batches only the
    last key's distinct windows are held, each with its first id."""
    held_key, held_hash, held_id = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            key, ids, _, first, _ = (part.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            blob = part.column(5)
            size = pa.compute.fill_null(pa.compute.binary_length(blob), 0).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
            raw = np.frombuffer(b"".join(v or b"" for v in blob.to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :WIDTH] = raw
            h = wide.view(np.uint64).ravel()
            row = np.repeat(np.arange(len(key)), size)
            group = np.cumsum(np.append(False, key[1:] != key[:-1]))
            if held_key != (key[0] if len(key) else None):
                held_hash, held_id = held_hash[:0], held_id[:0]
            code = np.concatenate([held_hash, h | group[row].astype(np.uint64) << np.uint64(48)])
            came = np.concatenate([held_id, ids[row]])
            known, place, back = np.unique(code, return_index=True, return_inverse=True)
            earliest = came[place]
            again = np.flatnonzero((came > earliest[back])[len(held_hash) :])
            word = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) + first[row]
            begin = _run_starts(row[again], np.cumsum(np.append(False, np.diff(again) != 1)) if len(again) else again)
            n = np.diff(np.append(begin, len(again)))
            lead = again[begin]
            yield _intervals(part, row[lead], word[lead], word[lead] + n - 1)
            decided = np.flatnonzero(part.column(5).is_null().to_numpy(zero_copy_only=False))
            yield _intervals(part, decided, first[decided], part.column(4).to_numpy(zero_copy_only=False)[decided])
            held_key = key[-1]
            last = known >> np.uint64(48) == np.uint64(group[-1])
            held_hash, held_id = known[last] & np.uint64((1 << 48) - 1), earliest[last]


def _intervals(part: pa.RecordBatch, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows.astype(np.int64))
    return pa.record_batch({"doc_id": part.column(1).take(at), "text_key": part.column(2).take(at), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, first, last): windows of ``docs`` (doc_id, text_key, text) from word ``first`` to word ``last``
    whose words also start in a document with a smaller doc_id. Intervals do not overlap but may touch."""
    known = docs.filter("doc_id IS NOT NULL")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(known, window))
    runs = known.mapInArrow(_hashing(window, lambda: frequent.value), _SPREAD)
    return runs.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_repeated, "doc_id long, text_key long, first int, last int")


def cut_words(texts: pa.Array, spans: pa.Array, window: int) -> dict[str, pa.Array]:
    """Words, removed words, removal intervals in words and the kept words of each text, joined by one space."""
    data, offsets = flat_texts(texts)
    starts, ends, first = word_places(data, offsets)
    counts = np.diff(first)
    cover = np.zeros(len(starts) + 1, dtype=np.int32)
    size = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    base = np.repeat(first[:-1], size)
    np.add.at(cover, base + flat.field("first").to_numpy(), 1)
    np.add.at(cover, base + flat.field("last").to_numpy() + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    of = np.repeat(np.arange(len(counts)), counts)
    dropped = np.flatnonzero(gone)
    begin = _run_starts(of[dropped], np.cumsum(np.append(False, np.diff(dropped) != 1)) if len(dropped) else dropped)
    from_word = dropped[begin]
    until = from_word + np.diff(np.append(begin, len(dropped)))
    owner = of[from_word]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int32)
    cuts = pa.StructArray.from_arrays([pa.array((from_word - first[owner]).astype(np.int32)), pa.array((until - first[owner]).astype(np.int32))], ["start", "end"])
    kept = np.flatnonzero(~gone)
    shift = np.zeros(len(data) + 1, dtype=np.int8)
    shift[starts[kept]] = 1
    shift[ends[kept]] -= 1
    take = np.cumsum(shift[:-1], dtype=np.int8).astype(bool)
    follow = kept[:-1][of[kept[1:]] == of[kept[:-1]]]  # kept words with another one after them in their text
    out = data.copy()
    out[ends[follow]] = 0x20
    take[ends[follow]] = True
    places = np.concatenate([[0], np.cumsum(take)])[offsets]
    text = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(out[take].tobytes())])
    return {"n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "removed": pa.ListArray.from_arrays(pa.array(bounds), cuts), "kept_text": text.cast(pa.string())}


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_removed (longs), removed (array of (start, end) in words, maximal and
    ascending) and kept_text; columns of these names are replaced.

    Words are runs of other characters than ASCII white space, unchanged. A word goes where a window of ``window``
    consecutive words covers it whose words also start in a document with a smaller doc_id; windows are judged on the
    input. Null and empty texts have no words; texts of fewer words than a window lose none. A null doc_id is smaller
    than nothing and nothing is smaller than it; rows with one doc_id take nothing from each other. ``docs`` may have
    any columns; an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = ["n_words", "n_removed", "removed", "kept_text"]
    docs = docs.drop(*made)
    named = plain_names(docs, "doc_id", "text").withColumns({"doc_key": F.col("doc_id").cast("long"), "text_key": F.xxhash64("text")})
    found = repeated_windows(named.select(F.col("doc_key").alias("doc_id"), "text_key", "text"), window)
    spans = found.groupBy(F.col("doc_id").alias("doc_key"), "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = named.join(spans, ["doc_key", "text_key"], "left").drop("doc_key", "text_key")
    added = spark.createDataFrame([], "n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string").schema
    kept = [c for c in joined.columns if c != "spans"]
    out = type(added)([*[f for f in joined.schema.fields if f.name != "spans"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            cut = cut_words(part.column(part.schema.get_field_index("text")), part.column(part.schema.get_field_index("spans")), window)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *(cut[n] for n in made)], names=[*kept, *made])

    whole = joined.mapInArrow(run, out)
    return whole.toDF(*docs.columns, *made)
