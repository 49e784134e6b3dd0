"""Token ids as binary files: canonical length-limited Huffman codes from global counts, in independent blocks.

A set of files has three tables below one folder:

* ``codebook``: (id, bits) of every id that occurs. Codes are canonical, so lengths alone define them.
* ``blocks``: one row per block of whole documents, in ascending document order: the block's number, how many ids
  precede it, its documents' ids and lengths, the code bits of all its ids, and the bit offset of every
  ``CHECKPOINT``-th id of each document. A block decodes without any other block.
* ``_SUCCESS`` markers as Spark writes them, so a reader sees whole tables only.

Decoding is table-driven: every checkpoint starts a lane and all lanes advance together, one table look-up per id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import id_ranges, range_of, shared_folder, staged, text_slices
from corpusloom.llm.spans import SpanTable, gathered
from corpusloom.llm.tokencount import byte_letters

CHECKPOINT = 256
BLOCK_IDS = 1 << 19
#: Bytes of text that are tokenised at once, and ids that are coded at once.
SLICE_BYTES, PACKED_IDS = 3_000_000, 400_000
MAX_BITS = 18
#: Documents in one range of ids; a range is the unit that one task sorts and writes.
RANGE_ROWS = 400
#: Words of Latin-1 letters, whose lower case has as many letters, with ASCII marks after them.
MARKS = ",.;:!?*$%&#/()+-="
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[" + MARKS.replace("-", r"\-") + r"]*$"


# --- tokenising -----------------------------------------------------------------------------------------------------


class WordIds:
    """Ids of texts under a tokenizers file that cuts words at white space, one library call per distinct word.

    Only blanks and line feeds, which such files drop, are cut here. A word of Latin-1 letters, whose lower case has as
    many letters, goes to the library's model in its byte letters, and the marks after it are a word of their own.
    Everything else, special strings included, goes to the library as it stands.
    """

    def __init__(self, path: str):
        # a task has one core: threads of the library's own would only take memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        probes = ["a", "words", "straße", "été", "ñandú"]
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        #: whether the file folds case, takes a word of letters as one piece of byte letters and marks after it as another
        self.folds = (
            self._ids(probes) == [self._direct(w) for w in probes] == self._ids([w.upper().replace("SS", "ß") for w in probes])
            and not set(MARKS) & set(added) and all(self._ids(["a" + m, "a" + 2 * m + "."]) == [self._direct("a") + i for i in self._ids([m, 2 * m + "."])] for m in MARKS)
        )
        self.known = SpanTable(keep_bytes=80_000_000)

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _direct(self, word: str) -> list[int]:
        letters = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        per_text = np.diff(lists.offsets.to_numpy())
        words = lists.flatten().dictionary_encode()
        distinct, index = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        self.known.make_room()
        plain = pc.match_substring_regex(distinct, PLAIN) if self.folds else pa.array(np.zeros(len(distinct), bool))
        is_plain = plain.to_numpy(zero_copy_only=False)
        # of each distinct word the row of its letters, or of the whole word, and that of its marks (-1 without any)
        rows = np.full((len(distinct), 2), -1, dtype=np.int64)
        rows[~is_plain, 0] = self.known.rows(distinct.filter(pc.invert(plain)), self._ids)
        letters = distinct.filter(plain)
        stems = pc.utf8_rtrim(letters, MARKS)
        marks = (pc.binary_length(letters).to_numpy(zero_copy_only=False) - pc.binary_length(stems).to_numpy(zero_copy_only=False)).astype(np.int64)
        stems = pc.utf8_lower(stems).dictionary_encode()
        rows[is_plain, 0] = self.known.rows(stems.dictionary, lambda part: list(map(self._direct, part)))[stems.indices.to_numpy(zero_copy_only=False)]
        for n in np.unique(marks[marks > 0]).tolist():
            at = np.flatnonzero(marks == n)
            tails = pc.utf8_slice_codeunits(letters.take(pa.array(at)), -n).dictionary_encode()
            rows[np.flatnonzero(is_plain)[at], 1] = self.known.rows(tails.dictionary, self._ids)[tails.indices.to_numpy(zero_copy_only=False)]
        # the spans of the distinct words, then every occurrence copies that of its word
        parts = rows.ravel()
        flat, ends = self.known.spans(parts[parts >= 0])
        stops = np.append(0, ends)[np.cumsum((rows >= 0).sum(axis=1))]
        starts = np.append(0, stops[:-1]) if len(stops) else stops
        out, ends = gathered(flat, starts, stops - starts, index)
        bounds = np.append(0, ends)
        text_ends = np.cumsum(per_text)
        return out, bounds[text_ends] - bounds[text_ends - per_text]


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids, tie, counts) of every row, the end id appended to each text.

    ``ids`` are little-endian integers of 16 bits, or 32 where the vocabulary needs them; ``tie`` is a hash of them.
    Each task adds one row without n_tokens, whose ``counts`` hold the number of times each id occurs in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        width = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        total = np.zeros(0, dtype=np.int64)
        for part in text_slices(batches, max_bytes=SLICE_BYTES):
            flat, n = words.encode(part.column(1))
            full = np.insert(flat, np.cumsum(n), end_id)
            total = _added(total, np.bincount(full))
            n = n + 1
            offsets = (width * np.append(0, np.cumsum(n))).tolist()
            data = full.astype(f"<u{width}").tobytes()
            rows = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            tie = pa.array(np.array([xxhash.xxh64_intdigest(r) for r in rows], dtype=np.uint64) >> np.uint64(1)).cast(pa.int64())
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(rows, pa.binary()), tie, pa.nulls(len(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_TOKEN_COLUMNS)
        if len(total):
            last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=_TOKEN_COLUMNS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, tie long, counts binary")


_TOKEN_COLUMNS = ["doc_id", "n_tokens", "ids", "tie", "counts"]


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two arrays of counts, the shorter one continued with zeros."""
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[: len(b)] += b
    return a


# --- the code -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of each symbol (0 where it does not occur), none above ``max_bits``: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit in {max_bits} bits")
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, level, history = len(order), weights, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        merged = np.argsort(both, kind="stable")
        history.append(merged >= n)
        level = both[merged]
    # walk back: how many leaves of each level are among the cheapest 2n - 2 items
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for packaged in reversed(history):
        packages = int(packaged[:take].sum())
        lengths[: take - packages] += 1
        take = 2 * packages
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol: shorter codes first, then by symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, size = 0, 0
    for s, bits in zip(order.tolist(), lengths[order].tolist(), strict=True):
        code <<= bits - size
        codes[s], size = code, bits
        code += 1
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for every value of the next ``max_bits`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (max_bits - lengths[order].astype(np.int64))
    symbols, sizes = np.repeat(order, spans).astype(np.uint32), np.repeat(lengths[order], spans)
    short = (1 << max_bits) - len(symbols)
    return np.append(symbols, np.zeros(short, np.uint32)), np.append(sizes, np.ones(short, np.uint8))


def pack_rows(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bits of all rows, first bit first; first byte of each row, and of what follows; bit offset of each id in its row).

    ``ids`` holds the rows of ``sizes`` ids end to end; every row begins with a byte of its own.
    """
    n = lengths[ids].astype(np.int64)
    ends = np.append(0, np.cumsum(n))
    row_ends = np.append(0, np.cumsum(sizes))
    bits = np.diff(ends[row_ends])
    first_byte = np.append(0, np.cumsum((bits + 7) // 8))
    inside = ends[:-1] - np.repeat(ends[row_ends[:-1]], sizes)
    starts = inside + np.repeat(8 * first_byte[:-1], sizes)
    words = np.zeros(int(first_byte[-1]) // 4 + 2, dtype=np.uint64)
    if len(ids):
        # each code lies in one or two 32-bit words: shift it into 64 bits and add both halves
        value = codes[ids] << (np.uint64(64) - (n + (starts & 31)).astype(np.uint64))
        word = starts >> 5
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: int(first_byte[-1])], first_byte, inside


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits of all ids, first bit first; bit offset of each id)."""
    data, _, at = pack_rows(ids, np.array([len(ids)]), codes, lengths)
    return data, at


def unpack(data: bytes, lane_starts: np.ndarray, lane_sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_bits: int = MAX_BITS) -> np.ndarray:
    """Ids of all lanes end to end; a lane is a run of ids that begins at a checkpoint."""
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits from every byte on
    symbols, sizes = table
    out_starts = np.cumsum(lane_sizes) - lane_sizes
    out = np.empty(int(lane_sizes.sum()), dtype=np.uint32)
    order = np.argsort(-lane_sizes, kind="stable")
    at, to, left = lane_starts[order].copy(), out_starts[order], lane_sizes[order]
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for k, n in enumerate(live.tolist()):
        bit = at[:n]
        window = (words[bit >> 3] >> (32 - max_bits - (bit & 7)).astype(np.uint32)) & np.uint32((1 << max_bits) - 1)
        out[to[:n] + k] = symbols[window]
        at[:n] += sizes[window]
    return out


# --- writing and reading --------------------------------------------------------------------------------------------


def _counts(tokens: DataFrame) -> np.ndarray:
    """Global count of every id; the driver gets one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for buffer in batch.column(0):
                total = _added(total, np.frombuffer(buffer.as_buffer(), dtype="<i8").copy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    told = tokens.filter("counts IS NOT NULL").select("counts")
    rows = told.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


BLOCK_SCHEMA = (
    "range int, block int, start long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, "
    "doc_bits array<bigint>, checkpoints array<bigint>, bits binary"
)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, max_bits: int = MAX_BITS) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the file set below ``path`` in ascending doc_id order.

    A null text counts as empty and so holds the end id alone; rows that repeat a doc_id stand in the order of a
    hash of their ids; a null doc_id comes first. An empty table writes empty tables.
    """
    spark = docs.sparkSession
    tokens = staged(tokenised(docs, vocabulary, end_id), "tokens")
    lengths = code_lengths(_counts(tokens), max_bits)
    tokens = tokens.filter("n_tokens IS NOT NULL").drop("counts")
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    code = spark.sparkContext.broadcast((canonical(lengths), lengths))
    cuts = id_ranges(tokens, "doc_id", RANGE_ROWS)
    ranged = tokens.withColumn("range", range_of(F.col("doc_id"), cuts, F.col("tie")))
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, total = {}, 0
    for r in range(len(cuts) + 1):  # one number for each range; there are MAX_RANGES at most
        starts[r], total = total, total + sizes.get(r, 0)
    starts = spark.sparkContext.broadcast(starts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = code.value
        for batch in batches:
            ends = np.cumsum(batch.column(1).to_numpy())
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PACKED_IDS, side="right")))
                part = batch.slice(at, to - at)
                at = to
                sizes = part.column(1).to_numpy()
                rows = [b.as_buffer() for b in part.column(2)]
                ids = np.concatenate([np.frombuffer(r, dtype=f"<u{r.size // n}") for r, n in zip(rows, sizes.tolist(), strict=True)])
                data, first, inside = pack_rows(ids, sizes, codes, lengths)
                lanes = -(-sizes // CHECKPOINT)
                lane_ends, row_starts = np.cumsum(lanes), np.cumsum(sizes) - sizes
                marks = inside[np.repeat(row_starts - CHECKPOINT * (lane_ends - lanes), lanes) + CHECKPOINT * np.arange(lane_ends[-1])]
                bits = pa.array([data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                checkpoints = pa.ListArray.from_arrays(pa.array(np.append(0, lane_ends), pa.int32()), pa.array(marks, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), bits, checkpoints, part.column(4)],
                    names=["doc_id", "n_tokens", "range", "bits", "marks", "tie"],
                )

    rows = (
        ranged.select("doc_id", "n_tokens", "ids", "range", "tie")
        .mapInArrow(coded, "doc_id long, n_tokens long, range int, bits binary, marks array<bigint>, tie long")
        .repartition("range")
        .sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "tie")
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, begin, filled, held = None, 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number, begin
            sizes = np.array([h[1] for h in held], dtype=np.int64)
            at = 8 * np.append(0, np.cumsum([len(h[2]) for h in held]))[:-1]
            marks = np.concatenate([h[3] + a for h, a in zip(held, at.tolist(), strict=True)])
            row = {
                "range": here, "block": number, "start": begin, "n_ids": int(sizes.sum()), "doc_ids": [h[0] for h in held],
                "doc_sizes": sizes.tolist(), "doc_bits": at.tolist(), "checkpoints": marks.tolist(), "bits": b"".join(h[2] for h in held),
            }
            number, begin = number + 1, begin + row["n_ids"]
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_block_arrow())

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for i, (doc, n, part, bits) in enumerate(zip(*columns, strict=True)):
                if held and (part != here or filled + n > BLOCK_IDS):
                    yield flush()
                    filled = 0
                if part != here:
                    here, number, begin, filled = part, 0, starts.value[part], 0
                held.append((doc, n, bits, batch.column(4)[i].values.to_numpy(zero_copy_only=False)))
                filled += n
        if held:
            yield flush()

    rows.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def _block_arrow() -> pa.Schema:
    many = pa.list_(pa.int64())
    return pa.schema([
        ("range", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", many),
        ("doc_sizes", many), ("doc_bits", many), ("checkpoints", many), ("bits", pa.binary()),
    ])


def _read(spark: SparkSession, path: str, schema: str, each: Callable[[dict, np.ndarray], pa.RecordBatch], max_bits: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/codebook").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    table = spark.sparkContext.broadcast(decode_table(lengths, max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                sizes = block["doc_sizes"].values.to_numpy(zero_copy_only=False)
                lanes = -(-sizes // CHECKPOINT)
                lane = np.full(int(lanes.sum()), CHECKPOINT, dtype=np.int64)
                lane[np.cumsum(lanes) - 1] = sizes - (lanes - 1) * CHECKPOINT
                at = block["checkpoints"].values.to_numpy(zero_copy_only=False)
                ids = unpack(block["bits"].as_py(), at, lane, table.value, max_bits)
                yield each({"doc_ids": block["doc_ids"].values, "sizes": sizes, "start": block["start"].as_py()}, ids)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.select("start", "doc_ids", "doc_sizes", "checkpoints", "bits").mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document in the file set."""

    def each(block: dict, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(block["sizes"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32)))
        start = pa.array(block["start"] + ends - block["sizes"], pa.int64())
        return pa.RecordBatch.from_arrays([block["doc_ids"], start, lists], names=["doc_id", "start", "ids"])

    return _read(spark, path, "doc_id long, start long, ids array<int>", each, max_bits)


def digest_token_files(spark: SparkSession, path: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""

    def each(block: dict, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(block["sizes"])
        starts, data = ends - block["sizes"], ids.astype("<u4").tobytes()
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [block["doc_ids"], pa.array(block["start"] + starts, pa.int64()), pa.array(block["sizes"], pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", each, max_bits)


def new_folder(spark: SparkSession) -> str:
    """A fresh place in the shared folder for one file set."""
    return f"{shared_folder(spark)}/token-files"
