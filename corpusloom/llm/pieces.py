"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A normalised text falls into marked words (a run of the space mark, then other characters). The distinct words of a
batch are sorted, which lays them out as the depth-first order of a trie; the search keeps a stack with one forward
state per character of the current word and, for the next word, starts from the state at the end of the common
prefix. A state is the best segmentation of the prefix that ends there: its last piece and its score.

* Unigram vocabularies: the score is the sum of piece scores and the largest one wins.
* BPE vocabularies: a segmentation of a prefix counts only if merging would leave each of its neighbouring pieces
  apart, which exactly one last piece satisfies, so the same search gives exactly the merge result.

Characters outside the vocabulary become byte pieces where the model has them, else the unknown piece.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from corpusloom.llm.common import with_columns
from corpusloom.llm.spans import SpanTable

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Pairs of pieces that a worker remembers (a speed-up only), and bytes of text that are encoded at once.
KEEP_PAIRS, SLICE_BYTES = 200_000, 6_000_000


class Pieces:
    """One SentencePiece model file read for encoding and decoding."""

    def __init__(self, proto: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        if trainer.model_type not in (UNIGRAM, BPE) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with a leading space mark are supported")
        self.prefix = spec.add_dummy_prefix
        self.bpe = trainer.model_type == BPE
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        if USER in self.kind:
            raise ValueError("user-defined symbols are not supported")
        self.unknown = self.kind.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        #: what each id decodes to
        self.raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode()
            for p, k in zip(self.text, self.kind, strict=True)
        ]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece holds a space mark after another character")
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        #: pieces that the search may use: under BPE those that merging itself yields
        self.usable = {p for p in self.scores if not self.bpe or len(p) == 1 or self._merged(p) == [p]}
        #: proper tails of pieces: a string outside them ends no longer piece
        self.tails = {p[i:] for p in self.scores for i in range(1, len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.known = SpanTable()

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short string under the merge rule: best score first, then leftmost."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stay_apart(self, a: str, b: str) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > KEEP_PAIRS:
                self.apart.clear()
            known = self.apart[a, b] = self._merged(a + b) == [a, b]
        return known

    def _ids_of(self, pieces: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def search(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct word; ``words`` need not be sorted."""
        found: dict[str, tuple[int, ...]] = {}
        last: list[str] = [""]  # last piece of the best segmentation of the prefix of each length
        total: list[float | None] = [0.0]
        before = ""
        usable, tails, scores, apart, bpe, floor = self.usable, self.tails, self.scores, self.apart, self.bpe, self.floor
        for word in sorted(set(words)):
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, piece, begin = None, "", end
                while begin:
                    begin -= 1
                    p = word[begin:end]
                    if p in usable or end - begin == 1:
                        if bpe:
                            q = last[begin]
                            if not q:
                                piece = p
                                break
                            ok = apart.get((q, p))
                            if self._stay_apart(q, p) if ok is None else ok:
                                piece = p
                                break  # only one last piece is consistent
                        else:
                            s = total[begin] + scores.get(p, floor)
                            if best is None or s >= best:
                                best, piece = s, p
                    if p not in tails:
                        break
                if not piece:
                    raise ValueError(f"no piece ends at {word[:end]!r}")
                last.append(piece)
                total.append(best)
            before = word
            pieces, at = [], len(word)
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            found[word] = self._ids_of(pieces[::-1])
        return found

    def split(self, text: str | None) -> list[str]:
        """Marked words of a text."""
        if not text:
            return []
        t = text.replace(" ", MARK)
        return WORD.findall(MARK + t if self.prefix else t)

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts without their first mark, or as they are without ``prefix``; number of words of each text).

        A text without marks of its own, blanks at its ends or two blanks in a row falls at its blanks; others are cut
        one by one.
        """
        odd = pc.or_(pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}"), pa.scalar(not self.prefix))
        lists = pc.split_pattern(pc.filter(texts, pc.invert(odd)), " ")
        is_odd = odd.to_numpy(zero_copy_only=False)
        n = np.empty(len(texts), dtype=np.int64)
        n[~is_odd] = np.diff(lists.offsets.to_numpy())
        if not is_odd.any():
            return lists.flatten(), n
        cut = [[w[self.prefix :] for w in self.split(t)] for t in pc.filter(texts, odd).to_pylist()]
        n[is_odd] = [len(c) for c in cut]
        # words of plain texts come first, then those of the others; ``place`` puts them in the order of the texts
        both = pa.concat_arrays([lists.flatten(), pa.array([w for c in cut for w in c], pa.string())])
        order = np.argsort(np.repeat(np.append(np.flatnonzero(~is_odd), np.flatnonzero(is_odd)), np.append(n[~is_odd], n[is_odd])), kind="stable")
        return both.take(pa.array(order)), n

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); null and empty texts have none."""
        words, per_text = self._words(pc.fill_null(texts.cast(pa.string()), ""))
        words = words.dictionary_encode()
        self.known.make_room()
        mark = MARK if self.prefix else ""

        def ids_of(part: list[str]) -> list[tuple[int, ...]]:
            marked = [mark + w for w in part]
            found = self.search(marked)
            return list(map(found.__getitem__, marked))

        rows = self.known.rows(words.dictionary, ids_of, batch=200_000)
        ids, ends = self.known.spans(rows[words.indices.to_numpy(zero_copy_only=False)])
        bounds, text_ends = np.append(0, ends), np.cumsum(per_text)
        return ids.astype(np.int32), bounds[text_ends] - bounds[text_ends - per_text]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (empty for null and empty ones)."""
        ids, n = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids: control pieces vanish, byte pieces join into UTF-8, marks turn into spaces."""
        out = map(self.raw.__getitem__, ids.tolist())
        text = b"".join(out).decode("utf-8", errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The model of a file, read once per worker."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Pieces(f.read())
    return _models[path]


def encode_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``docs`` plus piece_ids (array<int>), the ids the model file gives the text.

    Null and empty texts get an empty array; repeated rows equal ones; other columns pass through; an empty table
    gives no rows. The file must be readable on every worker.
    """

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        ids, n = model(vocabulary).encode_flat(texts)
        return {"piece_ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))}

    return with_columns(docs, [("piece_ids", "array<int>")], compute, max_bytes=SLICE_BYTES)


def decode_pieces(rows: DataFrame, vocabulary: str, ids: str = "piece_ids") -> DataFrame:
    """All columns of ``rows`` plus decoded (string), the text of the ids; null ids give null.

    A text comes back as it was, but for space marks that it held itself (they turn into spaces).
    """
    schema = type(rows.schema)([*rows.schema.fields]).add("decoded", "string")

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [None if not x.is_valid else model(vocabulary).decode(x.values.to_numpy(zero_copy_only=False)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``docs`` plus n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip
    (the decoded ids equal the text, a null text counting as empty)."""

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        m = model(vocabulary)
        ids, n = m.encode_flat(texts)
        rows = np.split(ids.astype("<i4"), np.cumsum(n)[:-1])
        return {
            "n_tokens": pa.array(n, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
            "round_trip": pa.array([m.decode(r) == (t.as_py() or "") for r, t in zip(rows, texts, strict=True)], pa.bool_()),
        }

    return with_columns(docs, [("n_tokens", "long"), ("ids_crc32", "long"), ("round_trip", "boolean")], compute, max_bytes=SLICE_BYTES)


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own processor for the same file (used by tests as the reference result)."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
