"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Distinct pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence finds its pair
of lowest rank, all sequences merge that pair at once, and finished sequences leave; the symbols that survive are the
tokens. Counts are then gathered back to documents.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.common import with_columns

#: The vocabulary's own pre-token pattern (fixed value of the byte-level format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that remembered pre-tokens may take, counting WORD_BYTES for each besides its letters (a speed-up only).
KEEP_BYTES, WORD_BYTES = 50_000_000, 130


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


def _check(spec: dict) -> None:
    """Raise for a file that says anything but plain byte-level BPE with its own pattern."""
    model, before, more = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cut = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    loose = any(t.get(k) for t in more for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or not cut or loose or spec.get("normalizer"):
        raise ValueError("only byte-level BPE files without normalisation, prefix space or merges to ignore are supported")


class MergeCounter:
    """Counts tokens of texts under one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.base = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}
        self.held = 0

    def merged_lengths(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols that each pre-token keeps."""
        data = [t.encode("utf-8") for t in tokens]
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        sym = self.base[np.frombuffer(b"".join(data), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(data)), lengths)
        out = lengths.copy()
        none = np.int64(len(self.keys))
        while len(sym) > 1:
            pair = np.where(seq[1:] == seq[:-1], sym[:-1] * self.width + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.append(np.where(self.keys[at] == pair, self.ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(seq)))
            out[seq[starts]] = sizes
            open_ = low < none
            if not open_.any():
                break
            stay = np.repeat(open_, sizes)
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            hit = rank == np.repeat(low[open_], sizes[open_])
            # of hits that overlap (a run of one symbol) every second one counts, from the left
            fresh = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run) % 2 == 0
            sym = np.where(hit, self.made[np.minimum(rank, none - 1)], sym)
            gone = np.append(False, hit[:-1])
            sym, seq = sym[~gone], seq[~gone]
        else:
            if len(sym) == 1:
                out[seq[0]] = 1
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; a null text has none. Special strings count as one token each."""
        flat: list[str] = []
        totals = np.zeros(len(texts), dtype=np.int64)
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                totals[i] = len(parts) - 1
            before = len(flat)
            for part in parts:
                flat += self.pattern.findall(part)
            sizes[i] = len(flat) - before
        if not flat:
            return totals
        words = pa.array(flat, pa.string()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > KEEP_BYTES:
            self.seen.clear()
            self.held = 0
        known = np.array([self.seen.get(w, -1) for w in distinct], dtype=np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self.merged_lengths([distinct[i] for i in new])
            self.seen.update((distinct[i], int(known[i])) for i in new)
            self.held += sum(len(distinct[i]) + WORD_BYTES for i in new)
        each = np.append(0, np.cumsum(known[words.indices.to_numpy(zero_copy_only=False)]))
        ends = np.cumsum(sizes)
        return totals + each[ends] - each[ends - sizes]


_counters: dict[str, MergeCounter] = {}


def _counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """All columns of ``docs`` plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, readable on every worker. Null
    and empty texts have no bytes and no tokens. Other columns pass through; repeated rows get equal counts; an
    empty table gives no rows.
    """

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        n = _counter(vocabulary).count(texts.to_pylist())
        size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
        return {"n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)}

    return with_columns(docs, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], compute)
