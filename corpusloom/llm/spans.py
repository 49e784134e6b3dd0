"""Ids of the words met so far, end to end in one array, and their copies for every occurrence."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spans of ``rows`` end to end, end of each)."""
    n = sizes[rows]
    ends = np.cumsum(n)
    where = np.repeat(starts[rows] - (ends - n), n)
    where += np.arange(len(where))
    return np.take(flat, where, mode="clip"), ends


class SpanTable:
    """Row of each word, and the span of ids of each row.

    Beyond ``keep_bytes`` words are forgotten: first those met in a single batch since the last time (a speed-up only).
    """

    def __init__(self, keep_bytes: int = 60_000_000, word_bytes: int = 220):
        self.keep_bytes, self.word_bytes = keep_bytes, word_bytes
        self.at: dict[str, int] = {}
        self.held = self.used = 0
        self.starts, self.sizes, self.met = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint8)
        self.flat = np.zeros(4096, np.uint32)

    def _cost(self, words: list[str], ids: int) -> int:
        return sum(map(len, words)) + self.word_bytes * len(words) + 4 * ids

    def make_room(self) -> None:
        """Forget where too much is held; between two calls rows stay valid."""
        if self.held <= self.keep_bytes:
            return
        names, n = list(self.at), len(self.at)  # in the order of their rows
        for least in (2, 3, 5, 9, 256):
            keep = np.flatnonzero(self.met[:n] >= least)
            words = [names[k] for k in keep.tolist()]
            if self._cost(words, int(self.sizes[keep].sum())) <= self.keep_bytes // 2:
                break
        flat, ends = gathered(self.flat, self.starts, self.sizes, keep)
        sizes = self.sizes[keep]
        self.at = dict(zip(words, range(len(words)), strict=True))
        self.flat, self.used, self.held = np.append(flat, np.zeros(4096, np.uint32)), len(flat), self._cost(words, len(flat))
        spare = np.zeros(1024, np.int64)
        self.starts, self.sizes, self.met = np.append(ends - sizes, spare), np.append(sizes, spare), np.append(np.ones(len(keep), np.uint8), np.zeros(1024, np.uint8))

    def _learn(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = self.used + np.cumsum(sizes)
        first, n = len(self.at), self.used + int(sizes.sum())
        while n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(ids) > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes, self.met))
        self.flat[self.used : n] = np.fromiter(chain.from_iterable(ids), np.uint32, n - self.used)
        self.starts[first : first + len(ids)], self.sizes[first : first + len(ids)] = ends - sizes, sizes
        self.at.update(zip(words, range(first, first + len(ids)), strict=True))
        self.met[first : first + len(ids)] = 1
        self.held += self._cost(words, n - self.used)
        self.used = n

    def rows(self, words: pa.Array, ids_of: Callable[[list[str]], list[list[int]]], batch: int = 20_000) -> np.ndarray:
        """Row of each of the distinct ``words``; new ones are learned in batches, so that few objects live at once."""
        names = words.to_pylist()
        at = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new, old = np.flatnonzero(at < 0), at[at >= 0]
        self.met[old] = np.minimum(self.met[old], 254) + 1
        first = len(self.at)
        for i in range(0, len(new), batch):
            part = [names[k] for k in new[i : i + batch].tolist()]
            self._learn(part, ids_of(part))
        at[new] = np.arange(first, first + len(new))
        return at

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of ``rows`` end to end, end of each)."""
        return gathered(self.flat, self.starts, self.sizes, rows)
