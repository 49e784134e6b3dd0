"""Quality classifier: logistic regression on hashed word 1- and 2-grams, trained by FTRL-proximal updates.

A text is split into runs of letters or digits and runs of other marks. Each distinct token of a batch is hashed
once; pairs mix the hashes of neighbours, and all pairs of a token with itself are one gram. A score is one sparse dot product over the text's hashed grams, each gram
weighing by its share of the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_sample, staged, thinned, with_columns

#: Labelled documents that training may read, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 6000, 60_000_000
BITS = 20
TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands for every pair of a token with itself, whatever the token.
AGAIN = np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """Hashes of tokens, kept for the short words seen so far up to a bound (a speed-up only)."""

    def __init__(self, keep: int = 200_000, letters: int = 64):
        self.seen: dict[str, int] = {}
        self.keep, self.letters = keep, letters

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen, digest = self.seen, xxhash.xxh64_intdigest
        if len(seen) > self.keep:
            seen.clear()
        out = np.empty(len(tokens), dtype=np.uint64)
        for i, t in enumerate(tokens):
            h = seen.get(t)
            if h is None:
                h = digest(t)
                if len(t) <= self.letters:
                    seen[t] = h
            out[i] = h
        return out


def grams(texts: list[str | None], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of every text, and the number of grams of each text (0 for an empty one)."""
    lists = [TOKEN.findall(t) if t else [] for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    if not n.sum():
        return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    words = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    h = hasher(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)]
    pair = (h[:-1] * MIX) ^ (h[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair[h[1:] == h[:-1]] = AGAIN
    ends = np.cumsum(n)
    inside = np.ones(len(h), dtype=bool)
    inside[ends[n > 0] - 1] = False  # the last token of a text starts no pair
    shift = np.uint64(64 - BITS)
    both = np.full((len(h), 2), -1, dtype=np.int64)
    both[:, 0] = ((h * MIX) >> shift).astype(np.int64)
    both[:-1, 1] = (pair >> shift).astype(np.int64)
    both[~inside, 1] = -1
    flat = both.ravel()
    return flat[flat >= 0], np.where(n > 0, 2 * n - 1, 0)


class FtrlModel:
    """Weights of the hashed grams and a bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.w: np.ndarray | None = None

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self._weights(buckets)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[buckets] + g * g) - np.sqrt(self.n[buckets])) / self.alpha
        self.z[buckets] += g - sigma * w
        self.n[buckets] += g * g

    def freeze(self) -> tuple[np.ndarray, float]:
        w = np.concatenate([self._weights(np.arange(a, min(a + 65_536, len(self.z)))).astype(np.float32) for a in range(0, len(self.z), 65_536)])
        return w[:-1].copy(), float(self._weights(np.array([1 << BITS]))[0])


#: Grams are weighed by SCALE / sqrt(number of grams), so that long and short texts move the weights alike.
SCALE = 1.0


def fit(texts: list[str | None], labels: list[int], epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, float]:
    """FTRL over the texts in a seeded order; the examples lie end to end in two arrays, which keeps the driver small."""
    model, hasher = FtrlModel(), Hasher(keep=30_000)
    buckets, values, sizes = [], [], []
    for at in range(0, len(texts), 200):
        flat, n = grams(texts[at : at + 200], hasher)
        of = np.repeat(np.arange(len(n)), n)
        keys, counts = np.unique(of << BITS | flat, return_counts=True)
        of = keys >> BITS
        buckets.append((keys & (1 << BITS) - 1).astype(np.int32))
        values.append((counts * SCALE / np.sqrt(n[of])).astype(np.float32))
        sizes.append(np.bincount(of, minlength=len(n)))
    ends = np.cumsum(np.concatenate(sizes))
    all_buckets, all_values = np.concatenate(buckets), np.concatenate(values)
    del buckets, values
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(ends)):
            part = slice(ends[i - 1] if i else 0, ends[i])
            model.update(np.append(all_buckets[part], 1 << BITS), np.append(all_values[part], 1.0).astype(np.float64), labels[i])
    return model.freeze()


def score(texts: list[str | None], weights: np.ndarray, bias: float, hasher: Hasher) -> np.ndarray:
    """Probability of label 1 for each text; the bias alone speaks for an empty one."""
    flat, n = grams(texts, hasher)
    dots = np.zeros(len(texts))
    full = n > 0
    if full.any():
        starts = (np.cumsum(n) - n)[full]
        dots[full] = np.add.reduceat(weights[flat].astype(np.float64), starts) * SCALE / np.sqrt(n[full])
    return 1 / (1 + np.exp(-np.clip(dots + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float] | None:
    """Fit on at most ``rows`` labelled documents of ``TRAIN_BYTES`` together; None where nothing is labelled.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls teach nothing; of several labels of one
    document the smallest counts). Ids are chosen among those that have both a label and a document.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    present = staged(marked.join(known.select("doc_id"), "doc_id", "left_semi"), "labelled")
    chosen = thinned(present, ["doc_id"], rows).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    sample = bounded_sample(known.join(F.broadcast(chosen), "doc_id"), rows, TRAIN_BYTES)
    if sample.empty:
        return None
    return fit(sample["text"].tolist(), sample["quality"].tolist())


def classify_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS, training: DataFrame | None = None
) -> DataFrame:
    """All columns of ``docs`` plus quality_score (double, 0 to 1) and quality_pred (int: 1 from ``threshold`` on).

    The model learns from ``training`` (``docs`` where absent) joined with ``labels``. Null and empty texts get the
    bias alone; without any label every score is 0.5. Only the text decides: other columns pass through, and
    repeated rows get equal scores. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training, labels, rows))
    hasher = Hasher()

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        if model.value is None:
            scores = np.full(len(texts), 0.5)
        else:
            scores = score(texts.to_pylist(), *model.value, hasher)
        return {"quality_score": pa.array(scores), "quality_pred": pa.array((scores >= threshold).astype(np.int32))}

    return with_columns(docs, [("quality_score", "double"), ("quality_pred", "int")], compute)
