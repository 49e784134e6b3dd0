"""Language identification by a byte convolutional network trained and applied in numpy.

A text is cut into fixed-length byte windows. Bytes are embedded, filters of several widths slide over them, each
filter keeps its maximum over the window, and a softmax layer scores the languages. A document's distribution is the
softmax of its windows' mean logits. Training sees a bounded sample; scoring reads every window of every text.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_sample, with_columns

UNDETERMINED = "und"
#: Documents that training may read, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 3000, 40_000_000
WINDOW, DIM, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
REACH = max(WIDTHS)


class ByteCNN:
    """Weights and the forward pass; ``fit`` trains them with Adam on a cross-entropy loss."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        n = FILTERS * len(WIDTHS)
        self.emb = (r.standard_normal((256, DIM)) * 0.5).astype(np.float32)
        self.conv = np.zeros((REACH * DIM, n), dtype=np.float32)
        self.mask = np.zeros_like(self.conv)
        for i, w in enumerate(WIDTHS):
            at = slice(i * FILTERS, (i + 1) * FILTERS)
            self.conv[: w * DIM, at] = r.standard_normal((w * DIM, FILTERS)) * np.sqrt(2 / (w * DIM))
            self.mask[: w * DIM, at] = 1
        self.bias = np.zeros(n, dtype=np.float32)
        self.out = (r.standard_normal((n, len(classes))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(classes), dtype=np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, REACH * DIM) of embedded bytes; windows is (n, WINDOW) uint8."""
        x = self.emb[windows]
        n, s = len(windows), WINDOW - REACH + 1
        view = np.lib.stride_tricks.as_strided(x, (n, s, REACH * DIM), (x.strides[0], x.strides[1], x.strides[2]))
        return np.ascontiguousarray(view)

    def logits(self, windows: np.ndarray, rows: int = 48) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), dtype=np.float32)
        for at in range(0, len(windows), rows):
            z = (self._patches(windows[at : at + rows]) @ self.conv).max(axis=1)
            out[at : at + rows] = np.maximum(z + self.bias, 0) @ self.out + self.out_bias
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of windows ``x`` with classes ``y``, by name of the weights."""
        batch, at = len(x), np.arange(len(x))
        patches = self._patches(x)
        z = patches @ self.conv
        top = z.argmax(axis=1)
        best = np.take_along_axis(z, top[:, None, :], axis=1)[:, 0, :] + self.bias
        hidden = np.maximum(best, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[at, y] -= 1
        p /= batch
        g = {"out": hidden.T @ p, "out_bias": p.sum(axis=0)}
        back = (p @ self.out.T) * (best > 0)
        g["bias"] = back.sum(axis=0)
        chosen = patches[at[:, None], top]  # (batch, filters, REACH * DIM)
        g["conv"] = np.einsum("bf,bfk->kf", back, chosen) * self.mask
        spread = (back[:, :, None] * self.conv.T[None]).reshape(batch, -1, REACH, DIM)
        where = x[at[:, None, None], top[:, :, None] + np.arange(REACH)]
        g["emb"] = np.zeros_like(self.emb)
        np.add.at(g["emb"], where.ravel(), spread.reshape(-1, DIM))
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 64, seed: int = 11, rate: float = 0.01) -> None:
        r = np.random.default_rng(seed)
        # every language is drawn equally often
        pools = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        pools = [p for p in pools if len(p)]
        names = ("emb", "conv", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        for t in range(1, steps + 1):
            pick = np.array([p[r.integers(len(p))] for p in (pools[i] for i in r.integers(len(pools), size=batch))])
            x, y = windows[pick], labels[pick]
            g = self.gradients(x, y)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                step = rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(self, k, (getattr(self, k) - step).astype(np.float32))


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last one is padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW, dtype=np.uint8)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return flat.reshape(n, WINDOW)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, windows_per_text: int = 6, seed: int = 7) -> ByteCNN | None:
    """Fit on at most ``rows`` documents of ``docs`` (doc_id, text, lang) with an id, a text and a language, of
    ``TRAIN_BYTES`` together; None without any."""
    usable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND rlike(text, '\\\\p{L}')")
    sample = bounded_sample(usable.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), rows, TRAIN_BYTES)
    if sample.empty:
        return None
    classes = sorted(sample["lang"].unique())
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for text, lang in zip(sample["text"], sample["lang"], strict=True):
        w = windows_of(text.encode("utf-8"))
        take = w if len(w) <= windows_per_text else w[np.sort(r.choice(len(w), windows_per_text, replace=False))]
        xs.append(take)
        ys += [classes.index(lang)] * len(take)
    net = ByteCNN(classes, seed)
    net.fit(np.concatenate(xs), np.array(ys))
    return net


def predict(net: ByteCNN | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text; ``und`` and 0 where there is no letter or no network."""
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
    if not live:
        return langs, scores
    parts = [windows_of(texts[i].encode("utf-8")) for i in live]
    counts = np.array([len(p) for p in parts])
    logits = net.logits(np.concatenate(parts)).astype(np.float64)
    mean = np.add.reduceat(logits, np.cumsum(counts) - counts, axis=0) / counts[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    for i, b, q in zip(live, best, p[np.arange(len(live)), best], strict=True):
        langs[i], scores[i] = net.classes[b], q
    return langs, scores


def identify_languages(docs: DataFrame, training: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of ``docs`` plus lang_pred (string) and lang_score (double, 0 to 1).

    ``training`` holds the rows to learn from. A null text or one without a letter gets ``und`` and 0, and so does
    every text when nothing can be learned. Only the text column decides; other columns pass through, and repeated
    rows get equal answers. An empty table gives no rows.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(training, rows))

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        langs, scores = predict(net.value, texts.to_pylist())
        return {"lang_pred": pa.array(langs, pa.string()), "lang_score": pa.array(scores, pa.float64())}

    return with_columns(docs, [("lang_pred", "string"), ("lang_score", "double")], compute)
