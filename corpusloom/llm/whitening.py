"""Embedding whitening: distributed centred covariance, leading components on the driver, projection in tasks.

The driver only sees the sums and the covariance, whose size is set by the number of dimensions. Components come from
Householder tridiagonalisation, bisection on Sturm counts for the leading eigenvalues, and inverse iteration in which
the vectors of close eigenvalues are orthogonalised against each other again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged

#: Dimensions that the driver takes: a covariance of 4096 dimensions has 128 MB.
MAX_DIMENSIONS = 4096
#: Entries become floor(SCALE * c) + SHIFT; larger ones than EXACT (after scaling) are no exact integers as doubles.
SCALE, SHIFT, EXACT = 1024.0, 100_000, 2.0**53
LONG = (1 << 63) - 1


# --- components of a symmetric matrix -------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of an orthogonally similar tridiagonal matrix, by Householder reflections.

    Reflector k is a unit vector over the dimensions from k + 1 on (or zeros where nothing had to be reflected).
    """
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0.0 or not np.any(x[1:]):
            reflectors.append(np.zeros(n - k - 1))
            continue
        v[0] += size if x[0] >= 0 else -size
        v /= np.linalg.norm(v)
        reflectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2.0 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = x[0] - 2.0 * v[0] * (v @ x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], squares, strict=True):
        q = d - at - s / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection until its interval has no double inside."""
    n = len(diagonal)
    radius = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    span = max(np.max(np.abs(diagonal) + radius), np.finfo(float).tiny)
    tiny = np.finfo(float).eps ** 2 * span + np.finfo(float).tiny
    low, high = np.full(k, np.min(diagonal - radius) - span * 1e-12), np.full(k, np.max(diagonal + radius) + span * 1e-12)
    wanted = n - 1 - np.arange(k)  # as many eigenvalues lie below the one sought
    for _ in range(2000):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = below(diagonal, off**2, middle, tiny) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low + (high - low) / 2


def shifted_solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchanges; a zero pivot becomes ``tiny``."""
    n = len(diagonal)
    d, u, uu = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    b = right.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(d[i]):
            factor = d[i] / low
            d[i], u[i], uu[i], d[i + 1], u[i + 1] = low, d[i + 1], u[i + 1], u[i] - factor * d[i + 1], -factor * u[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            factor = low / (d[i] if d[i] != 0.0 else tiny)
            d[i + 1] -= factor * u[i]
            b[i + 1] -= factor * b[i]
    for i in reversed(range(n)):
        rest = (u[i] * b[i + 1] if i + 1 < n else 0.0) + (uu[i] * b[i + 2] if i + 2 < n else 0.0)
        b[i] = (b[i] - rest) / (d[i] if abs(d[i]) >= tiny else tiny)
        if abs(b[i]) > 1e200:
            b *= 1e-200
    return b


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors [n, k] by inverse iteration; those of one cluster are orthogonalised in every round."""
    n, k = len(diagonal), len(values)
    span = max(np.max(np.abs(diagonal)) + 2 * (np.max(np.abs(off)) if len(off) else 0.0), np.finfo(float).tiny)
    tiny, close = np.finfo(float).eps * span, 1e-3 * span
    random = np.random.default_rng(11)
    out = np.empty((n, k))
    first = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > close:
            first = j
        # equal eigenvalues need different shifts
        shift = values[j] - (j - first) * 2 * np.finfo(float).eps * abs(values[j])
        x = random.standard_normal(n)
        for _ in range(rounds):
            x = shifted_solve(diagonal, off, shift, x / np.linalg.norm(x), tiny)
            x /= np.max(np.abs(x))
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, the ``k`` leading ones."""
    size = np.max(np.abs(matrix))
    if size == 0.0:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for at in reversed(range(len(reflectors))):
        v = reflectors[at]
        vectors[at + 1 :] -= 2.0 * np.outer(v, v @ vectors[at + 1 :])
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


# --- the operator ---------------------------------------------------------------------------------------------------


def entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x-vectors as longs [rows, d]) of the sound vectors of a list column, length by length."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        scaled = np.floor(flat[starts[at][:, None] + np.arange(d)] * SCALE)
        sound = np.all(np.abs(scaled) < EXACT, axis=1)  # false for NaN as well
        yield at[sound], scaled[sound].astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in entries(batch.column(0)):
            if len(x):
                d = x.shape[1]
                exact = x.sum(axis=0) if np.abs(x).max() * len(x) < LONG / 2 else x.astype(object).sum(axis=0)
                total[d] = total.get(d, np.zeros(d + 1, dtype=object)) + np.append(np.array([int(v) for v in exact], dtype=object), len(x))
    for d, s in total.items():
        yield pa.record_batch({"d": pa.array([d] * (d + 1), pa.int32()), "i": pa.array(range(d + 1), pa.int32()), "s": pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))})


def whiten(vectors: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` that can be projected, with n, deviation, whitened (array, one entry for each component),
    explained (array) and identity_error; columns of these names are replaced.

    A row drops out where its vector is null or empty, holds a null, a non-finite entry or one beyond 2 ** 43 in size,
    or has another length than most vectors (of equally frequent lengths the longest counts). All other rows are the
    fit list; repeated rows count as often as they come. Components whose eigenvalue is zero to rounding have no
    whitened value and are left out, so equal vectors (or a single one) give empty arrays. ``deviation`` is null where
    it does not fit a long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    made = ["n", "deviation", "whitened", "explained", "identity_error"]
    rows = vectors.drop(*[c for c in made if c != column])
    shape = staged(rows.select(column).mapInArrow(_sums, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s")), "sums")
    most = shape.filter("i = d").orderBy(F.col("s").desc(), F.col("d").desc()).limit(1).collect()
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n long", "deviation long", "whitened array<double>"])
    if not most:
        return spark.createDataFrame([], out_schema).withColumns({"explained": F.lit(None).cast("array<double>"), "identity_error": F.lit(None).cast("double")})
    d, n = most[0]["d"], int(most[0]["s"])
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; {MAX_DIMENSIONS} at most")
    sums = [int(r["s"]) for r in shape.filter((F.col("d") == d) & (F.col("i") < d)).orderBy("i").collect()]
    mean = np.array([s / n for s in sums])
    k = min(components, d)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in entries(batch.column(0)):
                if x.shape[1] == d and len(x):
                    centred = x - mean
                    total = centred.T @ centred + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select(column).mapInArrow(scatter, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    pairs = parts.filter("j <= i").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    covariance = np.zeros((d, d))
    covariance[pairs["i"], pairs["j"]] = covariance[pairs["j"], pairs["i"]] = pairs["v"] / n
    trace = float(np.trace(covariance))
    values, axes = leading_components(covariance, k) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    real = values > d * np.finfo(float).eps * trace
    values, axes = values[real], axes[:, real]
    fitted = spark.sparkContext.broadcast((mean, sums, axes / np.sqrt(values)))
    place = rows.columns.index(column)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, total, onto = fitted.value
        exact = np.array(total, dtype=object)
        narrow = np.array(total, dtype=np.int64) if max(map(abs, total)) <= LONG else None
        for batch in batches:
            for at, x in entries(batch.column(place)):
                if x.shape[1] != d or not len(x):
                    continue
                far = n * (np.abs(x - centre).max() + 1.0)
                if narrow is not None and n * float(np.abs(x).max()) < LONG / 2 and far * far * d < LONG / 2:
                    deviation = ((n * x - narrow) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [v if v <= LONG else None for v in ((n * x.astype(object) - exact) ** 2).sum(axis=1)]
                kept = batch.take(pa.array(at))
                whitened = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * onto.shape[1], pa.array(((x - centre) @ onto).ravel()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([n] * len(at), pa.int64()), pa.array(deviation, pa.int64()), whitened], names=[*kept.schema.names, "n", "deviation", "whitened"])

    done = staged(rows.mapInArrow(project, out_schema), "whitened")
    return done.withColumns({"explained": F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>"), "identity_error": F.lit(identity_error(done, len(values)))})


def identity_error(done: DataFrame, k: int) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity: means first, then centred products."""
    if not k:
        return 0.0
    entry = [F.get("whitened", i) for i in range(k)]
    means = done.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(entry)]).first()
    centred = [e - F.lit(m) for e, m in zip(entry, means, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = done.agg(*[F.avg(centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def component_rows(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error): one row for each component."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "w")
    return whitened.select(key, "n", "deviation", "identity_error", each).select(key, (F.col("at") + 1).alias("component"), "n", "deviation", "w.whitened", "w.explained", "identity_error")
