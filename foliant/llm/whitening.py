"""Embedding whitening by spectral divide-and-conquer on QDWH polar decompositions.

Vectors are put on an integer grid (``x = floor(256 * c)``), and every distinct
``x`` counts once in the fit: Spark removes the copies, sums the entries exactly
and adds up the cross products of the centred vectors.  What reaches the driver is
the sums of one vector and one symmetric matrix: bounded by the dimension alone.

There the covariance is divided: the polar factor of ``V - shift * I`` (by the
QR-based dynamically weighted Halley iteration) is a matrix sign, hence a spectral
projector onto the eigenvectors above the shift; a basis of its range and one of
the complement turn ``V`` into two smaller blocks, which are divided again until
blocks of one remain.  The components go back to the tasks, which whiten all rows.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry is
left out; so are vectors of another length than most distinct vectors have (of two
equally frequent lengths the larger stays); repeated rows are results of their own but one
vector of the fit; products beyond 64 bits saturate ``x``; a ``deviation`` beyond 64
bits is null; a component without variance (also all of a single vector) has
``whitened`` 0 and is left out of ``identity_error``; there are fewer than ``top``
components where the vectors are shorter; equal eigenvalues share their subspace in
any basis, the same for all rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import materialize

GRID, TOP = 256, 4
EPS = np.finfo(np.float64).eps
WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}
ROWS = 2000  # vectors worked on at once


# --- the decomposition: matrices of the dimension, on the driver ------------------------


def polar(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QDWH (inverse-free: QR of stacked matrices)."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x, low = a / norm, EPS  # a lower bound of the singular values; too small costs a round, not accuracy
    for _ in range(rounds):
        s = low * low
        d = (4 * (1 - s) / (s * s)) ** (1 / 3)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - s) / (s * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * s) / (1 + wc * s))
        if 1 - low < 10 * EPS and moved < np.sqrt(n) * 1e-13:
            break
    return x


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift; None where one is empty or they don't part."""
    n = len(a)
    u = polar(a - shift * np.eye(n))
    above = (u + np.eye(n)) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < n:
        return None
    basis = rng.standard_normal((n, k))
    for _ in range(3):  # a projector: each pass is a step of subspace iteration
        q, _ = np.linalg.qr(above @ basis, mode="complete")
        basis = q[:, :k]
        left = np.linalg.norm(q[:, k:].T @ a @ basis)
        if left <= 100 * EPS * np.sqrt(n) * np.linalg.norm(a):
            return basis, q[:, k:]
    return None


def eigen(a: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix, by recursive splitting."""
    rng = np.random.default_rng(seed)
    total = np.linalg.norm(a)
    todo, values, vectors = [(a, np.eye(len(a)))], [], []
    while todo:
        block, basis = todo.pop()
        block = (block + block.T) / 2
        n = len(block)
        mean = np.trace(block) / n
        if n == 1 or np.linalg.norm(block - mean * np.eye(n)) <= 4 * EPS * total:  # one value: any basis of it is one of eigenvectors
            values += np.diagonal(block).tolist()
            vectors.append(basis)
            continue
        parts = None
        for shift in [float(np.median(np.diagonal(block))), mean, *(mean + rng.standard_normal(20) * np.std(np.linalg.norm(block, axis=0)))]:
            parts = split(block, shift, rng)
            if parts is not None:
                break
        if parts is None:  # values closer than a shift can tell apart
            values += np.diagonal(block).tolist()
            vectors.append(basis)
            continue
        todo += [(p.T @ block @ p, basis @ p) for p in parts]
    values, vectors = np.array(values), np.hstack(vectors) if vectors else np.zeros((0, 0))
    order = np.argsort(-values, kind="stable")
    return values[order], refined(a, vectors[:, order])


def refined(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Eigenvectors after one correction to first order, for what the nested products of bases have rounded off."""
    r = np.eye(len(a)) - q.T @ q
    s = q.T @ a @ q
    value = np.diagonal(s) / (1 - np.diagonal(r))
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= 1e3 * EPS * np.linalg.norm(a)
    e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
    q = q + q @ e
    return q / np.linalg.norm(q, axis=0)


# --- the data: one pass each for copies, sums, products, rows ---------------------------


def on_grid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, x) of the usable vectors, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        row = np.flatnonzero(size == d)
        c = flat[start[row][:, None] + np.arange(d)]
        fine = np.isfinite(c).all(axis=1)
        x = np.floor(GRID * c[fine])
        yield row[fine], np.clip(x, -2.0 ** 62, 2.0 ** 62).astype(np.int64)


def packed(x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Order and bytes of the distinct vectors, each in the fewest bytes an entry that hold all of it."""
    top = np.maximum(x.max(axis=1), ~x.min(axis=1))
    out = []
    for width, kind in WIDTHS.items():
        low = -1 if width == 1 else np.iinfo(WIDTHS[width // 2]).max
        some = x[(top > low) & (top <= np.iinfo(kind).max)]
        if len(some):
            rows = np.ascontiguousarray(some.astype(kind)).view(np.dtype((np.void, width * x.shape[1]))).reshape(-1)
            out += [r.tobytes() for r in np.unique(rows)]
    return len(out), pa.array(out, pa.binary())


def unpacked(rows: pa.Array, d: int) -> np.ndarray:
    """The vectors of ``packed`` bytes."""
    return np.array([np.frombuffer(r, WIDTHS[len(r) // d]) for r in rows.to_pylist()], np.int64).reshape(-1, d)


def distinct_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(d, x)``: the length and the bytes of each distinct vector; copies go before the shuffle where they meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in on_grid(batch.column(0)):
                for k in range(0, len(x), ROWS):
                    n, rows = packed(x[k: k + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x.shape[1]), pa.int32()), rows], ["d", "x"])

    return vectors.select(column).mapInArrow(run, "d int, x binary").distinct()


@dataclass
class Whitening:
    """What the tasks need: n, sums S (exact), eigenvalues and unit eigenvectors (columns) by falling eigenvalue."""

    d: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0)
        return (x - mean) @ self.vectors * scale


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry, in two halves of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                x = unpacked(batch.column("x").slice(k, ROWS), d)
                n += len(x)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n)), pa.array(low), pa.array(high)],
                                         ["i", "n", "low", "high"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "i int, n long, low long, high long").groupBy("i").agg(
        F.sum("n").alias("n"), wide("low"), wide("high")).orderBy("i").collect()  # one row per entry of a vector
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def _products(fit: DataFrame, d: int, centred, width: int) -> np.ndarray:
    """Sum over all vectors of the outer products of what ``centred`` makes of them: ``width`` squared values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                y = centred(unpacked(batch.column("x").slice(k, ROWS), d))
                total += y.T @ y
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[rows["i"], rows["j"]] = out[rows["j"], rows["i"]] = rows["v"]
    return out


def fit(vectors: DataFrame, top: int = TOP, column: str = "embedding") -> Whitening | None:
    """The whitening of the first ``top`` components; None without a usable vector."""
    listed = materialize(distinct_vectors(vectors, column), "vectors")
    most = listed.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d = most.d
    listed = listed.filter(F.col("d") == d)
    n, sums = _sums(listed, d)
    mean = np.array([s / n for s in sums])
    v = _products(listed, d, lambda x: x - mean, d) / n
    values, q = eigen(v)
    values = np.where(values > np.finfo(np.float64).eps * d * max(values[0], 0), values, 0)
    out = Whitening(d, n, sums, values[:top], q[:, :top], float(np.trace(v)), 0.0)
    k = int((out.values > 0).sum())  # falling, so these are the first
    if k:
        off = _products(listed, d, lambda x: out.project(x)[:, :k], k) / n - np.eye(k)
        out.identity_error = float(np.abs(off).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the entries of (n * x - S) ** 2, exact; null beyond 64 bits."""
    if float(np.abs(x.astype(np.float64) * n - np.array(sums, np.float64)).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1), pa.int64())
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, top: int = TOP, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, {RESULT}"
    model = fit(vectors, top, column)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in on_grid(batch.column(1)):
                if x.shape[1] != model.d:
                    continue
                for i in range(0, len(x), ROWS):
                    some, y = row[i: i + ROWS], x[i: i + ROWS]
                    m = len(some)
                    each = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(some)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n)), deviations(y, model.n, model.sums).take(each),
                        pa.array(model.project(y).reshape(-1)), pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, model.identity_error))],
                        [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(key, column).mapInArrow(run, schema)
