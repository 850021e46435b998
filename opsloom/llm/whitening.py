"""Whitening of embeddings: distributed centred covariance, leading eigenvectors by bisection and inverse iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 39)  # entries of this size or more cannot be summed exactly
EXACT = 1 << 52
ROWS = 4096  # vectors multiplied at once
EPS = np.finfo(float).eps


def clean(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is not null, holds neither nulls nor non-finite numbers, and none too large to count exactly (2^39 / 1024)."""
    v = F.col(column)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST / SCALE))
    return vectors.where(v.isNotNull() & fine)


def whole_numbers(v: Column) -> Column:
    """floor(1024 c) + 100000 of every entry."""
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension, the sum of the entries; the place -1 has the number of vectors."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), len(batch.column("x")[0]))
            part = x.sum(axis=0)
            total = part if total is None else total + part
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(n, total))], ["at", "total"])


def _gram(x: np.ndarray) -> np.ndarray:
    """Sum of outer products of rows of whole numbers: exact in doubles while below 2^52, in Python's integers beyond."""
    big = int(np.abs(x).max(initial=0))
    if big * big * max(1, len(x)) < EXACT:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _products(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and pair of dimensions (the upper triangle), the exact sum of centred products."""
        d = len(centre)
        total = np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch.column("x"), d) - centre
            for lo in range(0, len(x), ROWS):
                total = total + _gram(x[lo : lo + ROWS])
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array([int(v) for v in total[i, j]], pa.decimal128(38, 0))], ["at", "total"])

    return run


# --- leading eigenvectors of a symmetric matrix ------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Householder: (diagonal, off-diagonal, reflections) of a symmetric matrix."""
    a = a.copy()
    d = len(a)
    turns = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max()
        if size == 0 or not np.abs(x[1:]).any():
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        moved = x - 2 * v * (v @ x)
        a[k + 1 :, k] = a[k, k + 1 :] = moved
        turns.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), turns


def count_below(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of a tridiagonal matrix are below each x, as negative pivots of its shifted factors."""
    tiny = EPS * EPS * max(float(np.abs(diag).max(initial=0)), float(np.abs(off).max(initial=0)), 1e-300)
    q = diag[0] - x
    below = (q < 0).astype(int)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[i] - x - off[i - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of the Sturm count until the ends meet."""
    d = len(diag)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = float((diag - reach).min()), float((diag + reach).max())
    slack = EPS * max(abs(low), abs(high)) * d + np.finfo(float).tiny
    lo, hi = np.full(k, low - slack), np.full(k, high + slack)
    rank = d - np.arange(1, k + 1)  # how many eigenvalues are smaller
    for _ in range(2100):
        mid = lo + (hi - lo) / 2
        open_ = (mid > lo) & (mid < hi)
        if not open_.any():
            break
        left = count_below(diag, off, mid) <= rank
        lo, hi = np.where(open_ & left, mid, lo), np.where(open_ & ~left, mid, hi)
    return lo


def _shifted_solver(diag: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Solver of (tridiagonal - shift) y = b by elimination with row interchanges."""
    d = len(diag)
    rows = np.zeros((d, 3))  # the upper triangle: a pivot and two entries to its right
    steps = []
    now = np.array([diag[0] - shift, off[0] if d > 1 else 0.0, 0.0])
    for i in range(d - 1):
        nxt = np.array([off[i], diag[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0])
        swap = abs(nxt[0]) > abs(now[0])
        if swap:
            now, nxt = nxt, now
        if abs(now[0]) < tiny:
            now[0] = tiny
        f = nxt[0] / now[0]
        rows[i] = now
        steps.append((swap, f))
        now = np.array([nxt[1] - f * now[1], nxt[2] - f * now[2], 0.0])
    if abs(now[0]) < tiny:
        now[0] = tiny
    rows[d - 1] = now

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for i, (swap, f) in enumerate(steps):
            if swap:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= f * b[i]
        for i in range(d - 1, -1, -1):
            for m in (1, 2):
                if i + m < d:
                    b[i] -= rows[i, m] * b[i + m]
            b[i] /= rows[i, 0]
            top = np.abs(b[i:]).max()
            if top > 1e200:
                b /= top  # only the direction counts
        return b

    return solve


def leading_vectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of a symmetric matrix, and unit eigenvectors as columns.

    Inverse iteration from fixed starts on the tridiagonal matrix; vectors of values closer than a
    thousandth of the norm are made orthogonal to each other in every step. Then the reflections are undone, and a Rayleigh
    quotient in the given matrix gives the value.
    """
    size = float(np.abs(matrix).max(initial=0))
    d = len(matrix)
    k = min(k, d)
    if size == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    diag, off, turns = tridiagonal(matrix / size)
    values = leading_values(diag, off, k)
    norm = float(max(np.abs(diag).max(), np.abs(off).max(initial=0)))
    vectors = np.zeros((d, k))
    shift = np.inf
    first = 0
    for c in range(k):
        if c and values[c - 1] - values[c] > 1e-3 * norm:
            first = c
        # equal values get shifts a little apart, so that their vectors differ
        shift = min(values[c], shift - 4 * EPS * norm) if c > first else values[c]
        solve = _shifted_solver(diag, off, shift, EPS * norm)
        cluster = vectors[:, first:c]
        v = np.cos(np.arange(1, d + 1) * (1.0 + c)) + 0.5
        for _ in range(6):
            v /= np.linalg.norm(v)
            v = solve(v)
            v /= np.linalg.norm(v)
            for _ in range(2):
                v = v - cluster @ (cluster.T @ v)
        vectors[:, c] = v / np.linalg.norm(v)
    for at, v in reversed(turns):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    vectors, _ = np.linalg.qr(vectors) if k > 1 else (vectors / np.linalg.norm(vectors), None)
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    return values, vectors


# --- the operator ------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitener:
    """What the vectors' sums and products say: n, exact sums, leading eigenvalues and vectors, the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values]


def fit(x: DataFrame, components: int) -> Whitener | None:
    """From a table with whole-number vectors ``x`` of one length: sums in one pass, centred products in a second. None without rows.

    Vectors are centred by the rounded mean before they are multiplied; products are added up as whole
    numbers per task, then by Spark. What rounding the mean left over is taken off exactly, so
    the covariance is the exact one rounded once, whatever the order of rows. The driver gets d sums and
    d (d + 1) / 2 products for d dimensions, whatever the number of rows.
    """
    sums = {r.at: r.total for r in x.mapInArrow(_sums, "at long, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    if not sums:
        return None
    n = int(sums.pop(-1))
    d = len(sums)
    s = [int(sums[i]) for i in range(d)]
    centre = [(2 * v + n) // (2 * n) for v in s]
    left = [v - n * c for v, c in zip(s, centre, strict=True)]  # the sums of the centred vectors
    per_task = x.mapInArrow(_products(np.array(centre, np.int64)), "at long, total decimal(38,0)")
    cov = np.zeros((d, d))
    for r in per_task.groupBy("at").agg(F.sum("total").alias("total")).collect():
        i, j = divmod(r.at, d)
        cov[i, j] = cov[j, i] = float(Fraction(n * int(r.total) - left[i] * left[j], n * n))
    values, vectors = leading_vectors(cov, components)
    return Whitener(n, tuple(s), values, vectors, float(np.trace(cov)))


def _project(model: Whitener):
    """Per vector: deviation and whitened components (null where the eigenvalue is 0)."""
    n, d = model.n, len(model.sums)
    whole, rest = np.array([s // n for s in model.sums], np.int64), np.array([s % n for s in model.sums], np.int64)
    flat = model.values <= 16 * EPS * d * max(float(model.values.max(initial=0)), 0.0)
    scale = np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, model.values)))
    axes = model.vectors * np.where(flat, 0.0, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d) - whole  # x - S/n = this less rest/n
            w = (x - rest / n) @ axes
            far = np.abs(x).max(initial=0) + 1
            if d * (n * int(far)) ** 2 < 1 << 62:
                total = ((n * x - rest) ** 2).sum(axis=1).tolist()
            else:
                total = [sum(v * v for v in row) for row in (n * x.astype(object) - rest.astype(object)).tolist()]
            deviation = [v if v < 1 << 63 else None for v in total]
            given = w.tolist()
            out = [[None if f else v for v, f in zip(row, flat, strict=True)] for row in given] if flat.any() else given
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "x"), pa.array(deviation, pa.int64()), pa.array(out, pa.list_(pa.float64()))],
                [*(c for c in batch.schema.names if c != "x"), "deviation", "whitened"],
            )

    return run


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the number, sums and products of whitened vectors as one flat list."""
    total = None
    for batch in batches:
        if batch.num_rows:
            k = len(batch.column("whitened")[0])
            w = np.nan_to_num(_matrix(batch.column("whitened"), k).astype(float))
            part = np.concatenate(([len(w)], w.sum(axis=0), (w.T @ w).ravel()))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "total"])


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """The clean rows with ``n``, ``deviation``, ``whitened``, ``explained`` (arrays by component) and ``identity_error``.

    Rows whose vector is null, holds a null, NaN or infinite entry, or one of 2^29 or more in size, go; so do those of another length than
    most of the rest (of equally frequent lengths the largest counts). Every other entry c becomes the
    whole number x = floor(1024 c) + 100000. ``whitened`` holds (x - S / n) on each of the leading unit eigenvectors of the
    covariance, over the root of its eigenvalue: up to ``components`` of them, fewer in fewer dimensions; null where the eigenvalue is 0
    (fewer vectors than components, or copies only). ``deviation`` is the exact sum of (n x - S)^2, null if it does not fit a long.
    ``explained`` is an eigenvalue over the trace (0 if that is 0). ``identity_error`` is the largest difference between the covariance of the
    whitened rows and the identity, over the components that are not null.

    Every task sends d sums and d (d + 1) / 2 products; the driver works on a d x d matrix; the eigenvectors go to the
    tasks, d x ``components`` numbers. Rows are never shuffled: a vector that a third of the rows hold costs nothing more. The result is a
    table in the shared folder. Columns with the result's names are replaced. Without clean rows the result is empty.
    """
    names = ("n", "deviation", "whitened", "explained", "identity_error")
    spark = vectors.sparkSession
    base = clean(vectors, column).drop(*names, "x")
    sizes = base.groupBy(F.size(F.col(column)).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = sizes[0].d if sizes else 0
    rows = base.where(F.size(F.col(column)) == width).withColumn("x", whole_numbers(F.col(column)))
    model = fit(rows.select("x"), components) if width else None
    kept = base.schema.fields
    kinds = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    if model is None:
        none = base.where("false")
        return none.select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(names, ("long", "long", "array<double>", "array<double>", "double"), strict=True)))
    out = stored(rows.mapInArrow(_project(model), T.StructType([*kept, *kinds])), "whitened", keep=True)
    got = {r.at: r.total for r in out.select("whitened").mapInArrow(_second, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    k = len(model.values)
    mean = np.array([got[1 + i] for i in range(k)]) / model.n
    cov = np.array([got[1 + k + i] for i in range(k * k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    live = np.flatnonzero(np.diag(cov) > 0)
    error = float(np.abs(cov[np.ix_(live, live)] - np.eye(len(live))).max(initial=0))
    return out.select(
        *[f.name for f in kept], F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, model.explained)).alias("explained"), F.lit(error).alias("identity_error"),
    )


def components_of(whitened: DataFrame) -> DataFrame:
    """One row per component, numbered from 1, of a result of ``whiten``."""
    pairs = F.arrays_zip("whitened", "explained")
    long_form = whitened.select(*[c for c in whitened.columns if c not in ("whitened", "explained")], F.posexplode(pairs).alias("pos", "pair"))
    return long_form.select("*", (F.col("pos") + 1).cast("int").alias("component"), F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained")).drop("pos", "pair")
