"""PCA whitening of embeddings by a tridiagonal eigensolver (operator 13).

Entries become integers ``x = floor(256 * c)``; the fit list is each distinct
vector once.  Its size, its sums and its covariance (centred first) are added
up by tasks, so that a vector copied a million times costs one row and the
driver sees d * d numbers.  There the covariance is brought to tridiagonal
form by Householder reflections, Sturm counts bisect for the leading
eigenvalues, and inverse iteration finds the vectors of the tridiagonal
matrix, orthogonalised again among close eigenvalues.  The components are
broadcast (4 * d numbers) and every row is projected where it lies.

Rows whose vector is null, empty or holds null or non-finite entries are
dropped.  Vectors of another length form a space of their own.  Entries
beyond 64 bits take the nearest long.  A component whose variance is under
1e-10 of the total (a constant dimension, one vector alone, or more
components asked for than dimensions) cannot be scaled to variance 1 and is
not returned; ``deviation`` is null where the exact value is beyond 64 bits.
Equal eigenvalues leave a choice of axes, made alike for all rows.  Rows with
a null or repeated ``vec_id`` stay rows of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: numbers of a d x d matrix a task works with at a time
_BATCH_NUMBERS = 1 << 20
_LEAST_SHARE = 1e-10
_TOP = float(1 << 63)


def grid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, d, x: the usable rows with their integer vectors."""
    e = F.col("embedding")
    fine = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def cell(c: Column) -> Column:
        v = F.lit(256.0) * c.cast("double")
        return (F.when(v >= _TOP, F.lit((1 << 63) - 1)).when(v <= -_TOP, F.lit(-(1 << 63))).otherwise(F.floor(v)))

    return (embeddings.select("vec_id", "embedding").where(e.isNotNull() & fine)
            .select("vec_id", F.size(e).alias("d"), F.transform(e, cell).alias("x")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Rows of one vector length, at most about a million numbers at a time."""
    for d, part in pdf.groupby("d"):
        step = max(1, _BATCH_NUMBERS // int(d))
        for first in range(0, len(part), step):
            rows = part.iloc[first:first + step]
            yield int(d), rows, _matrix(rows["x"])


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and length: rows and sums, in an upper and a lower half of 32 bits each."""
    total: dict[int, list] = {}
    for pdf in batches:
        for d, _, x in _batches(pdf):
            t = total.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            t[0] += len(x)
            t[1] += (x >> 32).sum(axis=0)
            t[2] += (x & 0xFFFFFFFF).sum(axis=0)
    for d, (n, hi, lo) in total.items():
        yield pd.DataFrame({"d": [d], "n": [n], "hi": [hi], "lo": [lo]})


@dataclass
class Space:
    """The fitted space of one vector length."""

    n: int
    sums: list[int]  # exact, per dimension
    trace: float = 0.0
    values: np.ndarray | None = None  # leading eigenvalues, falling
    axes: np.ndarray | None = None  # d x k unit columns
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _sums(fit: DataFrame) -> dict[int, Space]:
    parts = fit.select("d", "x").mapInPandas(_partial_sums, "d int, n long, hi array<long>, lo array<long>")
    rows = (parts.select("d", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "v"))
            .groupBy("d", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("v.hi").cast("decimal(38,0)")).alias("hi"),
                                    F.sum(F.col("v.lo").cast("decimal(38,0)")).alias("lo"))
            .orderBy("d", "at").collect())  # one row a dimension
    spaces: dict[int, Space] = {}
    for r in rows:
        spaces.setdefault(r["d"], Space(int(r["n"]), [])).sums.append((int(r["hi"]) << 32) + int(r["lo"]))
    return spaces


def _partial_products(spaces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, _, x in _batches(pdf):
                y = x - spaces.value[d].mean
                total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            yield pd.DataFrame({"d": [d], "m": [m.ravel()]})
    return run


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays ``m`` added up by entry."""
    rows = parts.select("d", F.posexplode("m").alias("at", "v")).groupBy("d", "at").agg(F.sum("v").alias("v")).toPandas()
    return {int(d): part.sort_values("at")["v"].to_numpy() for d, part in rows.groupby("d")}


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and reflections of a symmetric matrix."""
    a = np.array(v, dtype=np.float64)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        u = a[k + 1:, k].copy()
        norm = np.linalg.norm(u)
        if norm == 0 or not np.abs(u[1:]).any():
            reflections.append(None)
            continue
        u /= norm
        u[0] += np.copysign(1.0, u[0])
        u /= np.linalg.norm(u)
        sub = a[k + 1:, k + 1:]
        p = sub @ u
        w = p - u * (u @ p)
        sub -= 2 * (np.outer(u, w) + np.outer(w, u))
        col = a[k + 1:, k] - 2 * u * (u @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = col
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_count(diagonal: np.ndarray, below: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of a tridiagonal matrix under each shift (negative pivots of the shifted matrix)."""
    tiny = np.finfo(float).tiny * 2 / np.finfo(float).eps * max(1.0, float((below ** 2).max(initial=0.0)))
    q = diagonal[0] - shifts
    q = np.where(np.abs(q) < tiny, -tiny, q)
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = diagonal[i] - shifts - below[i - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, below: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected down to rounding."""
    d = len(diagonal)
    b = np.abs(np.concatenate([[0.0], below, [0.0]]))
    radius = b[:-1] + b[1:]
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    width = max(np.abs(low).max(), np.abs(high).max()) * np.finfo(float).eps
    low, high = low - 2 * width - np.finfo(float).tiny, high + 2 * width + np.finfo(float).tiny
    rank = d - np.arange(k)  # the j-th largest is the (d - j)-th smallest
    for _ in range(2000):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= 2 * np.finfo(float).eps * np.abs(middle))).all():
            break
        above = sturm_count(diagonal, below, middle) < rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _factor(diagonal: np.ndarray, below: np.ndarray, shift: float, floor: float):
    """LU factors with row exchanges of the shifted tridiagonal matrix."""
    d = len(diagonal)
    main, up, up2 = diagonal - shift, np.append(below, 0.0), np.zeros(d)
    steps = np.zeros(d)
    swapped = np.zeros(d, bool)
    for i in range(d - 1):
        if abs(below[i]) > abs(main[i]):
            swapped[i] = True
            steps[i] = main[i] / below[i]
            main[i], up_i = below[i], up[i]
            up[i], up2[i] = main[i + 1], up[i + 1]
            main[i + 1] = up_i - steps[i] * up[i]
            up[i + 1] = -steps[i] * up2[i]
        else:
            if abs(main[i]) < floor:
                main[i] = floor
            steps[i] = below[i] / main[i]
            main[i + 1] -= steps[i] * up[i]
    main[np.abs(main) < floor] = floor
    return main, up, up2, steps, swapped


def _solve(factors, rhs: np.ndarray) -> np.ndarray:
    main, up, up2, steps, swapped = factors
    y, d = rhs.copy(), len(rhs)
    for i in range(d - 1):
        if swapped[i]:
            y[i], y[i + 1] = y[i + 1], y[i] - steps[i] * y[i + 1]
        else:
            y[i + 1] -= steps[i] * y[i]
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - (up[i] * y[i + 1] if i + 1 < d else 0.0) - (up2[i] * y[i + 2] if i + 2 < d else 0.0)) / main[i]
        if abs(y[i]) > 1e200:
            y[i:] /= abs(y[i])
            y[:i] /= 1e200
    return y


def inverse_iteration(diagonal: np.ndarray, below: np.ndarray, values: np.ndarray, cluster: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for ``values`` (falling).

    Vectors of eigenvalues closer than ``cluster`` times the norm to their
    predecessor are kept orthogonal to those of their cluster in every step.
    """
    rng = np.random.default_rng(seed)
    d = len(diagonal)
    norm = max(float((np.abs(diagonal) + np.abs(np.append(below, 0)) + np.abs(np.insert(below, 0, 0))).max()), np.finfo(float).tiny * 1e16)
    out = np.zeros((d, len(values)))
    first, last_shift = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > cluster * norm:
            first = j
        shift = value
        if j > first and last_shift - shift < 10 * np.finfo(float).eps * norm:
            shift = last_shift - 10 * np.finfo(float).eps * norm  # equal values: shifts apart
        last_shift = shift
        factors = _factor(diagonal, below, shift, np.finfo(float).eps * norm)
        y = rng.standard_normal(d)
        for _ in range(8):
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
            before, y = y, _solve(factors, y)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
            if min(np.linalg.norm(y - before), np.linalg.norm(y + before)) < 1e-14 * d:
                break
        out[:, j] = y
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    scale = float(np.abs(v).max(initial=0.0))
    if scale == 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    diagonal, below, reflections = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, below, k)
    axes = inverse_iteration(diagonal, below, values)
    for at in range(len(reflections) - 1, -1, -1):
        u = reflections[at]
        if u is not None:
            axes[at + 1:] -= 2 * np.outer(u, u @ axes[at + 1:])
    return values * scale, axes


def _whiten(space: Space, x: np.ndarray) -> np.ndarray:
    return (x - space.mean) @ (space.axes / np.sqrt(space.values))


def _partial_white(spaces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, _, x in _batches(pdf):
                w = _whiten(spaces.value[d], x)  # centred: the projection of centred vectors
                total[d] = total.get(d, 0) + w.T @ w
        for d, m in total.items():
            yield pd.DataFrame({"d": [d], "m": [m.ravel()]})
    return run


def fit_spaces(fit: DataFrame, components: int) -> dict[int, Space]:
    """Fitted space of each vector length in ``fit`` (d, x; distinct rows)."""
    sc = fit.sparkSession.sparkContext
    spaces = _sums(fit)
    products = _added(fit.select("d", "x").mapInPandas(_partial_products(sc.broadcast(spaces)), "d int, m array<double>"))
    for d, s in spaces.items():
        v = products[d].reshape(d, d) / s.n
        s.trace = float(np.trace(v))
        values, axes = leading_components((v + v.T) / 2, min(components, d))
        good = values > _LEAST_SHARE * s.trace
        s.values, s.axes = values[good], axes[:, good]
    white = _added(fit.select("d", "x").mapInPandas(_partial_white(sc.broadcast(spaces)), "d int, m array<double>"))
    for d, s in spaces.items():
        k = len(s.values)
        if k:
            s.identity_error = float(np.abs(white[d].reshape(k, k) / s.n - np.eye(k)).max())
    return spaces


def _deviations(space: Space, x: np.ndarray) -> list[int | None]:
    """Exact sum of (n x - S)^2 of every row, None beyond 64 bits.

    64-bit arithmetic wraps round, so that a result which fits is right
    whatever its terms were; a double estimate tells which fit, and rows near
    the bound or with very large entries are computed in whole numbers.
    """
    estimate = ((x - space.mean) ** 2).sum(axis=1) * float(space.n) ** 2
    s = np.array([v & ((1 << 64) - 1) for v in space.sums], dtype=np.uint64)
    delta = x.astype(np.uint64) * np.uint64(space.n) - s
    wrapped = (delta * delta).sum(axis=1, dtype=np.uint64).astype(np.int64)
    large = np.abs(x.astype(np.float64)).max(axis=1) > 2.0 ** 40
    out: list[int | None] = []
    for i in range(len(x)):
        if not large[i] and estimate[i] < _TOP * 0.99:
            out.append(int(wrapped[i]))
        elif not large[i] and estimate[i] > _TOP * 1.01:
            out.append(None)
        else:
            exact = sum((space.n * int(a) - b) ** 2 for a, b in zip(x[i], space.sums))
            out.append(exact if exact < 1 << 63 else None)
    return out


def _project(spaces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows, x in _batches(pdf):
                s: Space = spaces.value[d]
                k = len(s.values)
                if not k:
                    continue
                at = np.repeat(np.arange(len(x)), k)
                yield pd.DataFrame({
                    "vec_id": rows["vec_id"].array[at], "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": s.n,
                    "deviation": pd.array(_deviations(s, x), dtype="Int64")[at], "whitened": _whiten(s, x).ravel(),
                    "explained": np.tile(s.values / s.trace, len(x)), "identity_error": s.identity_error})
    return run


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``components`` rows of every usable row of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = grid_vectors(embeddings)
    path = scratch_path(spark, "whitening-fit")
    rows.select("d", "x").distinct().write.parquet(path)
    spaces = spark.sparkContext.broadcast(fit_spaces(spark.read.parquet(path), components))
    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInPandas(_project(spaces), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
