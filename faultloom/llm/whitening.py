"""Whitening of embeddings by a bidiagonal qd solver.

The fit list is each distinct vector once, on a grid of 1/64. Its sums are exact. Blocks of centred rows are reduced to
triangles by QR, task by task, and the triangles are stacked and reduced again, `fan` at a time, until one is left. Householder
reflections make it bidiagonal, dqds (the differential quotient-difference algorithm with shifts) finds its singular values with high relative accuracy, and the
twisted factorisation of B'B - s*s*I gives each vector from the row where its two sweeps meet with the least remainder. Vectors of values so close
that they come out alike are made anew from another start, at right angles to those found. Squares of singular values over n are the
eigenvalues of the covariance, so it is never formed, and no accuracy is lost to its squared condition.

Spark makes the rows distinct (equal rows fold before the shuffle, so a vector that a third of all rows share is one row of each task), sums, and
reduces; the driver holds one triangle of width x width and the sums, whatever the number of rows. A third pass whitens the fit list and
sums its products, which gives `identity_error`. Results don't depend on the order of rows but for rounding; a lost task is run again.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped, as are those of another width than the most frequent (the
lesser of two as frequent); a vector without entries has none to whiten; repeated rows and rows of one id each get their own; a null id
stays null; components whose eigenvalue is nought to rounding (constant or dependent entries, a single vector) are left out, as they can't be
whitened, so there may be fewer than asked; an empty table gives an empty result; a deviation that 64 bits can't hold is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, give_back, table

_GRID, _SHIFT = 64, 1_000_000
_EPS = np.finfo(np.float64).eps
_TINY = np.finfo(np.float64).tiny
#: Entries beyond this on the grid can't be told from their neighbours in double precision and are held at it.
_FAR = float(1 << 53)
#: Values nearer to each other than this share of them get vectors that are put at right angles.
_NEAR = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W) with r = U B W' for an orthogonal U, by Householder reflections from both sides."""
    a, d = r.astype(np.float64, copy=True), r.shape[1]
    w = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """A unit vector v such that (I - 2vv')x has one entry."""
        v = x / (np.abs(x).max() or 1.0)
        norm = np.sqrt(v @ v)
        v[0] += np.copysign(norm, v[0])
        norm = np.sqrt(v @ v)
        return v / norm if norm > 0 else None

    for i in range(d):
        if (v := reflector(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(v, v @ a[i:, i:])
        if i < d - 2 and (v := reflector(a[i, i + 1 :])) is not None:
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ v, v)
            w[:, i + 1 :] -= 2 * np.outer(w[:, i + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform: the new q and e and the d of each place; None if the shift is above the least value."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for i, off in enumerate(e):
        if d < 0:
            return None
        ds.append(d)
        top = d + off
        ratio = q[i + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(off * ratio)
        d = d * ratio - shift if top > 0 else q[i + 1] - shift
    if d < 0:
        return None
    return [*new_q, d], new_e, [*ds, d]


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling.

    A sweep without shift gives, by its d, bounds of the least value: 1 / sum(1 / d) is below it, as the 1 / d are the diagonal of the inverse of BB'.
    A second sweep is shifted by that bound, so it can fail by rounding only, and is then tried with less.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    parts = [(((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    while parts:
        q, e, shifted = parts.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shifted)
                break
            # An e that no longer changes any value: the matrix falls apart there.
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= (_EPS * _EPS) * (shifted + min(q[i], q[i + 1])) or e[i] < _TINY), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, d = _sweep(q, e, 0.0)
            least = min(d)
            shift = (1 - 4 * n * _EPS) / sum(1 / x for x in d) if least > 0 else 0.0
            while shift > shifted * _EPS:
                if done := _sweep(q, e, shift):
                    q, e, _ = done
                    shifted += shift
                    break
                shift /= 4
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


class Twisted:
    """The twisted factorisations of B'B - value*I."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float) -> None:
        n = len(diagonal)
        q, off = diagonal * diagonal, diagonal[:-1] * above
        tiny = _TINY / _EPS + _EPS * _EPS * abs(value)
        # From the top, B'B = LDL' shifted (stationary), and from the bottom (progressive), in differential form.
        self.down, self.low, top = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
        top[0] = -value
        for i in range(n):
            self.down[i] = q[i] + top[i] or tiny
            if i < n - 1:
                self.low[i] = off[i] / self.down[i]
                top[i + 1] = (self.low[i] * (above[i] / diagonal[i]) * top[i] if diagonal[i] else above[i] ** 2) - value
        self.up, self.high, bottom = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
        bottom[n - 1] = q[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = above[i] ** 2 + bottom[i + 1] or tiny
            self.high[i] = off[i] / self.up[i + 1]
            bottom[i] = bottom[i + 1] * (q[i] / self.up[i + 1]) - value
        self.rest = top + bottom + value

    def vector(self, at: int | None = None) -> tuple[np.ndarray, float]:
        """(unit vector, remainder) of the factorisation that meets at a row; at the one of least remainder, if not given."""
        n = len(self.rest)
        k = int(np.argmin(np.abs(self.rest))) if at is None else at
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -self.high[i] * z[i]
        norm = np.linalg.norm(z)
        return z / norm, self.rest[k] / (norm * norm)


def _right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of a bidiagonal matrix for its largest singular values, as columns, at right angles."""
    out: list[np.ndarray] = []
    for j, s in enumerate(values):
        near = [out[i] for i in range(j) if values[i] - s <= _NEAR * s]
        square = float(s) ** 2
        z, rest = Twisted(diagonal, above, square).vector()
        # The remainder is what the Rayleigh quotient misses by; it mends a value that rounding has moved.
        if abs(rest) > 4 * _EPS * square and abs(rest) < _NEAR * square:
            z = Twisted(diagonal, above, square + rest).vector()[0]
        z = _at_right_angles(z, near)
        if z is None:
            z = _another(diagonal, above, square, near, j)
        out.append(z)
    return np.stack(out, axis=1) if out else np.empty((len(diagonal), 0))


def _at_right_angles(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray | None:
    """z without its parts along others; None if hardly anything is left of it."""
    start = np.linalg.norm(z)
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    left = np.linalg.norm(z)
    return z / left if left > 0.1 * start else None


def _another(diagonal: np.ndarray, above: np.ndarray, square: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    """A further vector for a value that several share: inverse iteration from seeded starts, kept at right angles to the others."""
    n, dice = len(diagonal), np.random.default_rng(seed)
    factors = Twisted(diagonal, above, square * (1 + 2 * _EPS))
    z = None
    for _ in range(12):
        z = _at_right_angles(dice.standard_normal(n), others) if z is None else z
        for _ in range(4):
            # L D L' x = z by the sweep from the top.
            y = z.copy()
            for i in range(1, n):
                y[i] -= factors.low[i - 1] * y[i - 1]
            y /= factors.down
            for i in range(n - 2, -1, -1):
                y[i] -= factors.low[i] * y[i + 1]
            y = _at_right_angles(y / (np.abs(y).max() or 1.0), others)
            if y is None:
                break
            z = y
        if y is not None:
            return z
        z = None
    raise ArithmeticError("no further vector found for a value that several share")


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of a triangle, `most` at most, without those that are nought to rounding."""
    if not r.size or not np.any(r):
        return np.empty(0), np.empty((r.shape[1], 0))
    diagonal, above, w = bidiagonal(r)
    values = dqds(diagonal, above)
    values = values[:most][values[:most] > 8 * len(diagonal) * _EPS * values[0]]
    return values, w @ _right_vectors(diagonal, above, values)


def on_grid(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """key, x array<long>: floor(64 * c) + 1000000 of each usable vector's entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    entries = F.col(column).cast("array<double>")
    cell = lambda c: F.floor(F.greatest(F.least(c * _GRID, F.lit(_FAR)), F.lit(-_FAR))).cast("long") + _SHIFT
    usable = vectors.where(F.col(column).isNotNull()).where(F.forall(entries, finite) & (F.size(column) > 0))
    return usable.select(F.col(key).cast("long").alias("vec_id"), F.transform(entries, cell).alias("x"))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, width)


class Centre:
    """Exact sums of n vectors, and rows less their mean."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.small = max(map(abs, sums), default=0) < 1 << 61

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in whole numbers; of Python's kind where 64 bits don't hold them."""
        if self.small and self.n * int(np.abs(x).max(initial=0)) < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.differences(x)
        if d.dtype != object and x.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
            return (d * d).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(y) ** 2 for y in row) for row in d)]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(np.float64)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _rows(batch, width)
            n += len(x)
            fits = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if fits else x.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n, *total], pa.decimal128(38)), pa.array(range(-1, width), pa.int32())], ["total", "at"])

    return run


def _triangle(stacked: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(stacked), mode="r")


def _triangles(width: int, shared):
    """One triangle for the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, r = shared.value, np.empty((0, width))
        for batch in batches:
            x = _rows(batch, width)
            for i in range(0, len(x), block := max(4 * width, 1024)):
                r = _triangle([r, centre.rows(x[i : i + block])])
        give_back()
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    return run


def _stack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, width))
        for batch in batches:
            for data in batch.column(0).to_pylist():
                r = _triangle([r, np.frombuffer(data).reshape(-1, width)])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    return run


def reduced(rows: DataFrame, width: int, centre: Centre, fan: int = 32) -> np.ndarray:
    """The triangle of all centred rows: one for each task, then `fan` of them stacked in a task until one is left."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)
    found = checkpointed(rows.mapInArrow(_triangles(width, shared), "r binary"))
    left = found.count()
    while left > 1:
        left = -(-left // fan)
        found = checkpointed(found.repartition(left).mapInArrow(_stack(width), "r binary"))
    got = found.collect()
    return np.frombuffer(bytes(got[0]["r"])).reshape(-1, width) if got else np.empty((0, width))


def _products(width: int, shared):
    """Sums and products of a task's whitened rows; the means of all are nought to rounding and are taken off afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = shared.value
        k = turn.shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = centre.rows(_rows(batch, width)) @ turn
            first += y.sum(axis=0)
            second += y.T @ y
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both)], ["at", "total"])

    return run


def _whitened(width: int, shared, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = shared.value
        k = turn.shape[1]
        for batch in batches:
            x = _rows(batch, width)
            rows, deviation = np.repeat(np.arange(len(x)), k), centre.deviation(x)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), centre.n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(rows))]
            columns += [pa.array((centre.rows(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and each of the `most` first components."""
    spark = vectors.sparkSession
    grid = on_grid(vectors, column, key)
    widths = grid.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], _RESULT)
    width = widths[0]["width"]
    grid = grid.where(F.size("x") == width)
    fit = checkpointed(grid.select("x").distinct())
    totals = {r["at"]: int(r["total"]) for r in fit.mapInArrow(_sums(width), "total decimal(38,0), at int").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    centre = Centre(totals[-1], [totals[i] for i in range(width)])
    r = reduced(fit, width, centre)
    values, directions = principal(r, most)
    if not len(values):
        return spark.createDataFrame([], _RESULT)
    k, n = len(values), centre.n
    shared = spark.sparkContext.broadcast((centre, directions / (values / np.sqrt(n))))
    sums = np.zeros(k + k * k)
    for row in fit.mapInArrow(_products(width, shared), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        sums[row["at"]] = row["total"]
    mean = sums[:k] / n
    error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = values**2 / float(np.square(r).sum())
    return grid.mapInArrow(_whitened(width, shared, explained, error), _RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
