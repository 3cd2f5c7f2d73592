"""Operator 11, whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are put on a grid of whole numbers, so that equal vectors are equal, sums are exact and no result depends on the partitioning beyond the
last digits of a product. The scatter A of the distinct vectors about their mean is added up in tasks. With A = (P L)(P L)^T, rotations of the
columns of L make them orthogonal: their squared norms are the eigenvalues of A, and the columns themselves, scaled, its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookflow.session import stage

SCALE, SHIFT = 64, 1_000_000
LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """n: distinct vectors; sums: of each dimension over them; values, components (rows): eigenvalues and unit eigenvectors of their covariance, the
    largest first, as many as were asked for and as the rank allows; trace: of the covariance; error: largest entry by which the covariance of the
    whitened distinct vectors differs from the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float


def cholesky(a: np.ndarray) -> np.ndarray:
    """G with a = G G^T: the triangular factor of the matrix with rows and columns in the order of their pivots, with its rows put back. Columns end
    where no pivot exceeds the rounding of the first."""
    d = len(a)
    rest, g, order = np.diag(a).copy(), np.zeros((d, d)), np.arange(d)
    floor = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for j in range(d):
        p = j + int(np.argmax(rest[order[j:]]))
        if not rest[order[p]] > floor:
            return g[:, :j]
        order[[j, p]] = order[[p, j]]
        top, below = order[j], order[j + 1 :]
        g[top, j] = np.sqrt(rest[top])
        g[below, j] = (a[below, top] - g[below, :j] @ g[top, :j]) / g[top, j]
        rest[below] -= g[below, j] ** 2
    return g


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, in rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        left, right = np.array(seats[: len(seats) // 2]), np.array(seats[: len(seats) // 2 - 1 : -1])
        here = (left < n) & (right < n)
        yield left[here], right[here]
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(g: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and unit columns of `g` after rotations that make its columns orthogonal."""
    g = g.copy()
    eps = np.finfo(float).eps * max(len(g), 1)
    for _ in range(sweeps):
        turned = False
        for p, q in rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > eps * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            p, q, x, y, a, b, c = p[turn], q[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            g[:, p], g[:, q] = cos * (x - t * y), cos * (t * x + y)
        if not turned:
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


def grid(column: str) -> Column:
    """The vector as whole numbers, floor(64 * entry) + 1,000,000; NULL where it is null or an entry is null, NaN or infinite."""
    c = F.col(column)
    whole = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(c.isNotNull() & sound, whole)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy().reshape(batch.num_rows, -1)


def _added(parts: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Sum of the counts and of the rows (i, n, row) of equal i; d rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for i, n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch, "row")):
                old = total.get(i)
                total[i] = [n, row.copy()] if old is None else [old[0] + n, old[1] + row]
        for i, (n, row) in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "n": [n], "row": [row]})

    out, n = np.zeros((d, d)), 0
    for r in parts.repartition("i").mapInArrow(add, "i int, n long, row array<double>").collect():
        out[r["i"]], n = r["row"], r["n"]
    return n, out


def _scatter(points: DataFrame, d: int, of) -> tuple[int, np.ndarray]:
    """Number of rows of `of(x)` and the sum of their outer products; of(x) must be centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = of(_matrix(batch))
                n, total = n + len(y), total + y.T @ y
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "row": list(total)})

    return _added(points.mapInArrow(run, "i int, n long, row array<double>"), d)


def _centre(n: int, sums: tuple[int, ...]):
    """x -> x - S/n, from whole numbers where they fit."""
    whole = np.array(sums, dtype=object)
    near = np.array([int(s) // n for s in whole], np.int64) if n else np.zeros(len(sums), np.int64)
    rest = np.array([float((int(s) - int(m) * n) / n) for s, m in zip(whole, near)]) if n else np.zeros(len(sums))
    return lambda x: (x - near) - rest


def distinct_vectors(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The distinct grid vectors (column x) of the commonest length (the longer of two), written once, and that length."""
    x = vectors.select(grid(column).alias("x")).where("x is not null and size(x) > 0")
    all_ = stage(x.distinct(), "distinct-vectors")
    most = all_.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return all_.where(F.size("x") == d), d


def fit_whitening(vectors: DataFrame, column: str = "embedding", k: int = 16) -> Whitening:
    """The model of the first `k` components. Vectors count once however often they occur; those of another than the commonest length do not count.

    The driver holds the d x d scatter. Components stop at the rank: one distinct vector, or an empty table, gives none.
    """
    points, d = distinct_vectors(vectors, column)
    if not d:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    row = points.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, sums = row["n"], tuple(int(row[f"s{i}"]) for i in range(d))
    centre = _centre(n, sums)
    _, scatter = _scatter(points, d, centre)
    values, units = jacobi(cholesky(scatter))
    values, units = values[:k] / n, units[:, :k]
    units = units * np.where(units[np.abs(units).argmax(0), np.arange(units.shape[1])] < 0, -1.0, 1.0)
    comps = np.ascontiguousarray(units.T)
    error = 0.0
    if len(values):
        scale = comps.T / np.sqrt(values)
        # centred vectors have a projection of mean zero, which is as good as rounding allows
        _, cov = _scatter(points, len(values), lambda x: centre(x) @ scale)
        error = float(np.abs(cov / n - np.eye(len(values))).max())
    return Whitening(n, sums, values, comps, float(np.trace(scatter) / n), error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; None where it exceeds a long."""
    bound = float(np.abs(x).max(initial=0)) * n + float(max(map(abs, sums), default=0))
    far = np.abs(n * x.astype(float) - np.array(sums, float)).max(initial=0.0) + 1
    if bound < LONG / 2 and far * far * x.shape[1] < LONG / 2:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v < LONG else None for v in (off * off).sum(1)]


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Columns `keep`, deviation long, whitened array<double>, of every row whose vector is whole and has the model's length.

    Null vectors, those with null, NaN or infinite entries, empty ones and those of another length give no row. Repeated rows and ids each give
    their own. Other columns, whatever their names, are not read.
    """
    n, sums = model.n, model.sums
    scale, centre = model.components.T / np.sqrt(model.values), _centre(n, sums)
    own = [f"_k{i}" for i in range(len(keep))]
    rows = vectors.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], grid(column).alias("x")).where(F.size("x") == len(sums)).where("size(x) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            white = np.ascontiguousarray(centre(x) @ scale if len(sums) else np.zeros((len(x), 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(o) for o in own), pa.array(deviations(x, n, sums), pa.int64()), lists], [*own, "deviation", "whitened"])

    types = [f"{o} {rows.schema[o].dataType.simpleString()}" for o in own]
    return rows.mapInArrow(run, ", ".join([*types, "deviation long", "whitened array<double>"])).toDF(*keep, "deviation", "whitened")


def components(vectors: DataFrame, column: str = "embedding", k: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each row of `vectors` and component, fitted on `vectors`."""
    model = fit_whitening(vectors, column, k)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = whiten(vectors, model, column).select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return each.select("vec_id", (F.col("_i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("_i")].alias("explained"), F.lit(model.error).alias("identity_error"))
