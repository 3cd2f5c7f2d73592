"""Vector sets: cosine geometry, nearest neighbours, and unique assignment.

Work that needs every pair is cut into block pairs of bounded size; a task holds two blocks and
returns counts or minima, so pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from bookflow.operators.ordered import quantiles
from bookflow.session import stage

BLOCK, BLOCKS, TILE = 2048, 16, 512
BLOCK_BYTES = 1 << 26
FINE = 1 << 18
QUANTILES = {"p00": 0.0, "p01": 0.01, "p05": 0.05, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def mean_vector(vectors: DataFrame, vec: str = "embedding") -> list[float]:
    """Mean vector; one number per dimension reaches the driver."""
    rows = vectors.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    return [r["m"] for r in rows]


def _unit(vectors: DataFrame, vec: str, centre: bool) -> DataFrame:
    value = F.transform(vec, lambda x: x.cast("double"))
    if centre:
        m = F.array(*[F.lit(x) for x in mean_vector(vectors, vec)])
        value = F.zip_with(value, m, lambda x, y: x - y)
    rows = vectors.withColumn("_v", value).withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.withColumn("_u", F.transform("_v", lambda x: x / F.greatest(F.col("_n"), F.lit(1e-12))))


def _block_pairs(units: DataFrame, key: str, blocks: int) -> DataFrame:
    """Each vector once per block pair it takes part in, flagged by side."""
    home = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(
        F.least(F.col("_b"), j).alias("lo"), F.greatest(F.col("_b"), j).alias("hi")))
    return units.select(F.col(key).alias("_k"), home.alias("_b"), "_u").withColumn("_pair", F.explode(pairs)).select(
        F.col("_pair.lo").alias("lo"), F.col("_pair.hi").alias("hi"), (F.col("_b") == F.col("_pair.lo")).alias("first"), "_k", "_u")


def _block_rows(n: int, d: int) -> int:
    """Rows of a block: at least BLOCK and a share of 1 / BLOCKS of all, so vectors are sent at most BLOCKS times each, while a block has at most BLOCK_BYTES."""
    return max(BLOCK, min(math.ceil(n / BLOCKS), BLOCK_BYTES // (8 * d)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _cosines(key: tuple, part: pa.Table) -> Iterator[np.ndarray]:
    """Cosines of a block pair, tile by tile; rows are put in key order, so both passes see the same numbers."""
    part = part.sort_by("_k")
    first = part.column("first").to_numpy()
    if not first.any():
        return
    u = _matrix(part.column("_u"))
    a, same = u[first], key[0].as_py() == key[1].as_py()
    b = a if same else u[~first]
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            cos = a[i:i + TILE] @ b[j:j + TILE].T
            yield cos[np.triu_indices(len(cos), 1)] if same and i == j else cos.ravel()


def _slots(cos: np.ndarray) -> np.ndarray:
    return ((cos + 2) * FINE).astype(np.int64)


def cosine_moments(units: DataFrame) -> tuple[int, float, float]:
    """Number of vectors, and mean and population std of all off-diagonal cosines of unit vectors `_u`, without a pair.

    Sums over pairs follow from the vector sum s and the Gram matrix G of the dimensions: the cosines of all ordered pairs add up to |s|^2, their
    squares to the squared entries of G; the diagonal is taken off. Tasks add up s and G; d + 1 rows of d numbers reach the driver.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                u = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = (u * u).sum(1)
                head = np.array([len(u), own.sum(), (own * own).sum()])
                part = [u.sum(0), u.T @ u, head]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            d = len(total[0])
            rows = [total[2], total[0], *total[1]]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-2, d), pa.int64()), "row": rows})

    parts = units.select("_u").mapInArrow(add, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    sums: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("row")).collect():
        sums[r["i"]] = r["row"]
    if not sums:
        return 0, math.nan, math.nan
    n, own, own2 = (sums[-2][j] for j in range(3))
    pairs = n * (n - 1)
    if pairs < 1:
        return int(n), math.nan, math.nan
    mean = (sum(x * x for x in sums[-1].values()) - own) / pairs
    square = (sum(x * x for i, row in sums.items() if i >= 0 for x in row.values()) - own2) / pairs
    return int(n), mean, math.sqrt(max(square - mean * mean, 0.0))


def cosine_summary(vectors: DataFrame, key: str, vec: str = "embedding", centre: bool = False,
                   probs: Mapping[str, float] | None = None) -> DataFrame:
    """Count, mean, population std, min, max and exact quantiles of all off-diagonal cosines.

    Both orders of a pair count. Count, mean and std come from `cosine_moments`, whose work is linear; `probs={}` asks for no more than these.
    Quantiles, min and max need the pairs: a first pass counts cosines in narrow bins, which fixes the bins that hold the wanted ranks; a second
    pass returns the distinct values of those bins only. The arithmetic is quadratic; a task holds two blocks and a tile of
    cosines. Vectors are sent at most BLOCKS times a pass until blocks reach BLOCK_BYTES (2.1 million vectors of 64 numbers), and n / block times beyond.
    """
    probs = dict(QUANTILES if probs is None else probs)
    units = stage(_unit(vectors, vec, centre).select(key, "_u"), "unit-vectors")
    n, mean, std = cosine_moments(units)
    if n < 2:
        raise ValueError("cosines need two vectors")
    if not probs:
        return vectors.sparkSession.createDataFrame([(n * (n - 1), mean, std)], "count long, mean double, std double")
    blocks = math.ceil(n / _block_rows(n, len(units.select("_u").first()[0])))
    paired = _block_pairs(units, key, blocks)
    if blocks > 1:
        paired = paired.repartition(blocks * (blocks + 1) // 2, "lo", "hi")

    def count(group: tuple, part: pa.Table) -> pa.Table:
        hits = np.zeros(4 * FINE, np.int64)
        for cos in _cosines(group, part):
            if len(cos):
                slot = _slots(cos)
                low = slot.min()
                found = np.bincount(slot - low)
                hits[low:low + len(found)] += found
        slot = np.flatnonzero(hits)
        return pa.table({"slot": slot, "n": hits[slot]})

    counts = paired.groupBy("lo", "hi").applyInArrow(count, "slot long, n long")
    table = stage(counts.groupBy("slot").agg(F.sum("n").alias("n")), "cosine-counts")
    total = n * (n - 1) // 2
    ranks = {name: p * (2 * total - 1) for name, p in probs.items()} | {"min": 0.0, "max": 2.0 * total - 1}
    wanted = sorted({int(f(r)) // 2 for r in ranks.values() for f in (math.floor, math.ceil)})
    cum = table.select("slot", "n").withColumn("_end", F.sum("n").over(W.orderBy("slot")))  # at most 2 * FINE rows
    slots = cum.filter(F.size(F.filter(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("n")))) > 0).select(
        "slot", (F.col("_end") - F.col("n")).alias("before")).collect()
    chosen = np.array([r["slot"] for r in slots])

    def fetch(group: tuple, part: pa.Table) -> pa.Table:
        hit = np.zeros(4 * FINE, bool)
        hit[chosen] = True
        kept = [np.zeros((2, 0))]
        for cos in _cosines(group, part):
            kept.append(np.array(np.unique(cos[hit[_slots(cos)]], return_counts=True)))
        v, place = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([k[1] for k in kept]), minlength=len(v))
        return pa.table({"slot": _slots(v), "v": v, "n": n.astype(np.int64)})

    values = paired.groupBy("lo", "hi").applyInArrow(fetch, "slot long, v double, n long").groupBy("slot", "v").agg(F.sum("n").alias("n"))
    place = vectors.sparkSession.createDataFrame([(r["slot"], r["before"]) for r in slots], "slot long, before long")
    inside = F.sum("n").over(W.partitionBy("slot").orderBy("v"))
    ranked = values.join(F.broadcast(place), "slot").withColumn("_end", F.col("before") + inside)
    found = ranked.agg(*[F.max(F.when((F.lit(r) < F.col("_end")) & (F.lit(r) >= F.col("_end") - F.col("n")), F.col("v"))).alias(f"r{r}") for r in wanted]).first()

    def at(rank: float) -> float:
        lo, hi = found[f"r{math.floor(rank) // 2}"], found[f"r{math.ceil(rank) // 2}"]
        return lo + (hi - lo) * (rank - math.floor(rank))

    row = {"count": 2 * total, "mean": mean, "std": std, **{name: at(r) for name, r in ranks.items()}}
    return vectors.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'long' if c == 'count' else 'double'}" for c in row))


def geometry(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Norms and off-diagonal cosines of a vector set in one row."""
    norms = _unit(vectors, vec, False).agg(
        F.count(F.lit(1)).alias("anchor_count"), F.avg("_n").alias("norm_mean"), F.stddev_pop("_n").alias("norm_std"),
        F.min("_n").alias("norm_min"), F.max("_n").alias("norm_max"))
    cos = cosine_summary(vectors, key, vec, probs={"p90": 0.9, "p99": 0.99}).select(
        F.col("mean").alias("cos_mean"), F.col("std").alias("cos_std"), F.col("p90").alias("cos_p90"), F.col("p99").alias("cos_p99"), F.col("max").alias("cos_max"))
    return norms.crossJoin(cos)  # one row each


# Nearest neighbours -----------------------------------------------------------------------------------------

def nearest(queries: DataFrame, points: DataFrame, key: str, vec: str, *, same_set: bool = False, pivots: int = 64, block: int | None = None) -> DataFrame:
    """Exact distance of each query to its nearest point (`same_set`: to its nearest other point).

    Points are cut into cells by nearest pivot. With the pivot distances of a query and the radii of the
    cells, the triangle inequality bounds the answer from above and each cell from below; a query
    visits only cells that can hold it. Large cells, and the visitors of a cell, are split again into parts of `block` rows
    (a quarter of BLOCK_BYTES unless told otherwise), so a query is sent once to each cell that it visits until cells outgrow a block.
    """
    spark = points.sparkSession
    centre = np.array([list(map(float, r[0])) for r in points.orderBy(F.xxhash64(key), key).limit(pivots).select(vec).collect()])
    fields = points.select(key).schema[0].dataType.simpleString()
    block = block or max(BLOCK, BLOCK_BYTES // (32 * max(1, centre.shape[-1])))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.array(part["v"].tolist(), dtype=float)
            gaps = _gaps(x, centre)
            cell = gaps.argmin(axis=1)
            yield pd.DataFrame({"id": part["id"], "v": part["v"], "cell": cell, "r": gaps[np.arange(len(x)), cell]})

    as_rows = lambda df: df.select(F.col(key).alias("id"), F.transform(vec, lambda e: e.cast("double")).alias("v"))
    placed = stage(as_rows(points).mapInPandas(assign, f"id {fields}, v array<double>, cell int, r double"), "cells")
    need = 2 if same_set else 1
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("far"), F.min("r").alias("near")).collect()
    cells = np.array([s["cell"] for s in stats], dtype=int)
    far = np.array([s["far"] for s in stats])
    # Any cell point is within d + far; the nearest one to its pivot within d + near.
    reach = np.array([s["near"] if need == 1 else (s["far"] if s["n"] >= 2 else np.inf) for s in stats])
    splits = np.array([math.ceil(s["n"] / block) for s in stats], dtype=int)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.array(part["v"].tolist(), dtype=float)
            gaps = _gaps(x, centre)[:, cells]
            bound = (gaps + reach).min(axis=1) * (1 + 1e-9) + 1e-12
            q, c = np.nonzero(gaps - far <= bound[:, None])
            yield pd.DataFrame({"id": part["id"], "v": part["v"], "cells": np.split(cells[c], np.cumsum(np.bincount(q, minlength=len(x)))[:-1])})

    split_n = spark.createDataFrame([(int(c), int(k)) for c, k in zip(cells, splits)], "cell int, parts int")
    # Vectors are small beside their visits: the route is worked out again rather than written with a copy of the vector for each cell.
    visits = as_rows(queries).mapInPandas(route, f"id {fields}, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell")).join(
        F.broadcast(split_n), "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")  # a row per cell
    sizes = {int(s["cell"]): int(math.ceil(s["n"] / block)) for s in stats}
    lanes = {(r["cell"], r["sub"]): math.ceil(r["n"] / block) for r in visits.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n")).collect()}
    split_of = spark.createDataFrame([(c, s, lanes.get((c, s), 1)) for c, k in sizes.items() for s in range(k)], "cell int, sub int, lanes int")
    hashed = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    point_rows = placed.join(split_n, "cell").withColumn("sub", hashed(F.col("parts"))).join(split_of, ["cell", "sub"]).withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).select("cell", "sub", "lane", "id", "v", F.lit(False).alias("query"))
    query_rows = visits.join(split_of, ["cell", "sub"]).select("cell", "sub", hashed(F.col("lanes")).alias("lane"), "id", "v", F.lit(True).alias("query"))

    def least(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ask, have = part[part["query"]], part[~part["query"]]
        if not len(ask) or not len(have):
            return pd.DataFrame({"id": ask["id"][:0], "d": []})
        same = (ask["id"].to_numpy(), have["id"].to_numpy()) if same_set else None
        return pd.DataFrame({"id": ask["id"], "d": _least(np.array(ask["v"].tolist()), np.array(have["v"].tolist()), same)})

    found = point_rows.unionByName(query_rows).groupBy("cell", "sub", "lane").applyInPandas(least, f"id {fields}, d double")
    return found.groupBy(F.col("id").alias(key)).agg(F.min("d").alias("distance"))


def _least(a: np.ndarray, b: np.ndarray, ids: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Exact distance of each row of `a` to its nearest row of `b`; with `ids`, rows of one id are not held against each other.

    Products of tiles bound the squared distances within a known rounding error; only pairs within it of the least are computed by differences.
    """
    na, nb = (a * a).sum(1), (b * b).sum(1)
    if not (np.isfinite(na).all() and np.isfinite(nb).all()):
        gaps = _gaps(a, b)
        if ids is not None:
            gaps[ids[0][:, None] == ids[1][None, :]] = np.inf
        return gaps.min(axis=1)
    slack = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (na + nb.max())
    best = np.full(len(a), np.inf)
    own = {}
    if ids is not None:
        for j, x in enumerate(ids[1]):
            own.setdefault(x, []).append(j)
    for i in range(0, len(a), TILE):
        rows = slice(i, min(i + TILE, len(a)))
        mine = [(r, j) for r, x in enumerate(ids[0][rows]) for j in own.get(x, ())] if ids is not None else []
        at = np.array(mine, dtype=np.int64).reshape(-1, 2)
        for j in range(0, len(b), TILE):
            near = nb[None, j:j + TILE] - 2 * (a[rows] @ b[j:j + TILE].T)
            here = at[(at[:, 1] >= j) & (at[:, 1] < j + TILE)]
            near[here[:, 0], here[:, 1] - j] = np.inf
            limit = np.minimum(near.min(axis=1), best[rows] - na[rows]) + slack[rows]
            close = np.flatnonzero((near <= limit[:, None]) & (near < np.inf))
            for k in range(0, len(close), 1 << 16):
                r, c = np.divmod(close[k:k + (1 << 16)], near.shape[1])
                np.minimum.at(best, i + r, ((a[i + r] - b[j + c]) ** 2).sum(axis=1))
    return np.sqrt(best)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences in slices, exact also for near points."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def kl_knn(x: DataFrame, y: DataFrame, key: str, vec: str = "embedding", **options) -> DataFrame:
    """KL(X || Y) from distances to the nearest other point in X and the nearest point in Y."""
    d = len(x.select(vec).first()[0])
    own = nearest(x, x, key, vec, same_set=True, **options).withColumnRenamed("distance", "r")
    other = nearest(x, y, key, vec, **options).withColumnRenamed("distance", "s")
    m = y.count()
    n = F.count(F.lit(1))
    ratio = F.when((F.col("r") > 0) & (F.col("s") > 0), F.log(F.col("r") / F.col("s")))
    return own.join(other, key).agg(n.alias("n"), (-F.sum(ratio) * d / n + F.log(F.lit(float(m)) / (n - 1))).alias("kl_knn"))


# Assignment -------------------------------------------------------------------------------------------------

def assign_unique(centroids: Sequence[Sequence[float]], candidates: DataFrame, key: str, vec: str = "embedding", *, d: int = 64,
                  seed: int = 42, unique: bool = True) -> DataFrame:
    """Assign a candidate to each of K centroids: both sides are projected to d dimensions by seeded
    random matrices and compared by cosine; centroids with the best match choose first.

    Each task keeps the K best candidates of every centroid, so at most K * K rows reach the driver: with K
    centroids, none can lose more than K - 1 of its candidates to others.
    """
    c = np.asarray(centroids, dtype=float)
    k, width = c.shape
    h = len(candidates.select(vec).first()[0])
    rng = np.random.RandomState(seed)
    left = rng.normal(size=(width, d)) / np.sqrt(float(width))
    right = rng.normal(size=(h, d)) / np.sqrt(float(h))
    z = ((c - c.mean(axis=0)) / np.maximum(c.std(axis=0), 1e-9)) @ left
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    kind = candidates.select(key).schema[0].dataType.simpleString()

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            u = np.array(part["v"].tolist(), dtype=float) @ right
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
            cos = z @ u.T
            top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"centroid": np.repeat(np.arange(k), top.shape[1]), "id": part["id"].to_numpy()[top.ravel()],
                                "cosine": np.take_along_axis(cos, top, axis=1).ravel()})

    slim = candidates.select(F.col(key).alias("id"), F.col(vec).alias("v"))
    local = slim.mapInPandas(best, f"centroid int, id {kind}, cosine double")
    rank = F.row_number().over(W.partitionBy("centroid").orderBy(F.desc("cosine"), "id"))
    rows = local.withColumn("_r", rank).filter(F.col("_r") <= k).orderBy("centroid", "_r").collect()
    choices: dict[int, list] = {}
    for r in rows:
        choices.setdefault(r["centroid"], []).append((r["id"], r["cosine"]))
    used, out = set(), []
    for i in sorted(choices, key=lambda j: (-choices[j][0][1], j)):
        free = [x for x in choices[i] if not unique or x[0] not in used]
        if not free:
            raise ValueError("fewer candidates than centroids")
        used.add(free[0][0])
        out.append((i, free[0][0], free[0][1]))
    return candidates.sparkSession.createDataFrame(sorted(out), f"centroid int, {key} {kind}, cosine double")


# Usage of anchors -------------------------------------------------------------------------------------------

def usage_diag(scores: DataFrame, k: int, tau: float = 1.0) -> DataFrame:
    """Diagnostics of a (query, anchor, score) table as long rows (name, stat, value).

    How often anchors come first or among the first k, and per query the softmax entropy, score gaps
    and spreads. A query has one row per anchor, so its window is bounded by the number of anchors.
    """
    scale = max(tau, 1e-6)
    of_query = W.partitionBy("query")
    weight = F.exp((F.col("score") - F.max("score").over(of_query)) / scale)
    ranked = scores.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "anchor"))).withColumn("_e", weight).withColumn(
        "p", F.col("_e") / F.sum("_e").over(of_query)).withColumn("_a", F.count(F.lit(1)).over(of_query))
    at = lambda col, rank: F.max(F.when(F.col("rank") == rank, F.col(col)))
    low = F.max(F.when(F.col("rank") == F.least(F.lit(k + 1), F.col("_a")), F.col("p")))
    per_query = ranked.groupBy("query").agg(
        (-F.sum(F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1e-12))))).alias("entropy_softmax"),
        F.coalesce(at("score", 1) - at("score", 2), F.lit(0.0)).alias("gap_1_2"),
        F.coalesce(at("score", k) - at("score", k + 1), F.lit(0.0)).alias("gap_k_k1"),
        F.sum(F.when(F.col("rank") <= k, F.col("p")).otherwise(0.0)).alias("topk_mass"),
        F.stddev_pop("score").alias("row_std"), (F.max("score") - F.min("score")).alias("row_range"),
        at("p", 1).alias("p_top1"), F.coalesce(at("p", 1) - at("p", 2), F.lit(0.0)).alias("p_margin_12"), (at("p", 1) - low).alias("p_margin_1k"),
    ).withColumn("neff_softmax", F.exp("entropy_softmax"))
    names = ["entropy_softmax", "neff_softmax", "gap_1_2", "gap_k_k1", "topk_mass", "row_std", "row_range", "p_top1", "p_margin_12", "p_margin_1k"]
    long = per_query.select(F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("x")) for x in names])))
    stats = long.groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    stats = stats.join(quantiles(long, ["name"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n"), "name")
    summaries = stats.select("name", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in (
        "mean", "std", "p10", "p50", "p90", "min", "max")])))

    anchors = ranked.groupBy("anchor").agg(F.sum((F.col("rank") == 1).cast("double")).alias("top1"), F.sum((F.col("rank") <= k).cast("double")).alias("topk"))
    totals = anchors.agg(F.sum("top1").alias("_t1"), F.sum("topk").alias("_tk"), F.count(F.lit(1)).cast("double").alias("_a"))
    shares = anchors.crossJoin(F.broadcast(totals)).select(  # one row of totals
        "_a", F.inline(F.array(F.struct(F.lit("top1").alias("name"), (F.col("top1") / F.col("_t1")).alias("p")),
                               F.struct(F.lit("topk").alias("name"), (F.col("topk") / F.col("_tk")).alias("p")))))
    safe = F.greatest(F.col("p"), F.lit(1e-12))
    usage = shares.groupBy("name").agg(
        F.sum((F.col("p") > 0).cast("double")).alias("unique"), F.max("p").alias("max_share"), F.sum(F.col("p") * F.col("p")).alias("hhi"),
        (-F.sum(F.col("p") * F.log(safe))).alias("entropy"), F.exp(-F.sum(F.col("p") * F.log(safe))).alias("neff"),
        F.sum(F.col("p") * F.log(safe * F.col("_a"))).alias("kl_to_uniform"))
    usage_long = usage.select("name", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in (
        "unique", "max_share", "hhi", "entropy", "neff", "kl_to_uniform")])))
    top = F.col("rank") <= k
    overall = ranked.agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"),
                         F.avg(F.when(top, F.col("score"))).alias("align_topk_mean"), F.stddev_pop(F.when(top, F.col("score"))).alias("align_topk_std"))
    overall_long = overall.select(F.lit("all").alias("name"), F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in (
        "score_mean", "score_std", "align_topk_mean", "align_topk_std")])))
    return summaries.unionByName(usage_long).unionByName(overall_long)

