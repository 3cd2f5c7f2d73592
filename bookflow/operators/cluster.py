"""Clustering of window features: scaling, k sweep, quality measures, choice of k, captions.

Feature rows have key columns, `start`, and one column per feature; clusters are in `label`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from bookflow.operators.ordered import join_key_stats, quantiles_of
from bookflow.operators.windows import FEATURES
from bookflow.session import stage


def standardise(df: DataFrame, cols: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """z-scores with the population std per key; a constant column is only centred. Adds `z` (array<double>)."""
    stats = df.groupBy(*by).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in cols])
    scaled = F.array(*[(F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.s") > 0, F.col(f"_{c}.s")).otherwise(F.lit(1.0)) for c in cols])
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row of statistics
    return joined.withColumn("z", scaled).drop(*[f"_{c}" for c in cols])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def centroids(points: DataFrame, dims: int) -> DataFrame:
    """label, n, centre of each cluster."""
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("z")[i]) for i in range(dims)]).alias("centre"))


def _with_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres are written first: a few clusters are broadcast, very many labels are joined by a shuffle."""
    return join_key_stats(points, centres.select("label", "centre"), ["label"]).withColumn("_d", distance(F.col("z"), F.col("centre")))


def cluster_balance(points: DataFrame, k: int) -> DataFrame:
    """Smallest and largest share, non-empty clusters, exp(entropy) over k clusters, empty ones included."""
    counts = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("_t")
    return counts.withColumn("_t", F.sum("n").over(W.partitionBy())).agg(
        F.when(F.count(F.lit(1)) < k, F.lit(0.0)).otherwise(F.min(share)).alias("min_cluster_frac"), F.max(share).alias("max_cluster_frac"),
        F.count(F.lit(1)).alias("n_nonempty_clusters"),
        F.exp(-F.sum(share * F.log(share + 1e-15))).alias("effective_clusters"))


def _pair_distances(centres: DataFrame) -> DataFrame:
    """All centre distances i < j, formed inside one row of k centres."""
    rest = lambda i: F.slice(F.col("_all"), i + 2, F.greatest(F.size("_all") - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform("_all", lambda a, i: F.transform(rest(i), lambda b: F.struct(
        a["label"].alias("i"), b["label"].alias("j"), distance(a["centre"], b["centre"]).alias("d")))))
    return centres.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("_all")).select(F.inline(pairs))


def centroid_metrics(points: DataFrame, dims: int, centres: DataFrame | None = None) -> DataFrame:
    """Mean distance to the own centre, its spread over clusters, centre distances, and the ratio.

    Without `centres` the means of the labelled points are used.
    """
    centres = centroids(points, dims) if centres is None else centres
    per = _with_centre(points, centres).groupBy("label").agg(F.sum("_d").alias("_s"), F.count(F.lit(1)).alias("_n"))
    intra = per.agg((F.sum("_s") / F.sum("_n")).alias("intra_mean"), F.stddev_pop(F.col("_s") / F.col("_n")).alias("intra_std"))
    inter = _pair_distances(centres).agg(
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("inter_mean"), F.coalesce(F.min("d"), F.lit(0.0)).alias("inter_min"),
        F.coalesce(F.max("d"), F.lit(0.0)).alias("inter_max"))
    return intra.crossJoin(inter).withColumn(  # one row each
        "intra_over_inter", F.when(F.col("inter_mean") > 1e-15, F.col("intra_mean") / F.col("inter_mean")))


def cluster_sums(points: DataFrame, cents: DataFrame) -> DataFrame:
    """Per cluster: rows, summed distance and summed squared distance to its mean."""
    return _with_centre(points, cents).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_d").alias("sum_d"), F.sum(F.col("_d") * F.col("_d")).alias("sum_d2"))


def ch_index(points: DataFrame, dims: int, cents: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Calinski-Harabasz score, with n and k. The overall mean is the weighted mean of the cluster means."""
    cents = centroids(points, dims) if cents is None else cents
    sums = cluster_sums(points, cents) if sums is None else sums
    rows = cents.join(sums.select("label", "sum_d2"), "label")  # k rows
    one = rows.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("sum_d2").alias("_w"), F.collect_list(F.struct("n", "centre")).alias("_all"),
                   F.array(*[F.sum(F.col("n") * F.col("centre")[i]) / F.sum("n") for i in range(dims)]).alias("_m"))
    between = F.aggregate("_all", F.lit(0.0), lambda acc, c: acc + c["n"] * F.pow(distance(c["centre"], F.col("_m")), 2))
    score = F.when(F.col("_w") == 0, F.lit(1.0)).otherwise(between * (F.col("n") - F.col("k")) / (F.col("_w") * (F.col("k") - 1)))
    return one.select("n", "k", score.alias("calinski_harabasz"))


def db_index(points: DataFrame, dims: int, cents: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Davies-Bouldin score."""
    cents = centroids(points, dims) if cents is None else cents
    sums = cluster_sums(points, cents) if sums is None else sums
    spread = sums.select("label", (F.col("sum_d") / F.col("n")).alias("s"))
    rows = cents.join(spread, "label").agg(F.array_sort(F.collect_list(F.struct("label", "centre", "s"))).alias("_all"))  # k rows
    worst = F.transform("_all", lambda a: F.array_max(F.transform(F.filter("_all", lambda b: b["label"] != a["label"]), lambda b: F.coalesce(
        F.try_divide(a["s"] + b["s"], distance(a["centre"], b["centre"])), F.lit(0.0)))))
    return rows.select((F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v) / F.size("_all")).alias("davies_bouldin"))


def silhouette_squared(points: DataFrame, dims: int) -> DataFrame:
    """Mean silhouette over all points, with squared Euclidean distances; NULL for fewer than two clusters. Also n.

    The mean squared distance of a point to a cluster follows from the cluster's n, mean and mean squared norm, so one row of k
    clusters meets every point and no pair is formed. A point alone in its cluster counts 0.
    """
    norm = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + v * v)
    each = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"), F.array(*[F.avg(F.col("z")[i]) for i in range(dims)]).alias("m"))
    one = each.agg(F.collect_list(F.struct("label", "n", "q", "m")).alias("_all"))
    dot = lambda c: F.aggregate(F.zip_with("z", c["m"], lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    far = F.transform("_all", lambda c: F.struct(c["label"].alias("label"), c["n"].alias("n"), F.greatest(F.lit(0.0), norm - 2 * dot(c) + c["q"]).alias("d")))
    rows = points.crossJoin(F.broadcast(one)).select("label", far.alias("_far"))  # one row of k clusters
    own = F.filter("_far", lambda c: c["label"] == F.col("label"))[0]
    other = F.array_min(F.transform(F.filter("_far", lambda c: c["label"] != F.col("label")), lambda c: c["d"]))
    sized = rows.select(own["n"].alias("n"), F.try_divide(own["d"] * own["n"], own["n"] - 1).alias("a"), other.alias("b"))
    score = F.when(F.col("n") == 1, F.when(F.col("b").isNotNull(), 0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.when(F.col("b").isNotNull(), 0.0)))
    return sized.agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def spread_starts(points: DataFrame, cols: Sequence[str], most: int, seed: int, key: Sequence[str], rows: int = 20_000) -> np.ndarray:
    """`most` starting centres by k-means++ on `rows` points, those of smallest hash; its first k are a start for k clusters."""
    some = points.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(rows).select(*cols).toPandas().to_numpy(float)
    rng = np.random.RandomState(seed)
    picked = [some[rng.randint(len(some))]]
    gap = ((some - picked[0]) ** 2).sum(1)
    while len(picked) < most:
        total = gap.sum()
        picked.append(some[rng.choice(len(some), p=gap / total)] if total > 0 else some[rng.randint(len(some))])
        gap = np.minimum(gap, ((some - picked[-1]) ** 2).sum(1))
    return np.array(picked)


def _scan(points: DataFrame, cols: Sequence[str], centres: Mapping[int, np.ndarray], measure: Callable[[np.ndarray, np.ndarray, int, np.ndarray], dict[str, np.ndarray]],
          names: Sequence[str]) -> dict[int, dict[str, np.ndarray]]:
    """One pass over the points for all k: per cluster its size and sums of what `measure(x, squared distances, k, labels)` gives for each point.

    Tasks add up their points, Spark adds up the tasks; one row per cluster of each k reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(c), 1 + len(names))) for k, c in centres.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).to_numpy() for c in cols])
            norm = (x * x).sum(1)[:, None]
            for k, c in centres.items():
                gap = np.maximum(norm - 2 * x @ c.T + (c * c).sum(1), 0)
                label = gap.argmin(1)
                total[k][:, 0] += np.bincount(label, minlength=len(c))
                for i, v in enumerate(measure(x, gap, k, label)):
                    total[k][:, i + 1] += np.bincount(label, v, minlength=len(c))
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), k)), pa.array(np.arange(len(t))), *map(pa.array, t.T)], ["k", "label", "n", *names])

    parts = points.select(*cols).mapInArrow(run, ", ".join(["k long", "label long", "n double", *[f"{c} double" for c in names]]))
    out = {k: {c: np.zeros(len(v)) for c in ("n", *names)} for k, v in centres.items()}
    for r in parts.groupBy("k", "label").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        for c in ("n", *names):
            out[r["k"]][c][r["label"]] = r[c]
    return out


def lloyd(points: DataFrame, cols: Sequence[str], starts: Mapping[int, np.ndarray], steps: int, tol: float = 1e-4) -> dict[int, np.ndarray]:
    """Centres for every k after at most `steps` steps of k-means, all k in one pass a step; a centre without points stays."""
    centres, active = {k: np.array(c, float) for k, c in starts.items()}, set(starts)
    names = [f"s{i}" for i in range(len(cols))]
    for _ in range(steps):
        sums = _scan(points, cols, {k: centres[k] for k in active}, lambda x, gap, k, label: x.T, names)
        for k, s in sums.items():
            filled = s["n"] > 0
            new = centres[k].copy()
            new[filled] = np.column_stack([s[c] for c in names])[filled] / s["n"][filled][:, None]
            if ((new - centres[k]) ** 2).sum(1).max() <= tol * tol:
                active.discard(k)
            centres[k] = new
        if not active:
            break
    return centres


def kmeans_sweep(features: DataFrame, ks: Sequence[int], seed: int = 42, cols: Sequence[str] = FEATURES,
                 key: Sequence[str] = ("start",), *, starts: Mapping[int, Sequence[Sequence[float]]] | None = None, steps: int = 20) -> DataFrame:
    """One row of quality measures per k on standardised features.

    All k advance together, one pass over the points a step, and two passes give every measure: the first the clusters' means and the distances to
    the centres, the second the distances to the means and the silhouette (squared distances, see `silhouette_squared`). `starts` gives the starting
    centres, in standardised units; else they are drawn by k-means++ from a bounded sample.
    """
    z = standardise(features, cols)
    names = [f"z{i}" for i in range(len(cols))]
    points = stage(z.select(*key, *[F.col("z")[i].alias(c) for i, c in enumerate(names)]), "scaled-features")
    n = points.count()
    ks = [k for k in ks if 2 <= k <= n - 1]
    if not ks:
        return sweep_table(points.sparkSession, [])
    if starts is None:
        spread = spread_starts(points, names, max(ks), seed, key)
        starts = {k: spread[:k] for k in ks}
    centres = lloyd(points, names, {k: np.array(starts[k], float) for k in ks}, steps)
    sums = [f"s{i}" for i in range(len(names))]
    first = _scan(points, names, centres, lambda x, gap, k, label: [*x.T, (x * x).sum(1), gap.min(1), np.sqrt(gap.min(1))], [*sums, "norm", "cost", "far"])
    means, sizes, norms = {}, {}, {}
    for k, f in first.items():
        size = np.maximum(f["n"], 1)
        means[k], sizes[k], norms[k] = np.column_stack([f[c] for c in sums]) / size[:, None], f["n"], f["norm"] / size

    def about_means(x: np.ndarray, gap: np.ndarray, k: int, label: np.ndarray) -> list[np.ndarray]:
        m, size, at = means[k], sizes[k], np.arange(len(x))
        near = np.maximum((x * x).sum(1)[:, None] - 2 * x @ m.T + norms[k], 0)  # mean squared distance to each cluster
        near[:, size == 0] = np.inf
        own = near[at, label].copy()
        near[at, label] = np.inf
        other = near.min(1)
        mine = size[label]
        a = own * mine / np.maximum(mine - 1, 1)
        most = np.maximum(a, other)
        score = np.where((mine > 1) & (most > 0) & np.isfinite(other), (np.where(np.isfinite(other), other, 0) - a) / np.where(most > 0, most, 1), 0.0)
        square = ((x - m[label]) ** 2).sum(1)
        return [np.sqrt(square), square, score]

    second = _scan(points, names, centres, about_means, ["sum_d", "sum_d2", "score"])
    rows = [{"k": k, "n_samples": n, **_measures(first[k], second[k], means[k], centres[k])} for k in ks]
    return sweep_table(points.sparkSession, rows)


def _measures(first: Mapping[str, np.ndarray], second: Mapping[str, np.ndarray], means: np.ndarray, centres: np.ndarray) -> dict[str, float | None]:
    """The measures of one k from the sums of its clusters."""
    has = first["n"] > 0
    size, m, total = first["n"][has], means[has], first["n"].sum()
    apart = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    spread, within = second["sum_d"][has] / size, second["sum_d2"][has].sum()
    middle = (size[:, None] * m).sum(0) / total
    between = (size * ((m - middle) ** 2).sum(1)).sum()
    k = len(size)
    both = spread[:, None] + spread[None]
    worst = np.where(apart > 0, both / np.where(apart > 0, apart, 1), 0.0)
    share = size / total
    intra = first["far"][has] / size
    pairs = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(len(centres), 1)]
    inter = float(pairs.mean()) if len(pairs) else 0.0
    return {
        "inertia": float(first["cost"].sum()), "silhouette": float(second["score"].sum() / total) if k > 1 else None,
        "calinski_harabasz": (1.0 if within == 0 else float(between * (total - k) / (within * (k - 1)))) if k > 1 else None,
        "davies_bouldin": float(worst.max(1).mean()), "min_cluster_frac": float(share.min()) if has.all() else 0.0, "max_cluster_frac": float(share.max()),
        "n_nonempty_clusters": k, "effective_clusters": float(np.exp(-(share * np.log(share + 1e-15)).sum())),
        "intra_mean": float(first["far"].sum() / total), "intra_std": float(intra.std()), "inter_mean": inter,
        "inter_min": float(pairs.min()) if len(pairs) else 0.0, "inter_max": float(pairs.max()) if len(pairs) else 0.0,
        "intra_over_inter": float(first["far"].sum() / total / inter) if inter > 1e-15 else None}


SWEEP_SCHEMA = ("k long, inertia double, n_samples long, silhouette double, calinski_harabasz double, davies_bouldin double, min_cluster_frac double, "
                "max_cluster_frac double, n_nonempty_clusters long, effective_clusters double, intra_mean double, intra_std double, "
                "inter_mean double, inter_min double, inter_max double, intra_over_inter double")


def sweep_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    names = [part.split()[0] for part in SWEEP_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SWEEP_SCHEMA)


def recommend_k(sweep: DataFrame, by: Sequence[str] = (), *, min_frac: float = 0.01, min_points: int = 80, eps: float = 0.02) -> DataFrame:
    """Best silhouette (squared distances) among the feasible k (all of them if none is feasible), and the plateau k.

    The plateau is the last k, going up, before the first one more than eps below the best.
    """
    known = sweep.filter("silhouette IS NOT NULL")
    ok = (F.col("min_cluster_frac") >= min_frac) & (F.col("min_cluster_frac") * F.col("n_samples") >= min_points)
    group = W.partitionBy(*by)
    pool = known.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(group)).filter(F.col("_ok") | ~F.col("_any"))
    best = F.max("silhouette").over(group)
    near = pool.withColumn("_near", F.col("silhouette") >= best - eps)
    run = F.min("_near").over(W.partitionBy(*by).orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return near.withColumn("_run", run).groupBy(*by).agg(
        F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("recommended_k"), F.max("silhouette").alias("recommended_silhouette"),
        F.max(F.when(F.col("_run"), F.col("k"))).alias("plateau_k"), F.array_join(F.array_sort(F.collect_list("k")).cast("array<string>"), ",").alias("feasible_ks"))


# Wording of the captions.
BUCKETS = {
    "pm_abs_mean": ("very tight", "tight", "medium", "wide", "very wide"),
    "log_interval_mean": ("very fast", "fast", "normal", "slow", "very slow"),
    "log_qty_mean": ("very small", "small", "medium", "large", "very large"),
    "frac_side_99": ("very low cancels", "low cancels", "normal cancels", "high cancels", "very high cancels"),
    "frac_side_129": ("very low executions", "low executions", "normal executions", "high executions", "very high executions"),
    "mid_return": ("down", "slightly down", "flat", "slightly up", "up"),
}
TRAITS = {
    "pm_mean": ("off-mid bias", "near-mid bias"), "pm_std": ("volatile quotes", "stable quotes"),
    "frac_side_49": ("more side49", "less side49"), "frac_side_50": ("more side50", "less side50"),
    "frac_side_130": ("more side130", "less side130"),
}
SESSIONS = ((10.0, "open/morning"), (12.0, "late morning"), (14.0, "early afternoon"))
LAST_SESSION = "late afternoon"
LINE = "%s quotes, %s tempo, %s size, %s, %s, drift=%s, session=%s. Traits: %s. sig=%s"
SIGNATURE = "spr:%s|tmp:%s|sz:%s|cxl:%s|exe:%s|dr:%s|sess:%s"


def captions(features: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """One text line per cluster from its feature means, the quintiles of all windows and its largest z-deltas."""
    keys = list(by) or ["_one"]
    rows = features if by else features.withColumn("_one", F.lit(1))
    scale = rows.groupBy(*keys).agg(*[F.struct(F.avg(f).alias("m"), (F.stddev_pop(f) + 1e-12).alias("s")).alias(f"_z_{f}") for f in TRAITS])
    scale = scale.join(quantiles_of(rows, keys, list(BUCKETS), {f"_{i}": i / 5 for i in range(1, 5)}), keys)
    means = rows.groupBy(*keys, "label").agg(*[F.avg(f).alias(f) for f in FEATURES])
    spine = scale.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = spine.join(means, [*keys, "label"], "left")

    def bucket(f: str) -> Column:
        out = F.lit(BUCKETS[f][4])
        for i in range(4, 0, -1):
            out = F.when(F.col(f) <= F.col(f"_{i}_{f}"), BUCKETS[f][i - 1]).otherwise(out)
        return out

    session = F.lit(LAST_SESSION)
    for limit, name in reversed(SESSIONS):
        session = F.when(F.col("tod_hour") < limit, name).otherwise(session)
    z = lambda f: (F.col(f) - F.col(f"_z_{f}.m")) / F.col(f"_z_{f}.s")
    deltas = F.array_sort(F.array(*[F.struct((-F.abs(z(f))).alias("size"), F.lit(i).alias("i"), F.when(
        z(f) > 0, high).otherwise(low).alias("phrase")) for i, (f, (high, low)) in enumerate(TRAITS.items())]))
    traits = F.array_join(F.transform(F.slice(deltas, 1, 3), lambda d: d["phrase"]), ", ")
    words = [*[bucket(f) for f in BUCKETS], session]
    signature = F.format_string(SIGNATURE, *words)
    line = F.when(F.col("pm_mean").isNull(), F.format_string("(empty cluster %d)", F.col("label"))).otherwise(
        F.format_string(LINE, *words, traits, signature))
    return full.select(*by, "label", line.alias("caption"))
