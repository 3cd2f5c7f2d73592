"""Descriptive aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookflow.functions import finite_or_null
from bookflow.operators.ordered import join_key_stats, quantiles


def value_mix(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Count and share (4 places, half-even) of each value."""
    counts = df.groupBy(*by, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, list(by)).select(*by, "value", "n", F.bround(F.col("n") / F.col("_t"), 4).alias("fraction"))


def describe(df: DataFrame, col: str, by: Sequence[str], probs: Mapping[str, float] | None = None) -> DataFrame:
    """n, mean, sample std and exact quantiles (median and p95 unless told otherwise)."""
    probs = probs or {"median": 0.5, "p95": 0.95}
    stats = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    return stats.join(quantiles(df, by, col, probs).drop("n"), list(by), "left")


def moments(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """n, mean, std, and bias-corrected skew and excess kurtosis."""
    raw = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                              F.skewness(col).alias("_g1"), F.kurtosis(col).alias("_g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.col("_g1"))
    kurt = F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return raw.select(*by, "n", "mean", "std", skew.alias("skew"), kurt.alias("kurtosis"))


def hist_pct(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Count and percent of each value."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, list(by)).select(*by, col, "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"))


def token_dist(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Sparse distribution: token, count, probability."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("token_id")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_t"))
    return counts.join(totals, list(by)).select(*by, "token_id", "count", (F.col("count") / F.col("_t")).alias("probability"))


def shared_hist(a: DataFrame, b: DataFrame, col: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Equal-width histogram of two samples over their joint range; the last bin is closed."""
    both = a.select(*by, F.lit(1).alias("_s"), F.col(col).cast("double").alias("_x")).unionByName(
        b.select(*by, F.lit(2).alias("_s"), F.col(col).cast("double").alias("_x")))
    ends = both.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(*by, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    bin_no = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("long")
    counts = join_key_stats(both, ends, by).groupBy(*by, bin_no.alias("bin")).agg(
        F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"),
        F.sum((F.col("_s") == 1).cast("long")).alias("n_a"), F.sum((F.col("_s") == 2).cast("long")).alias("n_b"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counts.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), "n_a", "n_b")


def slot_entropy(tokens: DataFrame, by: Sequence[str], slot: str = "slot", token: str = "token") -> DataFrame:
    """Entropy in nats of the token of each slot."""
    counts = tokens.groupBy(*by, slot, token).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return counts.groupBy(*by, slot).agg((F.log(n) - F.sum(F.col("_n") * F.log("_n")) / n).alias("entropy"))


def slot_l1(tokens: DataFrame, by: Sequence[str], slot: str = "slot", token: str = "token") -> DataFrame:
    """Summed absolute difference of token shares between the kinds (not halved)."""
    kind_n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    counts = tokens.groupBy(*by, slot, token).agg(kind_n("real").alias("_r"), kind_n("generated").alias("_g"))
    totals = counts.groupBy(*by, slot).agg(F.sum("_r").alias("_tr"), F.sum("_g").alias("_tg"))
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n), F.col(t)), F.lit(0.0))
    return counts.join(totals, [*by, slot]).groupBy(*by, slot).agg(
        F.sum(F.abs(share("_r", "_tr") - share("_g", "_tg"))).alias("l1"))


def iqm(df: DataFrame, col: str, by: Sequence[str], prefix: str = "") -> DataFrame:
    """Mean, median, interquartile mean and n of the finite values.

    The interquartile mean averages the values inside [q25, q75], both ends included.
    """
    clean = df.select(*by, finite_or_null(F.col(col)).alias("_x")).filter("_x IS NOT NULL")
    cuts = quantiles(clean, by, "_x", {"_q25": 0.25, "_median": 0.5, "_q75": 0.75})
    inside = F.col("_x").between(F.col("_q25"), F.col("_q75"))
    return join_key_stats(clean, cuts.drop("n"), by).groupBy(*by).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"), F.avg("_x").alias(f"{prefix}mean"), F.max("_median").alias(f"{prefix}median"),
        F.coalesce(F.avg(F.when(inside, F.col("_x"))), F.avg("_x")).alias(f"{prefix}iqm"))


def loss_stats(df: DataFrame, cols: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """n, mean, median and interquartile mean of several columns in one aggregation.

    For tables with one row per metric or slot: a group is a list of losses, never event rows.
    """
    def at(values: Column, p: float) -> Column:
        rank = (F.size(values) - 1) * F.lit(p)
        lo, hi = (F.get(values, f(rank).cast("int")) for f in (F.floor, F.ceil))
        weight = rank - F.floor(rank)
        return lo * (1 - weight) + hi * weight

    lists = df.groupBy(*by).agg(*[F.array_sort(F.collect_list(finite_or_null(F.col(c)))).alias(f"_{p}") for p, c in cols.items()])
    mean = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values).cast("double"))
    out = []
    for p in cols:
        values = F.col(f"_{p}")
        inner = F.filter(values, lambda x: (x >= at(values, 0.25)) & (x <= at(values, 0.75)))
        out += [F.size(values).cast("long").alias(f"{p}n"), mean(values).alias(f"{p}mean"), at(values, 0.5).alias(f"{p}median"),
                F.coalesce(mean(inner), mean(values)).alias(f"{p}iqm")]
    return lists.select(*by, *out)


def direction_eval(df: DataFrame, predicted: str, actual: str, by: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Pearson correlation, sign hits and hit rate; moves within eps of zero count as flat."""
    sign = lambda c: F.when(F.col(c) > eps, 1).when(F.col(c) < -eps, -1).otherwise(0)
    hit = (sign(predicted) == sign(actual)).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(predicted, actual).alias("correlation"),
                               F.sum(hit).alias("hits"), F.avg(hit).alias("hit_rate"))


def token_accuracy(df: DataFrame, predicted: str, true: str, pos: str, warmup: int, by: Sequence[str]) -> DataFrame:
    """Exact-match rate over all rows and over the rows after the first `warmup`."""
    hit = (F.col(predicted) == F.col(true)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.avg(F.when(F.col(pos) >= warmup, hit)).alias("accuracy_after"))


def run_counts(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.max("n_real").alias("n_real"), F.max("n_generated").alias("n_generated"))
