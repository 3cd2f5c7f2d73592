"""Comparison of experiments from tables of per-metric losses.

A metrics table has one row per run and metric: run keys (`stock`, and `variant` or `setting`), `metric`,
`n_real`, `n_generated`, `wasserstein`, `l1_by_group`, `weighted_wasserstein`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bookflow.functions import finite_or_null
from bookflow.operators import aggregates as agg
from bookflow.operators.micro import spread_of
from bookflow.operators.ordered import quantiles

SIX = ("w_mean", "w_median", "w_iqm", "l1_mean", "l1_median", "l1_iqm")
NO_RANK = 10 ** 9

# Columns of a sweep row, as (metric, column of the table).
SWEEP_FIELDS = {
    "spread_l1": ("spread", "l1_by_group"), "spread_w1": ("spread", "wasserstein"),
    "orderbook_imbalance_l1": ("orderbook_imbalance", "l1_by_group"), "orderbook_imbalance_w1": ("orderbook_imbalance", "wasserstein"),
    "ask_volume_touch_l1": ("ask_volume_touch", "l1_by_group"), "ask_volume_touch_w1": ("ask_volume_touch", "wasserstein"),
    "bid_volume_touch_l1": ("bid_volume_touch", "l1_by_group"), "bid_volume_touch_w1": ("bid_volume_touch", "wasserstein"),
    "log_inter_arrival_time_l1": ("log_inter_arrival_time", "l1_by_group"), "log_inter_arrival_time_w1": ("log_inter_arrival_time", "wasserstein"),
    "limit_bid_order_depth_l1": ("limit_bid_order_depth", "l1_by_group"), "limit_bid_order_depth_w1": ("limit_bid_order_depth", "wasserstein"),
    "ofi_up_l1": ("ofi_up", "l1_by_group"), "ofi_down_l1": ("ofi_down", "l1_by_group"),
}


def losses(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finite weighted Wasserstein where there is one, else the plain one; finite L1."""
    w = F.coalesce(finite_or_null(F.col("weighted_wasserstein")), finite_or_null(F.col("wasserstein")))
    return metrics.select(*keys, "metric", w.alias("w"), finite_or_null(F.col("l1_by_group")).alias("l1"))


def six_pack(loss: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean, median and IQM of both losses over the metrics of a run."""
    return agg.loss_stats(loss, {"w_": "w", "l1_": "l1"}, keys)


def _prefixed(table: DataFrame, on: Sequence[str], prefix: str) -> DataFrame:
    return table.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in table.columns if c not in on])


def before_after(before: DataFrame, after: DataFrame, on: Sequence[str] = ("stock",)) -> DataFrame:
    """Six-packs of two runs side by side."""
    return _prefixed(before, on, "before_").join(_prefixed(after, on, "after_"), list(on))


def common_metrics(a: DataFrame, b: DataFrame, on: Sequence[str] = ("stock",)) -> DataFrame:
    """Every metric with the side it has a loss on ('both', 'a', 'b'), per loss."""
    def present(df: DataFrame) -> DataFrame:
        pairs = F.array(F.struct(F.lit("w").alias("loss"), F.col("w").isNotNull().alias("has")),
                        F.struct(F.lit("l1").alias("loss"), F.col("l1").isNotNull().alias("has")))
        return df.select(*on, "metric", F.inline(pairs)).filter("has").drop("has")

    left, right = present(a).withColumn("_a", F.lit(1)), present(b).withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "a").otherwise("b")
    return left.join(right, [*on, "metric", "loss"], "full").select(*on, "metric", "loss", side.alias("side"))


def six_pack_common(a: DataFrame, b: DataFrame, on: Sequence[str] = ("stock",)) -> DataFrame:
    """Six-packs of two variants over the metrics both have a loss for, each loss on its own."""
    joined = a.select(*on, "metric", F.col("w").alias("wa"), F.col("l1").alias("la")).join(
        b.select(*on, "metric", F.col("w").alias("wb"), F.col("l1").alias("lb")), [*on, "metric"])
    both_w, both_l = F.col("wa").isNotNull() & F.col("wb").isNotNull(), F.col("la").isNotNull() & F.col("lb").isNotNull()
    pairs = F.array(*[F.struct(F.lit(v).alias("variant"), F.when(both_w, F.col(w)).alias("w"), F.when(both_l, F.col(l1)).alias("l1"))
                      for v, w, l1 in (("a", "wa", "la"), ("b", "wb", "lb"))])
    return six_pack(joined.select(*on, "metric", F.inline(pairs)), [*on, "variant"])


def best_setting(six: DataFrame, criterion: str = "mean", prior: DataFrame | None = None, on: Sequence[str] = ("stock",)) -> DataFrame:
    """Best setting per stock by one Wasserstein aggregate; ties by the other two, then by name.

    `prior` (keys, prior_setting) adds whether the pick agrees with it.
    """
    order = {"mean": ("w_mean", "w_median", "w_iqm"), "median": ("w_median", "w_mean", "w_iqm"), "iqm": ("w_iqm", "w_mean", "w_median")}[criterion]
    rank = F.row_number().over(W.partitionBy(*on).orderBy(*[F.col(c).asc_nulls_last() for c in order], "setting"))
    best = six.withColumn("_r", rank).filter("_r = 1").select(*on, F.col("setting").alias("best_setting"), "w_mean", "w_median", "w_iqm", "w_n")
    if prior is None:
        return best
    return best.join(prior, list(on), "left").withColumn("same_as_prior", F.col("prior_setting") == F.col("best_setting"))


def rank_sum(six: DataFrame, top: int | None = None, on: Sequence[str] = ("stock",)) -> DataFrame:
    """Settings (the first `top`, or all) by the sum of their ranks over the six numbers; equal values share the lower rank, missing ones count 1e9."""
    ranks = [F.when(F.col(d).isNull(), F.lit(NO_RANK)).otherwise(F.rank().over(W.partitionBy(*on).orderBy(F.col(d).asc_nulls_last()))) for d in SIX]
    total = ranks[0]
    for r in ranks[1:]:
        total = total + r
    place = F.row_number().over(W.partitionBy(*on).orderBy("rank_sum", "setting"))
    placed = six.withColumn("rank_sum", total.cast("long")).withColumn("place", place).select(*on, "setting", "rank_sum", "place", *SIX)
    return placed if top is None else placed.filter(F.col("place") <= top)


def vs_baseline(run: DataFrame, base: DataFrame, on: Sequence[str] = ("stock",)) -> DataFrame:
    """Delta and ratio to a baseline per common metric; no ratio to a baseline of (nearly) 0."""
    value = F.coalesce("wasserstein", "weighted_wasserstein")
    left = run.select(*on, "metric", value.alias("w_run")).filter("w_run IS NOT NULL")
    right = base.select(*on, "metric", value.alias("w_base")).filter("w_base IS NOT NULL")
    ratio = F.when(F.col("w_base") > 1e-12, F.col("w_run") / F.when(F.col("w_base") > 1e-12, F.col("w_base")))
    return left.join(right, [*on, "metric"]).withColumns({"delta": F.col("w_run") - F.col("w_base"), "ratio": ratio})


def pivot_runs(six: DataFrame, variants: Sequence, *, column: str = "variant", value: str = "w_mean", delta: tuple | None = None,
               on: Sequence[str] = ("stock",)) -> DataFrame:
    """One column per variant, and the difference of two of them; a missing run gives NULL."""
    table = six.groupBy(*on).pivot(column, list(variants)).agg(F.max(value))
    table = table.select(*on, *[F.col(f"`{v}`").alias(f"{column}_{v}") for v in variants])
    if delta:
        table = table.withColumn("delta", F.col(f"{column}_{delta[1]}") - F.col(f"{column}_{delta[0]}"))
    return table


def spread_sweep(tapes: DataFrame, reference: DataFrame, on: Sequence[str] = ("stock",), tick: float = 100.0) -> DataFrame:
    """Spread statistics per setting in ticks, gap of the mean to the reference, and the place by smallest gap."""
    gen = tapes.select(*on, "setting", (spread_of() / tick).alias("_s"))
    ref = reference.select(*on, (spread_of() / tick).alias("_s")).groupBy(*on).agg(F.avg("_s").alias("ref_mean"))
    stats = gen.groupBy(*on, "setting").agg(F.count("_s").alias("n"), F.avg("_s").alias("mean"), F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias("std"))
    stats = stats.join(quantiles(gen, [*on, "setting"], "_s", {"median": 0.5, "p95": 0.95}).drop("n"), [*on, "setting"]).join(ref, list(on))
    out = stats.withColumn("mean_gap", F.col("mean") - F.col("ref_mean"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(*on).orderBy(F.abs("mean_gap"), "mean", "setting")))


def spread_histograms(generated: DataFrame, reference: DataFrame, on: Sequence[str] = ("stock",), tick: float = 100.0,
                      least_pct: float | None = None) -> DataFrame:
    """Percent of each spread on both sides and the difference; `least_pct` keeps spreads with that mass on a side."""
    both = generated.select(*on, F.lit(1).alias("_k"), (spread_of() / tick).alias("spread_ticks")).unionByName(
        reference.select(*on, F.lit(2).alias("_k"), (spread_of() / tick).alias("spread_ticks")))
    counts = both.groupBy(*on, "spread_ticks").agg(F.sum((F.col("_k") == 1).cast("long")).alias("count_gen"), F.sum((F.col("_k") == 2).cast("long")).alias("count_ref"))
    totals = counts.groupBy(*on).agg(F.sum("count_gen").alias("_tg"), F.sum("count_ref").alias("_tr"))
    pct = lambda n, t: F.coalesce(F.try_divide(F.col(n) * 100.0, F.col(t)), F.lit(0.0))
    out = counts.join(totals, list(on)).select(*on, "spread_ticks", "count_gen", pct("count_gen", "_tg").alias("pct_gen"), "count_ref",
                                               pct("count_ref", "_tr").alias("pct_ref"))
    out = out.withColumn("delta_pct", F.col("pct_gen") - F.col("pct_ref"))
    return out if least_pct is None else out.filter((F.col("pct_gen") >= least_pct) | (F.col("pct_ref") >= least_pct))


def sweep_row(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chosen fields of a run in one row; a metric the run lacks gives NULL."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return metrics.groupBy(*keys).agg(*[pick(m, c).alias(name) for name, (m, c) in SWEEP_FIELDS.items()])


def latest_run(files: DataFrame, keys: Sequence[str], stamp: Column | str = "modified") -> DataFrame:
    """Latest record per key by file time; equal times take the last path."""
    order = F.struct(F.col(stamp) if isinstance(stamp, str) else stamp, "path")
    return files.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in files.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
