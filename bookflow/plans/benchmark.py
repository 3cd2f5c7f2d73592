"""The 24-metric comparison of a generated tape with the real one, and the summary of a single tape."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bookflow.functions import div, edge_group, is_finite, literal_edges
from bookflow.operators import aggregates as agg, distances as dist, micro
from bookflow.operators.ordered import chunk_of, dense_index, over_neighbours, quantiles, running
from bookflow.session import stage

# Metric names of the comparison, and which of them are compared value by value.
UNCONDITIONAL = (
    "spread", "orderbook_imbalance", "log_inter_arrival_time", "log_time_to_cancel", "ask_volume_touch",
    "bid_volume_touch", "ask_volume", "bid_volume", "limit_ask_order_depth", "limit_bid_order_depth",
    "ask_cancellation_depth", "bid_cancellation_depth", "limit_ask_order_levels", "limit_bid_order_levels",
    "ask_cancellation_levels", "bid_cancellation_levels", "vol_per_min", "ofi", "ofi_up", "ofi_stay", "ofi_down",
)
CONDITIONAL = ("ask_volume | spread", "spread | time", "spread | volatility")
DISCRETE = ("spread", "limit_ask_order_levels", "limit_bid_order_levels", "ask_cancellation_levels", "bid_cancellation_levels")
EMPTY_SAMPLE = "empty real or generated sample after cleaning"
ZERO_GAP = 1e-9
DAY_EDGES = [86400.0 / 23 * i for i in range(23)] + [86400.0]
VOLATILITY_NS = 100_000_000
FIRST_DAY, DAY_CODE = "first day", 100

MetricFn = Callable[[DataFrame], DataFrame]
_user_metrics: dict[str, tuple[MetricFn, bool]] = {}


def register_metric(name: str, fn: MetricFn, discrete: bool = False) -> None:
    """Add a scoring function: tape -> rows with the tape's keys and a `score`."""
    _user_metrics[name] = (fn, discrete)


def unregister_metric(name: str) -> None:
    _user_metrics.pop(name, None)


def registered_metrics() -> dict[str, tuple[MetricFn, bool]]:
    return dict(_user_metrics)


def _log_gap(value: Column) -> Column:
    return F.log(F.when(value == 0, F.lit(ZERO_GAP)).otherwise(value))


def row_scores(tape: DataFrame, by: Sequence[str], n_ofi: int = 100, levels: int = 10) -> DataFrame:
    """All metrics that need a row and its neighbours, as (metric, score, given), from one shuffle."""
    prices = lambda field: F.col("levels")[field]
    rows = tape.select(
        *by, "row_seq", "t_ns", "event_type", "price",
        micro.touch("ask_p").alias("_ap"), micro.touch("ask_v").alias("_av"),
        micro.touch("bid_p").alias("_bp"), micro.touch("bid_v").alias("_bv"),
        micro.depth_sum("ask_v", levels).alias("_ask10"), micro.depth_sum("bid_v", levels).alias("_bid10"),
        prices("ask_p").alias("_asks"), prices("bid_p").alias("_bids"))
    mid2 = F.col("_ap") + F.col("_bp")

    def neighbours(w):
        return {
            "_gap": (F.col("t_ns") - F.lag("t_ns").over(w)) / 1e6,
            "_asks0": F.lag("_asks").over(w), "_bids0": F.lag("_bids").over(w),
            "_move": F.signum((F.lead(mid2).over(w) - mid2).cast("double")),
        }

    seen = over_neighbours(rows, by, *micro.ofi_columns(n_ofi), neighbours, before=n_ofi, after=1)
    is_new, is_cancel = F.col("event_type") == 1, F.col("event_type").isin(2, 3)
    spread, away = F.col("_ap") - F.col("_bp"), F.col("price") - mid2 / 2
    level = lambda levels_col: F.nullif(F.array_position(levels_col, F.col("price")), F.lit(0))
    ofi = F.when(F.col("row_seq") >= n_ofi, F.col("ofi"))
    day_ns = F.lit(86_400 * micro.NS)
    day, seconds = div(F.col("t_ns"), day_ns), F.pmod(F.col("t_ns"), day_ns) / 1e9
    scores: list[tuple[str, Column, Column | None]] = [
        ("spread", spread, None),
        ("orderbook_imbalance", F.try_divide((F.col("_bv") - F.col("_av")).cast("double"), (F.col("_bv") + F.col("_av")).cast("double")), None),
        ("log_inter_arrival_time", _log_gap(F.col("_gap")), None),
        ("ask_volume_touch", F.col("_av"), None), ("bid_volume_touch", F.col("_bv"), None),
        ("ask_volume", F.col("_ask10"), None), ("bid_volume", F.col("_bid10"), None),
        ("limit_ask_order_depth", F.when(is_new & (away > 0), away), None),
        ("limit_bid_order_depth", F.when(is_new & (away < 0), -away), None),
        ("ask_cancellation_depth", F.when(is_cancel & (away > 0), away), None),
        ("bid_cancellation_depth", F.when(is_cancel & (away < 0), -away), None),
        ("limit_ask_order_levels", F.when(is_new, level("_asks")), None),
        ("limit_bid_order_levels", F.when(is_new, level("_bids")), None),
        ("ask_cancellation_levels", F.when(is_cancel, level("_asks0")), None),
        ("bid_cancellation_levels", F.when(is_cancel, level("_bids0")), None),
        ("ofi", ofi, None),
        *[(name, F.when(F.col("_move") == sign, ofi), None) for name, sign in (("ofi_up", 1), ("ofi_stay", 0), ("ofi_down", -1))],
        ("ask_volume | spread", F.col("_av"), spread.cast("double")),
        # the day of the key's first row is not known here: hours of the own day, and the day (see `hour_group`)
        ("spread | time", spread, (day * DAY_CODE + edge_group(seconds, literal_edges(DAY_EDGES))).cast("double")),
        (FIRST_DAY, F.when(F.col("row_seq") == 0, day), None),
    ]
    null = F.lit(None).cast("double")
    stacked = F.array(*[F.struct(F.lit(m).alias("metric"), s.cast("double").alias("score"),
                                 (null if g is None else g).alias("given")) for m, s, g in scores])
    return seen.select(*by, F.inline(F.filter(stacked, lambda x: x["score"].isNotNull())))


def hour_group(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """`given` of the time metric as the number of hour edges, counted from midnight before the key's first row, that are not after the row."""
    first = scores.filter(F.col("metric") == FIRST_DAY).select(*by, F.col("score").alias("_first"))
    day = F.floor(F.col("given") / DAY_CODE)
    group = F.when(day > F.col("_first"), len(DAY_EDGES)).when(day < F.col("_first"), 0).otherwise(F.col("given") - day * DAY_CODE)
    return scores.join(first, list(by), "left").withColumn("given", F.when(F.col("metric") == "spread | time", group.cast("double")).otherwise(F.col("given"))).drop("_first")


def metric_scores(tape: DataFrame, by: Sequence[str], n_ofi: int = 100) -> DataFrame:
    """Long counts of distinct scores: by, metric, score, given, n. Reduced before anything is shuffled for a distance."""
    null = F.lit(None).cast("double")
    seconds = F.col("delta_ns") / 1e9
    cancel = micro.time_to_cancel(tape, by).select(
        *by, F.lit("log_time_to_cancel").alias("metric"), _log_gap(seconds).alias("score"), null.alias("given"))
    volume = micro.volume_per_minute(tape, by).select(
        *by, F.lit("vol_per_min").alias("metric"), F.col("volume_per_minute").alias("score"), null.alias("given"))
    spreads = tape.groupBy(*by, micro.spread_of().cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    by_vol = spreads.join(micro.volatility(tape, VOLATILITY_NS, by), list(by)).select(
        *by, F.lit("spread | volatility").alias("metric"), "score", F.col("volatility").alias("given"), "n")
    parts = row_scores(tape, by, n_ofi).unionByName(cancel).unionByName(volume)
    for name, (fn, _) in _user_metrics.items():
        parts = parts.unionByName(fn(tape).select(
            *by, F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"), null.alias("given")))
    counts = parts.filter(is_finite(F.col("score"))).groupBy(*by, "metric", "score", "given").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(by_vol)


def benchmark(tape: DataFrame, by: Sequence[str] = ("run_id",), n_ofi: int = 100) -> DataFrame:
    """One row per key and metric: sizes, distances, and `status` / `reason` where a metric has no result."""
    keys = [*by, "kind"]
    scores = stage(metric_scores(tape, keys, n_ofi), "metric-scores")
    by_metric = [*by, "metric"]
    plain = scores.filter(F.col("metric").isin(*UNCONDITIONAL, *_user_metrics)).drop("given")
    own_value = F.col("metric").isin(*DISCRETE, *[n for n, (_, d) in _user_metrics.items() if d])
    uncond = dist.compare(plain, by_metric, discrete=own_value, weight="n")
    known = hour_group(scores.filter(F.col("metric").isin(*CONDITIONAL, FIRST_DAY)), keys).filter(F.col("metric") != FIRST_DAY)
    grouped = known.filter(is_finite(F.col("given"))).withColumnRenamed("given", "grp")
    cond = dist.weighted_wasserstein(dist.wasserstein(grouped, [*by_metric, "grp"], weight="n"), by_metric)
    results = uncond.unionByName(cond, allowMissingColumns=True)
    names = F.array(*[F.lit(m) for m in (*UNCONDITIONAL, *CONDITIONAL, *_user_metrics)])
    spine = scores.select(*by).distinct().withColumn("metric", F.explode(names))
    ok = (F.coalesce("n_real", F.lit(0)) > 0) & (F.coalesce("n_generated", F.lit(0)) > 0)
    out = spine.join(results, by_metric, "left")
    keep = lambda c: F.when(ok, F.col(c)).alias(c)
    return out.select(
        *by, "metric", *[keep(c) for c in ("n_real", "n_generated", "wasserstein", "l1_by_group",
                                            "weighted_wasserstein", "num_condition_groups")],
        F.when(ok, "ok").otherwise("failed").alias("status"), F.when(~ok, F.lit(EMPTY_SAMPLE)).alias("reason"))


def message_measures(tape: DataFrame, by: Sequence[str], n_ofi: int) -> DataFrame:
    """One narrow row per message with what the summary of a tape needs, from one scan: written once, read by every part of the summary."""
    touches = {"_ap": "ask_p", "_av": "ask_v", "_bp": "bid_p", "_bv": "bid_v"}
    arrival = F.when(~F.col("event_type").isin(4, 5), F.col("t_ns"))
    slim = tape.select(*by, "row_seq", "t_ns", "event_type", "direction", "size", *[micro.touch(f).alias(c) for c, f in touches.items()],
                       micro.depth_sum("ask_v", 5).alias("ask5"), micro.depth_sum("bid_v", 5).alias("bid5"), micro.imbalance_of().alias("imb"), arrival.alias("_a"))
    seen = running(slim, by, ["row_seq"], chunk_of("row_seq"), befores={"_last": F.col("_a")})
    rows = over_neighbours(seen, by, *micro.ofi_columns(n_ofi), before=n_ofi)
    gap, spread = (F.col("_a") - F.col("_last")) / 1e6, F.col("_ap") - F.col("_bp")
    return stage(rows.select(
        *by, "row_seq", "t_ns", "event_type", "direction", "size", ((F.col("_ap") + F.col("_bp")) / 2).alias("mid"), spread.alias("_s"), F.when(spread > 0, spread / 100.0).alias("ticks"),
        F.col("_av").alias("ask"), F.col("_bv").alias("bid"), "ask5", "bid5", "imb", F.when(gap >= 0, gap).alias("gap"), F.when(F.col("row_seq") >= n_ofi, F.col("ofi")).alias("ofi")), "messages")


def stream_summary(tape: DataFrame, by: Sequence[str] = ("run_id", "kind"), minute_ns: int = 60 * micro.NS,
                   n_ofi: int = 100) -> DataFrame:
    """Measures of one tape as long rows (by, section, stat, value)."""
    top = list(by)
    rows = message_measures(tape, top, n_ofi)
    fact = lambda section, stat, col: F.struct(F.lit(section).alias("section"), F.lit(stat).alias("stat"), F.col(col).cast("double").alias("value"))
    melt = lambda df, facts: df.select(*top, F.inline(F.array(*[fact(*f) for f in facts])))

    # counts of both codes from one aggregation
    codes = rows.groupBy(*top, "event_type", "direction").agg(F.count(F.lit(1)).alias("n")).select(*top, "n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("section"), F.col(c).cast("long").alias("value")) for c in ("event_type", "direction")]))).groupBy(*top, "section", "value").agg(F.sum("n").alias("n"))
    share = F.bround(F.col("n") / F.sum("n").over(W.partitionBy(*top, "section")), 4)
    mixes = codes.withColumn("share", share).select(*top, "section", F.inline(F.array(*[
        F.struct(F.concat(F.lit(p), F.col("value").cast("string")).alias("stat"), F.col(c).cast("double").alias("value")) for p, c in (("count_", "n"), ("fraction_", "share"))])))

    # one aggregation for all plain statistics, one histogram for all quantiles
    first, last = F.min_by("mid", "row_seq"), F.max_by("mid", "row_seq")
    facts = rows.groupBy(*top).agg(
        first.alias("start_mid"), last.alias("end_mid"), F.avg("mid").alias("mean_mid"), F.stddev_samp("mid").alias("std_mid"), ((last / first - 1) * 10_000).alias("return_bps"),
        F.count("ticks").alias("spread_n"), F.avg("ticks").alias("spread_mean"), F.stddev_samp("ticks").alias("spread_std"),
        F.avg((F.col("_s") <= 0).cast("double")).alias("spread_share"), F.avg("ask").alias("ask_mean"), F.avg("bid").alias("bid_mean"),
        F.avg("ask5").alias("ask5_mean"), F.avg("bid5").alias("bid5_mean"), F.avg("imb").alias("imb_mean"), F.stddev_samp("imb").alias("imb_std"),
        F.count("gap").alias("gap_n"), F.sum(F.col("event_type").isin(4, 5).cast("long")).alias("n_exec_excluded"), F.avg("gap").alias("gap_mean"), F.stddev_samp("gap").alias("gap_std"),
        F.count("ofi").alias("ofi_n"), F.avg("ofi").alias("ofi_mean"), F.stddev_samp("ofi").alias("ofi_std"))
    plain = facts.select(*top, "gap_n", "ofi_n", F.inline(F.array(*[fact(*f) for f in [
        *[("mid_price", c, c) for c in ("start_mid", "end_mid", "mean_mid", "std_mid", "return_bps")],
        ("spread_ticks", "n", "spread_n"), ("spread_ticks", "mean", "spread_mean"), ("spread_ticks", "std", "spread_std"), ("spread_ticks", "share_not_positive", "spread_share"),
        ("l1_volume", "ask_mean", "ask_mean"), ("l1_volume", "bid_mean", "bid_mean"), ("total_volume_5", "ask5_mean", "ask5_mean"), ("total_volume_5", "bid5_mean", "bid5_mean"),
        ("ob_imbalance", "mean", "imb_mean"), ("ob_imbalance", "std", "imb_std"), ("iat_ms", "n", "gap_n"), ("iat_ms", "n_exec_excluded", "n_exec_excluded"), ("iat_ms", "mean", "gap_mean"),
        ("iat_ms", "std", "gap_std"), ("orderflow_imbalance", "mean", "ofi_mean"), ("orderflow_imbalance", "std", "ofi_std"), ("orderflow_imbalance", "n", "ofi_n"),
        ("iat_ms", "median", "gap_mean"), ("iat_ms", "p95", "gap_mean")]]))).filter(  # quantiles of no gap are NULL, an empty imbalance has no rows
            "(section <> 'orderflow_imbalance' OR ofi_n > 0) AND (stat NOT IN ('median', 'p95') OR gap_n = 0)").drop("gap_n", "ofi_n")
    stacked = melt(rows, [("spread_ticks", "median", "ticks"), ("l1_volume", "ask_median", "ask"), ("l1_volume", "bid_median", "bid"), ("ob_imbalance", "median", "imb"), ("iat_ms", "median", "gap")])
    picked = quantiles(stacked, [*top, "section", "stat"], "value", {"median": 0.5, "p95": 0.95}).select(*top, "section", F.explode(F.when(F.col("section") == "iat_ms", F.array(
        F.struct(F.lit("median").alias("stat"), F.col("median").alias("value")), F.struct(F.lit("p95").alias("stat"), F.col("p95").alias("value")))).otherwise(
            F.array(F.struct(F.col("stat").alias("stat"), F.col("median").alias("value"))))).alias("_q")).select(*top, "section", "_q.*")

    returns = stage(micro.mid_returns(rows, minute_ns, top, F.col("mid")).filter("ret IS NOT NULL"), "returns")
    moments = melt(agg.moments(returns, "ret", top).withColumn("volatility", F.coalesce("std", F.lit(0.0))), [
        *[("returns", c, c) for c in ("n", "mean", "std", "skew", "kurtosis")], ("volatility", "volatility", "volatility")])
    vpm = melt(micro.volume_per_minute(rows, top).groupBy(*top).agg(
        F.count(F.lit(1)).alias("n"), F.avg("volume_per_minute").alias("mean"), F.sum("volume_per_minute").alias("total")), [("volume_per_minute", c, c) for c in ("n", "mean", "total")])
    return reduce(DataFrame.unionByName, [mixes, plain, picked, moments, vpm, returns_acf(returns, top)])


def returns_acf(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Autocorrelation of the returns to lag max(1, min(10, n - 2)) of each key."""
    minute = returns.withColumn("_m", (F.col("label_ns") / 1_000_000_000).cast("long"))
    series = dense_index(minute, by, ["label_ns"], chunk_of("_m"))
    sizes = series.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    lags = micro.acf(series, "ret", 10, by).join(sizes, list(by)).filter(
        F.col("lag") <= F.greatest(F.lit(1), F.least(F.lit(10), F.col("_n") - 2)))
    return lags.select(*by, F.lit("acf_returns").alias("section"),
                       F.concat(F.lit("lag_"), F.col("lag").cast("string")).alias("stat"), F.col("acf").alias("value"))
