"""Microstructure measures of a tape.

A tape has one row per message with the book after it: key columns `by`, a dense `row_seq`, `t_ns`,
`event_type` (1 new, 2 partial cancel, 3 full cancel, 4 execution), `order_id`, `size`, `price`,
`direction` and `levels`, an array of (ask_p, ask_v, bid_p, bid_v) from the touch outwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bookflow.functions import div
from bookflow.operators.ordered import chunk_of, join_key_stats, over_neighbours, quantiles, running

BY = ("run_id", "kind")
NEW, PARTIAL_CANCEL, FULL_CANCEL, EXECUTION = 1, 2, 3, 4
NS = 1_000_000_000


def touch(field: str) -> Column:
    """Field of the first level; taking the field first lets a Parquet scan read that field only."""
    return F.col("levels")[field][0]


def mid() -> Column:
    return (touch("ask_p") + touch("bid_p")) / 2


def spread_of() -> Column:
    return touch("ask_p") - touch("bid_p")


def imbalance_of() -> Column:
    bid, ask = touch("bid_v"), touch("ask_v")
    return F.try_divide((bid - ask).cast("double"), (bid + ask).cast("double"))


def depth_sum(field: str, n: int) -> Column:
    return F.aggregate(F.slice(F.col("levels")[field], 1, n), F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(v, F.lit(0)))


def _rows(tape: DataFrame, by: Sequence[str], **cols: Column) -> DataFrame:
    return tape.select(*by, "row_seq", *[c.alias(n) for n, c in cols.items()])


def events(tape: DataFrame, types: Sequence[int], keep: bool = True) -> DataFrame:
    hit = F.col("event_type").isin(*types)
    return tape.filter(hit if keep else ~hit)


def mid_price(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return _rows(tape, by, mid=mid())


def spread(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return _rows(tape, by, spread=spread_of())


def spread_summary(tape: DataFrame, by: Sequence[str] = BY, tick: int = 100) -> DataFrame:
    """Statistics of the positive spreads in ticks, and the share of rows whose spread is <= 0."""
    ticks = tape.select(*by, spread_of().alias("_s")).withColumn(
        "ticks", F.when(F.col("_s") > 0, F.col("_s") / float(tick)))
    stats = ticks.groupBy(*by).agg(
        F.count("ticks").alias("n"), F.avg("ticks").alias("mean"), F.stddev_samp("ticks").alias("std"),
        F.avg((F.col("_s") <= 0).cast("double")).alias("share_not_positive"))
    return stats.join(quantiles(ticks, by, "ticks", {"median": 0.5}).drop("n"), list(by), "left")


def time_weight(tape: DataFrame, by: Sequence[str] = BY, *carry: Column) -> DataFrame:
    """Gap to the previous row as a share of the whole span."""
    rows = tape.select(*by, "row_seq", "t_ns", *carry)
    span = rows.groupBy(*by).agg((F.max_by("t_ns", "row_seq") - F.min_by("t_ns", "row_seq")).alias("_span"))
    gaps = over_neighbours(rows, by, lambda w: {"_gap": F.col("t_ns") - F.lag("t_ns").over(w)}, before=1)
    return join_key_stats(gaps, span, by).withColumn(
        "time_weight", F.try_divide(F.col("_gap").cast("double"), F.col("_span").cast("double"))).drop(
            "_gap", "_span", "t_ns")


def l1_volume(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return time_weight(tape, by, touch("ask_v").alias("ask_vol"), touch("bid_v").alias("bid_vol"))


def total_volume(tape: DataFrame, n: int, by: Sequence[str] = BY) -> DataFrame:
    if n < 1:
        raise ValueError("the number of levels must be positive")
    deep = F.assert_true(F.size("levels") >= n, F.lit("the book has fewer levels than asked for"))
    checked = tape.filter(deep.isNull())
    return time_weight(checked, by, depth_sum("ask_v", n).alias("ask_vol"), depth_sum("bid_v", n).alias("bid_vol"))


def book_imbalance(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return _rows(tape, by, imbalance=imbalance_of())


def inter_arrival(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Gap to the previous message in milliseconds; the first row of a key has none."""
    gaps = over_neighbours(tape.select(*by, "row_seq", "t_ns"), by,
                           lambda w: {"_gap": F.col("t_ns") - F.lag("t_ns").over(w)}, before=1)
    return gaps.filter("_gap IS NOT NULL").select(*by, "row_seq", (F.col("_gap") / 1e6).alias("gap_ms"))


def arrival_summary(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Gaps between messages that are not executions (types 4, 5), negative gaps left out."""
    arrival = F.when(~F.col("event_type").isin(4, 5), F.col("t_ns"))
    rows = tape.select(*by, "row_seq", "event_type", "t_ns", arrival.alias("_a"))
    seen = running(rows, by, ["row_seq"], chunk_of("row_seq"), befores={"_last": F.col("_a")})
    gap = (F.col("_a") - F.col("_last")) / 1e6
    gaps = seen.select(*by, "event_type", F.when(gap >= 0, gap).alias("gap"))
    stats = gaps.groupBy(*by).agg(
        F.count("gap").alias("n"), F.sum(F.col("event_type").isin(4, 5).cast("long")).alias("n_exec_excluded"),
        F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"))
    return stats.join(quantiles(gaps, by, "gap", {"median": 0.5, "p95": 0.95}).drop("n"), list(by), "left")


def ofi(tape: DataFrame, n: int = 100, by: Sequence[str] = BY, *carry: Column) -> DataFrame:
    """Order-flow imbalance at the touch, averaged over the last n changes; warm-up rows removed.

    Terms are summed as integers, so the difference of two prefix sums inside a chunk is exact.
    """
    rows = tape.select(*by, "row_seq", touch("ask_p").alias("_ap"), touch("ask_v").alias("_av"),
                       touch("bid_p").alias("_bp"), touch("bid_v").alias("_bv"), *carry)
    return over_neighbours(rows, by, *ofi_columns(n), before=n).filter(F.col("row_seq") >= n).drop(
        "_ap", "_av", "_bp", "_bv", "_term", "_sum")


def ofi_columns(n: int, name: str = "ofi") -> list:
    zero = F.lit(0)

    def term(w):
        ap, av, bp, bv = (F.lag(c).over(w) for c in ("_ap", "_av", "_bp", "_bv"))
        return {"_term": F.coalesce(
            F.when(F.col("_bp") >= bp, F.col("_bv")).otherwise(zero) - F.when(F.col("_bp") <= bp, bv).otherwise(zero)
            - F.when(F.col("_ap") <= ap, F.col("_av")).otherwise(zero) + F.when(F.col("_ap") >= ap, av).otherwise(zero),
            zero)}

    def total(w):
        return {"_sum": F.sum("_term").over(w.rowsBetween(W.unboundedPreceding, 0))}

    def mean(w):
        return {name: (F.col("_sum") - F.coalesce(F.lag("_sum", n).over(w), zero)) / F.lit(float(n))}

    return [term, total, mean]


def ofi_cond_tick(tape: DataFrame, n: int = 100, by: Sequence[str] = BY) -> DataFrame:
    """OFI paired with the sign of the next mid change (`tick` -1, 0, 1)."""
    rows = tape.select(*by, "row_seq", touch("ask_p").alias("_ap"), touch("ask_v").alias("_av"),
                       touch("bid_p").alias("_bp"), touch("bid_v").alias("_bv"))
    mid2 = F.col("_ap") + F.col("_bp")
    look = lambda w: {"tick": F.signum((F.lead(mid2).over(w) - mid2).cast("double")).cast("int")}
    out = over_neighbours(rows, by, *ofi_columns(n), look, before=n, after=1)
    return out.filter((F.col("row_seq") >= n) & F.col("tick").isNotNull()).select(*by, "row_seq", "ofi", "tick")


def _depth(tape: DataFrame, types: Sequence[int], by: Sequence[str]) -> DataFrame:
    away = events(tape, types).select(*by, "row_seq", (F.col("price") - mid()).alias("_d")).filter("_d <> 0")
    return away.select(*by, "row_seq", F.when(F.col("_d") > 0, "ask").otherwise("bid").alias("side"),
                       F.abs("_d").alias("depth"))


def limit_depth(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Distance of new orders from the same-row mid; above is the ask side, on the mid is dropped."""
    return _depth(tape, (NEW,), by)


def cancel_depth(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return _depth(tape, (PARTIAL_CANCEL, FULL_CANCEL), by)


def level_hits(levels: Column, price: Column) -> Column:
    """Array of (side, level) where the price stands in the book; sides are told by the matched column."""
    hit = lambda side, field: F.struct(
        F.lit(side).alias("side"),
        F.array_position(levels[field], price).cast("int").alias("level"))
    return F.filter(F.array(hit("ask", "ask_p"), hit("bid", "bid_p")), lambda h: h["level"] > 0)


def limit_level(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Level of new orders in the same-row book; orders off the book are dropped."""
    return events(tape, (NEW,)).select(*by, "row_seq", F.inline(level_hits(F.col("levels"), F.col("price"))))


def prev_book(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add `prev_levels`, the book before each message."""
    return over_neighbours(tape, by, lambda w: {"prev_levels": F.lag("levels").over(w)}, before=1)


def cancel_level(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Level of cancelled orders in the book before the message."""
    rows = tape.select(*by, "row_seq", "event_type", "price", "levels")
    return events(prev_book(rows, by), (PARTIAL_CANCEL, FULL_CANCEL)).filter("prev_levels IS NOT NULL").select(
        *by, "row_seq", F.inline(level_hits(F.col("prev_levels"), F.col("price"))))


def known_orders(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows of orders that have a new-order message."""
    ids = tape.filter(F.col("event_type") == NEW).select(*by, "order_id").distinct()
    return tape.join(ids, [*by, "order_id"], "left_semi")


def first_two(tape: DataFrame, types: Sequence[int], by: Sequence[str] = BY) -> DataFrame:
    """Time between the first two rows of each known order among `types`; single rows are dropped.

    The rank filter is applied before the shuffle (window group limit), so an order with very many
    rows sends two rows per input partition.
    """
    rows = events(tape.select(*by, "order_id", "row_seq", "event_type", "t_ns"), types)
    rank = F.row_number().over(W.partitionBy(*by, "order_id").orderBy("row_seq"))
    pairs = rows.withColumn("_rank", rank).filter("_rank <= 2").groupBy(*by, "order_id").agg(
        (F.max(F.when(F.col("_rank") == 2, F.col("t_ns"))) - F.max(F.when(F.col("_rank") == 1, F.col("t_ns")))
         ).alias("delta_ns"),
    ).filter("delta_ns IS NOT NULL")
    ids = tape.filter(F.col("event_type") == NEW).select(*by, "order_id").distinct()
    return pairs.join(ids, [*by, "order_id"], "left_semi")


def time_to_first_fill(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return first_two(tape, (NEW, EXECUTION), by)


def time_to_cancel(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return first_two(tape, (NEW, PARTIAL_CANCEL, FULL_CANCEL), by)


def volume_per_minute(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Executed size per second times 60, for seconds with trades; the edge seconds are scaled to
    the part they cover, or dropped when that part is shorter than 0.1 s."""
    trades = events(tape, (EXECUTION,)).select(*by, "row_seq", "t_ns", "size", div(F.col("t_ns"), NS).alias("second"))
    secs = trades.groupBy(*by, "second").agg(
        F.sum("size").cast("double").alias("_v"), F.min_by("t_ns", "row_seq").alias("_t0"),
        F.max_by("t_ns", "row_seq").alias("_t1"))
    edges = trades.groupBy(*by).agg(F.min("second").alias("_s0"), F.max("second").alias("_s1"))
    us = lambda t: div(F.col(t), 1000) % 1_000_000
    first, last = F.col("second") == F.col("_s0"), F.col("second") == F.col("_s1")
    width = us("_t1") - us("_t0")
    value = (
        F.when(first & last & (F.col("_t0") == F.col("_t1")), F.col("_v"))
        .when(first & last & (width >= 100_000), F.col("_v") * (1e6 / width))
        .when(first & last, F.lit(None))
        .when(first & (us("_t0") >= 900_000), F.col("_v") / (1 - us("_t0") / 1e6))
        .when(first, F.lit(None))
        .when(last & (us("_t1") >= 100_000), F.col("_v") * (1e6 / us("_t1")))
        .when(last, F.lit(None))
        .otherwise(F.col("_v")))
    out = secs.join(edges, list(by)).select(*by, "second", (value * 60).alias("volume_per_minute"))
    return out.filter("volume_per_minute IS NOT NULL")


def time_of_day(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Seconds since midnight of the day of the key's first row."""
    day = 86_400 * NS
    first = tape.groupBy(*by).agg((F.min_by("t_ns", "row_seq") - F.min_by("t_ns", "row_seq") % day).alias("_day0"))
    return join_key_stats(tape.select(*by, "row_seq", "t_ns"), first, by).select(
        *by, "row_seq", ((F.col("t_ns") - F.col("_day0")) / 1e9).alias("seconds"))


def start_time(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    t0 = F.min_by("t_ns", "row_seq")
    return tape.groupBy(*by).agg(t0.alias("start_ns"), ((t0 % (86_400 * NS)) / 1e9).alias("start_seconds"))


def bars(tape: DataFrame, every_ns: int, value: Column, by: Sequence[str] = BY) -> DataFrame:
    """Last value of each non-empty interval; `bar` is the interval's number since the epoch."""
    rows = tape.select(*by, "row_seq", div(F.col("t_ns"), every_ns).alias("bar"), value.alias("_x"))
    return rows.groupBy(*by, "bar").agg(F.max_by("_x", "row_seq").alias("last"))


def mid_returns(tape: DataFrame, every_ns: int = 60 * NS, by: Sequence[str] = BY, value: Column | None = None) -> DataFrame:
    """Log return between the last mids (or values of `value`) of adjacent intervals; NULL after an empty interval."""
    table = bars(tape, every_ns, mid() if value is None else value, by)
    prev = F.struct(F.col("bar"), F.col("last"))
    seen = running(table, by, ["bar"], chunk_of("bar"), prevs={"_prev": prev})
    adjacent = F.col("bar") - F.col("_prev.bar") == 1
    ret = F.when(adjacent, F.log("last") - F.log("_prev.last"))
    return seen.select(*by, ((F.col("bar") + 1) * every_ns).alias("label_ns"), ret.alias("ret"))


def volatility(tape: DataFrame, every_ns: int = 60 * NS, by: Sequence[str] = BY) -> DataFrame:
    return mid_returns(tape, every_ns, by).groupBy(*by).agg(
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("volatility"))


def mean_per_interval(rows: DataFrame, value: str, every_ns: int, by: Sequence[str] = BY) -> DataFrame:
    """Mean per interval (closed left, labelled right); intervals without rows are present with NULL.

    The grid of a key is laid out in blocks, so no single row holds all of its intervals.
    """
    means = rows.groupBy(*by, div(F.col("t_ns"), every_ns).alias("bar")).agg(F.avg(value).alias("mean"))
    return grid(rows.groupBy(*by).agg(div(F.min("t_ns"), every_ns).alias("_lo"), div(F.max("t_ns"), every_ns).alias("_hi")),
                by, "bar").join(means, [*by, "bar"], "left").select(
                    *by, ((F.col("bar") + 1) * every_ns).alias("label_ns"), "mean")


def grid(ranges: DataFrame, by: Sequence[str], name: str, block: int = 4096) -> DataFrame:
    """All integers of [_lo, _hi] per key."""
    blocks = ranges.withColumn("_b", F.explode(F.sequence(div(F.col("_lo"), block), div(F.col("_hi"), block))))
    return blocks.repartition(*by, "_b").select(*by, F.explode(F.sequence(
        F.greatest(F.col("_lo"), F.col("_b") * block), F.least(F.col("_hi"), F.col("_b") * block + block - 1))).alias(name))


def rolling_mean(rows: DataFrame, value: str, n: int, by: Sequence[str] = BY) -> DataFrame:
    """Mean over exactly n rows by difference of prefix sums inside a chunk; the first n - 1 rows are removed."""
    total = lambda w: {"_sum": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))}
    mean = lambda w: {"rolling": (F.col("_sum") - F.coalesce(F.lag("_sum", n).over(w), F.lit(0))) / F.lit(float(n))}
    return over_neighbours(rows, by, total, mean, before=n).filter(F.col("row_seq") >= n - 1).drop("_sum")


def acf(series: DataFrame, value: str, nlags: int, by: Sequence[str] = BY, alpha: float | None = None) -> DataFrame:
    """Autocorrelation for lags 0..nlags (biased estimator) of a densely indexed series without NULLs."""
    mean = series.groupBy(*by).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("n"))
    centred = join_key_stats(series.select(*by, "row_seq", value), mean, by).select(*by, "row_seq", "n", (F.col(value) - F.col("_m")).alias("_x"))
    ahead = over_neighbours(centred, by, lambda w: {f"_l{k}": F.lead("_x", k).over(w) for k in range(1, nlags + 1)},
                            after=nlags)
    sums = ahead.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_c0"), *[
        F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, nlags + 1)])
    lagged = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_c{k}"), F.col("_c0")).alias("acf"))
                       for k in range(nlags + 1)])
    out = sums.select(*by, "n", F.inline(lagged)).filter("acf IS NOT NULL")
    if alpha is None:
        return out.drop("n")
    z = NormalDist().inv_cdf(1 - alpha / 2)
    past = W.partitionBy(*by).orderBy("lag").rowsBetween(W.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(past), F.lit(0.0))
    var = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise((1 + 2 * squares) / F.col("n"))
    half = z * F.sqrt(var)
    return out.select(*by, "lag", "acf", (F.col("acf") - half).alias("ci_low"), (F.col("acf") + half).alias("ci_high"))


def book_change_3d(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mid change, price relative to the mid, and size signed + for new orders and - for all others."""
    rows = tape.select(*by, "row_seq", "event_type", "price", "size", mid().alias("_mid"))
    out = over_neighbours(rows, by, lambda w: {"mid_change": F.col("_mid") - F.lag("_mid").over(w)}, before=1)
    return out.select(*by, "row_seq", "mid_change", (F.col("price") - F.col("_mid")).alias("price"),
                      F.when(F.col("event_type") == NEW, F.col("size")).otherwise(-F.col("size")).alias("size"))


def qcut_3d(changes: DataFrame, n: int, by: Sequence[str] = BY,
            dims: Sequence[str] = ("mid_change", "price", "size")) -> DataFrame:
    """Quantile group of each dimension: right-closed, lowest included, equal edges merged."""
    out = changes
    for dim in dims:
        named = {f"_e{i}": i / n for i in range(n + 1)}
        edges = quantiles(changes, by, dim, named).select(*by, F.array_distinct(F.array(*named)).alias("_edges"))
        below = F.size(F.filter("_edges", lambda e: e < F.col(dim)))
        out = join_key_stats(out, edges, by).withColumn(
            f"{dim}_group", F.when(F.col(dim).isNotNull(), F.greatest(below, F.lit(1)) - 1).cast("long")).drop("_edges")
    return out


def book_delta(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """First changed (price, volume) pair between consecutive books, asks and bids interleaved.

    Gives the mid change, the 0-based position of the new price, and the volume change (the whole
    volume when the first new price differs from the first vanished one). Unchanged books are left out.
    """
    pairs = F.flatten(F.transform("levels", lambda lv: F.array(
        F.struct(lv["ask_p"].alias("p"), lv["ask_v"].alias("v")),
        F.struct(lv["bid_p"].alias("p"), lv["bid_v"].alias("v")))))
    rows = tape.select(*by, "row_seq", mid().alias("_mid"), pairs.alias("_now"))
    seen = over_neighbours(rows, by, lambda w: {"_before": F.lag("_now").over(w), "_mid0": F.lag("_mid").over(w)}, before=1)
    new, old = F.get(F.array_except("_now", "_before"), F.lit(0)), F.get(F.array_except("_before", "_now"), F.lit(0))
    found = seen.select(*by, "row_seq", (F.col("_mid") - F.col("_mid0")).alias("delta_mid"), "_now",
                        new.alias("_new"), old.alias("_old")).filter("_new IS NOT NULL AND _old IS NOT NULL")
    change = F.when(F.col("_new.p") == F.col("_old.p"), F.col("_new.v") - F.col("_old.v")).otherwise(F.col("_new.v"))
    return found.select(*by, "row_seq", "delta_mid", (F.array_position(F.transform(
        "_now", lambda x: x["p"]), F.col("_new.p")) - 1).cast("long").alias("level_index"), change.alias("quantity"))


def mid_summary(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    rows = tape.select(*by, "row_seq", mid().alias("_m"))
    first, last = F.min_by("_m", "row_seq"), F.max_by("_m", "row_seq")
    return rows.groupBy(*by).agg(
        first.alias("start_mid"), last.alias("end_mid"), F.avg("_m").alias("mean_mid"), F.stddev_samp("_m").alias("std_mid"),
        ((last / first - 1) * 10_000).alias("return_bps"))
