"""Dense book state on an even time grid, its tokens and their evaluation.

Snapshots have key columns `by` (a security on one trade day), `t_ms`, a feed position `feed_seq` and
`levels`. After `last_per_slot` a key has at most one row per grid step, 86 400 a day at one second,
so windows by key are bounded from there on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bookflow.functions import div, edge_bin, literal_edges
from bookflow.operators import aggregates as agg, distances as dist
from bookflow.operators.micro import grid
from bookflow.operators.ordered import quantiles

BY = ("trade_date", "security_id")
FIELDS = ("ask_p", "ask_v", "bid_p", "bid_v")


def last_per_slot(snaps: DataFrame, step_ms: int = 1000, by: Sequence[str] = BY) -> DataFrame:
    """Last row per key and grid slot in feed order; rows without a best price on both sides are dropped."""
    top = F.col("levels")[0]
    valid = snaps.filter(top["bid_p"].isNotNull() & top["ask_p"].isNotNull())
    slot = div(F.col("t_ms"), step_ms).alias("slot")
    return valid.groupBy(*by, slot).agg(F.max_by("levels", "feed_seq").alias("levels"))


def densify(slots: DataFrame, by: Sequence[str] = BY, levels: int = 10) -> DataFrame:
    """All slots from the first to the last of a key, every level field filled forward on its own."""
    ranges = slots.groupBy(*by).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    flat = [(i, f) for i in range(levels) for f in FIELDS]
    wide = grid(ranges, by, "slot").join(
        slots.select(*by, "slot", *[F.get("levels", F.lit(i))[f].alias(f"_{f}{i}") for i, f in flat]), [*by, "slot"], "left")
    so_far = W.partitionBy(*by).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    filled = wide.withColumns({f"_{f}{i}": F.last(f"_{f}{i}", ignorenulls=True).over(so_far) for i, f in flat})
    book = F.array(*[F.struct(*[F.col(f"_{f}{i}").alias(f) for f in FIELDS]) for i in range(levels)])
    return filled.select(*by, "slot", book.alias("levels"))


def bucket_anchor(state: DataFrame, per_bucket: int, by: Sequence[str] = BY) -> DataFrame:
    """Attach the first book of each bucket of `per_bucket` slots to all rows of the bucket."""
    keyed = state.withColumn("bucket", div(F.col("slot"), per_bucket))
    first = W.partitionBy(*by, "bucket").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    return keyed.withColumn("anchor", F.first("levels").over(first))


def book_state(snaps: DataFrame, step_ms: int = 1000, anchor_minutes: int = 5, by: Sequence[str] = BY, levels: int = 10) -> DataFrame:
    """Last snapshot per slot, densified, with the bucket anchor."""
    return bucket_anchor(densify(last_per_slot(snaps, step_ms, by), by, levels), anchor_minutes * 60_000 // step_ms, by)


def _slots(levels: Column, field: str) -> Column:
    return F.concat(F.transform(levels, lambda lv: lv[f"ask_{field}"]), F.transform(levels, lambda lv: lv[f"bid_{field}"]))


def price_bins(state: DataFrame, tick: float, max_tick: int = 20) -> DataFrame:
    """Array of 2 x levels price bins, asks first: clipped ticks from the anchor, shifted to start at 0; NULL stays NULL."""
    ticks = F.zip_with(_slots(F.col("levels"), "p"), _slots(F.col("anchor"), "p"), lambda p, a: F.when(
        p.isNotNull() & a.isNotNull(), F.greatest(F.lit(-max_tick), F.least(F.lit(max_tick), F.rint((p - a) / tick))) + max_tick).cast("int"))
    return state.withColumn("price_bins", ticks)


def vol_delta(state: DataFrame) -> DataFrame:
    """Array of log volume changes from the anchor."""
    log = lambda v: F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0)).cast("double")))
    return state.withColumn("vol_delta", F.zip_with(
        _slots(F.col("levels"), "v"), _slots(F.col("anchor"), "v"), lambda v, a: log(v) - log(a)))


def fit_vol_edges(deltas: DataFrame, bins: int = 31, q: float = 0.995) -> list[float]:
    """Even edges on [-m, m], m the q-quantile of the absolute deltas (at least 1e-6)."""
    values = deltas.select(F.lit(1).alias("_one"), F.explode("vol_delta").alias("_x")).withColumn("_x", F.abs("_x"))
    row = quantiles(values, ["_one"], "_x", {"m": q}).first()
    if row is None:
        raise ValueError("no volume deltas to fit")
    m = max(float(row["m"]), 1e-6)
    return [float(e) for e in np.linspace(-m, m, bins + 1)]


def apply_vol_edges(deltas: DataFrame, edges: Sequence[float], bins: int | None = None) -> DataFrame:
    """Volume bin of every slot; edges may come from another day but must fit `bins`."""
    if bins is not None and len(edges) != bins + 1:
        raise ValueError(f"{len(edges)} edges for {bins} bins")
    lit = literal_edges(edges)
    return deltas.withColumn("vol_bins", F.transform("vol_delta", lambda x: F.when(x.isNotNull(), edge_bin(x, lit))))


def slot_tokens(binned: DataFrame, vol_bins: int, price_bins_n: int = 41) -> DataFrame:
    """Joint token price * V + volume per slot; a token out of range is an error."""
    top = price_bins_n * vol_bins
    token = lambda p, v: p * vol_bins + v
    checked = F.zip_with("price_bins", "vol_bins", lambda p, v: F.when(token(p, v).between(0, top - 1), token(p, v)).when(
        token(p, v).isNotNull(), F.raise_error(F.lit("book token out of range")).cast("int")))
    return binned.withColumn("tokens", checked)


def tokenise(state: DataFrame, tick: float, edges: Sequence[float], max_tick: int = 20) -> DataFrame:
    deltas = apply_vol_edges(vol_delta(price_bins(state, tick, max_tick)), edges)
    return slot_tokens(deltas, len(edges) - 1, 2 * max_tick + 1)


def decode_state(tokens: DataFrame, edges: Sequence[float], tick: float, max_tick: int = 20, levels: int = 10) -> DataFrame:
    """Tokens against their anchors back to prices (ticks from the anchor) and volumes (bin centres)."""
    v = len(edges) - 1
    centres = literal_edges([(a + b) / 2 for a, b in zip(edges, edges[1:])])

    def side(name: str, shift: int) -> Column:
        return F.transform(F.slice("tokens", shift + 1, levels), lambda t, i: F.struct(
            (F.get(F.col("anchor"), i)[f"{name}_p"] + (div(t, v) - max_tick) * tick).alias("p"),
            F.expm1(F.log1p(F.greatest(F.get(F.col("anchor"), i)[f"{name}_v"], F.lit(0)).cast("double")) + F.get(centres, (t % v).cast("int"))).alias("v")))

    book = F.zip_with(side("ask", 0), side("bid", levels), lambda a, b: F.struct(
        a["p"].alias("ask_p"), a["v"].alias("ask_v"), b["p"].alias("bid_p"), b["v"].alias("bid_v")))
    return tokens.withColumn("levels", book)


def state_metrics(state: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Spread, log mid return to the previous slot, 10-level depths and depth imbalance per row."""
    top = F.col("levels")[0]
    total = lambda f: F.aggregate("levels", F.lit(0.0), lambda acc, lv: acc + F.coalesce(lv[f].cast("double"), F.lit(0.0)))
    mid = (top["ask_p"] + top["bid_p"]) / 2.0
    base = state.select(*by, "slot", (top["ask_p"] - top["bid_p"]).cast("double").alias("spread"),
                        F.log(F.greatest(mid, F.lit(1e-12))).alias("_log"), total("bid_v").alias("bid_depth_10"), total("ask_v").alias("ask_depth_10"))
    prev = F.lag("_log").over(W.partitionBy(*by).orderBy("slot"))
    both = F.col("bid_depth_10") + F.col("ask_depth_10")
    return base.withColumn("mid_return_log", F.col("_log") - prev).withColumn(
        "depth_imbalance_10", (F.col("bid_depth_10") - F.col("ask_depth_10")) / F.greatest(both, F.lit(1e-12))).drop("_log")


STATE_METRICS = ("spread", "mid_return_log", "bid_depth_10", "ask_depth_10", "depth_imbalance_10")


def state_compare(real: DataFrame, generated: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Distances of the five state measures (spread value by value, the rest by the FD rule), one row per key and metric."""
    long = None
    for kind, table in (("real", real), ("generated", generated)):
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in STATE_METRICS])
        rows = state_metrics(table, by).select(*by, F.lit(kind).alias("kind"), F.inline(pairs))
        long = rows if long is None else long.unionByName(rows)
    return dist.compare(long, [*by, "metric"], discrete=F.col("metric") == "spread")


def slot_rows(real: DataFrame, generated: DataFrame, vol_bins: int, by: Sequence[str] = BY) -> DataFrame:
    """Long (by, kind, slot_no, token, price_bin, vol_bin)."""
    one = lambda df, kind: df.select(*by, F.lit(kind).alias("kind"), F.posexplode("tokens").alias("slot_no", "token"))
    both = one(real, "real").unionByName(one(generated, "generated")).filter("token IS NOT NULL")
    return both.withColumns({"price_bin": div(F.col("token"), vol_bins), "vol_bin": F.col("token") % vol_bins})


def slot_report(real: DataFrame, generated: DataFrame, vol_bins: int, by: Sequence[str] = BY) -> DataFrame:
    """Per slot: token L1, entropies, distance of mean bins, Wasserstein and L1 by group; tokens are counted once."""
    keys = [*by, "slot_no"]
    counts = slot_rows(real, generated, vol_bins, by).groupBy(*keys, "kind", "token", "price_bin", "vol_bin").agg(F.count(F.lit(1)).alias("n"))
    by_token = counts.groupBy(*keys, "token").agg(
        F.sum(F.when(F.col("kind") == "real", F.col("n")).otherwise(0)).alias("_r"),
        F.sum(F.when(F.col("kind") == "generated", F.col("n")).otherwise(0)).alias("_g"),
        F.first("price_bin").alias("_p"), F.first("vol_bin").alias("_v"))
    totals = by_token.groupBy(*keys).agg(F.sum("_r").alias("_tr"), F.sum("_g").alias("_tg"))
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n), F.col(t)), F.lit(0.0))
    entropy = lambda n, t: -F.sum(F.when(F.col(n) > 0, share(n, t) * F.log(share(n, t))).otherwise(0.0))
    gap = lambda b: F.abs(F.sum(F.col(b) * F.col("_r")) / F.max("_tr") - F.sum(F.col(b) * F.col("_g")) / F.max("_tg"))
    basic = by_token.join(totals, keys).groupBy(*keys).agg(
        F.sum(F.abs(share("_r", "_tr") - share("_g", "_tg"))).alias("token_l1"), entropy("_r", "_tr").alias("entropy_real"),
        entropy("_g", "_tg").alias("entropy_generated"), gap("_p").alias("price_bin_diff"), gap("_v").alias("vol_bin_diff"))
    tokens = counts.withColumnRenamed("token", "score")
    distances = dist.compare(tokens, keys, discrete=True, weight="n")
    return basic.join(distances, keys)


def slot_summary(report: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Means over slots, and mean / median / IQM of the slot distances."""
    means = report.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in (
        "token_l1", "entropy_real", "entropy_generated", "price_bin_diff", "vol_bin_diff")])
    return means.join(agg.loss_stats(report, {"w_": "wasserstein", "l1_": "l1_by_group"}, by), list(by))


def horizon(state: DataFrame, start_slot: int, context: int, length: int, by: Sequence[str] = BY) -> DataFrame:
    """`context` rows from the first slot >= start, then `length` rows; fails for a key that is too short.

    Adds `part` ('context' | 'horizon') and `step` counted from 0 in each part.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy("slot")) - 1
    size = F.count(F.lit(1)).over(W.partitionBy(*by))
    rows = state.filter(F.col("slot") >= start_slot).withColumn("_i", rank).withColumn("_n", size)
    enough = F.when(F.col("_n") > context + length, F.lit(True)).otherwise(
        F.raise_error(F.lit("not enough rows for the context and horizon")).cast("boolean"))
    kept = rows.filter(enough).filter(F.col("_i") < context + length)
    seed = F.col("_i") < context
    return kept.withColumns({"part": F.when(seed, "context").otherwise("horizon"),
                             "step": F.when(seed, F.col("_i")).otherwise(F.col("_i") - context)}).drop("_i", "_n")


def token_columns(tokens: DataFrame, slots: int = 20) -> DataFrame:
    """The token array as named columns book_token_00, book_token_01, ..."""
    return tokens.withColumns({f"book_token_{i:02d}": F.get("tokens", F.lit(i)) for i in range(slots)}).drop("tokens")
