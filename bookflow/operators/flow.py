"""Order posts and transactions to one unified event flow.

Keys of a flow are `trade_date, security_id`; prices are integer ticks, `t_ms` is milliseconds since
midnight. `build_flow` composes the single steps, each of which also stands alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookflow.functions import (
    ASK, BID, CANCEL, CANCEL_ASK, CANCEL_BID, DONE_ASK, DONE_BID, EXEC_CANCEL, EXEC_TRADE, ORD_LIMIT, div,
)
from bookflow.operators.ordered import asof_backward, dense_index, join_key_stats, over_neighbours, running, spread
from bookflow.session import stage

BY = ("trade_date", "security_id")
ORDER_KEY = (*BY, "channel_no", "appl_seq_num")
SESSION_OPEN_S, SESSION_CLOSE_S, AUCTION_S, ANCHOR_S = 34_200, 54_000, 33_900, 34_260
HALF_TICK = 0.5
FEED_TIE = ("leg", "txn_seq", "exec_type", "order_qty")

# Side code -> token digit.
SIDES_3 = {49: 0, 50: 1, 99: 2}
SIDES_5 = {49: 0, 50: 1, 99: 2, 129: 3, 130: 4}
SIDES_6 = {49: 0, 50: 1, 97: 2, 98: 3, 129: 4, 130: 5}


# Filters and anchors ----------------------------------------------------------------------------------------

def limit_orders(posts: DataFrame) -> DataFrame:
    return posts.filter((F.col("ord_type") == ORD_LIMIT) & F.col("price_tick").isNotNull())


def after_open(df: DataFrame, open_s: int = SESSION_OPEN_S) -> DataFrame:
    """Rows strictly after the opening second: the whole opening second is left out."""
    return df.filter(div(F.col("t_ms"), 1000) > open_s)


def session_filter(df: DataFrame, start_s: int = AUCTION_S, end_s: int = SESSION_CLOSE_S) -> DataFrame:
    """Rows whose whole second lies in [start, end]."""
    return df.filter(div(F.col("t_ms"), 1000).between(start_s, end_s))


def universe(df: DataFrame, stocks: Sequence[str] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Keep the named securities and, with a mask, the liquid ones of the day."""
    if stocks:
        df = df.filter(F.col("security_id").isin(*stocks))
    if mask is not None:
        df = df.join(mask.filter(F.col("is_liquid") == 1).select(*BY), list(BY), "left_semi")
    return df


def join_mask(posts: DataFrame, mask: DataFrame) -> DataFrame:
    """Left join of the liquidity flag; the mask is broadcast when its measured size allows."""
    return posts.join(mask.select(*BY, "is_liquid"), list(BY), "left")


def snapshot_at(snaps: DataFrame, second: int, security_id: str | None = None) -> DataFrame:
    """Snapshots of an exact second."""
    hit = snaps.filter(div(F.col("t_ms"), 1000) == second)
    return hit.filter(F.col("security_id") == security_id) if security_id else hit


def open_anchor(snaps: DataFrame, second: int = ANCHOR_S, required: DataFrame | None = None) -> DataFrame:
    """Last touch of the anchor second per security; fails if a key of `required` has none."""
    last = F.max_by(F.struct("bid1", "ask1"), F.struct("t_ms", "snap_seq")).alias("_a")
    anchors = snapshot_at(snaps, second).groupBy(*BY).agg(last).select(
        *BY, F.col("_a.bid1").alias("anchor_bid_tick"), F.col("_a.ask1").alias("anchor_ask_tick"))
    if required is None:
        return anchors
    miss = F.raise_error(F.concat(F.lit("no snapshot in the anchor second for "), F.col("security_id"))).cast("long")
    return required.select(*BY).distinct().join(anchors, list(BY), "left").select(
        *BY, F.coalesce("anchor_bid_tick", miss).alias("anchor_bid_tick"), "anchor_ask_tick")


def open_diff(posts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Price in whole ticks from the fixed opening bid; securities without an anchor are dropped."""
    joined = join_key_stats(posts, anchors.select(*BY, "anchor_bid_tick"), BY)
    return joined.withColumn("price_diff", _open_diff())


def _open_diff() -> Column:
    return F.rint(F.col("price_tick") - F.col("anchor_bid_tick")).cast("long")


def last_mid_per_second(snaps: DataFrame) -> DataFrame:
    """Last touch of each second as a mid price in ticks."""
    last = F.max_by((F.col("bid1") + F.col("ask1")) / 2, F.struct("t_ms", "snap_seq")).alias("mid_tick")
    return snaps.groupBy(*BY, div(F.col("t_ms"), 1000).alias("t_sec")).agg(last)


def mid_diff(posts: DataFrame, snaps: DataFrame, tolerance_s: int = 5) -> DataFrame:
    """Attach the latest mid within the tolerance and the price distance to it in half ticks (half-even)."""
    timed = posts.withColumn("t_sec", div(F.col("t_ms"), 1000))
    joined = asof_backward(timed, last_mid_per_second(snaps), BY, "t_sec", ["mid_tick"], tolerance=tolerance_s, bucket=60)
    return joined.filter("mid_tick IS NOT NULL").withColumn(
        "price_diff", F.rint((F.col("price_tick") - F.col("mid_tick")) / HALF_TICK).cast("long"))


# Transactions -----------------------------------------------------------------------------------------------

def expand_legs(txns: DataFrame) -> DataFrame:
    """One row per order a cancel or trade refers to: bid and offer legs with a non-zero number, in one scan."""
    leg = lambda col, no: F.struct(F.col(col).alias("appl_seq_num"), F.lit(no).alias("leg"))
    legs = F.filter(F.array(leg("bid_seq", 1), leg("offer_seq", 2)),
                    lambda x: x["appl_seq_num"].isNotNull() & (x["appl_seq_num"] != 0))
    return txns.filter(F.col("exec_type").isin(EXEC_CANCEL, EXEC_TRADE)).select(
        *BY, "channel_no", "exec_type", F.col("last_qty").alias("order_qty"), "t_ms", "txn_seq", F.inline(legs))


def match_legs(legs: DataFrame, posts: DataFrame, carry: Sequence[str] = ("price_tick", "price_diff")) -> DataFrame:
    """Attach the price, anchor columns and original side of the post; legs without one are dropped."""
    return legs.join(posts.select(*ORDER_KEY, *carry, F.col("side").alias("orig_side")), list(ORDER_KEY))


def code_side(legs: DataFrame, mode: str = "split") -> DataFrame:
    """Side code of a leg: 99 for cancels; executions 129 / 130 by the resting side, or always 129 ('single')."""
    return legs.withColumn("side", _code_side(mode))


def _code_side(mode: str) -> Column:
    done = F.lit(DONE_BID) if mode == "single" else (
        F.when(F.col("orig_side") == BID, DONE_BID).when(F.col("orig_side") == ASK, DONE_ASK))
    return F.when(F.col("exec_type") == EXEC_CANCEL, CANCEL).when(F.col("exec_type") == EXEC_TRADE, done).cast("long")


def split_cancels(flow: DataFrame) -> DataFrame:
    """Cancel code by the side of the cancelled order."""
    cancel = F.col("side") == CANCEL
    return flow.withColumn("side", F.when(cancel & (F.col("orig_side") == BID), CANCEL_BID).when(
        cancel & (F.col("orig_side") == ASK), CANCEL_ASK).otherwise(F.col("side")).cast("long"))


def immediate_exec(legs: DataFrame) -> DataFrame:
    """Executed quantity per order and instant."""
    return legs.filter(F.col("exec_type") == EXEC_TRADE).groupBy(*ORDER_KEY, "t_ms").agg(
        F.sum("order_qty").alias("immediate_qty"))


def join_immediate(posts: DataFrame, executed: DataFrame) -> DataFrame:
    """Quantity executed in the instant of the post, 0 where none."""
    joined = posts.join(executed, [*ORDER_KEY, "t_ms"], "left")
    return joined.withColumn("immediate_qty", F.coalesce("immediate_qty", F.lit(0)).cast("long"))


def residual_flags(posts: DataFrame) -> DataFrame:
    """Split the posted quantity into the part executed at once (capped) and the resting rest."""
    immediate = F.least("immediate_qty", "order_qty")
    return posts.withColumns({
        "post_qty": F.col("order_qty"), "immediate_qty": immediate, "residual_qty": F.col("order_qty") - immediate,
        "aggressive": immediate > 0, "residual_posted": F.col("order_qty") - immediate > 0,
    })


def residual_posts(flagged: DataFrame) -> DataFrame:
    """Posts that leave something on the book, with the resting quantity as their quantity."""
    return flagged.filter("residual_posted").withColumn("order_qty", F.col("residual_qty"))


def aggressive_stats(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(*BY).agg(F.sum(F.col("aggressive").cast("long")).alias("immediate_aggressive_posts"),
                                    F.sum(F.col("residual_posted").cast("long")).alias("residual_post_rows"))


def match_rate(legs: DataFrame, posts: DataFrame) -> DataFrame:
    """Legs without a post, in all, by execution type, by security, and by both.

    Post keys are de-duplicated first. Legs are counted per (security, type) before the report
    levels are formed, so the grouping sets run on a handful of rows.
    """
    keys = posts.select(*ORDER_KEY).distinct().withColumn("_hit", F.lit(1))
    counted = legs.join(keys, list(ORDER_KEY), "left").groupBy("security_id", "exec_type").agg(
        F.count(F.lit(1)).alias("_legs"), F.sum(F.col("_hit").isNull().cast("long")).alias("_miss"))
    return counted.cube("security_id", "exec_type").agg(
        F.sum("_legs").alias("total_legs"), F.sum("_miss").alias("unmatched"),
        (100.0 * F.sum("_miss") / F.sum("_legs")).alias("unmatched_pct"))


# The flow ---------------------------------------------------------------------------------------------------

def unify_flow(posts: DataFrame, legs: DataFrame) -> DataFrame:
    """Union of post rows and matched legs; the semantic names what happened."""
    post_rows = posts.withColumns({"orig_side": F.col("side"), "event_semantic": F.lit("post"), "leg": F.lit(0)})
    leg_rows = legs.withColumn("event_semantic", _semantic())
    both = post_rows.unionByName(leg_rows, allowMissingColumns=True)
    flags = [c for c in ("aggressive", "residual_posted") if c in both.columns]
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})


def _semantic() -> Column:
    return F.when(F.col("exec_type") == EXEC_CANCEL, "cancel").when(F.col("exec_type") == EXEC_TRADE, "transaction_complete")


def order_flow(flow: DataFrame) -> DataFrame:
    """Dense `row_seq` per security in time, channel, number order; equal keys keep post, bid leg, offer leg, feed order."""
    tie = [c for c in FEED_TIE if c in flow.columns]
    return dense_index(flow, BY, ["t_ms", "channel_no", "appl_seq_num", *tie], div(F.col("t_ms"), 1000))


def interval_ms(flow: DataFrame) -> DataFrame:
    """Gap to the previous event of the security; 0 for the first."""
    gap = lambda w: {"interval_ms": F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(0)).cast("long")}
    return over_neighbours(flow, BY, gap, before=1)


def ordered_with_gaps(flow: DataFrame, coded: Column) -> DataFrame:
    """`order_flow` and `interval_ms` from one shuffle: rows are numbered and compared inside a second, and
    one row of counts and last time per second is carried forward. Rows that are not `coded` (without a side) take no number: they are dropped
    afterwards, and the numbers of the others stay dense."""
    counted = F.when(coded, 1).otherwise(0)
    tie = [c for c in FEED_TIE if c in flow.columns]
    out = running(flow, BY, ["t_ms", "channel_no", "appl_seq_num", *tie], div(F.col("t_ms"), 1000),
                  sums={"_n": counted}, prevs={"_t": F.col("t_ms")}, rows=flow.count())
    return out.withColumns({
        "row_seq": (F.col("_n") - 1).cast("long"),
        "interval_ms": (F.col("t_ms") - F.coalesce("_t", "t_ms")).cast("long")}).drop("_n", "_t")


def build_flow(posts: DataFrame, txns: DataFrame, snaps: DataFrame, mask: DataFrame | None = None, *,
               variant: str = "open_complete", split_cancel_sides: bool = False, stocks: Sequence[str] | None = None,
               anchor_s: int = ANCHOR_S, after_open_only: bool = True) -> DataFrame:
    """Unified flow of a day in one of three variants.

    'mid': prices relative to the as-of mid, executions coded 129. 'open': relative to the opening
    bid, executions coded 129. 'open_complete': as 'open' with executions split by resting side
    and immediately executed quantity taken out of the posts. With selected `stocks` a security without a
    snapshot in the anchor second is an error. The matched rows are staged once,
    so the joins are not repeated by the two branches of the ordering.
    """
    if variant not in ("mid", "open", "open_complete"):
        raise ValueError(f"unknown variant {variant!r}")
    if split_cancel_sides and variant != "open_complete":
        raise ValueError("split cancels need the six-side 'open_complete' variant")
    orders = limit_orders(universe(posts, stocks, mask))
    if after_open_only:
        orders = after_open(orders)
    if variant == "mid":
        priced, carry = mid_diff(orders, snaps), ("price_tick", "mid_tick", "price_diff")
    else:
        priced, carry = open_diff(orders, open_anchor(snaps, anchor_s, orders if stocks else None)), ("price_tick", "anchor_bid_tick", "price_diff")
    mode = "split" if variant == "open_complete" else "single"
    n_legs = 2 * txns.count()
    legs = match_legs(spread(expand_legs(universe(txns, stocks)), n_legs, *ORDER_KEY), spread(priced, n_legs, *ORDER_KEY), carry)
    if variant == "open_complete":
        priced = residual_posts(residual_flags(join_immediate(priced, immediate_exec(legs)))).drop("post_qty", "residual_qty", "aggressive", "residual_posted")
    # What follows from other columns is left out while rows are written and ordered: semantic, side, distance, quantities.
    posted = priced.drop("ord_type").withColumnsRenamed({"side": "orig_side"}).withColumns({"leg": F.lit(0), "exec_type": F.lit(None).cast(legs.schema["exec_type"].dataType)})
    slim = posted.unionByName(legs, allowMissingColumns=True)
    if variant != "mid":
        slim = slim.drop("price_diff")
    coded = (F.col("leg") == 0) | _code_side(mode).isNotNull()
    flow = ordered_with_gaps(stage(session_filter(slim), "flow-rows"), coded).filter(coded)
    is_post = F.col("leg") == 0
    flow = flow.withColumns({
        "side": F.when(is_post, F.col("orig_side")).otherwise(_code_side(mode)).cast("long"),
        "event_semantic": F.when(is_post, "post").otherwise(_semantic())})
    if variant != "mid":
        flow = flow.withColumn("price_diff", _open_diff())
    if variant == "open_complete":
        flow = flow.withColumns({
            "post_qty": F.when(is_post, F.col("order_qty") + F.col("immediate_qty")), "residual_qty": F.when(is_post, F.col("order_qty")),
            "aggressive": F.coalesce(F.col("immediate_qty") > 0, F.lit(False)), "residual_posted": is_post})
    return split_cancels(flow) if split_cancel_sides else flow


def pool(*days: DataFrame) -> DataFrame:
    """Rows of several days as one table for pooled fitting."""
    out = days[0]
    for day in days[1:]:
        out = out.unionByName(day, allowMissingColumns=True)
    return out


def flow_report(flow: DataFrame) -> DataFrame:
    """Rows, tokenizable rows, and counts per semantic and per side, from one aggregation."""
    token = F.col("tokenizable_event") if "tokenizable_event" in flow.columns else F.lit(False)
    counts = flow.groupBy(*BY, "event_semantic", "side").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(token.cast("long")).alias("_t"))
    facts = F.array(
        F.struct(F.lit("rows").alias("fact"), F.lit("all").alias("value"), F.col("_n").alias("n")),
        F.struct(F.lit("tokenizable").alias("fact"), F.lit("all").alias("value"), F.col("_t").alias("n")),
        F.struct(F.lit("semantic").alias("fact"), F.col("event_semantic").alias("value"), F.col("_n").alias("n")),
        F.struct(F.lit("side").alias("fact"), F.col("side").cast("string").alias("value"), F.col("_n").alias("n")))
    return counts.select(*BY, F.inline(facts)).groupBy(*BY, "fact", "value").agg(F.sum("n").alias("n"))


def fixed_window(flow: DataFrame, start_ms: int, lookahead_ms: int, tokenizable_only: bool = True) -> DataFrame:
    """Events with start <= t <= start + lookahead."""
    inside = F.col("t_ms").between(start_ms, start_ms + lookahead_ms)
    if tokenizable_only and "tokenizable_event" in flow.columns:
        inside = inside & F.col("tokenizable_event")
    return flow.filter(inside)


def context_window(flow: DataFrame, second: int, n: int, required: DataFrame | None = None) -> DataFrame:
    """The last n events of each security up to its last row stamped in exactly that second.

    Fails where a key of `required` has no row in that second; without it, where no key has one.
    """
    if n <= 0:
        raise ValueError("the window must be positive")
    ends = stage(flow.filter(div(F.col("t_ms"), 1000) == second).groupBy(*BY).agg(F.max("row_seq").alias("_end")), "window-ends")
    missing = ends.limit(1).count() == 0 if required is None else required.select(*BY).distinct().join(ends, list(BY), "left_anti").first()
    if missing:
        raise ValueError(f"no event is stamped in second {second}" + (f" for {missing['security_id']}" if required is not None else ""))
    return flow.join(ends, list(BY)).filter(
        (F.col("row_seq") <= F.col("_end")) & (F.col("row_seq") > F.col("_end") - n)).drop("_end")


def time_pairs(seconds: DataFrame, delta_s: int, by: Sequence[str] = BY, on: str = "t_sec") -> DataFrame:
    """Pairs of present times exactly `delta_s` apart."""
    times = seconds.select(*by, on).distinct()
    later = times.select(*by, (F.col(on) - delta_s).alias(on), F.col(on).alias("t1"))
    return times.join(later, [*by, on]).select(*by, F.col(on).alias("t0"), "t1")
