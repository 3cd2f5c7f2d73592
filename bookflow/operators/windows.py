"""Event windows: context and target pairs, splits, thinning, and window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bookflow.functions import div
from bookflow.operators.flow import BY
from bookflow.operators.ordered import join_key_stats, over_neighbours

# Feature order of the window vectors.
DRAWS = 1_000_003  # values of the thinning rule, a prime
FEATURES = (
    "pm_mean", "pm_std", "pm_abs_mean", "log_interval_mean", "log_qty_mean", "frac_side_49", "frac_side_50",
    "frac_side_99", "frac_side_129", "frac_side_130", "mid_return", "tod_hour",
)
SIDES = (49, 50, 99, 129, 130)


def windows(flow: DataFrame, w: int, token: str = "order_token", by: Sequence[str] = BY) -> DataFrame:
    """Rows i..i+w-1 as an array and row i+w as the target, for every start that has a target."""
    build = lambda win: {"context": F.collect_list(token).over(win.rowsBetween(0, w - 1)), "target": F.lead(token, w).over(win)}
    rows = flow.select(*by, "row_seq", token)
    return over_neighbours(rows, by, build, after=w, rows=flow.count()).filter("target IS NOT NULL").select(
        *by, F.col("row_seq").alias("start"), "context", "target")


def grid_windows(state: DataFrame, context: int, stride: int, by: Sequence[str] = BY) -> DataFrame:
    """Starts i (every `stride`-th row) whose row i+context lies exactly `context` slots later.

    A key is one trade day on the slot grid, so its window is bounded.
    """
    win = W.partitionBy(*by).orderBy("slot")
    rows = state.select(*by, "slot", (F.row_number().over(win) - 1).alias("start"), F.lead("slot", context).over(win).alias("_end"))
    return rows.filter((F.col("start") % stride == 0) & (F.col("_end") - F.col("slot") == context)).select(*by, "start", "slot")


def split_ordered(rows: DataFrame, w: int = 0, by: Sequence[str] = BY, pos: str = "row_seq") -> DataFrame:
    """Add `split`: the first 60 % of the n - w starts are train, the next 20 % val, the rest test (floors).

    Rows that start no window (the last w) are dropped.
    """
    sizes = rows.groupBy(*by).agg((F.count(F.lit(1)) - w).alias("_n"))
    train = F.floor(F.lit(0.6) * F.col("_n"))
    val = F.floor(F.lit(0.2) * F.col("_n"))
    part = F.when(F.col(pos) < train, "train").when(F.col(pos) < train + val, "val").otherwise("test")
    return join_key_stats(rows, sizes, by).filter(F.col(pos) < F.col("_n")).withColumn("split", part).drop("_n")


def thin(rows: DataFrame, stride: int, share: float | None = None, seed: int = 42, by: Sequence[str] = BY, pos: str = "row_seq") -> DataFrame:
    """Every stride-th row, and of those about the given share, by a seeded rule on the position that needs no shuffle.

    The rule is integer arithmetic, so it gives the same rows on any partitioning and in any engine.
    """
    kept = rows.filter(F.col(pos) % max(1, stride) == 0)
    if share is None:
        return kept
    return kept.filter(((F.col(pos) % DRAWS) * 7_919 + seed * 104_729) % DRAWS < int(share * DRAWS))


def window_features(flow: DataFrame, w: int, stride: int = 1, *, train_only: bool = False, by: Sequence[str] = BY,
                    mid: str | None = None) -> DataFrame:
    """The 12 features of every window of w events (every `stride`-th start).

    Sums over a window are differences of prefix sums inside a chunk; ticks and side counts are summed
    as integers, so the standard deviation does not cancel. With `train_only` the starts are the
    first 60 % of the starts that have a following event.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    log = lambda c: F.log1p(F.greatest(zero(c), F.lit(0)).cast("double"))
    inputs: dict[str, Column] = {
        "pm": zero("price_diff"), "pm2": zero("price_diff") * zero("price_diff"), "pma": F.abs(zero("price_diff")),
        "iv": log("interval_ms"), "qy": log("order_qty"),
        **{f"s{s}": (F.coalesce(F.col("side"), F.lit(-1)) == s).cast("long") for s in SIDES},
    }
    rows = flow.select(*by, "row_seq", "t_ms", "price_diff", "interval_ms", "order_qty", "side", *([F.col(mid).cast("double").alias("_mid")] if mid else []))
    derive = {f"_{n}": c for n, c in inputs.items()} | ({} if mid else {"_mid": F.lit(None).cast("double")})
    prefix = lambda win: {f"_c{n}": F.sum(f"_{n}").over(win.rowsBetween(W.unboundedPreceding, 0)) for n in inputs}

    def ahead(win):
        ends = {f"_w{n}": F.lead(f"_c{n}", w - 1).over(win) - F.col(f"_c{n}") + F.col(f"_{n}") for n in inputs}
        return ends | {"_mid_end": F.lead("_mid", w - 1).over(win), "_full": F.lead(F.lit(1), w - 1).over(win)}

    starts = over_neighbours(rows, by, prefix, ahead, after=w - 1, rows=flow.count(), derive=derive).filter("_full = 1").filter(F.col("row_seq") % max(1, stride) == 0)
    if train_only:
        sizes = flow.groupBy(*by).agg(F.floor(F.lit(0.6) * (F.count(F.lit(1)) - w)).alias("_train"))
        starts = join_key_stats(starts, sizes, by).filter(F.col("row_seq") < F.col("_train"))
    n = F.lit(float(w))
    var = F.greatest(F.lit(0), F.lit(w) * F.col("_wpm2") - F.col("_wpm") * F.col("_wpm")) / (n * n)
    first = F.coalesce("_mid", F.lit(0.0))
    values = {
        "pm_mean": F.col("_wpm") / n, "pm_std": F.sqrt(var), "pm_abs_mean": F.col("_wpma") / n,
        "log_interval_mean": F.col("_wiv") / n, "log_qty_mean": F.col("_wqy") / n,
        **{f"frac_side_{s}": F.col(f"_ws{s}") / n for s in SIDES},
        "mid_return": F.when(first != 0, (F.coalesce("_mid_end", F.lit(0.0)) - first) / (F.abs(first) + 1e-9)).otherwise(F.lit(0.0)),
        "tod_hour": div(F.col("t_ms"), 3_600_000) + div(F.col("t_ms"), 60_000) % 60 / F.lit(60.0),
    }
    return starts.select(*by, F.col("row_seq").alias("start"), *[values[f].cast("double").alias(f) for f in FEATURES])


def train_windows(flow: DataFrame, w: int, stride: int, share: float | None = None, seed: int = 42, by: Sequence[str] = BY,
                  mid: str | None = None) -> DataFrame:
    """Features of the training windows, thinned."""
    return thin(window_features(flow, w, stride, train_only=True, by=by, mid=mid), 1, share, seed, by, "start")
