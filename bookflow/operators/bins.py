"""Bins, tokens and their decoding."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Generator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookflow.functions import PRIME, div, edge_bin, literal_edges, toss
from bookflow.operators import ordered
from bookflow.operators.flow import BY, SIDES_5
from bookflow.operators.ordered import asof_backward, chunk_of, over_values, running, value_chunks
from bookflow.session import stage

FIELDS = {"price": "price_diff", "qty": "order_qty", "interval": "interval_ms"}


# Fitting ----------------------------------------------------------------------------------------------------

def fit_bins(df: DataFrame, field: str, bins: int) -> list[float]:
    """Edges of about equally filled bins; values heavier than an average bin get a bin of their own."""
    return fit_edges(df.select(F.lit(field).alias("field"), F.col(field).cast("double").alias("value")), {field: bins})[field]


def fit_edges(values: DataFrame, bins: Mapping[str, int]) -> dict[str, list[float]]:
    """Edges of each field of (field, value) rows, NULLs left out; all fields together.

    Everything is decided on the histogram of distinct values. Fewer than `bins` values can be heavier than an average bin, and the walk over the
    rest asks fewer than three times a bin which value stands at a position. Positions are found in a directory of cumulative counts: one row a
    chunk on the driver (at most CUTS a field), and under it the staged table, of which one chunk a field is read. Fields walk in step, so a round
    is one job, or none where the chunks are at hand.
    """
    hist = stage(values.filter(F.col("value").isNotNull()).groupBy("field", F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "histograms")
    totals = {r["field"]: r for r in hist.groupBy("field").agg(F.sum("_n").alias("n"), F.min("_v").alias("low")).collect()}
    for field in bins:
        if field not in totals:
            raise ValueError(f"no values in {field}")
    share = F.lit(None).cast("double")
    for field, n in bins.items():
        share = F.when(F.col("field") == field, totals[field]["n"] / n).otherwise(share)
    heavy: dict[str, list[float]] = {f: [] for f in bins}
    for r in hist.filter(F.col("_n") > share).orderBy(F.desc("_n"), "_v").collect():
        heavy[r["field"]].append(r["_v"])
    heavy = {f: h[:bins[f] - 1] if len(h) >= bins[f] else h for f, h in heavy.items()}
    alone = F.lit(False)
    for field, found in heavy.items():
        if found:
            alone |= (F.col("field") == field) & F.col("_v").isin(*found)
    places = Directory(hist.filter(~alone))
    walks = {f: _walk(places.size(f), bins[f] - len(heavy[f])) for f in bins}
    walked: dict[str, list[float]] = {}
    asked: dict[str, int] = {}

    def advance(field: str, answer) -> None:
        try:
            asked[field] = walks[field].send(answer)
        except StopIteration as end:
            asked.pop(field, None)
            walked[field] = end.value

    for field in bins:
        advance(field, None)
    while asked:
        for field, answer in places.find(dict(asked)).items():
            advance(field, answer)
    out = {}
    for field, n in bins.items():
        low = totals[field]["low"]
        edges = [low - 1 if low in heavy[field] else low, *heavy[field], *walked[field]]
        if len(edges) != n + 1:
            raise ValueError(f"{field}: {len(edges)} edges instead of {n + 1}")
        out[field] = sorted(float(e) for e in edges)
    return out


class Directory:
    """Positions in the sorted values of fields, from their histogram (field, _v, _n)."""

    def __init__(self, hist: DataFrame):
        chunked = value_chunks(hist, ["field"], "_v")
        self.table = stage(running(chunked, ["field"], ["_v"], F.col("_vc"), sums={"_end": F.col("_n")}), "positions")
        tops = self.table.groupBy("field", "_vc").agg(F.max("_end").alias("end")).orderBy("field", "end").collect()
        self.tops: dict[str, list[tuple[int, int]]] = {}
        for r in tops:
            self.tops.setdefault(r["field"], []).append((int(r["end"]), r["_vc"]))
        self.held: dict[str, tuple[int, list[int], list[float]]] = {}

    def size(self, field: str) -> int:
        return self.tops[field][-1][0] if field in self.tops else 0

    def find(self, positions: Mapping[str, int]) -> dict[str, tuple[float, int]]:
        """The value at a position of each field, and the first position after that value. One chunk a field is held."""
        want = {f: self.tops[f][bisect_right([end for end, _ in self.tops[f]], p)][1] for f, p in positions.items()}
        missing = {f: c for f, c in want.items() if self.held.get(f, (None,))[0] != c}
        if missing:
            here = F.lit(False)
            for field, chunk in missing.items():
                here |= (F.col("field") == field) & (F.col("_vc") == chunk)
                self.held[field] = (chunk, [], [])
            for r in self.table.filter(here).select("field", "_end", "_v").orderBy("_end").collect():
                self.held[r["field"]][1].append(int(r["_end"]))
                self.held[r["field"]][2].append(float(r["_v"]))
        out = {}
        for field, p in positions.items():
            _, ends, values = self.held[field]
            at = bisect_right(ends, p)
            out[field] = (values[at], ends[at])
        return out


def _walk(size: int, budget: int) -> Generator[int, tuple[float, int], list[float]]:
    """Edges of the values that have no bin of their own; yields positions and is sent what stands there."""
    at, edges = 0, []
    here = (yield 0) if size and budget > 0 else None
    while budget > 0 and at < size:
        target = at + ((size - at) // (budget - 1) if budget > 1 else size - at)
        if target < here[1]:  # still the value that this bin begins with
            target = here[1]
        at = min(target, size - 1)
        here = yield at
        edges.append(here[0])
        budget -= 1
    return edges


def fit_bins_pooled(days: Sequence[DataFrame], bins: Mapping[str, int], sides: Sequence[int]) -> dict[str, list[float]]:
    """Edges per field from the rows of all days whose side is tokenised."""
    from bookflow.operators.flow import pool

    rows = pool(*days).filter(F.col("side").isin(*sides))
    stacked = F.array(*[F.struct(F.lit(name).alias("field"), F.col(FIELDS[name]).cast("double").alias("value")) for name in bins])
    return fit_edges(rows.select(F.inline(stacked)), bins)


def edges_table(spark: SparkSession, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([(k, [float(e) for e in v]) for k, v in edges.items()], "field string, edges array<double>")


def apply_bins(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Add <field>_bin for each field."""
    return df.withColumns({f"{name}_bin": edge_bin(F.col(FIELDS.get(name, name)).cast("double"), literal_edges(e))
                           for name, e in edges.items()})


def bin_distribution(binned: DataFrame, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """Values found in each bin: field, bin, value, count, prob, n_unique, total_count."""
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_bin").alias("bin"),
                                 F.col(FIELDS.get(f, f)).cast("double").alias("value")) for f in fields])
    counts = binned.select(F.inline(stacked)).filter("value IS NOT NULL").groupBy("field", "bin", "value").agg(
        F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("field", "bin").agg(F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("n_unique"))
    return counts.join(totals, ["field", "bin"]).withColumn("prob", F.col("count") / F.col("total_count"))


# Tokens -----------------------------------------------------------------------------------------------------

def encode_token(binned: DataFrame, radices: tuple[int, int, int], sides: Mapping[int, int] = SIDES_5) -> DataFrame:
    """Mixed-radix token of (price, qty, interval, side) bins; rows with an unknown side or a missing bin get NULL.

    A bin outside its radix is an error, not a wrong token.
    """
    n_price, n_qty, n_interval = radices
    side = F.lit(None).cast("int")
    for code, digit in sides.items():
        side = F.when(F.col("side") == code, digit).otherwise(side)
    checked = lambda c, n: F.when(F.col(c).between(0, n - 1), F.col(c)).when(
        F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} outside 0..{n - 1}")).cast("int")).cast("long")
    digits = F.col("side_bin").cast("long")
    token = ((checked("price_bin", n_price) * n_qty + checked("qty_bin", n_qty)) * n_interval
             + checked("interval_bin", n_interval)) * len(sides) + digits
    out = binned.withColumn("side_bin", side).withColumn("order_token", token)
    return out.withColumn("tokenizable_event", F.col("order_token").isNotNull())


def decode_token(token: Column, radices: tuple[int, int, int], n_side: int) -> dict[str, Column]:
    _, n_qty, n_interval = radices
    rest = div(token, n_side)
    return {"side_bin": (token % n_side).cast("int"), "interval_bin": (rest % n_interval).cast("int"),
            "qty_bin": (div(rest, n_interval) % n_qty).cast("int"), "price_bin": div(rest, n_interval * n_qty).cast("int")}


def fallback_value(low: float, high: float) -> float:
    """The only integer in (low, high], else the rounded midpoint (half-even)."""
    first, last = int(np.floor(low)) + 1, int(np.floor(high))
    return float(first) if first == last else float(np.rint(0.5 * (low + high)))


def decode_flow(tokens: DataFrame, edges: Mapping[str, Sequence[float]], distribution: DataFrame, n_side: int, *,
                method: str = "mode", seed: int = 42, anchor: str = "open", start_ms: int = 0, exact: Sequence[str] = (),
                by: Sequence[str] = BY) -> DataFrame:
    """Decode a token table (by, row_seq, order_token, and an `anchor_bid_tick` or `mid_tick`) to events.

    Each bin gives its most frequent value ('mode', the smaller on ties) or a seeded draw from its
    values ('sample'), quantities at least 1 and intervals at least 0; bins without values give
    `fallback_value`. Times are running sums of intervals. `anchor='mid'` moves a zero offset to the
    own side and rounds half ticks away from zero. `exact` fields are taken from the row where present.
    """
    radices = tuple(len(edges[f]) - 1 for f in FIELDS)
    rows = tokens.withColumns(decode_token(F.col("order_token"), radices, n_side))
    floors = {"price": None, "qty": 1.0, "interval": 0.0}
    empty = {f: literal_edges([fallback_value(lo, hi) for lo, hi in zip(edges[f], edges[f][1:])]) for f in FIELDS}
    picked = _modes(rows, distribution, edges) if method == "mode" else _draws(rows, distribution, edges, seed, by)
    values = {}
    for f in FIELDS:
        value = F.rint(F.coalesce(F.col(f"_{f}"), empty[f][F.col(f"{f}_bin")]))
        values[f] = value if floors[f] is None else F.greatest(F.lit(floors[f]), value)
    ticks, qty = values["price"], values["qty"].cast("long")
    if anchor == "mid":
        ticks = F.when((ticks == 0) & (F.col("side_bin") == 0), F.lit(-1.0)).when(
            (ticks == 0) & (F.col("side_bin") == 1), F.lit(1.0)).otherwise(ticks)
        price = F.rint(F.col("mid_tick") + F.signum(ticks) * F.ceil(F.abs(ticks) / 2))
    else:
        price = F.rint(F.col("anchor_bid_tick") + ticks)
    if "price" in exact:
        price = F.coalesce(F.col("exact_price_tick"), price)
    if "qty" in exact:
        qty = F.coalesce(F.col("exact_qty"), qty)
    out = picked.withColumns({"dt_ms": values["interval"].cast("long"), "offset": ticks.cast("long")}).withColumns(
        {"qty": qty, "price_tick": price.cast("long")})
    timed = running(out, by, ["row_seq"], chunk_of("row_seq"), sums={"_elapsed": F.col("dt_ms")})
    return timed.select(*by, "row_seq", (F.col("_elapsed") + start_ms).cast("long").alias("t_ms"), "dt_ms", "side_bin",
                        "offset", "price_tick", "qty")


def _modes(rows: DataFrame, distribution: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Most frequent value of each bin; at most one row per bin reaches the driver."""
    best = distribution.groupBy("field", "bin").agg(
        F.max_by("value", F.struct("count", (-F.col("value")).alias("v"))).alias("value")).collect()
    table = {(r["field"], r["bin"]): r["value"] for r in best}
    cols = {}
    for f in FIELDS:
        modes = F.array(*[F.lit(table.get((f, b))).cast("double") for b in range(len(edges[f]) - 1)])
        cols[f"_{f}"] = modes[F.col(f"{f}_bin")]
    return rows.withColumns(cols)


def _draws(rows: DataFrame, distribution: DataFrame, edges: Mapping[str, Sequence[float]], seed: int,
           by: Sequence[str]) -> DataFrame:
    """A position in the bin's sorted values is drawn from (seed, row_seq, field) by whole numbers and looked up in the cumulative table.

    A table of at most CHUNK rows goes to the tasks, and no row is moved; a larger one is joined in order.
    """
    totals = {(r["field"], r["bin"]): r["n"] for r in distribution.groupBy("field", "bin").agg(F.sum("count").alias("n")).collect()}
    cum = stage(over_values(distribution, ["field", "bin"], "value", sums={"_end": F.col("count")}).select(
        "field", F.col("bin").cast("int").alias("bin"), (F.col("_end") - F.col("count")).cast("long").alias("_at"), "value"), "draw-places")
    asks = {}
    for number, f in enumerate(FIELDS):
        sizes = F.array(*[F.lit(totals.get((f, b))).cast("long") for b in range(len(edges[f]) - 1)])
        size = sizes[F.col(f"{f}_bin")]
        asks[f] = F.when(F.col("order_token").isNotNull(), div(toss(toss(F.col("row_seq") + seed * 104_729 + number * 1_299_709)) * size, PRIME))
    if cum.count() <= ordered.CHUNK:
        return rows.withColumns({f"_{f}": _looked_up(cum.filter(F.col("field") == f), totals, f, len(edges[f]) - 1, at) for f, at in asks.items()})
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_bin").alias("bin"), at.alias("_at")) for f, at in asks.items()])
    slim = rows.select(*by, "row_seq", F.inline(stacked)).filter("_at IS NOT NULL")
    found = asof_backward(slim, cum, ["field", "bin"], "_at", ["value"], bucket=1 << 16)
    wide = found.groupBy(*by, "row_seq").agg(*[
        F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in FIELDS])
    return rows.join(wide, [*by, "row_seq"], "left")


def _looked_up(places: DataFrame, totals: Mapping[tuple[str, int], int], field: str, n_bins: int, at: Column) -> Column:
    """Value at position `at` of the row's bin; the places of a field's bins lie one after another."""
    starts = np.concatenate([[0], np.cumsum([int(totals.get((field, b)) or 0) for b in range(n_bins)])]).astype(np.int64)
    table = sorted((int(starts[r["bin"]]) + r["_at"], r["value"]) for r in places.collect())
    firsts, values = np.array([p for p, _ in table], np.int64), np.array([v for _, v in table], np.float64)

    def find(pos: pd.Series) -> pd.Series:
        where = pos.to_numpy()
        out = np.full(len(where), np.nan)
        hit = where >= 0
        out[hit] = values[np.searchsorted(firsts, where[hit], "right") - 1]
        return pd.Series(out)

    pos = F.coalesce(F.array(*[F.lit(int(x)) for x in starts[:-1]]).cast("array<bigint>")[F.col(f"{field}_bin")] + at, F.lit(-1).cast("long"))
    return F.nanvl(F.pandas_udf(find, "double")(pos), F.lit(None).cast("double"))


def top_tokens(flow: DataFrame, k: int, token: str = "order_token") -> DataFrame:
    """The k most frequent tokens; ties by token."""
    return flow.filter(F.col(token).isNotNull()).groupBy(token).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), token).limit(k)
