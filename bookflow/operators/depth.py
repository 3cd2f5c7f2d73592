"""Depth of the book from the event flow.

Posts add to their price level; cancels and executions remove at most what rests there. No order
matching takes place: each level is a running sum clamped at zero.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from bookflow.functions import ASK, BID, TICK_INT
from bookflow.operators.flow import BY
from bookflow.operators.ordered import chunk_of, spread

REMOVALS = {"cancel": (97, 98, 99), "execute": (129, 130)}


def opening_depth(levels: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Snapshot `levels` (array of ask_p, ask_v, bid_p, bid_v in ticks) to (by, book_side, price_tick, depth)."""
    side = lambda name, p, v: F.transform("levels", lambda lv: F.struct(
        F.lit(name).alias("book_side"), lv[p].alias("price_tick"), lv[v].alias("depth")))
    rows = levels.select(*by, F.inline(F.concat(side("ask", "ask_p", "ask_v"), side("bid", "bid_p", "bid_v"))))
    return rows.filter("price_tick IS NOT NULL AND depth > 0").groupBy(*by, "book_side", "price_tick").agg(F.sum("depth").alias("depth"))


def depth_events(flow: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Signed changes per event; `kind_of` is post, cancel or execute. Removals without an original side have no book side."""
    kind = F.when(F.col("side").isin(BID, ASK), "post").when(F.col("side").isin(*REMOVALS["cancel"]), "cancel").when(
        F.col("side").isin(*REMOVALS["execute"]), "execute")
    owner = F.when(F.col("side").isin(BID, ASK), F.col("side")).otherwise(F.col("orig_side"))
    return flow.select(
        *by, "row_seq", "t_ms", "side", F.col("order_qty").alias("qty"), "price_tick", kind.alias("kind_of"),
        F.when(owner == BID, "bid").when(owner == ASK, "ask").alias("book_side"),
    ).filter("kind_of IS NOT NULL AND qty > 0")


def _starts(ends: DataFrame, opening: DataFrame | None, level: Sequence[str]) -> DataFrame:
    """Add `_d0`, the depth of a level at the start of each of its chunks, to one row (`_sum`, `_low`) per level and chunk."""
    across = W.partitionBy(*level).orderBy("_chunk")
    carried = ends.withColumn("_t", F.sum("_sum").over(across.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "_lift", F.max(F.col("_sum") - F.col("_low") - F.col("_t")).over(across.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "_t0", F.col("_t") - F.col("_sum"))
    if opening is not None:
        carried = carried.join(opening.select(*level, F.col("depth").alias("_open")), level, "left")
    else:
        carried = carried.withColumn("_open", F.lit(0))
    start = F.greatest(F.coalesce("_open", F.lit(0)), F.coalesce("_lift", F.coalesce("_open", F.lit(0)))) + F.col("_t0")
    return carried.withColumn("_d0", start.cast("long"))


def level_depth(flow: DataFrame, opening: DataFrame | None = None, by: Sequence[str] = BY, keep_aside: bool = False) -> DataFrame:
    """Depth of the event's own level before and after it, and the quantity removed.

    d[t] = max(0, d[t-1] + x) is the running sum lifted by its running minimum, so windows suffice. A
    level is cut into chunks of the sequence; a chunk enters later ones as (sum, lift) only.

    Removals without an original side belong to no level. They are left out; with `keep_aside` they are rows without side and depth that remove
    nothing, which `set_aside` counts.
    """
    level = [*by, "book_side", "price_tick"]
    events = depth_events(flow, by) if keep_aside else depth_events(flow, by).filter("book_side IS NOT NULL")
    keyed = events.withColumns({
        "_chunk": chunk_of("row_seq"), "_x": F.when(F.col("kind_of") == "post", F.col("qty")).otherwise(-F.col("qty"))})
    keyed = spread(keyed, flow.count(), *level, "_chunk")
    inside = W.partitionBy(*level, "_chunk").orderBy("row_seq")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    local = keyed.withColumn("_s", F.sum("_x").over(so_far)).withColumn("_m", F.min("_s").over(so_far))
    ends = local.groupBy(*level, "_chunk").agg(F.max_by("_s", "row_seq").alias("_sum"), F.min("_m").alias("_low"))
    begin = _starts(ends, opening, level).select(*level, "_chunk", "_d0")
    after = F.greatest(F.col("_d0") + F.col("_s"), F.col("_s") - F.col("_m"))
    if keep_aside:
        after = F.when(F.col("book_side").isNotNull(), after)
    out = local.join(begin, [*level, "_chunk"], "left" if keep_aside else "inner").withColumn("depth_after", after)
    before = F.coalesce(F.lag("depth_after").over(inside), F.col("_d0"))
    out = out.withColumn("depth_before", before)
    removed = F.when((F.col("kind_of") == "post") | F.col("book_side").isNull(), F.lit(0)).otherwise(F.col("depth_before") - F.col("depth_after"))
    return out.select(*by, "row_seq", "t_ms", "side", "kind_of", "book_side", "price_tick", "qty", "depth_before",
                      "depth_after", removed.cast("long").alias("removed"))


def set_aside(depth: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Removals of `level_depth(..., keep_aside=True)` that belong to no side: events and their quantity, per key and kind."""
    return depth.filter("book_side IS NULL").groupBy(*by, "kind_of").agg(F.count(F.lit(1)).alias("events"), F.sum("qty").alias("qty"))


def removed_qty(depth: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Removals of a side, and how many of them found nothing, per key and kind."""
    return depth.filter("kind_of <> 'post' AND book_side IS NOT NULL").groupBy(*by, "kind_of").agg(
        F.count(F.lit(1)).alias("events"), F.sum("removed").alias("removed_qty"),
        F.sum((F.col("removed") <= 0).cast("long")).alias("unmatched"))


def to_messages(depth: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Message rows: 1 post, 3 full / 2 partial cancel, 4 execution; removals of nothing are left out.

    The synthetic order id counts the kept messages of a key.
    """
    from bookflow.operators.ordered import dense_index

    kept = depth.filter("book_side IS NOT NULL AND (kind_of = 'post' OR removed > 0)")
    kind = F.when(F.col("kind_of") == "post", 1).when(F.col("kind_of") == "execute", 4).when(
        F.col("removed") >= F.col("qty"), 3).otherwise(2)
    own = F.when(F.col("book_side") == "bid", 1).otherwise(-1)
    direction = F.when(F.col("kind_of") == "execute", -own).otherwise(own)
    numbered = dense_index(kept, by, ["row_seq"], chunk_of("row_seq"), "_id")
    return numbered.select(
        *by, "row_seq", (F.col("t_ms") / 1000).alias("time"), kind.alias("event_type"), (F.col("_id") + 1).alias("order_id"),
        F.when(F.col("kind_of") == "post", F.col("qty")).otherwise(F.col("removed")).alias("size"),
        (F.col("price_tick") * TICK_INT).alias("price"), direction.alias("direction"))


CELLS = 1 << 22


def tops(price: np.ndarray, size: np.ndarray, opening: int, n: int, falling: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best n levels of one side: price, size and whether there is one, before its first event and after each.

    The first `opening` rows are levels open at the start, the others set their level to a size, in order. Blocks of events by all prices of the side
    are filled forward, and the occupied levels numbered from the best; a block has at most CELLS cells.
    """
    ladder = np.unique(price)[::-1 if falling else 1]
    code = len(ladder) - 1 - np.searchsorted(ladder[::-1], price) if falling else np.searchsorted(ladder, price)
    events = len(price) - opening
    prices, sizes, found = np.zeros((events + 1, n), np.int64), np.zeros((events + 1, n), np.int64), np.zeros((events + 1, n), bool)
    state = np.zeros(len(ladder), np.int64)
    state[code[:opening]] = size[:opening]
    block = max(1, CELLS // max(1, len(ladder)))
    for lo in range(0, events + 1, block):
        rows = np.arange(lo, min(lo + block, events + 1))  # states; state k follows event k - 1
        last = np.full((len(rows), len(ladder)), -1, np.int32)
        real = rows > 0
        row_of = opening + rows[real] - 1
        last[np.flatnonzero(real), code[row_of]] = row_of
        np.maximum.accumulate(last, axis=0, out=last)
        now = np.where(last >= 0, size[last], state)
        rank = np.cumsum(now > 0, axis=1)
        r, c = np.nonzero((now > 0) & (rank <= n))
        slot = rank[r, c] - 1
        prices[lo + r, slot], sizes[lo + r, slot], found[lo + r, slot] = ladder[c], now[r, c], True
        state = now[-1]
    return prices, sizes, found


def book_after(depth: DataFrame, n: int, opening: DataFrame | None = None, by: Sequence[str] = BY,
               grid_ms: int | None = None, rows: int = 0) -> DataFrame:
    """Top-n book after every event, or after the last event of every grid interval. From a flow, `book_of_flow` needs one shuffle less.

    Levels open at the start of a chunk are found with windows (one row per level and chunk); the
    events of a chunk, a bounded number, are then filled forward over them as arrays (`tops`). `rows`, where known, is the number of
    events: large tables are dealt to more tasks (`spread`).
    """
    level = [*by, "book_side", "price_tick"]
    events = depth.filter("book_side IS NOT NULL").withColumn("_chunk", chunk_of("row_seq"))
    closes = events.groupBy(*level, "_chunk").agg(F.max_by("depth_after", "row_seq").alias("depth"))
    opens = _open_levels(closes, opening, events.groupBy(*by).agg(F.max("_chunk").alias("_last")), by)
    stream = events.select(*by, "_chunk", "row_seq", "t_ms", "book_side", "price_tick", F.col("depth_after").alias("depth")).unionByName(
        opens.select(*by, "_chunk", F.lit(-1).cast("long").alias("row_seq"), F.lit(None).cast("long").alias("t_ms"),
                     "book_side", "price_tick", F.col("depth").cast("long").alias("depth")))
    stream = spread(stream, rows, *by, "_chunk")
    names = _names(n)

    def replay(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("row_seq")
        seq, price, size = (part.column(c).to_numpy() for c in ("row_seq", "price_tick", "depth"))
        asks = pc.equal(part.column("book_side"), "ask").to_numpy()
        first = int(np.searchsorted(seq, 0))  # levels open at the start have no sequence number
        out = {c: pa.array([key[i].as_py()] * (len(seq) - first), part.schema.field(c).type) for i, c in enumerate(by)}
        out |= {"row_seq": part.column("row_seq").slice(first), "t_ms": part.column("t_ms").slice(first)}
        cols = {}
        for side, mine in (("ask", asks), ("bid", ~asks)):
            at = np.flatnonzero(mine)
            prices, sizes, found = tops(price[at], size[at], int((at < first).sum()), n, side == "bid")
            _put(cols, side, prices, sizes, found, np.cumsum(mine[first:]))
        table = pa.table(out | {c: cols[c] for c in names})
        if grid_ms is None or not table.num_rows:
            return table
        _, back = np.unique((table.column("t_ms").to_numpy() // grid_ms)[::-1], return_index=True)
        return table.take(pa.array(np.sort(table.num_rows - 1 - back)))

    flat = stream.groupBy(*by, "_chunk").applyInArrow(replay, _book_schema(stream.select(*by).schema.fields, names))
    return _book(flat, n, by, grid_ms)


def _open_levels(closes: DataFrame, opening: DataFrame | None, last: DataFrame, by: Sequence[str]) -> DataFrame:
    """Levels with depth at the start of each chunk, from their depth at the end of the chunks in which they change; `last` names the last chunk of a key."""
    level = [*by, "book_side", "price_tick"]
    if opening is not None:
        closes = closes.unionByName(opening.select(*level, F.lit(-1).cast("long").alias("_chunk"), "depth"))
    following = F.lead("_chunk").over(W.partitionBy(*level).orderBy("_chunk"))
    spans = closes.withColumn("_next", following).join(last, list(by)).withColumn(
        "_until", F.coalesce("_next", "_last")).filter("depth > 0 AND _until > _chunk")
    return spans.select(*level, "depth", F.explode(F.sequence(F.col("_chunk") + 1, F.col("_until"))).alias("_chunk"))


def _names(n: int) -> list[str]:
    return [f"{s}_{x}_{i}" for i in range(1, n + 1) for s, x in (("ask", "p"), ("ask", "v"), ("bid", "p"), ("bid", "v"))]


def _book_schema(key_fields: Sequence, names: Sequence[str]) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields] + ["row_seq long", "t_ms long"] + [f"{c} long" for c in names])


def _put(cols: dict, side: str, prices: np.ndarray, sizes: np.ndarray, found: np.ndarray, state: np.ndarray) -> None:
    """Columns of one side from the `tops` in force at each row."""
    for i in range(prices.shape[1]):
        absent = ~found[state, i]
        cols[f"{side}_p_{i + 1}"] = pa.array(prices[state, i], mask=absent)
        cols[f"{side}_v_{i + 1}"] = pa.array(sizes[state, i], mask=absent)


def _book(flat: DataFrame, n: int, by: Sequence[str], grid_ms: int | None) -> DataFrame:
    """Flat columns to levels; with a grid, chunks have given their last row of each interval and the last of these stays."""
    names = _names(n)
    if grid_ms is not None:
        slot = F.floor(F.col("t_ms") / grid_ms)
        flat = flat.groupBy(*by, slot.alias("_slot")).agg(F.max_by(F.struct("row_seq", "t_ms", *names), "row_seq").alias("_r")).select(*by, "_r.*")
    levels = F.array(*[F.struct(*[F.col(f"{s}_{x}_{i}").alias(f"{s}_{x}") for s, x in (("ask", "p"), ("ask", "v"), ("bid", "p"), ("bid", "v"))])
                       for i in range(1, n + 1)])
    return flat.select(*by, "row_seq", "t_ms", levels.alias("levels"))


def _prefixes(level: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Events put level by level, in order: their places, the first place of each level, running sums and running minima of these."""
    order = np.argsort(level, kind="stable")
    first = np.flatnonzero(np.diff(level[order], prepend=level[order[0]] - 1)) if len(order) else order
    s = np.cumsum(x[order])
    sizes = np.diff(first, append=len(order))
    s -= np.repeat(s[first] - x[order][first], sizes)
    low = s.copy()
    for lo, n in zip(first, sizes):
        np.minimum.accumulate(s[lo:lo + n], out=low[lo:lo + n])
    return order, first, s, low


def book_of_flow(flow: DataFrame, n: int, opening: DataFrame | None = None, by: Sequence[str] = BY, grid_ms: int | None = None) -> DataFrame:
    """`book_after` of `level_depth`, for one shuffle of narrow events.

    The events of a chunk come together once and are read twice: first for the sum and the lowest running sum of each level, which windows over levels and
    chunks turn into the levels open at the start of a chunk, then for depths and the book after each event. With `grid_ms` a chunk gives only its last
    event of each interval. Tasks hold a bounded number of events (`spread`), whatever the size of the input.
    """
    level = [*by, "book_side", "price_tick"]
    signed = F.when(F.col("kind_of") == "post", F.col("qty")).otherwise(-F.col("qty"))
    events = depth_events(flow, by).dropna(subset=level).select(
        *by, chunk_of("row_seq").alias("_chunk"), F.col("row_seq").cast("long"), F.col("t_ms").cast("long"),
        (F.col("price_tick").cast("long") * 2 + (F.col("book_side") == "ask").cast("long")).alias("_level"), signed.cast("long").alias("_x"))
    dealt = spread(events, flow.count(), *by, "_chunk")
    group = [*by, "_chunk"]
    key_fields = dealt.select(*group).schema.fields
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields)

    def in_order(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        part = part.select(["row_seq", "t_ms", "_level", "_x"]).sort_by("row_seq")
        return part, part.column("_level").to_numpy(), part.column("_x").to_numpy()

    def of_key(key: tuple, rows: int, names: Sequence[str]) -> dict[str, pa.Array]:
        return {c: pa.repeat(k, rows) for c, k in zip(names, key)}

    def sums(key: tuple, part: pa.Table) -> pa.Table:
        _, code, x = in_order(part)
        order, first, s, low = _prefixes(code, x)
        last = np.append(first[1:], len(order)) - 1
        return pa.table(of_key(key, len(first), group) | {
            "_level": pa.array(code[order][first]), "_sum": pa.array(s[last]), "_low": pa.array(low[last])})

    ends = dealt.groupBy(*group).applyInArrow(sums, f"{key_schema}, _level long, _sum long, _low long").select(
        *group, F.when(F.col("_level") % 2 == 0, "bid").otherwise("ask").alias("book_side"), F.floor(F.col("_level") / 2).alias("price_tick"), "_sum", "_low")
    closes = _starts(ends, opening, level).select(
        *level, "_chunk", F.greatest(F.col("_d0") + F.col("_sum"), F.col("_sum") - F.col("_low")).alias("depth"))
    last = events.groupBy(*by).agg(F.max("_chunk").alias("_last"))
    opens = _open_levels(closes, opening, last, by).select(
        *group, (F.col("price_tick").cast("long") * 2 + (F.col("book_side") == "ask").cast("long")).alias("_level"), F.col("depth").cast("long").alias("_open"))
    names = _names(n)

    def replay(key: tuple, part: pa.Table, held: pa.Table) -> pa.Table:
        part, code, x = in_order(part)
        open_level, open_depth = held.column("_level").to_numpy(), held.column("_open").to_numpy()
        order, first, s, low = _prefixes(code, x)
        by_level = np.argsort(open_level)
        at = np.searchsorted(open_level[by_level], code[order])
        d0 = np.zeros(len(order), np.int64)
        if len(open_level):
            at = by_level[np.minimum(at, len(by_level) - 1)]
            d0 = np.where(open_level[at] == code[order], open_depth[at], 0)
        after = np.empty(len(order), np.int64)
        after[order] = np.maximum(d0 + s, s - low)
        seq, t_ms = part.column("row_seq").to_numpy(), part.column("t_ms").to_numpy()
        keep = np.arange(len(seq))
        if grid_ms is not None and len(seq):
            _, back = np.unique((t_ms // grid_ms)[::-1], return_index=True)
            keep = np.sort(len(seq) - 1 - back)
        cols = {}
        for side, odd in (("ask", 1), ("bid", 0)):
            mine, held_here = code % 2 == odd, open_level % 2 == odd
            prices, sizes, found = tops(np.append(open_level[held_here], code[mine]) // 2, np.append(open_depth[held_here], after[mine]),
                                        int(held_here.sum()), n, side == "bid")
            _put(cols, side, prices, sizes, found, np.cumsum(mine)[keep])
        return pa.table(of_key(key, len(keep), by) | {"row_seq": pa.array(seq[keep]), "t_ms": pa.array(t_ms[keep])} | {c: cols[c] for c in names})

    flat = dealt.groupBy(*group).cogroup(opens.groupBy(*group)).applyInArrow(replay, _book_schema(key_fields[:-1], names))
    return _book(flat, n, by, grid_ms)


def touch_after(depth: DataFrame, opening: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Best bid, best ask and mid (in ticks) after every event."""
    return touch(book_after(depth, 1, opening, by), by)


def touch(top: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Best bid, best ask and mid of every row of a book."""
    ask, bid = F.col("levels")[0]["ask_p"], F.col("levels")[0]["bid_p"]
    return top.select(*by, "row_seq", ask.alias("best_ask"), bid.alias("best_bid"), ((ask + bid) / 2).alias("mid"))

