import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import bins, depth, flow as flows, ordered


def test_fit_bins_by_properties(spark):
    """So many edges as asked for; a heavy value is alone in its bin; the other bins are filled about evenly."""
    rng = random.Random(4)
    for n in (6, 12):
        values = [float(rng.choice([0, 0, 0, 1, rng.randint(0, 4000), rng.randint(0, 300)])) for _ in range(900)]
        edges = bins.fit_bins(spark.createDataFrame([(v,) for v in values], "x double"), "x", n)
        assert len(edges) == n + 1 and edges == sorted(edges) and edges[0] < min(values) + 1 and edges[-1] == max(values)
        heavy = {v for v, c in Counter(values).items() if c > len(values) / n}
        inside = [Counter(v for v in values if lo < v <= hi) for lo, hi in zip(edges, edges[1:])]
        assert heavy <= set(edges)
        light = [sum(c.values()) for c in inside if not heavy & set(c)]
        assert max(light) < 3 * sum(light) / len(light)


@pytest.mark.parametrize("values,n,edges", [([1, 2, 3, 4, 5, 6, 7, 8], 4, [1, 3, 5, 7, 8]), ([0] * 6 + [1, 2, 3, 4], 3, None)])
def test_fit_bins_small(spark, values, n, edges):
    got = bins.fit_bins(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", n)
    assert len(got) == n + 1 and (edges is None or len(got) == len(edges)) and got[0] <= min(values) and got[-1] == max(values)
    if edges is None:
        assert got[:2] == [-1.0, 0.0]  # the heavy minimum has a bin of its own


def test_fields_are_fitted_together(spark, small_chunks):
    """Several fields in step, over many chunks, give the edges of each alone; a chunk is read no more often than the walk enters it."""
    rng = random.Random(5)
    data = {"a": [float(rng.randint(0, 3000)) for _ in range(4000)], "b": [rng.random() for _ in range(2500)], "c": [float(rng.choice([0, 0, 0, 5, 7, 8])) for _ in range(300)]}
    rows = spark.createDataFrame([(f, v) for f, vs in data.items() for v in vs] + [("a", None)], "field string, value double")
    budget = {"a": 26, "b": 12, "c": 4}
    together = bins.fit_edges(rows, budget)
    for f, vs in data.items():
        assert together[f] == bins.fit_bins(spark.createDataFrame([(v,) for v in vs], "x double"), "x", budget[f])
        assert len(together[f]) == budget[f] + 1
    inside = Counter(int(np.searchsorted(together["b"], v, side="left")) for v in data["b"])
    assert max(inside[i] for i in range(1, 13)) < 1.2 * len(data["b"]) / 11


def test_constant_column_fails(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    with pytest.raises(ValueError):
        bins.fit_bins(df, "x", 4)


def test_edge_bins(spark):
    edges = {"x": [0.0, 1.0, 2.0, 3.0]}
    df = spark.createDataFrame([(-5.0,), (0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (9.0,), (None,)], "x double")
    assert [r["x_bin"] for r in bins.apply_bins(df, edges).collect()] == [0, 0, 0, 1, 1, 2, 2, 0]


def test_token_round_trip_and_range_check(spark):
    df = spark.createDataFrame([(p, q, i, s) for p in (0, 25) for q in (0, 7) for i in (0, 11) for s in (49, 50, 99, 129, 130, 7)],
                               "price_bin int, qty_bin int, interval_bin int, side long")
    out = bins.encode_token(df, (26, 26, 12))
    back = out.filter("tokenizable_event").select("price_bin", "qty_bin", "interval_bin", "side_bin", F.struct(*[
        c.alias(n) for n, c in bins.decode_token(F.col("order_token"), (26, 26, 12), 5).items()]).alias("d")).collect()
    assert len(back) == 40
    assert all((r["price_bin"], r["qty_bin"], r["interval_bin"], r["side_bin"]) == (r["d"]["price_bin"], r["d"]["qty_bin"], r["d"]["interval_bin"], r["d"]["side_bin"]) for r in back)
    assert out.filter("NOT tokenizable_event").count() == 8
    with pytest.raises(Exception, match="price_bin outside"):
        bins.encode_token(df.withColumn("price_bin", F.lit(26)), (26, 26, 12)).collect()


def test_sampled_values_stay_in_their_bin(spark, tables, small_chunks):
    from catalog.adapters import FIXED_EDGES
    from catalog.q_flow import RADIX, _decode

    out = _decode(tables, method="sample", seed=3)
    again = _decode(tables, method="sample", seed=3).select("trade_date", "security_id", "row_seq", F.struct("dt_ms", "offset", "qty").alias("b"))
    both = out.join(again, ["trade_date", "security_id", "row_seq"])
    assert both.filter("b.dt_ms <> dt_ms OR b.offset <> offset OR b.qty <> qty").count() == 0
    rebinned = bins.apply_bins(out.select("row_seq", "trade_date", "security_id", F.col("offset").alias("price_diff"), F.col("qty").alias("order_qty"), F.col("dt_ms").alias("interval_ms")), FIXED_EDGES)
    origin = tables.tokens.select("trade_date", "security_id", "row_seq", *[c.alias("o_" + n) for n, c in bins.decode_token(F.col("order_token"), RADIX, 5).items()])
    joined = rebinned.join(origin, ["trade_date", "security_id", "row_seq"])
    assert joined.filter("price_bin <> o_price_bin OR qty_bin <> o_qty_bin OR interval_bin <> o_interval_bin").count() == 0
    assert joined.count() == tables.tokens.count()


def test_fallback_value():
    assert bins.fallback_value(3.0, 4.0) == 4.0
    assert bins.fallback_value(0.0, 5.0) == 2.0
    assert bins.fallback_value(0.2, 0.9) == 1.0


def test_flow_has_residual_posts_and_matched_legs(tables):
    flow = tables.flow
    kinds = {r["event_semantic"]: r["n"] for r in flow.groupBy("event_semantic").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"post", "cancel", "transaction_complete"}
    assert flow.filter("event_semantic = 'post' AND (order_qty <= 0 OR order_qty <> residual_qty)").count() == 0
    assert flow.count() == flow.select("trade_date", "security_id", "row_seq").distinct().count()


def test_session_second_rule(spark):
    rows = spark.createDataFrame([(34_200_500,), (34_201_000,), (34_199_999,)], "t_ms long")
    assert [r["t_ms"] for r in flows.after_open(rows).collect()] == [34_201_000]


def test_missing_anchor_fails(spark):
    snaps = spark.createDataFrame([(1, "a", 34_260_000, 1, 10, 11)], "trade_date long, security_id string, t_ms long, snap_seq long, bid1 long, ask1 long")
    wanted = spark.createDataFrame([(1, "a"), (1, "b")], "trade_date long, security_id string")
    with pytest.raises(Exception, match="no snapshot in the anchor second"):
        flows.open_anchor(snaps, required=wanted).collect()


@pytest.mark.parametrize("opened", [False, True])
def test_depth_is_clamped(spark, small_chunks, opened):
    rng = random.Random(8)
    rows, want = [], {}
    book = {("bid", 10): 300} if opened else {}
    for i in range(500):
        side, kind = rng.choice([49, 50]), rng.choice(["post", "post", 99, 129])
        tick, qty = rng.choice([10, 11]), 100 * rng.randint(1, 4)
        name = "bid" if side == 49 else "ask"
        at = book.get((name, tick), 0)
        book[(name, tick)] = at + qty if kind == "post" else max(0, at - qty)
        want[i] = (at, book[(name, tick)])
        rows.append((1, "s", i, i * 10, side if kind == "post" else kind, side, qty, tick))
    flow = spark.createDataFrame(rows, "trade_date long, security_id string, row_seq long, t_ms long, side long, orig_side long, order_qty long, price_tick long")
    opening = spark.createDataFrame([(1, "s", "bid", 10, 300)], "trade_date long, security_id string, book_side string, price_tick long, depth long")
    out = depth.level_depth(flow, opening if opened else None)
    assert {r["row_seq"]: (r["depth_before"], r["depth_after"]) for r in out.collect()} == want


def test_removals_without_side_are_set_aside(spark):
    flow = spark.createDataFrame([(1, "s", 0, 0, 99, None, 5, 10)], "trade_date long, security_id string, row_seq long, t_ms long, side long, orig_side long, order_qty long, price_tick long")
    assert depth.level_depth(flow).count() == 0 and depth.depth_events(flow).filter("book_side IS NULL").count() == 1


@pytest.mark.parametrize("cells", [1, 13, 1 << 22])
def test_top_levels(cells, monkeypatch):
    """Best levels after each event against a book kept row by row, in blocks of any size."""
    monkeypatch.setattr(depth, "CELLS", cells)
    rng = random.Random(cells)
    for falling in (False, True):
        ladder = rng.sample(range(10, 40), 9)
        price = np.array(ladder[:4] + [rng.choice(ladder) for _ in range(120)])
        size = np.array([5, 6, 7, 8] + [rng.choice([0, 0, 3, 9]) for _ in range(120)])
        prices, sizes, found = depth.tops(price, size, 4, 3, falling)
        book = dict(zip(price[:4].tolist(), size[:4].tolist()))
        for k in range(121):
            if k:
                book[int(price[3 + k])] = int(size[3 + k])
            want = sorted((p for p, q in book.items() if q > 0), reverse=falling)[:3]
            assert [(prices[k, i], sizes[k, i]) for i in range(3) if found[k, i]] == [(p, book[p]) for p in want]


def test_context_window_needs_the_second(spark):
    flow = spark.createDataFrame([(1, "a", 0, 34_200_100), (1, "a", 1, 34_200_900), (1, "b", 0, 34_201_000)], "trade_date long, security_id string, row_seq long, t_ms long")
    assert flows.context_window(flow, 34_200, 5).count() == 2
    with pytest.raises(ValueError, match="second 34300"):
        flows.context_window(flow, 34_300, 5)
    with pytest.raises(ValueError, match="for b"):
        flows.context_window(flow, 34_200, 5, required=flow)


def test_removals_without_side_are_counted(spark):
    rows = [(1, "s", 0, 0, 49, 49, 500, 10), (1, "s", 1, 1, 99, None, 100, 10), (1, "s", 2, 2, 129, None, 30, 11), (1, "s", 3, 3, 99, 49, 200, 10), (1, "s", 4, 4, 99, None, 7, 10)]
    flow = spark.createDataFrame(rows, "trade_date long, security_id string, row_seq long, t_ms long, side long, orig_side long, order_qty long, price_tick long")
    out = depth.level_depth(flow, keep_aside=True)
    assert {(r["kind_of"], r["events"], r["qty"]) for r in depth.set_aside(out).collect()} == {("cancel", 2, 107), ("execute", 1, 30)}
    plain = depth.level_depth(flow)
    assert out.filter("book_side IS NOT NULL").exceptAll(plain).count() == 0 and plain.count() == 2
    assert depth.removed_qty(out).collect() == depth.removed_qty(plain).collect() and depth.to_messages(out).count() == 2
    assert depth.book_after(out, 2).count() == depth.book_after(plain, 2).count() == 2


def test_flow_sorts_in_bounded_tasks(spark, tables, monkeypatch):
    """Large flows are dealt to more tasks than the session names, chunk totals need no sort, and nothing that follows from other columns is moved."""
    cols = [*flows.BY, "row_seq", "t_ms", "order_qty", "side", "price_diff", "interval_ms", "event_semantic", "post_qty", "aggressive"]
    want = sorted(map(tuple, tables.flow.select(*cols).collect()))
    monkeypatch.setattr(ordered, "TASK_ROWS", 500)
    flow = flows.build_flow(tables.posts, tables.txns, tables.snaps)
    assert sorted(map(tuple, flow.select(*cols).collect())) == want
    plan = flow._jdf.queryExecution().executedPlan().toString()
    parts = [int(n) for n in re.findall(r"hashpartitioning\(trade_date[^)]*_chunk[^)]*, (\d+)\), REPARTITION", plan)]
    assert parts and min(parts) * 500 >= len(want)
    assert "SortAggregate" not in plan and "post_qty" not in plan.split("Exchange", 1)[1]


def test_draws_move_no_rows(spark, tables, monkeypatch):
    """A small table of values goes to the rows; a large one is joined in order and gives the same draws."""
    from catalog.q_flow import _token_table, _dist_table
    from catalog.adapters import FIXED_EDGES

    rows = _token_table(tables).withColumns(bins.decode_token(F.col("order_token"), tuple(len(FIXED_EDGES[f]) - 1 for f in bins.FIELDS), 5))
    draws = lambda: bins._draws(rows, _dist_table(tables), FIXED_EDGES, 3, flows.BY).select(*flows.BY, "row_seq", *[f"_{f}" for f in bins.FIELDS])
    near = draws()
    assert "_at" not in near.columns and "rangepartitioning" not in (plan := near._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan
    want = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(ordered, "CHUNK", 37)
    assert sorted(map(tuple, draws().collect())) == want


def _book_case(spark):
    from bookflow.operators import depth

    rows, seed = [], 7
    for key, n in (("a", 211), ("b", 40)):
        for i in range(n):
            seed = (seed * 1103515245 + 12345) % 2**31
            side = (49, 50, 99, 129)[seed // 7 % 4]
            rows.append((1, key, i, 1000 * (i // 3), side, (49, 50)[seed // 31 % 2] if side > 50 else side, 100 + seed // 101 % 6, 1 + seed // 1009 % 5))
    flow = spark.createDataFrame(rows, "trade_date long, security_id string, row_seq long, t_ms long, side long, orig_side long, price_tick long, order_qty long")
    opening = spark.createDataFrame([(1, "a", "bid", 103, 4), (1, "a", "ask", 109, 2), (1, "b", "ask", 90, 1)],
                                    "trade_date long, security_id string, book_side string, price_tick long, depth long")
    return depth, flow, opening


@pytest.mark.parametrize("grid_ms", [None, 10_000])
def test_book_of_flow_equals_book_of_depth(spark, small_chunks, grid_ms):
    depth, flow, opening = _book_case(spark)
    for start in (opening, None):
        one = depth.book_of_flow(flow, 3, start, grid_ms=grid_ms)
        two = depth.book_after(depth.level_depth(flow, start), 3, start, grid_ms=grid_ms)
        assert one.count() == two.count() > 0
        assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_grid_book_rows_leave_a_chunk_once_per_interval(spark, small_chunks, monkeypatch):
    """The interval is closed inside the chunk: no more wide rows are sorted than intervals, whatever the number of events."""
    depth, flow, opening = _book_case(spark)
    seen = []
    monkeypatch.setattr(depth, "_book", lambda flat, *rest: seen.append(flat.count()) or flat)
    depth.book_of_flow(flow, 1, opening, grid_ms=10_000)
    depth.book_after(depth.level_depth(flow, opening), 1, opening, grid_ms=10_000)
    assert max(seen) <= 22 + 2 + 6  # 211 and 40 events in threes, ten seconds to an interval, cut into chunks of 37
    assert min(seen) > 0


def test_large_flows_are_dealt_to_bounded_tasks(spark, small_chunks, monkeypatch):
    from bookflow.operators import ordered

    depth, flow, opening = _book_case(spark)
    monkeypatch.setattr(ordered, "TASK_ROWS", 20)
    plan = depth.book_of_flow(flow, 1, opening)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert "RepartitionByExpression" in depth.level_depth(flow, opening)._jdf.queryExecution().optimizedPlan().toString()


def test_window_features_move_narrow_rows_to_bounded_tasks(spark, small_chunks, monkeypatch):
    from bookflow.operators import windows

    _, flow, _ = _book_case(spark)
    flow = flow.withColumns({"price_diff": F.col("price_tick") - 103, "interval_ms": F.col("t_ms") % 7})
    before = windows.window_features(flow, 5, 2).collect()
    monkeypatch.setattr(ordered, "TASK_ROWS", 20)
    out = windows.window_features(flow, 5, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG1P(" in plan and plan.rindex("LOG1P(") < plan.index("RepartitionByExpression")
    key = lambda r: (r["security_id"], r["start"])
    assert sorted(out.collect(), key=key) == sorted(before, key=key) and len(before) == 104 + 18
    row = min((r for r in before if r["security_id"] == "a"), key=key)
    first = flow.filter("security_id = 'a' AND row_seq < 5").collect()
    assert row["pm_mean"] == pytest.approx(np.mean([r["price_diff"] for r in first]))
    assert row["log_interval_mean"] == pytest.approx(np.mean([np.log1p(r["interval_ms"]) for r in first]))
