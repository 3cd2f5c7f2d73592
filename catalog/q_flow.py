"""Queries P, J, A, B, U, W, O, R over the order flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.functions import PRIME, bare_security, norm_security
from bookflow.operators import aggregates as agg, bins, depth, distances as dist, filters, flow as flows, ordered
from catalog import query
from catalog.adapters import BINNED_SQL, FEEDS_SQL, FIXED_EDGES, FLOW_KEYS, MASK_SQL, TOKENS_SQL, _ORDER, flow_sql
from catalog.q_micro import R

K = "trade_date, security_id"
COLS = ["channel_no", "appl_seq_num", "t_ms", "order_qty", "side", "orig_side", "price_tick", "price_diff", "event_semantic",
        "interval_ms", "row_seq"]
PICK = ", ".join(COLS)


def feeds_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FEEDS_SQL, *ctes]) + "\n" + body


def flow_q(body: str, *ctes: str, variant: str = "open_complete", split: bool = False) -> str:
    return feeds_sql(body, flow_sql(variant, split), *ctes)


# P: projections and filters
POST_COLS = [*FLOW_KEYS, "channel_no", "appl_seq_num", "price_tick", "order_qty", "side", "ord_type", "t_ms"]
PC = ", ".join(POST_COLS)
query("p1_norm_security", "SELECT c_custkey, concat(code, '_XSHE') AS security_id, code FROM (SELECT c_custkey, lpad(v, CAST(greatest(6, length(v)) AS INTEGER), '0') AS code "
      "FROM (SELECT c_custkey, CAST(c_custkey * CAST(pow(10, c_custkey % 6) AS BIGINT) AS VARCHAR) AS v FROM customer))")(
    lambda t: t.raw("customer").select("c_custkey", norm_security((F.col("c_custkey") * F.pow(F.lit(10), F.col("c_custkey") % 6).cast("long"))).alias("security_id")).withColumn(
        "code", bare_security(F.col("security_id"))))
query("p2_after_open", feeds_sql(f"SELECT {PC} FROM posts WHERE t_ms // 1000 > 34200"))(
    lambda t: flows.after_open(t.posts).select(*POST_COLS))
query("p2_session_filter", feeds_sql(f"SELECT {PC} FROM posts WHERE t_ms // 1000 BETWEEN 36000 AND 50400"))(
    lambda t: flows.session_filter(t.posts, 36000, 50400).select(*POST_COLS))
query("p3_limit_orders", feeds_sql(f"SELECT {PC} FROM posts WHERE ord_type = 50"))(
    lambda t: flows.limit_orders(t.posts).select(*POST_COLS))
query("p4_universe", feeds_sql(
    f"SELECT {PC} FROM posts SEMI JOIN (SELECT * FROM mask WHERE is_liquid = 1) USING ({K}) WHERE security_id IN ('000001_XSHE', '000002_XSHE', '000005_XSHE')",
    MASK_SQL))(lambda t: flows.universe(t.posts, ["000001_XSHE", "000002_XSHE", "000005_XSHE"], t.mask).select(*POST_COLS))
query("p7_fixed_window", flow_q(f"SELECT {K}, row_seq, t_ms FROM tokens WHERE t_ms BETWEEN 36000000 AND 36600000 AND tokenizable_event", TOKENS_SQL))(
    lambda t: flows.fixed_window(t.tokens, 36_000_000, 600_000).select(*FLOW_KEYS, "row_seq", "t_ms"))
query("p8_snapshot_at", feeds_sql(f"SELECT {K}, snap_seq, t_ms, bid1, ask1 FROM snaps WHERE t_ms // 1000 = 34260"))(
    lambda t: flows.snapshot_at(t.snaps, 34260).select(*FLOW_KEYS, "snap_seq", "t_ms", "bid1", "ask1"))
query("s4_liquidity_mask", f"WITH {MASK_SQL} SELECT * FROM mask")(lambda t: filters.unpivot_mask(t.wide_mask))

# J: joins
query("j1_join_mask", feeds_sql(f"SELECT {PC}, is_liquid FROM posts LEFT JOIN mask USING ({K})", MASK_SQL))(
    lambda t: flows.join_mask(t.posts, t.mask).select(*POST_COLS, "is_liquid"))
query("u1_expand_legs", feeds_sql(
    f"SELECT {K}, channel_no, appl_seq_num, exec_type, order_qty, t_ms, txn_seq, leg FROM legs", flow_sql()))(
    lambda t: flows.expand_legs(t.txns))
priced = lambda t: flows.open_diff(flows.after_open(flows.limit_orders(t.posts)), flows.open_anchor(t.snaps))
matched = lambda t: flows.match_legs(flows.expand_legs(t.txns), priced(t))
query("j2_match_legs", feeds_sql(
    f"SELECT {K}, channel_no, appl_seq_num, exec_type, order_qty, t_ms, txn_seq, leg, price_tick, price_diff, orig_side FROM matched", flow_sql()))(matched)
query("j3_join_immediate", feeds_sql(
    f"SELECT {_ORDER}, t_ms, order_qty, immediate_raw AS immediate_qty FROM flagged", flow_sql()))(
    lambda t: flows.join_immediate(priced(t), flows.immediate_exec(matched(t))).select(
        *flows.ORDER_KEY, "t_ms", "order_qty", "immediate_qty"))
query("j4_asof_join", feeds_sql(
    f"SELECT {_ORDER}, t_sec, mid_tick FROM (SELECT o.*, s.t_sec AS at, CASE WHEN o.t_sec - s.t_sec <= 5 THEN s.mid_tick END AS mid_tick FROM "
    f"(SELECT *, t_ms // 1000 AS t_sec FROM posts) o ASOF LEFT JOIN secs s ON o.trade_date = s.trade_date AND o.security_id = s.security_id AND o.t_sec >= s.t_sec)",
    "secs AS (SELECT trade_date, security_id, t_ms // 1000 AS t_sec, arg_max((bid1 + ask1) / 2.0, (t_ms, snap_seq)) AS mid_tick FROM snaps GROUP BY ALL)"))(
    lambda t: ordered.asof_backward(t.posts.withColumn("t_sec", F.floor(F.col("t_ms") / 1000)), flows.last_mid_per_second(t.snaps), FLOW_KEYS, "t_sec",
                                    ["mid_tick"], tolerance=5, bucket=60).select(*flows.ORDER_KEY, "t_sec", "mid_tick"))
query("j4_asof_join_open", feeds_sql(
    f"SELECT {_ORDER}, o.t_sec, s.mid_tick FROM (SELECT *, t_ms // 1000 AS t_sec FROM posts) o ASOF LEFT JOIN secs s USING (trade_date, security_id, t_sec)",
    "secs AS (SELECT trade_date, security_id, t_ms // 1000 AS t_sec, arg_max((bid1 + ask1) / 2.0, (t_ms, snap_seq)) AS mid_tick FROM snaps GROUP BY ALL)"))(
    lambda t: ordered.asof_backward(t.posts.withColumn("t_sec", F.floor(F.col("t_ms") / 1000)), flows.last_mid_per_second(t.snaps), FLOW_KEYS, "t_sec",
                                    ["mid_tick"], bucket=600).select(*flows.ORDER_KEY, "t_sec", "mid_tick"))
query("j5_open_anchor", feeds_sql(f"SELECT {K}, anchor_bid_tick, anchor_ask_tick FROM anchors", flow_sql()))(
    lambda t: flows.open_anchor(t.snaps, required=t.posts))
query("j7_align", flow_q(
    f"SELECT security_id, t AS token_id, coalesce(a.n / a.s, 0) AS p, coalesce(b.n / b.s, 0) AS q FROM a FULL JOIN b USING (security_id, t)".replace(
        "a.n / a.s", "round(a.n / a.s, 6)").replace("b.n / b.s", "round(b.n / b.s, 6)"),
    TOKENS_SQL, *[f"{x} AS (SELECT security_id, order_token AS t, count(*) AS n, sum(count(*)) OVER (PARTITION BY security_id) AS s FROM tokens "
                  f"WHERE trade_date = {d} GROUP BY security_id, order_token)" for x, d in (("a", 20250709), ("b", 20250710))]))(
    lambda t: dist.align(*_day_tokens(t), ["security_id"], "token_id"))
query("j9_time_pairs", flow_q(
    f"SELECT a.trade_date, a.security_id, a.t AS t0, b.t AS t1 FROM s a JOIN s b ON a.trade_date = b.trade_date AND a.security_id = b.security_id AND b.t = a.t + 30",
    f"s AS (SELECT DISTINCT {K}, t_ms // 1000 AS t FROM flow)"))(lambda t: flows.time_pairs(t.flow_seconds, 30))
query("j10_match_rate", feeds_sql(
    f"SELECT security_id, exec_type, count(*) AS total_legs, count(*) FILTER (hit IS NULL) AS unmatched, "
    f"{R('100.0 * count(*) FILTER (hit IS NULL) / count(*)')} AS unmatched_pct FROM legs LEFT JOIN (SELECT DISTINCT {_ORDER}, 1 AS hit FROM orders50) USING ({_ORDER}) "
    "GROUP BY CUBE (security_id, exec_type)", flow_sql()))(
    lambda t: flows.match_rate(flows.expand_legs(t.txns), flows.after_open(flows.limit_orders(t.posts))))
query("j11_context_window", flow_q(
    f"SELECT {K}, row_seq, t_ms, side FROM flow JOIN (SELECT {K}, max(row_seq) AS e FROM flow WHERE t_ms // 1000 = 40000 GROUP BY {K}) USING ({K}) "
    "WHERE row_seq BETWEEN e - 49 AND e"))(lambda t: flows.context_window(t.flow, 40_000, 50).select(*FLOW_KEYS, "row_seq", "t_ms", "side"))

# A, B: aggregates and coding
query("a5_immediate_exec", feeds_sql(f"SELECT {_ORDER}, t_ms, immediate_qty FROM executed", flow_sql()))(
    lambda t: flows.immediate_exec(matched(t)))
flagged = lambda t: flows.residual_flags(flows.join_immediate(priced(t), flows.immediate_exec(matched(t))))
query("a6_aggressive_stats", feeds_sql(
    f"SELECT {K}, count(*) FILTER (least(immediate_raw, order_qty) > 0) AS immediate_aggressive_posts, "
    f"count(*) FILTER (order_qty - immediate_raw > 0) AS residual_post_rows FROM flagged GROUP BY {K}", flow_sql()))(
    lambda t: flows.aggressive_stats(flagged(t)))
query("b1_mid_diff", feeds_sql(f"SELECT {_ORDER}, price_tick, mid_tick, price_diff FROM priced", flow_sql("mid")))(
    lambda t: flows.mid_diff(flows.after_open(flows.limit_orders(t.posts)), t.snaps).select(
        *flows.ORDER_KEY, "price_tick", "mid_tick", "price_diff"))
query("b2_open_diff", feeds_sql(f"SELECT {_ORDER}, price_tick, anchor_bid_tick, price_diff FROM priced", flow_sql()))(
    lambda t: priced(t).select(*flows.ORDER_KEY, "price_tick", "anchor_bid_tick", "price_diff"))
SIDE_SQL = (f"SELECT {K}, channel_no, appl_seq_num, txn_seq, exec_type, order_qty, CASE WHEN exec_type = 52 THEN 99 ELSE "
            "{done} END AS side FROM matched")
side_cols = [*flows.ORDER_KEY, "txn_seq", "exec_type", "order_qty", "side"]
query("b3_code_side", feeds_sql(SIDE_SQL.format(done="CASE WHEN orig_side = 49 THEN 129 WHEN orig_side = 50 THEN 130 END"), flow_sql()))(
    lambda t: flows.code_side(matched(t)).select(*side_cols))
query("b4_code_side_single", feeds_sql(SIDE_SQL.format(done="129"), flow_sql()))(
    lambda t: flows.code_side(matched(t), "single").select(*side_cols))
query("b5_split_cancels", flow_q(f"SELECT {K}, {PICK} FROM flow", split=True))(
    lambda t: flows.split_cancels(t.flow).select(*FLOW_KEYS, *COLS))
query("b6_residual_posts", feeds_sql(
    f"SELECT {_ORDER}, order_qty AS post_qty, least(immediate_raw, order_qty) AS immediate_qty, order_qty - least(immediate_raw, order_qty) AS order_qty, "
    "immediate_raw > 0 AS aggressive FROM flagged WHERE order_qty > immediate_raw", flow_sql()))(
    lambda t: flows.residual_posts(flagged(t)).select(*flows.ORDER_KEY, "post_qty", "immediate_qty", "order_qty", "aggressive"))
query("b7_build_flow", flow_q(f"SELECT {K}, {PICK} FROM flow"))(
    lambda t: flows.build_flow(t.posts, t.txns, t.snaps).select(*FLOW_KEYS, *COLS))
query("b7_build_flow_open", flow_q(f"SELECT {K}, {PICK} FROM flow", variant="open"))(
    lambda t: flows.build_flow(t.posts, t.txns, t.snaps, variant="open").select(*FLOW_KEYS, *COLS))
query("b7_build_flow_mid", flow_q(f"SELECT {K}, {PICK} FROM flow", variant="mid"))(
    lambda t: flows.build_flow(t.posts, t.txns, t.snaps, variant="mid").select(*FLOW_KEYS, *COLS))
query("b7_build_flow_split", flow_q(f"SELECT {K}, {PICK} FROM flow", split=True))(
    lambda t: flows.build_flow(t.posts, t.txns, t.snaps, split_cancel_sides=True).select(*FLOW_KEYS, *COLS))
query("u2_unify_flow", feeds_sql(
    f"SELECT {_ORDER}, t_ms, order_qty, event_semantic, orig_side FROM (SELECT {_ORDER}, t_ms, order_qty, 'post' AS event_semantic, side AS orig_side FROM priced UNION ALL "
    f"SELECT {_ORDER}, t_ms, order_qty, CASE WHEN exec_type = 52 THEN 'cancel' ELSE 'transaction_complete' END, orig_side FROM matched)", flow_sql()))(
    lambda t: flows.unify_flow(priced(t), matched(t)).select(*flows.ORDER_KEY, "t_ms", "order_qty", "event_semantic", "orig_side"))
query("o1_order_flow", feeds_sql(f"SELECT {_ORDER}, t_ms, row_seq FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY t_ms, channel_no, appl_seq_num) - 1 AS row_seq FROM posts)"))(
    lambda t: flows.order_flow(t.posts).select(*flows.ORDER_KEY, "t_ms", "row_seq"))
query("w1_interval_ms", flow_q(f"SELECT {K}, row_seq, interval_ms FROM flow"))(
    lambda t: flows.interval_ms(t.flow.drop("interval_ms")).select(*FLOW_KEYS, "row_seq", "interval_ms"))
query("u3_pool", flow_q("SELECT side, count(*) AS n, CAST(sum(order_qty) AS BIGINT) AS qty FROM flow GROUP BY side"))(
    lambda t: flows.pool(t.flow.filter("trade_date = 20250709"), t.flow.filter("trade_date = 20250710")).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_qty").alias("qty")))
query("b9_apply_bins", flow_q(f"SELECT {K}, row_seq, price_bin, qty_bin, interval_bin FROM binned", BINNED_SQL))(
    lambda t: bins.apply_bins(t.flow, FIXED_EDGES).select(*FLOW_KEYS, "row_seq", "price_bin", "qty_bin", "interval_bin"))
DIST_SQL = ("dist AS (SELECT *, sum(count) OVER p AS total_count, count(*) OVER p AS n_unique FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f}_bin AS bin, CAST({c} AS DOUBLE) AS value, count(*) AS count FROM binned GROUP BY ALL" for f, c in bins.FIELDS.items())
    + ") WINDOW p AS (PARTITION BY field, bin))")
query("b10_bin_distribution", flow_q(
    f"SELECT field, bin, value, count, CAST(total_count AS BIGINT) AS total_count, n_unique, {R('count / total_count')} AS prob FROM dist", BINNED_SQL, DIST_SQL))(
    lambda t: bins.bin_distribution(bins.apply_bins(t.flow, FIXED_EDGES)))
RADICES = {"price": 26, "qty": 26, "interval": 12}
# Edges of all rows with a tokenised side: heavy values, and a recursive walk over the positions of the rest.
FIT_SQL = [
    "vals AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({c} AS DOUBLE) AS v, {RADICES[f]} AS bins FROM flow WHERE side IN (49, 50, 99, 129, 130)" for f, c in bins.FIELDS.items()) + ")",
    "hist AS (SELECT field, bins, v, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY ALL)",
    "heavy AS (SELECT field, v FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, v) AS rk FROM (SELECT *, n > sum(n) OVER (PARTITION BY field) / bins AS alone FROM hist) WHERE alone) WHERE rk < bins)",
    "rest AS MATERIALIZED (SELECT field, v, CAST(sum(n) OVER (PARTITION BY field ORDER BY v) AS BIGINT) AS stop, CAST(sum(n) OVER (PARTITION BY field ORDER BY v) AS BIGINT) - n AS pos FROM hist ANTI JOIN heavy USING (field, v))",
    "sizes AS MATERIALIZED (SELECT field, max(stop) AS size, any_value(bins) - coalesce(any_value(taken), 0) AS budget FROM rest JOIN (SELECT DISTINCT field, bins FROM hist) USING (field) LEFT JOIN (SELECT field, count(*) AS taken FROM heavy GROUP BY field) USING (field) GROUP BY field)",
    """walk AS (SELECT field, size, budget, CAST(0 AS BIGINT) AS pos, stop AS here, CAST(NULL AS DOUBLE) AS edge FROM sizes JOIN rest USING (field) WHERE rest.pos = 0
  UNION ALL SELECT w.field, w.size, w.budget - 1, w.goal, r.stop, r.v FROM (SELECT *, least(CASE WHEN aim < here THEN here ELSE aim END, size - 1) AS goal
    FROM (SELECT *, pos + CASE WHEN budget > 1 THEN (size - pos) // (budget - 1) ELSE size - pos END AS aim FROM walk WHERE budget > 0 AND pos < size)) w
    JOIN rest r ON r.field = w.field AND r.pos <= w.goal AND w.goal < r.stop)""",
    "all_edges AS (SELECT field, edge FROM walk WHERE edge IS NOT NULL UNION ALL SELECT field, v FROM heavy UNION ALL SELECT field, CASE WHEN (field, low) IN (SELECT (field, v) FROM heavy) THEN low - 1 ELSE low END FROM (SELECT field, min(v) AS low FROM hist GROUP BY field))",
]
fit_q = lambda body, *ctes: flow_q(body, *FIT_SQL, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)
query("b8_fit_bins", fit_q(f"SELECT field, row_number() OVER (PARTITION BY field ORDER BY edge) - 1 AS edge_no, {R('edge')} AS edge FROM all_edges"))(
    lambda t: bins.edges_table(t.spark, t.edges).select("field", F.posexplode("edges").alias("edge_no", "edge")))
FIT_DAYS = (20250709, 20250710)
_binned = ", ".join(f"greatest(0, least(len(list_filter(e_{f}, lambda e: e < {c})) - 1, {n - 1})) AS {f}_bin" for (f, c), n in zip(bins.FIELDS.items(), RADICES.values()))
query("b11_fit_bins_pooled", fit_q(
    f"SELECT trade_date, price_bin, qty_bin, interval_bin, count(*) AS n FROM (SELECT trade_date, {_binned} FROM flow, (SELECT " + ", ".join(
        f"list(edge ORDER BY edge) FILTER (field = '{f}') AS e_{f}" for f in bins.FIELDS) + " FROM all_edges)) GROUP BY ALL"))(
    lambda t: bins.apply_bins(t.flow, t.once("edges-pooled", lambda: bins.fit_bins_pooled([t.flow.filter(F.col("trade_date") == d) for d in FIT_DAYS], RADICES, tuple(flows.SIDES_5)))).groupBy(
        "trade_date", "price_bin", "qty_bin", "interval_bin").agg(F.count(F.lit(1)).alias("n")))
query("b12_encode_token", flow_q(f"SELECT {K}, row_seq, side_bin, order_token, tokenizable_event FROM tokens", TOKENS_SQL))(
    lambda t: bins.encode_token(bins.apply_bins(t.flow, FIXED_EDGES), tuple(len(FIXED_EDGES[f]) - 1 for f in bins.FIELDS)).select(
        *FLOW_KEYS, "row_seq", "side_bin", "order_token", "tokenizable_event"))
RADIX = tuple(len(FIXED_EDGES[f]) - 1 for f in bins.FIELDS)
query("b13_decode_token", flow_q(f"SELECT {K}, row_seq, price_bin, qty_bin, interval_bin, side_bin FROM tokens", TOKENS_SQL))(
    lambda t: t.tokens.select(*FLOW_KEYS, "row_seq", *[c.alias(n) for n, c in bins.decode_token(F.col("order_token"), RADIX, 5).items()]))
MODE_SQL = [BINNED_SQL, DIST_SQL, TOKENS_SQL.split("tokens AS", 1)[1].join(["tokens AS", ""]),
            "best AS (SELECT field, bin, arg_max(value, (count, -value)) AS v FROM dist GROUP BY field, bin)"]


def _decode_sql(price: str, qty: str = "greatest(1, q.v)") -> str:
    return (f"SELECT {K}, row_seq, CAST(sum(CAST(greatest(0, i.v) AS BIGINT)) OVER (PARTITION BY {K} ORDER BY row_seq) AS BIGINT) + 34200000 AS t_ms, "
            f"CAST(greatest(0, i.v) AS BIGINT) AS dt_ms, side_bin, CAST({price} AS BIGINT) AS price_tick, CAST({qty} AS BIGINT) AS qty FROM tokens "
            + " ".join(f"JOIN (SELECT bin, v FROM best WHERE field = '{f}') {a} ON {a}.bin = tokens.{f}_bin"
                       for f, a in (("price", "p"), ("qty", "q"), ("interval", "i"))) + f" JOIN anchors USING ({K})")


def _token_table(t):
    return t.tokens.select(*FLOW_KEYS, "row_seq", "order_token", F.col("price_tick").alias("exact_price_tick"), F.col("order_qty").alias("exact_qty")).join(
        flows.open_anchor(t.snaps), list(FLOW_KEYS))


def _dist_table(t):
    return t.staged("bin-distribution", lambda: bins.bin_distribution(bins.apply_bins(t.flow, FIXED_EDGES)))


def _decode(t, **options):
    table = _token_table(t)
    if options.get("anchor") == "mid":
        table = table.withColumn("mid_tick", (F.col("anchor_bid_tick") + F.col("anchor_ask_tick")) / 2)
    return bins.decode_flow(table, FIXED_EDGES, _dist_table(t), 5, start_ms=34_200_000, **options)


query("b14_decode_mode", flow_q(_decode_sql("anchor_bid_tick + p.v"), *MODE_SQL))(lambda t: _decode(t).drop("offset"))
_toss = lambda x: f"list_transform([{x}], lambda v: ((v % {PRIME}) * (v % {PRIME}) + 5 * (v % {PRIME}) + 1013904223) % {PRIME})[1]"
_draw = lambda n: f"({_toss(_toss(f'row_seq + {7 * 104_729 + n * 1_299_709}'))}) * t{n}.total // {PRIME}"
SAMPLE_SQL = [*MODE_SQL[:-1], "places AS (SELECT field, bin, value AS v, CAST(total_count AS BIGINT) AS total, CAST(sum(count) OVER (PARTITION BY field, bin ORDER BY value) AS BIGINT) AS stop, count FROM dist)",
              "totals AS (SELECT field, bin, max(total) AS total FROM places GROUP BY ALL)",
              "asked AS (SELECT tokens.*, " + ", ".join(f"{_draw(n)} AS at_{f}" for n, f in enumerate(bins.FIELDS)) + " FROM tokens " + " ".join(
                  f"JOIN totals t{n} ON t{n}.field = '{f}' AND t{n}.bin = tokens.{f}_bin" for n, f in enumerate(bins.FIELDS)) + " WHERE order_token IS NOT NULL)"]
query("b14_decode_sample", flow_q(
    f"SELECT {K}, row_seq, CAST(sum(CAST(greatest(0, i.v) AS BIGINT)) OVER (PARTITION BY {K} ORDER BY row_seq) AS BIGINT) + 34200000 AS t_ms, CAST(greatest(0, i.v) AS BIGINT) AS dt_ms, side_bin, "
    "CAST(p.v AS BIGINT) AS offset, CAST(anchor_bid_tick + p.v AS BIGINT) AS price_tick, CAST(greatest(1, q.v) AS BIGINT) AS qty FROM asked " + " ".join(
        f"JOIN places {a} ON {a}.field = '{f}' AND {a}.bin = {f}_bin AND {a}.stop - {a}.count <= at_{f} AND at_{f} < {a}.stop" for f, a in (("price", "p"), ("qty", "q"), ("interval", "i")))
    + f" JOIN anchors USING ({K})", *SAMPLE_SQL))(lambda t: _decode(t, method="sample", seed=7))
OFF = "CASE WHEN p.v = 0 AND side_bin = 0 THEN -1 WHEN p.v = 0 AND side_bin = 1 THEN 1 ELSE p.v END"
query("b15_decode_mid", flow_q(_decode_sql(
    f"round_even((anchor_bid_tick + anchor_ask_tick) / 2.0 + sign({OFF}) * ceil(abs({OFF}) / 2.0), 0)"), *MODE_SQL))(
    lambda t: _decode(t, anchor="mid").drop("offset"))
query("b16_decode_exact", flow_q(_decode_sql("price_tick", "order_qty"), *MODE_SQL))(
    lambda t: _decode(t, exact=("price", "qty")).drop("offset"))
query("b17_flow_report", flow_q(
    f"SELECT {K}, 'rows' AS fact, 'all' AS value, count(*) AS n FROM tokens GROUP BY {K} UNION ALL "
    f"SELECT {K}, 'tokenizable', 'all', count(*) FILTER (tokenizable_event) FROM tokens GROUP BY {K} UNION ALL "
    f"SELECT {K}, 'semantic', event_semantic, count(*) FROM tokens GROUP BY {K}, event_semantic UNION ALL "
    f"SELECT {K}, 'side', CAST(side AS VARCHAR), count(*) FROM tokens GROUP BY {K}, side", TOKENS_SQL))(lambda t: flows.flow_report(t.tokens))

# A7 - A9, O2, U4, D15 - D18: token and value distributions
query("a7_hist_pct", flow_q(
    f"SELECT {K}, price_diff, count(*) AS n, {R(f'100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {K})')} AS percent FROM flow GROUP BY {K}, price_diff"))(
    lambda t: agg.hist_pct(t.flow, "price_diff", FLOW_KEYS))
query("a8_token_dist", flow_q(
    f"SELECT {K}, order_token AS token_id, count(*) AS count, {R(f'count(*) / sum(count(*)) OVER (PARTITION BY {K})')} AS probability FROM tokens GROUP BY {K}, order_token",
    TOKENS_SQL))(lambda t: agg.token_dist(t.tokens, "order_token", FLOW_KEYS))
query("a9_shared_hist", flow_q(
    f"SELECT security_id, bin, {R('lo + bin * ((hi - lo) / 200)')} AS left_edge, count(*) FILTER (trade_date = 20250709) AS n_a, count(*) FILTER (trade_date = 20250710) AS n_b "
    "FROM (SELECT *, least(CAST(floor((x - lo) / (hi - lo) * 200) AS BIGINT), 199) AS bin FROM (SELECT security_id, trade_date, CAST(order_qty AS DOUBLE) AS x, "
    "CAST(min(order_qty) OVER p AS DOUBLE) AS lo, CAST(max(order_qty) OVER p AS DOUBLE) AS hi FROM flow WINDOW p AS (PARTITION BY security_id))) GROUP BY ALL"))(
    lambda t: agg.shared_hist(t.flow.filter("trade_date = 20250709"), t.flow.filter("trade_date = 20250710"), "order_qty", 200, ["security_id"]))
query("o2_top_tokens", flow_q("SELECT order_token, count(*) AS n FROM tokens GROUP BY order_token ORDER BY n DESC, order_token LIMIT 20", TOKENS_SQL))(
    lambda t: bins.top_tokens(t.tokens, 20))


def _day_tokens(t):
    day = lambda d: agg.token_dist(t.tokens.filter(F.col("trade_date") == d), "order_token", ["security_id"])
    return day(20250709), day(20250710)


ALIGNED = "al AS (SELECT security_id, coalesce(a.n / a.s, 0) AS p, coalesce(b.n / b.s, 0) AS q FROM a FULL JOIN b USING (security_id, t))"
DAYS = [f"{x} AS (SELECT security_id, order_token AS t, count(*) AS n, sum(count(*)) OVER (PARTITION BY security_id) AS s FROM tokens "
        f"WHERE trade_date = {d} GROUP BY security_id, order_token)" for x, d in (("a", 20250709), ("b", 20250710))]
aligned = lambda t: dist.align(*_day_tokens(t), ["security_id"], "token_id")
JS = "(coalesce(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) END), 0) + coalesce(sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) END), 0)) / 2"
query("u4_support_overlap", flow_q(
    f"SELECT security_id, count(*) FILTER (p > 0) AS unique_p, count(*) FILTER (q > 0) AS unique_q, count(*) FILTER (p > 0 AND q > 0) AS overlap, "
    f"{R('count(*) FILTER (p > 0 AND q > 0) / count(*)')} AS jaccard FROM al GROUP BY security_id", TOKENS_SQL, *DAYS, ALIGNED))(
    lambda t: dist.support_overlap(aligned(t), ["security_id"]))
query("d15_js_bits", flow_q(f"SELECT security_id, {R(JS)} AS js_bits FROM al GROUP BY security_id", TOKENS_SQL, *DAYS, ALIGNED))(
    lambda t: dist.js_bits(aligned(t), ["security_id"]))
query("d16_tv", flow_q(f"SELECT security_id, {R('sum(abs(p - q)) / 2')} AS tv FROM al GROUP BY security_id", TOKENS_SQL, *DAYS, ALIGNED))(
    lambda t: dist.tv(aligned(t), ["security_id"]))


def predictions(t):
    """Predicted token = token of the next event of the security."""
    ahead = lambda w: {"token_pred": F.lead("token_true").over(w)}
    return ordered.over_neighbours(t.tokens.select(*FLOW_KEYS, "row_seq", F.col("order_token").alias("token_true")), FLOW_KEYS, ahead, after=1)


PRED_SQL = f"pred AS (SELECT {K}, row_seq, order_token AS token_true, lead(order_token) OVER (PARTITION BY {K} ORDER BY row_seq) AS token_pred FROM tokens)"
query("a14_token_accuracy", flow_q(
    f"SELECT {K}, {R('avg(CAST(token_pred = token_true AS INT))')} AS accuracy, {R('avg(CAST(token_pred = token_true AS INT)) FILTER (row_seq >= 50)')} AS accuracy_after "
    f"FROM pred GROUP BY {K}", TOKENS_SQL, PRED_SQL))(
    lambda t: agg.token_accuracy(predictions(t), "token_pred", "token_true", "row_seq", 50, FLOW_KEYS))
query("d18_token_report", flow_q(
    f"""SELECT {K}, CAST(max(n) AS BIGINT) AS sample_count_true, CAST(max(m) AS BIGINT) AS sample_count_pred, count(*) FILTER (r > 0) AS unique_true, count(*) FILTER (g > 0) AS unique_pred,
      count(*) FILTER (r > 0 AND g > 0) AS overlap, {R('count(*) FILTER (r > 0 AND g > 0) / count(*)')} AS jaccard, {R('sum(abs(p - q)) / 2')} AS l1_by_group, {R(JS)} AS js_bits,
      {R('sum(abs(fr - fg) * step) / max(sd)')} AS wasserstein
    FROM (SELECT *, r / n AS p, g / m AS q, sum(r) OVER o / n AS fr, sum(g) OVER o / m AS fg, coalesce(lead(v) OVER o - v, 0) AS step FROM (
      SELECT *, sum(r) OVER k AS n, sum(g) OVER k AS m FROM (SELECT {K}, v, count(*) FILTER (kd = 1) AS r, count(*) FILTER (kd = 2) AS g FROM s GROUP BY ALL) WINDOW k AS (PARTITION BY {K}))
      JOIN (SELECT {K}, stddev_pop(v) AS sd FROM s GROUP BY {K}) USING ({K}) WINDOW o AS (PARTITION BY {K} ORDER BY v)) GROUP BY {K}""",
    TOKENS_SQL, PRED_SQL, f"s AS (SELECT {K}, 1 AS kd, token_true AS v FROM pred WHERE token_true IS NOT NULL UNION ALL SELECT {K}, 2, token_pred FROM pred WHERE token_pred IS NOT NULL)"))(
    lambda t: dist.token_report(predictions(t), FLOW_KEYS))
query("a13_direction_eval", flow_q(
    f"SELECT {K}, count(*) AS n, {R('corr(x, y)')} AS correlation, CAST(sum(CAST(sign(x) = sign(y) AS INT)) AS BIGINT) AS hits, {R('avg(CAST(sign(x) = sign(y) AS INT))')} AS hit_rate "
    f"FROM (SELECT {K}, CAST(price_diff AS DOUBLE) AS x, CAST(price_tick - lag(price_tick) OVER (PARTITION BY {K} ORDER BY row_seq) AS DOUBLE) AS y FROM flow) WHERE y IS NOT NULL GROUP BY {K}"))(
    lambda t: agg.direction_eval(ordered.over_neighbours(
        t.flow.select(*FLOW_KEYS, "row_seq", "price_tick", F.col("price_diff").cast("double").alias("x")), FLOW_KEYS,
        lambda w: {"y": (F.col("price_tick") - F.lag("price_tick").over(w)).cast("double")}, before=1).filter("y IS NOT NULL"), "x", "y", FLOW_KEYS))

# R: depth
OPENING_SQL = (f"top AS (SELECT {K}, arg_max(bid1, (t_ms, snap_seq)) AS b, arg_max(ask1, (t_ms, snap_seq)) AS a, max(snap_seq) AS z FROM snaps WHERE t_ms // 1000 = 34260 GROUP BY {K}),\n"
               f"opening AS (SELECT {K}, 'ask' AS book_side, a + i AS price_tick, 100 * (1 + (a + i) % 7) AS depth FROM top, range(0, 5) r(i) UNION ALL "
               f"SELECT {K}, 'bid', b - i, 100 * (1 + (b - i) % 5) FROM top, range(0, 5) r(i))")


def opening(t):
    lv = lambda i: F.struct((F.col("anchor_ask_tick") + i).alias("ask_p"), (100 * (1 + (F.col("anchor_ask_tick") + i) % 7)).alias("ask_v"),
                            (F.col("anchor_bid_tick") - i).alias("bid_p"), (100 * (1 + (F.col("anchor_bid_tick") - i) % 5)).alias("bid_v"))
    return depth.opening_depth(flows.open_anchor(t.snaps).withColumn("levels", F.array(*[lv(i) for i in range(5)])))


def depth_table(t):
    return t.staged("depth", lambda: depth.level_depth(t.flow, opening(t)))


DEPTH_SQL = f"""ev AS (SELECT {K}, row_seq, t_ms, side, order_qty AS qty, price_tick,
    CASE WHEN side IN (49, 50) THEN 'post' WHEN side = 99 THEN 'cancel' ELSE 'execute' END AS kind_of,
    CASE WHEN CASE WHEN side IN (49, 50) THEN side ELSE orig_side END = 49 THEN 'bid' ELSE 'ask' END AS book_side FROM flow WHERE order_qty > 0),
sums AS (SELECT ev.*, coalesce(depth, 0) AS d0, CASE WHEN kind_of = 'post' THEN qty ELSE -qty END AS x FROM ev LEFT JOIN opening USING ({K}, book_side, price_tick)),
run AS (SELECT *, d0 + sum(x) OVER lv AS s FROM sums WINDOW lv AS (PARTITION BY {K}, book_side, price_tick ORDER BY row_seq)),
clamped AS (SELECT *, CAST(s - least(0, min(s) OVER lv) AS BIGINT) AS depth_after FROM run WINDOW lv AS (PARTITION BY {K}, book_side, price_tick ORDER BY row_seq)),
depth AS (SELECT {K}, row_seq, t_ms, side, kind_of, book_side, price_tick, qty, coalesce(lag(depth_after) OVER lv, d0) AS depth_before, depth_after,
    CASE WHEN kind_of = 'post' THEN 0 ELSE coalesce(lag(depth_after) OVER lv, d0) - depth_after END AS removed
    FROM clamped WINDOW lv AS (PARTITION BY {K}, book_side, price_tick ORDER BY row_seq))"""
query("r1_level_depth", flow_q("SELECT * FROM depth", OPENING_SQL, DEPTH_SQL))(lambda t: depth.level_depth(t.flow, opening(t)))
# A flow in which every third cancel and every fifth execution has lost its original side.
_lost = "(side = 99 AND appl_seq_num % 3 = 0 OR side IN (129, 130) AND appl_seq_num % 5 = 0)"
sideless = lambda t: t.flow.withColumn("orig_side", F.when(~F.expr(_lost), F.col("orig_side")))
query("r1_set_aside", flow_q(
    f"SELECT {K}, CASE WHEN side = 99 THEN 'cancel' ELSE 'execute' END AS kind_of, count(*) AS events, CAST(sum(order_qty) AS BIGINT) AS qty FROM flow WHERE {_lost} AND order_qty > 0 GROUP BY ALL"))(
    lambda t: depth.set_aside(depth.level_depth(sideless(t), opening(t), keep_aside=True)))
query("r2_removed_qty", flow_q(
    f"SELECT {K}, kind_of, count(*) AS events, CAST(sum(removed) AS BIGINT) AS removed_qty, count(*) FILTER (removed <= 0) AS unmatched FROM depth "
    f"WHERE kind_of <> 'post' GROUP BY {K}, kind_of", OPENING_SQL, DEPTH_SQL))(lambda t: depth.removed_qty(depth_table(t)))
MSG_SQL = f"""SELECT {K}, row_seq, t_ms / 1000.0 AS time, CASE kind_of WHEN 'post' THEN 1 WHEN 'execute' THEN 4 ELSE CASE WHEN removed >= qty THEN 3 ELSE 2 END END AS event_type,
  row_number() OVER (PARTITION BY {K} ORDER BY row_seq) AS order_id, CASE WHEN kind_of = 'post' THEN qty ELSE removed END AS size, price_tick * 100 AS price,
  (CASE WHEN book_side = 'bid' THEN 1 ELSE -1 END) * (CASE WHEN kind_of = 'execute' THEN -1 ELSE 1 END) AS direction FROM depth WHERE kind_of = 'post' OR removed > 0"""
query("r3_to_messages", flow_q(MSG_SQL, OPENING_SQL, DEPTH_SQL))(lambda t: depth.to_messages(depth_table(t)))
BOOK_SQL = f"""changes AS (SELECT {K}, book_side, price_tick, row_seq, depth_after AS d FROM depth UNION ALL SELECT {K}, book_side, price_tick, -1, depth FROM opening),
lv AS (SELECT DISTINCT {K}, book_side, price_tick FROM changes),
states AS (SELECT e.trade_date, e.security_id, e.row_seq, e.t_ms, e.book_side, e.price_tick, c.d FROM
  (SELECT depth.trade_date, depth.security_id, row_seq, t_ms, lv.book_side, lv.price_tick FROM depth JOIN lv USING (trade_date, security_id)) e
  ASOF JOIN changes c ON e.trade_date = c.trade_date AND e.security_id = c.security_id AND e.book_side = c.book_side AND e.price_tick = c.price_tick AND e.row_seq >= c.row_seq),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {K}, row_seq, book_side ORDER BY CASE WHEN book_side = 'bid' THEN -price_tick ELSE price_tick END) AS lvl FROM states WHERE d > 0),
book AS (SELECT {K}, d.row_seq, d.t_ms, """ + ", ".join(
    f"max(CASE WHEN book_side = '{s}' AND lvl = {i} THEN {x} END) AS {s}_{n}_{i}" for i in (1, 2, 3) for s in ("ask", "bid") for n, x in (("p", "r.price_tick"), ("v", "r.d"))) + \
    f" FROM (SELECT {K}, row_seq, t_ms FROM depth) d LEFT JOIN (SELECT {K}, row_seq, book_side, price_tick, d, lvl FROM ranked) r USING ({K}, row_seq) GROUP BY {K}, d.row_seq, d.t_ms)"
NAMES = [f"{s}_{n}_{i}" for i in (1, 2, 3) for s in ("ask", "bid") for n in ("p", "v")]


def _flat(df):
    return df.select(*FLOW_KEYS, "row_seq", "t_ms", *[
        F.col("levels")[i - 1][f"{s}_{n}"].alias(f"{s}_{n}_{i}") for i in (1, 2, 3) for s in ("ask", "bid") for n in ("p", "v")])


query("r4_book_after", flow_q(f"SELECT {K}, row_seq, t_ms, {', '.join(NAMES)} FROM book", OPENING_SQL, DEPTH_SQL, BOOK_SQL))(
    lambda t: _flat(depth.book_of_flow(t.flow, 3, opening(t))))
query("r4_book_grid", flow_q(
    f"SELECT {K}, row_seq, t_ms, {', '.join(NAMES)} FROM book QUALIFY row_seq = max(row_seq) OVER (PARTITION BY {K}, t_ms // 60000)", OPENING_SQL, DEPTH_SQL, BOOK_SQL))(
    lambda t: _flat(depth.book_of_flow(t.flow, 3, opening(t), grid_ms=60_000)))
query("r5_touch_after", flow_q(
    f"SELECT {K}, row_seq, ask_p_1 AS best_ask, bid_p_1 AS best_bid, (ask_p_1 + bid_p_1) / 2.0 AS mid FROM book", OPENING_SQL, DEPTH_SQL, BOOK_SQL))(
    lambda t: depth.touch(depth.book_of_flow(t.flow, 1, opening(t))))
