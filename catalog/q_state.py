"""Queries K, W, C1-C3: book state, windows and features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bookflow.operators import aggregates as agg, distances as dist, filters, micro, state, windows
from bookflow.session import checkpoint_dir
from bookflow.sources import writers
from catalog import query
from catalog.adapters import FLOW_KEYS, TAPE_KEYS, TAPE_SQL, TOKENS_SQL
from catalog.q_flow import K, flow_q
from catalog.q_micro import R, tape_sql
from catalog.q_scores import l1_sql, rule_sql, w_sql

S = ["security_id"]
STEP_MS, PER_BUCKET, TICK = 3_600_000, 6, 100.0
SEC = "concat('S', CAST(user_id % 4 AS VARCHAR(2)))"
LV = [(s, x, i) for i in range(1, 11) for s in ("ask", "bid") for x in ("p", "v")]
SLOT_ORDER = [("ask", i) for i in range(1, 11)] + [("bid", i) for i in range(1, 11)]
# Levels go missing on a rule, so filling has work to do: level i of an event is absent when (event_id + i) % 11 = 0, never level 1.
_miss = lambda s, x, i: f"CASE WHEN {i} > 1 AND (event_id + {i}) % 11 = 0 THEN NULL ELSE {s}_{x}_{i} END"
SNAP_SQL = ("slots AS (SELECT concat('S', run_id) AS security_id, t_ns // 3600000000000 AS slot, " + ", ".join(
    f"arg_max({{'x': {_miss(s, x, i)}}}, event_id).x AS {s}_{x}_{i}" for s, x, i in LV) + " FROM tape GROUP BY ALL)")
DENSE_SQL = SNAP_SQL + """,
axis AS (SELECT security_id, unnest(range(lo, hi + 1)) AS slot FROM (SELECT security_id, min(slot) AS lo, max(slot) AS hi FROM slots GROUP BY ALL)),
state AS (SELECT security_id, slot, slot // 6 AS bucket, """ + ", ".join(
    f"last_value({s}_{x}_{i} IGNORE NULLS) OVER w AS {s}_{x}_{i}" for s, x, i in LV) + \
    " FROM axis LEFT JOIN slots USING (security_id, slot) WINDOW w AS (PARTITION BY security_id ORDER BY slot ROWS UNBOUNDED PRECEDING)),\n" + \
    "anchored AS (SELECT *, " + ", ".join(f"first_value({s}_{x}_{i}) OVER b AS {s}_{x}_{i}_a" for s, x, i in LV) + \
    " FROM state WINDOW b AS (PARTITION BY security_id, bucket ORDER BY slot))"
EDGES = [round(-3 + 0.2 * i, 1) for i in range(31)]
V = len(EDGES) - 1
_pb = lambda s, i: (f"CASE WHEN {s}_p_{i} IS NOT NULL AND {s}_p_{i}_a IS NOT NULL THEN "
                    f"CAST(greatest(-20, least(20, round_even(({s}_p_{i} - {s}_p_{i}_a) / 100.0, 0))) + 20 AS BIGINT) END")
_vd = lambda s, i: (f"CASE WHEN {s}_v_{i} IS NOT NULL AND {s}_v_{i}_a IS NOT NULL THEN "
                    f"ln(1 + greatest({s}_v_{i}, 0)) - ln(1 + greatest({s}_v_{i}_a, 0)) END")
_vb = lambda s, i: f"CASE WHEN {s}_v_{i} IS NOT NULL AND {s}_v_{i}_a IS NOT NULL THEN greatest(0, least(len(list_filter({EDGES}, lambda e: e < {_vd(s, i)})) - 1, {V - 1})) END"
LONG_SQL = DENSE_SQL + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT security_id, slot, bucket, {n} AS slot_no, {_pb(s, i)} AS price_bin, {_vd(s, i)} AS vol_delta, {_vb(s, i)} AS vol_bin FROM anchored"
    for n, (s, i) in enumerate(SLOT_ORDER)) + ")"


def snapshots(t):
    keep = lambda lv, i: F.struct(*[F.when(~((i > 0) & ((F.col("event_id") + i + 1) % 11 == 0)), lv[f]).alias(f) for f in state.FIELDS])
    return t.tape.select(F.concat(F.lit("S"), F.col("run_id").cast("string")).alias("security_id"), (F.col("t_ns") / 1_000_000).cast("long").alias("t_ms"),
                         F.col("event_id").alias("feed_seq"), F.transform("levels", keep).alias("levels"))


def book(t):
    return t.staged("book-state", lambda: state.book_state(snapshots(t), STEP_MS, 360, S))


def exploded(df, **arrays):
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select("security_id", "slot", F.posexplode(zipped).alias("slot_no", "_z")).select("security_id", "slot", "slot_no", "_z.*")


flat = lambda df, col="levels": df.select("security_id", "slot", *[F.col(col)[i - 1][f"{s}_{x}"].alias(f"{s}_{x}_{i}") for s, x, i in LV])
NAMES = ", ".join(f"{s}_{x}_{i}" for s, x, i in LV)
query("w9_last_per_slot", tape_sql(f"SELECT security_id, slot, {NAMES} FROM slots", SNAP_SQL))(
    lambda t: flat(state.last_per_slot(snapshots(t), STEP_MS, S)))
query("w10_densify", tape_sql(f"SELECT security_id, slot, {NAMES} FROM state", DENSE_SQL))(
    lambda t: flat(state.densify(state.last_per_slot(snapshots(t), STEP_MS, S), S)))
query("j6_bucket_anchor", tape_sql("SELECT security_id, slot, bucket, ask_p_1_a AS ask_anchor, bid_v_10_a AS bid_anchor FROM anchored", DENSE_SQL))(
    lambda t: state.bucket_anchor(state.densify(state.last_per_slot(snapshots(t), STEP_MS, S), S), PER_BUCKET, S).select(
        "security_id", "slot", "bucket", F.col("anchor")[0]["ask_p"].alias("ask_anchor"), F.col("anchor")[9]["bid_v"].alias("bid_anchor")))
query("k1_book_state", tape_sql(
    "SELECT security_id, slot, bucket, ask_p_1, bid_p_1, ask_v_5, ask_p_1_a, bid_p_1_a FROM anchored", DENSE_SQL))(
    lambda t: state.book_state(snapshots(t), STEP_MS, 360, S).select(
        "security_id", "slot", "bucket", F.col("levels")[0]["ask_p"].alias("ask_p_1"), F.col("levels")[0]["bid_p"].alias("bid_p_1"),
        F.col("levels")[4]["ask_v"].alias("ask_v_5"), F.col("anchor")[0]["ask_p"].alias("ask_p_1_a"), F.col("anchor")[0]["bid_p"].alias("bid_p_1_a")))
query("k2_price_bins", tape_sql("SELECT security_id, slot, slot_no, price_bin FROM long", LONG_SQL))(
    lambda t: exploded(state.price_bins(book(t), TICK), price_bin="price_bins"))
query("k3_vol_delta", tape_sql(f"SELECT security_id, slot, slot_no, {R('vol_delta')} AS vol_delta FROM long", LONG_SQL))(
    lambda t: exploded(state.vol_delta(book(t)), vol_delta="vol_delta"))
query("k4_fit_vol_edges", tape_sql(
    f"SELECT i AS edge_no, {R('-m + i * (2 * m / 31)')} AS edge FROM (SELECT greatest(quantile_cont(abs(vol_delta), 0.995), 1e-6) AS m FROM long), range(0, 32) r(i)", LONG_SQL))(
    lambda t: t.spark.createDataFrame(list(enumerate(state.fit_vol_edges(state.vol_delta(book(t)), 31))), "edge_no long, edge double"))
query("k5_apply_vol_edges", tape_sql("SELECT security_id, slot, slot_no, vol_bin FROM long", LONG_SQL))(
    lambda t: exploded(state.apply_vol_edges(state.vol_delta(book(t)), EDGES, V), vol_bin="vol_bins"))
query("k6_slot_tokens", tape_sql(f"SELECT security_id, slot, slot_no, price_bin * {V} + vol_bin AS token FROM long", LONG_SQL))(
    lambda t: exploded(state.tokenise(book(t), TICK, EDGES), token="tokens"))


def written_state(t):
    path = f"{checkpoint_dir(t.spark)}/bookflow/state-{uuid.uuid4().hex}"
    writers.write_state(state.tokenise(book(t), TICK, EDGES).select("security_id", "slot", "tokens"), path, EDGES, S)
    tokens, meta = writers.read_state(t.spark, path)
    return exploded(tokens, token="tokens").join(meta.select("security_id", "n_rows", F.element_at("vol_edges", -1).alias("last_edge"), F.size("vol_edges").alias("n_edges")), "security_id")


query("s12_write_state", tape_sql(
    f"SELECT security_id, slot, slot_no, price_bin * {V} + vol_bin AS token, count(*) OVER (PARTITION BY security_id, slot_no) AS n_rows, {EDGES[-1]} AS last_edge, {len(EDGES)} AS n_edges FROM long", LONG_SQL))(written_state)
CENTRES = [(a + b) / 2 for a, b in zip(EDGES, EDGES[1:])]
query("k7_decode_state", tape_sql(
    "SELECT security_id, slot, " + ", ".join(
        f"{s}_p_{i}_a + ({_pb(s, i)} - 20) * 100.0 AS {s}_p_{i}, round(exp(ln(1 + greatest({s}_v_{i}_a, 0)) + {CENTRES}[({_vb(s, i)}) + 1]) - 1, 6) + 0.0 AS {s}_v_{i}"
        for s in ("ask", "bid") for i in (1, 5)) + " FROM anchored", DENSE_SQL))(
    lambda t: state.decode_state(state.tokenise(book(t), TICK, EDGES), EDGES, TICK).select("security_id", "slot", *[
        F.col("levels")[i - 1][f"{s}_{x}"].alias(f"{s}_{x}_{i}") for s in ("ask", "bid") for i in (1, 5) for x in ("p", "v")]))
_dep = lambda s: "(" + " + ".join(f"coalesce({s}_v_{i}, 0)" for i in range(1, 11)) + ")"
METRICS_SQL = (f"metrics AS (SELECT security_id, slot, CAST(ask_p_1 - bid_p_1 AS DOUBLE) AS spread, ln((ask_p_1 + bid_p_1) / 2.0) - lag(ln((ask_p_1 + bid_p_1) / 2.0)) OVER w AS mid_return_log, "
               f"CAST({_dep('bid')} AS DOUBLE) AS bid_depth_10, CAST({_dep('ask')} AS DOUBLE) AS ask_depth_10, "
               f"CAST({_dep('bid')} - {_dep('ask')} AS DOUBLE) / ({_dep('bid')} + {_dep('ask')}) AS depth_imbalance_10 FROM state WINDOW w AS (PARTITION BY security_id ORDER BY slot))")
query("k8_state_metrics", tape_sql("SELECT security_id, slot, " + ", ".join(f"{R(m)} AS {m}" for m in state.STATE_METRICS) + " FROM metrics", DENSE_SQL, METRICS_SQL))(
    lambda t: state.state_metrics(book(t), S))

# The generated side of the state reports is the state 24 slots later under the same anchor rule.
PAIR_SQL = ("toks AS (SELECT security_id, slot, slot_no, price_bin * 30 + vol_bin AS token, price_bin, vol_bin FROM long),\n"
            "both_t AS (SELECT security_id, slot_no, 'real' AS kind, token, price_bin, vol_bin FROM toks WHERE (slot // 24) % 2 = 0 AND token IS NOT NULL "
            "UNION ALL SELECT security_id, slot_no, 'generated', token, price_bin, vol_bin FROM toks WHERE (slot // 24) % 2 = 1 AND token IS NOT NULL)")
half = lambda df, k: df.filter(F.floor(F.col("slot") / 24) % 2 == k)
SK = "security_id, slot_no"
_ent = lambda c, n: f"coalesce(-sum(CASE WHEN {c} > 0 THEN {c} / {n} * ln({c} / {n}) END), 0)"
SLOT_SQL = [
    "tc AS (SELECT *, sum(r) OVER p AS tr, sum(g) OVER p AS tg FROM (SELECT security_id, slot_no, token, any_value(price_bin) AS pb, any_value(vol_bin) AS vb, "
    "count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g FROM both_t GROUP BY ALL) WINDOW p AS (PARTITION BY security_id, slot_no))",
    f"basic AS (SELECT {SK}, sum(abs(r / tr - g / tg)) AS token_l1, {_ent('r', 'tr')} AS entropy_real, {_ent('g', 'tg')} AS entropy_generated, "
    f"abs(sum(pb * r) / max(tr) - sum(pb * g) / max(tg)) AS price_bin_diff, abs(sum(vb * r) / max(tr) - sum(vb * g) / max(tg)) AS vol_bin_diff FROM tc GROUP BY {SK})",
    "sc AS (SELECT security_id, slot_no, kind, token AS score, token AS grp FROM both_t)", w_sql("sc", SK, "w"), l1_sql("sc", SK, "l")]
query("k9_slot_report", tape_sql(
    f"SELECT {SK}, " + ", ".join(f"{R(c)} AS {c}" for c in ("token_l1", "entropy_real", "entropy_generated", "price_bin_diff", "vol_bin_diff", "wasserstein", "l1_by_group")) +
    f", n_real, n_generated FROM basic JOIN w USING ({SK}) JOIN l USING ({SK})", LONG_SQL, PAIR_SQL, *SLOT_SQL))(
    lambda t: state.slot_report(half(_toks(t), 0), half(_toks(t), 1), V, S))
query("k9_slot_summary", tape_sql(
    "SELECT security_id, " + ", ".join(f"{R(f'avg({c})')} AS {c}_mean" for c in ("token_l1", "entropy_real", "entropy_generated", "price_bin_diff", "vol_bin_diff")) + ", "
    + ", ".join(f"count({c}) AS {p}n, {R(f'avg({c})')} AS {p}mean, {R(f'max({p}m)')} AS {p}median, {R(f'avg({c}) FILTER ({c} BETWEEN {p}q1 AND {p}q3)')} AS {p}iqm" for c, p in (("wasserstein", "w_"), ("l1_by_group", "l1_")))
    + f" FROM basic JOIN w9 USING ({SK}) JOIN l9 USING ({SK}) JOIN (SELECT security_id, " + ", ".join(
        f"quantile_cont({c}, 0.25) AS {p}q1, quantile_cont({c}, 0.5) AS {p}m, quantile_cont({c}, 0.75) AS {p}q3" for c, p in (("wasserstein", "w_"), ("l1_by_group", "l1_")))
    + f" FROM w9 JOIN l9 USING ({SK}) GROUP BY security_id) USING (security_id) GROUP BY security_id", LONG_SQL, PAIR_SQL, *SLOT_SQL, "w9 AS (SELECT * REPLACE (round(wasserstein, 9) AS wasserstein) FROM w)",
    "l9 AS (SELECT * REPLACE (round(l1_by_group, 9) AS l1_by_group) FROM l)"))(
    lambda t: state.slot_summary(state.slot_report(half(_toks(t), 0), half(_toks(t), 1), V, S).withColumns(
        {c: F.round(c, 9) for c in ("wasserstein", "l1_by_group")}), S))
query("a10_slot_entropy", tape_sql(f"SELECT {SK}, {R('ln(sum(n)) - sum(n * ln(n)) / sum(n)')} AS entropy FROM (SELECT {SK}, token, count(*) AS n FROM both_t GROUP BY ALL) GROUP BY {SK}",
                                   LONG_SQL, PAIR_SQL))(lambda t: agg.slot_entropy(_slot_rows(t), S, "slot_no"))
query("a10_slot_l1", tape_sql(f"SELECT {SK}, {R('token_l1')} AS l1 FROM basic", LONG_SQL, PAIR_SQL, *SLOT_SQL))(
    lambda t: agg.slot_l1(_slot_rows(t), S, "slot_no"))


def _toks(t):
    return t.staged("book-tokens", lambda: state.tokenise(book(t), TICK, EDGES))


def _slot_rows(t):
    return state.slot_rows(half(_toks(t), 0), half(_toks(t), 1), V, S)


CMP_SQL = ("ml AS (" + " UNION ALL ".join(
    f"SELECT security_id, '{m}' AS metric, CASE WHEN (slot // 24) % 2 = 0 THEN 'real' ELSE 'generated' END AS kind, {m} AS score FROM {{src}} WHERE {m} IS NOT NULL" for m in state.STATE_METRICS) + ")")

def _half_metrics_sql():
    """Returns restart where a half starts: the lag runs inside each half."""
    return METRICS_SQL.replace("metrics AS", "hm AS").replace("PARTITION BY security_id ORDER", "PARTITION BY security_id, (slot // 24) % 2 ORDER")


query("k10_state_compare", tape_sql(
    f"SELECT security_id, metric, n_real, n_generated, {R('wasserstein')} AS wasserstein, {R('l1_by_group')} AS l1_by_group FROM w JOIN l USING (security_id, metric)",
    DENSE_SQL, _half_metrics_sql(), CMP_SQL.format(src="hm"), w_sql("ml", "security_id, metric", "w"), rule_sql("ml", "security_id, metric", "fd"),
    "own AS (SELECT * REPLACE (CASE WHEN metric = 'spread' THEN score ELSE grp END AS grp) FROM fd)", l1_sql("own", "security_id, metric", "l")))(
    lambda t: state.state_compare(half(book(t), 0), half(book(t), 1), S))
START = 1_704_067_200_000 // STEP_MS + 100
query("k11_horizon", tape_sql(
    f"SELECT security_id, slot, CASE WHEN i < 48 THEN 'context' ELSE 'horizon' END AS part, CASE WHEN i < 48 THEN i ELSE i - 48 END AS step FROM "
    f"(SELECT security_id, slot, row_number() OVER (PARTITION BY security_id ORDER BY slot) - 1 AS i FROM state WHERE slot >= {START}) WHERE i < 168", DENSE_SQL))(
    lambda t: state.horizon(book(t), START, 48, 120, S).select("security_id", "slot", "part", "step"))

# W11 - W13, O4, C1 - C3
query("w11_windows", flow_q(
    f"SELECT {K}, row_seq AS start, array_to_string(ctx, ',') AS context, target FROM (SELECT {K}, row_seq, list(order_token) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ctx, "
    f"lead(order_token, 10) OVER w AS target FROM tokens WINDOW w AS (PARTITION BY {K} ORDER BY row_seq)) WHERE target IS NOT NULL", TOKENS_SQL))(
    lambda t: windows.windows(t.tokens, 10).withColumn("context", F.array_join(F.col("context").cast("array<string>"), ",")))
query("w12_grid_windows", tape_sql(
    "SELECT security_id, start, slot FROM (SELECT security_id, slot, row_number() OVER w - 1 AS start, lead(slot, 2) OVER w AS e FROM slots "
    "WINDOW w AS (PARTITION BY security_id ORDER BY slot)) WHERE start % 3 = 0 AND e - slot = 2", SNAP_SQL))(
    lambda t: windows.grid_windows(state.last_per_slot(snapshots(t), STEP_MS, S), 2, 3, S))
SPLIT_SQL = (f"CASE WHEN row_seq < floor(0.6 * n) THEN 'train' WHEN row_seq < floor(0.6 * n) + floor(0.2 * n) THEN 'val' ELSE 'test' END AS split FROM "
             f"(SELECT *, CAST(count(*) OVER (PARTITION BY {K}) - 50 AS DOUBLE) AS n FROM flow) WHERE row_seq < n")
query("w13_split_ordered", flow_q(f"SELECT {K}, row_seq, {SPLIT_SQL}"))(
    lambda t: windows.split_ordered(t.flow.select(*FLOW_KEYS, "row_seq"), 50))
query("o4_thin", flow_q(f"SELECT {K}, row_seq FROM flow WHERE row_seq % 7 = 0"))(
    lambda t: windows.thin(t.flow.select(*FLOW_KEYS, "row_seq"), 7))
query("o4_thin_share", flow_q(f"SELECT {K}, row_seq FROM flow WHERE row_seq % 7 = 0 AND ((row_seq % 1000003) * 7919 + 42 * 104729) % 1000003 < 250000"))(
    lambda t: windows.thin(t.flow.select(*FLOW_KEYS, "row_seq"), 7, 250_000 / 1_000_003 + 1e-9))
FEATURES_SQL = f"""feats AS (SELECT {K}, row_seq AS start, avg(coalesce(price_diff, 0)) OVER w AS pm_mean, stddev_pop(coalesce(price_diff, 0)) OVER w AS pm_std,
  avg(abs(coalesce(price_diff, 0))) OVER w AS pm_abs_mean, avg(ln(1 + greatest(interval_ms, 0))) OVER w AS log_interval_mean, avg(ln(1 + greatest(order_qty, 0))) OVER w AS log_qty_mean,
  """ + ", ".join(f"avg(CASE WHEN side = {s} THEN 1.0 ELSE 0.0 END) OVER w AS frac_side_{s}" for s in windows.SIDES) + f""",
  0.0 AS mid_return, t_ms // 3600000 + ((t_ms // 60000) % 60) / 60.0 AS tod_hour, lead(1, 49) OVER (PARTITION BY {K} ORDER BY row_seq) AS whole, count(*) OVER (PARTITION BY {K}) AS n_all
  FROM flow WINDOW w AS (PARTITION BY {K} ORDER BY row_seq ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))"""
FLIST = ", ".join(f"{R(f)} AS {f}" for f in windows.FEATURES)
query("c1_window_features", flow_q(f"SELECT {K}, start, {FLIST} FROM feats WHERE whole = 1 AND start % 2 = 0", FEATURES_SQL))(
    lambda t: windows.window_features(t.flow, 50, 2))
query("c2_train_windows", flow_q(f"SELECT {K}, start, {FLIST} FROM feats WHERE whole = 1 AND start % 2 = 0 AND start < floor(0.6 * (n_all - 50))", FEATURES_SQL))(
    lambda t: windows.train_windows(t.flow, 50, 2))

# P5, P6, P9, P10, S10 on the tape
query("p5_level_range", tape_sql("SELECT run_id, kind, row_seq, bid_p_3 AS low, ask_p_3 AS high FROM tape"))(
    lambda t: t.tape.select(*TAPE_KEYS, "row_seq", filters.level_range(F.col("levels"), 3)[0].alias("low"), filters.level_range(F.col("levels"), 3)[1].alias("high")))
query("p6_filter_by_level", tape_sql("SELECT run_id, kind, row_seq, price FROM tape WHERE price BETWEEN bid_p_3 AND ask_p_3"))(
    lambda t: filters.filter_by_level(t.tape, 3).select(*TAPE_KEYS, "row_seq", "price"))
query("s10_cut_to_level", tape_sql("SELECT run_id, kind, row_seq, price, 3 AS depth, ask_p_3 AS last_ask FROM tape WHERE price BETWEEN bid_p_3 AND ask_p_3"))(
    lambda t: filters.cut_to_level(t.tape, 3).select(*TAPE_KEYS, "row_seq", "price", F.size("levels").alias("depth"), F.col("levels")[2]["ask_p"].alias("last_ask")))
query("p9_finite", tape_sql(f"SELECT run_id, kind, row_seq, {R('ln(row_seq % 5)')} AS x FROM tape WHERE row_seq % 5 > 0"))(
    lambda t: filters.finite(t.tape.select(*TAPE_KEYS, "row_seq", F.when(F.col("row_seq") % 5 == 0, F.lit(float("-inf"))).otherwise(
        F.log((F.col("row_seq") % 5).cast("double"))).alias("x")), ["x"]))
query("p10_events", tape_sql("SELECT run_id, kind, row_seq, event_type FROM tape WHERE event_type NOT IN (4, 5)"))(
    lambda t: micro.events(t.tape, (4, 5), keep=False).select(*TAPE_KEYS, "row_seq", "event_type"))
