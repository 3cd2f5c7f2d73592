"""Queries D: distances between the real and the generated part of the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.operators import aggregates as agg, distances as dist, micro, sequences
from bookflow.plans import benchmark as bench
from catalog import query
from catalog.adapters import TAPE_KEYS
from catalog.q_micro import ACF_SQL, HALF_HOUR, K, MID, OFI_SQL, OWN, PREV_SQL, R, VPM_SQL, describe_sql, level_sql, returns_sql, tape_sql

RUN = ["run_id"]


def w_sql(source: str, keys: str, out: str, ddof: int = 1, extra: str = "") -> str:
    """CTEs giving keys, n_real, n_generated, wasserstein of source(keys, kind, score)."""
    std = "stddev_samp" if ddof == 1 else "stddev_pop"
    on = keys
    return f"""{out}_h AS (SELECT {keys}, CAST(score AS DOUBLE) AS v, count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g
  FROM {source} GROUP BY ALL),
{out}_c AS (SELECT {keys}, v, sum(r) OVER w / nullif(sum(r) OVER p, 0) AS fr, sum(g) OVER w / nullif(sum(g) OVER p, 0) AS fg,
  lead(v) OVER w - v AS step FROM {out}_h WINDOW w AS (PARTITION BY {keys} ORDER BY v), p AS (PARTITION BY {keys})),
{out}_s AS (SELECT {keys}, {std}(score) AS sd, CAST(count(*) FILTER (kind = 'real') AS BIGINT) AS n_real,
  CAST(count(*) FILTER (kind = 'generated') AS BIGINT) AS n_generated FROM {source} GROUP BY ALL),
{out} AS (SELECT {keys}, n_real, n_generated, CASE WHEN sd > 0 AND n_real > 0 AND n_generated > 0 THEN w / sd END AS wasserstein
  FROM (SELECT {keys}, coalesce(sum(abs(fr - fg) * step), 0) AS w FROM {out}_c GROUP BY {keys}) JOIN {out}_s USING ({on}))"""


def l1_sql(source: str, keys: str, out: str) -> str:
    """CTEs giving keys, l1_by_group of source(keys, kind, grp)."""
    return f"""{out}_g AS (SELECT {keys}, grp, count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g FROM {source} GROUP BY ALL),
{out} AS (SELECT {keys}, CASE WHEN max(tr) > 0 AND max(tg) > 0 THEN sum(abs(r / tr - g / tg)) / 2 ELSE 1.0 END AS l1_by_group
  FROM (SELECT *, sum(r) OVER p AS tr, sum(g) OVER p AS tg FROM {out}_g WINDOW p AS (PARTITION BY {keys})) GROUP BY {keys})"""


def rule_sql(source: str, keys: str, out: str, width: str = "2 * (q3 - q1) * pow(n, -1.0 / 3)") -> str:
    """CTEs giving source plus grp by a histogram rule."""
    return f"""{out}_q AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, min(score) AS lo, max(score) AS hi, quantile_cont(CAST(score AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST(score AS DOUBLE), 0.75) AS q3 FROM {source} GROUP BY {keys}),
{out}_e AS (SELECT {keys}, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi,
  greatest(CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END, 1) AS bins FROM (SELECT *, {width} AS width FROM {out}_q)),
{out} AS (SELECT s.*, len(list_filter(edges, lambda e: e <= s.score)) AS grp FROM {source} s JOIN (
  SELECT {keys}, list_transform(range(0, CAST(bins AS BIGINT) + 1), lambda i: CASE WHEN i = bins THEN hi ELSE lo + i * ((hi - lo) / bins) END) AS edges
  FROM {out}_e) USING ({keys}))"""


SPREADS = "spreads AS (SELECT run_id, kind, ask_p_1 - bid_p_1 AS score FROM tape)"
IMB = "imb AS (SELECT run_id, kind, row_seq, CAST(bid_v_1 - ask_v_1 AS DOUBLE) / (bid_v_1 + ask_v_1) AS score FROM tape)"
spreads = lambda t: micro.spread(t.tape).withColumnRenamed("spread", "score")
imb = lambda t: micro.book_imbalance(t.tape).withColumnRenamed("imbalance", "score")

query("d6_wasserstein", tape_sql(f"SELECT run_id, n_real, n_generated, {R('wasserstein')} AS wasserstein FROM w",
                                 IMB, w_sql("imb", "run_id", "w")))(lambda t: dist.wasserstein(imb(t), RUN))
query("d17_wasserstein_population", tape_sql(
    f"SELECT run_id, n_real, n_generated, {R('wasserstein')} AS wasserstein FROM w", IMB, w_sql("imb", "run_id", "w", ddof=0)))(
    lambda t: dist.wasserstein(imb(t), RUN, ddof=0))
query("d7_l1_by_group", tape_sql(
    f"SELECT run_id, {R('l1_by_group')} AS l1_by_group FROM l",
    "grouped AS (SELECT run_id, kind, event_type AS grp FROM tape)", l1_sql("grouped", "run_id", "l")))(
    lambda t: dist.l1_by_group(t.tape.withColumn("grp", F.col("event_type")), RUN))
COMPARED = f"SELECT run_id, n_real, n_generated, {R('wasserstein')} AS wasserstein, {R('l1_by_group')} AS l1_by_group FROM w JOIN l USING (run_id)"
query("d8_compare_discrete", tape_sql(
    COMPARED, SPREADS, w_sql("spreads", "run_id", "w"), "g AS (SELECT *, score AS grp FROM spreads)", l1_sql("g", "run_id", "l")))(
    lambda t: dist.compare(spreads(t), RUN, discrete=True))
query("d8_compare", tape_sql(
    COMPARED, IMB, w_sql("imb", "run_id", "w"), rule_sql("imb", "run_id", "g"), l1_sql("g", "run_id", "l")))(
    lambda t: dist.compare(imb(t), RUN))

# D3 / D4: groupings
GROUPED = f"SELECT {K}, row_seq, grp FROM g"
one = lambda df: df.select(*TAPE_KEYS, "row_seq", "grp")
query("d3_group_discrete", tape_sql(
    f"SELECT {K}, row_seq, dense_rank() OVER (PARTITION BY run_id ORDER BY size) AS grp FROM tape"))(
    lambda t: one(dist.group_scores(t.tape.withColumn("score", F.col("size")), RUN, "discrete")))
RULES = {"fd": None, "sturges": "(hi - lo) / (log2(n) + 1)", "sqrt": "(hi - lo) / sqrt(n)", "rice": "(hi - lo) / (2 * pow(n, 1.0 / 3))",
         "auto": "least(greatest(2 * (q3 - q1) * pow(n, -1.0 / 3), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1))"}
for rule, width in RULES.items():
    query(f"d3_group_{rule}", tape_sql(GROUPED, IMB, rule_sql("imb", "run_id", "g", *([width] if width else []))))(
        lambda t, rule=rule: one(dist.group_scores(imb(t), RUN, "rule", rule=rule)))
_moments = "stddev_pop(score) AS sd, (avg(pow(score, 3)) - 3 * avg(score) * avg(score * score) + 2 * pow(avg(score), 3)) / pow(stddev_pop(score), 3) AS skew, "
for rule, width in (("scott", "pow(24 * sqrt(pi()) / n, 1.0 / 3) * sd"),
                    ("doane", "CASE WHEN n > 2 AND sd > 0 THEN (hi - lo) / (1 + log2(n) + log2(1 + abs(skew) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) ELSE 0 END")):
    query(f"d3_group_{rule}", tape_sql(GROUPED, IMB, rule_sql("imb", "run_id", "g", width).replace("min(score) AS lo", _moments + "min(score) AS lo", 1)))(
        lambda t, rule=rule: one(dist.group_scores(imb(t), RUN, "rule", rule=rule)))
STONE_SQL = """sh AS (SELECT run_id, score AS v, count(*) AS c FROM imb GROUP BY ALL), st AS (SELECT run_id, CAST(sum(c) AS DOUBLE) AS n, min(v) AS lo, max(v) AS hi FROM sh GROUP BY run_id),
sb AS (SELECT run_id, v, c, n, lo, hi, unnest(range(1, greatest(100, CAST(floor(sqrt(n)) AS BIGINT)) + 1)) AS b FROM sh JOIN st USING (run_id)),
sg AS (SELECT *, CASE WHEN v < lo + g * ((hi - lo) / b) THEN g - 1 WHEN g <> b - 1 AND v >= lo + (g + 1) * ((hi - lo) / b) THEN g + 1 ELSE g END AS k FROM (SELECT *, least(CAST(floor((v - lo) / (hi - lo) * b) AS BIGINT), b - 1) AS g FROM sb)),
sc AS (SELECT run_id, b, (2 - (n + 1) * (sum(q) / (n * n))) / ((hi - lo) / b) AS cost FROM (SELECT run_id, b, k, n, lo, hi, pow(sum(c), 2) AS q FROM sg GROUP BY ALL) GROUP BY run_id, b, n, lo, hi),
stone AS (SELECT run_id, arg_min(b, (cost, b)) AS stone FROM sc GROUP BY run_id)"""
query("d3_group_stone", tape_sql(GROUPED, IMB, STONE_SQL, rule_sql("imb", "run_id", "g", "(hi - lo) / stone").replace("FROM g_q)", "FROM g_q JOIN stone USING (run_id))")))(
    lambda t: one(dist.group_scores(imb(t), RUN, "rule", rule="stone")))
query("d3_group_bins", tape_sql(
    f"SELECT {K}, row_seq, len(list_filter(list_transform(range(1, 8), lambda i: lo + i * ((hi - lo) / 8)), lambda e: e <= score)) AS grp "
    "FROM imb JOIN (SELECT run_id, min(score) AS lo, max(score) AS hi FROM imb GROUP BY run_id) USING (run_id)", IMB))(
    lambda t: one(dist.group_scores(imb(t), RUN, "bins", bins=8)))
DECILES = [i / 10 for i in range(1, 10)]
DECILE_SQL = ("cuts AS (SELECT run_id, quantile_cont(CAST(score AS DOUBLE), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM {src} GROUP BY run_id),\n"
              "kept AS (SELECT run_id, list_filter(q, lambda e, i: i < 3 OR NOT (e = q[i - 1] AND q[i - 1] = q[i - 2])) AS k FROM cuts),\n"
              "edges AS (SELECT run_id, list_transform(k, lambda e, i: CASE WHEN i > 1 AND e = k[i - 1] THEN e + 0.01 ELSE e END) AS e FROM kept)")
query("d3_group_quantiles", tape_sql(
    f"SELECT {K}, row_seq, len(list_filter(e, lambda x: x <= score)) AS grp FROM imb JOIN edges USING (run_id)",
    IMB, DECILE_SQL.format(src="imb")))(lambda t: one(dist.group_scores(imb(t), RUN, "quantiles", probs=DECILES)))
query("d3_group_thresholds", tape_sql(
    f"SELECT {K}, row_seq, len(list_filter([-0.5, 0.0, 0.5], lambda x: x <= score)) AS grp FROM imb", IMB))(
    lambda t: one(dist.group_scores(imb(t), RUN, "thresholds", thresholds=[-0.5, 0.0, 0.5])))
query("d4_quantile_edges", tape_sql(
    "SELECT run_id, unnest(range(0, len(e))) AS edge_no, round(unnest(e), 6) + 0.0 AS edge FROM edges",
    "few AS (SELECT run_id, kind, event_type AS score FROM tape)", DECILE_SQL.format(src="few")))(
    lambda t: dist.quantile_edges(t.tape.withColumn("score", F.col("event_type")), RUN, DECILES).select(
        "run_id", F.posexplode("edges").alias("edge_no", "edge")))

GIVEN = f"SELECT run_id, n_real, n_generated, {R('weighted_wasserstein')} AS weighted_wasserstein, num_condition_groups FROM cond"
COND_SQL = """cond AS (SELECT run_id, CAST(sum(n_real) AS BIGINT) AS n_real, CAST(sum(n_generated) AS BIGINT) AS n_generated,
  CASE WHEN bool_and(wasserstein IS NOT NULL) THEN sum(wasserstein * (n_real + n_generated)) / sum(n_real + n_generated) END AS weighted_wasserstein,
  count(*) AS num_condition_groups FROM w GROUP BY run_id)"""
pair = lambda t: t.tape.select(*TAPE_KEYS, micro.touch("ask_v").alias("score"), micro.imbalance_of().alias("given"))
PAIR = "pair AS (SELECT run_id, kind, ask_v_1 AS score, CAST(bid_v_1 - ask_v_1 AS DOUBLE) / (bid_v_1 + ask_v_1) AS given FROM tape)"
query("d9_given_quantiles", tape_sql(
    GIVEN, PAIR, DECILE_SQL.format(src="(SELECT run_id, given AS score FROM pair)"),
    "g AS (SELECT pair.*, len(list_filter(e, lambda x: x <= given)) AS grp FROM pair JOIN edges USING (run_id))",
    w_sql("g", "run_id, grp", "w"), COND_SQL))(lambda t: dist.compare_given(pair(t), RUN, "quantiles", probs=DECILES))
query("d9_given_discrete", tape_sql(
    GIVEN, "g AS (SELECT run_id, kind, ask_v_1 AS score, ask_p_1 - bid_p_1 AS grp FROM tape)", w_sql("g", "run_id, grp", "w"), COND_SQL))(
    lambda t: dist.compare_given(t.tape.select(*TAPE_KEYS, micro.touch("ask_v").alias("score"), micro.spread_of().alias("given")), RUN, "discrete"))
query("d9_given_thresholds", tape_sql(
    GIVEN, PAIR, "g AS (SELECT *, len(list_filter([-0.9, 0.0, 0.9], lambda x: x <= given)) AS grp FROM pair)",
    w_sql("g", "run_id, grp", "w"), COND_SQL))(
    lambda t: dist.compare_given(pair(t), RUN, "thresholds", thresholds=[-0.9, 0.0, 0.9]))

# D10: the whole comparison
_away = f"(price - {MID})"
_log = lambda x: f"ln(CASE WHEN {x} = 0 THEN 1e-9 ELSE {x} END)"
_plain = {
    "spread": ("tape", "ask_p_1 - bid_p_1", "TRUE"),
    "orderbook_imbalance": ("tape", "CAST(bid_v_1 - ask_v_1 AS DOUBLE) / (bid_v_1 + ask_v_1)", "TRUE"),
    "ask_volume_touch": ("tape", "ask_v_1", "TRUE"), "bid_volume_touch": ("tape", "bid_v_1", "TRUE"),
    "ask_volume": ("tape", " + ".join(f"ask_v_{i}" for i in range(1, 11)), "TRUE"),
    "bid_volume": ("tape", " + ".join(f"bid_v_{i}" for i in range(1, 11)), "TRUE"),
    "limit_ask_order_depth": ("tape", _away, f"event_type = 1 AND {_away} > 0"),
    "limit_bid_order_depth": ("tape", f"-{_away}", f"event_type = 1 AND {_away} < 0"),
    "ask_cancellation_depth": ("tape", _away, f"event_type IN (2, 3) AND {_away} > 0"),
    "bid_cancellation_depth": ("tape", f"-{_away}", f"event_type IN (2, 3) AND {_away} < 0"),
    "limit_ask_order_levels": ("lim", "level", "side = 'ask'"), "limit_bid_order_levels": ("lim", "level", "side = 'bid'"),
    "ask_cancellation_levels": ("can", "level", "side = 'ask'"), "bid_cancellation_levels": ("can", "level", "side = 'bid'"),
    "vol_per_min": ("vpm", "volume_per_minute", "volume_per_minute IS NOT NULL"),
    "log_inter_arrival_time": ("gaps", _log("g"), "g IS NOT NULL"),
    "log_time_to_cancel": ("cancels", _log("d"), "TRUE"),
    "ofi": ("ofi", "ofi", "row_seq >= 100"), "ofi_up": ("ofi", "ofi", "row_seq >= 100 AND next_move > 0"),
    "ofi_stay": ("ofi", "ofi", "row_seq >= 100 AND next_move = 0"), "ofi_down": ("ofi", "ofi", "row_seq >= 100 AND next_move < 0"),
}
_given = {
    "ask_volume | spread": ("tape", "ask_v_1", "CAST(ask_p_1 - bid_p_1 AS DOUBLE)"),
    "spread | time": ("tape JOIN day0 USING (run_id, kind)", "ask_p_1 - bid_p_1",
                      f"CAST(len(list_filter({bench.DAY_EDGES}, lambda e: e <= (t_ns - d0) / 1e9)) AS DOUBLE)"),
    "spread | volatility": ("tape JOIN vol USING (run_id, kind)", "ask_p_1 - bid_p_1", "vol"),
}
D10_CTES = [
    OFI_SQL, PREV_SQL, VPM_SQL, returns_sql(bench.VOLATILITY_NS),
    f"lim AS ({level_sql('tape', '(1)')})", f"can AS ({level_sql('before', '(2, 3)')})",
    f"gaps AS (SELECT {K}, (t_ns - lag(t_ns) OVER ({OWN})) / 1e6 AS g FROM tape)",
    f"known AS (SELECT DISTINCT {K}, order_id FROM tape WHERE event_type = 1)",
    f"ranked AS (SELECT {K}, order_id, t_ns, row_number() OVER (PARTITION BY {K}, order_id ORDER BY row_seq) AS rk "
    f"FROM tape SEMI JOIN known USING ({K}, order_id) WHERE event_type IN (1, 2, 3))",
    f"cancels AS (SELECT {K}, (max(t_ns) FILTER (rk = 2) - max(t_ns) FILTER (rk = 1)) / 1e9 AS d FROM ranked WHERE rk <= 2 "
    f"GROUP BY {K}, order_id HAVING count(*) = 2)",
    f"day0 AS (SELECT {K}, arg_min(t_ns, row_seq) - arg_min(t_ns, row_seq) % 86400000000000 AS d0 FROM tape GROUP BY {K})",
    f"vol AS (SELECT {K}, coalesce(stddev_samp(ret), 0) AS vol FROM rets GROUP BY {K})",
    "scores AS (" + " UNION ALL ".join(
        f"SELECT {K}, '{m}' AS metric, CAST({expr} AS DOUBLE) AS score FROM {src} WHERE {cond}" for m, (src, expr, cond) in _plain.items()) + ")",
    "given AS (" + " UNION ALL ".join(
        f"SELECT {K}, '{m}' AS metric, CAST({expr} AS DOUBLE) AS score, {g} AS grp FROM {src}" for m, (src, expr, g) in _given.items()) + ")",
    w_sql("scores", "run_id, metric", "w1"), rule_sql("scores", "run_id, metric", "fd"),
    f"own AS (SELECT * REPLACE (CASE WHEN metric IN {bench.DISCRETE} THEN score ELSE grp END AS grp) FROM fd)",
    l1_sql("own", "run_id, metric", "l"), w_sql("given", "run_id, metric, grp", "w2"),
    """results AS (SELECT run_id, metric, n_real, n_generated, wasserstein, l1_by_group, NULL AS weighted_wasserstein, NULL AS num_condition_groups
      FROM w1 JOIN l USING (run_id, metric) UNION ALL
      SELECT run_id, metric, CAST(sum(n_real) AS BIGINT), CAST(sum(n_generated) AS BIGINT), NULL, NULL, CASE WHEN bool_and(wasserstein IS NOT NULL)
        THEN sum(wasserstein * (n_real + n_generated)) / sum(n_real + n_generated) END, count(*) FROM w2 GROUP BY run_id, metric)""",
]
METRIC_LIST = list(bench.UNCONDITIONAL) + list(bench.CONDITIONAL)
OK = "coalesce(n_real, 0) > 0 AND coalesce(n_generated, 0) > 0"
query("d10_benchmark", tape_sql(
    "SELECT run_id, metric, " + ", ".join(f"CASE WHEN {OK} THEN {x} END AS {c}" for c, x in (
        ("n_real", "n_real"), ("n_generated", "n_generated"), ("wasserstein", R("wasserstein")), ("l1_by_group", R("l1_by_group")),
        ("weighted_wasserstein", R("weighted_wasserstein")), ("num_condition_groups", "num_condition_groups"))) +
    f", CASE WHEN {OK} THEN 'ok' ELSE 'failed' END AS status, CASE WHEN NOT ({OK}) THEN '{bench.EMPTY_SAMPLE}' END AS reason "
    f"FROM (SELECT run_id, unnest({METRIC_LIST}) AS metric FROM (SELECT DISTINCT run_id FROM tape)) LEFT JOIN results USING (run_id, metric)", *D10_CTES))(
    lambda t: bench.benchmark(t.tape))

# M20: summary of each tape
_melt = lambda section, src, stats: " UNION ALL ".join(
    f"SELECT {K}, '{section}' AS section, '{s}' AS stat, CAST({x} AS DOUBLE) AS value FROM {src}" for s, x in stats.items())
_mix = lambda c: " UNION ALL ".join(
    f"SELECT {K}, '{c}' AS section, concat('{p}_', v) AS stat, CAST({x} AS DOUBLE) AS value FROM (SELECT {K}, {c} AS v, count(*) AS n, "
    f"round_even(count(*) / sum(count(*)) OVER (PARTITION BY {K}), 4) AS f FROM tape GROUP BY {K}, {c})" for p, x in (("count", "n"), ("fraction", "f")))
_asum = " + ".join(f"ask_v_{i}" for i in range(1, 6))
_bsum = " + ".join(f"bid_v_{i}" for i in range(1, 6))
M20_CTES = [
    OFI_SQL, VPM_SQL, returns_sql(HALF_HOUR),
    f"gaps AS (SELECT {K}, CASE WHEN g >= 0 THEN g END AS gap FROM (SELECT {K}, (t_ns - lag(t_ns) OVER ({OWN})) / 1e6 AS g FROM tape WHERE event_type NOT IN (4, 5)))",
    f"iat AS ({describe_sql('gaps', 'gap')})",
    f"execs AS (SELECT {K}, count(*) FILTER (event_type IN (4, 5)) AS n_exec_excluded FROM tape GROUP BY {K})",
    f"spr AS (SELECT {K}, count(s) AS n, avg(s) AS mean, quantile_cont(s, 0.5) AS median, stddev_samp(s) AS std, avg(CAST(raw <= 0 AS INT)) AS share "
    f"FROM (SELECT {K}, ask_p_1 - bid_p_1 AS raw, CASE WHEN ask_p_1 > bid_p_1 THEN (ask_p_1 - bid_p_1) / 100.0 END AS s FROM tape) GROUP BY {K})",
    f"mids AS (SELECT {K}, arg_min(m, row_seq) AS a, arg_max(m, row_seq) AS z, avg(m) AS mean, stddev_samp(m) AS std FROM (SELECT *, {MID} AS m FROM tape) GROUP BY {K})",
    f"ret AS (SELECT {K}, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM rets GROUP BY {K})",
    f"rx AS (SELECT {K}, ret - avg(ret) OVER (PARTITION BY {K}) AS x, row_number() OVER (PARTITION BY {K} ORDER BY label_ns) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM rets WHERE ret IS NOT NULL)",
    "rc AS (SELECT a.run_id, a.kind, k, max(a.n) AS n, sum(a.x * b.x) AS c FROM rx a, range(0, 11) t(k), rx b WHERE a.run_id = b.run_id AND a.kind = b.kind AND b.i = a.i + k GROUP BY ALL)",
    f"ac AS (SELECT {K}, k, n, c / first_value(c) OVER (PARTITION BY {K} ORDER BY k) AS acf FROM rc)",
    f"vols AS (SELECT {K}, avg(ask_v_1) AS am, avg(bid_v_1) AS bm, quantile_cont(CAST(ask_v_1 AS DOUBLE), 0.5) AS amed, quantile_cont(CAST(bid_v_1 AS DOUBLE), 0.5) AS bmed, "
    f"avg({_asum}) AS a5, avg({_bsum}) AS b5, avg(i) AS im, stddev_samp(i) AS isd, quantile_cont(i, 0.5) AS imed "
    f"FROM (SELECT *, CAST(bid_v_1 - ask_v_1 AS DOUBLE) / (bid_v_1 + ask_v_1) AS i FROM tape) GROUP BY {K})",
    f"vp AS (SELECT {K}, count(*) AS n, avg(volume_per_minute) AS mean, sum(volume_per_minute) AS total FROM vpm WHERE volume_per_minute IS NOT NULL GROUP BY {K})",
    f"of AS (SELECT {K}, count(*) AS n, avg(ofi) AS mean, stddev_samp(ofi) AS std FROM ofi WHERE row_seq >= 100 GROUP BY {K})",
]
query("m20_stream_summary", tape_sql(
    f"SELECT {K}, section, stat, {R('value')} AS value FROM (" + " UNION ALL ".join([
        _mix("event_type"), _mix("direction"),
        _melt("iat_ms", "iat JOIN execs USING (run_id, kind)", {s: s for s in ("n", "n_exec_excluded", "mean", "median", "std", "p95")}),
        _melt("spread_ticks", "spr", {"n": "n", "mean": "mean", "median": "median", "std": "std", "share_not_positive": "share"}),
        _melt("mid_price", "mids", {"start_mid": "a", "end_mid": "z", "mean_mid": "mean", "std_mid": "std", "return_bps": "(z / a - 1) * 10000"}),
        _melt("returns", "ret", {s: s for s in ("n", "mean", "std", "skew", "kurtosis")}),
        _melt("volatility", "ret", {"volatility": "coalesce(std, 0)"}),
        _melt("l1_volume", "vols", {"ask_mean": "am", "bid_mean": "bm", "ask_median": "amed", "bid_median": "bmed"}),
        _melt("total_volume_5", "vols", {"ask5_mean": "a5", "bid5_mean": "b5"}),
        _melt("volume_per_minute", "vp", {s: s for s in ("n", "mean", "total")}),
        _melt("ob_imbalance", "vols", {"mean": "im", "std": "isd", "median": "imed"}),
        _melt("orderflow_imbalance", "of", {s: s for s in ("n", "mean", "std")}),
        f"SELECT {K}, 'acf_returns' AS section, concat('lag_', k) AS stat, acf AS value FROM ac WHERE k <= greatest(1, least(10, n - 2))",
    ]) + ")", *M20_CTES))(lambda t: bench.stream_summary(t.tape, minute_ns=HALF_HOUR))

# D1, D2, D5, X1: scores of sequences and sub-sequences
query("d1_score_sequences", tape_sql(
    f"SELECT {K}, sub_id, {R('avg(s)')} AS score FROM (SELECT {K}, row_seq // 250 AS sub_id, ask_p_1 - bid_p_1 AS s FROM tape) GROUP BY ALL"))(
    lambda t: sequences.score(sequences.subseqs(t.tape, length=250),
                              lambda d, keys: d.groupBy(*keys).agg(F.avg(micro.spread_of()).alias("score"))))
query("d2_subseqs_count", tape_sql(
    f"SELECT {K}, sub_id, count(*) AS n, min(row_seq) AS first_row FROM (SELECT {K}, row_seq, row_seq // (count(*) FILTER (kind = 'real') OVER "
    "(PARTITION BY run_id) // 7) AS sub_id FROM tape) GROUP BY ALL"))(
    lambda t: sequences.subseqs(t.tape, n=7).groupBy(*TAPE_KEYS, "sub_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_seq").alias("first_row")))
query("d2_subseqs_every", tape_sql(
    f"SELECT {K}, sub_id, count(*) AS n FROM (SELECT {K}, t_ns // 86400000000000 - min(t_ns // 86400000000000) OVER (PARTITION BY {K}) AS sub_id FROM tape) GROUP BY ALL"))(
    lambda t: sequences.subseqs(t.tape, every_ns=86_400 * micro.NS).groupBy(*TAPE_KEYS, "sub_id").agg(F.count(F.lit(1)).alias("n")))
query("d5_score_table", tape_sql(
    f"SELECT {K}, row_seq, size AS score, row_seq % 250 AS grp FROM tape"))(
    lambda t: sequences.score_table(sequences.position_groups(sequences.subseqs(t.tape, length=250)), "size", "grp"))
query("x1_user_metric", tape_sql(
    f"SELECT run_id, 'signed_size' AS metric, n_real, n_generated, {R('wasserstein')} AS wasserstein, {R('l1_by_group')} AS l1_by_group, CAST(NULL AS DOUBLE) AS weighted_wasserstein, "
    "CAST(NULL AS BIGINT) AS num_condition_groups, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM w JOIN l USING (run_id)",
    "signed AS (SELECT run_id, kind, CAST(size * direction AS DOUBLE) AS score FROM tape)", w_sql("signed", "run_id", "w"), rule_sql("signed", "run_id", "g"), l1_sql("g", "run_id", "l")))(
    lambda t: _with_user_metric(t))
query("x1_user_function", tape_sql(
    f"SELECT {K}, sub_id, {R('max(price) - min(price)')} AS score FROM (SELECT {K}, row_seq // 500 AS sub_id, price FROM tape) GROUP BY ALL"))(
    lambda t: sequences.score_with_python(sequences.subseqs(t.tape, length=500).select(*TAPE_KEYS, "sub_id", "row_seq", "price"),
                                          _price_range, [*TAPE_KEYS, "sub_id"]))


def _price_range(rows) -> float:
    return float(rows["price"].max() - rows["price"].min())


def _with_user_metric(t):
    bench.register_metric("signed_size", lambda tape: tape.select(*TAPE_KEYS, (F.col("size") * F.col("direction")).alias("score")))
    try:
        return bench.benchmark(t.tape).filter("metric = 'signed_size'")
    finally:
        bench.unregister_metric("signed_size")


query("a11_iqm", tape_sql(
    f"SELECT run_id, count(*) AS n, {R('avg(score)')} AS mean, {R('max(m)')} AS median, {R('avg(score) FILTER (score BETWEEN q1 AND q3)')} AS iqm "
    "FROM imb JOIN (SELECT run_id, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS m, quantile_cont(score, 0.75) AS q3 "
    "FROM imb GROUP BY run_id) USING (run_id) GROUP BY run_id", IMB))(lambda t: agg.iqm(imb(t), "score", RUN))

# D11 - D14
REPLICATES = 20


def split_sql(source: str, cols: str) -> list[str]:
    """CTEs ending in `drawn`(run_id, kind, b, cols, weight): source(run_id, kind, cols) resampled by the split tree; b = 0 is the source itself."""
    toss = lambda x: f"list_transform([{x}], lambda v: ((v % {dist.PRIME}) * (v % {dist.PRIME}) + 5 * (v % {dist.PRIME}) + 1013904223) % {dist.PRIME})[1]"
    u = toss(toss("state + 65537 * i"))
    return [
        f"uniq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY {cols}) AS rk FROM (SELECT run_id, kind, {cols}, count(*) AS n FROM {source} GROUP BY ALL))",
        "cums AS MATERIALIZED (SELECT run_id, kind, list(c ORDER BY rk) AS c, max(rk) AS d FROM (SELECT run_id, kind, rk, CAST(sum(n) OVER (PARTITION BY run_id, kind ORDER BY rk) AS BIGINT) AS c FROM uniq UNION ALL SELECT DISTINCT run_id, kind, 0, 0 FROM uniq) GROUP BY ALL)",
        f"""tree AS (SELECT run_id, kind, b, CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS lo, d AS hi, c[d + 1] AS k FROM cums, (SELECT unnest(range(1, {REPLICATES + 1})) AS b)
  UNION ALL SELECT run_id, kind, b, 2 * id + side, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END, CASE WHEN side = 0 THEN l ELSE k - l END FROM (
    SELECT *, CAST(CASE WHEN k <= {dist.FEW} THEN list_sum(list_transform(us, lambda x, i: CASE WHEN i <= k AND CAST(x AS DOUBLE) / {dist.PRIME} < p THEN 1 ELSE 0 END))
      ELSE greatest(0, least(k, floor(k * p + (CAST(list_sum(us[1:12]) AS DOUBLE) / {dist.PRIME} - 6) * sqrt(k * p * (1 - p)) + 0.5))) END AS BIGINT) AS l
    FROM (SELECT *, list_transform(range(1, {dist.FEW + 1}), lambda i: {u}) AS us, CAST(c[mid + 1] - c[lo + 1] AS DOUBLE) / (c[hi + 1] - c[lo + 1]) AS p
      FROM (SELECT *, (lo + hi) // 2 AS mid, {toss(toss(toss("12345 + 1000003 * b") + " + CASE WHEN kind = 'real' THEN 104729 ELSE 1299709 END") + f" + (id % {dist.PRIME}) * 7919 % {dist.PRIME}")} AS state
        FROM tree JOIN cums USING (run_id, kind) WHERE hi - lo > 1 AND k > 0))), (VALUES (0), (1)) s(side))""",
        f"drawn AS (SELECT run_id, kind, b, {cols}, k AS weight FROM tree JOIN uniq USING (run_id, kind) WHERE hi - lo = 1 AND rk = hi AND k > 0 UNION ALL SELECT run_id, kind, 0, {cols}, n FROM uniq)"]


INTERVAL = (f"SELECT run_id, {R('max(loss) FILTER (b = 0)')} AS loss, {R('quantile_cont(loss, 0.005)')} AS ci_low, {R('quantile_cont(loss, 0.995)')} AS ci_high, count(loss) AS n_losses FROM losses GROUP BY run_id")
recursive = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)
query("d11_bootstrap_wasserstein", recursive(tape_sql(
    INTERVAL, IMB, "scaled AS (SELECT run_id, kind, imb.score / sd AS score FROM imb JOIN (SELECT run_id, stddev_samp(score) AS sd FROM imb GROUP BY run_id) USING (run_id))", *split_sql("scaled", "score"),
    """dh AS (SELECT run_id, b, score AS v, coalesce(sum(weight) FILTER (kind = 'real'), 0) AS r, coalesce(sum(weight) FILTER (kind = 'generated'), 0) AS g FROM drawn GROUP BY ALL),
    dc AS (SELECT run_id, b, sum(r) OVER w / sum(r) OVER p AS fr, sum(g) OVER w / sum(g) OVER p AS fg, lead(v) OVER w - v AS step FROM dh WINDOW w AS (PARTITION BY run_id, b ORDER BY v), p AS (PARTITION BY run_id, b)),
    losses AS (SELECT run_id, b, coalesce(sum(abs(fr - fg) * step), 0) AS loss FROM dc GROUP BY run_id, b)""")))(
    lambda t: dist.bootstrap(imb(t).select("run_id", "kind", "score"), RUN, dist.wasserstein_loss, replicates=REPLICATES, standardise=True))
query("x2_bootstrap_l1", recursive(tape_sql(
    INTERVAL, "typed AS (SELECT run_id, kind, CAST(event_type AS DOUBLE) AS score, event_type AS grp FROM tape)", *split_sql("typed", "score, grp"),
    """dg AS (SELECT run_id, b, grp, coalesce(sum(weight) FILTER (kind = 'real'), 0) AS r, coalesce(sum(weight) FILTER (kind = 'generated'), 0) AS g FROM drawn GROUP BY ALL),
    losses AS (SELECT run_id, b, sum(abs(r / tr - g / tg)) / 2 AS loss FROM (SELECT *, sum(r) OVER p AS tr, sum(g) OVER p AS tg FROM dg WINDOW p AS (PARTITION BY run_id, b)) GROUP BY run_id, b)""")))(
    lambda t: dist.bootstrap(t.tape.select("run_id", "kind", F.col("event_type").cast("double").alias("score"), F.col("event_type").alias("grp")),
                             RUN, dist.l1_loss, replicates=REPLICATES))
query("d12_kl_ecdf", tape_sql(
    f"SELECT run_id, {R('sum(uses * ln(sp / sq)) / sum(uses) - 1')} AS kl_ecdf FROM terms_k GROUP BY run_id", IMB,
    """h AS (SELECT run_id, score AS v, count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g FROM imb GROUP BY ALL),
    hh AS (SELECT *, sum(r) OVER p AS n, sum(g) OVER p AS m, min(v) OVER p - 1 AS x0, max(v) OVER p + 1 AS x1,
      max(CASE WHEN r > 0 THEN v END) OVER b AS plo, max(CASE WHEN g > 0 THEN v END) OVER b AS qlo,
      min(CASE WHEN g > 0 THEN v END) OVER (PARTITION BY run_id ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qhi,
      max(CASE WHEN r > 0 THEN v END) OVER p AS pmax
      FROM h WINDOW p AS (PARTITION BY run_id), b AS (PARTITION BY run_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    terms_k AS (SELECT run_id, CASE WHEN v = pmax THEN r - 1 ELSE r END AS uses,
      CASE WHEN plo IS NULL THEN 0.5 / n / (v - x0) ELSE 1.0 / n / (v - plo) END AS sp,
      CASE WHEN qlo IS NULL OR qhi IS NULL THEN 0.5 / m ELSE 1.0 / m END / (coalesce(qhi, x1) - coalesce(qlo, x0)) AS sq FROM hh WHERE r > 0)"""))(
    lambda t: dist.kl_ecdf(imb(t), RUN))
query("d13_kl_knn_1d", tape_sql(
    f"SELECT run_id, CAST(sum(r) AS BIGINT) AS n, {R('-sum(CASE WHEN r = 1 AND g = 0 AND least(v - x0, x1 - v) > 0 THEN ln(least(v - x0, x1 - v) / least(v - y0, y1 - v)) END) / sum(r) + ln(sum(g) / (sum(r) - 1))')} AS kl_knn FROM near GROUP BY run_id", IMB,
    """h AS (SELECT run_id, score AS v, count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g FROM imb GROUP BY ALL),
    near AS (SELECT *, max(CASE WHEN r > 0 THEN v END) OVER b AS x0, max(CASE WHEN g > 0 THEN v END) OVER b AS y0, min(CASE WHEN r > 0 THEN v END) OVER a AS x1, min(CASE WHEN g > 0 THEN v END) OVER a AS y1
      FROM h WINDOW b AS (PARTITION BY run_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY run_id ORDER BY v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""))(
    lambda t: dist.kl_knn_1d(imb(t), RUN))
query("d14_kl_kde", tape_sql(
    f"SELECT run_id, {R('sum(p * ln(p / q)) / sum(p) - ln(sum(p) / sum(q))')} AS kl_kde FROM dens GROUP BY run_id", IMB,
    """h AS (SELECT run_id, score AS v, count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g FROM imb GROUP BY ALL),
    e AS (SELECT run_id, min(v) - 1 AS lo, max(v) + 1 AS hi, sum(r) AS n, sum(g) AS m FROM h GROUP BY run_id),
    dens AS (SELECT run_id, k, sum(r * kern) / max(n) / (0.2 * sqrt(2 * pi())) + 1e-10 AS p, sum(g * kern) / max(m) / (0.2 * sqrt(2 * pi())) + 1e-10 AS q
      FROM (SELECT run_id, k, r, g, n, m, exp(-pow((lo + k * ((hi - lo) / 200) - v) / 0.2, 2) / 2) AS kern
            FROM h JOIN e USING (run_id), range(0, 201) t(k)) GROUP BY run_id, k)"""))(lambda t: dist.kl_kde(imb(t), RUN, 201))
