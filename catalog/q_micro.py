"""Queries M, A, W over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.operators import aggregates as agg, micro
from catalog import query
from catalog.adapters import TAPE_KEYS, TAPE_SQL

K = "run_id, kind"
OWN = "PARTITION BY run_id, kind ORDER BY row_seq"
MID = "(ask_p_1 + bid_p_1) / 2.0"
R = lambda x: f"round({x}, 6) + 0.0"


def tape_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TAPE_SQL, *ctes]) + "\n" + body


def describe_sql(source: str, col: str, keys: str = K) -> str:
    return (f"SELECT {keys}, count({col}) AS n, {R(f'avg({col})')} AS mean, {R(f'stddev_samp({col})')} AS std, "
            f"{R(f'quantile_cont({col}, 0.5)')} AS median, {R(f'quantile_cont({col}, 0.95)')} AS p95 "
            f"FROM {source} GROUP BY {keys}")


query("m1_mid_price", tape_sql(f"SELECT {K}, row_seq, {MID} AS mid FROM tape"))(lambda t: micro.mid_price(t.tape))
query("m2_spread", tape_sql(f"SELECT {K}, row_seq, ask_p_1 - bid_p_1 AS spread FROM tape"))(
    lambda t: micro.spread(t.tape))
query("m2_spread_summary", tape_sql(
    f"SELECT {K}, count(s) AS n, {R('avg(s)')} AS mean, {R('stddev_samp(s)')} AS std, "
    f"{R('avg(CAST(raw <= 0 AS INT))')} AS share_not_positive, {R('quantile_cont(s, 0.5)')} AS median "
    f"FROM (SELECT {K}, ask_p_1 - bid_p_1 AS raw, CASE WHEN ask_p_1 > bid_p_1 THEN (ask_p_1 - bid_p_1) / 100.0 END AS s FROM tape) "
    f"GROUP BY {K}"))(lambda t: micro.spread_summary(t.tape))

WEIGHT = (f"CAST(t_ns - lag(t_ns) OVER ({OWN}) AS DOUBLE) / (max(t_ns) OVER (PARTITION BY {K}) - min(t_ns) OVER (PARTITION BY {K}))")
query("m3_l1_volume", tape_sql(
    f"SELECT {K}, row_seq, ask_v_1 AS ask_vol, bid_v_1 AS bid_vol, {R(WEIGHT)} AS time_weight FROM tape"))(
    lambda t: micro.l1_volume(t.tape))
query("m4_total_volume", tape_sql(
    f"SELECT {K}, row_seq, {' + '.join(f'ask_v_{i}' for i in range(1, 6))} AS ask_vol, "
    f"{' + '.join(f'bid_v_{i}' for i in range(1, 6))} AS bid_vol, {R(WEIGHT)} AS time_weight FROM tape"))(
    lambda t: micro.total_volume(t.tape, 5))
query("w7_time_weight", tape_sql(f"SELECT {K}, row_seq, {R(WEIGHT)} AS time_weight FROM tape"))(
    lambda t: micro.time_weight(t.tape))
query("m5_book_imbalance", tape_sql(
    f"SELECT {K}, row_seq, {R('CAST(bid_v_1 - ask_v_1 AS DOUBLE) / (bid_v_1 + ask_v_1)')} AS imbalance FROM tape"))(
    lambda t: micro.book_imbalance(t.tape))

OFI_SQL = f"""terms AS (
  SELECT {K}, row_seq, {MID} AS mid,
    CASE WHEN bid_p_1 >= lag(bid_p_1) OVER w THEN bid_v_1 ELSE 0 END
    - CASE WHEN bid_p_1 <= lag(bid_p_1) OVER w THEN lag(bid_v_1) OVER w ELSE 0 END
    - CASE WHEN ask_p_1 <= lag(ask_p_1) OVER w THEN ask_v_1 ELSE 0 END
    + CASE WHEN ask_p_1 >= lag(ask_p_1) OVER w THEN lag(ask_v_1) OVER w ELSE 0 END AS term,
    lead({MID}) OVER w - {MID} AS next_move
  FROM tape WINDOW w AS ({OWN})),
ofi AS (
  SELECT {K}, row_seq, next_move, avg(CASE WHEN row_seq > 0 THEN term END) OVER ({OWN} ROWS 99 PRECEDING) AS ofi FROM terms)"""
query("m6_ofi", tape_sql(f"SELECT {K}, row_seq, {R('ofi')} AS ofi FROM ofi WHERE row_seq >= 100", OFI_SQL))(
    lambda t: micro.ofi(t.tape))
query("m7_ofi_cond_tick", tape_sql(
    f"SELECT {K}, row_seq, {R('ofi')} AS ofi, CAST(sign(next_move) AS BIGINT) AS tick FROM ofi "
    "WHERE row_seq >= 100 AND next_move IS NOT NULL", OFI_SQL))(lambda t: micro.ofi_cond_tick(t.tape))


def depth_sql(types: str) -> str:
    return tape_sql(
        f"SELECT {K}, row_seq, CASE WHEN price > {MID} THEN 'ask' ELSE 'bid' END AS side, abs(price - {MID}) AS depth "
        f"FROM tape WHERE event_type IN {types} AND price <> {MID}")


query("m8_limit_depth", depth_sql("(1)"))(lambda t: micro.limit_depth(t.tape))
query("m9_cancel_depth", depth_sql("(2, 3)"))(lambda t: micro.cancel_depth(t.tape))


def lifecycle_sql(types: str) -> str:
    return tape_sql(
        f"SELECT {K}, order_id, max(t_ns) FILTER (rk = 2) - max(t_ns) FILTER (rk = 1) AS delta_ns FROM ranked "
        f"WHERE rk <= 2 GROUP BY {K}, order_id HAVING count(*) = 2",
        f"known AS (SELECT DISTINCT {K}, order_id FROM tape WHERE event_type = 1)",
        f"ranked AS (SELECT {K}, order_id, t_ns, row_number() OVER (PARTITION BY {K}, order_id ORDER BY row_seq) AS rk "
        f"FROM tape SEMI JOIN known USING ({K}, order_id) WHERE event_type IN {types})")


query("m10_time_to_first_fill", lifecycle_sql("(1, 4)"))(lambda t: micro.time_to_first_fill(t.tape))
query("m11_time_to_cancel", lifecycle_sql("(1, 2, 3)"))(lambda t: micro.time_to_cancel(t.tape))
query("w8_first_two", lifecycle_sql("(1, 2, 3, 4)"))(lambda t: micro.first_two(t.tape, (1, 2, 3, 4)))
query("j8_known_orders", tape_sql(
    f"SELECT {K}, row_seq, order_id, event_type FROM tape SEMI JOIN "
    f"(SELECT DISTINCT {K}, order_id FROM tape WHERE event_type = 1) USING ({K}, order_id)"))(
    lambda t: micro.known_orders(t.tape).select(*TAPE_KEYS, "row_seq", "order_id", "event_type"))


def level_sql(source: str, types: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {K}, row_seq, '{side}' AS side, {i} AS level FROM {source} WHERE event_type IN {types} AND price = {side}_p_{i}"
        for side in ("ask", "bid") for i in range(1, 11))


PREV_SQL = ("before AS (SELECT run_id, kind, row_seq, event_type, price, " + ", ".join(
    f"lag({s}_p_{i}) OVER w AS {s}_p_{i}" for s in ("ask", "bid") for i in range(1, 11)) + f" FROM tape WINDOW w AS ({OWN}))")
query("m12_limit_level", tape_sql(level_sql("tape", "(1)")))(lambda t: micro.limit_level(t.tape))
query("m13_cancel_level", tape_sql(level_sql("before", "(2, 3)"), PREV_SQL))(lambda t: micro.cancel_level(t.tape))
query("w14_prev_book", tape_sql(f"SELECT {K}, row_seq, ask_p_1 AS ask, bid_p_10 AS bid FROM before", PREV_SQL))(
    lambda t: micro.prev_book(t.tape).select(
        *TAPE_KEYS, "row_seq", F.col("prev_levels")[0]["ask_p"].alias("ask"), F.col("prev_levels")[9]["bid_p"].alias("bid")))

VPM_SQL = f"""secs AS (
  SELECT {K}, t_ns // 1000000000 AS second, CAST(sum(size) AS DOUBLE) AS v,
    arg_min(t_ns, row_seq) AS t0, arg_max(t_ns, row_seq) AS t1 FROM tape WHERE event_type = 4 GROUP BY ALL),
flagged AS (
  SELECT *, (t0 // 1000) % 1000000 AS u0, (t1 // 1000) % 1000000 AS u1,
    second = min(second) OVER k AS f, second = max(second) OVER k AS l FROM secs WINDOW k AS (PARTITION BY {K})),
vpm AS (
  SELECT {K}, second, 60 * CASE
    WHEN f AND l AND t0 = t1 THEN v WHEN f AND l AND u1 - u0 >= 100000 THEN v * (1e6 / (u1 - u0)) WHEN f AND l THEN NULL
    WHEN f AND u0 >= 900000 THEN v / (1 - u0 / 1e6) WHEN f THEN NULL
    WHEN l AND u1 >= 100000 THEN v * (1e6 / u1) WHEN l THEN NULL ELSE v END AS volume_per_minute FROM flagged)"""
query("m14_volume_per_minute", tape_sql(
    f"SELECT {K}, second, {R('volume_per_minute')} AS volume_per_minute FROM vpm WHERE volume_per_minute IS NOT NULL",
    VPM_SQL))(lambda t: micro.volume_per_minute(t.tape))
query("m15_time_of_day", tape_sql(
    f"SELECT {K}, row_seq, {R('(t_ns - d0) / 1e9')} AS seconds FROM tape JOIN (SELECT {K}, "
    f"arg_min(t_ns, row_seq) - arg_min(t_ns, row_seq) % 86400000000000 AS d0 FROM tape GROUP BY {K}) USING ({K})"))(
    lambda t: micro.time_of_day(t.tape))
query("m15_start_time", tape_sql(
    f"SELECT {K}, arg_min(t_ns, row_seq) AS start_ns, {R('(arg_min(t_ns, row_seq) % 86400000000000) / 1e9')} AS start_seconds "
    f"FROM tape GROUP BY {K}"))(lambda t: micro.start_time(t.tape))
query("m16_arrival_summary", tape_sql(
    f"SELECT s.*, n_exec_excluded FROM ({describe_sql('gaps', 'gap')}) s JOIN (SELECT {K}, "
    f"CAST(count(*) FILTER (event_type IN (4, 5)) AS BIGINT) AS n_exec_excluded FROM tape GROUP BY {K}) USING ({K})",
    f"gaps AS (SELECT {K}, CASE WHEN g >= 0 THEN g END AS gap FROM (SELECT {K}, (t_ns - lag(t_ns) OVER ({OWN})) / 1e6 AS g "
    "FROM tape WHERE event_type NOT IN (4, 5)))"))(lambda t: micro.arrival_summary(t.tape))
query("m17_book_change_3d", tape_sql(
    f"SELECT {K}, row_seq, {MID} - lag({MID}) OVER ({OWN}) AS mid_change, price - {MID} AS price, "
    "CASE WHEN event_type = 1 THEN size ELSE -size END AS size FROM tape"))(lambda t: micro.book_change_3d(t.tape))

QCUT_SQL = f"""changes AS (
  SELECT {K}, row_seq, {MID} - lag({MID}) OVER ({OWN}) AS mid_change, price - {MID} AS price,
    CASE WHEN event_type = 1 THEN size ELSE -size END AS size FROM tape),
edges AS (SELECT {K}, """ + ", ".join(
    f"list_sort(list_distinct(quantile_cont({d}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS {d}_e"
    for d in ("mid_change", "price", "size")) + f" FROM changes GROUP BY {K})"
query("m18_qcut_3d", tape_sql(
    f"SELECT {K}, row_seq, " + ", ".join(
        f"CASE WHEN {d} IS NOT NULL THEN greatest(len(list_filter({d}_e, lambda e: e < {d})), 1) - 1 END AS {d}_group"
        for d in ("mid_change", "price", "size")) + f" FROM changes JOIN edges USING ({K})", QCUT_SQL))(
    lambda t: micro.qcut_3d(micro.book_change_3d(t.tape), 5).select(
        *TAPE_KEYS, "row_seq", "mid_change_group", "price_group", "size_group"))

PAIRS = "[" + ", ".join(f"{{'p': {s}_p_{i}, 'v': {s}_v_{i}}}" for i in range(1, 11) for s in ("ask", "bid")) + "]"
query("m19_book_delta", tape_sql(
    f"""SELECT {K}, row_seq, mid - mid0 AS delta_mid, list_position(list_transform(cur, lambda x: x.p), nw.p) - 1 AS level_index,
      CASE WHEN nw.p = od.p THEN nw.v - od.v ELSE nw.v END AS quantity
    FROM (SELECT *, list_filter(cur, lambda x: NOT list_contains(prv, x))[1] AS nw,
            list_filter(prv, lambda x: NOT list_contains(cur, x))[1] AS od FROM
          (SELECT {K}, row_seq, {MID} AS mid, lag({MID}) OVER w AS mid0, {PAIRS} AS cur, lag({PAIRS}) OVER w AS prv
           FROM tape WINDOW w AS ({OWN})) WHERE prv IS NOT NULL)
    WHERE nw IS NOT NULL AND od IS NOT NULL"""))(lambda t: micro.book_delta(t.tape))

query("a1_value_mix", tape_sql(
    f"SELECT {K}, event_type AS value, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY {K}), 4) AS fraction "
    f"FROM tape GROUP BY {K}, event_type"))(lambda t: agg.value_mix(t.tape, "event_type", TAPE_KEYS))
query("a2_describe", tape_sql(describe_sql("(SELECT *, ask_v_1 AS x FROM tape)", "x")))(
    lambda t: agg.describe(t.tape.select(*TAPE_KEYS, micro.touch("ask_v").alias("x")), "x", TAPE_KEYS))
query("a3_moments", tape_sql(
    f"SELECT {K}, count(x) AS n, {R('avg(x)')} AS mean, {R('stddev_samp(x)')} AS std, {R('skewness(x)')} AS skew, "
    f"{R('kurtosis(x)')} AS kurtosis FROM (SELECT *, size / 100.0 AS x FROM tape) GROUP BY {K}"))(
    lambda t: agg.moments(t.tape.select(*TAPE_KEYS, (F.col("size") / 100).alias("x")), "x", TAPE_KEYS))
HOUR6 = 6 * 3600 * micro.NS
query("a4_mean_per_interval", tape_sql(
    f"SELECT {K}, (bar + 1) * 1800000000000 AS label_ns, {R('mean')} AS mean FROM (SELECT {K}, unnest(range(lo, hi + 1)) AS bar FROM "
    f"(SELECT {K}, min(t_ns) // 1800000000000 AS lo, max(t_ns) // 1800000000000 AS hi FROM tape GROUP BY {K})) LEFT JOIN "
    f"(SELECT {K}, t_ns // 1800000000000 AS bar, avg({MID}) AS mean FROM tape GROUP BY ALL) USING ({K}, bar)"))(
    lambda t: micro.mean_per_interval(t.tape.select(*TAPE_KEYS, "t_ns", micro.mid().alias("mid")), "mid", 1800 * micro.NS))
query("a15_mid_summary", tape_sql(
    f"SELECT {K}, arg_min(m, row_seq) AS start_mid, arg_max(m, row_seq) AS end_mid, {R('avg(m)')} AS mean_mid, "
    f"{R('stddev_samp(m)')} AS std_mid, {R('(arg_max(m, row_seq) / arg_min(m, row_seq) - 1) * 10000')} AS return_bps "
    f"FROM (SELECT *, {MID} AS m FROM tape) GROUP BY {K}"))(lambda t: micro.mid_summary(t.tape))
query("w2_inter_arrival", tape_sql(
    f"SELECT {K}, row_seq, {R('g / 1e6')} AS gap_ms FROM (SELECT {K}, row_seq, t_ns - lag(t_ns) OVER ({OWN}) AS g FROM tape) "
    "WHERE g IS NOT NULL"))(lambda t: micro.inter_arrival(t.tape))
query("w3_rolling_mean", tape_sql(
    f"SELECT {K}, row_seq, {R('r')} AS rolling FROM (SELECT {K}, row_seq, avg(size) OVER ({OWN} ROWS 19 PRECEDING) AS r FROM tape) "
    "WHERE row_seq >= 19"))(lambda t: micro.rolling_mean(
        t.tape.select(*TAPE_KEYS, "row_seq", "size"), "size", 20).drop("size"))


def returns_sql(every: int) -> str:
    return (f"bars AS (SELECT {K}, t_ns // {every} AS bar, arg_max({MID}, row_seq) AS last FROM tape GROUP BY ALL),\n"
            f"rets AS (SELECT {K}, (bar + 1) * {every} AS label_ns, CASE WHEN bar - lag(bar) OVER w = 1 THEN ln(last) - ln(lag(last) OVER w) END AS ret "
            f"FROM bars WINDOW w AS (PARTITION BY {K} ORDER BY bar))")


HALF_HOUR = 1800 * micro.NS
query("w4_mid_returns", tape_sql(f"SELECT {K}, label_ns, {R('ret')} AS ret FROM rets", returns_sql(HALF_HOUR)))(
    lambda t: micro.mid_returns(t.tape, HALF_HOUR))
query("w5_volatility", tape_sql(
    f"SELECT {K}, {R('coalesce(stddev_samp(ret), 0)')} AS volatility FROM rets GROUP BY {K}", returns_sql(HALF_HOUR)))(
    lambda t: micro.volatility(t.tape, HALF_HOUR))
ACF_SQL = (f"x AS (SELECT {K}, row_seq, size - avg(size) OVER (PARTITION BY {K}) AS x FROM tape),\n"
           f"c AS (SELECT {K}, lag_k, sum(a.x * b.x) AS c FROM x a, range(0, 6) t(lag_k), x b WHERE a.run_id = b.run_id "
           "AND a.kind = b.kind AND b.row_seq = a.row_seq + lag_k GROUP BY ALL)").replace(
               f"SELECT {K}, lag_k", "SELECT a.run_id, a.kind, lag_k")
query("w6_acf", tape_sql(
    f"SELECT {K}, lag_k AS lag, {R('c / first_value(c) OVER (PARTITION BY run_id, kind ORDER BY lag_k)')} AS acf FROM c", ACF_SQL))(
    lambda t: micro.acf(t.tape.select(*TAPE_KEYS, "row_seq", "size"), "size", 5))
