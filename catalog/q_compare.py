"""Queries E, O3, J12, A12: comparison of experiments built from the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.operators import aggregates as agg, distances as dist, micro
from bookflow.plans import compare
from catalog import query
from catalog.q_micro import K, R, tape_sql
from catalog.q_scores import l1_sql, rule_sql, w_sql

RUN = ["stock", "variant", "metric"]
RK = "stock, variant, metric"
# metric -> (expression over flat columns, same in both engines); NULL leaves a metric out of a variant.
METRICS = {
    "spread": "CAST(ask1 - bid1 AS DOUBLE)", "ask_volume_touch": "CAST(av AS DOUBLE)", "bid_volume_touch": "CAST(bv AS DOUBLE)",
    "orderbook_imbalance": "CAST(bv - av AS DOUBLE) / (bv + av)", "size": "CASE WHEN variant <> 1 THEN CAST(size AS DOUBLE) END",
    "price": "CASE WHEN variant <> 0 THEN CAST(price AS DOUBLE) END", "mid": "(ask1 + bid1) / 2.0",
}
BASE = ("base AS (SELECT CAST(run_id AS BIGINT) AS stock, event_id % 3 AS variant, kind, ask_p_1 AS ask1, bid_p_1 AS bid1, ask_v_1 AS av, bid_v_1 AS bv, size, price FROM tape)")
RUNS_SQL = [
    BASE, "sc AS (" + " UNION ALL ".join(f"SELECT stock, variant, '{m}' AS metric, kind, {x} AS score FROM base" for m, x in METRICS.items()) + ")",
    "scores AS (SELECT * FROM sc WHERE score IS NOT NULL)", w_sql("scores", RK, "w"), rule_sql("scores", RK, "fd"), l1_sql("fd", RK, "l"),
    "gv AS (SELECT stock, variant, 'ask_volume | spread' AS metric, kind, av AS score, CAST(ask1 - bid1 AS DOUBLE) AS grp FROM base)", w_sql("gv", RK + ", grp", "wg"),
    f"runs AS (SELECT * REPLACE (round(wasserstein, 9) AS wasserstein, round(l1_by_group, 9) AS l1_by_group, round(weighted_wasserstein, 9) AS weighted_wasserstein) FROM (SELECT {RK}, n_real, n_generated, wasserstein, l1_by_group, CAST(NULL AS DOUBLE) AS weighted_wasserstein FROM w JOIN l USING ({RK}) UNION ALL "
    f"SELECT {RK}, CAST(sum(n_real) AS BIGINT), CAST(sum(n_generated) AS BIGINT), NULL, NULL, CASE WHEN bool_and(wasserstein IS NOT NULL) THEN sum(wasserstein * (n_real + n_generated)) / sum(n_real + n_generated) END FROM wg GROUP BY {RK}))",
    "loss AS (SELECT stock, variant, metric, coalesce(weighted_wasserstein, wasserstein) AS w, l1_by_group AS l1 FROM runs)"]
_stats = lambda src, keys, cols=(("w", "w_"), ("l1", "l1_")): (
    f"(SELECT {keys}, " + ", ".join(f"count({c}) AS {p}n, avg({c}) AS {p}mean, max({p}m) AS {p}median, avg({c}) FILTER ({c} BETWEEN {p}q1 AND {p}q3) AS {p}iqm" for c, p in cols)
    + f" FROM {src} JOIN (SELECT {keys}, " + ", ".join(f"quantile_cont({c}, 0.25) AS {p}q1, quantile_cont({c}, 0.5) AS {p}m, quantile_cont({c}, 0.75) AS {p}q3" for c, p in cols)
    + f" FROM {src} GROUP BY {keys}) USING ({keys}) GROUP BY {keys})")
SIX_SQL = f"six AS (SELECT *, concat('S', variant) AS setting FROM {_stats('loss', 'stock, variant')})"
SIXN = ["w_n", "w_mean", "w_median", "w_iqm", "l1_n", "l1_mean", "l1_median", "l1_iqm"]
rnd = lambda cols, pre="": ", ".join(c if c.endswith("_n") else f"{R(c)} AS {c}" for c in (pre + x for x in cols))


def base(t):
    return t.tape.select(F.col("run_id").cast("long").alias("stock"), (F.col("event_id") % 3).alias("variant"), "kind", micro.touch("ask_p").alias("ask1"),
                         micro.touch("bid_p").alias("bid1"), micro.touch("ask_v").alias("av"), micro.touch("bid_v").alias("bv"), "size", "price")


def runs(t):
    def build():
        stacked = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(x).alias("score")) for m, x in METRICS.items()])
        scores = base(t).select("stock", "variant", "kind", F.inline(stacked)).filter("score IS NOT NULL")
        given = base(t).select("stock", "variant", F.lit("ask_volume | spread").alias("metric"), "kind", F.col("av").alias("score"), (F.col("ask1") - F.col("bid1")).alias("given"))
        table = dist.compare(scores, RUN).unionByName(dist.compare_given(given, RUN, "discrete").drop("num_condition_groups"), allowMissingColumns=True)
        # Equal losses of two metrics may differ in the last bit; 9 places make the quartile test of the IQM the same everywhere.
        return table.withColumns({c: F.round(c, 9) for c in ("wasserstein", "l1_by_group", "weighted_wasserstein")})
    return t.staged("runs", build)


loss = lambda t: compare.losses(runs(t), ["stock", "variant"])
six = lambda t: compare.six_pack(loss(t), ["stock", "variant"]).withColumn("setting", F.concat(F.lit("S"), F.col("variant").cast("string")))
of = lambda df, v: df.filter(F.col("variant") == v).drop("variant")
cmp_sql = lambda body, *ctes: tape_sql(body, *RUNS_SQL, SIX_SQL, *ctes)

query("e1_losses", cmp_sql(f"SELECT stock, variant, metric, {R('w')} AS w, {R('l1')} AS l1 FROM loss"))(loss)
query("e2_six_pack", cmp_sql(f"SELECT stock, variant, {rnd(SIXN)} FROM six"))(lambda t: six(t).drop("setting"))
query("e3_before_after", cmp_sql(
    "SELECT stock, " + ", ".join(f"{x if c.endswith('_n') else R(x)} AS {p}_{c}" for p, a in (("before", "a"), ("after", "b")) for c in SIXN for x in [f"{a}.{c}"]) +
    " FROM (SELECT * FROM six WHERE variant = 0) a JOIN (SELECT * FROM six WHERE variant = 1) b USING (stock)"))(
    lambda t: compare.before_after(of(six(t), 0).drop("setting"), of(six(t), 1).drop("setting")))
query("e4_six_pack_common", cmp_sql(
    f"SELECT stock, variant, {rnd(SIXN)} FROM {_stats('common', 'stock, variant')}",
    "la AS (SELECT * FROM loss WHERE variant = 0)", "lb AS (SELECT * FROM loss WHERE variant = 1)",
    "pairs AS (SELECT la.stock, la.metric, la.w AS wa, lb.w AS wb, la.l1 AS l1a, lb.l1 AS l1b FROM la JOIN lb USING (stock, metric))",
    "common AS (SELECT stock, 'a' AS variant, CASE WHEN wb IS NOT NULL THEN wa END AS w, CASE WHEN l1b IS NOT NULL THEN l1a END AS l1 FROM pairs UNION ALL "
    "SELECT stock, 'b', CASE WHEN wa IS NOT NULL THEN wb END, CASE WHEN l1a IS NOT NULL THEN l1b END FROM pairs)"))(
    lambda t: compare.six_pack_common(of(loss(t), 0), of(loss(t), 1)))
query("j12_common_metrics", cmp_sql(
    "SELECT stock, metric, loss, CASE WHEN a.h AND b.h THEN 'both' WHEN a.h THEN 'a' ELSE 'b' END AS side FROM pa a FULL JOIN pb b USING (stock, metric, loss)",
    *[f"p{n} AS (SELECT stock, metric, 'w' AS loss, TRUE AS h FROM loss WHERE variant = {v} AND w IS NOT NULL UNION ALL "
      f"SELECT stock, metric, 'l1', TRUE FROM loss WHERE variant = {v} AND l1 IS NOT NULL)" for n, v in (("a", 0), ("b", 1))]))(
    lambda t: compare.common_metrics(of(loss(t), 0), of(loss(t), 1)))
query("a12_run_counts", cmp_sql("SELECT stock, variant, max(n_real) AS n_real, max(n_generated) AS n_generated FROM runs GROUP BY ALL"))(
    lambda t: agg.run_counts(runs(t), ["stock", "variant"]))
for crit, order in (("mean", "w_mean, w_median, w_iqm"), ("median", "w_median, w_mean, w_iqm"), ("iqm", "w_iqm, w_mean, w_median")):
    query(f"e5_best_setting_{crit}", cmp_sql(
        f"SELECT stock, best_setting, {rnd(['w_mean', 'w_median', 'w_iqm', 'w_n'])}, concat('S', stock % 3) AS prior_setting, best_setting = concat('S', stock % 3) AS same_as_prior FROM "
        f"(SELECT *, setting AS best_setting FROM six QUALIFY row_number() OVER (PARTITION BY stock ORDER BY {order}, setting) = 1)"))(
        lambda t, crit=crit: compare.best_setting(six(t), crit, six(t).select("stock").distinct().withColumn(
            "prior_setting", F.concat(F.lit("S"), (F.col("stock") % 3).cast("string")))))
query("e6_rank_sum", cmp_sql(
    f"SELECT stock, setting, rank_sum, row_number() OVER (PARTITION BY stock ORDER BY rank_sum, setting) AS place, {rnd(compare.SIX)} FROM (SELECT *, " +
    " + ".join(f"rank() OVER (PARTITION BY stock ORDER BY {d})" for d in compare.SIX) + " AS rank_sum FROM six)"))(lambda t: compare.rank_sum(six(t)))
query("e7_vs_baseline", cmp_sql(
    f"SELECT stock, metric, {R('a.v')} AS w_run, {R('b.v')} AS w_base, {R('a.v - b.v')} AS delta, {R('CASE WHEN b.v > 1e-12 THEN a.v / b.v END')} AS ratio FROM v a JOIN v b USING (stock, metric) "
    "WHERE a.variant = 2 AND b.variant = 0", "v AS (SELECT stock, variant, metric, coalesce(wasserstein, weighted_wasserstein) AS v FROM runs WHERE coalesce(wasserstein, weighted_wasserstein) IS NOT NULL)"))(
    lambda t: compare.vs_baseline(of(runs(t), 2), of(runs(t), 0)))
query("e8_pivot_runs", cmp_sql(
    f"SELECT stock, {', '.join(R(f'max(CASE WHEN variant = {v} THEN w_mean END)') + f' AS variant_{v}' for v in (0, 1, 2))}, "
    f"{R('max(CASE WHEN variant = 2 THEN w_mean END) - max(CASE WHEN variant = 0 THEN w_mean END)')} AS delta FROM six GROUP BY stock"))(
    lambda t: compare.pivot_runs(six(t), [0, 1, 2], delta=(0, 2)))
spread_tape = lambda t: t.tape.select(F.col("run_id").cast("long").alias("stock"), F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("setting"), "kind", "levels")
query("e9_spread_sweep", tape_sql(
    f"SELECT stock, setting, n, {R('mean')} AS mean, {R('std')} AS std, {R('median')} AS median, {R('p95')} AS p95, {R('ref_mean')} AS ref_mean, {R('mean - ref_mean')} AS mean_gap, "
    "row_number() OVER (PARTITION BY stock ORDER BY abs(mean - ref_mean), mean, setting) AS place FROM "
    "(SELECT stock, concat('S', variant) AS setting, count(*) AS n, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS std, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.95) AS p95 "
    "FROM (SELECT *, (ask1 - bid1) / 100.0 AS s FROM base WHERE kind = 'generated') GROUP BY ALL) JOIN (SELECT stock, avg((ask1 - bid1) / 100.0) AS ref_mean FROM base WHERE kind = 'real' GROUP BY stock) USING (stock)",
    BASE))(lambda t: compare.spread_sweep(spread_tape(t).filter("kind = 'generated'"), spread_tape(t).filter("kind = 'real'")))
query("e9_spread_histograms", tape_sql(
    f"SELECT stock, s AS spread_ticks, g AS count_gen, {R('pg')} AS pct_gen, r AS count_ref, {R('pr')} AS pct_ref, {R('pg - pr')} AS delta_pct FROM (SELECT *, 100.0 * g / sum(g) OVER (PARTITION BY stock) AS pg, "
    "100.0 * r / sum(r) OVER (PARTITION BY stock) AS pr FROM (SELECT stock, (ask1 - bid1) / 100.0 AS s, count(*) FILTER (kind = 'generated') AS g, count(*) FILTER (kind = 'real') AS r FROM base GROUP BY ALL)) "
    "WHERE pg >= 1 OR pr >= 1", BASE))(
    lambda t: compare.spread_histograms(spread_tape(t).filter("kind = 'generated'"), spread_tape(t).filter("kind = 'real'"), least_pct=1.0))
query("e10_sweep_row", cmp_sql(
    "SELECT stock, variant, " + ", ".join(f"round(CAST(max(CASE WHEN metric = '{m}' THEN {c} END) AS DOUBLE), 6) + 0.0 AS {n}" for n, (m, c) in compare.SWEEP_FIELDS.items()) + " FROM runs GROUP BY ALL"))(
    lambda t: compare.sweep_row(runs(t), ["stock", "variant"]))
query("o3_latest_run", "SELECT o_custkey, max_by(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) AS path FROM orders GROUP BY o_custkey")(
    lambda t: compare.latest_run(t.raw("orders").select("o_custkey", F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("path")), ["o_custkey"]).drop("modified"))
