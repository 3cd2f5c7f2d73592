"""Queries C, D13, P11: clusters, captions, vectors, text filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.operators import cluster, filters, vectors, windows
from catalog import query
from catalog.adapters import FLOW_KEYS
from catalog.q_flow import K, flow_q
from catalog.q_micro import R
from catalog.q_state import FEATURES_SQL

KEY = [*FLOW_KEYS, "start"]
FEATS = windows.FEATURES
# Labels of the labelled queries come from a rule over the features, so both engines agree on them.
FEATS_SQL = [FEATURES_SQL, "fw AS MATERIALIZED (SELECT *, CAST(floor(round(pm_abs_mean, 6)) AS BIGINT) % 4 AS label FROM feats WHERE whole = 1 AND start % 2 = 0)",
             "mu AS MATERIALIZED (SELECT " + ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1.0 END AS s_{f}" for f in FEATS) + " FROM fw)",
             "pts AS MATERIALIZED (SELECT trade_date, security_id, start, label, [" + ", ".join(f"({f} - m_{f}) / s_{f}" for f in FEATS) + "] AS z FROM fw, mu)",
             "cen AS (SELECT label, count(*) AS n, [" + ", ".join(f"avg(z[{i + 1}])" for i in range(len(FEATS))) + "] AS c FROM pts GROUP BY label)",
             "own AS (SELECT pts.label, list_distance(z, c) AS d FROM pts JOIN cen USING (label))"]


def features(t):
    return t.staged("features", lambda: windows.window_features(t.flow, 50, 2)).withColumn(
        "label", (F.floor(F.round("pm_abs_mean", 6)) % 4).cast("int"))


def points(t):
    return cluster.standardise(features(t))


c_sql = lambda body: flow_q(body, *FEATS_SQL)
query("c3_standardise", c_sql(f"SELECT {K}, start, " + ", ".join(f"{R(f'z[{i + 1}]')} AS {f}" for i, f in enumerate(FEATS)) + " FROM pts"))(
    lambda t: points(t).select(*KEY, *[F.col("z")[i].alias(f) for i, f in enumerate(FEATS)]))
# k-means from a fixed start: the k windows that come first by an integer rule, three steps.
SWEEP_KS, SWEEP_STEPS = (4, 8, 12), 3
_dims = range(1, len(FEATS) + 1)
_SWEEP = [
    "seeds AS (SELECT row_number() OVER (ORDER BY start % 1009, start, trade_date, security_id) - 1 AS label, z FROM pts ORDER BY ALL LIMIT 12)".replace("ORDER BY ALL", "ORDER BY start % 1009, start, trade_date, security_id"),
    f"c0 AS MATERIALIZED (SELECT k, label, z AS c FROM seeds, (SELECT unnest({list(SWEEP_KS)}) AS k) WHERE label < k)",
    *[x for i in range(SWEEP_STEPS + 1) for x in (
        f"a{i} AS MATERIALIZED (SELECT k, trade_date, security_id, start, any_value(z) AS z, arg_min(label, (d, label)) AS label, min(d) AS d FROM (SELECT k, trade_date, security_id, start, z, label, list_distance(z, c) AS d FROM (SELECT * EXCLUDE (label) FROM pts), c{i}) GROUP BY ALL)"
        .replace("GROUP BY ALL", "GROUP BY k, trade_date, security_id, start"),
        f"m{i} AS MATERIALIZED (SELECT k, label, count(*) AS n, [{', '.join(f'avg(z[{d}])' for d in _dims)}] AS m, avg(list_dot_product(z, z)) AS q, sum(d) AS far, sum(d * d) AS cost FROM a{i} GROUP BY k, label)",
        f"c{i + 1} AS MATERIALIZED (SELECT k, label, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (k, label))")],
]
_L = SWEEP_STEPS
_SWEEP += [
    f"own4 AS (SELECT k, label, sum(d) AS sum_d, sum(d * d) AS sum_d2 FROM (SELECT k, label, list_distance(z, m) AS d FROM a{_L} JOIN m{_L} USING (k, label)) GROUP BY k, label)",
    f"sil AS (SELECT k, avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT k, trade_date, security_id, start, max(CASE WHEN own THEN n END) AS n, "
    "max(CASE WHEN own AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM (SELECT p.k, trade_date, security_id, start, p.label = c.label AS own, n, "
    f"greatest(0, list_dot_product(z, z) - 2 * list_dot_product(z, c.m) + q) AS d FROM a{_L} p JOIN m{_L} c ON p.k = c.k) GROUP BY k, trade_date, security_id, start) GROUP BY k)",
    f"tot AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS filled, sum(cost) AS inertia, [{', '.join(f'sum(n * m[{d}]) / sum(n)' for d in _dims)}] AS mid, sum(far) / sum(n) AS intra_mean, stddev_pop(far / n) AS intra_std, "
    f"CASE WHEN count(*) < k THEN 0.0 ELSE min(n) / sum(n) END AS lo, max(n) / sum(n) AS hi FROM m{_L} GROUP BY k)",
    f"eff AS (SELECT k, exp(-sum(p * ln(p + 1e-15))) AS effective FROM (SELECT k, n / sum(n) OVER (PARTITION BY k) AS p FROM m{_L}) GROUP BY k)",
    f"chs AS (SELECT k, any_value(b) * (any_value(n_samples) - any_value(filled)) / (sum(sum_d2) * (any_value(filled) - 1)) AS ch FROM own4 JOIN (SELECT m.k, sum(n * pow(list_distance(m.m, t.mid), 2)) AS b FROM m{_L} m JOIN tot t ON m.k = t.k GROUP BY m.k) USING (k) JOIN tot USING (k) GROUP BY k)",
    f"dbs AS (SELECT k, avg(r) AS db FROM (SELECT a.k, a.label, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM (SELECT k, label, m, sum_d / n AS s FROM m{_L} JOIN own4 USING (k, label)) a JOIN "
    f"(SELECT k, label, m, sum_d / n AS s FROM m{_L} JOIN own4 USING (k, label)) b ON a.k = b.k AND a.label <> b.label GROUP BY a.k, a.label) GROUP BY k)",
    f"ctr AS (SELECT k, avg(d) AS inter_mean, min(d) AS inter_min, max(d) AS inter_max FROM (SELECT a.k, list_distance(a.c, b.c) AS d FROM c{_L} a JOIN c{_L} b ON a.k = b.k AND a.label < b.label) GROUP BY k)",
    "sweep AS (SELECT k, inertia, n_samples, silhouette, ch AS calinski_harabasz, db AS davies_bouldin, lo AS min_cluster_frac, hi AS max_cluster_frac, filled AS n_nonempty_clusters, effective AS effective_clusters, "
    "intra_mean, intra_std, inter_mean, inter_min, inter_max, intra_mean / inter_mean AS intra_over_inter FROM tot JOIN sil USING (k) JOIN eff USING (k) JOIN chs USING (k) JOIN dbs USING (k) JOIN ctr USING (k))",
]
_whole = ("k", "n_samples", "n_nonempty_clusters")
query("c4_kmeans_sweep", flow_q("SELECT " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in _whole else f"{R(c)} AS {c}" for c in (
    f.split()[0] for f in cluster.SWEEP_SCHEMA.split(", "))) + " FROM sweep", *FEATS_SQL, *_SWEEP))(lambda t: _sweep(t))
query("c5_silhouette", c_sql(
    f"SELECT {R('avg(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette, count(*) AS n FROM (SELECT trade_date, security_id, start, max(CASE WHEN own THEN n END) AS n, "
    "max(CASE WHEN own THEN d * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM (SELECT trade_date, security_id, start, p.label = c.label AS own, n, "
    "list_dot_product(z, z) - 2 * list_dot_product(z, c.c) + q AS d FROM pts p, (SELECT cen.label, n, c, q FROM cen JOIN (SELECT label, avg(list_dot_product(z, z)) AS q FROM pts GROUP BY label) USING (label)) c) "
    "GROUP BY trade_date, security_id, start)"))(
    lambda t: cluster.silhouette_squared(points(t), len(FEATS)))
query("c6_ch_index", c_sql(
    f"SELECT n, k, {R('b * (n - k) / (w * (k - 1))')} AS calinski_harabasz FROM (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(list_distance(c, m), 2)) AS b FROM cen, "
    "(SELECT [" + ", ".join(f"avg(z[{i + 1}])" for i in range(len(FEATS))) + "] AS m FROM pts)), (SELECT sum(d * d) AS w FROM own)"))(
    lambda t: cluster.ch_index(points(t), len(FEATS)))
query("c6_db_index", c_sql(
    f"SELECT {R('avg(r)')} AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM sc a, sc b WHERE a.label <> b.label GROUP BY a.label)".replace(
        "FROM sc a, sc b", "FROM (SELECT * FROM cen JOIN (SELECT label, avg(d) AS s FROM own GROUP BY label) USING (label)) a, (SELECT * FROM cen JOIN (SELECT label, avg(d) AS s FROM own GROUP BY label) USING (label)) b")))(
    lambda t: cluster.db_index(points(t), len(FEATS)))
query("c7_cluster_balance", c_sql(
    f"SELECT CASE WHEN count(*) < 6 THEN 0.0 ELSE {R('min(p)')} END AS min_cluster_frac, {R('max(p)')} AS max_cluster_frac, count(*) AS n_nonempty_clusters, "
    f"{R('exp(-sum(p * ln(p + 1e-15)))')} AS effective_clusters FROM (SELECT n / sum(n) OVER () AS p FROM cen)"))(
    lambda t: cluster.cluster_balance(features(t), 6))
query("c8_centroid_metrics", c_sql(
    f"SELECT {R('intra_mean')} AS intra_mean, {R('intra_std')} AS intra_std, {R('im')} AS inter_mean, {R('imin')} AS inter_min, {R('imax')} AS inter_max, {R('intra_mean / im')} AS intra_over_inter FROM "
    "(SELECT sum(s) / sum(n) AS intra_mean, stddev_pop(s / n) AS intra_std FROM (SELECT label, sum(d) AS s, count(*) AS n FROM own GROUP BY label)), "
    "(SELECT avg(d) AS im, min(d) AS imin, max(d) AS imax FROM (SELECT list_distance(a.c, b.c) AS d FROM cen a, cen b WHERE a.label < b.label))"))(
    lambda t: cluster.centroid_metrics(points(t), len(FEATS)))


def _sweep(t):
    def build():
        z = points(t).orderBy(F.col("start") % 1009, "start", "trade_date", "security_id").limit(max(SWEEP_KS)).select("z").collect()
        starts = {k: [r["z"] for r in z[:k]] for k in SWEEP_KS}
        return cluster.kmeans_sweep(features(t).drop("label"), SWEEP_KS, key=KEY, starts=starts, steps=SWEEP_STEPS)
    return t.staged("k-sweep", build)


query("c9_recommend_k", flow_q(
    "SELECT CAST(arg_max(k, (silhouette, -k)) AS BIGINT) AS recommended_k, " + R("max(silhouette)") + " AS recommended_silhouette, CAST(max(k) FILTER (ok) AS BIGINT) AS plateau_k, array_to_string(list(k ORDER BY k), ',') AS feasible_ks "
    "FROM (SELECT *, bool_and(silhouette >= best - 0.02) OVER (ORDER BY k) AS ok FROM (SELECT *, max(silhouette) OVER () AS best FROM (SELECT *, min_cluster_frac >= 0.01 AND min_cluster_frac * n_samples >= 80 AS fit FROM sweep) "
    "QUALIFY fit OR NOT bool_or(fit) OVER ()))", *FEATS_SQL, *_SWEEP))(lambda t: cluster.recommend_k(_sweep(t)))


def _bucket_sql(f: str) -> str:
    words = cluster.BUCKETS[f]
    return "CASE " + " ".join(f"WHEN c.{f} <= q.q_{f}[{i}] THEN '{words[i - 1]}'" for i in range(1, 5)) + f" ELSE '{words[4]}' END"


_W = [_bucket_sql(f) for f in cluster.BUCKETS] + [
    "CASE " + " ".join(f"WHEN c.tod_hour < {x} THEN '{n}'" for x, n in cluster.SESSIONS) + f" ELSE '{cluster.LAST_SESSION}' END"]
_T = "[" + ", ".join(f"{{'a': -abs((c.{f} - g.m_{f}) / g.s_{f}), 'i': {i}, 'p': CASE WHEN c.{f} > g.m_{f} THEN '{hi}' ELSE '{lo}' END}}"
                     for i, (f, (hi, lo)) in enumerate(cluster.TRAITS.items())) + "]"
query("c10_captions", c_sql(
    "SELECT security_id, label, CASE WHEN m IS NULL THEN concat('(empty cluster ', label, ')') ELSE concat(b1, ' quotes, ', b2, ' tempo, ', b3, ' size, ', b4, ', ', b5, ', drift=', b6, ', session=', b7, "
    "'. Traits: ', array_to_string(list_transform(list_sort(tr)[1:3], lambda d: d.p), ', '), '. sig=spr:', b1, '|tmp:', b2, '|sz:', b3, '|cxl:', b4, '|exe:', b5, '|dr:', b6, '|sess:', b7) END AS caption FROM ("
    "SELECT s.security_id, s.label, c.pm_mean AS m, " + ", ".join(f"{x} AS b{i + 1}" for i, x in enumerate(_W)) + f", {_T} AS tr FROM "
    "(SELECT security_id, unnest(range(0, 5)) AS label FROM (SELECT DISTINCT security_id FROM fw)) s JOIN (SELECT security_id, " + ", ".join(
        f"quantile_cont({f}, [0.2, 0.4, 0.6, 0.8]) AS q_{f}" for f in cluster.BUCKETS) + " FROM fw GROUP BY security_id) q USING (security_id) JOIN (SELECT security_id, " + ", ".join(
        f"avg({f}) AS m_{f}, stddev_pop({f}) + 1e-12 AS s_{f}" for f in cluster.TRAITS) + " FROM fw GROUP BY security_id) g USING (security_id) LEFT JOIN (SELECT security_id, label, " + ", ".join(
        f"avg({f}) AS {f}" for f in FEATS) + " FROM fw GROUP BY security_id, label) c USING (security_id, label))"))(
    lambda t: cluster.captions(features(t), 5, ["security_id"]))

# Vectors
EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
COS = ("u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM {src}),\n"
       "cs AS (SELECT list_dot_product(a.u, b.u) AS x FROM u a, u b WHERE a.vec_id <> b.vec_id)")
CENT = ("mv AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY i)),\n"
        "ec AS (SELECT vec_id, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS v FROM e, mv)")
COS_OUT = ("SELECT count(*) AS count, " + R("avg(x)") + " AS mean, " + R("stddev_pop(x)") + " AS std, " + ", ".join(
    f"{R(f'quantile_cont(x, {p})')} AS {n}" for n, p in vectors.QUANTILES.items()) + f", {R('min(x)')} AS min, {R('max(x)')} AS max FROM cs")
query("c11_cosine_summary", f"WITH {EMB}, {COS.format(src='e')} {COS_OUT}")(
    lambda t: vectors.cosine_summary(t.raw("embeddings"), "vec_id"))
query("c11_cosine_summary_centred", f"WITH {EMB}, {CENT}, {COS.format(src='ec')} {COS_OUT}")(
    lambda t: vectors.cosine_summary(t.raw("embeddings"), "vec_id", centre=True))
query("c11_cosine_moments", f"WITH {EMB}, {COS.format(src='e')} SELECT count(*) AS count, {R('avg(x)')} AS mean, {R('stddev_pop(x)')} AS std FROM cs")(
    lambda t: vectors.cosine_summary(t.raw("embeddings"), "vec_id", probs={}))
query("c12_assign_unique")(lambda t: vectors.assign_unique(_centroids(t), t.raw("embeddings"), "vec_id"))


def _centroids(t):
    rows = features(t).groupBy("label").agg(*[F.avg(f).alias(f) for f in FEATS]).orderBy("label").collect()
    return [[r[f] for f in FEATS] for r in rows]


query("c13_reasonable", r"""SELECT doc_id, count(*) AS words, count(*) FILTER (length(w) > 0 AND NOT regexp_matches(w, '[\x00-\x1F]') AND length(w) <= 30 AND regexp_matches(w, '[\p{L}\p{N}]')) AS kept
  FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, ' ')), '^\s+|\s+$', '', 'g') AS w FROM documents) GROUP BY doc_id""")(
    lambda t: t.raw("documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.sum(filters.reasonable(F.col("w")).cast("long")).alias("kept")))
SCORES = "s AS (SELECT q.vec_id AS query, a.label AS anchor, list_dot_product(q.v, a.v) AS score FROM e q, (SELECT label, [{means}] AS v FROM e GROUP BY label) a)".format(
    means=", ".join(f"avg(v[{i}])" for i in range(1, 65)))
_Q = ["entropy_softmax", "neff_softmax", "gap_1_2", "gap_k_k1", "topk_mass", "row_std", "row_range", "p_top1", "p_margin_12", "p_margin_1k"]
_safe = "greatest(p, 1e-12)"
query("c14_usage_diag", f"""WITH {EMB}, {SCORES},
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, anchor) AS rk, exp((score - max(score) OVER (PARTITION BY query)) / 0.5) AS ex, count(*) OVER (PARTITION BY query) AS a FROM s),
p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query) AS p FROM r),
g AS (SELECT query, -sum(p * ln({_safe})) AS entropy_softmax, exp(-sum(p * ln({_safe}))) AS neff_softmax, max(score) FILTER (rk = 1) - max(score) FILTER (rk = 2) AS gap_1_2,
  max(score) FILTER (rk = 3) - max(score) FILTER (rk = 4) AS gap_k_k1, sum(p) FILTER (rk <= 3) AS topk_mass, stddev_pop(score) AS row_std, max(score) - min(score) AS row_range,
  max(p) FILTER (rk = 1) AS p_top1, max(p) FILTER (rk = 1) - max(p) FILTER (rk = 2) AS p_margin_12, max(p) FILTER (rk = 1) - max(p) FILTER (rk = 4) AS p_margin_1k FROM p GROUP BY query),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS x FROM g" for c in _Q)}),
sh AS (SELECT 'top1' AS name, count(*) FILTER (rk = 1) / sum(count(*) FILTER (rk = 1)) OVER () AS p, count(*) OVER () AS a FROM p GROUP BY anchor UNION ALL
  SELECT 'topk', count(*) FILTER (rk <= 3) / sum(count(*) FILTER (rk <= 3)) OVER (), count(*) OVER () FROM p GROUP BY anchor),
al AS (SELECT avg(score) AS score_mean, stddev_pop(score) AS score_std, avg(score) FILTER (rk <= 3) AS align_topk_mean, stddev_pop(score) FILTER (rk <= 3) AS align_topk_std FROM p)
SELECT name, stat, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM (
""" + " UNION ALL ".join(
    [f"SELECT name, '{n}' AS stat, {x} AS value FROM l GROUP BY name" for n, x in (("mean", "avg(x)"), ("std", "stddev_pop(x)"), ("p10", "quantile_cont(x, 0.1)"),
     ("p50", "quantile_cont(x, 0.5)"), ("p90", "quantile_cont(x, 0.9)"), ("min", "min(x)"), ("max", "max(x)"))]
    + [f"SELECT name, '{n}', {x} FROM sh GROUP BY name" for n, x in (("unique", "count(*) FILTER (p > 0)"), ("max_share", "max(p)"), ("hhi", "sum(p * p)"),
       ("entropy", f"-sum(p * ln({_safe}))"), ("neff", f"exp(-sum(p * ln({_safe})))"), ("kl_to_uniform", f"sum(p * ln({_safe} * a))"))]
    + [f"SELECT 'all', '{n}', {n} FROM al" for n in ("score_mean", "score_std", "align_topk_mean", "align_topk_std")]) + ")")(lambda t: vectors.usage_diag(_scores(t), 3, 0.5))


def _scores(t):
    """Score of every vector against the mean vector of each label: the anchors, ten labels, ride along as one array."""
    vecs = t.raw("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = vecs.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("a"))
    anchors = means.agg(F.collect_list(F.struct("label", "a")).alias("anchors"))
    dot = lambda a: F.aggregate(F.zip_with("v", a, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    scored = F.transform("anchors", lambda s: F.struct(s["label"].alias("anchor"), dot(s["a"]).alias("score")))
    return vecs.crossJoin(F.broadcast(anchors)).select(F.col("vec_id").alias("query"), F.inline(scored))


query("c15_geometry", f"WITH {EMB}, {COS.format(src='e')} SELECT * FROM (SELECT count(*) AS anchor_count, {R('avg(n)')} AS norm_mean, {R('stddev_pop(n)')} AS norm_std, {R('min(n)')} AS norm_min, {R('max(n)')} AS norm_max "
      f"FROM (SELECT sqrt(list_dot_product(v, v)) AS n FROM e)), (SELECT {R('avg(x)')} AS cos_mean, {R('stddev_pop(x)')} AS cos_std, {R('quantile_cont(x, 0.9)')} AS cos_p90, {R('quantile_cont(x, 0.99)')} AS cos_p99, {R('max(x)')} AS cos_max FROM cs)")(
    lambda t: vectors.geometry(t.raw("embeddings"), "vec_id"))
query("d13_kl_knn", f"""WITH {EMB}, x AS (SELECT * FROM e WHERE vec_id % 2 = 0), y AS (SELECT * FROM e WHERE vec_id % 2 = 1),
r AS (SELECT a.vec_id, min(list_distance(a.v, b.v)) AS r FROM x a JOIN x b ON a.vec_id <> b.vec_id GROUP BY a.vec_id),
s AS (SELECT a.vec_id, min(list_distance(a.v, b.v)) AS s FROM x a, y b GROUP BY a.vec_id)
SELECT count(*) AS n, {R('-sum(ln(r / s)) * 64 / count(*) + ln(CAST((SELECT count(*) FROM y) AS DOUBLE) / (count(*) - 1))')} AS kl_knn FROM r JOIN s USING (vec_id)""")(
    lambda t: vectors.kl_knn(t.raw("embeddings").filter("vec_id % 2 = 0"), t.raw("embeddings").filter("vec_id % 2 = 1"), "vec_id"))
query("p11_clean_lines", "SELECT line_no, regexp_replace(regexp_replace(text, '^\\s*\\d+\\.\\s*', ''), '^[\\s\"''“”]+|[\\s\"''“”]+$', '', 'g') AS text FROM "
      "(SELECT item_id AS line_no, concat(item_id, '. \"', text, '\"') AS text FROM benchmark) ORDER BY line_no LIMIT 8")(
    lambda t: filters.clean_lines(t.raw("benchmark").select(F.col("item_id").alias("line_no"), F.concat(
        F.col("item_id").cast("string"), F.lit('. "'), "text", F.lit('"')).alias("text")), 8))
