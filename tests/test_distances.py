import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import distances as dist


def scores(spark, real, gen, key="r"):
    return spark.createDataFrame([(key, "real", float(x)) for x in real] + [(key, "generated", float(x)) for x in gen], "run string, kind string, score double")


def w1(a, b):
    """Area between the two empirical distribution functions."""
    every = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), every[:-1], side="right") / len(s) for s in (a, b))
    return float(np.sum(np.abs(fa - fb) * np.diff(every)))


@pytest.mark.parametrize("ddof", [0, 1])
def test_wasserstein(spark, ddof):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(0.3, 2, size=151).round(1)
    got = dist.wasserstein(scores(spark, a, b), ["run"], ddof=ddof).first()
    assert got["wasserstein"] == pytest.approx(w1(a, b) / np.std(np.concatenate([a, b]), ddof=ddof), rel=1e-10)
    assert (got["n_real"], got["n_generated"]) == (200, 151)


def test_one_kind_and_zero_spread(spark):
    assert dist.wasserstein(scores(spark, [1, 2], []), ["run"]).first()["wasserstein"] is None
    assert dist.wasserstein(scores(spark, [1, 1], [1]), ["run"]).first()["wasserstein"] is None
    assert dist.wasserstein(scores(spark, [1, 1], [1]), ["run"], ddof=0).first()["wasserstein"] == 0
    only = scores(spark, [1, 2], []).withColumn("grp", F.col("score"))
    assert dist.l1_by_group(only, ["run"]).first()["l1_by_group"] == 1.0


def test_identity_and_range(spark):
    same = scores(spark, [1, 2, 3, 3], [1, 2, 3, 3])
    row = dist.compare(same, ["run"]).first()
    assert row["wasserstein"] == 0 and row["l1_by_group"] == 0
    assert dist.compare(scores(spark, [1, 2], [8, 9]), ["run"], discrete=True).first()["l1_by_group"] == 1.0


@pytest.mark.parametrize("rule", ["fd", "sturges", "sqrt", "rice", "scott", "doane", "auto"])
def test_rules_match_numpy(spark, rule):
    rng = np.random.default_rng(5)
    for values in (rng.exponential(size=300), rng.integers(0, 9, size=120).astype(float), np.array([4.0, 4.0, 4.0, 9.0])):
        df = scores(spark, values, [])
        got = {(r["score"], r["grp"]) for r in dist.group_scores(df, ["run"], "rule", rule=rule).collect()}
        edges = np.histogram_bin_edges(values, bins=rule)
        assert got == {(float(v), int(g)) for v, g in zip(values, np.searchsorted(edges, values, side="right"))}


def test_compare_agrees_with_its_parts(spark):
    rng = np.random.default_rng(2)
    df = scores(spark, rng.gamma(2, size=400), rng.gamma(3, size=350))
    both = dist.compare(df, ["run"]).first()
    grouped = dist.group_scores(df, ["run"], "rule")
    assert both["wasserstein"] == pytest.approx(dist.wasserstein(df, ["run"]).first()["wasserstein"], rel=1e-12)
    assert both["l1_by_group"] == pytest.approx(dist.l1_by_group(grouped, ["run"]).first()["l1_by_group"], rel=1e-12)


def test_conditional_is_null_when_a_group_is(spark):
    df = spark.createDataFrame([("r", k, float(i % 5), float(g)) for g in (0, 1) for k in ("real", "generated") for i in range(10) if not (g == 1 and k == "real")],
                               "run string, kind string, score double, given double")
    row = dist.compare_given(df, ["run"], "discrete").first()
    assert row["weighted_wasserstein"] is None and row["num_condition_groups"] == 2


def test_quantile_edges_keep_two_copies(spark):
    df = scores(spark, [1.0] * 70 + [2.0] * 20 + [3.0] * 10, [])
    edges = dist.quantile_edges(df, ["run"], [i / 10 for i in range(1, 10)]).first()["edges"]
    assert edges == pytest.approx([1.0, 1.01, 1.3, 2.0, 2.1])


def test_bootstrap(spark):
    rng = np.random.default_rng(7)
    df = scores(spark, rng.normal(size=150), rng.normal(0.5, 1, size=150))
    row = dist.bootstrap(df, ["run"], dist.wasserstein_loss, replicates=60, alpha=0.1, standardise=True).first()
    again = dist.bootstrap(df.repartition(7), ["run"], dist.wasserstein_loss, replicates=60, alpha=0.1, standardise=True).first()
    assert row["n_losses"] == 61
    assert row["loss"] == pytest.approx(dist.wasserstein(df, ["run"]).first()["wasserstein"], rel=1e-9)
    assert row["ci_low"] < row["loss"] < row["ci_high"] + 0.2 and 0 < row["ci_low"] < row["ci_high"]
    assert row["ci_low"] == pytest.approx(again["ci_low"], rel=1e-9)


def test_kl_ecdf_matches_slopes(spark):
    rng = np.random.default_rng(11)
    p, q = np.sort(rng.normal(size=60)), np.sort(rng.normal(0.2, 1.3, size=80))
    x0, x1 = min(p[0], q[0]) - 1, max(p[-1], q[-1]) + 1

    def curve(v):
        return np.r_[x0, v, x1], np.r_[0, (np.arange(1, len(v) + 1) - 0.5) / len(v), 1]

    def slope(v, at):
        xs, ys = curve(v)
        i = np.searchsorted(xs, at)
        return (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])

    want = np.mean([np.log(slope(p, x) / slope(q, x)) for x in p[:-1]]) - 1
    assert dist.kl_ecdf(scores(spark, p, q), ["run"]).first()["kl_ecdf"] == pytest.approx(want, rel=1e-9)


def test_stone_rule_matches_numpy(spark, small_chunks):
    rng = np.random.default_rng(11)
    samples = {"a": rng.normal(size=400), "b": np.r_[rng.normal(size=150), rng.normal(9, 0.2, 150)], "c": rng.integers(0, 6, 300).astype(float), "d": np.full(5, 2.0), "e": rng.exponential(size=12_000).round(3)}
    df = spark.createDataFrame([(k, "real", float(v)) for k, x in samples.items() for v in x], "k string, kind string, score double")
    got = dist.group_scores(df, ["k"], "rule", rule="stone").groupBy("k", "score", "grp").count().collect()
    for k, x in samples.items():
        edges = np.histogram_bin_edges(x, bins="stone")
        assert {(r["score"], r["grp"]) for r in got if r["k"] == k} == {(float(v), int(np.searchsorted(edges, v, side="right"))) for v in x}


def nearest_1d(x, y):
    r = np.array([np.abs(np.delete(x, i) - v).min() for i, v in enumerate(x)])
    s = np.array([np.abs(y - v).min() for v in x])
    ok = (r > 0) & (s > 0)
    return -np.log(r[ok] / s[ok]).sum() / len(x) + np.log(len(y) / (len(x) - 1))


def test_nearest_neighbour_kl_in_one_dimension(spark, small_chunks):
    rng = np.random.default_rng(12)
    pairs = {"a": (rng.normal(size=300), rng.normal(1, 2, 250)), "b": (rng.integers(0, 50, 200) / 7, rng.integers(0, 50, 90) / 7), "c": (np.array([1.0, 5.0]), np.array([2.0]))}
    rows = [(k, kind, float(v)) for k, p in pairs.items() for kind, x in zip(("real", "generated"), p) for v in x]
    rows += [("a", "real", None), ("a", "generated", float("nan")), ("a", "conditional", 0.1), ("lonely", "real", 1.0), ("lonely", "generated", 2.0), ("empty", "real", 1.0), ("empty", "real", 2.0)]
    out = {r["k"]: (r["n"], r["kl_knn"]) for r in dist.kl_knn_1d(spark.createDataFrame(rows, "k string, kind string, score double"), ["k"]).collect()}
    for k, (x, y) in pairs.items():
        assert out[k] == (len(x), pytest.approx(nearest_1d(x, y), rel=1e-9))
    assert out["lonely"] == (1, None) and out["empty"] == (2, None)


def test_nearest_neighbour_kl_of_a_million(spark):
    """Two even grids: real points lie 2 apart and 0.5 from a generated one, whatever their number."""
    n = 500_000
    df = spark.range(2 * n).select(F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, "real").otherwise("generated").alias("kind"), (F.col("id") - F.col("id") % 2 * 0.5).alias("score"))
    row = dist.kl_knn_1d(df, ["k"]).first()
    assert row["n"] == n and row["kl_knn"] == pytest.approx(-np.log(2 / 0.5) + np.log(n / (n - 1)), rel=1e-6)


def test_conditional_sequences_are_scored_only(spark):
    rows = [("r", kind, float(v)) for kind, xs in (("real", [1, 2, 3]), ("generated", [2, 3, 9]), ("conditional", [100, 200])) for v in xs]
    df = spark.createDataFrame(rows, "run_id string, kind string, score double")
    two = df.filter("kind <> 'conditional'")
    for fn in (lambda d: dist.wasserstein(d, ["run_id"]), lambda d: dist.compare(d, ["run_id"]), lambda d: dist.l1_by_group(d.withColumn("grp", F.col("score")), ["run_id"]),
               lambda d: dist.quantile_edges(d, ["run_id"], [0.5, 0.9])):
        assert fn(df).collect() == fn(two).collect()
    grouped = dist.group_scores(df, ["run_id"], "bins", bins=4)
    assert grouped.filter("kind = 'conditional' AND grp = 3").count() == 2


def test_draws_do_not_depend_on_the_parts(spark):
    """Subtrees split in tasks of their own give the draws of one tree; every replicate draws as many rows as there are."""
    rng = np.random.default_rng(21)
    counts = rng.integers(1, 9, 301)
    k, seed = np.full(40, counts.sum()), dist.toss(np.arange(40) * 977 + 5)
    whole = dist.split_draws(counts, k, seed)
    assert (whole.sum(1) == counts.sum()).all() and (whole >= 0).all()
    share = whole.mean(0) / counts
    assert abs(share.mean() - 1) < 0.05 and 0.6 < (whole - counts).var() / counts.mean() < 1.5  # about Poisson
    rows = [("r", kind, float(i)) for kind in ("real", "generated") for i, c in enumerate(rng.integers(1, 5, 90)) for _ in range(c)]
    df = spark.createDataFrame(rows, "run string, kind string, score double")
    results = {n: dist.bootstrap(df.repartition(p), ["run"], dist.wasserstein_loss, replicates=30, alpha=0.1, leaves=n).collect() for n, p in ((4096, 1), (16, 5), (3, 3))}
    assert results[4096] == results[16] == results[3]


@pytest.mark.parametrize("k", [1, 7, 32, 33, 500])
def test_left_share_is_binomial(k):
    state = dist.toss(np.arange(20_000) * 31 + 7)
    for p in (0.5, 0.1, 0.93):
        x = dist.left_share(np.full(20_000, k), np.full(20_000, p * 1000), np.full(20_000, 1000.0), state)
        assert x.min() >= 0 and x.max() <= k
        assert abs(x.mean() - k * p) < 0.05 * max(1, np.sqrt(k * p * (1 - p))) + 0.02 and abs(x.var() / (k * p * (1 - p)) - 1) < 0.08
