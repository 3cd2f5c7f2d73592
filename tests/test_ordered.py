import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookflow.operators import ordered


def frame(spark, n, seed, keys=3, parts=5):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"[:keys]) if rng.random() > 0.4 else "a", i, rng.randint(-5, 5), rng.choice([None, 1.5, 2.5])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, o long, x long, y double").repartition(parts), pd.DataFrame(rows, columns=["k", "o", "x", "y"])


@pytest.mark.parametrize("chunk", [1, 7, 1000, None])
def test_running_matches_pandas(spark, chunk):
    df, pdf = frame(spark, 300, chunk or 5)
    out = ordered.running(
        df, ["k"], ["o"], F.expr(f"o div {chunk}") if chunk else None, sums={"s": F.col("x")}, mins={"m": F.col("x")}, lasts={"l": F.col("y")}, prevs={"p": F.col("x")},
        nexts={"n": F.col("x")}, totals={"t": F.col("x")}, befores={"b": F.col("y")}, froms={"f": F.col("y")}, afters={"a": F.col("y")}).toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    pdf = pdf.sort_values(["k", "o"]).reset_index(drop=True)
    g = pdf.groupby("k")
    want = pd.DataFrame({"s": g.x.cumsum(), "m": g.x.cummin(), "l": g.y.ffill(), "p": g.x.shift(1), "n": g.x.shift(-1), "t": g.x.transform("sum"),
                         "b": g.y.apply(lambda v: v.ffill().shift(1)).reset_index(level=0, drop=True), "f": g.y.bfill(),
                         "a": g.y.apply(lambda v: v.bfill().shift(-1)).reset_index(level=0, drop=True)})
    for c in want:
        np.testing.assert_array_equal(out[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), err_msg=c)


@pytest.mark.parametrize("chunk", [3, 10, 500])
def test_neighbours_match_plain_window(spark, chunk):
    df, pdf = frame(spark, 400, 9)
    dense = ordered.dense_index(df, ["k"], ["o"], F.expr("o div 16"))
    out = ordered.over_neighbours(dense, ["k"], lambda w: {"a": F.lag("x", 3).over(w), "z": F.lead("x", 2).over(w)}, before=3, after=2, chunk=chunk)
    got = out.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    pdf = pdf.sort_values(["k", "o"]).reset_index(drop=True)
    g = pdf.groupby("k")
    assert (got.row_seq == g.cumcount()).all()
    np.testing.assert_array_equal(got.a.astype(float), g.x.shift(3))
    np.testing.assert_array_equal(got.z.astype(float), g.x.shift(-2))


@pytest.mark.parametrize("tolerance", [None, 5000])
def test_asof_edges(spark, tolerance):
    left = spark.createDataFrame([("s", 10_000, 1), ("s", 15_000, 2), ("s", 15_001, 3), ("s", 9_999, 4), ("t", 20_000, 5)], "k string, t long, id long")
    right = spark.createDataFrame([("s", 10_000, 1, 7.0), ("s", 10_000, 2, 8.0), ("u", 19_999, 1, 9.0)], "k string, t long, q long, v double")
    out = {r["id"]: r["v"] for r in ordered.asof_backward(left, right, ["k"], "t", ["v"], tolerance=tolerance, tie=["q"]).collect()}
    assert out == {1: 8.0, 2: 8.0, 3: None if tolerance else 8.0, 4: None, 5: None}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=501), rng.integers(0, 4, size=200).astype(float), np.array([2.5]), -np.exp(rng.normal(size=77) * 8)):
        df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
        row = ordered.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.995}).first()
        np.testing.assert_allclose([row["a"], row["b"], row["c"]], np.quantile(values, [0.05, 0.5, 0.995]), rtol=1e-12)
        assert row["n"] == len(values)


def spread_of_chunks(df, value="v"):
    """Numbers of rows by chunk, and whether chunks follow the values."""
    rows = ordered.value_chunks(df, ["k"], value).groupBy("k", "_vc").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy("k", "_vc").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]) if a["k"] == b["k"])
    return [r["n"] for r in rows]


def test_value_chunks_follow_the_values(spark, small_chunks):
    values = sorted([0.0, -1e-300, 1e-300, 1e300, -1e300, 1.0, 1.0001, -1.0, -0.5, 3.0, 1e-5, 2e-5] + [1000 + i / 1e6 for i in range(2000)])
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    sizes = spread_of_chunks(df)
    assert sum(sizes) == len(values) + 2 and len(sizes) > 300 and max(sizes) <= 37


@pytest.mark.parametrize("value", ["1000 + id / 1000000", "1752105600000000000 + id * 86400000000"])
def test_narrow_values_spread(spark, value):
    """A million distinct values, however close, fill many chunks evenly; quantiles stay exact."""
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.expr(value).cast("double").alias("v"))
    sizes = spread_of_chunks(df)
    assert len(sizes) >= 16 and max(sizes) < 4 * sum(sizes) / len(sizes)
    row = ordered.quantiles(df, ["k"], "v", {"q": 0.5, "p": 0.999}).first()
    lo, hi = df.agg(F.min("v"), F.max("v")).first()
    assert row["n"] == 1_000_000 and abs(row["q"] - (lo + hi) / 2) <= 1e-12 * hi and row["p"] == pytest.approx(lo + (hi - lo) * 0.999, rel=1e-12)


def test_hot_key_spreads_over_tasks(spark):
    """A key with all rows is cut into chunks, none larger than asked for."""
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    dense = ordered.dense_index(df, ["k"], ["o"], F.expr("o div 100"))
    out = ordered.over_neighbours(dense, ["k"], lambda w: {"n": F.count("*").over(w.rowsBetween(-10**6, 10**6))}, before=5, after=5, chunk=100)
    assert out.agg(F.max("n")).first()[0] <= 110


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_key_statistics_do_not_move_the_rows(tables):
    """Per-key statistics are small and written first, so the plan broadcasts them and has no shuffle of the rows for them."""
    from bookflow.operators import aggregates as agg, distances as dist, micro, sequences, windows

    tape, by = tables.tape, ["run_id"]
    imb = micro.book_imbalance(tape).withColumnRenamed("imbalance", "score")
    flow = tables.flow.select("trade_date", "security_id", "row_seq")
    plans = {
        "M3": micro.l1_volume(tape), "M15": micro.time_of_day(tape), "W13": windows.split_ordered(flow, 50), "D2": sequences.subseqs(tape, n=7), "D2t": sequences.subseqs(tape, every_ns=10**12),
        "D3": dist.group_scores(imb, by, "rule"), "D3q": dist.group_scores(imb, by, "quantiles", probs=[0.5]), "D3b": dist.group_scores(imb, by, "bins", bins=4),
        "D5": sequences.position_groups(sequences.subseqs(tape, length=250)), "A9": agg.shared_hist(imb, imb, "score", 10, by), "A11": agg.iqm(imb, "score", by)}
    for name, df in plans.items():
        assert joins(df)[0] == 0 and joins(df)[1] >= 1, name
    w6 = micro.acf(imb.select("run_id", "kind", "row_seq", "score"), "score", 3)
    assert joins(w6) == (0, 1)


@pytest.mark.parametrize("sketch", [1000, 10])
def test_quantiles_of_several_columns_are_exact(spark, small_chunks, monkeypatch, sketch):
    """Large and small keys, ties, null values, and a sketch so coarse that brackets may miss."""
    monkeypatch.setattr(ordered, "SKETCH", sketch)
    rng = np.random.RandomState(3)
    rows = [("big", float(rng.lognormal()), float(rng.randint(3))) for _ in range(3000)]
    rows += [("small", float(rng.normal()), None) for _ in range(5)] + [("one", 2.5, 1.0), ("big", None, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    probs = {"_1": 0.2, "_2": 0.5, "_3": 0.99, "_4": 0.0, "_5": 1.0}
    out = {r["k"]: r for r in ordered.quantiles_of(df, ["k"], ["a", "b"], probs).collect()}
    assert set(out) == {"big", "small", "one"}
    for k in out:
        for i, c in enumerate(("a", "b")):
            have = [r[i + 1] for r in rows if r[0] == k and r[i + 1] is not None]
            for name, p in probs.items():
                want = pytest.approx(np.quantile(have, p), rel=1e-12) if have else None
                assert out[k][f"{name}_{c}"] == want


def test_missed_brackets_are_done_over_all_values(spark, small_chunks, monkeypatch):
    plain = F.percentile_approx  # value_chunks names its ranks in a list
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda col, ends, accuracy: plain(col, ends, accuracy) if isinstance(ends, list) else F.array(F.lit(-2.0), F.lit(-1.0)))
    df = spark.createDataFrame([(1, float(i)) for i in range(100)], "k int, a double")
    assert ordered.quantiles_of(df, ["k"], ["a"], {"_m": 0.5}).first()["_m_a"] == 49.5


def test_quantiles_of_move_few_values(spark, monkeypatch):
    seen = []
    plain = ordered.cumulative
    monkeypatch.setattr(ordered, "cumulative", lambda hist, *rest: seen.append(hist.count()) or plain(hist, *rest))
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.xxhash64("id") / 1e9).alias("a"))
    row = ordered.quantiles_of(df, ["k"], ["a"], {"_m": 0.5}).first()
    assert row["_m_a"] == df.selectExpr("percentile(a, 0.5) AS m").first()["m"]
    assert seen and max(seen) < n / 50
