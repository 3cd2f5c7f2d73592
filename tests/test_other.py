import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import aggregates as agg, cluster, filters, micro, vectors, windows
from bookflow.plans import benchmark, compare
from bookflow.sources import readers, writers


def tape(spark, rows):
    """rows: (t_ns, type, order_id, size, price, ask, bid)"""
    data = [("r", "real", i, *r[:5], 1, [(r[5], 100, r[6], 200)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, kind string, row_seq long, t_ns long, event_type int, order_id long, size long, price long, direction int, "
                                       "levels array<struct<ask_p: long, ask_v: long, bid_p: long, bid_v: long>>")


S = 1_000_000_000


@pytest.mark.parametrize("trades, want", [
    ([(0.2, 10), (0.5, 20)], {0: 30 * (1 / 0.3) * 60}),                      # one second, span 0.3 s
    ([(0.2, 10), (0.25, 20)], {}),                                           # one second, span below 0.1 s
    ([(0.2, 10)], {0: 600.0}),                                               # one instant
    ([(0.5, 10), (1.5, 20), (2.5, 30)], {1: 1200.0, 2: 30 * 2 * 60}),        # first second dropped, last scaled
    ([(0.95, 10), (1.5, 20), (2.05, 30)], {0: 10 / 0.05 * 60, 1: 1200.0}),   # first scaled, last dropped
])
def test_volume_per_minute_edges(spark, trades, want):
    rows = [(int(t * S), 4, 1, v, 100, 101, 99) for t, v in trades]
    got = {r["second"]: r["volume_per_minute"] for r in micro.volume_per_minute(tape(spark, rows)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_lifecycle_uses_first_two_rows(spark):
    rows = [(1, 1, 5, 1, 1, 2, 1), (4, 4, 5, 1, 1, 2, 1), (9, 4, 5, 1, 1, 2, 1), (3, 4, 6, 1, 1, 2, 1), (5, 1, 6, 1, 1, 2, 1), (2, 1, 7, 1, 1, 2, 1), (2, 2, 8, 1, 1, 2, 1), (3, 1, 8, 1, 1, 2, 1)]
    got = {r["order_id"]: r["delta_ns"] for r in micro.time_to_first_fill(tape(spark, rows)).collect()}
    assert got == {5: 3, 6: 2}


def test_missing_levels(spark):
    df = spark.createDataFrame([([(-1, 1, None, 1)], 5)], "levels array<struct<ask_p: long, ask_v: long, bid_p: long, bid_v: long>>, price long")
    low, high = filters.level_range(F.col("levels"), 1)
    assert tuple(df.select(low, high).first()) == (-9_999_999_999, 9_999_999_999)
    assert filters.filter_by_level(df, 1).count() == 1


def test_total_volume_checks_depth(spark):
    with pytest.raises(Exception, match="fewer levels"):
        micro.total_volume(tape(spark, [(1, 1, 1, 1, 1, 2, 1)]), 2).collect()


def test_acf_interval(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    df = spark.createDataFrame([("r", "real", i, float(v)) for i, v in enumerate(x)], "run_id string, kind string, row_seq long, v double")
    rows = micro.acf(df, "v", 4, alpha=0.05).orderBy("lag").collect()
    c = x - x.mean()
    rho = [float((c[:60 - k] * c[k:]).sum() / (c * c).sum()) for k in range(5)]
    assert [r["acf"] for r in rows] == pytest.approx(rho)
    half = [0.0, *[1.959963984540054 * math.sqrt((1 + 2 * sum(r * r for r in rho[1:k])) / 60) for k in range(1, 5)]]
    assert [r["ci_high"] - r["acf"] for r in rows] == pytest.approx(half)


def test_loss_stats_equals_iqm(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 8), ("c", 13)) for v in rng.random(n)] + [("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    one = {r["k"]: (r["n"], r["mean"], r["median"], r["iqm"]) for r in agg.iqm(df, "x", ["k"]).collect()}
    two = {r["k"]: (r["n"], r["mean"], r["median"], r["iqm"]) for r in agg.loss_stats(df, {"": "x"}, ["k"]).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k] == pytest.approx(two[k])


def test_benchmark_reports_failures(spark):
    only = tape(spark, [(i * S, 1, i, 1, 100, 101, 99) for i in range(3)])
    rows = benchmark.benchmark(only).collect()
    assert len(rows) == 24 and all(r["status"] == "failed" and r["reason"] for r in rows)


def sweep(spark, rows):
    return cluster.sweep_table(spark, [dict(k=k, silhouette=s, min_cluster_frac=f, n_samples=10_000) for k, s, f in rows])


def test_plateau_stops_at_first_drop(spark):
    row = cluster.recommend_k(sweep(spark, [(8, 0.20, 0.05), (12, 0.19, 0.05), (16, 0.10, 0.05), (20, 0.195, 0.05)]), eps=0.02).first()
    assert (row["recommended_k"], row["plateau_k"], row["feasible_ks"]) == (8, 12, "8,12,16,20")
    row = cluster.recommend_k(sweep(spark, [(8, 0.20, 0.001), (12, 0.25, 0.002)])).first()
    assert row["recommended_k"] == 12 and row["plateau_k"] is None and row["feasible_ks"] == "8,12"


def sweep_directly(x, starts, steps):
    """k-means from a start, step by step, and its measures."""
    c = np.array(starts, float)
    for _ in range(steps):
        lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(len(c))])
    gap = ((x[:, None] - c[None]) ** 2).sum(2)
    lab = gap.argmin(1)
    has = [j for j in range(len(c)) if (lab == j).any()]
    m = np.array([x[lab == j].mean(0) for j in has])
    n = np.array([(lab == j).sum() for j in has])
    within = sum(((x[lab == j] - m[i]) ** 2).sum() for i, j in enumerate(has))
    between = (n * ((m - x.mean(0)) ** 2).sum(1)).sum()
    s = np.array([np.sqrt(((x[lab == j] - m[i]) ** 2).sum(1)).mean() for i, j in enumerate(has)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(m[i] - m[j]) for j in range(len(has)) if j != i) for i in range(len(has))])
    return {"inertia": gap.min(1).sum(), "calinski_harabasz": between * (len(x) - len(has)) / (within * (len(has) - 1)), "davies_bouldin": db,
            "min_cluster_frac": n.min() / len(x) if len(has) == len(c) else 0.0, "n_nonempty_clusters": len(has), "intra_mean": np.sqrt(gap.min(1)).mean()}


def test_sweep_from_a_start(spark):
    """All k in one pass a step give what each k gives alone; one start has a centre without points."""
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 1, (150, 2)), rng.normal(4, 1, (100, 2)), rng.normal(-6, 0.5, (60, 2))]
    z = (x - x.mean(0)) / x.std(0)
    starts = {2: z[[0, 200]], 3: z[[0, 200, 300]], 4: np.r_[z[[0, 1, 200]], [[50.0, 50.0]]]}
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "start long, a double, b double").repartition(5)
    out = {r["k"]: r for r in cluster.kmeans_sweep(df, [2, 3, 4], cols=["a", "b"], starts={k: v.tolist() for k, v in starts.items()}, steps=7).collect()}
    for k, start in starts.items():
        want = sweep_directly(z, start, 7)
        assert {c: out[k][c] for c in want} == {c: pytest.approx(v, rel=1e-9) for c, v in want.items()}
        assert 0 < out[k]["silhouette"] < 1
    own = cluster.kmeans_sweep(df, [2, 3, 400], cols=["a", "b"]).collect()
    assert [r["k"] for r in own] == [2, 3] and own[1]["inertia"] < 1.05 * sweep_directly(z, starts[3], 50)["inertia"]


def test_silhouette_matches_definition(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (40, 3)), rng.normal(3, 1, (30, 3)), rng.normal(9, 1, (1, 3))]
    lab = np.r_[np.zeros(40), np.ones(30), [2]].astype(int)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = (lab == lab[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(lab[i])) for i in range(len(x))], "start long, z array<double>, label int")
    assert cluster.silhouette_squared(df, 3).first()["silhouette"] == pytest.approx(np.mean(s), rel=1e-6)


@pytest.mark.parametrize("block, pivots", [(2048, 64), (7, 5)])
def test_nearest_is_exact(spark, block, pivots):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(60, 4)), np.repeat(rng.normal(5, 0.1, (1, 4)), 40, axis=0) + rng.normal(0, 0.01, (40, 4))]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = df.filter("vec_id % 2 = 0"), df.filter("vec_id % 2 = 1")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    even, odd = np.arange(0, 100, 2), np.arange(1, 100, 2)
    other = {r["vec_id"]: r["distance"] for r in vectors.nearest(a, b, "vec_id", "embedding", block=block, pivots=pivots).collect()}
    own = {r["vec_id"]: r["distance"] for r in vectors.nearest(a, a, "vec_id", "embedding", same_set=True, block=block, pivots=pivots).collect()}
    for i in even:
        assert other[i] == pytest.approx(d[i, odd].min())
        assert own[i] == pytest.approx(min(d[i, j] for j in even if j != i))


@pytest.mark.parametrize("same", [False, True])
def test_least_distances_of_tiles_are_exact(monkeypatch, same):
    """Far from the origin, with copies and near copies, where products alone would cancel."""
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(8)
    a = rng.normal(1000, 1, (70, 5))
    b = np.r_[a[:30] + rng.normal(0, 1e-7, (30, 5)), a[30:60], rng.normal(1000, 1, (40, 5))]
    ids = (np.arange(70), np.r_[np.arange(60), np.full(40, 3)]) if same else None
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    if same:
        d[ids[0][:, None] == ids[1][None, :]] = np.inf
    assert vectors._least(a, b, ids).tolist() == d.min(axis=1).tolist()


def test_least_distances_of_one_point_and_of_infinite_ones():
    assert vectors._least(np.ones((1, 2)), np.ones((1, 2)), (np.array([5]), np.array([5])))[0] == np.inf
    assert vectors._least(np.array([[np.inf, 0.0]]), np.zeros((2, 2)))[0] == np.inf


def test_cosines_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 9)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = (u @ u.T)[~np.eye(50, dtype=bool)]
    row = vectors.cosine_summary(df, "vec_id").first()
    assert row["count"] == off.size
    assert [row["mean"], row["std"], row["p05"], row["p50"], row["p99"], row["max"]] == pytest.approx(
        [off.mean(), off.std(), *np.quantile(off, [0.05, 0.5, 0.99]), off.max()])


def test_cosines_in_tiles_and_few_copies(spark, monkeypatch):
    """Many tiles to a block, copies among the vectors; each vector is sent at most BLOCKS times, however many there are."""
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "TILE", 4)
    monkeypatch.setattr(vectors, "BLOCKS", 5)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 6))
    x[40:] = x[:20]
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = (u @ u.T)[~np.eye(60, dtype=bool)]
    sent, plain = [], vectors._block_pairs
    monkeypatch.setattr(vectors, "_block_pairs", lambda units, key, blocks: sent.append(blocks) or plain(units, key, blocks))
    row = vectors.cosine_summary(df, "vec_id").first()
    assert sent == [5]
    assert [row[c] for c in (*vectors.QUANTILES, "min", "max")] == pytest.approx([*np.quantile(off, list(vectors.QUANTILES.values())), off.min(), off.max()])


def test_assignment_is_greedy_and_unique(spark):
    rng = np.random.default_rng(5)
    cand, cent = rng.normal(size=(80, 16)), rng.normal(size=(6, 12))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(cand)], "vec_id long, embedding array<double>").repartition(5)
    got = {r["centroid"]: r["vec_id"] for r in vectors.assign_unique(cent.tolist(), df, "vec_id", d=3, seed=9).collect()}
    r = np.random.RandomState(9)
    left, right = r.normal(size=(12, 3)) / np.sqrt(12), r.normal(size=(16, 3)) / np.sqrt(16)
    z, u = ((cent - cent.mean(0)) / cent.std(0)) @ left, cand @ right
    cos = (z / np.linalg.norm(z, axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T
    want, used = {}, set()
    for i in np.argsort(-cos.max(axis=1)):
        j = next(j for j in np.argsort(-cos[i]) if j not in used)
        want[int(i)] = int(j)
        used.add(j)
    assert got == want


def test_messy_message_file(spark, tmp_path):
    (tmp_path / "X_2025-07-10_0_1_message_10.csv").write_text(
        "34200.5,1,7,100,101000,1\n" "34200.1.25,2,7,50,101000,1\n" "34201,x,7,50,101000,1\n" "34202.000000001s,4,7,50,101000,-1,extra\n" "34203,3,7\n" "34204.75,3,7,50,101000,-1\n")
    rows = readers.read_messages(spark, str(tmp_path / "*message*.csv")).orderBy("row_seq").collect()
    day = 1_752_105_600 * S
    assert [(r["row_seq"], r["t_ns"] - day) for r in rows] == [(0, 34_200_500_000_000), (1, 342_001_250_000_000), (3, 34_202_000_000_001), (5, 34_204_750_000_000)]


def test_line_counts_must_match(spark, tmp_path):
    (tmp_path / "X_2025-07-10_0_1_message_1.csv").write_text("1,1,7,100,101000,1\n2,1,7,100,101000,1\n")
    (tmp_path / "X_2025-07-10_0_1_orderbook_1.csv").write_text("101100,5,101000,6\n")
    with pytest.raises(ValueError, match="row counts differ"):
        readers.read_tape(spark, str(tmp_path / "*message*"), str(tmp_path / "*orderbook*"), 1)
    (tmp_path / "X_2025-07-10_0_1_orderbook_1.csv").write_text("101100,5,101000,6\n9999999999,0,101000,7\n")
    out = readers.read_tape(spark, str(tmp_path / "*message*"), str(tmp_path / "*orderbook*"), 1).orderBy("row_seq").collect()
    assert [(r["row_seq"], r["levels"][0]["ask_p"], r["levels"][0]["bid_v"]) for r in out] == [(0, 101100, 6), (1, None, 7)]


def test_snapshot_file_with_unnamed_field(spark, tmp_path):
    head = ["UpdateTime", "SecurityID"] + [f"{s}{x}{i}" for x in ("Price", "Volume") for s in ("Bid", "Ask") for i in (1, 2)]
    lines = [",".join(head), "09:31:00.120,617,9.99,9.98,10.01,10.02,5,6,7,8,z", "09:31,617,9.99,9.98,10.01,10.02,5,6,7,8,z", "09:31:01.000,617,,9.98,10.01,10.02,5,6,7,8,z"]
    (tmp_path / "snap.csv").write_text("\n".join(lines) + "\n")
    rows = readers.read_snapshots(spark, str(tmp_path / "snap.csv"), 20250709, 2).collect()
    assert len(rows) == 1 and rows[0]["security_id"] == "000617_XSHE" and rows[0]["t_ms"] == 34_260_120
    assert rows[0]["mid_price"] == pytest.approx(10.0) and rows[0]["levels"][1]["ask_v"] == 8.0


def test_metrics_with_nan(spark, tmp_path):
    body = {"a": {"n_real": 3, "n_generated": 4, "wasserstein": float("nan"), "l1_by_group": 0.5}, "b": {"n_real": 3, "n_generated": 4, "weighted_wasserstein": 0.25},
            "c": {"n_real": 1, "n_generated": 1, "wasserstein": float("inf"), "l1_by_group": None}}
    (tmp_path / "metrics_summary.json").write_text(json.dumps({"reference_comparison": {"metrics": body}}, indent=1))
    rows = {r["metric"]: (r["w"], r["l1"]) for r in compare.losses(readers.read_metrics(spark, str(tmp_path)), ["path"]).collect()}
    assert rows == {"a": (None, 0.5), "b": (0.25, None), "c": (None, None)}


def test_catalogue_rejects_double_conditionals(spark, tmp_path):
    for folder, names in (("real", ["X_2025-07-10_a_message_real_id_1.csv", "X_2025-07-10_a_orderbook_real_id_1.csv"]), ("gen", ["X_2025-07-10_a_message_real_id_1_gen_id_0.csv"]),
                          ("cond", ["X_2025-07-10_a_message_real_id_1.csv", "Y_2025-07-10_b_message_real_id_1.csv"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("1\n")
    with pytest.raises(ValueError, match="several conditional"):
        readers.read_catalogue(spark, *[str(tmp_path / f) for f in ("real", "gen", "cond")])
    assert readers.read_catalogue(spark, str(tmp_path / "real"), str(tmp_path / "gen")).count() == 2


def lines(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(rows) + "\n")


def test_catalogue_is_loaded(spark, tmp_path):
    message = lambda t, n: [f"{t + i}.5,1,{i + 1},100,101000,1" for i in range(n)]
    book = lambda n: [f"101100,{i},101000,{i}" for i in range(n)]
    name = lambda day, what, real, gen=None: f"X_{day}_a_{what}_10_real_id_{real}" + (f"_gen_id_{gen}" if gen is not None else "") + ".csv"
    for day, real in (("2025-07-10", 1), ("2025-07-11", 1), ("2025-07-11", 2)):
        lines(tmp_path / "real" / name(day, "message", real), message(34200, 3))
        lines(tmp_path / "real" / name(day, "orderbook", real), book(3))
    for real, gen in ((1, 0), (1, 1)):
        lines(tmp_path / "gen" / name("2025-07-10", "message", real, gen), message(35000 + gen, 2) + ["x,1,1,1,1,1"] + message(36000, 1))
        lines(tmp_path / "gen" / name("2025-07-10", "orderbook", real, gen), book(4))
    lines(tmp_path / "gen" / name("2025-07-12", "message", 7, 0), message(1, 9))
    lines(tmp_path / "gen" / name("2025-07-12", "orderbook", 7, 0), book(9))
    lines(tmp_path / "cond" / name("2025-07-11", "message", 2), message(34000, 5))
    roots = [str(tmp_path / f) for f in ("real", "gen", "cond")]
    with pytest.warns(UserWarning, match="2 real sequences"):
        out = readers.load_catalogue(spark, *roots, levels=1)
    rows = out.orderBy("date", "real_id", "gen_id", "kind", "row_seq").collect()
    seen = {}
    for r in rows:
        seen.setdefault((r["date"], r["real_id"], r["gen_id"], r["kind"]), []).append((r["row_seq"], r["levels"] and r["levels"][0]["ask_v"]))
    three = [(0, 0), (1, 1), (2, 2)]
    assert seen == {("2025-07-10", "1", "", "real"): three, ("2025-07-11", "1", "", "real"): three, ("2025-07-11", "2", "", "real"): three,
                    ("2025-07-10", "1", "0", "generated"): [(0, 0), (1, 1), (2, 3)], ("2025-07-10", "1", "1", "generated"): [(0, 0), (1, 1), (2, 3)],
                    ("2025-07-11", "2", "", "conditional"): [(i, None) for i in range(5)]}
    lines(tmp_path / "real" / name("2025-07-11", "orderbook", 2), book(2))
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="row counts differ"):
        readers.load_catalogue(spark, *roots, levels=1)
    with pytest.warns(UserWarning):
        assert readers.load_catalogue(spark, *roots, levels=1, strict=False).count() == 20


def test_catalogue_keeps_line_order_over_parts(spark, tmp_path):
    """A sequence of many part files comes back in its order."""
    rows = spark.range(5000).select(F.lit("2025-07-10").alias("date"), F.lit("4").alias("real_id"), F.lit("").alias("gen_id"), F.lit("real").alias("kind"), F.col("id").alias("row_seq"),
                                    (F.col("id") * 1000).alias("t_ns"), F.lit(1).alias("event_type"), F.col("id").alias("order_id"), F.lit(5).alias("size"), F.lit(7).alias("price"), F.lit(1).alias("direction"),
                                    F.array(F.struct(F.col("id").alias("ask_p"), F.lit(1).alias("ask_v"), F.lit(1).alias("bid_p"), F.lit(1).alias("bid_v"))).alias("levels")).repartition(9)
    writers.write_catalogue(rows, str(tmp_path / "c"), levels=1)
    assert len(list((tmp_path / "c" / "real").rglob("part-*.csv"))) > 4
    out = readers.load_catalogue(spark, str(tmp_path / "c" / "real"), str(tmp_path / "c" / "real"), levels=1)
    real = out.filter("kind = 'real'")
    assert real.count() == 5000 and real.filter("row_seq <> order_id OR levels[0].ask_p <> order_id").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "] csv" not in plan and "Window" not in plan  # files are parsed once, and lines numbered without a sort


def test_incomplete_bin_record_fails(spark, tmp_path):
    (tmp_path / "bins.json").write_text(json.dumps({"price_mid_diff": {"bins": [0, 1]}}))
    with pytest.raises(ValueError, match="bin record lacks"):
        readers.load_bins(spark, str(tmp_path / "bins.json"))


def test_state_is_checked_against_its_metadata(spark, tmp_path):
    tokens = spark.createDataFrame([("a", i, [1, 2]) for i in range(5)] + [("b", 0, [3, 4])], "security_id string, slot long, tokens array<int>")
    path = str(tmp_path / "s")
    writers.write_state(tokens, path, [0.0, 1.0], ["security_id"])
    back, meta = writers.read_state(spark, path)
    assert back.count() == 6 and {(r["security_id"], r["n_rows"], tuple(r["vol_edges"])) for r in meta.collect()} == {("a", 5, (0.0, 1.0)), ("b", 1, (0.0, 1.0))}
    tokens.filter("slot > 2").write.mode("append").partitionBy("security_id").parquet(path + "/state")
    with pytest.raises(ValueError, match="rows in the metadata"):
        writers.read_state(spark, path)


def test_bins_as_tables(spark, tmp_path):
    from bookflow.operators import bins

    edges = {f: [0.0, 2.0, 4.0] for f in bins.FIELDS}
    dist = spark.createDataFrame([(f, b, float(b), 3, 1.0, 1, 3) for f in bins.FIELDS for b in (0, 1)], "field string, bin int, value double, count long, prob double, n_unique long, total_count long")
    writers.save_bins(edges, dist, bins.FIELDS, str(tmp_path / "b"), record=False)
    got, values = readers.load_bin_tables(spark, str(tmp_path / "b"))
    assert got == edges and values.count() == 6 and not (tmp_path / "b" / "record").exists()
    spark.createDataFrame([("price", [1.0])], "field string, edges array<double>").write.mode("overwrite").parquet(str(tmp_path / "b" / "bin_edges"))
    with pytest.raises(ValueError, match="bin edges lack"):
        readers.load_bin_tables(spark, str(tmp_path / "b"))


def test_cut_refuses_its_source(tables):
    with pytest.raises(ValueError, match="same"):
        writers.write_cut(tables.tape, 3, "/x/y", F.lit("s"), source="/x/y/")


def test_clean_lines_fails_when_short(spark):
    df = spark.createDataFrame([(1, '1. "one"'), (2, "  "), (3, "“two”")], "line_no int, text string")
    assert [r["text"] for r in filters.clean_lines(df, 2).orderBy("line_no").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="fewer than 3"):
        filters.clean_lines(df, 3).collect()


def test_thinning_by_share_is_stable(spark):
    df = spark.range(1000).select(F.lit("d").alias("trade_date"), F.lit("s").alias("security_id"), F.col("id").alias("row_seq"))
    one = {r["row_seq"] for r in windows.thin(df, 3, 0.2, seed=1).collect()}
    two = {r["row_seq"] for r in windows.thin(df.repartition(9), 3, 0.2, seed=1).collect()}
    assert one == two and 40 < len(one) < 95 and all(x % 3 == 0 for x in one)


def test_stream_matches_batch(spark, tables, tmp_path):
    from bookflow.streaming import live

    rows = tables.tape.select("run_id", "kind", "event_type", "size", micro.mid().alias("mid"), F.timestamp_micros((F.col("t_ns") / 1000).cast("long")).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = live.run_available(live.stream_interval(stream, "6 hours", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = live.stream_interval(rows, "6 hours", "1 hour")
    assert out.count() > 0 and out.exceptAll(batch).count() == 0
