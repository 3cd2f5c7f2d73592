"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bookflow.operators import bins, cluster, depth, flow as flows, micro, state, windows  # noqa: E402
from bookflow.plans import benchmark as bench  # noqa: E402
from bookflow.session import build_session  # noqa: E402
from catalog.adapters import FIXED_EDGES, Tables  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    spark.range(1000).groupBy("id").count().collect()

    keys = [*flows.BY, "start"]
    feats = lambda: windows.window_features(t.flow, 50, 2)
    from catalog.q_state import S, STEP_MS, snapshots

    work = {
        "build_flow": lambda: t.flow.count(),
        "match_rate": lambda: run(flows.match_rate(flows.expand_legs(t.txns), flows.after_open(flows.limit_orders(t.posts)))),
        "fit_bins": lambda: t.edges,
        "encode_tokens": lambda: run(bins.encode_token(bins.apply_bins(t.flow, FIXED_EDGES), tuple(len(FIXED_EDGES[f]) - 1 for f in bins.FIELDS))),
        "window_features": lambda: run(feats()),
        "k_sweep": lambda: run(cluster.kmeans_sweep(windows.window_features(t.flow, 50, 2), list(range(8, 49, 4)), key=keys)),
        "level_depth": lambda: run(depth.level_depth(t.flow)),
        "book_after": lambda: run(depth.book_after(depth.level_depth(t.flow), 10)),
        "benchmark_24": lambda: run(bench.benchmark(t.tape)),
        "stream_summary": lambda: run(bench.stream_summary(t.tape)),
        "ofi": lambda: run(micro.ofi(t.tape)),
        "book_state": lambda: run(state.book_state(snapshots(t), STEP_MS, 360, S)),
    }
    times, begin = {}, time.time()
    for name, job in work.items():
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
    n_windows = feats().count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "windows": n_windows, "windows_per_second": round(n_windows / times["window_features"], 1), "wall": round(time.time() - begin, 1)}))


if __name__ == "__main__":
    main()
