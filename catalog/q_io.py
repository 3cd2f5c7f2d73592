"""Queries S, T: files written from the tables and read back, and the live operator."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from bookflow.functions import div
from bookflow.operators import bins, distances, micro, ordered, sequences
from bookflow.operators.sequences import SEQUENCE_KEYS
from bookflow.plans import compare
from bookflow.session import checkpoint_dir, stage
from bookflow.sources import readers, writers
from bookflow.streaming import live
from catalog import query
from catalog.adapters import BINNED_SQL, FIXED_EDGES, FLOW_KEYS, TAPE_KEYS, TOKENS_SQL, TOUCH, wall_us
from catalog.q_flow import DIST_SQL, K, feeds_sql, flow_q
from catalog.q_micro import MID, R, tape_sql
from catalog.q_compare import cmp_sql, runs
from catalog.q_scores import w_sql

folder = lambda t, label: f"{checkpoint_dir(t.spark)}/bookflow/{label}-{uuid.uuid4().hex}"
clock = lambda ms: F.format_string("%02d:%02d:%02d.%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)
price = lambda tick: F.format_string("%.2f", tick / 100.0)


DAYS = (20250709, 20250710)


def each_day(t, files, read):
    """One feed per day, each read with its date."""
    return reduce(DataFrame.unionByName, [read(t.spark, files(t, day), day) for day in DAYS])


def posts_files(t, day):
    """The posts of a day as a feed file with a header, every field as text."""
    path = folder(t, "feed-posts")
    code = F.split("security_id", "_")[0].cast("int")
    t.posts.filter(F.col("trade_date") == day).select(
        "channel_no", "appl_seq_num", F.lit("011").alias("md"), code.alias("sec"), F.lit("102").alias("src"), price(F.col("price_tick")).alias("price"),
        "order_qty", "side", clock(F.col("t_ms")).alias("time"), "ord_type", F.lit("x").alias("local"), F.lit("1").alias("seq"), F.lit("").alias("misc")).write.csv(path, header=True)
    return path


def txn_files(t, day):
    path = folder(t, "feed-txns")
    code = F.split("security_id", "_")[0].cast("int")
    t.txns.filter(F.col("trade_date") == day).select(
        "channel_no", F.col("txn_seq"), F.lit("011").alias("md"), "bid_seq", "offer_seq", code.alias("sec"), F.lit("102").alias("src"), F.lit("10.00").alias("px"),
        "last_qty", "exec_type", clock(F.col("t_ms")).alias("time"), F.lit("x").alias("local"), F.lit("1").alias("seq"), F.lit("").alias("misc")).write.csv(path, header=True)
    return path


def snap_files(t, day):
    path = folder(t, "feed-snaps")
    level = lambda i: [price(F.col("ask1") + i - 1).alias(f"AskPrice{i}"), F.lit(100 * i).alias(f"AskVolume{i}"), price(F.col("bid1") - i + 1).alias(f"BidPrice{i}"), F.lit(200 * i).alias(f"BidVolume{i}")]
    code = F.split("security_id", "_")[0].cast("int")
    t.snaps.filter(F.col("trade_date") == day).select(clock(F.col("t_ms")).alias("UpdateTime"), code.alias("SecurityID"), *[c for i in range(1, 11) for c in level(i)]).write.csv(path, header=True)
    return path


query("s1_read_posts", feeds_sql(f"SELECT {K}, channel_no, appl_seq_num, price_tick, order_qty, side, ord_type, t_ms FROM posts"))(
    lambda t: each_day(t, posts_files, readers.read_posts))
query("s2_read_transactions", feeds_sql(f"SELECT {K}, channel_no, bid_seq, offer_seq, last_qty, exec_type, t_ms, txn_seq FROM txns"))(
    lambda t: each_day(t, txn_files, readers.read_transactions))
query("s3_read_snapshots", feeds_sql(
    f"SELECT {K}, t_ms, round((bid1 + ask1) / 200.0, 6) + 0.0 AS mid_price, round((ask1 + 9) / 100.0, 6) + 0.0 AS ask_p_10, 2000.0 AS bid_v_10 FROM snaps"))(
    lambda t: each_day(t, snap_files, readers.read_snapshots).select(
        *FLOW_KEYS, "t_ms", "mid_price", F.col("levels")[9]["ask_p"].alias("ask_p_10"), F.col("levels")[9]["bid_v"].alias("bid_v_10")))


def mask_file(t):
    path = folder(t, "feed-mask")
    t.wide_mask.withColumnRenamed("trade_date", "Unnamed: 0").coalesce(1).write.csv(path, header=True)
    return path


query("s4_read_liquidity_mask", "SELECT * FROM (SELECT 20250709 + CAST(FLOOR(p_partkey / 8.0) AS BIGINT) % 2 AS trade_date, concat(lpad(CAST(p_partkey % 8 AS VARCHAR(6)), 6, '0'), '_XSHE') AS security_id, "
      "CAST(CASE WHEN sum(p_size) % 4 > 0 THEN 1 ELSE 0 END AS BIGINT) AS is_liquid FROM part GROUP BY ALL) WHERE trade_date = 20250710")(
    lambda t: readers.read_liquidity_mask(t.spark, mask_file(t), 20250710))

# One file pair per run and kind, under one date: times of day come back, the 30 days of the tape do not.
seq_name = lambda: F.concat(F.lit("r"), F.col("run_id").cast("string"), F.lit("-"), F.col("kind"))
SEQ = "concat('r', run_id, '-', kind) AS seq"


def lobster_files(t):
    def write():
        path = folder(t, "lobster")
        writers.write_lobster(t.tape, path, seq_name())
        return path
    return t.once("lobster", write)


TAPE_COLS = "event_type, order_id, size, price, direction"
LEVEL_COLS = ("ask_p", "ask_v", "bid_p", "bid_v")
level_cols = lambda n: [F.col("levels")[i - 1][c].alias(f"{c}_{i}") for i in range(1, n + 1) for c in LEVEL_COLS]
level_names = lambda n: ", ".join(f"{c}_{i}" for i in range(1, n + 1) for c in LEVEL_COLS)
WALL = "t_ns % 86400000000000 + 1752019200000000000 AS t_ns"
MESSAGE = ("t_ns", "event_type", "order_id", "size", "price", "direction")
query("s5_read_messages", tape_sql(f"SELECT {SEQ}, row_seq, {WALL}, {TAPE_COLS} FROM tape"))(
    lambda t: readers.read_messages(t.spark, lobster_files(t) + "/message", "2025-07-09", **writers.lobster_files()))
query("s6_read_book", tape_sql(f"SELECT {SEQ}, row_seq, ask_p_1, ask_v_1, bid_p_10, bid_v_10 FROM tape"))(
    lambda t: readers.read_book(t.spark, lobster_files(t) + "/orderbook", **writers.lobster_files()).select(
        "seq", "row_seq", F.col("levels")[0]["ask_p"].alias("ask_p_1"), F.col("levels")[0]["ask_v"].alias("ask_v_1"),
        F.col("levels")[9]["bid_p"].alias("bid_p_10"), F.col("levels")[9]["bid_v"].alias("bid_v_10")))
query("s7_read_tape", tape_sql(f"SELECT {SEQ}, row_seq, {TAPE_COLS}, ask_p_1, bid_p_1 FROM tape"))(
    lambda t: writers.read_lobster(t.spark, lobster_files(t), "2025-07-09").select(
        "seq", "row_seq", "event_type", "order_id", "size", "price", "direction", F.col("levels")[0]["ask_p"].alias("ask_p_1"), F.col("levels")[0]["bid_p"].alias("bid_p_1")))
query("s9_write_lobster", tape_sql(f"SELECT {SEQ}, row_seq, {WALL}, {TAPE_COLS}, {level_names(10)} FROM tape"))(
    lambda t: writers.read_lobster(t.spark, lobster_files(t), "2025-07-09").select("seq", "row_seq", *MESSAGE, *level_cols(10)))


def cut_files(t):
    path = folder(t, "lobster-cut")
    writers.write_cut(t.tape, 3, path, seq_name())
    return path


query("s10_write_cut", tape_sql(
    f"SELECT {SEQ}, row_number() OVER (PARTITION BY run_id, kind ORDER BY tape.row_seq) - 1 AS row_seq, {WALL}, {TAPE_COLS}, {level_names(3)} FROM tape WHERE price BETWEEN bid_p_3 AND ask_p_3"))(
    lambda t: writers.read_lobster(t.spark, cut_files(t), "2025-07-09", 3).select("seq", "row_seq", *MESSAGE, *level_cols(3)))


def record(t):
    path = folder(t, "bins")
    writers.save_bins(FIXED_EDGES, bins.bin_distribution(bins.apply_bins(t.flow, FIXED_EDGES)), bins.FIELDS, path)
    return path + "/record"


query("s11_bin_record", flow_q(f"SELECT field, bin, value, count, {R('count / total_count')} AS prob FROM dist", BINNED_SQL, DIST_SQL))(
    lambda t: readers.load_bins(t.spark, record(t))[1])


def bin_tables(t):
    path = folder(t, "bin-tables")
    writers.save_bins(FIXED_EDGES, bins.bin_distribution(bins.apply_bins(t.flow, FIXED_EDGES)), bins.FIELDS, path, record=False)
    edges, values = readers.load_bin_tables(t.spark, path)
    side = F.lit(None).cast("double")
    for name, e in edges.items():
        side = F.when(F.col("field") == name, F.array(*[F.lit(x) for x in e])[F.col("bin")]).otherwise(side)
    return values.withColumn("bin_left", side)


query("s11_bin_tables", flow_q(f"SELECT field, bin, value, count, {R('count / total_count')} AS prob, CASE field " + " ".join(
    f"WHEN '{f}' THEN {e}[bin + 1]" for f, e in FIXED_EDGES.items()) + " END AS bin_left FROM dist", BINNED_SQL, DIST_SQL))(bin_tables)


def written_flow(t):
    path = folder(t, "flow-table")
    writers.write_flow(t.flow, path, {"variant": "open_complete"})
    return t.spark.read.parquet(path + "/flow"), t.spark.read.json(path + "/meta")


query("s12_write_flow", flow_q(f"SELECT {K}, count(*) AS n, CAST(sum(order_qty) AS BIGINT) AS qty FROM flow GROUP BY {K}"))(
    lambda t: written_flow(t)[0].withColumn("trade_date", F.col("trade_date").cast("long")).groupBy(*FLOW_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("order_qty").alias("qty")))


def flow_meta(t):
    path = folder(t, "flow-facts")
    writers.write_flow(t.tokens, path, {"variant": "open_complete"})
    return t.spark.read.json(path + "/meta").select(*FLOW_KEYS, "fact", "value", "n", "variant")


query("s12_flow_meta", flow_q("SELECT trade_date, security_id, fact, value, CAST(sum(n) AS BIGINT) AS n, 'open_complete' AS variant FROM (" + " UNION ALL ".join(
    f"SELECT {K}, '{fact}' AS fact, CAST({value} AS VARCHAR) AS value, {n} AS n FROM tokens" for fact, value, n in (
        ("rows", "'all'", "1"), ("tokenizable", "'all'", "CASE WHEN tokenizable_event THEN 1 ELSE 0 END"), ("semantic", "event_semantic", "1"), ("side", "side", "1"))) + ") GROUP BY ALL", TOKENS_SQL))(flow_meta)


def metrics_files(t):
    """Metrics summaries, one JSON text per run, with NaN where a loss is missing."""
    path = folder(t, "metrics")
    nan = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
    one = F.format_string('"%s": {"n_real": %d, "n_generated": %d, "wasserstein": %s, "l1_by_group": %s, "weighted_wasserstein": %s}',
                          "metric", "n_real", "n_generated", nan("wasserstein"), nan("l1_by_group"), nan("weighted_wasserstein"))
    runs(t).groupBy("stock", "variant").agg(F.array_join(F.collect_list(one), ", ").alias("m")).select(
        F.concat(F.lit("stock-"), F.col("stock"), F.lit("-variant-"), F.col("variant")).alias("run"),
        F.concat(F.lit('{"reference_comparison": {"metrics": {'), "m", F.lit("}}}")).alias("value")).write.partitionBy("run").text(path)
    return path


query("s13_read_metrics", cmp_sql(f"SELECT stock, variant, metric, n_real, n_generated, {R('w')} AS w, {R('l1')} AS l1 FROM loss JOIN runs USING (stock, variant, metric)"))(
    lambda t: _losses_read(t))


def _losses_read(t):
    table = readers.read_metrics(t.spark, metrics_files(t)).withColumns({
        "stock": F.regexp_extract("path", r"stock-(\d+)-", 1).cast("long"), "variant": F.regexp_extract("path", r"variant-(\d+)/", 1).cast("long")})
    sizes = table.select("stock", "variant", "metric", "n_real", "n_generated")
    return compare.losses(table, ["stock", "variant"]).join(sizes, ["stock", "variant", "metric"])


def written_table(t):
    out = None
    for fmt in ("csv", "tsv", "json", "parquet"):
        path = folder(t, f"table-{fmt}")
        writers.write_table(t.raw("nation").join(t.raw("customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")), path, fmt)
        schema = "n_name string, n long"
        rows = {"csv": lambda: t.spark.read.csv(path, header=True, schema=schema), "tsv": lambda: t.spark.read.csv(path, header=True, sep="\t", schema=schema),
                "json": lambda: t.spark.read.json(path, schema=schema), "parquet": lambda: t.spark.read.parquet(path)}[fmt]().select(F.lit(fmt).alias("fmt"), "n_name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


query("s14_write_table", "SELECT fmt, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey, (SELECT unnest(['csv', 'tsv', 'json', 'parquet']) AS fmt) GROUP BY ALL")(written_table)


def catalogue(t):
    """Files named after the runs and days of the tape."""
    root = folder(t, "catalogue")
    for role, kind in (("real", "real"), ("gen", "generated"), ("cond", "real")):
        runs_of = t.tape.filter(F.col("kind") == kind).groupBy("run_id").agg(div(F.min("t_ns"), 86_400 * micro.NS).alias("day"))
        date = F.date_format(F.date_add(F.lit("1970-01-01"), F.col("day").cast("int")), "yyyy-MM-dd")
        tail = F.lit("_gen_id_0" if role == "gen" else "")
        names = F.explode(F.array(*[F.concat(F.lit("X_"), date, F.lit(f"_0_1_{what}_10_real_id_"), F.col("run_id").cast("string"), tail, F.lit(".csv")) for what in ("message", "orderbook")]))
        runs_of.select(names.alias("file"), F.col("day").cast("string").alias("value")).coalesce(1).write.partitionBy("file").text(f"{root}/{role}")
    return readers.read_catalogue(t.spark, f"{root}/real", f"{root}/gen", f"{root}/cond")


query("s8_read_catalogue", tape_sql(
    "SELECT strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS date, CAST(run_id AS VARCHAR) AS real_id, role, CASE WHEN role = 'generated' THEN '0' ELSE '' END AS gen_id FROM "
    "(SELECT run_id, kind, min(t_ns) // 86400000000000 AS day FROM tape GROUP BY ALL) JOIN (VALUES ('real', 'real'), ('generated', 'generated'), ('real', 'conditional')) v(kind, role) USING (kind)"))(
    lambda t: catalogue(t).select("date", "real_id", "role", "gen_id"))


def sequences_of(t):
    """The tape as a catalogue: the real half of a run, two generated sequences for it, and its new orders as the conditional one."""
    day = t.tape.filter("kind = 'real'").groupBy("run_id").agg(div(F.min("t_ns"), 86_400 * micro.NS).alias("_day"))
    gen = F.when(F.col("kind") == "generated", F.pmod(div(F.col("event_id"), 2), F.lit(2)).cast("string")).otherwise("")
    rows = t.tape.withColumn("gen_id", gen).unionByName(t.tape.filter("kind = 'real' AND event_type = 1").withColumns({"kind": F.lit("conditional"), "gen_id": F.lit("")}))
    dated = rows.join(F.broadcast(day), "run_id").withColumns({  # one row a run
        "date": F.date_format(F.date_add(F.lit("1970-01-01"), F.col("_day").cast("int")), "yyyy-MM-dd"), "real_id": F.col("run_id").cast("string")})
    return ordered.dense_index(dated.withColumnRenamed("row_seq", "_old"), SEQUENCE_KEYS, ["_old"], ordered.chunk_of("_old"))


def loaded(t):
    """The catalogue of `sequences_of`, written and loaded."""
    def build():
        path = folder(t, "catalogue-files")
        writers.write_catalogue(sequences_of(t), path)
        return stage(readers.load_catalogue(t.spark, f"{path}/real", f"{path}/generated", f"{path}/conditional"), "catalogue")
    return t.once("loaded-catalogue", build)


SEQUENCES_SQL = """days AS (SELECT run_id, min(t_ns) // 86400000000000 AS d FROM tape WHERE kind = 'real' GROUP BY run_id),
roles AS (SELECT *, CASE WHEN kind = 'generated' THEN CAST((event_id // 2) % 2 AS VARCHAR) ELSE '' END AS gen_id FROM tape
  UNION ALL SELECT * REPLACE ('conditional' AS kind), '' FROM tape WHERE kind = 'real' AND event_type = 1),
sequences AS (SELECT * EXCLUDE (row_seq) REPLACE (t_ns % 86400000000000 + d * 86400000000000 AS t_ns), strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS date, CAST(run_id AS VARCHAR) AS real_id,
  row_number() OVER (PARTITION BY run_id, gen_id, kind ORDER BY row_seq) - 1 AS row_seq FROM roles JOIN days USING (run_id))"""
SK = ", ".join(SEQUENCE_KEYS)
query("s8_load_catalogue", tape_sql(f"SELECT {SK}, row_seq, t_ns, {TAPE_COLS}, {level_names(10)} FROM sequences", SEQUENCES_SQL))(
    lambda t: loaded(t).select(*SEQUENCE_KEYS, "row_seq", *MESSAGE, *level_cols(10)))

# D1 over a catalogue: every kind scored, by parts of a fortieth of the real sequence.
PART_SQL = ("parts AS (SELECT *, row_seq // (count(*) FILTER (kind = 'real') OVER (PARTITION BY date, real_id) // 40) AS sub_id FROM sequences),\n"
            f"scored AS (SELECT {SK}, sub_id, avg(ask_p_1 - bid_p_1) AS score FROM parts GROUP BY ALL)")
mean_spread = lambda rows, keys: rows.groupBy(*keys).agg(F.avg(micro.spread_of()).alias("score"))
scored = lambda t: sequences.score_sequences(loaded(t), mean_spread, n=40)
query("d1_score_conditional", tape_sql(f"SELECT {SK}, sub_id, {R('score')} AS score FROM scored", SEQUENCES_SQL, PART_SQL))(scored)
query("d1_compare_sequences", tape_sql(
    f"SELECT real_id, n_real, n_generated, {R('wasserstein')} AS wasserstein FROM w", SEQUENCES_SQL, PART_SQL, "two AS (SELECT * FROM scored WHERE kind <> 'conditional')", w_sql("two", "real_id", "w")))(
    lambda t: distances.wasserstein(scored(t), ["real_id"]))


def live_intervals(t):
    schema = t.raw("events").schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    tape = source.select(F.timestamp_micros(wall_us("ts")).alias("ts"), *[F.expr(TOUCH[c]).alias(c) for c in ("run_id", "kind", "event_type", "size")],
                         ((F.expr(TOUCH["ask1"]) + F.expr(TOUCH["bid1"])) / 2).alias("mid"))
    out = live.run_available(live.stream_interval(tape, "1 hour", "2 hours"), folder(t, "live"), folder(t, "live-checkpoint"))
    return out.select(*TAPE_KEYS, F.unix_seconds("label").alias("label_s"), "mean", "executed_volume", "n")


query("t1_stream_interval", tape_sql(
    f"SELECT run_id, kind, h * 3600 + 3600 AS label_s, {R(f'avg({MID})')} AS mean, CAST(sum(CASE WHEN event_type = 4 THEN size ELSE 0 END) AS BIGINT) AS executed_volume, count(*) AS n FROM "
    "(SELECT *, t_ns // 3600000000000 AS h FROM tape) GROUP BY run_id, kind, h HAVING (h + 1) * 3600000000 <= (SELECT max(t_ns) // 1000 // 1000 * 1000 FROM tape) - 7200000000"))(live_intervals)
