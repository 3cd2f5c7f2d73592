"""Readers of raw feeds, tapes, bin records and metrics files.

CSV rows are read as text fields and coerced one by one, so a bad field costs its row and never the
file. Where order matters, rows carry their place in the file: file, block start and position in the
block, which together increase with the line.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from bookflow.functions import EXEC_CANCEL, EXEC_TRADE, clock_ms, norm_security, number
from bookflow.operators.filters import unpivot_mask
from bookflow.operators.ordered import chunk_of, dense_index, join_key_stats
from bookflow.operators.sequences import SEQUENCE_KEYS
from bookflow.session import stage

TICKS_PER_UNIT = 100
POST_FIELDS = ("ChannelNo", "ApplSeqNum", "MDStreamID", "SecurityID", "SecurityIDSource", "Price", "OrderQty", "Side",
               "TransactTime", "OrdType", "LocalTime", "SeqNo", "MISC")
TXN_FIELDS = ("ChannelNo", "ApplSeqNum", "MDStreamID", "BidApplSeqNum", "OfferApplSeqNum", "SecurityID", "SecurityIDSource",
              "LastPx", "LastQty", "ExecType", "TransactTime", "LocalTime", "SeqNo", "MISC")
MESSAGE_FIELDS = ("time", "event_type", "order_id", "size", "price", "direction")
LEVEL_FIELDS = (("ask_p", "AskPrice"), ("ask_v", "AskVolume"), ("bid_p", "BidPrice"), ("bid_v", "BidVolume"))


def _text_csv(spark: SparkSession, path, names: Sequence[str], header: bool) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE")


def _place(df: DataFrame) -> DataFrame:
    """Add `_file`, `_block` and `_at`, which order the rows of a file as its lines."""
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                           "_at": F.monotonically_increasing_id()})


def _numbered(df: DataFrame, fields: Sequence[Column], seq: Column | None = None, part: Column | None = None,
              name: str = "row_seq") -> tuple[DataFrame, DataFrame]:
    """`fields` of every line with its 0-based number per file, or over all files of a `seq` in the order of `part` (else of their paths); and lines per file or `seq`.

    The files are parsed once, into a staged table. A task reads a block from its first line to its last, so the place of a line in its block is a
    difference of `_at`; only one row a block is added up, and no line is sorted or moved.
    """
    by = "_file" if seq is None else "seq"
    rows = stage(_place(df).select("_file", "_block", "_at", *fields), "lines")
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).withColumn(
        "_part", F.lit(0) if part is None else part)
    blocks = stage(blocks if seq is None else blocks.withColumn("seq", seq), "blocks")
    before = W.partitionBy(by).orderBy("_part", "_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", *(["seq"] if seq is not None else []),
                           (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    numbered = join_key_stats(rows, starts, ["_file", "_block"]).withColumn(name, (F.col("_start") + F.col("_at")).cast("long"))
    return numbered.drop("_block", "_at", "_start"), blocks.groupBy(by).agg(F.sum("n").alias("n"))


def _whole(text: Column) -> Column:
    """Whole numbers keep all their digits; texts like `5.0` go through a double."""
    return F.coalesce(text.try_cast("long"), number(text).cast("long"))


def _ticks(text: Column) -> Column:
    return F.rint(number(text) * TICKS_PER_UNIT).cast("long")


def read_posts(spark: SparkSession, path, trade_date: int, stocks: Sequence[str] | None = None) -> DataFrame:
    """Order posts by position, header line dropped; prices as ticks, NULL where not a number."""
    raw = _text_csv(spark, path, POST_FIELDS, True).withColumn("security_id", norm_security(F.col("SecurityID")))
    raw = raw.filter(F.col("security_id").isin(*stocks)) if stocks else raw
    return raw.select(
        F.lit(trade_date).cast("long").alias("trade_date"), "security_id", _whole(F.col("ChannelNo")).alias("channel_no"),
        _whole(F.col("ApplSeqNum")).alias("appl_seq_num"), _ticks(F.col("Price")).alias("price_tick"),
        _whole(F.col("OrderQty")).alias("order_qty"), _whole(F.col("Side")).alias("side"), _whole(F.col("OrdType")).alias("ord_type"),
        clock_ms(F.col("TransactTime")).alias("t_ms"))


def read_transactions(spark: SparkSession, path, trade_date: int, stocks: Sequence[str] | None = None) -> DataFrame:
    """Cancels and trades by position; `txn_seq` keeps the feed order of equal keys."""
    raw = _text_csv(spark, path, TXN_FIELDS, True).withColumn("security_id", norm_security(F.col("SecurityID")))
    raw = raw.filter(F.col("security_id").isin(*stocks)) if stocks else raw
    rows = raw.select(
        F.lit(trade_date).cast("long").alias("trade_date"), "security_id", _whole(F.col("ChannelNo")).alias("channel_no"),
        _whole(F.col("BidApplSeqNum")).alias("bid_seq"), _whole(F.col("OfferApplSeqNum")).alias("offer_seq"),
        _whole(F.col("LastQty")).alias("last_qty"), _whole(F.col("ExecType")).alias("exec_type"), clock_ms(F.col("TransactTime")).alias("t_ms"),
        _whole(F.col("ApplSeqNum")).alias("txn_seq"))
    return rows.filter(F.col("exec_type").isin(EXEC_CANCEL, EXEC_TRADE))


def header_fields(spark: SparkSession, path) -> list[str]:
    """Column names in the first line of a CSV file (one line reaches the driver)."""
    return [h.strip() for h in spark.read.text(path).first()[0].split(",")]


def read_snapshots(spark: SparkSession, path, trade_date: int, levels: int = 10, stocks: Sequence[str] | None = None) -> DataFrame:
    """Depth snapshots; the header may lack the name of a last field. Rows need both best prices and a clock.

    Adds the mid price in CNY; level prices stay in CNY, `feed_seq` orders rows as in the file.
    """
    names = [*header_fields(spark, path), "_extra"]
    needed = ["UpdateTime", "SecurityID", *[f"{n}{i}" for _, n in LEVEL_FIELDS for i in range(1, levels + 1)]]
    missing = [c for c in needed if c not in names]
    if missing:
        raise ValueError(f"snapshot columns missing: {missing[:10]}")
    raw = _place(_text_csv(spark, path, names, True)).withColumn("security_id", norm_security(F.col("SecurityID")))
    raw = raw.filter(F.col("security_id").isin(*stocks)) if stocks else raw
    book = F.array(*[F.struct(*[number(F.col(f"{n}{i}")).alias(f) for f, n in LEVEL_FIELDS]) for i in range(1, levels + 1)])
    rows = raw.filter(F.length("UpdateTime") >= 8).select(
        F.lit(trade_date).cast("long").alias("trade_date"), "security_id", clock_ms(F.col("UpdateTime")).alias("t_ms"),
        F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_at").alias("at")).alias("feed_seq"), book.alias("levels"))
    top = F.col("levels")[0]
    return rows.filter(F.col("t_ms").isNotNull() & top["bid_p"].isNotNull() & top["ask_p"].isNotNull()).withColumn(
        "mid_price", (top["ask_p"] + top["bid_p"]) / 2)


def touch_ticks(snaps: DataFrame) -> DataFrame:
    """Snapshots as the flow build takes them: best prices in ticks and a feed position."""
    top = F.col("levels")[0]
    tick = lambda p: F.rint(p * TICKS_PER_UNIT).cast("long")
    return snaps.select("trade_date", "security_id", "t_ms", F.col("feed_seq").alias("snap_seq"), tick(top["bid_p"]).alias("bid1"), tick(top["ask_p"]).alias("ask1"))


def read_liquidity_mask(spark: SparkSession, path, day: int) -> DataFrame:
    """Mask of one day, wide to long; the unnamed first column is the day."""
    wide = spark.read.csv(path, header=True)
    first = wide.columns[0]
    named = wide.select(F.col(f"`{first}`").cast("long").alias("trade_date"), *[
        F.col(f"`{c}`").try_cast("double").cast("long").alias(c) for c in wide.columns[1:]])
    return unpivot_mask(named, "trade_date", day)


# Tapes ------------------------------------------------------------------------------------------------------

def clean_time(text: Column) -> Column:
    """Seconds since midnight as an exact decimal: stray characters and all dots but the last are removed."""
    digits = F.regexp_replace(text, r"[^0-9,.]", "")
    return F.regexp_replace(digits, r"\.(?=.*\.)", "").try_cast("decimal(20,9)")


def read_messages(spark: SparkSession, path, date: str | None = None, *, seq: Column | None = None, part: Column | None = None) -> DataFrame:
    """Messages of headerless CSV files. Rows with an unparsable number are dropped after line numbers are given.

    The date is taken from the second part of the file name unless given. `row_seq` counts the lines of a file; or, with `seq` (a name made from
    `_file`), those of all files of that name, in the order of `part`.
    """
    return _messages(spark, path, date, seq, part)[0]


def _messages(spark: SparkSession, path, date: str | None, seq: Column | None, part: Column | None) -> tuple[DataFrame, DataFrame]:
    """Messages, and lines per file or sequence before any was dropped."""
    day = F.lit(date) if date else F.get(F.split(file_name(F.col("_file")), "_"), F.lit(1))
    seconds = clean_time(F.col("time"))
    day_ns = F.datediff(F.to_date(day), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000_000
    ints = ("event_type", "order_id", "size", "price", "direction")
    fields = [(day_ns + (seconds * 1_000_000_000).cast("long")).alias("t_ns"), *[_whole(F.col(c)).alias(c) for c in ints]]
    rows, sizes = _numbered(_text_csv(spark, path, MESSAGE_FIELDS, False), fields, seq, part)
    rows = rows.select(*(["_file"] if seq is None else ["seq"]), "row_seq", "t_ns", *ints)
    for c in ("t_ns", *ints):
        rows = rows.filter(F.col(c).isNotNull())
    return rows, sizes


def read_book(spark: SparkSession, path, levels: int = 10, *, seq: Column | None = None, part: Column | None = None) -> DataFrame:
    """Books of headerless CSV files, four columns a level; sentinels of absent levels become NULL. Numbered as `read_messages` does."""
    return _books(spark, path, levels, seq, part)[0]


def _books(spark: SparkSession, path, levels: int, seq: Column | None, part: Column | None) -> tuple[DataFrame, DataFrame]:
    """Books, and lines per file or sequence."""
    names = [f"{f}_{i}" for i in range(1, levels + 1) for f in ("ask_p", "ask_v", "bid_p", "bid_v")]
    # One conversion over all fields instead of one a field: the code of so many does not fit a method that is compiled.
    text = _text_csv(spark, path, names, False).withColumn("_v", F.transform(F.array(*names), _whole))
    far = lambda i: F.when(F.abs(F.col("_v")[i]) < 9_999_999_999, F.col("_v")[i])
    book = F.array(*[F.struct(far(i).alias("ask_p"), F.col("_v")[i + 1].alias("ask_v"), far(i + 2).alias("bid_p"), F.col("_v")[i + 3].alias("bid_v"))
                     for i in range(0, 4 * levels, 4)])
    rows, sizes = _numbered(text, [book.alias("levels")], seq, part)
    return rows.select(*(["_file"] if seq is None else ["seq"]), "row_seq", "levels"), sizes


def file_name(path: Column) -> Column:
    """Last part of a path; a table written by Spark is a folder of part files, and counts under the name of the folder."""
    return F.element_at(F.split(F.regexp_replace(path, r"/part-[^/]*$", ""), "/"), -1)


def pair_key(path: Column) -> Column:
    """File name without the part that tells messages from books."""
    return F.regexp_replace(file_name(path), "message|orderbook", "")


def _check_lengths(messages: DataFrame, books: DataFrame, book_required: bool) -> None:
    """Fails on a sequence whose message and book files differ in lines (seq, n); `books` may lack a whole sequence unless it is required."""
    sizes = messages.withColumnRenamed("n", "n_m").join(books.withColumnRenamed("n", "n_b"), "seq", "full")
    differ = ~F.col("n_m").eqNullSafe(F.col("n_b"))
    odd = sizes.filter(differ if book_required else differ & F.col("n_b").isNotNull()).first()
    if odd is not None:
        raise ValueError(f"row counts differ for {odd['seq']}: {odd['n_m']} messages, {odd['n_b']} books")


def read_tape(spark: SparkSession, messages, books, levels: int = 10, strict: bool = True, *, date: str | None = None,
              seq: Column | None = None, part: Column | None = None) -> DataFrame:
    """Message and book files joined line by line, with a dense `row_seq` per `seq` (by default the file name without message or orderbook).

    `strict` compares the line counts of each pair first and fails where they differ.
    """
    key = pair_key(F.col("_file")) if seq is None else seq
    msg, msg_lines = _messages(spark, messages, date, key, part)
    book, book_lines = _books(spark, books, levels, key, part)
    if strict:
        _check_lengths(msg_lines, book_lines, True)
    joined = msg.join(book, ["seq", "row_seq"]).withColumnRenamed("row_seq", "_line")
    return dense_index(joined, ["seq"], ["_line"], chunk_of("_line")).drop("_line")


PAIR_FIELDS = SEQUENCE_KEYS[:3]


def _pair_fields(name: Column) -> list[Column]:
    """Date, real_id and gen_id (empty for real and conditional files) in a file name."""
    return [F.get(F.split(name, "_"), F.lit(1)).alias("date"), F.regexp_extract(name, r"real_id_([^_.]+)", 1).alias("real_id"),
            F.regexp_extract(name, r"gen_id_([^_.]+)", 1).alias("gen_id")]


def read_catalogue(spark: SparkSession, real: str, generated: str, conditional: str | None = None) -> DataFrame:
    """Which files belong together: date, real_id, role, gen_id, message and book path.

    Names are `..._<date>_..._real_id_<i>[_gen_id_<j>].csv`. Two conditional files of one pair are an error; a
    real sequence without generated ones is a warning.
    """
    def listing(folder: str, role: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
        # A table written by Spark is a folder of part files under the name.
        named = files.select(F.regexp_replace("path", r"/part-[^/]*$", "").alias("path")).distinct()
        name = file_name(F.col("path"))
        parsed = named.filter(name.endswith(".csv")).select("path", *_pair_fields(name), F.when(
            name.contains("orderbook"), "book").when(name.contains("message"), "message").alias("what")).filter("what IS NOT NULL")
        if role != "generated":
            parsed = parsed.filter("gen_id = ''")
        pick = lambda what: F.max(F.when(F.col("what") == what, F.col("path")))
        n = lambda what: F.sum((F.col("what") == what).cast("int"))
        return parsed.groupBy("date", "real_id", "gen_id").agg(
            pick("message").alias("message_path"), pick("book").alias("book_path"), F.greatest(n("message"), n("book")).alias("copies")).withColumn("role", F.lit(role))

    reals, gens = listing(real, "real"), listing(generated, "generated")
    out = reals.unionByName(gens.join(reals.select("date", "real_id"), ["date", "real_id"], "left_semi"))
    if conditional:
        cond = listing(conditional, "conditional").join(reals.select("date", "real_id"), ["date", "real_id"], "left_semi")
        double = cond.filter("copies > 1").first()
        if double is not None:
            raise ValueError(f"several conditional files for real_id={double['real_id']}")
        out = out.unionByName(cond)
    lonely = reals.join(gens.select("date", "real_id"), ["date", "real_id"], "left_anti").count()
    if lonely:
        warnings.warn(f"{lonely} real sequences have no generated files")
    return out.drop("copies")


def load_catalogue(spark: SparkSession, real: str, generated: str, conditional: str | None = None, levels: int = 10, strict: bool = True) -> DataFrame:
    """All tapes of a catalogue in one table: date, real_id, gen_id, kind (real, generated, conditional), row_seq, messages and books.

    Every role is one scan of its message files and one of its book files, and one shuffle joins them; rows find their sequence by the path they came from, so any number of
    sequences costs the same. Files of a date and real_id without a real sequence are left out. A sequence without a book has NULL levels. `strict`
    fails where a pair of files differs in lines. Errors and warnings of `read_catalogue` apply.
    """
    listing = read_catalogue(spark, real, generated, conditional)
    roots = {"real": real, "generated": generated} | ({"conditional": conditional} if conditional else {})
    out = None
    for role, root in roots.items():
        known = F.broadcast(listing.filter(F.col("role") == role).select(*PAIR_FIELDS))  # one row a file, as many as Spark's own list of them
        key = F.to_json(F.struct(*_pair_fields(file_name(F.col("_file")))))
        paths = [f"{root.rstrip('/')}/*{what}*" for what in ("message", "orderbook")]
        msg, msg_lines = _messages(spark, paths[0], None, key, None)
        # Lines are dense unless some were dropped; messages are numbered anew before the wide books are joined to them.
        msg = msg.withColumnRenamed("row_seq", "_line")
        dropped = msg_lines.agg(F.sum("n")).first()[0] != msg.count()
        msg = dense_index(msg, ["seq"], ["_line"], chunk_of("_line")) if dropped else msg.withColumn("row_seq", F.col("_line"))
        if not listing.filter((F.col("role") == role) & F.col("book_path").isNotNull()).isEmpty():
            book, book_lines = _books(spark, paths[1], levels, key, None)
            if strict:
                _check_lengths(msg_lines, book_lines, False)
            joined = msg.join(book.withColumnRenamed("row_seq", "_line"), ["_line", "seq"], "left")  # the number first: it sorts faster than a name
        else:
            level = ", ".join(f"{c}: bigint" for c in ("ask_p", "ask_v", "bid_p", "bid_v"))
            joined = msg.withColumn("levels", F.lit(None).cast(f"array<struct<{level}>>"))
        fields = F.from_json("seq", ", ".join(f"{c} string" for c in PAIR_FIELDS))
        rows = joined.withColumn("_k", fields).select(*[F.col(f"_k.{c}").alias(c) for c in PAIR_FIELDS], F.lit(role).alias("kind"), *[c for c in joined.columns if c != "seq"])
        rows = rows.join(known, list(PAIR_FIELDS), "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out.drop("_line")


# Records and metrics ----------------------------------------------------------------------------------------

RECORD_KEYS = {"price": "price_mid_diff", "qty": "order_qty", "interval": "interval_ms"}
_BIN = "struct<bin_left: double, bin_right: double, total_count: bigint, n_unique: bigint, unique_values: array<double>, counts: array<bigint>, probs: array<double>>"
_FIELD = f"struct<field: string, num_bins: bigint, bins: array<double>, unit: string, bin_value_distributions: map<string, {_BIN}>>"
RECORD_SCHEMA = ", ".join(f"{k} {_FIELD}" for k in RECORD_KEYS.values())


def load_bins(spark: SparkSession, path: str) -> tuple[dict[str, list[float]], DataFrame]:
    """Edges per field and the table of bin values (field, bin, value, count, prob) of a JSON bin record."""
    record = spark.read.json(path, schema=RECORD_SCHEMA, multiLine=True)
    heads = record.select(*[F.struct(F.col(f"{k}.bins").alias("bins"), F.col(f"{k}.bin_value_distributions").isNotNull().alias("has")).alias(k)
                            for k in RECORD_KEYS.values()]).first()
    for key in RECORD_KEYS.values():
        if heads is None or heads[key]["bins"] is None or not heads[key]["has"]:
            raise ValueError(f"bin record lacks {key}.bins or {key}.bin_value_distributions")
    edges = {name: list(heads[key]["bins"]) for name, key in RECORD_KEYS.items()}
    values = None
    for name, key in RECORD_KEYS.items():
        rows = record.select(F.explode(F.col(f"{key}.bin_value_distributions")).alias("bin", "d")).select(
            F.lit(name).alias("field"), F.col("bin").cast("int").alias("bin"), F.inline(F.arrays_zip(
                F.col("d.unique_values").alias("value"), F.col("d.counts").alias("count"), F.col("d.probs").alias("prob"))))
        values = rows if values is None else values.unionByName(rows)
    return edges, values


def load_bin_tables(spark: SparkSession, path: str) -> tuple[dict[str, list[float]], DataFrame]:
    """As `load_bins`, from the tables that `save_bins` writes beside the record; one row a field reaches the driver."""
    edges = {r["field"]: list(r["edges"]) for r in spark.read.parquet(f"{path}/bin_edges").collect()}
    missing = [f for f in RECORD_KEYS if f not in edges]
    if missing:
        raise ValueError(f"bin edges lack {missing}")
    return edges, spark.read.parquet(f"{path}/bin_values").select("field", F.col("bin").cast("int").alias("bin"), "value", "count", "prob")


METRIC_SCHEMA = ("reference_comparison struct<metrics: map<string, struct<n_real: bigint, n_generated: bigint, wasserstein: double, "
                 "l1_by_group: double, weighted_wasserstein: double, num_condition_groups: bigint>>>")


def read_metrics(spark: SparkSession, paths) -> DataFrame:
    """Metrics summaries as rows (path, modified, metric, ...); NaN and infinities are accepted."""
    files = spark.read.json(paths, schema=METRIC_SCHEMA, multiLine=True, allowNonNumericNumbers=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
                        F.explode("reference_comparison.metrics").alias("metric", "m")).select("path", "modified", "metric", "m.*")
