"""Writers of tapes, flows, bin records and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookflow.functions import MISSING_LEVEL
from bookflow.operators.filters import cut_to_level
from bookflow.operators.flow import BY as FLOW_BY, flow_report
from bookflow.operators.ordered import chunk_of
from bookflow.session import stage
from bookflow.sources.readers import RECORD_KEYS, read_tape


def flat_book(levels: int, book: str = "levels") -> list[Column]:
    """Flat level columns with the far sentinels for absent levels."""
    out = []
    for i in range(levels):
        lv = F.get(book, F.lit(i))
        for side, far in (("ask", MISSING_LEVEL), ("bid", -MISSING_LEVEL)):
            out.append(F.coalesce(lv[f"{side}_p"], F.lit(far)).alias(f"{side}_p_{i + 1}"))
            out.append(F.coalesce(lv[f"{side}_v"], F.lit(0)).alias(f"{side}_v_{i + 1}"))
    return out


def write_lobster(tape: DataFrame, path: str, seq: Column, levels: int = 10, overwrite: bool = False) -> None:
    """Headerless message and book CSVs, line i of one belonging to line i of the other.

    A sequence becomes one file per chunk of rows: `message/seq=<name>/chunk=<n>` and `orderbook/...`, so a long
    sequence is written by many tasks and its lines stay in order.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    rows = tape.withColumns({"seq": seq, "chunk": chunk_of("row_seq")}).repartition("seq", "chunk").sortWithinPartitions("seq", "chunk", "row_seq")
    message = rows.select("seq", "chunk", _seconds().alias("time"), "event_type", "order_id", "size", "price", "direction")
    message.write.mode(mode).partitionBy("seq", "chunk").csv(f"{path}/message")
    rows.select("seq", "chunk", *flat_book(levels)).write.mode(mode).partitionBy("seq", "chunk").csv(f"{path}/orderbook")


def lobster_files() -> dict[str, Column]:
    """The sequence of a file written by `write_lobster`, and its place in it, for the readers."""
    return {"seq": F.regexp_extract("_file", r"seq=([^/]+)/", 1), "part": F.regexp_extract("_file", r"chunk=(\d+)/", 1).cast("long")}


def read_lobster(spark, path: str, date: str, levels: int = 10) -> DataFrame:
    """Tape written by `write_lobster`: chunks in order, lines in order inside a chunk."""
    return read_tape(spark, f"{path}/message", f"{path}/orderbook", levels, False, date=date, **lobster_files())


def _seconds() -> Column:
    """Time of day with nine digits after the point."""
    return F.format_string("%d.%09d", F.floor(F.col("t_ns") % 86_400_000_000_000 / 1_000_000_000), F.col("t_ns") % 1_000_000_000)


def write_catalogue(tape: DataFrame, path: str, levels: int = 10, mode: str = "errorifexists") -> None:
    """Sequences keyed date, real_id, gen_id, kind as folders `real`, `generated`, `conditional` of message and book files for `load_catalogue`.

    Ranges of (file, row) are written by one task each, so the parts of a long file lie in the order of their names. The rows are staged: each of
    the six writes samples them for its ranges and then reads them.
    """
    tape = stage(tape, "catalogue-rows")
    name = lambda what: F.concat(F.lit("X_"), "date", F.lit(f"_{what}_real_id_"), "real_id", F.when(F.col("gen_id") != "", F.concat(F.lit("_gen_id_"), "gen_id")).otherwise(""), F.lit(".csv"))
    message = (_seconds().alias("time"), "event_type", "order_id", "size", "price", "direction")
    tasks = int(tape.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for kind in ("real", "generated", "conditional"):
        rows = tape.filter(F.col("kind") == kind)
        for what, cols in (("message", message), ("orderbook", flat_book(levels))):
            files = rows.select(name(what).alias("file"), "row_seq", *cols).repartitionByRange(tasks, "file", "row_seq").sortWithinPartitions("file", "row_seq").drop("row_seq")
            files.write.mode(mode).partitionBy("file").csv(f"{path}/{kind}/{what}")


def write_cut(tape: DataFrame, level: int, path: str, seq: Column, source: str | None = None, overwrite: bool = False) -> None:
    """Cut a tape to its first `level` levels and write it; writing over its source must be asked for."""
    if source is not None and source.rstrip("/") == path.rstrip("/") and not overwrite:
        raise ValueError("source and target are the same; set overwrite=True")
    write_lobster(cut_to_level(tape, level), path, seq, level, overwrite)


def write_flow(flow: DataFrame, path: str, meta: Mapping[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Flow as Parquet by day and security, and its counts as JSON next to it. A large security spans several files."""
    flow.withColumn("_chunk", chunk_of("row_seq")).repartition(*FLOW_BY, "_chunk").drop("_chunk").write.mode(mode).partitionBy(*FLOW_BY).parquet(f"{path}/flow")
    report = flow_report(flow)
    for key, value in (meta or {}).items():
        report = report.withColumn(key, F.lit(value))
    report.write.mode(mode).json(f"{path}/meta")


def write_state(tokens: DataFrame, path: str, edges: Sequence[float], by: Sequence[str], mode: str = "errorifexists") -> None:
    """Book-state tokens as Parquet by key, with row counts and volume edges as JSON next to it."""
    tokens.write.mode(mode).partitionBy(*by).parquet(f"{path}/state")
    tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "vol_edges", F.array(*[F.lit(float(e)) for e in edges])).write.mode(mode).json(f"{path}/meta")


def read_state(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Tokens and metadata written by `write_state`; fails where a key has other rows than its metadata says."""
    tokens, meta = spark.read.parquet(f"{path}/state"), spark.read.json(f"{path}/meta")
    by = [c for c in meta.columns if c not in ("n_rows", "vol_edges")]
    keyed = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(meta, by, "full")
    odd = keyed.filter(~F.col("_n").eqNullSafe(F.col("n_rows"))).first()
    if odd is not None:
        raise ValueError(f"{odd['n_rows']} rows in the metadata, {odd['_n']} in the table of {[odd[c] for c in by]}")
    return tokens, meta


def bin_record(edges: Mapping[str, Sequence[float]], distribution: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One row in the layout of a bin record: per field its edges and, per bin, the values found in it.

    A bin's value list is an array in that layout; the Parquet table of `save_bins` has no such limit.
    """
    spark = distribution.sparkSession
    per_bin = distribution.groupBy("field", "bin").agg(
        F.array_sort(F.collect_list(F.struct("value", "count", "prob"))).alias("_v"), F.sum("count").alias("total_count"))
    ends = spark.createDataFrame([(f, b, float(e[b]), float(e[b + 1])) for f, e in edges.items() for b in range(len(e) - 1)],
                                 "field string, bin int, bin_left double, bin_right double")
    empty = F.lit(None).cast("array<double>")
    rows = ends.join(per_bin.withColumn("bin", F.col("bin").cast("int")), ["field", "bin"], "left").withColumn("_e", F.struct(
        "bin_left", "bin_right", F.coalesce("total_count", F.lit(0)).alias("total_count"), F.coalesce(F.size("_v"), F.lit(0)).cast("long").alias("n_unique"),
        F.coalesce(F.transform("_v", lambda x: x["value"]), F.array().cast("array<double>"), empty).alias("unique_values"),
        F.coalesce(F.transform("_v", lambda x: x["count"]), F.array().cast("array<bigint>")).alias("counts"),
        F.coalesce(F.transform("_v", lambda x: x["prob"]), F.array().cast("array<double>")).alias("probs")))
    maps = rows.groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string").alias("k"), F.col("_e").alias("v"))))).alias("_m"))
    record = maps.groupBy().agg(*[F.first(F.when(F.col("field") == f, F.struct(
        F.lit(fields[f]).alias("field"), F.lit(len(e) - 1).alias("num_bins"), F.array(*[F.lit(float(x)) for x in e]).alias("bins"),
        F.col("_m").alias("bin_value_distributions"))), ignorenulls=True).alias(RECORD_KEYS[f]) for f, e in edges.items()])
    return record


def save_bins(edges: Mapping[str, Sequence[float]], distribution: DataFrame, fields: Mapping[str, str], path: str, mode: str = "errorifexists", record: bool = True) -> None:
    """Edges and bin values as Parquet, one row a field, bin and value; and, unless `record` is off, the JSON record.

    The record is one JSON object with all values of all bins, so it suits bins of few distinct values; the tables have no such limit.
    """
    distribution.sparkSession.createDataFrame([(f, [float(x) for x in e]) for f, e in edges.items()], "field string, edges array<double>").write.mode(mode).parquet(f"{path}/bin_edges")
    distribution.write.mode(mode).parquet(f"{path}/bin_values")
    if not record:
        return
    bin_record(edges, distribution, fields).coalesce(1).write.mode(mode).json(f"{path}/record")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Result table as csv, tsv, json or parquet."""
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if fmt == "tsv" else ",")
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
