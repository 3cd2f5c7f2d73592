"""Tumbling interval measures on a live tape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bookflow.operators.micro import EXECUTION


def stream_interval(tape: DataFrame, every: str, lateness: str, value: str = "mid", by: Sequence[str] = ("run_id", "kind"),
                    ts: str = "ts") -> DataFrame:
    """Mean of `value`, executed volume and row count per interval (closed left, labelled by its end).

    Rows older than the watermark are dropped and intervals without rows are not emitted. Works on a
    streaming or a static tape; on a static one the watermark has no effect.
    """
    timed = tape.withWatermark(ts, lateness)
    done = F.sum(F.when(F.col("event_type") == EXECUTION, F.col("size")).otherwise(0))
    return timed.groupBy(*by, F.window(ts, every).alias("_w")).agg(
        F.avg(value).alias("mean"), done.alias("executed_volume"), F.count(F.lit(1)).alias("n")).select(
            *by, F.col("_w.end").alias("label"), "mean", "executed_volume", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what the source holds now, append closed intervals to a Parquet table and return it."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
