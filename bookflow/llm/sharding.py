"""Operator 6, sharding over fixed virtual slots, with DataFrame functions only.

Records are hashed into `n_slots` slots for good. Bytes and rows are summed per slot (one small row per slot, so at most `n_slots` rows
reach the driver), and a slot-to-shard map is planned from them, stored as one folder per version, and edited when shards are
added or grow apart: an edit moves as few slots as it can and touches no record of any other slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bookflow.session import stage

N_SLOTS = 4096
ROWS_PER_BUCKET = 200_000

SlotMap = dict[int, int]


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row. A null text has size 1 and crc 0, as an empty one.

    Rows equal in doc_id and text share a slot; rows that share one of the two only, nulls too, spread.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: summed before the shuffle, one row per slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def plan_map(sizes: dict[int, int], shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """A first map: slots by falling bytes, each to the shard with least bytes; empty slots go round."""
    load, out = [0] * shards, {}
    for slot in sorted(range(n_slots), key=lambda s: (-sizes.get(s, 0), s)):
        to = min(range(shards), key=lambda k: (load[k], k)) if sizes.get(slot) else slot % shards
        load[to] += sizes.get(slot, 0)
        out[slot] = to
    return out


def edit_map(old: SlotMap, sizes: dict[int, int], shards: int, slack: float = 0.005) -> SlotMap:
    """The map for `shards` shards: slots leave a shard only while it holds more than the mean plus `slack`, and go to the emptiest, only to added shards where there are any; slots of shards that no longer exist go too."""
    new = dict(old)
    load = [0] * shards
    homeless = sorted((s for s, k in old.items() if k >= shards), key=lambda s: (-sizes.get(s, 0), s))
    for slot, k in old.items():
        if k < shards:
            load[k] += sizes.get(slot, 0)
    for slot in homeless:
        to = min(range(shards), key=lambda k: (load[k], k))
        new[slot], load[to] = to, load[to] + sizes.get(slot, 0)
    limit = sum(load) / shards * (1 + slack)
    added = [k for k in range(shards) if k not in old.values()] or list(range(shards))
    for k in range(shards):
        for slot in sorted((s for s in new if new[s] == k), key=lambda s: (-sizes.get(s, 0), s)):
            to, size = min(added, key=lambda j: (load[j], j)), sizes.get(slot, 0)
            if k != to and load[k] > limit and size and load[to] + size <= limit:
                new[slot], load[to], load[k] = to, load[to] + size, load[k] - size
    return new


def save_map(spark: SparkSession, slots: SlotMap, path: str, version: int) -> None:
    """Store a version; versions are never overwritten."""
    spark.createDataFrame(sorted(slots.items()), "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame, rows_per_slot: DataFrame, most: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds shard and `slot`, the place in the shard: 0, 1, 2, ... without gaps, ordered by (bucket, doc_id, text_crc32, size).

    Rows are numbered in buckets of a virtual slot, of about `most` rows each, and buckets get offsets from their counts. Rows equal in
    all columns of the order are interchangeable. slot_map has one row per slot and is broadcast.
    """
    share = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(most))).cast("long").alias("_n")
    slots = slot_map.join(F.broadcast(rows_per_slot.select("virtual_slot", share)), "virtual_slot")
    rows = rows.join(F.broadcast(slots), "virtual_slot").withColumn("_b", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), "_n"))
    counts = rows.groupBy("shard", "virtual_slot", "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy("shard").orderBy("virtual_slot", "_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("virtual_slot", "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    number = F.row_number().over(W.partitionBy("virtual_slot", "_b").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("_r", number).join(offsets, ["virtual_slot", "_b"])
        .withColumn("slot", (F.col("_o") + F.col("_r")).cast("long")).drop("_o", "_r", "_b", "_n")
    )


def shard(docs: DataFrame, path: str, shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot; version 1 of the map is stored under `path`.

    Shards get nearly equal bytes, as far as single slots allow: a slot that alone outweighs a shard's share (one huge text, or one
    row repeated very often) stays whole. An empty table gives no rows and a map of empty slots.
    """
    spark = docs.sparkSession
    rows = stage(records(docs, n_slots), "shard-records")
    per_slot = stage(slot_bytes(rows), "shard-slots")
    sizes = {r["virtual_slot"]: r["bytes"] for r in per_slot.collect()}  # at most n_slots rows
    save_map(spark, plan_map(sizes, shards, n_slots), path, 1)
    return place(rows, read_map(spark, path, 1), per_slot)
