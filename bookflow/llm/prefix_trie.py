"""Operator 13, the trie of conversation prefixes, by an Euler tour.

1. Turns are hashed where they are read; texts are not shuffled. Running sums of hashes of (turn, position) name every prefix by 96 bits.
2. A node is named by (its smallest member, depth). Every node has an arc in and an arc out; siblings follow each other by id, and the tour goes from
   a node's way in to its first child, from its way out to its next sibling or to its parent's way out.
3. List ranking: nodes are dealt by ranges of (conversation, depth), so most arcs are followed by one of their own task; every task joins its arcs to
   sublists and sums along them. The sublists, far fewer, are ranked by pointer jumping, one join a round.
4. What lies in a subtree is the sum at its way in minus the sum at its way out.

No conversation, parent or node is gathered: long conversations and sibling lists go in chunks, ids that end at a node arrive as joined strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from bookflow.llm import scan
from bookflow.operators.ordered import running
from bookflow.session import stage

GROUP, REUSE = 5, 9
GIANT = 1 << 20  # turns of a conversation that are ordered in one task
NODES = 1 << 15  # nodes of a task of the tour
PIECE = 1 << 16  # characters of joined ids
KEY = ["depth", "a", "b", "g"]
NODE_TYPES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends binary"


def turns_of(conversations: DataFrame) -> DataFrame:
    """c, turn, ta, tb (hashes of role and text), bytes (of the text); rows without a conversation left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("ta"), F.xxhash64(F.lit("prefix"), text, role).alias("tb"), F.octet_length(text).cast("long").alias("bytes"))


def _chunked(turns: DataFrame, giant: int) -> DataFrame:
    """`turns` with a chunk number that rises with the order inside a conversation; only very long ones have more than one."""
    long_ = stage(turns.groupBy("c").count().where(F.col("count") > giant), "long-conversations")
    total = long_.agg(F.sum("count")).first()[0]
    if total is None:
        return turns.withColumn("chunk", F.lit(0))
    ids = F.broadcast(long_.select("c"))  # one row for each `giant` turns at most
    cut = turns.join(ids, "c", "left_semi").repartitionByRange(total // giant + 1, "c", "turn", "ta").withColumn("chunk", F.spark_partition_id())
    return turns.join(ids, "c", "left_anti").withColumn("chunk", F.lit(0)).unionByName(stage(cut, "long-turns"))


def rebuilt(conversations: DataFrame, giant: int = GIANT) -> tuple[DataFrame, DataFrame]:
    """Every conversation id (c), and the turns of the rebuilt conversations: c, chunk, depth (from 1), ta, tb, bytes.

    A rebuilt conversation c has the first h turns of conversation c - c % 5, then its own from the one after its first h; h is crc32(c) % 9.
    Turns are in the order of their number, null first; those of one number in the order of a hash of role and text.
    """
    turns = stage(turns_of(conversations), "turns")
    ids = stage(turns.select("c").distinct(), "conversations")
    h = F.crc32(F.col("c").cast("string")) % REUSE
    first = W.partitionBy("c").orderBy("turn", "ta", "tb")
    heads = turns.where(F.col("c") % GROUP == 0).withColumn("i", F.row_number().over(first)).where(F.col("i") < REUSE)
    shared = ids.select("c", (F.col("c") - F.col("c") % GROUP).alias("_b"), h.alias("_h")).join(heads.withColumnRenamed("c", "_b"), "_b").where("i <= _h")
    prefix = shared.select("c", F.lit(0).alias("own"), F.col("i").cast(turns.schema["turn"].dataType).alias("turn"), "ta", "tb", "bytes", F.lit(-1).alias("chunk"))
    both = prefix.unionByName(_chunked(turns, giant).withColumn("own", F.lit(1)))
    counted = running(both, ["c"], ["own", "turn", "ta", "tb"], F.col("chunk"), sums={"n_shared": 1 - F.col("own"), "n_own": F.col("own")})
    kept = counted.where((F.col("own") == 0) | (F.col("n_own") > h))
    depth = F.col("n_shared") + F.when(F.col("own") == 1, F.col("n_own") - h).otherwise(0)
    return ids, kept.select("c", "chunk", depth.cast("long").alias("depth"), "ta", "tb", "bytes")


def _lanes() -> dict[str, Column]:
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    fa, fb = F.xxhash64("ta", "depth"), F.xxhash64("tb", "depth")
    return {"a": low(fa), "b": F.shiftrightunsigned(fa, 32), "g": low(fb)}


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the name (a, b, g) of the prefix that ends with each turn, and that of the prefix before it (pa, pb, pg)."""
    marked = stage(turns.withColumns({f"_{n}": x for n, x in _lanes().items()}).drop("ta", "tb"), "rebuilt-turns")
    named = running(marked, ["c"], ["depth"], F.col("chunk"), sums={n: F.col(f"_{n}") for n in "abg"})
    return named.select("c", *KEY, "bytes", *[(F.col(n) - F.col(f"_{n}")).alias(f"p{n}") for n in "abg"])


def digests(ends: DataFrame) -> DataFrame:
    """KEY, ends: SHA-256 of the decimal ids c, ascending, joined by commas, of each key of `ends` (KEY, c; no id twice)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, size = None, [], 0

        def out():
            return pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.int64()) for k, v in zip(KEY, at)}, "c": pa.array([int(ids[0])], pa.int64()), "piece": [",".join(ids)]})

        for batch in batches:
            for *key, c in zip(*(batch.column(k).to_pylist() for k in KEY), batch.column("c").to_pylist()):
                if at is not None and (key != at or size > PIECE):
                    yield out()
                    ids, size = [], 0
                at = key
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        done: list[tuple] = []

        def out():
            cols = [pa.array([d[i] for d in done], pa.int64()) for i in range(len(KEY))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([d[-1] for d in done], pa.binary())], [*KEY, "ends"])

        for batch in batches:
            for *key, piece in zip(*(batch.column(k).to_pylist() for k in KEY), batch.column("piece").to_pylist()):
                if key == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        done.append((*at, sha.digest()))
                    at, sha = key, hashlib.sha256()
                sha.update(piece.encode())
            if len(done) > 4096:
                yield out()
                done.clear()
        if at is not None:
            done.append((*at, sha.digest()))
            yield out()

    types = ", ".join(f"{k} long" for k in KEY)
    # ids lie in disjoint ranges, so the pieces of a key follow each other by their first id
    made = ends.repartitionByRange("c").sortWithinPartitions(*KEY, "c").mapInArrow(join, f"{types}, c long, piece string")
    return made.repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(digest, f"{types}, ends binary")


def nodes(conversations: DataFrame, giant: int = GIANT) -> DataFrame:
    """One row for each node: the columns of NODE_TYPES, first_child (conv_id), saved (bytes that the node itself saves)."""
    ids, turns = rebuilt(conversations, giant)
    rows = stage(prefixes(turns), "prefixes")
    inner = rows.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), *[F.first(f"p{n}").alias(f"p{n}") for n in "abg"])
    zero = lambda name: F.lit(0).cast("long").alias(name)
    nothing = F.lit(None).cast("long")
    root = ids.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*map(zero, KEY), "conv_id", "n_convs", zero("bytes"), *[nothing.alias(f"p{n}") for n in "abg"])
    all_ = stage(inner.unionByName(root), "nodes")
    last = rows.groupBy("c").agg(F.max(F.struct(*KEY)).alias("k"))
    ends = ids.join(last, "c", "left").select("c", *[F.coalesce(F.col(f"k.{n}"), F.lit(0)).cast("long").alias(n) for n in KEY])
    of_parent = all_.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{n}").alias(n) for n in "abg"]).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    full = all_.join(of_parent, KEY, "left").join(digests(ends), KEY, "left")
    parents = all_.select((F.col("depth") + 1).alias("depth"), *[F.col(n).alias(f"p{n}") for n in "abg"], F.col("conv_id").alias("parent_conv_id"))
    named = full.join(parents, ["depth", "pa", "pb", "pg"], "left")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    return stage(named.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "ends", "first_child", saved.alias("saved")), "trie")


def with_siblings(trie: DataFrame, per_task: int) -> DataFrame:
    """Adds `sibling`: conv_id of the next child of the same parent, by id. Children of one parent are cut where ids cross common borders."""
    parts = min(max(trie.count() // per_task, 127), 1023)
    cuts = trie.approxQuantile("conv_id", [i / (parts + 1) for i in range(1, parts + 1)], 0.1 / (parts + 1))
    chunk = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x <= F.col("conv_id"))) if cuts else F.lit(0)
    below = running(trie.where("depth > 0"), ["depth", "parent_conv_id"], ["conv_id"], chunk, nexts={"sibling": F.col("conv_id")})
    return trie.where("depth = 0").withColumn("sibling", F.lit(None).cast("long")).unionByName(below)


def _ints(batch: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which are there."""
    col = batch.column(name)
    return col.fill_null(0).to_numpy(), ~col.is_null().to_numpy(zero_copy_only=False)


def follow(step: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of lists given by the next entry (-1: none): the last entry of each entry's list, and the sums from the entry to it."""
    last = np.arange(len(step))
    sums, step = [s.copy() for s in sums], step.copy()
    live = np.flatnonzero(step >= 0)
    while len(live):
        to = step[live]
        gained = [s[to] for s in sums]
        last[live] = last[to]
        for s, more in zip(sums, gained):
            s[live] += more
        step[live] = step[to]
        live = live[step[live] >= 0]
    return last, sums


def sublists(table: pa.Table) -> Iterator[pa.Table]:
    """The arcs of one task's nodes (sorted by conv_id, depth) as sublists.

    First the nodes: their columns, leaves and saved as far as the task knows them, and where its two sublists go on (entry and exit); then one row
    for each sublist: arc (its first), next (the arc after its last), leaves and saved.
    """
    conv, depth = table.column("conv_id").to_numpy(), table.column("depth").to_numpy()
    n = len(conv)
    parent, child, sib = (_ints(table, c) for c in ("parent_conv_id", "first_child", "sibling"))
    # the arc after each arc, by name: conv_id, depth, way out or not
    to_conv = np.concatenate([np.where(child[1], child[0], conv), np.where(sib[1], sib[0], parent[0])])
    to_depth = np.concatenate([depth + child[1], depth - ~sib[1]])
    to_out = np.concatenate([~child[1], ~sib[1]])
    exists = np.concatenate([np.ones(n, bool), sib[1] | parent[1]])
    # depths of one conversation follow each other without a gap
    lead = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    size = np.diff(np.append(lead, n))
    run = np.minimum(np.searchsorted(conv[lead], to_conv), len(lead) - 1)
    at = to_depth - depth[lead[run]]
    here = exists & (conv[lead[run]] == to_conv) & (at >= 0) & (at < size[run])
    step = np.where(here, lead[run] + at + n * to_out, -1)
    weight = [np.append(table.column("n_children").to_numpy() == 0, np.zeros(n, bool)).astype(np.int64), np.append(table.column("saved").to_numpy(), np.zeros(n, np.int64))]
    last, (leaves, saved) = follow(step, weight)

    def arcs(of: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(to_conv[of]), pa.array(to_depth[of]), pa.array(to_out[of])], ["c", "d", "out"], mask=pa.array(~there))

    same = last[:n] == last[n:]
    nothing = pa.nulls(n, pa.struct([("c", pa.int64()), ("d", pa.int64()), ("out", pa.bool_())]))
    cols = {f.split()[0]: table.column(f.split()[0]) for f in NODE_TYPES.split(", ")}
    yield pa.table({**cols, "leaves": leaves[:n] - leaves[n:], "saved": saved[:n] - saved[n:], "arc": nothing, "entry": arcs(last[:n], exists[last[:n]] & ~same), "exit": arcs(last[n:], exists[last[n:]] & ~same)})
    first = np.ones(2 * n, bool)
    first[step[step >= 0]] = False
    first = np.flatnonzero(first)
    k = len(first)
    names = pa.StructArray.from_arrays([pa.array(np.append(conv, conv)[first]), pa.array(np.append(depth, depth)[first]), pa.array(first >= n)], ["c", "d", "out"])
    yield pa.table({**{f.split()[0]: pa.nulls(k, pa.binary() if f.endswith("binary") else pa.int64()) for f in NODE_TYPES.split(", ")},
                    "leaves": leaves[first], "saved": saved[first], "arc": names, "entry": arcs(last[first], exists[last[first]]), "exit": pa.nulls(k, nothing.type)})


def ranked(lists: DataFrame) -> DataFrame:
    """arc, leaves, saved: sums from each sublist (arc, next, leaves, saved) to the end of the tour, by pointer jumping; rounds grow with the logarithm."""
    while not lists.where("next is not null").isEmpty():
        on = lists.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
        more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        lists = stage(lists.join(on, "next", "left").select("arc", F.col("_next").alias("next"), more("leaves"), more("saved")), "jumps")
    return lists.drop("next")


def prefix_trie(conversations: DataFrame, giant: int = GIANT, per_task: int = NODES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (SHA-256, binary) of every node.

    Input columns conv_id, turn, role, text; others are not read. A null role or text is empty; a null turn comes first; turns of one number go by
    a hash of role and text, so repeated rows are repeated turns; rows without conv_id belong to no conversation. A conversation whose rebuilt form
    has no turn ends at the root. An empty table has no node.
    """
    trie = with_siblings(nodes(conversations, giant), per_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about `per_task` nodes
        if held:
            for part in sublists(pa.Table.from_batches(held)):
                yield from part.to_batches()

    arc = "struct<c:long,d:long,out:boolean>"
    parts = trie.count() // per_task + 1
    toured = stage(trie.repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth").mapInArrow(run, f"{NODE_TYPES}, leaves long, saved long, arc {arc}, entry {arc}, exit {arc}"), "tour")
    rank = ranked(toured.where("arc is not null").select("arc", F.col("entry").alias("next"), "leaves", "saved"))
    side = lambda c: rank.select(F.col("arc").alias(c), F.col("leaves").alias(f"_l{c}"), F.col("saved").alias(f"_s{c}"))
    full = toured.where("arc is null").join(side("entry"), "entry", "left").join(side("exit"), "exit", "left")
    part = lambda c, k: F.col(c) + F.coalesce(f"_{k}entry", F.lit(0)) - F.coalesce(f"_{k}exit", F.lit(0))
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", part("leaves", "l").alias("n_leaves"), part("saved", "s").alias("saved_tokens"), "ends")
