"""Operator 9 on corpora that need many automata: results, and how their work grows."""

import hashlib
import random
import types

import ahocorasick
import pytest
from pyspark.sql import functions as F
from test_dedup import corpus, direct_passages, frame, same

from bookflow.llm import phrases, repeats


@pytest.mark.parametrize("size,per_shard,slice_", [(8, 400_000, 900), (8, 7, 900), (50, 400_000, 3000)])
def test_passages_of_many_slices(spark, monkeypatch, size, per_shard, slice_):
    monkeypatch.setattr(phrases, "SLICE", slice_, raising=False)
    rows = corpus(size + 2)
    got = phrases.remove_passages(frame(spark, rows), size, per_shard)
    found = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()]
    assert same(found, direct_passages(rows, size))


def work_of_automata(spark, monkeypatch, n, coalesce="false"):
    """Phrases compiled and letters read in the first round of n groups of documents with words of their own, and the letters of the documents."""
    rng, rows = random.Random(5), []
    for g in range(n):
        shared = [f"g{g}w{rng.randrange(500)}" for _ in range(300)]
        for k in range(4):
            rows.append((len(rows), " ".join(f"g{g}d{k}o{rng.randrange(500)}" for _ in range(200)) + " " + " ".join(shared)))
    rounds, frames = [], type(spark.range(0))
    made = frames.mapInArrow

    def recorded(df, run, schema, *more):
        if run.__qualname__.startswith("first_round"):
            rounds.append((df, run))
        return made(df, run, schema, *more)

    with monkeypatch.context() as m:
        m.setattr(phrases, "SLICE", 50_000, raising=False)
        m.setattr(frames, "mapInArrow", recorded)
        phrases.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10, 1000)
        [(df, run)] = rounds
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            table = df.withColumn("_task", F.spark_partition_id()).toArrow().combine_chunks()
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        compiled, read = [], []

        class Counted:
            def __init__(self, *kind):
                self.machine = ahocorasick.Automaton(*kind)
                self.get, self.make_automaton = self.machine.get, self.machine.make_automaton

            def add_word(self, *word):
                compiled.append(1)
                return self.machine.add_word(*word)

            def iter(self, codes, begin, end):
                read.append(end - begin)
                return self.machine.iter(codes, begin, end)

        m.setattr(phrases, "ahocorasick", types.SimpleNamespace(Automaton=Counted, STORE_LENGTH=ahocorasick.STORE_LENGTH))
        m.setattr("bookflow.llm.repeats.PART", 10_000)
        for task in sorted(set(table.column("_task").to_pylist())):
            phrases._automata.clear()
            mine = [k for k, t in enumerate(table.column("_task").to_pylist()) if t == task]
            assert sum(b.num_rows for b in run(iter(table.take(mine).drop_columns("_task").combine_chunks().to_batches())))
        phrases._automata.clear()
    return len(compiled), sum(read), sum(phrases.LETTERS * len(t.split()) for _, t in rows)


def test_automata_work_grows_with_the_corpus(spark, monkeypatch):
    """Each document is read once, and a phrase compiled once for each document that holds it at most, however many automata there are."""
    for n in (5, 40):
        compiled, read, letters = work_of_automata(spark, monkeypatch, n)
        assert n * 30 < compiled < n * 4 * 200 and read == letters


def test_a_task_of_many_slices_compiles_each_once(spark, monkeypatch):
    """Adaptive execution reads small partitions in one task."""
    apart, together = (work_of_automata(spark, monkeypatch, 40, coalesce) for coalesce in ("false", "true"))
    assert apart == together


@pytest.mark.parametrize("key,value", [("shuffle.partitions", "3"), ("adaptive.coalescePartitions.initialPartitionNum", "7"), ("adaptive.enabled", "false")])
def test_a_slice_lies_in_one_partition(spark, monkeypatch, key, value):
    monkeypatch.setattr(phrases, "SLICE", 2000)
    before = spark.conf.get(f"spark.sql.{key}", None)
    spark.conf.set(f"spark.sql.{key}", value)
    try:
        named = repeats.named(frame(spark, corpus(4)).select("doc_id", "text"))
        of = repeats.dealt(named).withColumn("_s", phrases.slices(named)).select("_s", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset(f"spark.sql.{key}") if before is None else spark.conf.set(f"spark.sql.{key}", before)
    assert len({r._s for r in of}) == len({(r._s, r.p) for r in of}) > 7
