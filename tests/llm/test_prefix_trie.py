"""Operator 13 against a direct trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, c int, n_convs string, chunk int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def direct(data):
    convs = {}
    for c, turn, role, text in data:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(rows, key=lambda r: r[:2])] for c, rows in convs.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, d == len(seq)))
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    total = {}
    for seq in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids.get(seq, [])]
        save = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        total[seq] = (sum(b[0] for b in below) or 1, save + sum(b[1] for b in below))
    least = {seq: min(c for c, _ in m) for seq, m in members.items()}
    return sorted((least[s], len(s), least[s[:-1]] if s else None, len(m), len(kids.get(s, [])), *total[s], hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest()) for s, m in members.items())


def rows_of(df):
    out = df.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))).select(*COLUMNS)
    return sorted(tuple(r) for r in out.collect())


def frame(spark, data):
    return spark.createDataFrame([(*r, "d", 1, "n", 2) for r in data], SCHEMA).repartition(3)


def made(seed, n, deep=0):
    rng = random.Random(seed)
    data = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hé", "ho", "what", ""])) for c in range(0, 2 * n, rng.choice([1, 2])) for t in range(rng.randint(0, 12)) if rng.random() < 0.9]
    data += [(4 * n, t, "user", f"x{t % 3}") for t in range(deep)]
    rng.shuffle(data)
    return data


def test_whole_table(spark):
    data = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_prefix_trie(spark, SF)
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == direct(data)


@pytest.mark.parametrize("seed,giant,per_task", [(1, 1 << 20, 1 << 15), (2, 30, 20), (3, 5, 3)])
def test_small_parts(spark, seed, giant, per_task):
    data = made(seed, 40, deep=150)
    assert rows_of(prefix_trie.prefix_trie(frame(spark, data), giant, per_task)) == direct(data)


def test_common_start(spark):
    data = [(c, t, "user", "hello" if t < 2 else str(c % 7)) for c in range(120) for t in range(4)]
    assert rows_of(prefix_trie.prefix_trie(frame(spark, data), per_task=16)) == direct(data)


def test_odd_rows(spark):
    data = [(0, None, None, "a"), (0, 1, "user", None), (7, 0, "u", "b"), (7, 1, "u", "b"), (None, 1, "u", "b"), (None, None, None, None), (11, 3, "", ""), (10, -5, "u", "z"), (10, 4, "u", "y"), (3, 2**40, "u", "x" * 100_000)]
    data += [(20, 1, "u", "same")] * 3 + [(21, 1, "u", "same")] * 12
    assert rows_of(prefix_trie.prefix_trie(frame(spark, data))) == direct(data)
    # turns of one number: any order of the rows gives the same
    tied = [(40, 1, "u", t) for t in "abcdefghij"]
    assert rows_of(prefix_trie.prefix_trie(frame(spark, tied))) == rows_of(prefix_trie.prefix_trie(frame(spark, tied[::-1])))


@pytest.mark.parametrize("data", [[], [(None, 1, "u", "t")]])
def test_no_conversation(spark, data):
    out = prefix_trie.prefix_trie(frame(spark, data))
    assert out.count() == 0 and out.columns == COLUMNS[:-1] + ["ends"]


def test_turnless(spark):
    # 1: h is crc32("1") % 9 > 0 and conversation 0 is absent, so its only turn goes
    assert zlib.crc32(b"1") % 9 > 0
    assert rows_of(prefix_trie.prefix_trie(frame(spark, [(1, 0, "u", "t")]))) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    ends = spark.range(5000).select(*[F.lit(1).cast("long").alias(k) for k in prefix_trie.KEY], F.col("id").alias("c")).repartition(5)
    row = prefix_trie.digests(ends).collect()
    assert [bytes(r.ends).hex() for r in row] == [hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()]


def test_follow():
    rng = np.random.RandomState(0)
    order = rng.permutation(200)
    step = np.full(200, -1)
    for k in range(199):
        if rng.rand() < 0.9:
            step[order[k]] = order[k + 1]
    w = rng.randint(0, 9, 200)
    last, (sums,) = prefix_trie.follow(step, [w])
    for i in range(200):
        j, s = i, w[i]
        while step[j] >= 0:
            j = step[j]
            s += w[j]
        assert last[i] == j and sums[i] == s


def test_jumps(spark):
    n = 37
    name = lambda i: (i * 7 % n, 0, False)
    data = [(name(i), name(i + 1) if i + 1 < n else None, i, 2 * i) for i in range(n)]
    arc = "struct<c:long,d:long,out:boolean>"
    got = {tuple(r.arc): (r.leaves, r.saved) for r in prefix_trie.ranked(spark.createDataFrame(data, f"arc {arc}, next {arc}, leaves long, saved long")).collect()}
    assert got == {name(i): (sum(range(i, n)), 2 * sum(range(i, n))) for i in range(n)}
