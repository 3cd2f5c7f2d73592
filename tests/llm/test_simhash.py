"""Operator 12: fingerprints against the xxhash library, links against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bookflow.llm import queries, scan, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, fp int, component_id string, seg string"


def direct(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, bits=4):
    """Smallest id reachable, by all pairs, of (id, fingerprint)."""
    root = list(range(len(items)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= bits:
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(items):
        groups.setdefault(top(i), []).append(d)
    return [min((d for d in groups[top(i)] if d is not None), default=None) for i in range(len(items))]


def check(rows, want):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=repr)
    fps = [(d, direct(t)) for d, t in want]
    assert got == sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, classes(fps))), key=repr)


def test_whole_table(spark):
    docs = queries.table(spark, SF, "documents")
    check(queries.op12_simhash(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ab", "cd", "é", "x" * 40, "漢字", "İ"])
    data = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)]
    data += [(100, None), (101, ""), (102, " \n\t"), (103, "A  b\nC d"), (104, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (5, "zz"), (5, "zz"), (5, "yy xx"), (106, "w" * 5000), (107, "a\x1cb c")]
    df = spark.createDataFrame([(*r, 1, "c", "s") for r in data], SCHEMA).repartition(3)
    out = simhash.near_duplicates(df).withColumn("fingerprint", simhash.as_hex("fp"))
    check(out.collect(), data)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hash():
    rng = np.random.RandomState(0)
    data = rng.randint(0, 256, 5000).astype(np.uint8)
    start = rng.randint(0, 3000, 400)
    end = start + np.concatenate([np.arange(100), rng.randint(0, 2000, 300)])
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert simhash.xxh64(data, start, end).tolist() == want


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_pieces(limit, monkeypatch):
    rng = random.Random(limit)
    for n in (0, 1, 3, 4, 5, 200):
        text = "  ".join("w" * rng.randint(1, 9) + str(i) for i in range(n)).encode() + b" \n"
        whole = simhash.shingle_hashes([text], 4)[0].tolist()
        cut = [h for p in simhash.pieces(text, 4, limit) for h in simhash.shingle_hashes([p], 4)[0].tolist()]
        assert cut == whole
        monkeypatch.setattr(scan, "BLOCK", limit)
        assert simhash.fingerprints_of([b"a b", text, b""], 4).tolist() == [direct("a b"), direct(text.decode()), 0]
        monkeypatch.undo()


def test_long_text():
    text = " ".join(str(i * i % 9973) for i in range(4_000_000))
    assert len(text) > 18_000_000
    half = simhash.shingle_hashes([text.encode()[:900]], 4)[0]
    assert simhash.fingerprints_of([text.encode()], 4)[0] and len(half)


@pytest.mark.parametrize("checks,threshold", [(0, 1), (3, 1), (4, 1), (4, 0), (4, 2)])
def test_covering(checks, threshold):
    code, width, radius = simhash.Covering(16, checks, threshold), 16, 1 if checks else 0
    v = np.arange(2**width)
    home = code.home(v)
    assert (code.syndrome(home) == 0).all() and (np.bitwise_count(home ^ v) <= radius).all()
    words = v[code.syndrome(v) == 0]
    some = v[::977]
    which, anchor = code.near(some)
    want = {(i, int(c)) for i, x in enumerate(some) for c in words[np.bitwise_count(words ^ x) <= radius + threshold]}
    assert set(zip(which.tolist(), anchor.tolist())) == want and len(which) == len(want)


@pytest.mark.parametrize("checks,part", [(0, 1 << 14), (3, 1 << 14), (4, 1 << 14), (4, 7)])
def test_links(spark, checks, part, monkeypatch):
    rng = random.Random(checks + part)
    monkeypatch.setattr(simhash, "FLUSH", 500)
    monkeypatch.setattr(simhash, "TILE", 2048)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 2**64 - 1}
    for b in base:
        for _ in range(rng.choice([1, 3, 60])):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long").repartition(1 if part == 7 else 4)
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, 4, checks, simhash.WIDTHS, part).collect()]
    assert all(a != b for a, b in got)
    name = {f: i for i, f in enumerate(fps)}
    want = classes([(name[f], f) for f in fps])
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        x, y = top(name[a]), top(name[b])
        root[max(x, y)] = min(x, y)
    assert [top(i) for i in range(len(fps))] == want
    if part == 7:
        assert simhash.common_anchors(df, len(fps), 4, checks, simhash.WIDTHS, part).where("others > 1 and homes > 1").count() > 0


def test_compared(monkeypatch):
    rng = np.random.RandomState(5)
    monkeypatch.setattr(simhash, "TILE", 8192)
    fp, home, lead, want = [], [], [], set()
    for size in (1, 2, 5, 900, 30, 2):
        base = rng.randint(0, 2**62, dtype=np.int64)
        group = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.randint(0, 6))) for _ in range(size)], np.uint64).view(np.int64)
        own = np.sort(rng.rand(size) < 0.4)[::-1]
        lead.append(len(fp))
        want |= {frozenset((int(a), int(b))) for a in group[own] for b in group[~own] if a != b and bin(int(a ^ b) % 2**64).count("1") <= 4}
        fp += group.tolist()
        home += own.tolist()
    a, b = simhash.compared(np.array(fp), np.array(home), np.array(lead), 4)
    links = lambda pairs: sorted(zip(*(x.tolist() for x in simhash.forest(*(np.array(c, np.uint64) for c in zip(*pairs))))))
    assert links([(int(x), int(y)) for x, y in zip(a, b)]) == links([[v % 2**64 for v in p] for p in want])
