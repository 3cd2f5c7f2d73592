"""Operator 12, SimHash near-duplicates by anchor points of a covering code.

A fingerprint is cut into three segments. Of two that differ in at most four bits, some segment differs in at most one. For each segment the
codewords of a linear code are anchors: a Hamming code on its first bits with the other bits left free, so that every value lies within one bit
(the covering radius) of exactly one codeword, its home. Fingerprints are sent to their home and to every anchor within the radius plus one bit;
two whose segments differ in one bit therefore meet at the home of either, and are compared there on all 64 bits. Equal fingerprints are one.

Links found in a task leave it as a forest, never as all pairs. Anchors with many fingerprints are dealt as a grid of parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bookflow.llm import components, scan
from bookflow.session import stage

# The primes of XXH64, and the seed of Spark's xxhash64.
PRIMES = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
SEED = 42
LONGEST = 1024  # bytes of a shingle that is hashed beside others
WIDTHS, CHECKS = (22, 21, 21), 4
PART = 1 << 14  # fingerprints of each side of a part of a common anchor
SHARE = 256
SPREAD = 20_000  # fingerprints that one task sends to their anchors
TILE = 1 << 20  # comparisons at a time
FLUSH = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * PRIMES[1], 31) * PRIMES[0]


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:end] for each range; those over LONGEST bytes one by one."""
    p1, p2, p3, p4, p5 = PRIMES
    n = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    at, h = start.copy(), np.full(len(n), np.uint64((seed + int(p5)) % 2**64))
    wide = np.flatnonzero((n >= 32) & (n <= LONGEST))
    if len(wide):
        lanes = [np.full(len(wide), np.uint64(v % 2**64)) for v in (seed + int(p1) + int(p2), seed + int(p2), seed, seed - int(p1))]
        live = np.arange(len(wide))
        while len(live):
            here = at[wide[live]]
            for k in range(4):
                lanes[k][live] = _round(lanes[k][live], eight[here + 8 * k])
            at[wide[live]] += 32
            live = live[at[wide[live]] + 32 <= end[wide[live]]]
        acc = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in lanes:
            acc = (acc ^ _round(np.zeros_like(lane), lane)) * p1 + p4
        h[wide] = acc
    h += n.astype(np.uint64)
    live = np.flatnonzero((n <= LONGEST) & (at + 8 <= end))
    while len(live):
        h[live] = _turn(h[live] ^ _round(np.zeros(len(live), np.uint64), eight[at[live]]), 27) * p1 + p4
        at[live] += 8
        live = live[at[live] + 8 <= end[live]]
    live = np.flatnonzero((n <= LONGEST) & (at + 4 <= end))
    h[live] = _turn(h[live] ^ (four[at[live]].astype(np.uint64) * p1), 23) * p2 + p3
    at[live] += 4
    live = np.flatnonzero((n <= LONGEST) & (at < end))
    while len(live):
        h[live] = _turn(h[live] ^ (data[at[live]].astype(np.uint64) * p5), 11) * p1
        at[live] += 1
        live = live[at[live] < end[live]]
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(n > LONGEST).tolist():
        h[i] = xxhash.xxh64_intdigest(padded[start[i] : end[i]], seed)
    return h


def pieces(text: bytes, k: int, limit: int) -> Iterator[bytes]:
    """`text` in pieces of about `limit` bytes that together have each of its k-word shingles once."""
    lo, carry, some = 0, b"", False
    while True:
        found = _SPACE.search(text, min(lo + limit, len(text)))
        hi = found.start() if found else len(text)
        piece = carry + b" " + text[lo:hi] if carry else text[lo:hi]
        tail = piece.rsplit(None, k)
        whole = len(tail) >= k
        if whole or (hi == len(text) and not some):
            yield piece
        if hi == len(text):
            return
        some |= whole
        carry = b" ".join(tail[len(tail) - k + 1 :]) if whole else b" ".join(tail)
        lo = hi


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, repeats included, words joined by one space, and the number of each text; a text of 1 to k - 1 words has one."""
    s = scan.Scan(texts, lower=True)
    keep = ~s.space
    keep[s.word_end] = True
    data = s.data[keep]
    data[s.space[keep]] = 0x20
    size = s.word_end - s.word_start
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    count = np.where(s.n_words > 0, np.maximum(s.n_words - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), count)
    first = scan.ragged(s.first_word[:-1], count)
    last = first + np.minimum(s.n_words, k)[doc] - 1
    return xxh64(data, start[first], end[last]), doc


@cache
def _spread() -> np.ndarray:
    """For each byte, a word whose bytes are its bits, the lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def bit_counts(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x 64: in how many hashes of each text each bit is set. `doc` is rising."""
    out = np.zeros((n, 64), np.int64)
    if not len(h):
        return out
    lead = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(lead, len(doc)))
    runs = -(-size // 255)  # a counter of eight bits holds 255
    run = np.repeat(lead, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    owner = np.repeat(doc[lead], runs)
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        sums = np.add.reduceat(_spread()[octets[:, j]], run).view(np.uint8).reshape(-1, 8)
        np.add.at(out[:, 8 * j : 8 * j + 8], owner, sums)
    return out


def fingerprints_of(texts: list[bytes], k: int) -> np.ndarray:
    """Bit i is set where it is set in over half of a text's hashes; a text without a word has 0."""
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    small = [t if len(t) <= scan.BLOCK else b"" for t in texts]
    parts = [(np.arange(len(texts)), small)] + [(np.array([i]), [p]) for i, t in enumerate(texts) if len(t) > scan.BLOCK for p in pieces(t, k, scan.BLOCK)]
    for owner, part in parts:
        h, doc = shingle_hashes(part, k)
        counts[owner] += bit_counts(h, doc, len(part))
        total[owner] += np.bincount(doc, minlength=len(part))
    bits = 2 * counts > total[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scan.signed(fingerprints_of(scan.texts(batch), k)))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Covering:
    """The Hamming code with `checks` check bits on the first bits of a segment, the other bits free; no checks: every value is an anchor.

    `near(v)`: number of each value and its anchors within the covering radius plus `threshold`; `home(v)`: the one within the radius.
    """

    def __init__(self, width: int, checks: int, threshold: int):
        tied = min(2**checks - 1, width) if checks else 0
        if checks and tied < 2**checks - 1:
            raise ValueError("a segment is too short for its code")
        column = [b + 1 if b < tied else 0 for b in range(width)]
        self.tables = []
        for octet in range(0, width, 8):
            t = np.zeros(256, np.int64)
            for b, c in enumerate(column[octet : octet + 8]):
                t ^= np.where(np.arange(256) >> b & 1, c, 0)
            self.tables.append(t)
        made: list[list[int]] = [[] for _ in range(2**checks)]
        for weight in range((1 if checks else 0) + threshold + 1):
            for flips in combinations(range(width), weight):
                s = 0
                for b in flips:
                    s ^= column[b]
                made[s].append(sum(1 << b for b in flips))
        self.count = np.array([len(m) for m in made])
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.array([p for m in made for p in m], np.int64)
        self.leader = np.array([0] + [1 << (s - 1) for s in range(1, 2**checks)], np.int64)

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        for i, t in enumerate(self.tables):
            out ^= t[v >> (8 * i) & 255]
        return out

    def home(self, v: np.ndarray) -> np.ndarray:
        return v ^ self.leader[self.syndrome(v)]

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.syndrome(v)
        n = self.count[s]
        return np.repeat(np.arange(len(v)), n), np.repeat(v, n) ^ self.flat[scan.ragged(self.start[s], n)]


def placements(fp: np.ndarray, bits: int, checks: int, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each segment: its number, which fingerprint, its anchor, and whether it is its home (such rows are extra)."""
    low = 0
    for seg, width in enumerate(widths):
        code = _code(width, checks, bits // len(widths))
        v = (fp.view(np.uint64) >> np.uint64(low) & np.uint64(2**width - 1)).astype(np.int64)
        which, anchor = code.near(v)
        yield seg, np.append(np.arange(len(v)), which), np.append(code.home(v), anchor), np.append(np.ones(len(v), bool), np.zeros(len(which), bool))
        low += width


_code = cache(Covering)


def common_anchors(fps: DataFrame, total: int, bits: int, checks: int, widths: tuple[int, ...], part: int) -> DataFrame:
    """seg, anchor, homes, others (numbers of parts) of anchors that need more than one part.

    Tasks report what a 256th of a batch shares; anchors below a 512th of all fingerprints are left whole, so the table is bounded by the code, and
    an anchor with a 128th of all or more is always in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for seg, which, anchor, home in placements(fp, bits, checks, widths):
                key, n = np.unique(anchor[~home], return_counts=True)
                own = np.bincount(np.searchsorted(key, anchor[home]), minlength=len(key))
                much = n >= max(16, len(fp) // SHARE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(much.sum(), seg, np.int32)), pa.array(key[much]), pa.array(n[much]), pa.array(own[much])], ["seg", "anchor", "n", "own"])

    found = fps.select("fp").mapInArrow(run, "seg int, anchor long, n long, own long").groupBy("seg", "anchor").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    least = max(part, total // (2 * SHARE))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / part)).cast("int")
    return found.where(F.col("n") > least).select("seg", "anchor", parts("own").alias("homes"), parts("n").alias("others"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values as links to the smallest value that each reaches."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def compared(fp: np.ndarray, home: np.ndarray, lead: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups (rows from lead[i] on, homes first) between homes and the others, as a forest."""
    fp = fp.view(np.uint64)
    size = np.diff(np.append(lead, len(fp)))
    own = np.add.reduceat(home.astype(np.int64), lead)
    rest = size - own
    us, vs = [], []
    few = np.flatnonzero((own * rest <= 4096) & (own > 0) & (rest > 0))
    # groups of few pairs together: every other row with each home of its group
    other = scan.ragged(lead[few] + own[few], rest[few])
    group = np.repeat(few, rest[few])
    step = max(1, TILE // 4096)
    cut = np.append(0, np.cumsum(own[group]))
    at = 0
    while at < len(other):
        to = max(at + step, int(np.searchsorted(cut, cut[at] + TILE, "right")) - 1)
        mine, g = other[at:to], group[at:to]
        a, b = fp[np.repeat(mine, own[g])], fp[scan.ragged(lead[g], own[g])]
        hit = _close(a, b, bits) & (a != b)
        us.append(a[hit])
        vs.append(b[hit])
        at = to
    for g in np.flatnonzero(own * rest > 4096).tolist():
        homes, others = fp[lead[g] : lead[g] + own[g]], fp[lead[g] + own[g] : lead[g] + size[g]]
        wide = min(len(homes), 512)
        for i in range(0, len(homes), wide):
            for j in range(0, len(others), TILE // wide):
                a, b = others[j : j + TILE // wide], homes[i : i + wide]
                x, y = np.nonzero(_close(a[:, None], b[None, :], bits))
                differ = a[x] != b[y]
                s, t = forest(a[x[differ]], b[y[differ]])
                us.append(s)
                vs.append(t)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def links(fps: DataFrame, bits: int = 4, checks: int = CHECKS, widths: tuple[int, ...] = WIDTHS, part: int = PART) -> DataFrame:
    """a, b: links between the distinct fingerprints `fp` that differ in at most `bits` bits, enough of them to connect all that are connected."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for seg, which, anchor, home in placements(fp, bits, checks, widths):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), seg, np.int32)), pa.array(anchor), pa.array(home), pa.array(fp[which])], ["seg", "anchor", "home", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(last: bool):
            key, home, fp = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            lead = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            stop = len(fp) if last or len(fp) - lead[-1] > FLUSH else lead[-1]
            if stop < len(fp):
                held.append((key[stop:], home[stop:], fp[stop:]))
            elif not last:  # one large group: what came so far is compared, its homes wait for more
                own = np.arange(lead[-1], len(fp))
                own = own[home[own]]
                held.append((key[own], home[own], fp[own]))
            if stop:
                a, b = compared(fp[:stop], home[:stop], lead[lead < stop], bits)
                return pa.RecordBatch.from_arrays([pa.array(scan.signed(a)), pa.array(scan.signed(b))], ["a", "b"])

        waiting = 0
        for batch in batches:
            held.append((np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "anchor", "i", "j")], 1), batch.column("home").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy()))
            waiting += batch.num_rows
            if waiting >= FLUSH:
                out = flush(False)
                waiting = 0
                if out is not None:
                    yield out
        if held and sum(len(h[2]) for h in held):
            yield flush(True)

    total = fps.count()
    many = common_anchors(fps, total, bits, checks, widths, part)
    rows = fps.select("fp").repartition(total // SPREAD + 1).mapInArrow(place, "seg int, anchor long, home boolean, fp long").join(F.broadcast(many), ["seg", "anchor"], "left").na.fill(1, ["homes", "others"])
    mine = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    along = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = F.when(F.col("home"), F.transform(along("others"), lambda j: F.struct(mine("homes").alias("i"), j.alias("j")))).otherwise(F.transform(along("homes"), lambda i: F.struct(i.alias("i"), mine("others").alias("j"))))
    dealt = rows.select("seg", "anchor", "home", "fp", F.explode(cell).alias("c")).select("seg", "anchor", "c.i", "c.j", "home", "fp")
    return dealt.repartition("seg", "anchor", "i", "j").sortWithinPartitions("seg", "anchor", "i", "j", F.desc("home")).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, checks: int = CHECKS, widths: tuple[int, ...] = WIDTHS, part: int = PART) -> DataFrame:
    """doc_id, fp (long), component_id of every row: the smallest doc_id reachable over links of at most `bits` differing bits, itself included.

    A text without a word, or null, has fingerprint 0 and links like any other. Rows that share an id are judged each by its own text. A null id is
    never the smallest of a class, unless the class has no other. An empty table gives no rows. Other columns are not read.
    """
    prof = stage(fingerprints(docs, k), "simhash")
    fps = stage(prof.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    joined = components.components(links(fps, bits, checks, widths, part)).select(F.col("node").alias("fp"), "root")
    classes = joined.join(fps, "fp").groupBy("root").agg(F.min("least").alias("_c"))
    named = stage(fps.join(joined.join(classes, "root").select("fp", "_c"), "fp", "left").select("fp", F.coalesce("_c", "least").alias("_c"), "n"), "named")
    # a fingerprint with a 1,000th of all rows: there are fewer than 1,000 of them, and their rows need no shuffle
    total = fps.agg(F.sum("n")).first()[0] or 0
    often = named.where(F.col("n") > total // 1000)
    marked = prof.join(F.broadcast(often.select("fp", "_c", F.lit(True).alias("_often"))), "fp", "left")
    rest = marked.where("_often is null").select("doc_id", "fp").join(named.select("fp", "_c"), "fp")
    return marked.where("_often").select("doc_id", "fp", "_c").unionByName(rest.select("doc_id", "fp", "_c")).select("doc_id", "fp", F.coalesce("_c", "doc_id").alias("component_id"))


def as_hex(fp: str):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
