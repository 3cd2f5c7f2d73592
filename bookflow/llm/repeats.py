"""Windows of a fixed number of symbols that repeat, over all texts: sparse prefix doubling.

Symbols are the bytes or the words of a text. Every window is represented by an anchor: of all strings of `length` symbols in it the one
with the smallest hash, the leftmost if tied, so equal windows have equal anchors at equal places. Consecutive windows with one
anchor make a block, and a row of block ranks stands for some 30 windows:

    a  rank of the anchor (length symbols)       k  rank of the whole block       d, t, p  position    n  windows

Each round shuffles the rows by a and lets Spark sort them by (a, k, position). A rank that no other position has retires; equal pairs
(a, k) are equal text, so all but the first are repeats; only positions that share a rank but not the pair go on to the next round, with a
longer anchor. In the last round the anchor is the whole window, k is 0 and nothing stays open. Ranks are 64-bit fingerprints.

Rows that share doc_id are told apart by a 64-bit hash of their text, t, and ordered by it; rows equal in both are one document. Null ids
come first. Texts shorter than a window have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bookflow.llm import scan

NONE = -(2**63)
ROWS = "a long, k long, d long, t long, p long, n int, done boolean"
FOUND = "d long, t long, p long, n int, open boolean"
#: Bytes of text whose arrays are held at once; rows are still those of a whole block.
PART = 1 << 17


@dataclass(frozen=True)
class Rule:
    words: bool  # symbols are words, else bytes
    window: int
    lengths: tuple[int, ...]  # of anchors, growing, the last is the window
    within: bool  # an earlier start in the same document counts too

    def symbols(self, s: scan.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash values of all symbols, and where each text begins and ends in them."""
        if self.words:
            return s.words(), s.first_word[:-1], s.first_word[1:]
        return scan._VALUES[s.data], s.begin, s.end


def named(docs: DataFrame) -> DataFrame:
    """`docs` plus _d and _t, which name a document. _t is 0 where no id repeats."""
    same = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    # never null, so that no join puts a filter below the shuffle; and no literal 0, which the planner would drop from the partitioning. Else the
    # texts are shuffled again
    tag = F.coalesce(F.xxhash64("text") if same else F.pmod(F.col("_d"), F.lit(1).cast("long")), F.lit(0).cast("long"))
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE).cast("long"))).withColumn("_t", tag)


def dealt(named: DataFrame) -> DataFrame:
    """The table of `named`, shuffled by document."""
    return named.repartition("_d", "_t")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` plus _d and _t, shuffled by them."""
    return dealt(named(docs))


def anchored(values: np.ndarray, at: np.ndarray, count: np.ndarray, window: int, length: int) -> tuple[np.ndarray, ...]:
    """Blocks of the runs of `count` windows from index `at` on: ranks a and k, first window, number of windows, run, place of the anchor."""
    empty = np.zeros(0, np.int64)
    if not len(at) or not count.sum():
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    ranges = scan.Ranges(values)
    rank = scan.mix(ranges.fixed(length))
    width = window - length + 1
    low = (rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: span - width], low[width - span :])
    i, run = scan.ragged(at, count), np.repeat(np.arange(len(at)), count)
    anchor = (low[i] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(i)))
    start = i[first]
    whole = np.zeros(len(n), np.uint64) if length == window else ranges.hash(start, start + n + window - 1)
    return rank[anchor[first]], whole, start, n, run[first], anchor[first]


def later(rule: Rule, d: np.ndarray, t: np.ndarray, p: np.ndarray, fd: np.ndarray, ft: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether positions d, t, p count as repeats of fd, ft, fp."""
    if not rule.within:
        return d > fd
    return (d > fd) | (d == fd) & ((t > ft) | (t == ft) & (p > fp))


def rows_of(rule: Rule, a: np.ndarray, k: np.ndarray, d: np.ndarray, t: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of a round. Of positions with equal ranks here all but the first are known repeats; those side by side become one row."""
    key = scan.mix(a + scan.mix(k))
    order = np.lexsort((p, t, d, key))
    a, k, d, t, p, n, key = (x[order] for x in (a, k, d, t, p, n, key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = later(rule, d, t, p, d[first], t[first], p[first])
    order = np.lexsort((p[done], t[done], d[done]))
    rd, rt, rp, rn = (x[done][order] for x in (d, t, p, n))
    head = np.ones(len(rd), bool)
    head[1:] = (rd[1:] != rd[:-1]) | (rt[1:] != rt[:-1]) | (rp[1:] != rp[:-1] + rn[:-1])
    cut = np.flatnonzero(head)
    rd, rt, rp, rn = rd[cut], rt[cut], rp[cut], np.add.reduceat(rn, cut) if len(cut) else rn[:0]
    a = np.concatenate([scan.signed(a[~done]), scan.signed(scan.mix((rd ^ rt ^ rp).view(np.uint64)))])
    k = np.concatenate([scan.signed(k[~done]), np.zeros(len(rd), np.int64)])
    flags = np.arange(len(a)) >= len(a) - len(rd)
    cat = lambda x, y: np.concatenate([x[~done], y])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(k), pa.array(cat(d, rd)), pa.array(cat(t, rt)), pa.array(cat(p, rp)), pa.array(cat(n, rn).astype(np.int32)), pa.array(flags)], ["a", "k", "d", "t", "p", "n", "done"])


def positions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("_d").to_numpy(), batch.column("_t").to_numpy()


def by_parts(windows: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """What `windows` gives for a block, worked out part by part."""
    return map(np.concatenate, zip(*map(windows, scan.cut([batch], PART))))


def first_round(docs: DataFrame, rule: Rule, keep: Callable | None = None) -> DataFrame:
    """Rows of all windows of all texts; `keep(texts, values, begin, end, places)` may drop blocks whose anchor is known not to recur."""

    def windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        values, begin, end = rule.symbols(scan.Scan(scan.texts(part)))
        d, t = positions(part)
        a, k, start, n, doc, anchor = anchored(values, begin, np.maximum(end - begin - rule.window + 1, 0), rule.window, rule.lengths[0])
        if keep is not None and len(a):
            chosen = keep(part, values, begin, end, anchor)
            a, k, start, n, doc = (x[chosen] for x in (a, k, start, n, doc))
        return a, k, d[doc], t[doc], start - begin[doc], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            yield rows_of(rule, *by_parts(windows, batch))

    return docs.mapInArrow(run, ROWS)


def next_round(docs: DataFrame, found: DataFrame, rule: Rule, length: int) -> DataFrame:
    """Rows of the open windows of the round before, with longer anchors."""

    def windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        values, begin, _ = rule.symbols(scan.Scan(scan.texts(part)))
        d, t = positions(part)
        at, count, doc = spans(part, "_f", True)
        a, k, start, n, run_, _ = anchored(values, begin[doc] + at, count, rule.window, length)
        doc = doc[run_]
        return a, k, d[doc], t[doc], start - begin[doc], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            yield rows_of(rule, *by_parts(windows, batch))

    return docs.join(found, ["_d", "_t"]).where("_any").mapInArrow(run, ROWS)


def spans(batch: pa.RecordBatch, name: str, open_: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and document of the windows listed in a column, either the open ones or the repeats."""
    column = batch.column(name)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    flat = column.flatten()
    s, n, o = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    doc = np.repeat(np.arange(len(column)), sizes)
    pick = o.astype(bool) == open_
    return s[pick].astype(np.int64), n[pick].astype(np.int64), doc[pick]


def ranked(rows: DataFrame, rule: Rule) -> DataFrame:
    """One round: sorted by ranks, then read once. Gives per document the repeats and the open windows: _d, _t, _f (list), _any (some are open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # of the group of rank a that the last batch ended in: a, k, first d, t and p of k, many ranks k?, rows held back
        for batch in batches:
            out, (a, k, d, t, p, n, done) = [], (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            done = done.astype(bool)
            out.append((d[done], t[done], p[done], n[done], False))
            a, k, d, t, p, n = (x[~done] for x in (a, k, d, t, p, n))
            if len(a):
                state = _read(rule, state, a, k, d, t, p, n, out)
            d, t, p, n = (np.concatenate([x[c] for x in out]) for c in range(4))
            flags = np.concatenate([np.full(len(x[0]), x[4]) for x in out])
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(p), pa.array(n), pa.array(flags)], ["d", "t", "p", "n", "open"])
        scan.give_back()

    found = rows.repartition("a").sortWithinPartitions("a", "k", "d", "t", "p").mapInArrow(run, FOUND)
    place = F.struct(F.col("p").alias("s"), "n", F.col("open").alias("o"))
    return found.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(place).alias("_f"), F.max("open").alias("_any"))


def _read(rule: Rule, state, a, k, d, t, p, n, out: list):
    m = len(a)
    same_a = state is not None and state[0] == a[0]
    new_a, new_k = np.ones(m, bool), np.ones(m, bool)
    new_a[1:] = a[1:] != a[:-1]
    new_a[0] = not same_a
    new_k[1:] = new_a[1:] | (k[1:] != k[:-1])
    new_k[0] = not (same_a and state[1] == k[0])
    at = np.maximum.accumulate(np.where(new_k, np.arange(m), -1))
    fd, ft, fp = (x[np.maximum(at, 0)] for x in (d, t, p))
    if not new_k[0]:
        fd, ft, fp = (np.where(at < 0, x, y) for x, y in zip(state[2:5], (fd, ft, fp)))
    repeat = later(rule, d, t, p, fd, ft, fp)
    group = np.cumsum(new_a) - new_a[0]
    ranks = np.bincount(group, new_k)
    if same_a:
        ranks[0] += 2 if state[5] else 1
        if ranks[0] >= 2 and state[6]:
            out += [(*x, True) for x in state[6]]
    many = ranks >= 2
    out.append((d[repeat], t[repeat], p[repeat], n[repeat], False))
    open_ = ~repeat & many[group]
    out.append((d[open_], t[open_], p[open_], n[open_], True))
    tail = ~repeat & (group == group[-1]) & ~many[-1]
    held = [(d[tail], t[tail], p[tail], n[tail])] if tail.any() else []
    if same_a and group[-1] == 0 and not many[-1]:
        held = state[6] + held
    return a[-1], k[-1], fd[-1], ft[-1], fp[-1], bool(many[-1]), held


def find(docs: DataFrame, rule: Rule, rows: DataFrame | None = None) -> DataFrame:
    """`docs` (from `keyed`) plus, of each round, a list of windows (_r0, _r1, ...) and whether some were open (_any0, ...). Everything is one plan; the shuffle of the texts and those of each round are used again. `rows`: those of the first round, if made before."""
    out, rows = docs, first_round(docs, rule) if rows is None else rows
    for r, length in enumerate(rule.lengths):
        found = ranked(rows, rule)
        out = out.join(found.select("_d", "_t", F.col("_f").alias(f"_r{r}"), F.col("_any").alias(f"_any{r}")), ["_d", "_t"], "left")
        if r + 1 < len(rule.lengths):
            rows = next_round(docs, found, rule, rule.lengths[r + 1])
    return out


def covered(batch: pa.RecordBatch, rule: Rule, begin: np.ndarray, size: int) -> np.ndarray:
    """Flags of the symbols that repeated windows cover, for texts laid side by side."""
    step = np.zeros(size + 1, np.int64)
    for r in range(len(rule.lengths)):
        at, count, doc = spans(batch, f"_r{r}", False)
        start = begin[doc] + at
        np.add.at(step, start, 1)
        np.add.at(step, start + count + rule.window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def columns(rule: Rule) -> list[str]:
    """What `find` adds; a reader that takes them all lets Spark use each shuffle again."""
    return [f"{c}{r}" for r in range(len(rule.lengths)) for c in ("_r", "_any")]
