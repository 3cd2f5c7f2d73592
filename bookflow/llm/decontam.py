"""Operator 10, benchmark decontamination: BM25 index of the test items, queried with every passage by block-max WAND.

The index is small and is sent to all tasks; its size is checked, and a larger benchmark goes through several indexes one after the
other. Impacts are divided by the score that an item gives itself, so a score is the share of an item that a passage holds. Passages
are windows of `2 * step` words, every `step` words, at least as long as two items, so a whole item lies in one of them. Skipping is done for a
block of passages at once: by the sum of the largest impacts of the passage's terms, then by the largest impacts per block of items; only
items of blocks whose bound reaches the threshold are scored, all that reach it are retrieved, and question and answer are then verified
in each of these passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bookflow.llm import scan

INDEX_BYTES = 16 << 20
BLOCKS = 64
K1, B = 1.2, 0.75
_TRIM = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\"'()[]{}"])
FOUND = ["score", "question_overlap", "answer_overlap", "at_word"]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased and without punctuation around them, and the first word of each text (one entry more)."""
    s = scan.Scan(texts, lower=True)
    start, end = s.word_start.copy(), s.word_end.copy()
    for _ in range(3):
        end -= _TRIM[s.data[end - 1]] & (end - start > 1)
        start += _TRIM[s.data[start]] & (end - start > 1)
    return s.bytes.hash(start, end), s.first_word


def grams(words: np.ndarray, k: int) -> np.ndarray:
    return scan.mix(scan.Ranges(words).fixed(k)) if len(words) >= k else np.zeros(0, np.uint64)


@dataclass
class Index:
    item_ids: np.ndarray
    vocab: np.ndarray  # sorted term hashes
    head: np.ndarray  # postings of term t: [head[t], head[t + 1])
    item: np.ndarray
    impact: np.ndarray
    best: np.ndarray  # largest impact of a term
    block_best: np.ndarray  # and per block of items (terms, blocks)
    per_block: int
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # per item: k and distinct k-grams of question and answer
    maybe: np.ndarray  # by the low 16 bits of a hash: some term has them
    step: int


def build(items: list[tuple[int, bytes, bytes]], gram: int = 3) -> Index:
    """An index of (id, question, answer); items without a word are never found."""
    words, first = tokens([q + b" " + a for _, q, a in items])
    length = np.diff(first)
    doc = np.repeat(np.arange(len(items)), length)
    vocab, term = np.unique(words, return_inverse=True)
    pair, tf = np.unique(term * max(1, len(items)) + doc, return_counts=True)
    t, i = pair // max(1, len(items)), pair % max(1, len(items))
    df = np.bincount(t, minlength=len(vocab))
    weight = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[i] / max(1.0, length.mean() if len(length) else 1)))
    weight = weight / np.bincount(i, weight, len(items))[i]
    per_block = max(1, -(-len(items) // BLOCKS))
    best, block_best = np.zeros(len(vocab)), np.zeros((len(vocab), -(-len(items) // per_block)), np.float32)
    np.maximum.at(best, t, weight)
    np.maximum.at(block_best, (t, i // per_block), np.nextafter(weight.astype(np.float32), np.float32(2)))
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    parts = []
    for _, q, a in items:
        both = []
        for side in (q, a):
            w, _ = tokens([side])
            k = max(1, min(gram, len(w)))
            both.append((k, np.unique(grams(w, k))))
        parts.append(tuple(both))
    return Index(np.array([x[0] for x in items], np.int64), vocab, np.searchsorted(t, np.arange(len(vocab) + 1)), i, weight, best, block_best, per_block, parts, maybe, max(32, int(length.max(initial=1))))


def search(index: Index, texts: list[bytes], threshold: float) -> tuple[np.ndarray, ...]:
    """Every passage and item that reach the threshold, passage by passage. Gives text, item, score, first word and end word of the passage."""
    words, first = tokens(texts)
    n, step, terms = np.diff(first), index.step, len(index.vocab)
    empty = np.zeros(0, np.int64)
    if not len(words) or not terms:
        return empty, empty, empty.astype(float), empty, empty, words, first
    last = np.maximum(-(-n // step) - 2, 0)  # number of the last passage of each text
    base = np.cumsum(last + 1) - (last + 1)
    at = np.flatnonzero(index.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.vocab, words[at]), terms - 1)
    known = index.vocab[term] == words[at]
    at, term = at[known], term[known]
    doc = np.searchsorted(first, at, "right") - 1
    k = (at - first[doc]) // step
    both = np.concatenate([(base[doc] + np.minimum(k, last[doc])) * terms + term, ((base[doc] + k - 1) * terms + term)[(k > 0) & (k <= last[doc])]])
    both = np.unique(both)
    passage, term = both // terms, both % terms
    bound = np.bincount(passage, index.best[term], int(base[-1] + last[-1] + 1))
    live = bound[passage] >= threshold - 1e-6
    passage, term = passage[live], term[live]
    if not len(passage):
        return empty, empty, empty.astype(float), empty, empty, words, first
    head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    blocks = np.add.reduceat(index.block_best[term], head, axis=0) >= threshold - 1e-4
    row = np.cumsum(np.append(False, passage[1:] != passage[:-1]))
    live = blocks.any(axis=1)[row]
    passage, term, row = passage[live], term[live], row[live]
    count = index.head[term + 1] - index.head[term]
    post = scan.ragged(index.head[term], count)
    owner, item, value = np.repeat(row, count), index.item[post], index.impact[post]
    live = blocks[owner, item // index.per_block]
    owner, item, value, number = owner[live], item[live], value[live], np.repeat(passage, count)[live]
    hit, inverse = np.unique(number * len(index.item_ids) + item, return_inverse=True)
    score = np.bincount(inverse, value, len(hit))
    good = score >= threshold
    hit, score = hit[good], score[good]
    number, item = hit // len(index.item_ids), hit % len(index.item_ids)
    text = np.searchsorted(base, number, "right") - 1
    start = first[text] + (number - base[text]) * step
    return text, item, score, start, np.minimum(start + 2 * step, first[text + 1]), words, first


def overlaps(index: Index, words: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Shares of the question's and the answer's k-grams that each passage holds, two a row; 1 for a side without a word. Rows of one passage follow each other."""
    out, here, held = np.ones((len(item), 2)), -1, {}
    for row, (i, s, e) in enumerate(zip(item.tolist(), start.tolist(), end.tolist())):
        if s != here:
            here, held = s, {}
        for side, (k, wanted) in enumerate(index.parts[i]):
            if len(wanted):
                if k not in held:
                    held[k] = np.unique(grams(words[s:e], k))
                at = np.searchsorted(held[k], wanted)
                out[row, side] = (held[k][np.minimum(at, len(held[k]) - 1)] == wanted).mean() if len(held[k]) else 0.0
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id and FOUND for every row of `docs` and item of which a passage scores `threshold` or more and holds that share of the 3-grams of question and of answer.

    items: item_id, question, answer; null sides are empty, rows without an item_id are left out, repeated ids are items of their own. A null
    or empty text, or an empty table, gives no rows; equal texts give equal rows. No shuffle: every text is searched where it is read.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in FOUND[:3]), T.StructField("at_word", T.LongType())])
    shared = indexes(items, index_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            for index in shared:
                text, item, *found = verified(index.value, scan.texts(batch), threshold, question, answer)
                columns = [pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in found[:3]), pa.array(found[3], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text, pa.int64())), *columns], ["doc_id", "item_id", *FOUND])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> list:
    """Broadcast indexes of at most about `index_bytes` of item text each."""
    size = F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)) + 16
    items = items.where("item_id is not null").select("item_id", "question", "answer", size.cast("long").alias("_size"))
    runs = max(1, -(-(items.agg(F.sum("_size")).first()[0] or 0) // index_bytes))
    out = []
    for k in range(runs):
        part = items if runs == 1 else items.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(runs)) == k)
        rows = sorted((r["item_id"], (r["question"] or "").encode(), (r["answer"] or "").encode()) for r in part.toLocalIterator())
        out.append(items.sparkSession.sparkContext.broadcast(build(rows)))
    return out


def verified(index: Index, texts: list[bytes], threshold: float, question: float, answer: float) -> tuple[np.ndarray, ...]:
    """Text, item id, score, overlaps and first word. Of the passages of a text that pass both steps for an item the one of best score, the first if tied."""
    text, item, score, start, end, words, first = search(index, texts, threshold)
    sides = overlaps(index, words, item, start, end)
    good = np.flatnonzero((sides[:, 0] >= question) & (sides[:, 1] >= answer))
    good = good[np.lexsort((start[good], -np.round(score[good], 9), item[good], text[good]))]
    new = np.ones(len(good), bool)
    new[1:] = (text[good][1:] != text[good][:-1]) | (item[good][1:] != item[good][:-1])
    good = good[new]
    return text[good], index.item_ids[item[good]], score[good], sides[good, 0], sides[good, 1], (start - first[text])[good].astype(np.int64)


def halves(benchmark: DataFrame, share: float = 2 / 3) -> DataFrame:
    """item_id, question, answer from items with one text: the first `share` of the words ask, the others answer."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.ceil(F.size("_w") * F.lit(share)).cast("int")
    rows = benchmark.select("item_id", words.alias("_w"))
    return rows.select("item_id", F.array_join(F.slice("_w", F.lit(1), cut), " ").alias("question"), F.array_join(F.slice("_w", cut + 1, F.size("_w")), " ").alias("answer"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """The rows of `docs` that hold no item, with the columns of `docs`; each row is judged by its own text."""
    shared = indexes(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            clean = np.ones(batch.num_rows, bool)
            for index in shared:
                clean[verified(index.value, scan.texts(batch), threshold, question, answer)[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
