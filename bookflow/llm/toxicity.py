"""Operator 5, toxicity: bags of character n-grams, averaged into a linear softmax.

A word is the bag of its lower-cased 3- to 5-grams, with its ends marked, and itself. Every n-gram is hashed to one of BUCKETS vectors; windows
of WINDOW words are averaged and go through a linear softmax; the windows of a text are pooled by log-sum-exp, so a few bad words
count in a long text. Vectors and softmax are trained jointly on a bounded sample. A misspelling shares n-grams with the word it stands for.
For scoring, vectors and softmax collapse to one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bookflow.llm import scan

BUCKETS, DIM, WINDOW = 1 << 17, 8, 3
GRAMS = (3, 4, 5)


def vocabulary(docs: list[bytes]) -> tuple[scan.Scan, np.ndarray, np.ndarray, np.ndarray]:
    """The scan, the distinct word of each word, and of each distinct word its buckets side by side with the number of them."""
    s = scan.Scan(docs, lower=True)
    hashes = s.words()
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    start, end = s.word_start[first], s.word_end[first]
    at, whose = [hashes[first]], [np.arange(len(first))]
    padded = np.full(int((end - start + 2).sum()) if len(first) else 0, 32, np.uint8)
    begin = np.cumsum(end - start + 2) - (end - start + 2)
    padded[scan.ragged(begin + 1, end - start)] = s.data[scan.ragged(start, end - start)]
    codes = padded.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        counts = np.maximum(end - start + 3 - n, 0)
        i = scan.ragged(begin, counts)
        h = np.full(len(i), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ codes[i + k]
        at.append(scan.mix(h))
        whose.append(np.repeat(np.arange(len(first)), counts))
    buckets, owner = (np.concatenate(at) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(whose)
    return s, word.astype(np.int64), buckets, owner


def windows(first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (in words) and text of all windows: every WINDOW-th word begins one."""
    sizes = np.diff(first_word)
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = scan.ragged(np.zeros(len(sizes), np.int64), counts) * WINDOW + first_word[:-1][doc]
    return start, np.minimum(start + WINDOW, first_word[1:][doc]), doc


def _pool(z: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp of the windows of each text, less a fixed log, and every window's share in it; -40 where there are none."""
    top = np.full(n_docs, -40.0)
    np.maximum.at(top, doc, z)
    e = np.exp(z - top[doc])
    total = np.bincount(doc, e, n_docs)
    return np.where(total > 0, top + np.log(np.maximum(total, 1e-300)), -40.0), e / np.maximum(total, 1e-300)[doc]


@dataclass
class Toxicity:
    weight: np.ndarray  # of each bucket
    bias: float

    def score(self, docs: list[bytes]) -> np.ndarray:
        s, word, buckets, owner = vocabulary(docs)
        value, size = np.bincount(owner, self.weight[buckets], word.max(initial=-1) + 1), np.bincount(owner)
        start, end, doc = windows(s.first_word)
        z = _average(value, size, word, start, end)[0] + self.bias
        pooled = _pool(z, doc, len(docs))[0]
        return 1 / (1 + np.exp(-pooled))


def _average(value, size, word, start, end) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = np.append(0, np.cumsum(value[word])), np.append(0, np.cumsum(size[word]))
    n = counts[end] - counts[start]
    return (sums[end] - sums[start]) / np.maximum(n, 1), n


def fit(docs: list[bytes], y: np.ndarray, rounds: int = 40, rate: float = 0.5, l2: float = 1e-6, seed: int = 1) -> Toxicity:
    """Full-batch Adam on the vectors (BUCKETS x DIM), the softmax and the bias together; the loss is weighted to equal class sizes."""
    if not len(y) or y.min() == y.max():
        return Toxicity(np.zeros(BUCKETS), 8.0 if len(y) and y.min() == 1 else -8.0)
    s, word, buckets, owner = vocabulary(docs)
    start, end, doc = windows(s.first_word)
    size = np.bincount(owner)
    n_words = np.append(0, np.cumsum(size[word]))
    per_window = np.maximum(n_words[end] - n_words[start], 1)
    used, bucket = np.unique(buckets, return_inverse=True)
    rng = np.random.RandomState(seed)
    emb, soft = rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 1, (DIM, 2))
    bias, n_docs = -6.0, len(docs)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    window_of = np.repeat(np.arange(len(start)), end - start)
    state = [np.zeros_like(x) for x in (emb, emb, soft, soft)]
    b_m = b_v = 0.0
    for t in range(1, rounds + 1):
        direction = soft[:, 1] - soft[:, 0]
        weight = (emb * direction).sum(1)  # not by BLAS, whose threads would idle beside Spark's
        z = _average(np.bincount(owner, weight[bucket], len(size)), size, word, start, end)[0] + bias
        logit, share = _pool(z, doc, n_docs)
        p = 1 / (1 + np.exp(-logit))
        g_window = (balance * (p - y))[doc] * share
        g_word = np.bincount(word, (g_window / per_window)[window_of], len(size))
        g_weight = np.bincount(bucket, g_word[owner], len(used))
        g_emb, g_dir = np.outer(g_weight, direction) + l2 * emb, (emb * g_weight[:, None]).sum(0)
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for k, (x, g) in enumerate(((emb, g_emb), (soft, np.stack([-g_dir, g_dir], 1)))):
            m, v = state[2 * k], state[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= (step if k == 0 else 0.1 * step) * m / (np.sqrt(v) + 1e-9)
        g_b = g_window.sum()
        b_m, b_v = 0.9 * b_m + 0.1 * g_b, 0.999 * b_v + 0.001 * g_b * g_b
        bias -= step * b_m / (np.sqrt(b_v) + 1e-9)
    weight = np.zeros(BUCKETS)
    weight[used] = (emb * (soft[:, 1] - soft[:, 0])).sum(1)
    return Toxicity(weight, float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500) -> Toxicity:
    """Fit on at most `fit_rows` labelled texts, a third of them toxic where there are enough, those of smallest hash of their id.

    docs: doc_id, text. labels: doc_id, toxic; null labels are left out, repeated ones count as toxic if one is.
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    part = lambda y: ids.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 3 if y else fit_rows - fit_rows // 3)
    rows = docs.select("doc_id", "text").join(F.broadcast(part(1).unionByName(part(0))), "doc_id")
    found = rows.toArrow().to_pydict()
    order = sorted(range(len(found["doc_id"])), key=lambda i: (found["doc_id"][i], found["text"][i] or ""))
    return fit([(found["text"][i] or "").encode() for i in order], np.array([found["_y"][i] for i in order], np.int64))


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text alone. A null or empty text, or one without a word, scores about 0."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(scan.texts(batch)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
