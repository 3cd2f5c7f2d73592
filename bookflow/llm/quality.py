"""Operator 1, quality rules: base rules and gradient-boosted trees over document statistics.

`document_stats` computes the statistics of whole texts inside one map over the documents, without a shuffle. `fit_trees` boosts
trees on a bounded sample of labelled rows; `Trees` keeps them as flat node arrays of complete binary trees, so a block of
documents is scored for all trees at once. Chosen statistics act in one direction only (`MONOTONE`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bookflow.llm import scan

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.arange(256) & 0xC0 != 0x80
_UPPER, _DIGIT, _STOP, _PUNCT = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".!?", ".,;:!?'\"()-"))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics the trees see, and the direction of those that may only lower (-1) the quality.
FEATURES = ["log_words", "word_len", "symbols", "dup_lines", "repeat_words", "distinct", "upper", "digits", "stops", "punct", "short", "long_", "top_word", "words_line", "non_ascii", "dup_words_line"]
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1}


def document_stats(docs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS and the matrix of FEATURES, for texts given as bytes."""
    s = scan.Scan(docs)
    n, word = s.n_words, s.words()
    lead = _LEAD[s.data] & ~s.space
    chars = s.per_doc(lead)
    symbols = s.per_doc(_SYMBOL[s.data])

    # lines with a word: cut at \n and at the ends of texts
    cut = s.data == 10
    cut[s.end] = True
    line_end = np.flatnonzero(cut)
    line_start = np.append(0, line_end[:-1] + 1)
    words_in = np.searchsorted(s.word_start, line_end) - np.searchsorted(s.word_start, line_start)
    keep = words_in > 0
    line_start, line_end = line_start[keep], line_end[keep]
    line_doc = np.searchsorted(s.end, line_start)
    n_lines = np.bincount(line_doc, minlength=len(docs))
    dup_lines, _ = _repeats(s.bytes.hash(line_start, line_end), line_doc, len(docs))

    # words in three-word windows that the text has twice or more
    repeat = np.zeros(len(word), bool)
    if len(word) >= 3:
        inside = np.flatnonzero(s.word_doc[2:] == s.word_doc[:-2])
        key = scan.mix(scan.Ranges(word).fixed(3)[inside] + scan.mix(s.word_doc[inside].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = inside[count[inverse] > 1]
        for k in range(3):
            repeat[at + k] = True
    repeats = np.bincount(s.word_doc[repeat], minlength=len(docs))

    dup_words, top = _repeats(word, s.word_doc, len(docs))
    total = np.append(0, np.cumsum(lead))
    length = total[s.word_end] - total[s.word_start]
    part = lambda flags: np.bincount(s.word_doc[flags], minlength=len(docs)) / np.maximum(n, 1)
    of = lambda table: s.per_doc(table[s.data]) / np.maximum(chars, 1)
    last = s.data[s.word_end - 1] if len(word) else np.zeros(0, np.uint8)
    counts = dict(zip(COUNTS, (n, chars, symbols, dup_lines, repeats)))
    features = np.stack([
        np.log1p(n), chars / np.maximum(n, 1), symbols / np.maximum(n, 1), dup_lines / np.maximum(n_lines, 1), repeats / np.maximum(n, 1),
        1 - dup_words / np.maximum(n, 1), of(_UPPER), of(_DIGIT), part(_STOP[last]), of(_PUNCT), part(length <= 3), part(length >= 12),
        top / np.maximum(n, 1), n / np.maximum(n_lines, 1), s.per_doc(s.data >= 0xC0) / np.maximum(chars, 1), dup_lines / np.maximum(n, 1),
    ], axis=1).astype(np.float32)
    return counts, features


def _repeats(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: entries equal to an earlier one of the same text, and the count of its commonest."""
    top = np.zeros(n_docs, np.int64)
    if not len(hashes):
        return top, top
    _, first, count = np.unique(scan.mix(hashes + scan.mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    np.maximum.at(top, doc[first], count)
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[first], minlength=n_docs), top


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class Trees:
    """Complete binary trees of equal depth: node i has children 2i + 1 and 2i + 2; a row goes right where it exceeds the threshold."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for every row, all trees at once."""
        trees, inner = self.feature.shape
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int32)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-self.bias - self.value[tree, node - inner].sum(axis=1)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 5.0, monotone: dict[str, int] = MONOTONE) -> Trees:
    """Boosting on the logistic loss over binned statistics.

    A split on a constrained statistic counts only if its children's values have the demanded order, and both children's subtrees are
    then held on their side of the midpoint. Without rows of both classes the model is a constant.
    """
    n_inner, sign = 2**depth - 1, np.array([monotone.get(f, 0) for f in FEATURES])
    rate_pos = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(np.zeros((trees, n_inner), np.int32), np.full((trees, n_inner), np.inf, np.float32), np.zeros((trees, n_inner + 1), np.float64), float(np.log(rate_pos / (1 - rate_pos))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    logit = np.full(len(y), model.bias)
    width, n_f = bins + 1, x.shape[1]
    flat = binned + np.arange(n_f) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            n_nodes, base = 2**level, 2**level - 1
            cell = (node[:, None] * (n_f * width) + flat).ravel()
            shape = (n_nodes, n_f, width)
            g = np.bincount(cell, np.repeat(grad, n_f), n_nodes * n_f * width).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hess, n_f), n_nodes * n_f * width).reshape(shape).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            lo, hi = low[:, None, None], high[:, None, None]
            left, right = np.clip(g / (h + l2), lo, hi), np.clip((gt - g) / (ht - h + l2), lo, hi)
            whole = np.clip(gt / (ht + l2), lo, hi)
            gain = lambda v, gs, hs: 2 * v * gs - v * v * (hs + l2)
            total = gain(left, g, h) + gain(right, gt - g, ht - h) - gain(whole, gt, ht)
            ok = (h > 2) & (ht - h > 2) & ((sign[None, :, None] * (right - left)) >= 0)
            total = np.where(ok, total, 0).reshape(n_nodes, -1)
            best = total.argmax(axis=1)
            f, b = best // width, best % width
            split = total[np.arange(n_nodes), best] > 1e-6
            thr = np.array([edges[k][j] if s and j < len(edges[k]) else np.inf for k, j, s in zip(f, b, split)], np.float32)
            model.feature[t, base : base + n_nodes], model.threshold[t, base : base + n_nodes] = f, thr
            mid = (left + right)[np.arange(n_nodes), f, b] / 2
            child_low, child_high = np.repeat(low, 2), np.repeat(high, 2)
            for k in np.flatnonzero(split & (sign[f] != 0)):
                up = 2 * k + (sign[f[k]] > 0)
                down = 2 * k + (sign[f[k]] < 0)
                child_low[up], child_high[down] = max(child_low[up], mid[k]), min(child_high[down], mid[k])
            low, high = child_low, child_high
            node = 2 * node + (x[np.arange(len(y)), f[node]] > thr[node])
        leaf_g, leaf_h = np.bincount(node, grad, n_inner + 1), np.bincount(node, hess, n_inner + 1)
        model.value[t] = rate * np.clip(leaf_g / (leaf_h + l2), low, high)
        logit += model.value[t][node]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000) -> Trees:
    """Fit on at most `fit_rows` labelled documents, those of smallest hash of their id; so many labels reach the driver and are broadcast.

    docs: doc_id, text. labels: doc_id, quality; null labels are left out, and repeated ones count as good if one is.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            x = document_stats(scan.texts(batch))[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(list(x))], ["doc_id", "y", "x"])

    found = rows.mapInArrow(stats, "doc_id long, y double, x array<float>").toArrow().to_pydict()
    order = np.argsort(np.array(found["doc_id"], np.int64), kind="stable")
    x = np.array(found["x"], np.float32).reshape(-1, len(FEATURES))[order]
    return fit_trees(x, np.array(found["y"])[order])


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """`docs` with its columns as they are, plus COUNTS, base_failed, quality (probability) and kept.

    Columns of those names in `docs` are replaced. A null or empty text has counts 0 and fails the base rules, so does any text under
    50 words; equal texts get equal results; a text of any length is scored whole.
    """
    new = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    docs = docs.drop(*new.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            counts, x = document_stats(scan.texts(batch))
            failed, p = base_failed(counts["n_words"], counts["n_repeat_words"]), model.score(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                [*batch.schema.names, *new.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))


def filter_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000) -> DataFrame:
    """The documents that pass, with the columns of `docs`."""
    aside = scan.set_aside(docs)
    return score_quality(aside, fit_quality(docs, labels, fit_rows)).where("kept").select(*aside.columns).toDF(*docs.columns)
