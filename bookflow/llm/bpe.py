"""Operator 7, byte-level BPE: encoding by a queue of merges over a linked list, decoding by joining vocabulary strings.

A vocabulary file is given by path; executors get its content as a broadcast (a vocabulary has a fixed size). Every piece of text that the
splitting rule cuts is merged once per worker and kept in a bounded cache, which never changes a result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from bookflow.llm import scan

#: The splitting rule of byte-level vocabularies (fixed value); white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 150_000
#: The same rule for `re`, which is twice as fast, and the characters whose class it judges otherwise.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


@cache
def odd() -> frozenset[str]:
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    sets = [set(regex.findall(r"\p{L}", every)) ^ set(re.findall(r"[^\W\d_]", every)), set(regex.findall(r"\p{N}", every)) ^ set(re.findall(r"\d", every)), set(regex.findall(r"\p{White_Space}", every)) ^ set(re.findall(r"\s", every))]
    return frozenset().union(*sets)


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: printable Latin-1 itself, all others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """A vocabulary with its merges and special strings, which are cut out of a text before all else, as the file's own library does."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, chars = spec["model"], byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.string: dict[int, bytes] = {i: raw(s) for s, i in model["vocab"].items() if all(c in chars for c in s)}
        self.string |= {i: s.encode() for s, i in self.special.items()}
        vocab = model["vocab"]
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}  # by left << 32 | right
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank[vocab[a] << 32 | vocab[b]] = rank
        self.byte_id = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.split = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.cache: dict[str, bytes] = {}
        self.dropped: dict[str, bytes] = {}

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece: the queue gives the merge of lowest rank, leftmost first; an entry whose symbols have changed since is skipped.

        A queue entry is rank and place of the left symbol in one integer; the rank tells the pair it stands for.
        """
        ids = [self.byte_id[b] for b in piece.encode()]
        n, rank_of, merges = len(ids), self.rank.get, self.merges
        queue = [r << 40 | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFFFF
            a, b, new = merges[entry >> 40]
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank_of(new << 32 | ids[k])) is not None:
                    heappush(queue, r << 40 | i)
            k = left[i]
            if k >= 0 and (r := rank_of(ids[k] << 32 | new)) is not None:
                heappush(queue, r << 40 | k)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._encode(text)
        parts = self.cut(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._encode(p) for k, p in enumerate(parts))

    def _encode(self, text: str) -> bytes:
        pieces = FAST(text) if odd().isdisjoint(text) else self.split(text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._miss(pieces[i])
        return b"".join(found)

    def _miss(self, piece: str) -> bytes:
        got = self.dropped.get(piece)
        if got is None:
            got = array("I", self.merged(piece)).tobytes() if sys.byteorder == "little" else np.array(self.merged(piece), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.dropped, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings side by side; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.string.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_made: dict[str, Bpe] = scan.keep({})


def _of(shared) -> Bpe:
    """One tokenizer per worker: the one of the last vocabulary."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = Bpe(shared.value)
    return _made[shared.id]


class _Content:
    """A broadcast of a vocabulary file, known by its content."""

    def __init__(self, docs: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.sent = docs.sparkSession.sparkContext.broadcast(content)
        self.id = hashlib.sha256(content.encode()).hexdigest()

    @property
    def value(self) -> str:
        return self.sent.value


def encode(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """`docs` with its columns, plus n_tokens and ids (binary, little-endian unsigned 32-bit), and `decoded` where the way `back` is asked for.

    A null or empty text has no ids; a text of any length is encoded whole.
    """
    shared, new = _Content(docs, path), ["n_tokens", "ids", "decoded"][: 2 + back]
    docs = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(shared)
        for batch in scan.blocks(batches, own=_made):
            ids = [bpe.encode(x or "") for x in batch.column("text").to_pylist()]
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if back:
                made.append(pa.array(map(bpe.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *new])

    kinds = [T.LongType(), T.BinaryType(), T.StringType()]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(new, kinds))]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with its columns, plus `decoded`, the text of column ids; null ids give an empty text."""
    shared = _Content(encoded, path)
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([bpe.decode(x or b"") for x in part.column("ids").to_pylist()], pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode(docs.select("doc_id", "text"), path, back=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
