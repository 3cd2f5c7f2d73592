"""Operator 3, token ids in Arrow files of fixed-size lists.

Documents are ordered by id over range partitions; each task writes one file (Arrow's random-access stream file) whose batches hold
sequences of equal length and a mask of the same shape, so sequence k of a memory-mapped file is a slice and no copy. A second small file
tells where each document lies. Files get unique names and only a finished task's row names them, so a repeated task leaves
no double entry. Paths are URIs of a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bookflow.llm import scan
from bookflow.session import stage

SEQUENCE, BATCH, CACHE = 2048, 64, 1_000_000
MANIFEST = "part int, file string, n_docs long, n_tokens long"
#: Runs of Latin-1 letters; ASCII letters; ASCII punctuation.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER = np.isin(np.arange(256), list(string.ascii_letters.encode()))
_MARK = np.isin(np.arange(256), list(string.punctuation.encode()))


class WordEncoder:
    """Encodes by the tokenizers library, word by word.

    For a vocabulary that drops white space, no token reaches over ASCII white space, so a text's ids are those of its words; words (where the vocabulary cuts
    them there: letters and the punctuation after them) are looked up by their 64-bit hashes, a block at a time, in a bounded cache. Otherwise (`whole`) texts go to the library as they are.
    """

    def __init__(self, content: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        rules = (json.loads(content).get("normalizer") or {}).get("normalizers", [])
        self.lower = any(r["type"] == "Lowercase" for r in rules)
        cut = [(t["content"], t["id"]) for t in json.loads(content).get("added_tokens", []) if t["special"] and not t["normalized"] and "<|" in t["content"]]
        self.between = cut[0] if cut else None
        self.last = self._last_of_piece(json.loads(content))
        self.whole = whole
        self._forget()

    @staticmethod
    def _last_of_piece(rules: dict) -> np.ndarray | None:
        """Flags of the ids that end a piece, for a vocabulary that marks them and makes one piece of a run of letters; else none."""
        suffix, split = rules["model"].get("end_of_word_suffix"), json.dumps(rules.get("pre_tokenizer"))
        if not suffix or r"|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" not in split:
            return None
        vocab = rules["model"]["vocab"]
        flags = np.zeros(max(vocab.values()) + 1, bool)
        flags[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return flags

    def _library(self, parts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def _words(self, parts: list[bytes]) -> list[bytes]:
        """As _library, but many at a time with a special string between them, which the library cuts out before all else."""
        if self.between is None:
            return self._library(parts)
        out, (name, number) = [], self.between
        joined = [parts[k : k + 500] for k in range(0, len(parts), 500)]
        for e in (self.tokenizer.encode_batch_fast([name.join(p.decode() for p in g) for g in joined], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            cuts = np.flatnonzero(ids == number)
            packed, size = ids.tobytes(), self.kind.itemsize
            start = [0, *((cuts + 1) * size).tolist()]
            out += [packed[a:b] for a, b in zip(start, [*(cuts * size).tolist(), len(packed)])]
        return out

    def _runs(self, parts: list[bytes]) -> list[bytes]:
        """As _library, for runs of letters: they go side by side with spaces between them, and the ids that end a piece tell them apart."""
        out, size = [], self.kind.itemsize
        joined = [parts[k : k + 500] for k in range(0, len(parts), 500)]
        for e in self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in joined], add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            cuts, packed = ((np.flatnonzero(self.last[ids]) + 1) * size).tolist(), ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _units(self, s: scan.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the units of all texts start and end, and their number in each word: a word, or its letters and the ASCII punctuation after them."""
        start, end = s.word_start, s.word_end
        if self.last is None or not len(start):
            return start, end, np.ones(len(start), np.int64)
        other = np.where(_MARK[s.data], 0, np.arange(1, len(s.data) + 1))
        tail = np.maximum(np.maximum.accumulate(other)[end - 1], start)
        cut = (tail > start) & (tail < end) & _LETTER[s.data[tail - 1]]
        special = np.flatnonzero((s.data[:-1] == ord("<")) & (s.data[1:] == ord("|")))
        cut[np.searchsorted(start, special, "right") - 1] = False  # a special string is never cut
        n = 1 + cut
        first, last = np.repeat(start, n), np.repeat(end, n)
        at = (np.cumsum(n) - 1)[cut]
        first[at], last[at - 1] = tail[cut], tail[cut]
        return first, last, n

    def _new(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units."""
        plain = [self.last is not None and _LETTERS.fullmatch(u) is not None for u in units]
        odd = [b"<|" in u for u in units]
        out: list[bytes] = [b""] * len(units)
        for how, wanted in ((self._runs, plain), (self._library, odd), (self._words, [not p and not o for p, o in zip(plain, odd)])):
            at = list(itertools.compress(range(len(units)), wanted))
            if at:
                for k, packed in zip(at, how([units[k] for k in at]), strict=True):
                    out[k] = packed
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, packed as `kind`."""
        if self.whole:
            return self._library(texts)
        # ASCII white space cuts words; bytes.lower changes A-Z only, which the vocabulary's own rule does too, but not in front of a
        # combining accent (it might then compose), nor inside a special string
        s = scan.Scan([t if not self.lower or b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts])
        start, end, n = self._units(s)
        if not len(start):
            return [b""] * len(texts)
        unit, first, which = np.unique(s.bytes.hash(start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, unit), len(self.known) - 1)
        fresh = np.flatnonzero(self.known[at] != unit)
        if len(fresh):
            data = s.data.tobytes()
            made = self._new([data[a:b] for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())])
            count = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
            where = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), self.kind)])
            into = np.searchsorted(self.known, unit[fresh])
            self.known, self.where, self.count = (np.insert(old, into, add) for old, add in ((self.known, unit[fresh]), (self.where, where), (self.count, count)))
            at = np.searchsorted(self.known, unit)
        at = at[which]
        count = self.count[at]
        packed = self.pool[scan.ragged(self.where[at], count)].tobytes()
        ends = np.append(0, np.cumsum(count)) * self.kind.itemsize
        cuts = ends[np.append(0, np.cumsum(n))[s.first_word]].tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _forget(self) -> None:
        """Empties the cache: hashes of units in order, and where the ids of each lie in the pool. One entry, of no unit, keeps lookups inside."""
        self.known, self.where, self.count = np.array([2**64 - 1], np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.zeros(0, self.kind)


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder_of(content: str, whole: bool) -> WordEncoder:
    """One per worker, with what it has cached."""
    key = (hashlib.sha256(content.encode()).hexdigest(), whole)
    if key not in _encoders:
        _encoders[key] = WordEncoder(content, whole)
    return _encoders[key]


class _Writer:
    """Cuts a stream of ids into masked sequences of one file."""

    def __init__(self, sink, kind: np.dtype, length: int, batch: int):
        self.value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file, self.kind, self.length, self.rows = pa.ipc.new_file(sink, self.schema), kind, length, batch
        self.held: list[bytes] = []
        self.size = 0

    def add(self, packed: bytes) -> None:
        self.held.append(packed)
        self.size += len(packed)
        full = self.rows * self.length * self.kind.itemsize
        if self.size >= full:
            data = b"".join(self.held)
            cut = len(data) - len(data) % full
            for k in range(0, cut, full):
                self._batch(np.frombuffer(data, self.kind, full // self.kind.itemsize, k), full // self.kind.itemsize)
            self.held, self.size = [data[cut:]], len(data) - cut

    def _batch(self, ids: np.ndarray, n: int) -> None:
        lists = lambda x: pa.FixedSizeListArray.from_arrays(x, self.length)
        self.file.write_batch(pa.RecordBatch.from_arrays([lists(pa.array(ids, self.value)), lists(pa.array(np.arange(len(ids)) < n))], schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        if len(ids):
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.file.close()


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, length: int = SEQUENCE, whole: bool = False) -> DataFrame:
    """Write the ids of all texts under `path`, ascending by (doc_id, hash of text), null ids first; `end_id` closes each document. Returns the manifest.

    Manifest: part, file, n_docs, n_tokens, start (tokens in all parts before). Null and empty texts have the end id alone; an empty
    table gives no file. The last sequence of a file is padded, its mask says how far it counts.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    parts = max(1, docs.rdd.getNumPartitions())
    rows = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        doc_ids, counts = [], []
        for batch in scan.blocks(batches):
            if encoder is None:
                encoder = encoder_of(shared.value, whole)
                fs, folder = pafs.FileSystem.from_uri(path)
                fs.create_dir(folder, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(f"{name}.arrow")
                writer = _Writer(sink, encoder.kind, length, BATCH)
                end = np.array([end_id], encoder.kind).tobytes()
            for packed in encoder.encode(scan.texts(batch)):
                writer.add(packed + end)
                counts.append(len(packed) // encoder.kind.itemsize + 1)
            doc_ids += batch.column("doc_id").to_pylist()
        if writer is None:
            return
        writer.close()
        sink.close()
        table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with fs.open_output_stream(f"{name}.index.arrow") as index, pa.ipc.new_file(index, table.schema) as out:
            out.write_table(table)
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name.rpartition("/")[2], "n_docs": len(counts), "n_tokens": sum(counts)}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = stage(rows.mapInArrow(run, MANIFEST), "token-manifest")
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def open_sequences(uri: str) -> tuple[pa.Table, pa.Table]:
    """Sequences with masks, and the index of documents, of one file; a local file is memory-mapped and nothing is copied."""
    fs, path = pafs.FileSystem.from_uri(uri)
    opened = []
    for name in (f"{path}.arrow", f"{path}.index.arrow"):
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        opened.append(pa.ipc.open_file(source).read_all())
    return opened[0], opened[1]


def read_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the files of `manifest`; one task reads a file."""
    files = manifest.select("file", "start", "part").repartitionByRange(max(1, manifest.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequences, index = open_sequences(f"{path}/{row['file']}")
                column, size = sequences.column("ids"), index.column("n_tokens").to_numpy()
                length = column.type.list_size
                ends = np.cumsum(size)
                heads = np.append(0, np.cumsum([len(c) * length for c in column.chunks]))
                for lo in range(0, len(size), 256):
                    hi = min(lo + 256, len(size))
                    a, b = int(ends[lo] - size[lo]), int(ends[hi - 1])
                    first, last = np.searchsorted(heads, a, "right") - 1, np.searchsorted(heads, b, "left")
                    ids = np.concatenate([c.flatten().to_numpy() for c in column.chunks[first:last]])[a - heads[first] : b - heads[first]].astype("<u4").tobytes()
                    cuts = (ends[lo:hi] - a) * 4
                    yield pa.RecordBatch.from_arrays([
                        index.column("doc_id").slice(lo, hi - lo).combine_chunks(), pa.array(ends[lo:hi] - size[lo:hi] + row["start"]), pa.array(size[lo:hi]),
                        pa.array([ids[e - 4 * n : e] for e, n in zip(cuts.tolist(), size[lo:hi].tolist())], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
