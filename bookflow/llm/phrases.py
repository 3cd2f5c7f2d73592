"""Operator 9, repeated-phrase automata: passages of words that recur across documents.

1. Every window of `window` words is represented by an anchor phrase (see `repeats`). Phrases of two or more documents are confirmed.
2. Documents are dealt to slices of some SLICE bytes, the partitions of their shuffle or parts of them. A confirmed phrase is stored once for each
   slice that holds it, in shards of at most PER_SHARD phrases, each of which an executor compiles into an Aho-Corasick automaton. A word is
   two letters of an alphabet of 64, 12 bits of its hash: the library looks through the letters that follow a state one by one.
3. All documents stream through all shards of their slice, which locates every occurrence; the 64-bit hash of the words is held against those of
   the phrases. No slice stores more phrases than it has windows, so the work grows as the corpus does.
4. Windows at located phrases are compared exactly by the rounds of `repeats`.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bookflow.llm import repeats, scan
from bookflow.session import checkpoint_dir

PER_SHARD = 400_000
LETTERS = 2
#: Bytes of text in a slice, about.
SLICE = 1 << 26


def rule(window: int = 50) -> repeats.Rule:
    return repeats.Rule(True, window, tuple(sorted({max(1, window * 12 // 100), window})), False)


def letters(words: np.ndarray) -> np.ndarray:
    """The two ASCII letters of each word hash, as rows."""
    h = scan.mix(words)
    return np.stack([(h >> np.uint64(58)).astype(np.uint8) + np.uint8(48), ((h >> np.uint64(52)).astype(np.uint8) & np.uint8(63)) + np.uint8(48)], axis=1)


def slices(docs: DataFrame) -> Column:
    """The slice of a document of `docs` (from `repeats.named`)."""
    conf = docs.sparkSession.conf
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    if all(conf.get(f"spark.sql.adaptive.{name}").lower() == "true" for name in ("enabled", "coalescePartitions.enabled")):
        parts = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or parts)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the hash that deals rows to partitions, so slice s lies in partition s mod parts. With another one results are the same, but a task compiles more
    return F.pmod(F.hash("_d", "_t"), F.lit(parts * (-(-size // (SLICE * parts)) or 1)))


def confirmed(docs: DataFrame, r: repeats.Rule) -> DataFrame:
    """_s, a, phrase: anchor phrases found in two documents or more, as hash and as characters, for each slice with one. Each block of texts sends a phrase once a slice."""
    length = r.lengths[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            values, begin, end = r.symbols(scan.Scan(scan.texts(batch)))
            a, _, _, _, doc, anchor = repeats.anchored(values, begin, np.maximum(end - begin - r.window + 1, 0), r.window, length)
            if not len(a):
                continue
            d, s = batch.column("_d").to_numpy()[doc], batch.column("_s").to_numpy()[doc]
            order = np.lexsort((d, s, a))
            a, d, s, anchor = a[order], d[order], s[order], anchor[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
            last = np.append(first[1:], len(a)) - 1
            text = letters(values)[anchor[first][:, None] + np.arange(length)].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(scan.signed(a[first])), pa.array([text[k : k + LETTERS * length] for k in range(0, len(text), LETTERS * length)]), pa.array(d[first]), pa.array(d[last]), pa.array(s[first])], ["a", "phrase", "lo", "hi", "_s"])

    found = docs.select("text", "_d", "_s").mapInArrow(run, "a long, phrase string, lo long, hi long, _s int")
    found = found.groupBy("a").agg(F.first("phrase").alias("phrase"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("_s").alias("_s"))
    return found.where("lo < hi").select(F.explode("_s").alias("_s"), "a", "phrase")


def store(phrases: DataFrame) -> str:
    """Write the phrases to a new shared folder, by slice; its URI."""
    root = checkpoint_dir(phrases.sparkSession).rstrip("/")
    path = f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/bookflow/phrases-{uuid.uuid4().hex}"
    phrases.withColumnRenamed("_s", "slice").repartition("slice").write.partitionBy("slice").parquet(path)
    return path


_automata: dict[tuple[str, int], list[tuple[ahocorasick.Automaton, np.ndarray]]] = scan.keep({})


def automata(path: str, part: int, per_shard: int) -> list[tuple[ahocorasick.Automaton, np.ndarray]]:
    """The automata of a slice, each with the sorted hashes of its phrases; held until another slice is read."""
    key = (path, part)
    if key not in _automata:
        _automata.clear()
        fs, folder = pafs.FileSystem.from_uri(f"{path}/slice={part}")
        made = []
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            table = pq.read_table(folder, filesystem=fs, partitioning=None)
            for lo in range(0, len(table), per_shard):
                shard, machine = table.slice(lo, per_shard), ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
                for phrase in shard.column("phrase").to_pylist():
                    machine.add_word(phrase)
                machine.make_automaton()
                made.append((machine, np.sort(shard.column("a").to_numpy())))
        _automata[key] = made
    return _automata[key]


def located(values: np.ndarray, begin: np.ndarray, end: np.ndarray, part: np.ndarray, length: int, path: str, per_shard: int) -> np.ndarray:
    """Flags of the words where a phrase stored for the slice of a text (`part`) starts inside it."""
    flags = np.zeros(len(values) + 1, bool)
    if len(values) < length:
        return flags
    rank = scan.signed(scan.mix(scan.Ranges(values).fixed(length)))
    codes = letters(values).tobytes().decode()
    long_ = end - begin >= length
    for s in np.unique(part[long_]).tolist():
        bounds = [(LETTERS * b, LETTERS * e) for b, e in zip(begin[long_ & (part == s)].tolist(), end[long_ & (part == s)].tolist())]
        for machine, hashes in automata(path, s, per_shard):
            at = np.array([at for b, e in bounds for at, _ in machine.iter(codes, b, e)], np.int64)
            start = (at[at % LETTERS == LETTERS - 1] + 1) // LETTERS - length  # a hit that ends elsewhere lies between words
            place = np.minimum(np.searchsorted(hashes, rank[start]), len(hashes) - 1)
            flags[start[hashes[place] == rank[start]]] = True
    return flags


def remove_passages(docs: DataFrame, window: int = 50, per_shard: int = PER_SHARD) -> DataFrame:
    """`docs` with its columns, plus n_words, n_removed and kept (the words that stay, joined by single spaces).

    A word goes if a window that covers it also starts in a document of smaller id; a repeat in the same document does not count, nor
    does one in another row of the same id. A null or empty text, or one shorter than a window, keeps all words.
    """
    r, names = rule(window), ["n_words", "n_removed", "kept"]
    docs = docs.drop(*names)
    own, length = docs.columns, r.lengths[0]
    named = repeats.named(docs)
    of = slices(named)
    path = store(confirmed(named.withColumn("_s", of), r))

    def keep(part, values, begin, end, anchor):
        return located(values, begin, end, part.column("_s").to_numpy(), length, path, per_shard)[anchor]

    dealt = repeats.dealt(named)
    by_slice = dealt.withColumn("_s", of).sortWithinPartitions("_s")  # a task may read several partitions
    found = repeats.find(dealt, r, repeats.first_round(by_slice, r, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches):
            words = [t.split() for t in scan.texts(batch)]
            n = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(n)
            begin = end - n
            gone = repeats.covered(batch, r, begin, int(n.sum()))
            total, stay = np.append(0, np.cumsum(gone)), ~gone
            kept = [b" ".join(itertools.compress(ws, stay[b:e])).decode() for ws, b, e in zip(words, begin, end)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n), pa.array(total[end] - total[begin]), pa.array(kept, pa.string())], [*own, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names[:2]), T.StructField("kept", T.StringType())])
    return found.select(*own, *repeats.columns(r)).mapInArrow(run, schema)


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    out = remove_passages(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
