"""Operator 2, n-gram Jaccard join with a prefix filter under one global order and parities of the sets.

Documents with one set of shingles are one node. Tokens (shingles) are ordered by how common they are, in classes of a sketch of fixed size over all
documents, and inside a class by a hash. Two sets of similarity t share a token among the first n - ceil(t n) + 1 of each, so

1. buckets of the prefix tokens hold all candidates; buckets with the same members are one;
2. a member stays in a bucket only if its parity allows a link with another member there;
3. each node goes once to its largest bucket, where links are found inside bounded chunks, set against set, and give classes;
4. in buckets that still hold several classes, one member is held against those of other classes, then all pairs of different classes; parities
   must allow a link before texts are fetched and compared.

Parities: every token of a set flips one of 512 bits, in sets of over WIDE tokens one of at least two bits for three tokens, so two sets differ in at
least as many tokens as their parities differ in bits. No link is lost by it, and chance meetings, which grow faster than the input, end before texts
are moved for them, however long the texts are.

Inside a class no pair needs comparing, so a large group of near copies costs its size, not its square; no candidate is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bookflow.llm import components, scan, url_filter
from bookflow.session import stage

BITS, PIECES = 23, 256
CELLS = 1 << BITS
NO_ID = -(2**63)
CHUNK = 600_000  # tokens of the sets that one task compares at once
MEMBERS = 4096  # and sets
GROUP = 4096
BLOCK = scan.BLOCK // 4  # bytes of text handled at once; the sets of all that a worker has seen at once stay in its memory
MET = 1 << 20  # sets that a task remembers having sent
PARITY = [f"par{k}" for k in range(8)]  # columns of 64 bits
WIDE = 768  # tokens; the parity of a larger set has more bits
ROOM = 1 << 24  # bytes of a bucket's parities that a task holds at once
WORDS = 1 << 20  # of 64 bits, the most that a filter of wanted texts has


def sets(docs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted inside each, their texts, and the number of each text."""
    s = scan.Scan(docs, lower=True)
    token, doc = scan.shingles(s.words(), s.first_word, k)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, doc, np.bincount(doc, minlength=len(docs))


def set_keys(token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each set."""
    key = np.zeros(len(n), np.uint64)
    np.add.at(key, doc, scan.mix(token))
    return scan.signed(scan.mix(key + n.astype(np.uint64)))


def _cell(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - BITS)).astype(np.int64)


def rarity(docs: DataFrame, k: int) -> bytes:
    """Class of each cell: ten steps for each doubling of its count of (document, shingle). CELLS bytes, whatever the corpus; summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in scan.blocks(batches, BLOCK):
            token = sets(scan.texts(batch), k)[0]
            if total is None:
                total = np.zeros(CELLS, np.uint32)
            cell, n = np.unique(_cell(token), return_counts=True)
            total[cell] += n.astype(np.uint32)
        if total is not None:
            size = CELLS // PIECES
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(total[p * size : (p + 1) * size].astype(np.uint64).tobytes(), 1) for p in range(PIECES)], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), np.uint64)
                sums[p] = sums[p] + part if p in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema)
    out = np.zeros(CELLS, np.uint8)
    for row in summed.collect():  # PIECES rows of a fixed size
        part = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
        out[row["piece"] * len(part) : (row["piece"] + 1) * len(part)] = np.minimum(np.ceil(10 * np.log2(part.astype(float) + 1)), 255).astype(np.uint8)
    return out.tobytes()


def prefixes(token: np.ndarray, doc: np.ndarray, sizes: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of every set, and their sets."""
    key = (classes[_cell(token)].astype(np.uint64) << np.uint64(56)) | (scan.mix(token) >> np.uint64(8))
    by = np.lexsort((key, doc))
    length = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
    rank = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = by[rank < length[doc]]
    return token[taken], doc[taken]


def parities(token: np.ndarray, doc: np.ndarray, n_docs: int, bits: int = 512) -> np.ndarray:
    """`bits` (a power of two) bits of each set as signed 64-bit values: whether an odd number of its tokens falls on a bit."""
    bit = (scan.mix(token + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(doc * bits + bit, minlength=n_docs * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n_docs, bits // 64)


def wide_parities(token: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Of sets of more than WIDE tokens: a parity of at least two bits for three tokens."""
    out: list[bytes | None] = [None] * len(sizes)
    step = np.ceil(np.log2(np.maximum(sizes, WIDE) / WIDE)).astype(np.int64)
    for s in np.unique(step[sizes > WIDE]):
        at = np.flatnonzero((step == s) & (sizes > WIDE))
        mine = np.isin(doc, at)
        for d, made in zip(at, parities(token[mine], np.searchsorted(at, doc[mine]), len(at), 512 << int(s))):
            out[d] = made.tobytes()
    return out


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def wide_may_link(a: bytes | None, b: bytes | None, total: int, percent: int) -> bool:
    """Whether wide parities allow a link of two sets of `total` tokens together; without both, yes."""
    return a is None or b is None or (100 + percent) * bits_apart(a, b) <= (100 - percent) * total


def may_link(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether sizes and parities of two sets allow a link. `a(c)` and `b(c)` are column c of each."""
    differ = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in PARITY), F.lit(0))
    sized = F.lit(100) * F.least(a("n"), b("n")) >= F.lit(percent) * F.greatest(a("n"), b("n"))
    return sized & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (a("n") + b("n")))


def profile(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), n, key (of the set), first (prefix tokens; none for a set the task has met), PARITY (null likewise) and wide (null likewise and for smaller sets), of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, met = np.frombuffer(shared.value, np.uint8), np.zeros(MET, np.int64)
        for batch in scan.blocks(batches, BLOCK):
            token, doc, n = sets(scan.texts(batch), k)
            key = set_keys(token, doc, n)
            slot = key & (MET - 1)
            fresh = (n > 0) & (met[slot] != key)
            fresh[np.setdiff1d(np.arange(len(key)), np.unique(key, return_index=True)[1])] = False
            met[slot] = key
            token, doc, n = token[fresh[doc]], doc[fresh[doc]], n.astype(np.int64)
            sizes = np.where(fresh, n, 0)
            odd = parities(token, doc, len(n))
            t, d = prefixes(token, doc, sizes, classes, percent)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(d, minlength=len(n)))).astype(np.int32))
            first = pa.ListArray.from_arrays(offsets, pa.array(scan.signed(t)))
            wide = pa.array(wide_parities(token, doc, sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n), pa.array(key), first, *(pa.array(odd[:, c], mask=~fresh) for c in range(8)), wide], ["doc_id", "t", "n", "key", "first", *PARITY, "wide"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n long, key long, first array<long>, " + ", ".join(f"{c} long" for c in PARITY) + ", wide binary")


def buckets(rows: DataFrame) -> DataFrame:
    """bucket, key, n from rows (tok, key, n): tokens that two nodes or more share. Buckets up to GROUP are named by their members, larger ones by their token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        tok, key, n, large = empty, empty, empty, None  # rows of the last token so far; the token that has outgrown GROUP
        def out(name, key, n):
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(key), pa.array(n)], ["bucket", "key", "n"])
        def groups(tok, key, n):
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            size = np.diff(np.append(first, len(tok)))
            total = np.add.reduceat(scan.mix(key.view(np.uint64)), first)
            name = np.repeat(scan.signed(scan.mix(total + size.astype(np.uint64))), size)
            keep = np.repeat(size > 1, size)
            order = np.lexsort((key[keep], name[keep]))
            name, key, n = name[keep][order], key[keep][order], n[keep][order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1])
            return out(name[new], key[new], n[new])
        for batch in batches:
            t, x, m = (np.concatenate([old, batch.column(c).to_numpy()]) for c, old in enumerate((tok, key, n)))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
            t, x, m = t[new], x[new], m[new]
            if large is not None:
                stop = int(np.searchsorted(t != large, True)) if (t != large).any() else len(t)
                if stop:
                    yield out(t[:stop], x[:stop], m[:stop])
                if stop == len(t):
                    tok, key, n = t[:0], x[:0], m[:0]
                    continue
                t, x, m, large = t[stop:], x[stop:], m[stop:], None
            last = int(np.flatnonzero(np.append(True, t[1:] != t[:-1]))[-1])
            if last:
                yield groups(t[:last], x[:last], m[:last])
            tok, key, n = t[last:], x[last:], m[last:]
            if len(tok) > GROUP:
                yield out(tok, key, n)
                large, tok, key, n = tok[0], tok[:0], key[:0], n[:0]
        if len(tok):
            yield groups(tok, key, n)
        scan.give_back()

    return rows.repartition("tok").sortWithinPartitions("tok", "key").mapInArrow(run, "bucket long, key long, n long").dropDuplicates(["bucket", "key"])


def may_meet(bucket: np.ndarray, n: np.ndarray, odd: np.ndarray, wide: list[bytes | None], percent: int) -> np.ndarray:
    """Of rows sorted by bucket and n: whether sizes and parities allow a link with another row of the bucket. odd: PARITY, a row each."""
    stays = np.zeros(len(n), bool)
    left, step = np.arange(len(n)), 0
    while True:
        step += 1
        left = left[left + step < len(n)]
        left = left[(bucket[left] == bucket[left + step]) & (100 * n[left] >= percent * n[left + step])]  # later rows of the bucket are larger still
        if not len(left):
            return stays
        i = left[~(stays[left] & stays[left + step])]
        j = i + step
        total = n[i] + n[j]
        ok = (100 + percent) * np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= (100 - percent) * total
        for at in np.flatnonzero(ok):
            ok[at] = wide_may_link(wide[i[at]], wide[j[at]], int(total[at]), percent)
        stays[i[ok]] = stays[j[ok]] = True


def plausible(rows: DataFrame, percent: int) -> DataFrame:
    """bucket, key, n from rows (bucket, key, n, PARITY, wide): without members that parities allow no link in their bucket. Buckets are named by the
    members left; those that outgrow GROUP rows or ROOM bytes stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large = None, None  # rows of the last bucket so far; the bucket that has outgrown its bounds

        def judged(part: pa.RecordBatch) -> pa.RecordBatch:
            bucket, key, n = (part.column(c).to_numpy() for c in ("bucket", "key", "n"))
            odd = np.stack([part.column(c).to_numpy() for c in PARITY], axis=1).view(np.uint64)
            stays = may_meet(bucket, n, odd, part.column("wide").to_pylist(), percent)
            bucket, key, n = bucket[stays], key[stays], n[stays]
            if len(bucket):
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                size = np.diff(np.append(first, len(bucket)))
                bucket = np.repeat(scan.signed(scan.mix(np.add.reduceat(scan.mix(key.view(np.uint64)), first) + size.astype(np.uint64))), size)
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key), pa.array(n)], ["bucket", "key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            bucket = batch.column("bucket").to_numpy()
            if large is not None:
                stop = int(np.searchsorted(bucket, large, "right"))
                yield batch.slice(0, stop).select(["bucket", "key", "n"])
                if stop == len(bucket):
                    rest = None
                    continue
                batch, bucket, large = batch.slice(stop), bucket[stop:], None
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last:
                yield judged(batch.slice(0, last))
            rest = batch.slice(last)
            if rest.num_rows > GROUP or rest.nbytes > ROOM:
                yield rest.select(["bucket", "key", "n"])
                rest, large = None, bucket[-1]
        if rest is not None:
            yield judged(rest)
        rest = None
        scan.give_back()

    return rows.select("bucket", "key", "n", *PARITY, "wide").repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(run, "bucket long, key long, n long").dropDuplicates(["bucket", "key"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def classes_of(sets_: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest position in the class of each set; every set is held against all others that share a token with it."""
    root = list(range(len(sets_)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(x) for x in sets_])
    token, which = np.unique(np.concatenate(sets_), return_inverse=True)
    doc = np.repeat(np.arange(len(sets_)), size)
    by = np.argsort(which, kind="stable")
    head = np.searchsorted(which[by], np.arange(len(token) + 1))
    start = np.cumsum(size) - size
    for i in range(1, len(sets_)):
        mine = which[start[i] : start[i] + size[i]]
        # sets before this one that share tokens with it, by the lists of those tokens
        lists = [doc[by[head[w] : head[w + 1]]] for w in mine]
        shared = np.bincount(np.concatenate(lists), minlength=len(sets_))[:i]
        for j in np.flatnonzero(100 * shared >= percent * (size[:i] + size[i] - shared)):
            a, b = top(int(j)), top(i)
            root[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(len(sets_))])


def _maybe(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """`docs` plus boolean _maybe: false only if (_d, _t) is surely none of `listed`, by a Bloom filter of at most WORDS words."""
    key = F.concat_ws(" ", "_d", "_t")
    words = url_filter.bloom(listed.select(key.alias("_k")), "_k", WORDS).select(F.col("word").alias("_w"), F.col("bits").alias("_bits"))
    word, mask = url_filter._word_and_mask(key, WORDS)
    return docs.withColumn("_w", word).join(F.broadcast(words), "_w", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_w", "_bits")


def with_text(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (at: doc_id and hash of a text, key and more) plus text; most texts of other documents stay out of the shuffle. Rows that share an id meet only those of their text."""
    wanted = wanted.select(F.col("at.doc_id").alias("_d"), F.col("at.t").alias("_t"), *(c for c in wanted.columns if c != "at"))
    own = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), "text")
    found = _maybe(own, wanted).where("_maybe").drop("_maybe").join(wanted, ["_d", "_t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches, BLOCK):
            yield batch.filter(pa.array(set_keys(*sets(scan.texts(batch), k)) == batch.column("key").to_numpy()))

    return found.mapInArrow(run, found.schema)


def local_classes(placed: DataFrame, k: int, percent: int) -> DataFrame:
    """key, root from rows (bucket, chunk, key, text), sorted by chunk: links inside each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, held = None, [], []

        def close():
            order = np.argsort(np.array(keys), kind="stable")
            names = np.array(keys)[order]
            made = classes_of([held[i] for i in order], percent)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[made])], ["key", "root"])

        for batch in scan.blocks(batches, BLOCK):
            token, _, n = sets(scan.texts(batch), k)
            cut = np.split(token, np.cumsum(n)[:-1])
            for b, c, x, s in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("key").to_pylist(), cut):
                if here is not None and here != (b, c):
                    yield close()
                    keys, held = [], []
                here = (b, c)
                if not keys or keys[-1] != x:
                    keys.append(x)
                    held.append(s.copy())
        if keys:
            yield close()
        keys, held = [], []
        scan.give_back()

    return placed.select("bucket", "chunk", "key", "text").repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "key").mapInArrow(run, "key long, root long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: first those whose wide parities allow it, then by their texts."""
    side = lambda c: nodes.where("wide is not null").select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, left, right = (batch.column(c).to_pylist() for c in ("total", "wa", "wb"))
            yield batch.select(["a", "b"]).filter(pa.array([wide_may_link(x, y, m, percent) for m, x, y in zip(total, left, right)], pa.bool_()))

    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "wa", "wb")
    near = stage(met.mapInArrow(narrow, "a long, b long"), "near-pairs")
    ends = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct()
    texts = stage(with_text(docs, nodes.join(ends, "key").select("at", "key"), k).select("key", "text").dropDuplicates(["key"]), "pair-texts")
    full = near.join(texts.select(F.col("key").alias("b"), F.col("text").alias("_b")), "b").join(texts.withColumnRenamed("key", "a"), "a").select("a", "b", "text", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches, BLOCK):
            both = [x or b"" for x in batch.column("_b").cast(pa.binary()).to_pylist()]
            left, right = (np.split(t, np.cumsum(n)[:-1]) for t, _, n in (sets(scan.texts(batch), k), sets(both, k)))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(left, right)], pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """key, root after links between keys: roots that the links join become the smallest of them."""
    of = lambda c: roots.select(F.col("key").alias(c), F.col("root").alias(f"_{c}"))
    joined = components.components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    found = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left")
    return stage(found.select("key", F.coalesce("_new", "root").alias("root")), "classes")


def real_id() -> Column:
    return F.nullif("doc_id", F.lit(NO_ID).cast("long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links, itself included.

    Two texts link when 100 * shared >= percent * union over their distinct k-word shingles, A-Z lower-cased. A text without a word, or null, has
    no shingles and is alone; one of fewer than k words has one shingle. Rows that share an id are judged each by its own text.
    A null id is never the smallest of a class, unless the class has no other. An empty table gives no rows.
    """
    prof, by_key = classified(docs, k, percent)
    probe = prof.select(real_id().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("_key"))
    return probe.join(by_key.select(F.col("key").alias("_key"), F.col("least.doc_id").alias("_least")), "_key", "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def classified(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The profile of every row, with NO_ID for a null id, and of each set: key, root, least (the smallest doc_id of its class and the smallest t of that id), lost (the smallest t of its rows without an id)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"), "text")
    real = real_id()
    prof = stage(profile(docs, k, percent), "profiles")
    nodes = stage(prof.where("n > 0").groupBy("key").agg(F.max(F.struct("doc_id", "t")).alias("at"), F.max("n").alias("n"), *(F.max(c).alias(c) for c in (*PARITY, "wide")), F.min(F.when(real.isNotNull(), F.struct("doc_id", "t"))).alias("least"), F.min(F.when(real.isNull(), F.col("t"))).alias("lost")), "nodes")
    rows = prof.where(F.size("first") > 0).select(F.explode("first").alias("tok"), "key", "n")
    met = buckets(rows).join(nodes.select("key", *PARITY, "wide"), "key")
    shared = stage(plausible(met, percent), "buckets")
    stats = shared.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    chosen = stage(shared.join(stats, "bucket").groupBy("key").agg(F.max(F.struct("size", "bucket")).alias("_c"), F.max("n").alias("n")).select("key", "n", F.col("_c.bucket").alias("bucket")), "largest")
    # members of a group that miss its largest bucket follow the others of theirs
    common = shared.select("bucket", "key").join(chosen.select("key", F.col("bucket").alias("_of")), "key").groupBy("bucket").agg(F.mode("_of", True).alias("_home"))
    moved = stage(chosen.join(common, "bucket").select("key", "n", F.col("_home").alias("bucket")), "moved")
    filled = moved.groupBy("bucket").agg(F.greatest(F.sum("n") / F.lit(CHUNK), F.count("*") / F.lit(MEMBERS)).alias("_parts"))
    home = stage(moved.join(filled, "bucket").select("key", "bucket", F.pmod(F.xxhash64("key"), F.ceil("_parts").cast("long")).alias("chunk")), "homes")
    placed = with_text(docs, nodes.join(home, "key").select("at", "key", "bucket", "chunk"), k)
    roots = stage(local_classes(placed, k, percent).groupBy("key").agg(F.min("root").alias("root")), "classes")
    # members that went to one chunk have been compared there; a bucket whose members all did is settled
    at = shared.join(home.select("key", F.struct("bucket", "chunk").alias("home")), "key")
    unsettled = at.groupBy("bucket").agg(F.min("home").alias("_lo"), F.max("home").alias("_hi")).where("_lo <> _hi").select("bucket")
    rest = stage(at.join(unsettled, "bucket", "left_semi").join(nodes.select("key", *PARITY), "key"), "open-buckets")
    for exhaustive in (False, True):
        now = rest.join(roots, "key")
        mixed = now.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min_by(F.struct("key", "n", "root", "home", *PARITY), F.xxhash64("key")).alias("_hub")).where("_lo <> _hi")
        if exhaustive:
            open_ = now.join(mixed.select("bucket"), "bucket")
            pairs = open_.join(open_.select("bucket", F.struct("key", "n", "root", "home", *PARITY).alias("_o")), "bucket").where(F.col("key") < F.col("_o.key"))
        else:
            pairs = now.join(mixed.select("bucket", F.col("_hub").alias("_o")), "bucket")
        pairs = pairs.where((F.col("root") != F.col("_o.root")) & (F.col("home") != F.col("_o.home")) & may_link(F.col, lambda c: F.col(f"_o.{c}"), percent))
        pairs = pairs.select(F.least("key", "_o.key").alias("a"), F.greatest("key", "_o.key").alias("b"))
        roots = _merge(roots, stage(verified(pairs.distinct(), nodes, docs, k, percent), "links"))
    named = nodes.select("key", "least", "lost").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return prof, named.select("key", "root").join(named.groupBy("root").agg(F.min("least").alias("least"), F.min("lost").alias("lost")), "root")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, with the columns of `docs`: of its smallest doc_id, of texts of that id the one of smallest hash, of equal rows any.

    Every row is judged by its own text. Rows without an id are a choice of their own: one of each class stays beside the one with an id.
    Rows without a word all stay.
    """
    prof, by_key = classified(docs, k, percent)
    first = F.when(F.col("doc_id") == NO_ID, F.col("t") == F.col("lost")).otherwise((F.col("doc_id") == F.col("least.doc_id")) & (F.col("t") == F.col("least.t")))
    judged = prof.where("n > 0").select("doc_id", "t", "key").join(by_key, "key").select(F.col("doc_id").alias("_d"), "t", first.alias("stays")).groupBy("_d", F.col("t").alias("_t")).agg(F.min("stays").alias("_stays"), F.count("*").alias("_n"))
    listed = stage(judged.where("not _stays or _n > 1").select("_d", "_t", "_stays"), "near-copies")
    own = scan.set_aside(docs)
    order = own.columns
    marked = _maybe(own.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))).withColumn("_t", F.xxhash64("text")), listed)
    lone = marked.where("not _maybe").unionByName(marked.where("_maybe").join(listed.select("_d", "_t"), ["_d", "_t"], "left_anti")).select(*order)
    once = marked.where("_maybe").join(listed.where("_stays").select("_d", "_t"), ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).select(*order)
    return lone.unionByName(once).toDF(*docs.columns)
