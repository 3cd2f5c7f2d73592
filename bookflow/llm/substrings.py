"""Operator 4, substring dedup by distributed prefix doubling, on the UTF-8 bytes of texts (see `repeats`)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bookflow.llm import repeats, scan


def rule(length: int = 100) -> repeats.Rule:
    """Anchors of about a third, two thirds, five sixths and all of the length."""
    return repeats.Rule(False, length, tuple(sorted({max(1, length * share // 100) for share in (30, 64, 83, 100)})), True)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """`docs` with its columns, plus n_bytes, n_removed, n_spans and kept (binary: the bytes that stay).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or earlier in the same. A
    null or empty text keeps nothing and loses nothing; rows equal in id and text get equal results; strings never cross texts.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*names)
    own = docs.columns

    def made(batch: pa.RecordBatch, *found: pa.Array) -> list[pa.Array]:
        return [*(batch.column(c) for c in own), *found]

    return _judged(docs, length, made, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names[:3]), T.StructField("kept", T.BinaryType())]))


def _judged(docs: DataFrame, length: int, made: Callable[..., list[pa.Array]], schema: T.StructType) -> DataFrame:
    """Columns that `made` gives for each block from its own, n_bytes, n_removed, n_spans and kept: one Python worker a task, not two."""
    r, own = rule(length), docs.columns
    found = repeats.find(repeats.keyed(docs), r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.blocks(batches, repeats.PART):
            texts = scan.texts(batch)
            data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            end = np.cumsum(size + 1) - 1
            begin = end - size
            gone = repeats.covered(batch, r, begin, len(data))
            total = np.append(0, np.cumsum(gone))
            heads = np.append(0, np.cumsum(gone & ~np.append(False, gone[:-1])))  # a separator is never covered
            kept = [data[b:e][~gone[b:e]].tobytes() for b, e in zip(begin, end)]
            yield pa.RecordBatch.from_arrays(made(batch, pa.array(size), pa.array(total[end] - total[begin]), pa.array(heads[end] - heads[begin]), pa.array(kept, pa.binary())), schema.names)

    return found.select(*own, *repeats.columns(r)).mapInArrow(run, schema)


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    out = remove_repeats(docs.select("doc_id", "text"), length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut(docs: DataFrame, length: int = 100) -> DataFrame:
    """`docs` with its columns, without repeated strings in `text`; a character that is cut in two goes whole. n_chars, where there is one, follows. A null text becomes empty."""
    aside, schema = scan.set_aside(docs), docs.schema
    own = aside.columns

    def made(batch: pa.RecordBatch, *found: pa.Array) -> list[pa.Array]:
        texts = pa.array([x.decode(errors="ignore") for x in found[-1].to_pylist()], pa.string())
        return [texts if c == "text" else batch.column(c) for c in own]

    left = _judged(aside, length, made, schema)
    return left.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else left
