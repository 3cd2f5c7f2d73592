"""Sequences, sub-sequences and scoring functions over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bookflow.functions import div
from bookflow.operators.micro import BY
from bookflow.operators.ordered import join_key_stats

SEQUENCE_KEYS = ("date", "real_id", "gen_id", "kind")


def subseqs(tape: DataFrame, *, n: int | None = None, length: int | None = None, every_ns: int | None = None,
            by: Sequence[str] = BY, run: Sequence[str] | None = None) -> DataFrame:
    """Add `sub_id`: by count (length is the real rows of the run // n), by length, or by time interval.

    Sub-sequences by count keep a last shorter one, as the length is rounded down. Time intervals are
    closed left and aligned to midnight; `sub_id` counts from the first interval of the key.
    """
    if sum(x is not None for x in (n, length, every_ns)) != 1:
        raise ValueError("give exactly one of n, length, every_ns")
    if length is not None:
        return tape.withColumn("sub_id", div(F.col("row_seq"), length))
    if n is not None:
        run = list(run or [c for c in by if c != "kind"])
        sizes = tape.groupBy(*run).agg(F.sum((F.col("kind") == "real").cast("long")).alias("_real"))
        return join_key_stats(tape, sizes, run).withColumn("sub_id", div(F.col("row_seq"), div(F.col("_real"), n))).drop("_real")
    bar = div(F.col("t_ns"), every_ns)
    first = tape.groupBy(*by).agg(F.min(bar).alias("_first"))
    return join_key_stats(tape, first, by).withColumn("sub_id", bar - F.col("_first")).drop("_first")


def score(tape: DataFrame, fn: Callable[[DataFrame, list[str]], DataFrame], by: Sequence[str] = BY) -> DataFrame:
    """Apply `fn(rows, keys)` to every sequence or sub-sequence; keys include `sub_id` when present."""
    keys = [*by, *(["sub_id"] if "sub_id" in tape.columns else [])]
    return fn(tape, keys)


def score_sequences(tape: DataFrame, fn: Callable[[DataFrame, list[str]], DataFrame], keys: Sequence[str] = SEQUENCE_KEYS, **subseq) -> DataFrame:
    """Score table of a catalogue's sequences: date, real_id, gen_id, kind, sub_id and the columns of `fn`, one call for all sequences.

    A real sequence may have any number of generated ones; conditional sequences are scored like the others, and the distances leave them out.
    `subseq` cuts sequences (see `subseqs`); without it a sequence is one whole, sub_id 0.
    """
    cut = subseqs(tape, by=keys, run=[k for k in keys if k not in ("gen_id", "kind")], **subseq) if subseq else tape.withColumn("sub_id", F.lit(0).cast("long"))
    return fn(cut, [*keys, "sub_id"])


def score_with_python(tape: DataFrame, fn: Callable[[pd.DataFrame], float], keys: Sequence[str]) -> DataFrame:
    """Apply a pandas function to each sub-sequence. Keys must bound the rows of a group (use a length)."""
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tape.select(*keys).schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, fn(rows.sort_values("row_seq"))]], columns=[*keys, "score"])

    return tape.groupBy(*keys).applyInPandas(run, f"{key_schema}, score double")


def position_groups(tape: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Group id = position inside the sub-sequence."""
    first = tape.groupBy(*by, "sub_id").agg(F.min("row_seq").alias("_first"))
    return join_key_stats(tape, first, [*by, "sub_id"]).withColumn("grp", F.col("row_seq") - F.col("_first")).drop("_first")


def score_table(tape: DataFrame, score_col: str, group_col: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Long score table; the score itself is the group where none is given. Array scores give one row each."""
    is_array = tape.schema[score_col].dataType.typeName() == "array"
    value = F.explode(score_col) if is_array else F.col(score_col)
    out = tape.select(*by, "row_seq", value.alias("score"), *([F.col(group_col).alias("grp")] if group_col else []))
    return out if group_col else out.withColumn("grp", F.col("score"))
