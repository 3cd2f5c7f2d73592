"""Price-range, cleaning and text filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bookflow.functions import MISSING_LEVEL, is_finite


def unpivot_mask(wide: DataFrame, day_col: str = "trade_date", day: int | None = None) -> DataFrame:
    """One 0/1 column per security to (trade_date, security_id, is_liquid)."""
    if day is not None:
        wide = wide.filter(F.col(day_col) == day)
    names = [c for c in wide.columns if c != day_col]
    return wide.unpivot([day_col], names, "security_id", "is_liquid").withColumnRenamed(day_col, "trade_date")


def level_range(levels: Column, level: int) -> tuple[Column, Column]:
    """Lowest bid and highest ask of the first `level` levels; an absent level (-1 or NULL) opens that side."""
    book = levels[level - 1]
    side = lambda price, far: F.when(price.isNull() | (price == -1), F.lit(far)).otherwise(price)
    return side(book["bid_p"], -MISSING_LEVEL), side(book["ask_p"], MISSING_LEVEL)


def filter_by_level(tape: DataFrame, level: int) -> DataFrame:
    """Messages priced inside the first `level` levels of their book."""
    low, high = level_range(F.col("levels"), level)
    return tape.filter(F.col("price").between(low, high))


def cut_to_level(tape: DataFrame, level: int) -> DataFrame:
    """Messages inside the first `level` levels, with the book cut to those levels."""
    return filter_by_level(tape, level).withColumn("levels", F.slice("levels", 1, level))


def finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where all of `cols` are finite numbers."""
    for col in cols:
        df = df.filter(is_finite(F.col(col)))
    return df


def clean_lines(df: DataFrame, n: int, text: str = "text", order: Sequence[str] = ("line_no",)) -> DataFrame:
    """First n non-empty lines without leading numbering and quotes; fails if there are fewer."""
    outer = "^[\\s\"'\u201c\u201d]+|[\\s\"'\u201c\u201d]+$"
    bare = F.regexp_replace(F.regexp_replace(F.col(text), r"^\s*\d+\.\s*", ""), outer, "")
    kept = df.withColumn(text, bare).filter(F.col(text) != "").orderBy(*order).limit(n)
    found = kept.agg(F.count(F.lit(1)).alias("_found"))
    enough = F.when(F.col("_found") >= n, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"fewer than {n} lines")).cast("boolean"))
    return kept.crossJoin(F.broadcast(found)).filter(enough).drop("_found")


def reasonable(text: Column, longest: int = 30) -> Column:
    """Trimmed text that is not empty, has no control characters, at most `longest` characters and an alphanumeric one."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return ((F.length(trimmed) > 0) & ~trimmed.rlike(r"[\x00-\x1F]") & (F.length(trimmed) <= longest)
            & trimmed.rlike(r"[\p{L}\p{N}]"))
