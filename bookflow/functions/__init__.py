"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the feed formats.
MISSING_LEVEL = 9_999_999_999
BID, ASK = 49, 50
CANCEL, CANCEL_BID, CANCEL_ASK = 99, 97, 98
DONE_BID, DONE_ASK = 129, 130
EXEC_CANCEL, EXEC_TRADE = 52, 70
ORD_LIMIT = 50
PRICE_SCALE = 10_000
TICK_INT = 100


def div(value: Column, by: int | Column) -> Column:
    """Integer division of non-negative integers."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


PRIME = 2_147_483_647


def toss(x):
    """Pseudo-random whole numbers below PRIME from non-negative whole numbers (columns or arrays), in integer arithmetic that any engine has."""
    x = x % PRIME
    return (x * x + 5 * x + 1_013_904_223) % PRIME


def _six(text: Column) -> Column:
    """Zeros in front up to six characters; longer codes stay whole."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def norm_security(code: Column, suffix: str = "_XSHE") -> Column:
    """`617` -> `000617_XSHE`; codes that carry the suffix already stay."""
    text = F.trim(code.cast("string"))
    return F.when(text.endswith(suffix), text).otherwise(F.concat(_six(text), F.lit(suffix)))


def bare_security(code: Column) -> Column:
    """`000617_XSHE` -> `000617`, six digits at least."""
    return _six(F.split(F.trim(code.cast("string")), "_")[0])


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value.cast("double"))


def clock_ms(text: Column) -> Column:
    """`HH:MM:SS[.fff...]` to milliseconds since midnight; NULL when the clock part is malformed."""
    pattern = r"^\s*(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("long")
    frac = F.substring(F.rpad(F.regexp_extract(text, pattern, 4), 3, "0"), 1, 3).try_cast("long")
    valid = (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    return F.when(valid, part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + frac)


def number(text: Column) -> Column:
    """Text to a finite double, else NULL."""
    return finite_or_null(text.try_cast("double"))


def edge_bin(value: Column, edges: Column) -> Column:
    """Right-closed bin of `value` between sorted `edges`: NULL to the lowest, clipped at both ends."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.greatest(F.lit(0), F.least(F.coalesce(below, F.lit(0)) - 1, F.size(edges) - 2)).cast("int")


def edge_group(value: Column, edges: Column) -> Column:
    """Number of `edges` that are <= `value`."""
    return F.size(F.filter(edges, lambda e: e <= value)).cast("long")


def literal_edges(edges: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(e)) for e in edges])
