"""Text helpers shared by all column expressions.

Lengths and cuts count UTF-16 units; a cut never splits a surrogate pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.constants import WS, WS_CHARS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled_columns(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with more columns, each computed once per row.

    A plain `withColumn` may be merged into what uses it, and an expression that lands in a lambda is then computed
    for every element. A generator of one row is never merged.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lits(values: list[str]) -> Column:
    """Array literal of strings."""
    return F.array(*[F.lit(v) for v in values])


def no_strings() -> Column:
    return F.array().cast("array<string>")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim_u(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_u(c) == "", F.lit(True))


def collapse_ws(c: Column) -> Column:
    return trim_u(F.regexp_replace(c, f"[{WS}]+", " "))


def len_u16(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def fits_u16(c: Column, limit: int) -> Column:
    return (F.char_length(c) <= limit) & (F.octet_length(F.encode(c, "UTF-16BE")) <= 2 * limit)


_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def cut_u16(c: Column, limit: int) -> Column:
    """Longest prefix of at most `limit` units.

    A character of two units gets a filler behind it, so that the cut counts it twice.
    """
    filled = F.regexp_replace(F.substring(c, 1, limit), f"({_ASTRAL})", "$1\uffff")
    return F.regexp_replace(F.substring(filled, 1, limit), f"{_ASTRAL}(?!\uffff)|\uffff", "")


def clip(c: Column, limit: int, tail: str) -> Column:
    """`c`, or its first `limit` units and `tail`; `c` is computed once."""
    return let(
        c,
        lambda x: F.when(fits_u16(x, limit), x).otherwise(
            F.concat(cut_u16(x, limit), F.lit(tail))
        ),
    )


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def truncate_log(c: Column, limit: int = 400) -> Column:
    """One-line form of a log text."""
    flat = F.translate(text_or_empty(c), "\r\n", "  ")
    return clip(flat, limit, "...")


def truncate_log_long(c: Column, limit: int = 1000) -> Column:
    return clip(text_or_empty(c), limit, "...[truncated]")
