"""Numeric cleaning and scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite_or_null(c: Column | str) -> Column:
    """Double with NaN turned into NULL."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def to_number(c: Column | str) -> Column:
    """Text -> double with a comma allowed as decimal sign; NULL when it is no plain number.

    The pattern keeps out what the JVM reads as a number but is none here: ``1d``, ``1f``, hex.
    """
    x = F.col(c) if isinstance(c, str) else c
    text = F.replace(F.btrim(x.cast("string"), F.lit(" \t\r\n\f\v")), F.lit(","), F.lit("."))
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded value that keeps NULL (``least`` and ``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def is_flat(low: Column, high: Column) -> Column:
    """True when a range is too narrow, infinite or unknown to scale by."""
    span = high - low
    return ~F.coalesce((span >= 1e-12) & (span < float("inf")), F.lit(False))


CLOCK = r"^(-?)(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
MINUTE_CLOCK = r"^(-?)()(\d+):(\d{1,2}(?:\.\d+)?)$"


def clock_seconds(c: Column | str, minute_form: bool = False) -> Column:
    """``[-]h:mm:ss[.f]`` -> seconds, else NULL; ``minute_form`` also reads ``mm:ss``."""
    x = F.col(c) if isinstance(c, str) else c
    text = F.btrim(x.cast("string"))

    def read(pattern: str) -> Column:
        part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("double"), F.lit(0.0))
        total = part(2) * 3600 + part(3) * 60 + part(4)
        return F.when(
            text.rlike(pattern),
            F.when(F.regexp_extract(text, pattern, 1) == "-", -total).otherwise(total),
        )

    return F.coalesce(read(CLOCK), read(MINUTE_CLOCK)) if minute_form else read(CLOCK)
