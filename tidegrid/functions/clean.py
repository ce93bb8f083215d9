"""Lenient parsing and value cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of on/off accepted in status columns, and the markers
# that stand for a missing value unless a source lists its own.
TRUE_WORDS = ("true", "1", "yes", "t", "y", "on")
FALSE_WORDS = ("false", "0", "no", "f", "n", "off", "-", "–")
NULL_MARKERS = ("", "NaN", "NULL", "N/A")  # numeric markers such as -1 are named by the spec of the files that use them


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_markers(c: str | Column, markers: Sequence[str] = NULL_MARKERS, boolean: bool = False) -> Column:
    """Markers to NULL; in a boolean column they mean "off"."""
    return F.when(col(c).isin(*markers), F.lit("false") if boolean else None).otherwise(col(c))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def finite(c: str | Column) -> Column:
    """NaN and both infinities to NULL."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) != float("inf")), col(c))


def finite_or_zero(c: str | Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def parse_decimal(c: str | Column) -> Column:
    """Decimal comma or point; anything else is NULL."""
    return F.trim(F.translate(col(c), ",", ".")).try_cast("double")


def parse_int(c: str | Column, tol: float = 1e-9) -> Column:
    """Whole numbers, also written as floats within ``tol`` of a whole number."""
    exact = F.trim(col(c)).try_cast("long")
    x = parse_decimal(c)
    return F.coalesce(exact, F.when(F.abs(x - F.round(x)) < tol, F.round(x).cast("long")))


def parse_bool(c: str | Column) -> Column:
    """On/off words; empty means off; unknown words are NULL."""
    word = F.lower(F.trim(col(c)))
    return F.when(word.isin(*TRUE_WORDS), True).when((word == "") | word.isin(*FALSE_WORDS), False)


def within(c: str | Column, low: float | None, high: float | None, *,
           open_low: bool = False, open_high: bool = False) -> Column:
    """Value if inside the physical range, else NULL."""
    x, ok = col(c), F.lit(True)
    if low is not None:
        ok = ok & ((x > low) if open_low else (x >= low))
    if high is not None:
        ok = ok & ((x < high) if open_high else (x <= high))
    return F.when(ok, x)


def replace_sentinels(c: str | Column, sentinels: Sequence[float]) -> Column:
    return F.when(~col(c).isin(*[float(s) for s in sentinels]), col(c))


def clip(c: str | Column, low: float | None, high: float | None) -> Column:
    """Clamp into [low, high]; NULL stays NULL."""
    x = col(c)
    if low is not None and high is not None and low > high:
        raise ValueError(f"reversed bounds {low} > {high}")
    out = x if low is None else F.greatest(x, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def recode_status(c: str | Column) -> Column:
    """0 stays 0, (0, 1] becomes 1, everything else NULL."""
    x = col(c)
    return F.when(x == 0, 0).when((x > 0) & (x <= 1), 1)


def bool_to_int(c: str | Column) -> Column:
    return col(c).cast("boolean").cast("int")


def available(c: str | Column) -> Column:
    return col(c).isNotNull().cast("int")
