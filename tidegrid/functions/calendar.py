"""Calendar parts, cycles, day/night."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import col


def time_parts(ts: str | Column) -> dict[str, Column]:
    t = col(ts)
    return {"hour": F.hour(t), "weekday": F.weekday(t) + 1, "day": F.dayofmonth(t), "month": F.month(t),
            "year": F.year(t), "day_of_year": F.dayofyear(t), "week": F.weekofyear(t)}


def cycle(part: Column, period: float) -> tuple[Column, Column]:
    angle = part * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def cyclic_parts(ts: str | Column) -> dict[str, Column]:
    p = time_parts(ts)
    out = {}
    for name, part, period in (("hour", p["hour"], 24), ("weekday", p["weekday"] - 1, 7), ("month", p["month"], 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(part, period)
    return out


def trunc(unit: str, ts: str | Column) -> Column:
    """``date_trunc`` that keeps the zone-less type."""
    return F.date_trunc(unit, col(ts)).cast("timestamp_ntz")


def from_millis(ms: str | Column) -> Column:
    return F.timestamp_millis(col(ms).cast("long")).cast("timestamp_ntz")


def to_millis(ts: str | Column) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def is_day_fixed(ts: str | Column, start: int = 6, end: int = 18) -> Column:
    h = F.hour(col(ts))
    return (h >= start) & (h < end)


def is_day_lamps(lamps: Sequence[str | Column]) -> Column:
    """Day while any lamp reports 1; unknown counts as off."""
    on = F.lit(False)
    for lamp in lamps:
        on = on | (F.coalesce(col(lamp).cast("int"), F.lit(0)) == 1)
    return on


def day_night(is_day: Column) -> Column:
    return F.when(is_day, "Day").otherwise("Night")


def winter(ts: str | Column) -> Column:
    return F.month(col(ts)).isin(12, 1, 2)


def weekend(ts: str | Column) -> Column:
    return F.weekday(col(ts)) >= 5
