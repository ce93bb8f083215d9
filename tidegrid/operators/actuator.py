"""Actuator dynamics and control quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cols, epoch, following, prev, row_frames, scan
from ..functions.calendar import trunc
from ..functions.stats import corr
from .stress import forward, hits


def edge_count(df: DataFrame, col: str, threshold: float, keys, order="ts", chunk="1 day") -> DataFrame:
    """Crossings of the threshold between consecutive known readings."""
    on = F.col(col) > threshold
    d = scan(df.where(F.col(col).isNotNull()), keys, order, {"_p": prev(on)}, chunk=chunk)
    return d.groupBy(*cols(keys)).agg(F.count_if(F.col("_p") != on).alias("edges"))


def duty_cycle(df: DataFrame, col: str, threshold: float, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    return forward(df, n, keys, lambda f: {"duty_cycle": hits(F.col(col) > threshold, f) / n * 100}, order, chunk=chunk)


def overshoot(col: str, setpoint: str) -> dict[str, Column]:
    e = F.col(col) - F.col(setpoint)
    return {"overshoot": F.when(e > 0, e).otherwise(0.0), "undershoot": F.when(e > 0, 0.0).otherwise(-e)}


def settled(df: DataFrame, col: str, setpoint: str, tolerance_pct: float, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """1 where this and the next ``n - 1`` readings stay within tolerance of this row's set-point, else 0."""

    def build(f):
        sp = F.col(setpoint)
        far = F.greatest(F.max(col).over(f) - sp, sp - F.min(col).over(f))
        return {"settled": F.when(far <= sp * tolerance_pct / 100, 1.0).otherwise(0.0)}

    return forward(df, n, keys, build, order, chunk=chunk)


def control_effort(df: DataFrame, col: str, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Sum of absolute steps inside each forward window."""
    d = scan(df, keys, order, {"_n": following(col)}, chunk=chunk).withColumn("_s", F.abs(F.col("_n") - F.col(col)))
    out = row_frames(d, keys, order, 0, n - 1, lambda w: {
        "_c": F.count(F.lit(1)).over(w.rowsBetween(0, n - 1)), "effort": F.sum("_s").over(w.rowsBetween(0, n - 2))}, chunk=chunk)
    return out.withColumn("effort", F.when(F.col("_c") == n, F.col("effort"))).drop("_n", "_s", "_c")


def synchronisation(df: DataFrame, a: str, b: str, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Rolling correlation of two actuators; 0 without variation."""

    def build(f):
        return {"sync": F.coalesce(corr(a, b, f), F.lit(0.0))}

    return forward(df, n, keys, build, order, chunk=chunk)


def oscillations(df: DataFrame, col: str, dead_band: float, keys, order="ts", chunk="1 day") -> DataFrame:
    """Sign changes of the second difference, both beyond the dead band."""
    x = F.col(col)
    d = row_frames(df, keys, order, 2, 1, lambda w: {
        "_b": F.lead(x).over(w) - 2 * x + F.lag(x).over(w), "_a": x - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w)}, chunk=chunk)
    a, b = F.col("_a"), F.col("_b")
    return d.groupBy(*cols(keys)).agg(F.count_if((F.abs(a) > dead_band) & (F.abs(b) > dead_band) & (F.signum(a) != F.signum(b))).alias("oscillations"))


def daily_summary(df: DataFrame, keys, averages: Sequence[str] = (), changes: Sequence[str] = (), on_hours: Mapping[str, float] | None = None,
                  ts: str = "ts", chunk="1 day") -> DataFrame:
    """Daily mean, number of changes and hours on; absent columns give NULL."""
    have, t = set(df.columns), epoch(ts)
    specs = {f"_p_{c}": prev(c) for c in changes if c in have}
    if on_hours:
        specs["_next"] = following(t)
    d = scan(df, keys, ts, specs, chunk=chunk) if specs else df
    null = F.lit(None).cast("double")
    aggs = [(F.avg(F.col(c).cast("double")) if c in have else F.max(null)).alias(f"{c}_avg") for c in averages]
    aggs += [(F.count_if(F.col(c) != F.col(f"_p_{c}")) if c in have else F.max(null.cast("long"))).alias(f"{c}_changes") for c in changes]
    for c, threshold in (on_hours or {}).items():
        held = F.when(F.col(c) > threshold, (F.col("_next") - t) / 3600e6) if c in have else null
        aggs.append(F.coalesce(F.sum(held), F.lit(0.0)).alias(f"{c}_on_hours"))
    return d.groupBy(*cols(keys), trunc("day", ts).alias("day")).agg(*aggs)


def movements(df: DataFrame, columns: Sequence[str], keys, order="ts", step: float = 5.0, chunk="1 day") -> DataFrame:
    """Moves above ``step`` between consecutive known positions, summed over the columns."""
    long = df.unpivot([*cols(keys), *cols(order)], list(columns), "_c", "_v").where(F.col("_v").isNotNull())
    d = scan(long, [*cols(keys), "_c"], order, {"_p": prev("_v")}, chunk=chunk)
    return d.groupBy(*cols(keys)).agg(F.count_if(F.abs(F.col("_v") - F.col("_p")) > step).alias("movements"))


def active_hours(df: DataFrame, test: Column, known: Column, keys, ts: str = "ts", weight: float = 1.0, name: str = "active_hours") -> DataFrame:
    """Share of known rows where the test holds x whole hours spanned x share of known rows x weight."""
    t = epoch(ts)
    n, on = F.count_if(known), F.count_if(known & test)
    hours = F.floor((F.max(t) - F.min(t)) / 3600e6)
    return df.groupBy(*cols(keys)).agg((on / F.greatest(n, F.lit(1)) * hours * n / F.count(F.lit(1)) * weight).alias(name))


def control_ratios(df: DataFrame, keys, temp: str, setpoint: str, vpd_hpa: str) -> DataFrame:
    """Heating-needed share, set-point deviations, VPD stress shares (bounds in kPa)."""
    t, s, v = F.col(temp), F.col(setpoint), F.col(vpd_hpa) / 10
    both = t.isNotNull() & s.isNotNull()
    return df.groupBy(*cols(keys)).agg(
        (F.count_if(t < s) / F.nullif(F.count_if(both), F.lit(0))).alias("heating_needed"), F.avg(F.abs(t - s)).alias("mean_deviation"),
        F.max(F.abs(t - s)).alias("max_deviation"), F.avg((v < 0.4).cast("int")).alias("vpd_low"), F.avg((v > 1.6).cast("int")).alias("vpd_high"))


def lamp_yield(df: DataFrame, keys, dli: str, lamps: Sequence[str], ts: str = "ts") -> DataFrame:
    """Total light integral per hour lamps were on."""
    t = epoch(ts)
    hours = (F.max(t) - F.min(t)) / 3600e6
    on = sum((F.coalesce(F.avg((F.col(c) > 0.5).cast("int")), F.lit(0.0)) for c in lamps), F.lit(0.0))
    return df.groupBy(*cols(keys)).agg((F.sum(dli) / F.nullif(on * hours, F.lit(0.0))).alias("dli_per_hour"))
