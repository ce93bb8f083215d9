"""Stress counters over forward windows, recovery and clusters.

Forward windows cover this row and the ``n - 1`` after it; rows without a full
window get NULL. All measures of one call share a frame and a sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..frames import cols, epoch, last_valid, prev, row_frames, running_count, scan
from .growth import at_least_zero


def forward(df: DataFrame, n: int, keys, build: Callable[[WindowSpec], Mapping[str, Column]], order="ts", extra: int = 0,
            chunk="1 day") -> DataFrame:
    """Append measures over full forward windows of ``n`` rows."""
    names: list[str] = []

    def full(w):
        frame = w.rowsBetween(0, n - 1)
        made = dict(build(frame))
        names.extend(c for c in made if c not in names)
        return {"_full": F.count(F.lit(1)).over(frame), **made}

    out = row_frames(df, keys, order, 0, n - 1 + extra, full, chunk=chunk)
    return out.withColumns({c: F.when(F.col("_full") == n, F.col(c)) for c in names}).drop("_full")


def hits(test: Column, frame: WindowSpec) -> Column:
    return F.count(F.when(test, 1)).over(frame)


def counts_above(df: DataFrame, col: str, thresholds: Sequence[float], n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    x = F.col(col)
    return forward(df, n, keys, lambda f: {f"above_{i}": hits(x > t, f) for i, t in enumerate(thresholds)}, order, chunk=chunk)


def stress_windows(df: DataFrame, n: int, keys, order="ts", *, vpd: str | None = None, temp: str | None = None, light: str | None = None,
                   co2: str | None = None, step_h: float = 1.0, vpd_limit: float = 1.2, hot: float = 35.0, cold: float = 10.0,
                   dim: float = 100.0, bright: float = 800.0, co2_opt: float = 800.0, co2_min: float = 400.0, chunk="1 day") -> DataFrame:
    """VPD integral, hot/cold hours, dim/bright hours (darkness left out), CO2 deficiency, over one frame."""

    def build(f):
        out = {}
        if vpd:
            out["vpd_integral"] = F.sum(at_least_zero(F.col(vpd) - vpd_limit)).over(f) * step_h
        if temp:
            out["hot_hours"] = hits(F.col(temp) > hot, f) * step_h
            out["cold_hours"] = hits(F.col(temp) < cold, f) * step_h
        if light:
            x = F.col(light)
            out["dim_hours"] = hits((x < dim) & (x > 0), f) * step_h
            out["bright_hours"] = hits(x > bright, f) * step_h
        if co2:
            x = F.col(co2)
            out["co2_low_count"] = hits(x < co2_opt, f)
            lack = F.when(x < co2_opt, F.least((co2_opt - x) / (co2_opt - co2_min), F.lit(1.0)))
            out["co2_low_integral"] = F.coalesce(F.sum(lack).over(f), F.lit(0.0))
        return out

    return forward(df, n, keys, build, order, chunk=chunk)


def combined_stress(weights: Mapping[str, float]) -> Column:
    """Weighted stress, at most 1."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * w
    return F.least(total, F.lit(1.0))


def recovery_hours(df: DataFrame, flag: Column, keys, order="ts", step_h: float = 1.0, name: str = "recovery_hours", chunk="1 day") -> DataFrame:
    """Hours since the last stressed row (from the series' start if there was none)."""
    d = scan(df.withColumn("_f", flag), keys, order, {"_i": running_count()}, chunk=chunk, keep_chunk=chunk is not None)
    d = scan(d, keys, order, {"_s": last_valid(F.when(F.col("_f"), F.col("_i")))}, chunk=chunk)
    return d.withColumn(name, (F.col("_i") - F.coalesce("_s", F.lit(0))) * step_h).drop("_f", "_i", "_s")


def clusters(df: DataFrame, flag: Column, n: int, keys, order="ts", step_h: float = 1.0, chunk="1 day") -> DataFrame:
    """Number and mean length of stressed runs inside each forward window."""
    d = scan(df.withColumn("_f", flag), keys, order, {"_p": prev("_f")}, chunk=chunk)
    rise = F.col("_f") & ~F.coalesce(F.col("_p"), F.lit(False))

    def build(f):
        # a run already under way at the window's start counts as one more run
        runs = hits(rise, f) + F.when(F.first("_f").over(f) & ~F.first(rise).over(f), 1).otherwise(0)
        total = hits(F.col("_f"), f) * step_h
        return {"cluster_count": runs, "cluster_hours": F.when(runs > 0, total / runs).otherwise(0.0)}

    return forward(d, n, keys, build, order, chunk=chunk).drop("_f", "_p")


def rapid_changes(df: DataFrame, temp: str, rh: str, keys, lag: int, order="ts", max_change: float = 2.0, dry: float = 40.0,
                  wet: float = 80.0, step_h: float = 1 / 3600, chunk="1 day") -> DataFrame:
    """Count of temperature moves above the limit over ``lag`` rows, and hours of humidity stress."""
    d = row_frames(df, keys, order, lag, 0, lambda w: {"_l": F.lag(temp, lag).over(w)}, chunk=chunk)
    h = F.col(rh)
    return d.groupBy(*cols(keys)).agg(
        F.count_if(F.abs(F.col(temp) - F.col("_l")) > max_change).alias("rapid_changes"),
        (F.count_if((h < dry) | (h > wet)) * step_h).alias("humidity_stress_hours"))


def stress_share_hours(df: DataFrame, value: str, keys, low: float, high: float, ts: str = "ts") -> DataFrame:
    """Estimated hours outside [low, high]: share of readings x span x coverage."""
    x, t = F.col(value), epoch(ts)
    n, out = F.count(x), F.count_if((x < low) | (x > high))
    hours = F.floor((F.max(t) - F.min(t)) / 3600e6)
    return df.groupBy(*cols(keys)).agg((out / F.greatest(n, F.lit(1)) * hours * n / F.count(F.lit(1))).alias("stress_hours"))
