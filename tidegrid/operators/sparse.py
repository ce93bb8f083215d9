"""Features of sparse series: coverage, gaps, changes, extremes, activity, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cols, epoch, exact_quantiles, last_valid, match, micros, prev, running_count, running_sum, scan
from ..functions.calendar import weekend


def coverage_gaps(df: DataFrame, value: str, keys, ts: str = "ts", chunk="1 day") -> DataFrame:
    """Share of slots with a value, number of points, longest and mean whole-hour gap between points."""
    t = epoch(ts)
    points = df.where(F.col(value).isNotNull()).select(*cols(keys), ts)
    gaps = scan(points, keys, ts, {"_p": prev(t)}, chunk=chunk)
    hours = F.floor((t - F.col("_p")) / 3600e6).cast("double")
    some = F.when(hours > 0, hours)
    g = gaps.groupBy(*cols(keys)).agg(F.coalesce(F.max(some), F.lit(0.0)).alias("longest_gap_hours"),
                                      F.coalesce(F.avg(some), F.lit(0.0)).alias("mean_gap_hours"))
    n = df.groupBy(*cols(keys)).agg(F.count(value).alias("points"), (F.count(value) / F.count(F.lit(1))).alias("coverage"))
    return n.transform(match, g, cols(keys), "left").fillna({"longest_gap_hours": 0.0, "mean_gap_hours": 0.0})


def null_runs(df: DataFrame, value: str, keys, ts: str = "ts", step: str = "1h", chunk=None) -> DataFrame:
    """Runs of missing slots on a grid: number, longest and mean length in minutes."""
    here = F.col(value).isNull()
    lagged = scan(df, keys, ts, {"_p": prev(here)}, chunk=chunk, keep_chunk=chunk is not None)
    starts = (here & ~F.coalesce(F.col("_p"), F.lit(False))).cast("long")
    runs = scan(lagged.withColumn("_s", starts), keys, ts, {"_run": running_sum("_s")}, chunk=chunk)
    per = runs.where(here).groupBy(*cols(keys), "_run").agg((F.count(F.lit(1)) * (micros(step) / 60e6)).alias("_m"))
    every = df.select(*cols(keys)).distinct()
    out = per.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("gaps"), F.max("_m").alias("longest_gap_min"), F.avg("_m").alias("mean_gap_min"))
    return every.transform(match, out, cols(keys), "left").fillna({"gaps": 0, "longest_gap_min": 0.0, "mean_gap_min": 0.0})


def sparse_stats(df: DataFrame, value: str, keys) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(
        F.count(value).alias("points"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"))


def change_counts(df: DataFrame, value: str, keys, ts: str = "ts", chunk="1 day") -> DataFrame:
    """Changes, changes above two standard deviations, crossings of the mean, sign changes."""
    k, x = cols(keys), F.col(value)
    points = df.where(x.isNotNull()).select(*k, ts, value)
    stats = points.groupBy(*k).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    p = F.col("_p")
    d = scan(points, k, ts, {"_p": prev(x)}, chunk=chunk).transform(match, stats, k).where(p.isNotNull())
    sign = lambda c: F.when(c < 0, -1).otherwise(1)  # noqa: E731  zero counts as positive
    found = d.groupBy(*k).agg(
        F.count_if(x != p).alias("changes"), F.count_if(F.abs(x - p) > 2 * F.col("_s")).alias("large_changes"),
        F.count_if((p - F.col("_m")) * (x - F.col("_m")) < 0).alias("mean_crossings"), F.count_if(sign(x) != sign(p)).alias("sign_changes"))
    return stats.select(*k).transform(match, found, k, "left").fillna(0)


def extremes(df: DataFrame, value: str, keys, ts: str = "ts", min_points: int = 10, chunk="spread") -> DataFrame:
    """Points beyond the 5th and 95th percentile and the hours they stand for."""
    k, x, t = cols(keys), F.col(value), epoch(ts)
    size = df.groupBy(*k).agg(F.count(value).alias("_n"), F.count(F.lit(1)).alias("_slots"),
                              F.floor((F.max(t) - F.min(t)) / 3600e6).alias("_h"))
    q = exact_quantiles(df, k, value, {"_p5": 0.05, "_p95": 0.95}, chunk=chunk)
    d = df.transform(match, q, k)
    hits = d.groupBy(*k).agg(F.count_if(x > F.col("_p95")).alias("_hi"), F.count_if(x < F.col("_p5")).alias("_lo"))
    many = F.col("_n") > min_points
    share = (F.col("_hi") + F.col("_lo")) / F.col("_n")
    return size.transform(match, hits, k, "left").select(
        *k, F.when(many, F.col("_hi")).otherwise(0).alias("extreme_high"), F.when(many, F.col("_lo")).otherwise(0).alias("extreme_low"),
        F.when(many, F.col("_h") * share * F.col("_n") / F.col("_slots")).otherwise(0.0).alias("extreme_hours"))


def activity(df: DataFrame, value: str, keys, ts: str = "ts") -> DataFrame:
    """24-slot activity vector, and the hour of day with the best coverage (ties: the earliest)."""
    k = cols(keys)
    per = df.groupBy(*k, F.hour(ts).alias("_h")).agg((F.count(value) / F.count(F.lit(1))).alias("_r"))
    out = per.groupBy(*k).agg(F.collect_set(F.when(F.col("_r") > 0, F.col("_h"))).alias("_on"),
                              F.max_by("_h", F.struct("_r", -F.col("_h"))).alias("peak_hour"), F.max("_r").alias("peak_ratio"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.array_contains("_on", h))
    return out.select(*k, hours.alias("active_hours"), "peak_hour", "peak_ratio")


def class_coverage(df: DataFrame, value: str, keys, ts: str = "ts") -> DataFrame:
    """Coverage of weekend over weekday slots and of night over day slots."""
    x, night = F.col(value), ~F.hour(ts).between(6, 17)

    def share(cls: Column) -> Column:
        return F.count(F.when(cls, x)) / F.nullif(F.count_if(cls), F.lit(0))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(F.coalesce(share(a), F.lit(0.0)), share(b)), F.lit(0.0))

    w = weekend(ts)
    return df.groupBy(*cols(keys)).agg(ratio(w, ~w).alias("weekend_vs_weekday"), ratio(night, ~night).alias("night_vs_day"))


def quality(df: DataFrame, sensors: Sequence[str], keys, order="ts", chunk=None) -> DataFrame:
    """Quality of gridded multi-sensor windows: coverage, continuity, consistency, availability, score.

    Continuity counts interior gaps against half the rows; consistency decays with
    the coefficient of variation. Sensors below 1 % coverage are left out.
    """
    k = cols(keys)
    pos = scan(df, k, order, {"_i": running_count()}, chunk=chunk, keep_chunk=chunk is not None)
    seen = scan(pos, k, order, {f"_l_{s}": last_valid(F.when(F.col(s).isNotNull(), F.col("_i")), strict=True) for s in sensors}, chunk=chunk)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for s in sensors:
        x = F.col(s)
        aggs += [F.count(x).alias(f"_n_{s}"), F.avg(x).alias(f"_m_{s}"), F.stddev(x).alias(f"_s_{s}"),
                 F.count_if(x.isNotNull() & (F.col("_i") - F.col(f"_l_{s}") > 1)).alias(f"_g_{s}")]
    return _score(seen.groupBy(*k).agg(*aggs), sensors, k)


def _score(agg: DataFrame, sensors: Sequence[str], k) -> DataFrame:
    parts = []
    for s in sensors:
        n, m, sd = F.col(f"_n_{s}"), F.abs(F.col(f"_m_{s}")), F.col(f"_s_{s}")
        steady = F.when(n < 3, 0.5).when(m < 0.001, 1.0).otherwise(F.exp(-sd / F.nullif(m, F.lit(0.0))))
        slots = F.nullif(F.floor(F.col("_rows") / 2), F.lit(0))
        cont = F.least(F.greatest(1 - F.col(f"_g_{s}") / slots, F.lit(0.0)), F.lit(1.0))
        parts.append(F.when(n / F.col("_rows") > 0.01, F.struct(
            (n / F.col("_rows")).alias("cov"), F.coalesce(cont, F.lit(1.0)).alias("cont"), steady.alias("cons"))))
    used = F.filter(F.array(*parts), lambda e: e.isNotNull())
    mean = lambda f: F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda a, e: a + e[f]) / F.size(used)).otherwise(0.0)
    out = agg.select(*k, F.col("_rows").alias("rows"), mean("cov").alias("coverage"), mean("cont").alias("continuity"),
                     mean("cons").alias("consistency"), (F.size(used) / len(sensors)).alias("availability"))
    return out.withColumn("score", 0.4 * F.col("coverage") + 0.3 * F.col("continuity") + 0.2 * F.col("consistency")
                          + 0.1 * F.col("availability"))


def window_plan(quality_rows: DataFrame) -> DataFrame:
    """Window hours, overlap, quality threshold and sensors needed, from quality scores."""
    c, n = F.col("coverage"), F.col("continuity")
    return quality_rows.withColumns({
        "window_hours": F.when(c > 0.8, 12).when(c > 0.5, 24).otherwise(48),
        "overlap": F.when(n > 0.8, 0.25).when(n > 0.5, 0.5).otherwise(0.75),
        "quality_threshold": F.col("score") * 0.8,
        "min_sensors": F.greatest(F.ceil(F.col("availability") * 5), F.lit(2))})


def adaptive_windows(df: DataFrame, sensors: Sequence[str], keys, ts: str = "hour", plan: DataFrame | None = None) -> DataFrame:
    """Sliding windows whose size and overlap follow each key's quality; poor windows are dropped.

    The plan has one row per key and is joined, not collected. Rows are on an hourly grid.
    """
    from ..frames import from_epoch

    k, hour = cols(keys), 3_600_000_000
    plan = plan if plan is not None else window_plan(quality(df, sensors, k, ts))
    t = epoch(ts)
    ends = df.groupBy(*k).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    d = df.transform(match, plan.select(*k, "window_hours", "overlap", "quality_threshold"), k).transform(match, ends, k)
    size = (F.col("window_hours") * hour).cast("long")
    slide = F.greatest(F.floor(F.col("window_hours") * (1 - F.col("overlap"))), F.lit(1)) * hour
    div = lambda a, b: F.floor(a / b).cast("long")
    off = t - F.col("_a")
    hi = F.least(div(off, slide), div(F.col("_b") - F.col("_a") - size, slide))
    lo = F.greatest(div(off - size, slide) + 1, F.lit(0).cast("long"))
    spread = (d.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("window_no", F.explode(F.sequence("_lo", "_hi")))
              .withColumn("window_start", from_epoch(F.col("_a") + F.col("window_no") * slide)))
    wk = [*k, "window_no", "window_start", "window_hours", "quality_threshold"]
    q = quality(spread, sensors, wk, ts)
    return q.where((F.col("rows") >= F.floor(F.col("window_hours") / 2)) & (F.col("score") >= F.col("quality_threshold")))


def suggest_window(df: DataFrame, sensors: Sequence[str], keys, ts: str = "ts", sizes: Sequence[int] = (12, 18, 24),
                   default: int = 24) -> DataFrame:
    """Best window size in rows: mean quality of half-overlapping windows, larger sizes penalised up to 10 %."""
    k = cols(keys)
    pos = scan(df, k, ts, {"_i": running_count()}, chunk=None).withColumn("_i", F.col("_i") - 1)
    total = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    d = pos.transform(match, total, k).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    step = F.floor(F.col("size") / 2)
    hi = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - F.col("size")) / step))
    lo = F.greatest(F.floor((F.col("_i") - F.col("size")) / step) + 1, F.lit(0))
    d = d.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_w", F.explode(F.sequence("_lo", "_hi")))
    q = quality(d.drop("_i"), sensors, [*k, "size", "_w"], ts).where(F.col("score") >= 0.1)
    by = q.groupBy(*k, "size").agg((F.avg("score") * (1 - F.col("size") / max(sizes) * 0.1)).alias("adjusted"), F.count(F.lit(1)).alias("windows"))
    best = by.groupBy(*k).agg(F.max_by("size", F.struct("adjusted", -F.col("size"))).alias("window_size"), F.max("adjusted").alias("adjusted"))
    return df.select(*k).distinct().transform(match, best, k, "left").fillna({"window_size": default})

