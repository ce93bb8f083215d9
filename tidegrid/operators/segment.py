"""Islands, segments, label runs, breakpoints and eras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cols, epoch, following, match, micros, prev, row_frames, running_count, running_sum, scan
from ..functions.calendar import trunc
from .grid import densify
from .join import interval_join


def number_runs(df: DataFrame, starts: Column, keys, order, name: str, before: dict, chunk) -> DataFrame:
    """Number runs from 0: ``starts`` (over the scanned ``before`` columns) opens a new one."""
    lagged = scan(df, keys, order, before, chunk=chunk, keep_chunk=chunk is not None)
    flagged = lagged.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(0)).cast("long")).drop(*before)
    out = scan(flagged, keys, order, {name: running_sum("_new")}, chunk=chunk)
    return out.drop("_new")


def label_islands(df: DataFrame, gap: str, keys, order="ts", name: str = "segment_id", chunk="1 day") -> DataFrame:
    """New island when the distance to the previous reading exceeds ``gap``; equal stays."""
    t = epoch(cols(order)[0])
    return number_runs(df, t - F.col("_p") > micros(gap), keys, order, name, {"_p": prev(t)}, chunk)


def island_stats(df: DataFrame, keys, gap: str | None = None, ts: str = "ts", segment: str = "segment_id",
                 min_rows: int = 1, chunk="1 day") -> DataFrame:
    """Start, end, minutes, rows and gaps above ``gap`` left inside (merged segments have some)."""
    k = [*cols(keys), segment]
    t = epoch(ts)
    if gap is not None:
        # neighbours are taken along the whole series; the first row of a segment has no inner gap
        df = scan(df, keys, ts, {"_p": prev(F.struct(t.alias("t"), F.col(segment).alias("s")))}, chunk=chunk)
        inner = F.when(F.col("_p.s") == F.col(segment), t - F.col("_p.t"))
        wide = F.when(inner > micros(gap), inner)
    else:
        wide = F.lit(None).cast("long")
    return (df.groupBy(*k).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"),
        ((F.max(t) - F.min(t)) / 60e6).alias("minutes"), F.count(F.lit(1)).alias("rows"),
        (F.count(wide) > 0).alias("has_gaps"), (F.coalesce(F.sum(wide), F.lit(0)) / 60e6).alias("gap_minutes"))
        .where(F.col("rows") >= min_rows))


def filter_segments(df: DataFrame, stats: DataFrame, keys, min_hours: float = 1.0, min_rows: int = 10,
                    segment: str = "segment_id") -> DataFrame:
    good = stats.where((F.col("minutes") >= min_hours * 60) & (F.col("rows") >= min_rows))
    return df.transform(match, good.select(*cols(keys), segment), [*cols(keys), segment], "left_semi")


def merge_small_gaps(df: DataFrame, gap: str, keys, order="ts", segment: str = "segment_id", chunk="1 day") -> DataFrame:
    """Relabel with a larger gap and keep the finer label as ``sub_segment_id``."""
    return label_islands(df.withColumnRenamed(segment, "sub_segment_id"), gap, keys, order, segment, chunk)


def segment_by_availability(df: DataFrame, keys, gap: str = "24 hours", order="ts", chunk="1 day") -> DataFrame:
    return label_islands(df, gap, keys, order, "segment_id", chunk)


def quantize(df: DataFrame, col: str, levels: int, keys, name: str = "symbol") -> DataFrame:
    """Scale to 0..levels by the key's range, half away from zero; constant series are 0."""
    keys = cols(keys)
    ends = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.round((F.col(col) - F.col("_lo")) / F.nullif(span, F.lit(0.0)) * levels).cast("int")
    return (df.transform(match, ends, keys, "left")
            .withColumn(name, F.when(F.col(col).isNull(), None).when(span < 1e-9, 0).otherwise(scaled))
            .drop("_lo", "_hi"))


def apply_breaks(df: DataFrame, is_break: str | Column, keys, order="ts", name: str = "era_id", chunk="1 day") -> DataFrame:
    """Rows marked as first of a new era become running era ids from 0."""
    flag = (F.col(is_break) if isinstance(is_break, str) else is_break).cast("int")
    return scan(df, keys, order, {name: running_sum(F.coalesce(flag, F.lit(0)).cast("long"))}, chunk=chunk)


def segments_from_labels(df: DataFrame, label: str, keys, ts: str = "ts", chunk="1 day") -> DataFrame:
    """Run-length form: one row per run of equal labels with start, end and rows."""
    changed = ~F.coalesce(F.col("_p").eqNullSafe(F.col(label)), F.lit(False))
    runs = number_runs(df, changed, keys, ts, "run", {"_p": prev(label)}, chunk)
    return (runs.groupBy(*cols(keys), "run", label)
            .agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count(F.lit(1)).alias("rows"))
            .withColumn("run", F.col("run") - 1))


def breaks_to_intervals(breaks: DataFrame, keys, day: str = "day") -> DataFrame:
    """Half-open day intervals between consecutive break days (days per key are bounded by the span)."""
    out = scan(breaks.select(*cols(keys), day).distinct(), keys, day, {"end_day": following(day)}, chunk=None)
    return out.where(F.col("end_day").isNotNull()).withColumnRenamed(day, "start_day")


def daily_nonnull_counts(df: DataFrame, values: Sequence[str], keys, ts: str = "ts") -> DataFrame:
    """Non-null cells per day; days without data inside the range count 0."""
    cells = sum((F.count(v) for v in values[1:]), F.count(values[0]))
    daily = df.groupBy(*cols(keys), trunc("day", ts).alias("day")).agg(cells.alias("n"))
    return densify(daily, "1 day", keys, "day").fillna({"n": 0})


def assign_eras(df: DataFrame, defs: DataFrame, row_id, ts: str = "ts") -> DataFrame:
    """Configured eras (era, start, end, ...) attached by time; the first defined wins."""
    return interval_join(df, defs, ts, "start", "end", keys=(), row_id=row_id, first_by=["start", "era"])


def mean_shift_score(df: DataFrame, col: str, keys, k: int, order="ts", chunk="1 day") -> DataFrame:
    """Absolute mean difference of the ``k`` rows from here on and the ``k`` rows before, over their pooled spread."""
    x = F.col(col)

    def build(w):
        left, right = w.rowsBetween(-k, -1), w.rowsBetween(0, k - 1)
        pooled = F.sqrt((F.var_pop(x).over(left) + F.var_pop(x).over(right)) / 2)
        gap = F.abs(F.avg(x).over(right) - F.avg(x).over(left))
        full = (F.count(x).over(left) == k) & (F.count(x).over(right) == k)
        return {"score": F.when(full, gap / F.nullif(pooled, F.lit(0.0)))}

    return row_frames(df, keys, order, k, k - 1, build, chunk=chunk)


def monthly_eras(windows: DataFrame, keys, window: str, start: str = "window_start",
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Window features grouped by the month in which the window starts."""
    from ..frames import from_epoch

    return (windows.groupBy(*cols(keys), trunc("month", start).alias("month"))
            .agg(F.min(start).alias("start_time"), from_epoch(F.max(epoch(start)) + micros(window)).alias("end_time"),
                 F.count(F.lit(1)).alias("windows"), *[c.alias(n) for n, c in (extra or {}).items()]))


def min_era_rows(eras: DataFrame, minimum: int, rows: str = "rows") -> DataFrame:
    return eras.where(F.col(rows) >= minimum)


def month_breaks(df: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """First reading of every month as breakpoint."""
    return df.groupBy(*cols(keys), trunc("month", ts).alias("month")).agg(F.min(ts).alias("break_time"))


def row_positions(df: DataFrame, keys, order="ts", name: str = "pos", chunk="1 day") -> DataFrame:
    """Row numbers from 0."""
    return scan(df, keys, order, {name: running_count()}, chunk=chunk).withColumn(name, F.col(name) - 1)
