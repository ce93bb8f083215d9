"""Complete grids, resampling and imputation.

Imputation runs on raw series through ``scan``/``row_frames``; on a grid the
number of rows per key is span / step, and ``chunk=None`` is the cheaper choice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import (Split, bucket, bucket_no, cols, epoch, exact_quantiles, following, from_epoch, is_plain, last_valid, match, micros, next_valid,
                      prev, row_frames, running_count, scan)


def grid_points(df: DataFrame, step: str, keys, ts: str = "ts") -> DataFrame:
    """Every grid time between a key's first and last reading."""
    k = cols(keys)
    ends = df.groupBy(*k).agg(F.min(bucket_no(ts, step)).alias("_a"), F.max(bucket_no(ts, step)).alias("_b"))
    return ends.select(*k, F.explode(F.sequence("_a", "_b")).alias("_i")).select(
        *k, from_epoch(F.col("_i") * micros(step)).alias(ts))


def densify(df: DataFrame, step: str, keys, ts: str = "ts", chunk=None) -> DataFrame:
    """Add the missing grid rows, with NULLs, between a key's first and last row.

    ``ts`` must lie on the grid and be unique per key. Each row emits the empty
    slots up to its successor, so there is no join and the one shuffle, by key, is
    shared with later windows over the same key.
    """
    s, t = micros(step), epoch(ts)
    out = scan(df, keys, ts, {"_n": following(t)}, chunk=chunk)
    slots = F.coalesce(F.floor((F.col("_n") - t) / s) - 1, F.lit(0).cast("long"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(slots, F.lit(0).cast("long")))))
    keep = {*cols(keys), ts}
    return out.select(*[F.when(F.col("_o") == 0, F.col(c)).alias(c) if c not in keep
                        else (from_epoch(t + F.col("_o") * s).alias(c) if c == ts else F.col(c)) for c in df.columns])


GRID_ROWS = 500_000  # grid rows of a partition


def dealt(df: DataFrame, step: str, keys, ts: str = "ts", most: int = GRID_ROWS) -> DataFrame:
    """Deal whole keys into so many partitions that one holds about ``most`` rows of their complete grid.

    What windows over the keys sort in a task then stays the same however many keys there are. Costs one count of the grid.
    """
    k = cols(keys)
    ends = df.groupBy(*k).agg((F.max(bucket_no(ts, step)) - F.min(bucket_no(ts, step)) + 1).alias("_n"))
    parts = math.ceil((ends.agg(F.sum("_n").alias("n")).first().n or 0) / most)
    return df.repartition(parts, *k) if parts > 1 else df


def asfreq(df: DataFrame, step: str, keys, ts: str = "ts") -> DataFrame:
    """Only readings exactly on the grid survive; no aggregation."""
    on_grid = df.where(F.pmod(epoch(ts), F.lit(micros(step))) == 0)
    return grid_points(df, step, keys, ts).transform(match, on_grid, [*cols(keys), ts], "left")


def resample_mean(df: DataFrame, every: str, keys, values: Sequence[str], ts: str = "ts") -> DataFrame:
    """Left-closed, left-labelled bucket means."""
    return (df.groupBy(*cols(keys), bucket(ts, every).alias(ts))
            .agg(*[F.avg(v).alias(v) for v in values]))


def resample_ffill(df: DataFrame, every: str, keys, values: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last reading of each bucket on the complete grid, carried forward over empty buckets."""
    last = (df.withColumn("_t", epoch(ts)).groupBy(*cols(keys), bucket(ts, every).alias("_b"))
            .agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_t"))).alias(v) for v in values])
            .withColumnRenamed("_b", ts))
    return ffill(densify(last, every, keys, ts), values, keys, ts, chunk=None)


def downsample_nearest(df: DataFrame, step: str, keys, value: str, ts: str = "ts",
                       missing: float | None = None) -> DataFrame:
    """Each grid point takes the closest reading within half a step; the later of two equally close."""
    s = micros(step)
    e = epoch(ts)
    point = bucket_no(from_epoch(e + s // 2), s) * s
    near = df.groupBy(*cols(keys), from_epoch(point).alias("_g")).agg(
        F.min_by(value, F.struct(F.abs(e - point), -e)).alias(value)).withColumnRenamed("_g", ts)
    full = densify(near, step, keys, ts)
    return full if missing is None else full.fillna({value: missing})


def _limited(df, names, keys, order, limit, chunk, pick, back):
    reach = (limit, 0) if back else (0, limit)

    def build(w):
        frame = w.rowsBetween(-reach[0], reach[1])
        return {f"_f_{c}": F.coalesce(F.col(c), pick(F.col(c), ignorenulls=True).over(frame)) for c in names}

    out = row_frames(df, keys, order, *reach, build, chunk=chunk)
    return out.withColumns({c: F.col(f"_f_{c}") for c in names}).drop(*[f"_f_{c}" for c in names])


def ffill(df: DataFrame, columns, keys, order="ts", limit: int | None = None, chunk="1 day") -> DataFrame:
    names = cols(columns)
    if limit is not None:
        return _limited(df, names, keys, order, limit, chunk, F.last, True)
    out = scan(df, keys, order, {f"_f_{c}": last_valid(c) for c in names}, chunk=chunk)
    return out.withColumns({c: F.col(f"_f_{c}") for c in names}).drop(*[f"_f_{c}" for c in names])


def bfill(df: DataFrame, columns, keys, order="ts", limit: int | None = None, chunk="1 day") -> DataFrame:
    names = cols(columns)
    if limit is not None:
        return _limited(df, names, keys, order, limit, chunk, F.first, False)
    out = scan(df, keys, order, {f"_f_{c}": next_valid(c) for c in names}, chunk=chunk)
    return out.withColumns({c: F.col(f"_f_{c}") for c in names}).drop(*[f"_f_{c}" for c in names])


def fill_both(df: DataFrame, columns, keys, order="ts", chunk="1 day", last_resort: float | None = None) -> DataFrame:
    """Forward, then backward, then a constant; one pass over the data."""
    names, specs = cols(columns), {}
    for c in names:
        specs[f"_f_{c}"], specs[f"_b_{c}"] = last_valid(c), next_valid(c)
    tail = [] if last_resort is None else [F.lit(last_resort)]
    out = scan(df, keys, order, specs, chunk=chunk)
    return out.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}"), *tail) for c in names}).drop(*specs)


def interpolate(df: DataFrame, columns, keys, order="ts", *, by: str = "time", limit: int | None = None,
                area: str = "both", chunk="1 day") -> DataFrame:
    """Straight lines between known neighbours.

    ``by`` is ``time`` or ``row``; ``area='both'`` repeats the edge value outside
    the known range, ``'inside'`` leaves it NULL; ``limit`` fills at most that
    many NULLs after a known value.
    """
    names, ts = cols(columns), cols(order)[0]
    work = scan(df, keys, order, {"_pos": running_count()}, chunk=chunk) if by == "row" or limit is not None else df
    place = F.col("_pos").cast("double") if by == "row" else epoch(ts)
    specs = {}
    for c in names:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), place.alias("p"), *(
            [F.col("_pos").alias("i")] if limit is not None else [])))
        specs[f"_l_{c}"], specs[f"_r_{c}"] = last_valid(here), next_valid(here)
    out = scan(work, keys, order, specs, chunk=chunk)
    made = {}
    for c in names:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        line = a["v"] + (b["v"] - a["v"]) * ((place - a["p"]) / F.nullif((b["p"] - a["p"]).cast("double"), F.lit(0.0)))
        edge = F.coalesce(line, a["v"], b["v"]) if area == "both" else line
        if limit is not None:
            near = F.coalesce(F.col("_pos") - a["i"] <= limit, F.lit(False))
            edge = F.when(near | (a.isNull() if area == "both" else F.lit(False)), edge)
        made[c] = F.coalesce(F.col(c), edge)
    return out.withColumns(made).drop("_pos", *specs)


def fill_stat(df: DataFrame, col: str, how: str, keys, chunk="spread") -> DataFrame:
    """Fill with the key's mean, median or mode, or with zero."""
    keys = cols(keys)
    if how == "zero":
        return df.fillna({col: 0.0})
    if how == "mean":
        stat = df.groupBy(*keys).agg(F.avg(col).alias("_s"))
    elif how == "median":
        stat = exact_quantiles(df, keys, col, {"_s": 0.5}, chunk=chunk)
    elif how == "mode":
        counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
        stat = counts.groupBy(*keys).agg(F.max_by(col, F.struct("_n", -F.col(col))).alias("_s"))
    else:
        raise ValueError(f"unknown fill {how}")
    return df.transform(match, stat, keys, "left").withColumn(col, F.coalesce(col, "_s")).drop("_s")


def impute(df: DataFrame, rules: Mapping[str, Mapping], keys, order="ts", default: Mapping | None = None,
           numeric: Sequence[str] = (), chunk="1 day") -> DataFrame:
    """Per-column strategies; columns with the same strategy share one pass. Unknown columns are skipped."""
    plan = {c: dict(r) for c, r in rules.items() if c in df.columns}
    if default:
        plan.update({c: dict(default) for c in numeric if c not in plan})
    groups: dict[tuple, list[str]] = {}
    for c, r in plan.items():
        groups.setdefault((r["how"], r.get("limit"), r.get("area", "both")), []).append(c)
    out = df
    for (how, limit, area), names in groups.items():
        if how == "ffill":
            out = ffill(out, names, keys, order, limit, chunk)
        elif how == "bfill":
            out = bfill(out, names, keys, order, limit, chunk)
        elif how == "linear":
            out = interpolate(out, names, keys, order, limit=limit, area=area, chunk=chunk)
        elif how == "none":
            continue
        else:
            for c in names:
                out = fill_stat(out, c, how, keys, chunk if is_plain(chunk) else "spread")
    return out


def neighbours(col: str, place: Column) -> dict:
    """Scans giving value and place of the known neighbours on both sides."""
    at = F.when(F.col(col).isNotNull(), place)
    return {f"_lv_{col}": last_valid(col), f"_lp_{col}": last_valid(at), f"_rv_{col}": next_valid(col), f"_rp_{col}": next_valid(at)}


def conservative_fill(df: DataFrame, rules: Mapping[str, tuple[float, float, float]], keys, max_gap: int, step: str = "1h",
                      order="ts", chunk=None) -> DataFrame:
    """Fill only short gaps on a dense grid, and only while the line stays plausible.

    A gap longer than ``max_gap`` slots, a slope above the rule's change per slot
    or a value outside [low, high] leaves the gap (from that slot on) open.
    """
    t, specs, made = epoch(cols(order)[0]), {}, {}
    for c in rules:
        specs.update(neighbours(c, t))
    out = scan(df, keys, order, specs, chunk=chunk)
    slot = float(micros(step))
    for c, (low, high, change) in rules.items():
        left, right, a, b = (F.col(f"{n}_{c}") for n in ("_lv", "_rv", "_lp", "_rp"))
        slots = F.nullif((b - a) / slot, F.lit(0.0))
        rise = (right - left) / slots
        here, first = left + rise * ((t - a) / slot), left + rise
        ok = (slots <= max_gap + 1) & (F.abs(rise) <= change) & first.between(low, high) & here.between(low, high)
        made[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(ok, here)
    return out.withColumns(made).drop(*specs)


def fill_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled and remaining NULLs per column from the two frames' counts."""
    def missing(df, tag):
        return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias(tag))
                                for c in columns]).alias("r")).select(F.inline("r"))

    return (missing(before, "missing").join(missing(after, "remaining"), "column")
            .select("column", (F.col("missing") - F.col("remaining")).alias("filled"), "remaining"))


def infer_step(df: DataFrame, keys, ts: str = "ts", how: str = "median", chunk="1 day") -> DataFrame:
    """Usual distance between readings in seconds: the median, or the first one."""
    keys = cols(keys)
    gaps = scan(df.select(*keys, ts), keys, ts, {"_p": prev(epoch(ts))}, chunk=chunk).withColumn(
        "_gap", (epoch(ts) - F.col("_p")) / 1e6)
    if how == "first":
        return gaps.where(F.col("_gap").isNotNull()).groupBy(*keys).agg(F.min_by("_gap", ts).alias("step_s"))
    return exact_quantiles(gaps, keys, "_gap", {"step_s": 0.5}, chunk=chunk if is_plain(chunk) or isinstance(chunk, Split) else "spread")


def multires(df: DataFrame, resolutions: Sequence[str], keys, value: str, ts: str = "ts") -> DataFrame:
    """Non-overlapping block means at several resolutions in one aggregation.

    Blocks roll up from sums and counts of the finest resolution, so a raw row is
    read and shuffled once whatever the number of resolutions.
    """
    keys = cols(keys)
    finest = min(micros(r) for r in resolutions)
    base = df.groupBy(*keys, bucket_no(ts, finest).alias("_i")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    width = F.array(*[F.struct(F.lit(r).alias("resolution"), F.lit(micros(r)).cast("long").alias("us")) for r in resolutions])
    us = F.col("_i") * finest
    return (base.withColumn("_r", F.explode(width))
            .groupBy(*keys, F.col("_r.resolution").alias("resolution"),
                     from_epoch(us - F.pmod(us, F.col("_r.us"))).alias(ts))
            .agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n")))

