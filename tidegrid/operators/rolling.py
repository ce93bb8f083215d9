"""Rolling, cumulative and sliding-window computations.

Statistics that share a frame are built together, so one sort serves them all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..frames import (attach_row, block_frames, bucket_no, cols, epoch, exact_quantiles, floor_div, following, from_epoch, linear_scan, match, micros, prev, row_frames,
                      running_count, running_product, running_sum, scan, time_block_frames, time_frames)
from ..functions.moments import Moments
from ..functions.ranks import Ranks


# Frame aggregates a statistic is made of. Each is computed once per call, however
# many statistics share it.
PARTS = {
    "n": F.count, "mean": F.avg, "std": F.stddev, "pop": F.stddev_pop, "min": F.min, "max": F.max, "var": F.variance, "sum": F.sum,
    "skew": F.skewness, "kurt": F.kurtosis, "list": F.collect_list,
    "logs": lambda x: F.avg(F.when(x > 0, F.ln(x))), "inverse": lambda x: F.sum(F.when(x != 0, 1 / F.nullif(x, F.lit(0.0)))),
    "nonzero": lambda x: F.count(F.when(x != 0, x)),
}


def _rank(p: float):
    """Interpolated quantile of the frame's sorted values."""
    def pick(c, x):
        a, at = c["list"], (F.size(c["list"]) - 1) * p
        lo, hi = (F.try_element_at(a, f(at).cast("int") + 1) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (at - F.floor(at))

    return ("list",), pick


def _plain(part: str):
    return (part,), lambda c, x: c[part]


def _mad(c, x):
    seen = c["list"]
    return _array_median(F.sort_array(F.transform(seen, lambda e: F.abs(e - _array_median(seen)))))


# statistic -> (parts, combination of the parts and the row's own value)
STATS = {
    **{s: _plain(s) for s in ("mean", "std", "min", "max", "var", "sum", "skew", "kurt")},
    "count": _plain("n"), "std_pop": _plain("pop"),
    **{n: _rank(p) for n, p in (("median", 0.5), ("q10", 0.1), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9))},
    "range": (("min", "max"), lambda c, x: c["max"] - c["min"]),
    "cv": (("pop", "mean"), lambda c, x: c["pop"] / F.nullif(F.abs(c["mean"]), F.lit(0.0))),
    "iqr": (("list",), lambda c, x: _rank(0.75)[1](c, x) - _rank(0.25)[1](c, x)),
    "z": (("pop", "mean"), lambda c, x: F.when(c["pop"] <= 1e-10, 0.0).otherwise((x - c["mean"]) / F.nullif(c["pop"], F.lit(0.0)))),
    "gmean": (("logs",), lambda c, x: F.exp(c["logs"])),
    "hmean": (("nonzero", "inverse"), lambda c, x: c["nonzero"] / F.nullif(c["inverse"], F.lit(0.0))),
    "mad": (("list",), _mad),
}


def _parts(stats: Sequence[str], x: Column, frame: WindowSpec) -> dict[str, Column]:
    needed = dict.fromkeys(["n", *[p for s in stats for p in STATS[s][0]]])
    made = {f"_w_{p}": PARTS[p](x).over(frame) for p in needed}
    # sorted once per row, whatever the number of order statistics
    return made | ({"_w_list": F.sort_array(made["_w_list"])} if "_w_list" in made else {})


def _combine(df: DataFrame, stats: Sequence[str], x: Column, name: str, min_n: int) -> DataFrame:
    have = {c[3:]: F.col(c) for c in df.columns if c.startswith("_w_")}
    made = {f"{name}_{s}": F.when(have["n"] >= min_n, STATS[s][1](have, x)) for s in stats}
    return df.withColumns(made).drop(*[f"_w_{p}" for p in have])


def _array_median(a: Column) -> Column:
    n = F.size(a)
    low, high = F.try_element_at(a, F.floor((n + 1) / 2).cast("int")), F.try_element_at(a, F.floor(n / 2 + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def rolling(df: DataFrame, col: str, window: str, stats: Sequence[str], keys, *, closed: str = "left",
            min_n: int = 1, ts: str = "ts", prefix: str | None = None) -> DataFrame:
    """Time-range statistics. ``closed='left'`` covers [t - w, t), ``'right'`` covers (t - w, t]."""
    w_us = micros(window)
    if {p for s in stats for p in STATS[s][0]} <= set(SUMS) and df.schema[col].dataType.simpleString() == "double":
        return _combine(_summed(df, col, w_us, stats, keys, closed, ts), stats, F.col(col), prefix or col, min_n)

    def build(w):
        return _parts(stats, F.col(col), w.rangeBetween(-w_us, -1) if closed == "left" else w.rangeBetween(-w_us + 1, 0))

    return _combine(time_frames(df, keys, ts, window, 0, build), stats, F.col(col), prefix or col, min_n)


# parts that come from count, sum and squared deviations of a frame
SUMS = {"n": lambda n, s, q: (n, n >= 0), "sum": lambda n, s, q: (s, n > 0), "mean": lambda n, s, q: (s / np.maximum(n, 1), n > 0),
        "std": lambda n, s, q: (np.sqrt(q / np.maximum(n - 1, 1)), n > 1), "var": lambda n, s, q: (q / np.maximum(n - 1, 1), n > 1),
        "pop": lambda n, s, q: (np.sqrt(q / np.maximum(n, 1)), n > 0)}


def _summed(df: DataFrame, col: str, w_us: int, stats: Sequence[str], keys, closed: str, ts: str) -> DataFrame:
    """The parts of ``stats``: each row joins a few ready sums, however many rows its frame holds."""
    needed = list(dict.fromkeys(["n", *[p for s in stats for p in STATS[s][0]]]))

    def compute(t, timeless, x, there):
        import pyarrow as pa

        begin = np.searchsorted(t, t - w_us, "left") if closed == "left" else np.searchsorted(t, t - w_us, "right")
        end = np.searchsorted(t, t, "left") if closed == "left" else np.searchsorted(t, t, "right")
        begin, end = np.where(timeless, 0, begin), np.where(timeless, len(t), end)
        found = Moments(np.asarray(x, float), np.asarray(there, bool)).of(begin, end)
        return [pa.array(v, mask=~known) for v, known in (SUMS[p](*found) for p in needed)]

    made = ", ".join(f"`_w_{p}` {'long' if p == 'n' else 'double'}" for p in needed)
    d = df.withColumns({"_x": F.coalesce(F.col(col), F.lit(0.0)), "_there": F.col(col).isNotNull()})
    return time_block_frames(d, keys, ts, w_us, 0, ["_x", "_there"], made, compute).drop("_x", "_there")


LONG = 64  # frames of more rows find order statistics by a rank structure instead of a list per row
QUANTILES = {"median": 0.5, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


def rolling_rows(df: DataFrame, col: str, n: int, stats: Sequence[str], keys, order="ts", *, min_n: int = 1,
                 prefix: str | None = None, ahead: bool = False, chunk="1 day") -> DataFrame:
    """Statistics over this row and the ``n - 1`` before it (``ahead``: after it)."""
    by_rank = [s for s in stats if n > LONG and "list" in STATS[s][0]]

    def build(w):
        return _parts([s for s in stats if s not in by_rank], F.col(col), w.rowsBetween(0, n - 1) if ahead else w.rowsBetween(-n + 1, 0))

    reach = (0, n - 1) if ahead else (n - 1, 0)
    if by_rank:
        df = _ranked(df, col, reach, by_rank, keys, order, min_n, prefix or col, chunk)
    if len(by_rank) == len(stats):
        return df
    out = row_frames(df, keys, order, *reach, build, chunk=chunk)
    return _combine(out, [s for s in stats if s not in by_rank], F.col(col), prefix or col, min_n)


def _ranked(df: DataFrame, col: str, reach: tuple[int, int], stats: Sequence[str], keys, order, min_n: int, name: str, chunk) -> DataFrame:
    """Order statistics of long row frames: each costs a few steps per row, whatever the frame's length."""
    before, after = reach

    def compute(x: np.ndarray):
        x = np.asarray(x, float)
        there = ~np.isnan(x)
        upto = np.concatenate(([0], np.cumsum(there)))
        at = np.arange(len(x))
        begin, end = upto[np.maximum(at - before, 0)], upto[np.minimum(at + after, len(x) - 1) + 1]
        ranks, made = Ranks(x[there]), {}

        def quantile(p):
            if p not in made:
                made[p] = ranks.quantile(begin, end, p)
            return made[p]

        for s in stats:
            v = (quantile(QUANTILES[s]) if s in QUANTILES else quantile(0.75) - quantile(0.25) if s == "iqr" else ranks.median_deviation(begin, end))
            yield np.where(end - begin >= min_n, v, np.nan)

    value = df.withColumn("_x", F.col(col).cast("double"))
    made = ", ".join(f"`{name}_{s}` double" for s in stats)
    return block_frames(value, keys, order, before, after, ["_x"], made, lambda x: list(compute(x)), chunk=chunk).drop("_x")


def stride(df: DataFrame, every: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Every n-th row of each series."""
    out = scan(df, keys, order, {"_pos": running_count()}, chunk=chunk)
    return out.where((F.col("_pos") - 1) % every == 0).drop("_pos")


def rolling_abs_diff(df: DataFrame, col: str, n: int, keys, order="ts", name: str = "abs_diff", chunk="1 day") -> DataFrame:
    """Sum of absolute steps inside the last ``n`` rows."""

    def build(w):
        # steps wholly inside the frame: n - 1 of them, ending here
        return {name: F.sum("_step").over(w.rowsBetween(-n + 2, 0))}

    steps = scan(df, keys, order, {"_p": prev(col)}, chunk=chunk).withColumn("_step", F.abs(F.col(col) - F.col("_p"))).drop("_p")
    return row_frames(steps, keys, order, max(n - 2, 0), 0, build, chunk=chunk).drop("_step")


def ewma(df: DataFrame, col: str, alpha: float, keys, order="ts", name: str = "ewma", chunk="1 day") -> DataFrame:
    """y = (1 - a) y' + a x from the first value on, over the whole history; a NULL keeps y."""
    x = F.col(col).cast("double")
    term = F.array(F.when(F.col("_n") == 0, x).otherwise(x * alpha))
    out = linear_scan(df, keys, order, x.isNotNull(), term, [[1 - alpha]], "_s", chunk=chunk)
    return out.withColumn(name, F.col("_s")[0]).drop("_s")


def holt(df: DataFrame, col: str, alpha: float, beta: float, keys, order="ts", chunk="1 day") -> DataFrame:
    """Double exponential smoothing over the whole history: level and trend, started at the first value with no trend."""
    x = F.col(col).cast("double")
    term = F.when(F.col("_n") == 0, F.array(x, F.lit(0.0))).otherwise(F.array(x * alpha, x * (alpha * beta)))
    step = [[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]]
    out = linear_scan(df, keys, order, x.isNotNull(), term, step, "_s", chunk=chunk)
    return out.withColumns({"level": F.col("_s")[0], "trend": F.col("_s")[1]}).drop("_s")


def cumulative(df: DataFrame, exprs: Mapping[str, tuple[str, Column | str]], keys, order="ts", chunk="1 day") -> DataFrame:
    """Running ``sum`` or ``product`` columns in one scan."""
    kind = {"sum": running_sum, "product": running_product}
    return scan(df, keys, order, {n: kind[k](x) for n, (k, x) in exprs.items()}, chunk=chunk)


def rate_of_change(df: DataFrame, col: str, keys, ts: str = "ts", chunk="1 day") -> DataFrame:
    """Step and step per second from the previous reading; no elapsed time gives NULL."""
    out = scan(df, keys, ts, {"_p": prev(F.struct(F.col(col).alias("v"), epoch(ts).alias("t")))}, chunk=chunk)
    d, secs = F.col(col) - F.col("_p.v"), (epoch(ts) - F.col("_p.t")) / 1e6
    return out.withColumns({f"{col}_delta": d, f"{col}_rate": d / F.nullif(secs, F.lit(0.0))}).drop("_p")


def gradient(df: DataFrame, col: str, keys, order="ts", dt: float = 1.0, name: str = "gradient", chunk="1 day") -> DataFrame:
    """Central differences, one-sided at the ends; a lone row has none."""
    out = scan(df, keys, order, {"_p": prev(F.struct(F.col(col).alias("v"))), "_n": following(F.struct(F.col(col).alias("v")))}, chunk=chunk)
    x, p, n = F.col(col), F.col("_p"), F.col("_n")
    g = (F.when(p.isNotNull() & n.isNotNull(), (n["v"] - p["v"]) / (2 * dt))
         .when(n.isNotNull(), (n["v"] - x) / dt).when(p.isNotNull(), (x - p["v"]) / dt))
    return out.withColumn(name, g).drop("_p", "_n")


def lag_time(df: DataFrame, col: str, duration: str, keys, ts: str = "ts", name: str | None = None) -> DataFrame:
    """Value exactly ``duration`` earlier, by an equi-join on the shifted time."""
    k = [*cols(keys), ts]
    shifted = df.select(*cols(keys), from_epoch(epoch(ts) + micros(duration)).alias(ts), F.col(col).alias(name or f"{col}_lag_{duration}"))
    return df.transform(match, shifted, k, "left")


# ------------------------------------------------------------------ sliding windows


def sliding_windows(df: DataFrame, size: str, slide: str, keys, ts: str = "hour", min_fill: float = 0.5,
                    step: str = "1h", full_only: bool = True) -> DataFrame:
    """Assign each row to the windows holding it: ``window_no``, ``window_start``, ``window_rows``.

    Windows start at the key's first time and advance by ``slide``; a full window
    ends no later than the key's last time. Windows filled below ``min_fill`` are
    dropped. A row is copied size / slide times and nothing else is.
    """
    k, size_us, slide_us = cols(keys), micros(size), micros(slide)
    t = epoch(ts)
    ends = df.groupBy(*k).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    both = df.transform(match, ends, k) if k else attach_row(df, ends)
    off, last = t - F.col("_a"), floor_div(F.col("_b") - F.col("_a") - size_us, slide_us)
    hi = floor_div(off, slide_us)
    hi = F.least(hi, last) if full_only else hi
    lo = F.greatest(floor_div(off - size_us, slide_us) + 1, F.lit(0).cast("long"))
    out = (both.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
           .withColumn("window_no", F.explode(F.sequence("_lo", "_hi")))
           .withColumn("window_start", from_epoch(F.col("_a") + F.col("window_no") * slide_us)))
    return out.drop("_a", "_b", "_lo", "_hi")


def filled_windows(windows: DataFrame, keys, size: str, step: str = "1h", min_fill: float = 0.5,
                   aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """Aggregate rows per window and keep windows filled to at least ``min_fill``."""
    need = micros(size) / micros(step) * min_fill
    out = windows.groupBy(*cols(keys), "window_no", "window_start").agg(
        F.count(F.lit(1)).alias("window_rows"), *[c.alias(n) for n, c in (aggs or {}).items()])
    return out.where(F.col("window_rows") >= int(need))


def pane_windows(df: DataFrame, size: str, slide: str, keys, values: Sequence[str], ts: str = "hour", extra: Mapping[str, Column] | None = None,
                 min_rows: int = 1) -> DataFrame:
    """Sliding-window mean, std, min, max and count of several columns, without copying rows.

    Windows as in ``sliding_windows``; ``size`` is a multiple of ``slide``. Rows are
    first reduced to one partial result per pane of width ``slide``; each window then
    adds up its size / slide panes. ``extra`` sums, per window, further expressions.
    """
    k, size_us, slide_us = cols(keys), micros(size), micros(slide)
    if size_us % slide_us:
        raise ValueError("size must be a multiple of slide")
    per, t = size_us // slide_us, epoch(ts)
    w = Window.partitionBy(*k)  # rows per key are bounded by the grid
    d = df.withColumns({"_a": F.min(t).over(w), "_b": F.max(t).over(w)})
    d = d.withColumn("_last", floor_div(F.col("_b") - F.col("_a") - size_us, slide_us))
    parts = [F.count(F.lit(1)).alias("window_rows")]
    for c in values:
        parts += [F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q"),
                  F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
    parts += [F.sum(e).alias(f"_x_{n}") for n, e in (extra or {}).items()]
    panes = d.withColumn("_pane", floor_div(t - F.col("_a"), slide_us)).groupBy(*k, "_a", "_last", "_pane").agg(*parts)
    lo = F.greatest(F.col("_pane") - (per - 1), F.lit(0).cast("long"))
    spread = (panes.withColumn("_hi", F.least(F.col("_pane"), F.col("_last"))).withColumn("_lo", lo).where("_lo <= _hi")
              .withColumn("window_no", F.explode(F.sequence("_lo", "_hi"))))
    adds = [F.sum("window_rows").alias("window_rows")]
    for c in values:
        adds += [F.sum(f"{c}_n").alias(f"{c}_n"), F.sum(f"{c}_s").alias(f"{c}_s"), F.sum(f"{c}_q").alias(f"{c}_q"),
                 F.min(f"{c}_lo").alias(f"{c}_min"), F.max(f"{c}_hi").alias(f"{c}_max")]
    adds += [F.sum(f"_x_{n}").alias(n) for n in (extra or {})]
    g = spread.groupBy(*k, "_a", "window_no").agg(*adds).where(F.col("window_rows") >= min_rows)
    out = [*k, F.col("window_no"), from_epoch(F.col("_a") + F.col("window_no") * slide_us).alias("window_start"), F.col("window_rows")]
    for c in values:
        n, s, q = F.col(f"{c}_n"), F.col(f"{c}_s"), F.col(f"{c}_q")
        var = F.greatest((q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
        out += [n.alias(f"{c}_count"), (s / F.nullif(n, F.lit(0))).alias(f"{c}_mean"), F.when(n > 1, F.sqrt(var)).alias(f"{c}_std"),
                F.col(f"{c}_min"), F.col(f"{c}_max")]
    return g.select(*out, *(extra or {}))


def sliding_rows(df: DataFrame, size: int, slide: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Windows counted in rows; a short tail counts if at least half full (one row per row and window)."""
    pos = scan(df, keys, order, {"_n": running_count()}, chunk=chunk)
    i = F.col("_n") - 1
    lo = F.greatest(floor_div(i - size, slide) + 1, F.lit(0).cast("long"))
    out = pos.withColumn("window_no", F.explode(F.sequence(lo, floor_div(i, slide)))).drop("_n")
    fill = out.groupBy(*cols(keys), "window_no").agg(F.count(F.lit(1)).alias("window_rows")).where(F.col("window_rows") >= size / 2)
    return out.transform(match, fill, [*cols(keys), "window_no"])


def volatility(df: DataFrame, col: str, rows: Mapping[str, int], keys, order="ts", sample: bool = True, chunk="1 day") -> DataFrame:
    """Rolling spread over several row counts, full windows only, in one pass."""
    f = F.stddev if sample else F.stddev_pop

    def build(w):
        out = {}
        for name, n in rows.items():
            frame = w.rowsBetween(-n + 1, 0)
            out[name] = F.when(F.count(col).over(frame) == n, f(col).over(frame))
        return out

    return row_frames(df, keys, order, max(rows.values()) - 1, 0, build, chunk=chunk)


def rolling_summary(df: DataFrame, col: str, every: str, keys, ts: str = "ts") -> DataFrame:
    """Mean of block means and largest block spread over fixed blocks."""
    blocks = df.groupBy(*cols(keys), bucket_no(ts, every).alias("_b")).agg(F.avg(col).alias("m"), F.stddev(col).alias("s"))
    return blocks.groupBy(*cols(keys)).agg(F.avg("m").alias("mean_of_means"), F.max("s").alias("max_std"), F.count(F.lit(1)).alias("blocks"))


def price_features(df: DataFrame, price: str, keys=(), ts: str = "hour", chunk="spread") -> DataFrame:
    """Deviation from the month's mean, price 1 h and 24 h earlier, yesterday's mean, winter and peak flags."""
    from ..functions.calendar import trunc, winter

    k = cols(keys)
    month = df.groupBy(*k, trunc("month", ts).alias("_m")).agg(F.avg(price).alias("_mean"))
    day = df.groupBy(*k, from_epoch(epoch(trunc("day", ts)) + micros("1 day")).alias("_d")).agg(F.avg(price).alias("price_yesterday"))
    out = lag_time(lag_time(df, price, "1h", k, ts, "price_lag_1h"), price, "24h", k, ts, "price_lag_24h")
    out = out.withColumns({"_m": trunc("month", ts), "_d": trunc("day", ts)}).transform(match, month, [*k, "_m"], "left").transform(match, day, [*k, "_d"], "left")
    q = exact_quantiles(df, k, price, {"_p75": 0.75}, chunk=chunk)
    out = out.transform(match, q, k) if k else attach_row(out, q)
    return out.withColumns({"deviation": F.col(price) - F.col("_mean"), "is_winter": winter(ts),
                            "is_peak": F.col(price) > F.col("_p75")}).drop("_m", "_d", "_mean", "_p75")


def decompose(df: DataFrame, col: str, period: int, keys, order="ts", model: str = "additive", chunk=None) -> DataFrame:
    """Classical decomposition on a dense grid: centred moving average, phase means, remainder.

    The trend is NULL in the half period at each end.
    """
    half, even = period // 2, period % 2 == 0
    x = F.col(col)

    def build(w):
        frame = w.rowsBetween(-half, half)
        total = F.sum(x).over(frame)
        if even:
            total = total - (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2
        return {"trend": F.when(F.count(x).over(frame) == 2 * half + 1, total / period)}

    out = row_frames(scan(df, keys, order, {"_pos": running_count()}, chunk=chunk), keys, order, half, half, build, chunk=chunk)
    bare = x - F.col("trend") if model == "additive" else x / F.col("trend")
    out = out.withColumns({"_bare": bare, "_phase": (F.col("_pos") - 1) % period})
    k = cols(keys)
    phase = out.groupBy(*k, "_phase").agg(F.avg("_bare").alias("_s"))
    centre = phase.groupBy(*k).agg(F.avg("_s").alias("_c"))
    phase = phase.transform(match, centre, k) if k else attach_row(phase, centre)
    additive = model == "additive"
    phase = phase.select(*k, "_phase", (F.col("_s") - F.col("_c") if additive else F.col("_s") / F.col("_c")).alias("seasonal"))
    resid = F.col("_bare") - F.col("seasonal") if additive else F.col("_bare") / F.col("seasonal")
    return out.transform(match, phase, [*k, "_phase"]).withColumn("resid", resid).drop("_pos", "_bare", "_phase")
