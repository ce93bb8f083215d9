"""Registry of series calculators and per-sensor profiles.

A calculator maps a prepared frame (value ``v``, its lags and leads, key-level
``mean``, ``std``, ``n``) to one aggregate expression, so a whole profile is one
aggregation over one window pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import attach_row, cols, exact_quantiles, last_valid, match, row_frames, running_count, scan

V, P, N1, P2 = F.col, "_p1", "_n1", "_p2"

MINIMAL: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.sum("v"), "mean": lambda: F.avg("v"), "length": lambda: F.count("v"), "std": lambda: F.stddev_pop("v"),
    "var": lambda: F.var_pop("v"), "rms": lambda: F.sqrt(F.avg(V("v") * V("v"))), "max": lambda: F.max("v"),
    "abs_max": lambda: F.max(F.abs("v")), "min": lambda: F.min("v"),
}

EFFICIENT: dict[str, Callable[[], Column]] = {
    "abs_energy": lambda: F.sum(V("v") * V("v")),
    "abs_sum_of_changes": lambda: F.sum(F.abs(V("v") - V(P))),
    "mean_abs_change": lambda: F.avg(F.abs(V("v") - V(P))),
    "mean_change": lambda: F.avg(V("v") - V(P)),
    "mean_second_derivative": lambda: F.avg((V(N1) - 2 * V("v") + V(P)) / 2),
    "cid_ce": lambda: F.sqrt(F.sum(F.pow(V("v") - V(P), 2))),
    "count_above_mean": lambda: F.count_if(V("v") > V("mean")),
    "count_below_mean": lambda: F.count_if(V("v") < V("mean")),
    "longest_strike_above_mean": lambda: F.coalesce(F.max(F.when(V("v") > V("mean"), V("_run"))), F.lit(0)),
    "longest_strike_below_mean": lambda: F.coalesce(F.max(F.when(V("v") < V("mean"), V("_run"))), F.lit(0)),
    "first_location_of_max": lambda: F.min_by((V("_i") - 1) / V("n"), F.struct(-V("v"), V("_i"))),
    "first_location_of_min": lambda: F.min_by((V("_i") - 1) / V("n"), F.struct(V("v"), V("_i"))),
    "last_location_of_max": lambda: F.min_by(V("_i") / V("n"), F.struct(-V("v"), -V("_i"))),
    "last_location_of_min": lambda: F.min_by(V("_i") / V("n"), F.struct(V("v"), -V("_i"))),
    "c3_1": lambda: F.avg(V("v") * V(P) * V(P2)),
    "time_reversal_asymmetry_1": lambda: F.avg(V("v") * V("v") * V(P) - V(P) * V(P2) * V(P2)),
    "ratio_beyond_1_sigma": lambda: F.count_if(F.abs(V("v") - V("mean")) > V("std")) / F.count("v"),
    "ratio_beyond_2_sigma": lambda: F.count_if(F.abs(V("v") - V("mean")) > 2 * V("std")) / F.count("v"),
    "trend_slope": lambda: F.regr_slope(V("v"), (V("_i") - 1).cast("double")),
    "trend_intercept": lambda: F.regr_intercept(V("v"), (V("_i") - 1).cast("double")),
    "crossings_mean": lambda: F.count_if((V("v") > V("mean")) != (V(P) > V("mean"))),
    "peaks_1": lambda: F.count_if((V("v") > V(P)) & (V("v") > V(N1))),
    "variance_larger_than_std": lambda: F.max(F.when(V("std") * V("std") > V("std"), 1).otherwise(0)),
    "large_std_ratio": lambda: F.max(V("std")) / F.nullif(F.max("v") - F.min("v"), F.lit(0.0)),
}


def register(name: str, build: Callable[[], Column], profile: dict = EFFICIENT) -> None:
    """Add a calculator to a profile."""
    profile[name] = build


def prepare(df: DataFrame, value: str, keys, order="ts", chunk="1 day") -> DataFrame:
    """Lags, lead, positions, key statistics and places in runs on one side of the mean, of which the last is a run's length."""
    k = cols(keys)
    d = df.where(F.col(value).isNotNull()).select(*k, *cols(order), F.col(value).cast("double").alias("v"))
    stats = d.groupBy(*k).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))
    d = scan(d, k, order, {"_i": running_count()}, chunk=chunk)
    d = row_frames(d, k, order, 2, 1, lambda w: {P: F.lag("v").over(w), P2: F.lag("v", 2).over(w), N1: F.lead("v").over(w)}, chunk=chunk)
    side = F.signum(F.col("v") - F.col("mean"))
    d = d.transform(match, stats, k).withColumn("_side", side)
    starts = F.coalesce((side != F.signum(F.col(P) - F.col("mean"))), F.lit(True))
    d = scan(d, k, order, {"_start": last_valid(F.when(starts, F.col("_i")))}, chunk=chunk)
    return d.withColumn("_run", F.col("_i") - F.col("_start") + 1)


def extract(df: DataFrame, value: str, keys, profile: Mapping[str, Callable[[], Column]], order="ts", chunk="1 day") -> DataFrame:
    """All calculators of a profile per key."""
    return prepare(df, value, keys, order, chunk).groupBy(*cols(keys)).agg(*[f().alias(n) for n, f in profile.items()])


def minimal(df: DataFrame, value: str, keys, chunk="spread") -> DataFrame:
    """The minimal set needs no window at all; the median comes from ranks."""
    k = cols(keys)
    d = df.where(F.col(value).isNotNull()).select(*k, F.col(value).cast("double").alias("v"))
    out = d.groupBy(*k).agg(*[f().alias(n) for n, f in MINIMAL.items()])
    return out.transform(match, exact_quantiles(d, k, "v", {"median": 0.5}, chunk=chunk), k)


def duplicate_features(df: DataFrame, value: str, keys) -> DataFrame:
    """Duplicates of the extremes, share of reoccurring values and of reoccurring points, distinct share."""
    k = cols(keys)
    seen = df.where(F.col(value).isNotNull()).groupBy(*k, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    many = F.col("c") > 1
    return seen.groupBy(*k).agg(
        (F.max_by("c", "v") > 1).alias("has_duplicate_max"), (F.min_by("c", "v") > 1).alias("has_duplicate_min"),
        F.max(many).alias("has_duplicate"), (F.count_if(many) / F.count(F.lit(1))).alias("reoccurring_values"),
        (F.sum(F.when(many, F.col("c")).otherwise(0)) / F.sum("c")).alias("reoccurring_points"),
        (F.count(F.lit(1)) / F.sum("c")).alias("distinct_share"), F.sum(F.when(many, F.col("v")).otherwise(0.0)).alias("sum_of_reoccurring_values"))


def energy_chunks(df: DataFrame, value: str, keys, parts: int, order="ts", chunk="1 day") -> DataFrame:
    """Share of the energy in each of ``parts`` equal stretches of the series."""
    k = cols(keys)
    n = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_e"))
    d = scan(df, k, order, {"_i": running_count()}, chunk=chunk).transform(match, n, k)
    part = F.floor((F.col("_i") - 1) * parts / F.col("_n")).cast("int")
    return d.groupBy(*k, part.alias("part")).agg((F.sum(F.col(value) * F.col(value)) / F.nullif(F.max("_e"), F.lit(0.0))).alias("energy_share"))


def range_count(df: DataFrame, value: str, keys, ranges: Sequence[tuple[float, float]], values: Sequence[float] = ()) -> DataFrame:
    x = F.col(value)
    return df.groupBy(*cols(keys)).agg(*[F.count_if((x >= a) & (x < b)).alias(f"range_{i}") for i, (a, b) in enumerate(ranges)],
                                       *[F.count_if(x == t).alias(f"value_{i}") for i, t in enumerate(values)])


def support_peaks(df: DataFrame, value: str, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Points above all ``n`` neighbours on both sides."""
    x = F.col(value)

    def build(w):
        left, right = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
        return {"_peak": (F.count(x).over(left) == n) & (F.count(x).over(right) == n) & (x > F.max(x).over(left)) & (x > F.max(x).over(right))}

    return row_frames(df, keys, order, n, n, build, chunk=chunk).groupBy(*cols(keys)).agg(F.count_if("_peak").alias(f"peaks_{n}"))


def profile_of(sensor: str, efficient: Sequence[str]) -> dict[str, Callable[[], Column]]:
    """Minimal by default, the efficient set for the listed sensors."""
    return {**MINIMAL, **EFFICIENT} if sensor in efficient else dict(MINIMAL)


def extract_profiled(df: DataFrame, value: str, keys, sensor: str, efficient: Sequence[str], order="ts", chunk="1 day") -> DataFrame:
    """Long features (key, sensor, feature, value): every sensor gets the minimal set, listed ones the efficient set too."""
    k = [*cols(keys), sensor]

    def long(d, names):
        wide = d.select(*k, *[F.col(n).cast("double").alias(n) for n in names])
        return wide.unpivot(k, list(names), "feature", "value")

    small = df.where(F.col(value).isNotNull()).select(*k, F.col(value).cast("double").alias("v")).groupBy(*k).agg(
        *[f().alias(n) for n, f in MINIMAL.items()])
    big = extract(df.where(F.col(sensor).isin(*efficient)), value, k, EFFICIENT, order, chunk)
    return long(small, MINIMAL).unionByName(long(big, EFFICIENT))


def column_medians(df: DataFrame, columns: Sequence[str], suffix: str = "_med") -> DataFrame:
    """One row with the exact median of every column, from one rank pass over the long form."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v")
    q = exact_quantiles(long.where(F.col("v").isNotNull()), "column", "v", {"m": 0.5})
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"{c}{suffix}") for c in columns])


def impute_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature matrix repair: infinities to the column's finite extremes, NULL and NaN to its median."""
    inf = float("inf")
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != inf), F.col(c)) for c in columns}
    ends = df.agg(*[f(finite[c]).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    fixed = attach_row(ends, column_medians(df.select(*[finite[c].alias(c) for c in columns]), columns))
    made = {c: F.when(F.col(c) == inf, F.col(f"{c}_hi")).when(F.col(c) == -inf, F.col(f"{c}_lo"))
            .when(F.col(c).isNull() | F.isnan(c), F.col(f"{c}_med")).otherwise(F.col(c)) for c in columns}
    return attach_row(df, fixed).withColumns(made).select(*df.columns)


def distribution_features(df: DataFrame, value: str, keys, quantiles: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9), bins: int = 10, chunk="spread") -> DataFrame:
    """Quantiles ``quantile_p`` and ``binned_entropy`` per key.

    The entropy is that of ``bins`` equal parts of the key's range, the last one closed; a constant series has none (0). NULL
    values take no part, and keys without values no row.
    """
    k = cols(keys)
    d = df.where(F.col(value).isNotNull()).select(*k, F.col(value).cast("double").alias("_v"))
    ends = d.groupBy(*k).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    part = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    counts = match(d, ends, k).groupBy(*k, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))  # at most ``bins`` rows per key
    total = F.sum("_c")
    entropy = counts.groupBy(*k).agg((F.ln(total) - F.sum(F.col("_c") * F.ln("_c")) / total).alias("binned_entropy"))
    names = {f"quantile_{round(100 * q)}": q for q in quantiles}
    return match(exact_quantiles(d, k, "_v", names, chunk=chunk), entropy, k)
