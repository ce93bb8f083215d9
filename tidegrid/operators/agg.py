"""Aggregates, profiles, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import attach_row, bucket, cols, epoch, exact_quantiles, from_epoch, match, prev, scan
from ..functions.calendar import trunc
from ..functions.stats import corr

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC and n not in skip]


# ------------------------------------------------------------------ calendar grains


def hourly(df: DataFrame, signals: Sequence[str], keys=(), ts: str = "ts", lamps: Sequence[str] = (),
           stats: Sequence[str] = ("mean", "count", "std", "min", "max")) -> DataFrame:
    """Per key and hour: statistics per signal, any lamp on, share of lamp readings on, records."""
    fn = {"mean": F.avg, "count": F.count, "std": F.stddev, "min": F.min, "max": F.max}
    aggs = [fn[s](c).alias(f"{c}_{s}") for c in signals for s in stats]
    if lamps:
        any_on = F.lit(False)
        for c in lamps:
            any_on = any_on | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
        aggs += [F.max(any_on).alias("lamp_on"), F.avg(any_on.cast("int")).alias("lamp_ratio")]
    return (df.groupBy(*cols(keys), bucket(ts, "1h").alias("hour"))
            .agg(*aggs, F.count(F.lit(1)).alias("total_records")))


def coverage(df: DataFrame, counts: Sequence[str], expected: int) -> DataFrame:
    """``<signal>_coverage`` per count column and their mean ``overall_coverage``."""
    made = {c.removesuffix("_count") + "_coverage": F.col(c) / expected for c in counts}
    overall = sum(list(made.values())[1:], list(made.values())[0]) / len(made)
    return df.withColumns({**made, "overall_coverage": overall})


SUMMED = ("dli", "radiation", "light", "dosing_status")  # fixed values: signals whose totals matter


def daily(df: DataFrame, columns: Sequence[str], keys=(), ts: str = "ts", label: Column | None = None,
          grain: str = "daily") -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_{grain}_mean"), F.min(c).alias(f"{c}_{grain}_min"),
                 F.max(c).alias(f"{c}_{grain}_max"), F.stddev(c).alias(f"{c}_{grain}_std")]
        if any(s in c.lower() for s in SUMMED):
            aggs.append(F.sum(c).alias(f"{c}_{grain}_sum"))
    day = trunc("day", ts) if label is None else label
    return df.groupBy(*cols(keys), day.alias("day" if grain == "daily" else "week")).agg(*aggs)


def weekly(df: DataFrame, columns: Sequence[str], keys=(), ts: str = "ts") -> DataFrame:
    """Weeks ending (and labelled) on Monday."""
    monday = F.next_day(F.date_sub(F.to_date(ts), 1), "Mon").cast("timestamp_ntz")
    return daily(df, columns, keys, ts, monday, "weekly")


def price_series(df: DataFrame, value: str, ts: str, grain: str) -> DataFrame:
    return df.groupBy(trunc(grain, ts).alias(grain)).agg(F.avg(value).alias("price"))


def heat_table(df: DataFrame, value: str, first: Column, second: Column, keys=()) -> DataFrame:
    """Two-way mean table, for example month x hour."""
    return df.groupBy(*cols(keys), first.alias("k1"), second.alias("k2")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


# --------------------------------------------------------------------- statistics


def basic_stats(df: DataFrame, value: str, keys) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("min"),
                                       F.max(value).alias("max"), F.count(value).alias("count"))


def moments(value: str) -> dict[str, Column]:
    return {"mean": F.avg(value), "std": F.stddev(value), "min": F.min(value), "max": F.max(value),
            "skewness": F.skewness(value), "kurtosis": F.kurtosis(value), "count": F.count(value)}


QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def histogram_entropy(df: DataFrame, value: str, keys, bins: int, base: float | None = 2.0) -> DataFrame:
    """Shannon entropy of an equal-width histogram between the key's extremes."""
    keys = cols(keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins),
                 F.lit(bins - 1).cast("long"))
    counts = (df.where(F.col(value).isNotNull()).transform(match, ends, keys).withColumn("_bin", F.coalesce(at, F.lit(0).cast("long")))
              .groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")))
    p = F.col("_c") / F.col("_n")
    log = F.ln(p) if base is None else F.log(base, p)
    return counts.groupBy(*keys).agg((-F.sum(p * log)).alias("entropy"))


def ext_stats(df: DataFrame, value: str, keys, bins: int = 50, chunk="spread") -> DataFrame:
    """Moments, quantiles, MAD, IQR and histogram entropy per key."""
    keys = cols(keys)
    x = df.select(*keys, value).where(F.col(value).isNotNull())
    q = exact_quantiles(x, keys, value, QUANTILES, chunk=chunk)
    dev = x.transform(match, q.select(*keys, "p50"), keys).withColumn("_d", F.abs(F.col(value) - F.col("p50")))
    mad = exact_quantiles(dev, keys, "_d", {"mad": 0.5}, chunk=chunk)
    out = x.groupBy(*keys).agg(*[c.alias(n) for n, c in moments(value).items()])
    return (out.transform(match, q, keys).transform(match, mad, keys).transform(match, histogram_entropy(x, value, keys, bins, None), keys)
            .withColumn("iqr", F.col("p75") - F.col("p25")))


def window_stats(df: DataFrame, value: str, keys) -> DataFrame:
    """As ``ext_stats`` for groups bounded by construction (a window on a grid): one aggregation."""
    pct = F.percentile(value, F.array(*[F.lit(p) for p in QUANTILES.values()]))
    out = df.groupBy(*cols(keys)).agg(*[c.alias(n) for n, c in moments(value).items()], pct.alias("_q"))
    return out.withColumns({n: F.col("_q")[i] for i, n in enumerate(QUANTILES)}).drop("_q").withColumn(
        "iqr", F.col("p75") - F.col("p25"))


def block_stats(df: DataFrame, value: str, keys, order="ts") -> DataFrame:
    """Range, coefficient of variation, energy and the times of the extremes."""
    x, o = F.col(value), F.struct(*cols(order))
    return df.groupBy(*cols(keys)).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), (F.max(x) - F.min(x)).alias("range"),
        F.try_divide(F.stddev_pop(x), F.abs(F.avg(x))).alias("cv"), F.sum(x * x).alias("energy"),
        F.min_by(cols(order)[0], F.struct(x, o)).alias("argmin"), F.min_by(cols(order)[0], F.struct(-x, o)).alias("argmax"))


def column_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Type, missing count and share, distinct values, range and moments per column in one aggregation."""
    types = dict(df.dtypes)
    distinct = F.approx_count_distinct if approx else F.countDistinct
    parts = []
    for c in columns:
        num = F.col(c).cast("double") if types[c] in NUMERIC else F.lit(None).cast("double")
        missing = F.count_if(F.col(c).isNull())
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), missing.alias("missing"),
                              (missing / F.count(F.lit(1)) * 100).alias("missing_pct"), distinct(c).alias("uniques"),
                              F.min(num).alias("min"), F.max(num).alias("max"), F.avg(num).alias("mean"),
                              F.stddev(num).alias("std")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def completeness(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Columns ranked by their share of non-null values."""
    from .clean import column_coverage

    out = column_coverage(df, columns).withColumnRenamed("coverage", "completeness")
    return out.orderBy(F.desc("completeness"), "column").limit(top) if top else out


def status_ratio(df: DataFrame, columns: Sequence[str], keys=()) -> DataFrame:
    """Share of true readings per status column, then the mean over keys (files)."""
    keys = cols(keys)
    per = df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("boolean").cast("int")).alias(c) for c in columns])
    return melt(per, keys, columns, "column", "ratio").groupBy("column").agg(F.avg("ratio").alias("ratio"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Frequencies including NULL; ``top`` most frequent, ties by value."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(top) if top else out


def availability(df: DataFrame, columns: Sequence[str], every: str, keys=(), ts: str = "ts") -> DataFrame:
    """Per bucket: presence flag per column, all present, number present."""
    out = df.groupBy(*cols(keys), bucket(ts, every).alias("bucket")).agg(
        *[F.max(F.col(c).isNotNull()).alias(f"{c}_present") for c in columns])
    n = sum((F.col(f"{c}_present").cast("int") for c in columns), F.lit(0))
    return out.withColumns({"n_present": n, "all_present": n == len(columns)})


def missing_matrix(df: DataFrame, columns: Sequence[str], every: str = "1 day", keys=(), ts: str = "ts") -> DataFrame:
    """Long form: bucket x column, true where the column is wholly missing."""
    out = df.groupBy(*cols(keys), bucket(ts, every).alias("bucket")).agg(
        *[(F.count(c) == 0).alias(c) for c in columns])
    return melt(out, [*cols(keys), "bucket"], columns, "column", "missing")


def map_profile(df: DataFrame, json: str, keys) -> DataFrame:
    """Readings per JSON key within an era, number of sensors, and mean fill per sensor."""
    keys = cols(keys)
    names = df.select(*keys, F.explode(F.json_object_keys(F.col(json))).alias("name"))
    per = names.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("readings"))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("sensors"), F.sum("readings").alias("readings")).transform(match, 
        total, keys).withColumn("suitability", F.col("readings") / (F.col("rows") * F.col("sensors")))


def era_stats(eras: DataFrame, keys, rows: str = "rows") -> DataFrame:
    return eras.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("eras"), F.avg(rows).alias("avg_rows"),
                                         F.min(rows).alias("min_rows"), F.max(rows).alias("max_rows"))


# ------------------------------------------------------------------------ actuators


def on_hours(df: DataFrame, status: str, keys, ts: str = "ts", max_step: str = "1 day", chunk="1 day") -> DataFrame:
    """Daily hours on: each reading holds until the next one, but not longer than ``max_step``."""
    from ..frames import following, micros

    t = epoch(ts)
    nxt = scan(df, keys, ts, {"_n": following(t)}, chunk=chunk)
    held = F.least(F.coalesce(F.col("_n") - t, F.lit(0)), F.lit(micros(max_step))) / 3600e6
    return nxt.groupBy(*cols(keys), trunc("day", ts).alias("day")).agg(
        F.sum(F.when(F.col(status).cast("boolean"), held).otherwise(0.0)).alias("on_hours"))


def mean_on_hours(df: DataFrame, status: str, keys, grain: str = "day", ts: str = "ts") -> DataFrame:
    """Hours on per period from the mean status x 24."""
    return df.groupBy(*cols(keys), trunc(grain, ts).alias(grain)).agg(
        (F.avg(F.col(status).cast("int")) * 24).alias("on_hours"))


def hour_profile(df: DataFrame, value: str, keys, ts: str = "ts") -> DataFrame:
    return df.groupBy(*cols(keys), F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def by_state(df: DataFrame, sensor: str, keys, chunk="spread") -> DataFrame:
    """Quartiles, mean and count of a sensor per group and state."""
    q = exact_quantiles(df, keys, sensor, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, chunk=chunk)
    return q.transform(match, df.groupBy(*cols(keys)).agg(F.avg(sensor).alias("mean"), F.count(sensor).alias("n")), cols(keys))


# ---------------------------------------------------------------------- correlation


def corr_matrix(df: DataFrame, columns: Sequence[str], keys=()) -> DataFrame:
    """Pairwise Pearson correlations (each pair once) per group in one aggregation."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr"))
             for i, a in enumerate(columns) for b in columns[i + 1:]]
    return df.groupBy(*cols(keys)).agg(F.array(*parts).alias("_r")).select(*cols(keys), F.inline("_r"))


def pair_corr(df: DataFrame, pairs: Sequence[tuple[str, str]], keys=(), min_n: int = 10) -> DataFrame:
    """Correlation over rows where both are present; too few rows or no variation give 0."""
    parts = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"),
                              F.when(F.count_if(both) > min_n, F.coalesce(corr(a, b), F.lit(0.0))).otherwise(0.0).alias("corr")))
    return df.groupBy(*cols(keys)).agg(F.array(*parts).alias("_r")).select(*cols(keys), F.inline("_r"))


def attach_dim_stats(df: DataFrame, dim: DataFrame, columns: Sequence[str], prefix: str = "dim_") -> DataFrame:
    """Mean and spread of a dimension's numeric columns as constants on every row."""
    one = dim.agg(*[f(c).alias(f"{prefix}{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev))])
    return attach_row(df, one)


def summarize_runs(df: DataFrame, value: str, keys, chunk="spread") -> DataFrame:
    """Mean, population spread, median, IQR, extremes and number of runs."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, chunk=chunk)
    s = df.groupBy(*cols(keys)).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
                                    F.max(value).alias("max"), F.count(value).alias("n"))
    return s.transform(match, q, cols(keys)).withColumn("iqr", F.col("q3") - F.col("q1")).drop("q1", "q3")


def aggregate_runs(df: DataFrame, values: Sequence[str], keys) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(*[f(c).alias(f"{c}_{n}") for c in values
                                         for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count(F.lit(1)).alias("runs"))


def partition_count(df: DataFrame, keys, name: str = "partition_rows") -> DataFrame:
    """Rows of the partition beside each row: pre-aggregated and joined back, so a hot key is never sorted."""
    counts = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias(name))
    return df.transform(match, counts, cols(keys))


def change_stats(df: DataFrame, value: str, keys, order="ts", chunk="1 day") -> DataFrame:
    d = scan(df, keys, order, {"_p": prev(value)}, chunk=chunk).withColumn("_d", F.col(value) - F.col("_p"))
    return d.groupBy(*cols(keys)).agg(F.avg("_d").alias("mean_change"), F.stddev("_d").alias("std_change"))


# ----------------------------------------------------------------- reshaping, scaling


def melt(df: DataFrame, ids, columns: Sequence[str], name: str = "signal", value: str = "value") -> DataFrame:
    """Wide to long without NULLs."""
    return df.unpivot(cols(ids), list(columns), name, value).where(F.col(value).isNotNull())


def pivot(df: DataFrame, ids, by: str, labels: Sequence[str], value: str) -> DataFrame:
    """Long to wide with known labels: conditional means in one aggregation."""
    return df.groupBy(*cols(ids)).agg(*[F.avg(F.when(F.col(by) == x, F.col(value))).alias(x) for x in labels])


def fit_minmax(df: DataFrame, columns: Sequence[str], keys=()) -> DataFrame:
    """Fitted ranges as a table, to be stored and applied to other data."""
    types = dict(df.dtypes)
    use = [c for c in columns if types[c] != "boolean"]
    return df.groupBy(*cols(keys)).agg(*[f(c).alias(f"{c}_{n}") for c in use for n, f in (("lo", F.min), ("hi", F.max))])


def apply_minmax(df: DataFrame, fitted: DataFrame, columns: Sequence[str], keys=()) -> DataFrame:
    """Scale to [-1, 1] with stored ranges; boolean columns are left alone."""
    keys = cols(keys)
    both = df.transform(match, fitted, keys, "left") if keys else attach_row(df, fitted)
    use = [c for c in columns if f"{c}_lo" in fitted.columns]
    made = {c: 2 * (F.col(c) - F.col(f"{c}_lo")) / F.nullif(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(0.0)) - 1 for c in use}
    return both.withColumns(made).select(*df.columns)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The ``k`` largest; every task keeps only its own best."""
    return df.orderBy(F.desc(by), tie).limit(k)


def cheapest_quartile(df: DataFrame, price: str, keys=(), chunk="spread") -> DataFrame:
    """Rows priced at or below the first quartile of their key."""
    keys = cols(keys)
    q = exact_quantiles(df, keys, price, {"_q": 0.25}, chunk=chunk)
    both = df.transform(match, q, keys) if keys else attach_row(df, q)
    return both.where(F.col(price) <= F.col("_q")).drop("_q")


def daily_total(df: DataFrame, value: str, keys, ts: str = "ts", name: str = "day_total") -> DataFrame:
    """Whole-day total beside each row."""
    day = trunc("day", ts)
    total = df.groupBy(*cols(keys), day.alias("_day")).agg(F.sum(value).alias(name))
    return df.withColumn("_day", day).transform(match, total, [*cols(keys), "_day"]).drop("_day")


def span_grid(df: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    """One row per bucket between the overall first and last reading."""
    from ..frames import bucket_no, micros

    ends = df.agg(F.min(bucket_no(ts, every)).alias("a"), F.max(bucket_no(ts, every)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("i")).select(from_epoch(F.col("i") * micros(every)).alias(ts))


