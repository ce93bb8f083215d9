"""Cleaning operators over whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import attach_row, bucket, cols, epoch, exact_quantiles, match, prev, scan, time_frames
from ..functions import clean as fc


def apply_ranges(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]], **kw) -> DataFrame:
    """Values outside their physical range become NULL."""
    return df.withColumns({c: fc.within(c, lo, hi, **kw) for c, (lo, hi) in rules.items()})


def apply_sentinels(df: DataFrame, rules: Mapping[str, Sequence[float]]) -> DataFrame:
    return df.withColumns({c: fc.replace_sentinels(c, s) for c, s in rules.items()})


def clean_export(df: DataFrame, columns: Sequence[str], token: str = "#NUM!", limit: float = 1e30) -> DataFrame:
    """Drop rows with an error token or an absurd number; blanks become 0."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce((F.col(c) == token) | (F.abs(fc.parse_decimal(c)) > limit), F.lit(False))
    return df.where(~bad).withColumns({c: F.coalesce(fc.parse_decimal(c), F.lit(0.0)) for c in columns})


def clip_outliers(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]],
                  skip: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({c: fc.clip(c, lo, hi) for c, (lo, hi) in rules.items() if c not in skip})


def clip_counts(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]],
                skip: Sequence[str] = ()) -> DataFrame:
    """Low and high hits per clipped column, one pass."""
    parts = []
    for c, (lo, hi) in rules.items():
        if c in skip:
            continue
        low = F.count_if(F.col(c) < lo) if lo is not None else F.lit(0)
        high = F.count_if(F.col(c) > hi) if hi is not None else F.lit(0)
        parts.append(F.struct(F.lit(c).alias("column"), low.cast("long").alias("low"), high.cast("long").alias("high")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def iqr_bounds(df: DataFrame, col: str, keys=(), factor: float = 1.5, chunk="spread") -> DataFrame:
    q = exact_quantiles(df, keys, col, {"q1": 0.25, "q3": 0.75}, chunk=chunk)
    spread = F.col("q3") - F.col("q1")
    return q.select(*cols(keys), (F.col("q1") - factor * spread).alias("low"),
                    (F.col("q3") + factor * spread).alias("high"))


def iqr_outliers(df: DataFrame, col: str, keys, factor: float = 1.5, strategy: str = "null", chunk="spread") -> DataFrame:
    """Outliers beyond the quartiles by ``factor`` x IQR to NULL, or clipped to the bounds."""
    joined = df.transform(match, iqr_bounds(df, col, keys, factor, chunk), cols(keys), "left")
    x = F.col(col)
    if strategy == "clip":
        new = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("low")), F.col("high")))
    else:
        new = F.when(F.col("low").isNull() | x.between(F.col("low"), F.col("high")), x)
    return joined.withColumn(col, new).drop("low", "high")


def rolling_z_outliers(df: DataFrame, col: str, keys, window: str, threshold: float = 3.0,
                       min_n: int = 1, ts: str = "ts") -> DataFrame:
    """Flag ``outlier``: far from the trailing mean; a zero or unknown spread flags nothing."""

    def build(w):
        frame = w.rangeBetween(-_us(window) + 1, 0)
        n, m, s = (f(F.col(col)).over(frame) for f in (F.count, F.avg, F.stddev))
        return {"outlier": F.coalesce((n >= min_n) & (s > 0) & (F.abs((F.col(col) - m) / F.nullif(s, F.lit(0.0))) > threshold),
                                      F.lit(False))}

    return time_frames(df, keys, ts, window, 0, build)


def _us(window):
    from ..frames import micros

    return micros(window)


@dataclass(frozen=True)
class OutlierRule:
    column: str
    method: str  # domain | iqr | mad | winsorize
    strategy: str = "null"  # null | clip
    low: float | None = None
    high: float | None = None
    factor: float = 1.5


def mad_bounds(df: DataFrame, col: str, keys, factor: float = 3.0, chunk="spread") -> DataFrame:
    """median ± factor x 1.4826 x MAD per key."""
    med = exact_quantiles(df, keys, col, {"med": 0.5}, chunk=chunk)
    dev = df.transform(match, med, cols(keys)).withColumn("_dev", F.abs(F.col(col) - F.col("med")))
    spread = exact_quantiles(dev, keys, "_dev", {"mad": 0.5}, chunk=chunk)
    half = factor * 1.4826 * F.col("mad")
    return med.transform(match, spread, cols(keys)).select(*cols(keys), (F.col("med") - half).alias("low"),
                                               (F.col("med") + half).alias("high"))


def apply_outlier_rules(df: DataFrame, rules: Sequence[OutlierRule], keys, chunk="spread") -> DataFrame:
    """All rules in one projection; data-driven bounds are joined per key first."""
    keys, out, made, extra = cols(keys), df, {}, []
    for n, r in enumerate(rules):
        if r.low is not None and r.high is not None and r.low > r.high:
            raise ValueError(f"reversed bounds for {r.column}")
        lo, hi = F.lit(r.low).cast("double"), F.lit(r.high).cast("double")
        if r.method != "domain":
            if r.method == "iqr":
                b = iqr_bounds(df, r.column, keys, r.factor, chunk)
            elif r.method == "mad":
                b = mad_bounds(df, r.column, keys, r.factor, chunk)
            elif r.method == "winsorize":
                b = exact_quantiles(df, keys, r.column, {"low": 0.05, "high": 0.95}, chunk=chunk)
            else:
                raise ValueError(f"unknown outlier method {r.method}")
            lo, hi = F.col(f"_lo{n}"), F.col(f"_hi{n}")
            out = out.transform(match, b.withColumnsRenamed({"low": f"_lo{n}", "high": f"_hi{n}"}), keys, "left")
            extra += [f"_lo{n}", f"_hi{n}"]
        x = made.get(r.column, F.col(r.column))
        inside = F.coalesce(x >= lo, F.lit(True)) & F.coalesce(x <= hi, F.lit(True))
        if r.strategy == "clip" or r.method == "winsorize":
            made[r.column] = F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))
        else:
            made[r.column] = F.when(inside, x)
    return out.withColumns(made).drop(*extra)


def suggest_bounds(df: DataFrame, columns: Sequence[str],
                   limits: Mapping[str, tuple[float, float]] | None = None, chunk="spread") -> DataFrame:
    """p01/p25/p75/p99 bounds, widened by 1.5 IQR, cut to min/max and physical limits."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                         for c in columns])).alias("r")).select("r.column", "r.v")
    q = exact_quantiles(long, "column", "v", {"p01": 0.01, "p25": 0.25, "p75": 0.75, "p99": 0.99}, chunk=chunk)
    ends = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    caps = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(
        *[F.lit(float(v)) for v in (limits or {}).get(c, (float("-inf"), float("inf")))]))])
    cap, iqr = caps[F.col("column")], F.col("p75") - F.col("p25")
    low = F.greatest(F.least(F.col("p01"), F.col("p25") - 1.5 * iqr), F.col("lo"), cap[0])
    high = F.least(F.greatest(F.col("p99"), F.col("p75") + 1.5 * iqr), F.col("hi"), cap[1])
    return q.join(ends, "column").select("column", low.alias("low"), high.alias("high"))


def ensure_entity(df: DataFrame, name: str = "entity", default: str = "1") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def prepare_time(df: DataFrame, raw: str, ts: str = "ts", fmt: str | None = None) -> DataFrame:
    """Parse timestamps; rows that do not parse are dropped. Order is left to the consumers."""
    parsed = (F.try_to_timestamp(F.col(raw), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(raw)))
    return df.withColumn(ts, parsed.cast("timestamp_ntz")).where(F.col(ts).isNotNull())


def _pick(df: DataFrame, keys: Sequence[str], order: Column, first: bool) -> DataFrame:
    """One whole row per key by map-side combined ``min_by``/``max_by``: copies of a hot key never meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = (F.min_by if first else F.max_by)(F.struct(*rest), order)
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def dedupe_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key along ``order`` (which must break ties)."""
    return _pick(df, cols(keys), F.struct(*cols(order)), True)


def latest_by(df: DataFrame, keys, order) -> DataFrame:
    return _pick(df, cols(keys), F.struct(*cols(order)), False)


def latest_per_bucket(df: DataFrame, keys, every: str, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Latest row in each time bucket."""
    tagged = df.withColumn("bucket", bucket(ts, every))
    return latest_by(tagged, [*cols(keys), "bucket"], [ts, *tie])


def dedupe_mean(df: DataFrame, keys, values: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*cols(keys), ts).agg(*[F.avg(v).alias(v) for v in values])


def select_signals(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Named numeric columns, plus ``keep``."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")
               or t.startswith("decimal")}
    return df.select(*keep, *[n for n in names if n in numeric])


def column_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    share = [F.struct(F.lit(c).alias("column"), (F.count(c) / F.count(F.lit(1))).alias("coverage")) for c in columns]
    return df.agg(F.array(*share).alias("r")).select(F.inline("r"))


def select_by_coverage(df: DataFrame, columns: Sequence[str], min_coverage: float,
                       priority: Sequence[str] = (), max_n: int | None = None,
                       keep: Sequence[str] = ("ts",)) -> DataFrame:
    """Columns covered well enough: priority names first, then by coverage.

    The one-row coverage aggregate is read on the driver because a schema must be
    known before a plan exists; its size is the number of columns.
    """
    found = {r["column"]: r["coverage"] for r in column_coverage(df, columns).collect()}
    good = [c for c in columns if found[c] >= min_coverage]
    ranked = [c for c in priority if c in good]
    ranked += sorted((c for c in good if c not in ranked), key=lambda c: (-found[c], c))
    return df.select(*keep, *ranked[:max_n])


def viable(df: DataFrame, coverage: str = "coverage", minimum: float = 0.1) -> DataFrame:
    return df.where(F.col(coverage) > minimum)


def drop_empty(df: DataFrame, count: str = "n") -> DataFrame:
    return df.where(F.col(count) > 0)


def physics_check(df: DataFrame, col: str, keys, low: float, high: float, max_step: float,
                  order="ts", chunk="1 day") -> DataFrame:
    """Values out of bounds, or too far from the previous reading, become NULL."""
    x = F.col(col)
    out = scan(df, keys, order, {"_p": prev(x)}, chunk=chunk)
    step_ok = F.coalesce(F.abs(x - F.col("_p")) <= max_step, F.lit(True))
    return out.withColumn(col, F.when(x.between(low, high) & step_ok, x)).drop("_p")


def availability_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_available": fc.available(c) for c in columns})


def decimate(df: DataFrame, span: str = "7 days", step: str = "5 minutes", keys=(), ts: str = "ts") -> DataFrame:
    """Keep only rows on ``step`` epochs in series at least ``span`` long."""
    keys = cols(keys)
    ends = df.groupBy(*keys).agg((F.max(epoch(ts)) - F.min(epoch(ts))).alias("_span"))
    both = df.transform(match, ends, keys) if keys else attach_row(df, ends)
    whole_seconds = F.floor(epoch(ts) / 1_000_000).cast("long")
    keep = (F.col("_span") < _us(span)) | (F.pmod(whole_seconds, F.lit(_us(step) // 1_000_000)) == 0)
    return both.where(keep).drop("_span")
