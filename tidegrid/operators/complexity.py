"""Dependence and complexity of series.

Series are gridded: ``order`` numbers equal steps. Lagged copies come from one
window pass (``row_frames``), never from a self-join; quadratic measures run on
blocks whose length is fixed by the grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import all_of, cols, match, row_frames, running_count, scan


def _cov_about(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """Mean of (x - mx)(y - my) over rows where both are present, from mergeable moments."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) + (F.avg(a) - mx) * (F.avg(b) - my)


def acf(df: DataFrame, value: str, max_lag: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Autocorrelations 0..max_lag as an array, and the first lag at or below zero."""
    x = F.col(value)
    d = row_frames(df, keys, order, max_lag, 0, lambda w: {f"_x{k}": F.lag(value, k).over(w) for k in range(1, max_lag + 1)}, chunk=chunk)
    m, var = F.avg(x), F.var_pop(x)
    one = F.lit(1.0)
    parts = [one] + [_cov_about(x, F.col(f"_x{k}"), m, m) / F.nullif(var, F.lit(0.0)) for k in range(1, max_lag + 1)]
    out = d.groupBy(*cols(keys)).agg(F.array(*parts).alias("acf"))
    signed = F.transform("acf", lambda v, i: F.when(v <= 0, i))
    return out.withColumn("zero_lag", F.array_min(F.filter(signed, lambda i: i.isNotNull())))


def pacf(acfs: DataFrame, col: str = "acf") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion, folded over the small array."""
    a = F.col(col)
    at = lambda i: F.try_element_at(a, i + F.lit(1))

    def step(s, k):
        phi = s["phi"]
        num = at(k) - F.aggregate(F.transform(phi, lambda p, j: p * at(k - 1 - j)), F.lit(0.0), lambda t, v: t + v)
        den = 1 - F.aggregate(F.transform(phi, lambda p, j: p * at(j + 1)), F.lit(0.0), lambda t, v: t + v)
        last = F.when(F.abs(den) > 1e-10, num / F.nullif(den, F.lit(0.0))).otherwise(0.0)
        grown = F.concat(F.zip_with(phi, F.reverse(phi), lambda p, q: p - last * q), F.array(last))
        return F.struct(grown.alias("phi"), F.concat(s["out"], F.array(last)).alias("out"))

    start = F.struct(F.array(at(F.lit(1))).alias("phi"), F.array(F.lit(1.0), at(F.lit(1))).alias("out"))
    folded = F.aggregate(F.sequence(F.lit(2), F.size(a) - 1), start, step)
    return acfs.withColumn("pacf", F.when(F.size(a) > 2, folded["out"]).otherwise(F.array(F.lit(1.0), at(F.lit(1)))))


def cross_correlation(df: DataFrame, x: str, y: str, max_lag: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Correlations at lags -max..max (positive: y later than x), and the lag of largest magnitude."""
    lags = list(range(-max_lag, max_lag + 1))
    d = row_frames(df, keys, order, max_lag, max_lag, lambda w: {
        f"_y{i}": (F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(w) for i, k in enumerate(lags)}, chunk=chunk)
    scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    parts = [F.struct(F.lit(k).alias("lag"), (_cov_about(F.col(x), F.col(f"_y{i}"), F.avg(x), F.avg(y)) / scale).alias("r"))
             for i, k in enumerate(lags)]
    out = d.groupBy(*cols(keys)).agg(F.array(*parts).alias("xcorr"))
    best = F.array_max(F.transform("xcorr", lambda e: F.struct(F.abs(e["r"]).alias("m"), (-e["lag"]).alias("n"), e["r"].alias("r"))))
    return out.withColumns({"best_lag": -best["n"], "best_r": best["r"]})


def delayed_mutual_info(df: DataFrame, x: str, y: str, delay: int, bins: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Mutual information (bits) of x now and y ``delay`` steps later, on an equal-width grid."""
    k = cols(keys)
    d = row_frames(df, k, order, 0, max(delay, 1), lambda w: {"_y": F.lead(y, delay).over(w)}, chunk=chunk).where(
        F.col("_y").isNotNull() & F.col(x).isNotNull())
    ends = d.groupBy(*k).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"), F.count(F.lit(1)).alias("_n"))
    cell = lambda c, lo, hi: F.floor((c - lo) / (hi - lo + 1e-10) * (bins - 1))
    joint = (d.transform(match, ends, k).groupBy(*k, cell(F.col(x), F.col("_x0"), F.col("_x1")).alias("_i"), cell(F.col("_y"), F.col("_y0"), F.col("_y1")).alias("_j"))
             .agg((F.count(F.lit(1)) / F.max("_n")).alias("_p")))
    px, py = (joint.groupBy(*k, c).agg(F.sum("_p").alias(n)) for c, n in (("_i", "_px"), ("_j", "_py")))
    return (joint.transform(match, px, [*k, "_i"]).transform(match, py, [*k, "_j"]).groupBy(*k)
            .agg(F.sum(F.col("_p") * F.log2(F.col("_p") / (F.col("_px") * F.col("_py")))).alias("mutual_info")))


def permutation_entropy(df: DataFrame, value: str, order_n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Entropy of rank patterns of ``order_n`` consecutive values over its maximum."""
    k = cols(keys)
    v = [F.col(value) if i == 0 else F.col(f"_v{i}") for i in range(order_n)]
    d = row_frames(df, k, order, 0, order_n - 1, lambda w: {f"_v{i}": F.lead(value, i).over(w) for i in range(1, order_n)}, chunk=chunk)
    ranks = [sum(((v[j] < v[i]).cast("int") for j in range(order_n) if j != i), F.lit(0)) for i in range(order_n)]
    known = v[0].isNotNull()
    for c in v[1:]:
        known = known & c.isNotNull()
    counts = d.where(known).groupBy(*k, F.concat_ws(",", *[r.cast("string") for r in ranks]).alias("_pat")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(*k).agg(F.sum("_c").alias("_n"))
    p = F.col("_c") / F.col("_n")
    return counts.transform(match, total, k).groupBy(*k).agg((-F.sum(p * F.log2(p)) / math.log2(math.factorial(order_n))).alias("permutation_entropy"))


def higuchi(df: DataFrame, value: str, k_max: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Higuchi fractal dimension: slope of log curve length against log 1/k."""
    key = cols(keys)
    d = scan(df, key, order, {"_i": running_count()}, chunk=chunk)
    d = row_frames(d, key, order, 0, k_max, lambda w: {f"_d{k}": F.abs(F.lead(value, k).over(w) - F.col(value)) for k in range(1, k_max + 1)}, chunk=chunk)
    n = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_d{k}").alias("d")) for k in range(1, k_max + 1)])
    long = d.select(*key, "_i", F.explode(steps).alias("_s")).where(F.col("_s.d").isNotNull())
    k = F.col("k")
    curve = long.groupBy(*key, F.col("_s.k").alias("k"), F.pmod(F.col("_i") - 1, F.col("_s.k")).alias("_m")).agg(F.sum("_s.d").alias("_sum"), F.count(F.lit(1)).alias("_c"))
    length = curve.transform(match, n, key).withColumn("_l", F.col("_sum") * (F.col("_n") - 1) / (F.col("_c") * k * k)).groupBy(*key, "k").agg(F.avg("_l").alias("_l"))
    use = length.where(F.col("_l") > 0)
    return use.groupBy(*key).agg(F.regr_slope(F.ln("_l"), F.ln(1 / F.col("k"))).alias("fractal_dimension"))


def blocks(df: DataFrame, value: str, keys, block: Sequence[Column] | Column, order="ts", size: int | None = None) -> DataFrame:
    """Values of each block as an array in time order; ``size`` keeps only complete blocks.

    The block must bound its length: a fixed span of a fixed grid.
    """
    by = [block] if isinstance(block, Column) else list(block)
    out = df.groupBy(*cols(keys), *by).agg(F.sort_array(F.collect_list(F.struct(*cols(order), F.col(value).cast("double").alias("_v")))).alias("_a"))
    out = out.withColumn("x", F.transform("_a", lambda e: e["_v"])).drop("_a")
    return out.where(F.size("x") == size) if size else out


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def _spread(x: Column) -> Column:
    """Population standard deviation of an array, in one pass; NULL if empty."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s, v):
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + (v - s["mean"]) * (v - mean)).alias("m2"))

    return F.aggregate(x, start, step, lambda s: F.sqrt(s["m2"] / F.nullif(s["n"], F.lit(0.0))))


def _templates(blocked: DataFrame, x: str, size: int, count: Column, tol: float) -> DataFrame:
    """Rows (_k, _r, _t, _c): the different templates of ``size`` values among the first ``count`` starts of each block, and how often each occurs.

    ``_k`` holds the block's other columns, which name it, and ``_r`` the tolerance.
    """
    key = F.struct(*[c for c in blocked.columns if c != x])
    a = F.col(x)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(a, i, F.lit(size))))
    named = blocked.select(key.alias("_k"), (tol * _spread(a)).alias("_r"), x)  # before the explode: once per block
    rows = named.select("_k", "_r", F.explode(starts).alias("_t"))
    return rows.groupBy("_k", "_r", "_t").agg(F.count(F.lit(1)).alias("_c"))


def _near(templates: DataFrame, m: int) -> DataFrame:
    """Pairs of templates (_t with _c, _u with _n) of one block whose first ``m`` values are within the tolerance.

    Templates are put in a grid of cells as wide as the tolerance, so a partner lies in one of the 3^m cells around:
    an equi-join. A block whose values are all equal has no tolerance, and one template.
    """
    width = F.col("_r") * (1 + 1e-9)
    cell = lambda s: F.when(F.col("_r") > 0, F.floor(F.element_at("_t", s) / F.nullif(width, F.lit(0.0)))).otherwise(F.lit(0).cast("long"))
    home = templates.withColumn("_cell", F.array(*[cell(s) for s in range(1, m + 1)]))
    others = home.select("_k", F.col("_t").alias("_u"), F.col("_c").alias("_n"), "_cell")
    around = home
    for s in range(m):
        moved = F.array(*[F.col("_cell")[i] + (F.col("_step") if i == s else F.lit(0)) for i in range(m)])
        around = around.withColumn("_step", F.explode(F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)]))).withColumn("_cell", moved).drop("_step")
    close = all_of(F.abs(F.element_at("_t", s) - F.element_at("_u", s)) <= F.col("_r") for s in range(1, m + 1))
    return around.join(others, ["_k", "_cell"]).where(close)


def sample_entropy(blocked: DataFrame, m: int = 2, tol: float = 0.2, x: str = "x") -> DataFrame:
    """-ln(A / B) over the block's templates, self-matches excluded; 0 where undefined.

    Equal templates are one with a count, and neighbours come from a grid of cells: the cost follows the number
    of different near templates, not the square of the block. The columns beside ``x`` name the blocks.
    """
    keys = [c for c in blocked.columns if c != x]
    pairs = _near(_templates(blocked, x, m + 1, F.size(x) - m, tol), m)
    same = F.when(F.col("_t") == F.col("_u"), F.col("_c")).otherwise(F.lit(0))
    hits = (F.col("_c") * F.col("_n") - same).cast("double")
    longer = F.abs(F.element_at("_t", m + 1) - F.element_at("_u", m + 1)) <= F.col("_r")
    sums = pairs.groupBy("_k").agg(F.sum(hits).alias("_b"), F.sum(F.when(longer, hits)).alias("_a"))
    value = F.when((F.col("_a") > 0) & (F.col("_b") > 0), -F.ln(F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0)))).otherwise(0.0)
    return _with_blocks(blocked, sums.select("_k", value.alias("sample_entropy")), keys).withColumn("sample_entropy", F.coalesce("sample_entropy", F.lit(0.0)))


def _with_blocks(blocked: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return match(blocked, found.select("_k.*", *[c for c in found.columns if c != "_k"]), keys, "left")


def approximate_entropy(blocked: DataFrame, m: int = 2, tol: float = 0.2, x: str = "x") -> DataFrame:
    """phi(m) - phi(m + 1), self-matches included, from the same grid of cells; NULL for blocks shorter than m + 1."""
    keys = [c for c in blocked.columns if c != x]

    def phi(k: int, name: str) -> DataFrame:
        templates = _templates(blocked, x, k, F.size(x) - (k - 1), tol)
        n = templates.groupBy("_k").agg(F.sum("_c").alias("_all"))
        hits = _near(templates, k).groupBy("_k", "_t").agg(F.first("_c").alias("_c"), F.sum("_n").alias("_hits")).join(n, "_k")
        return hits.groupBy("_k").agg((F.sum(F.col("_c") * F.ln(F.col("_hits") / F.col("_all"))) / F.first("_all")).alias(name))

    both = phi(m, "_p").join(phi(m + 1, "_q"), "_k").select("_k", (F.col("_p") - F.col("_q")).alias("approximate_entropy"))
    return _with_blocks(blocked, both, keys)
