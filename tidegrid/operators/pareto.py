"""Solution tables: fronts, indicators, rank tests.

Objectives are minimised (flip a maximised one with ``minimised``). ``front_many``, ``epsilon_many``
and ``igd_plus_many`` take any number of them; the others are for two.
Fronts and indicators use ordered scans and as-of lookups; no solution is ever
compared with all others.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import all_of, attach_row, cols, following, is_plain, match, min_before, prev, running_count, value_chunk, value_ranks, value_scan
from ..functions.tails import chi2_tail, normal_two_sided
from ..sources.tables import stage
from .join import asof_join


def minimised(df: DataFrame, objectives: Mapping[str, str]) -> DataFrame:
    """Flip the sign of objectives marked ``max``."""
    return df.withColumns({c: -F.col(c) for c, goal in objectives.items() if goal == "max"})


def front_points(df: DataFrame, a: str, b: str, keys=(), chunk="spread") -> DataFrame:
    """Distinct non-dominated points, ordered by ``a``: each improves ``b`` on all smaller ``a``."""
    k = cols(keys)
    best = df.groupBy(*k, a).agg(F.min(b).alias(b))
    d = value_scan(best, k, a, {"_m": min_before(b)}, chunk=chunk)
    return d.where(F.col("_m").isNull() | (F.col(b) < F.col("_m"))).drop("_m")


def non_dominated(df: DataFrame, a: str, b: str, keys=(), chunk="spread") -> DataFrame:
    """Rows no other row dominates (equal rows do not dominate each other)."""
    return df.transform(match, front_points(df, a, b, keys, chunk), [*cols(keys), a, b], "left_semi")


def front_many(df: DataFrame, objectives, keys=(), rows: int = 50_000) -> DataFrame:
    """Rows that no other row dominates, for any number of objectives, all minimised.

    A row on the whole front is on the front of any part. Rows are dealt into parts of
    about ``rows`` by a hash of the objectives and each part is reduced to its front. With several parts the
    survivors stay partitioned: each is compared with nested cells of all survivors, of which only those whose lowest corner
    may dominate it are opened (``_dominated``). Rows with
    a NULL or NaN objective are on no front; equal rows do not dominate each other.
    """
    import numpy as np
    import pandas as pd

    k, names = cols(keys), list(objectives)
    d = df.where(all_of(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names))
    parts = max(1, -(-d.count() // rows))

    def local(rows_of: pd.DataFrame) -> pd.DataFrame:
        x = rows_of[names].to_numpy(dtype=float)
        front: list[int] = []
        best = np.empty((64, len(names)))
        for i in np.lexsort(x.T[::-1]):  # a row can only be dominated by one before it
            now = best[:len(front)]
            if not (np.all(now <= x[i], axis=1) & np.any(now < x[i], axis=1)).any():
                if len(front) == len(best):
                    best = np.concatenate([best, np.empty_like(best)])
                best[len(front)] = x[i]
                front.append(i)
        return rows_of.iloc[sorted(front)].drop(columns="_part")

    kept = d.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts))).groupBy(*k, "_part").applyInPandas(local, df.schema)
    if parts == 1:
        return kept
    kept = stage(kept, "local")
    t = {f"_t_{c}": F.col(c).cast("double") for c in names}
    return match(kept.withColumns(t), _dominated(kept, names, k), [*k, *t], "left_anti").select(*df.columns)


def _dominated(points: DataFrame, names, k) -> DataFrame:
    """The different (keys, _t_ objectives) among the points that another point dominates.

    A cell whose highest corner dominates a point settles it; one whose lowest corner does not dominate it holds nothing that does.
    """
    d, cells = _cells(points, names, k, "spread")
    t = [f"_t_{c}" for c in names]
    beats = lambda x, end="": all_of(x[f"{c}{end}"] <= F.col(f"_t_{c}") for c in names) & ~all_of(x[f"{c}{end}"] == F.col(f"_t_{c}") for c in names)
    open_, found = d.select(*k, *[F.col(c).alias(f"_t_{c}") for c in names]), []
    for i, c in enumerate(cells):
        children = _corners(d, names, k, cells[:i], c)
        near = match(open_, children, [*k, *cells[:i]]).withColumn("_sure", F.exists("_x", lambda x: beats(x, "_hi")))
        found.append(near.where("_sure").select(*k, *t))
        open_ = near.where("NOT _sure").select(*k, *t, *cells[:i], F.explode(F.transform(F.filter("_x", lambda x: beats(x, "_lo")), lambda x: x[c])).alias(c))
    leaves = d.groupBy(*k, *cells).agg(F.collect_list(F.struct(*names)).alias("_x"))
    found.append(match(open_, leaves, [*k, *cells]).where(F.exists("_x", lambda x: beats(x))).select(*k, *t))
    return reduce(DataFrame.unionByName, found).distinct()


def _corners(d: DataFrame, names, k, by, c) -> DataFrame:
    """The cells ``c`` inside each cell ``by``, with their lowest and highest corners, as an array ``_x``."""
    corners = d.groupBy(*k, *by, c).agg(*[F.min(n).alias(f"{n}_lo") for n in names], *[F.max(n).alias(f"{n}_hi") for n in names])
    return corners.groupBy(*k, *by).agg(F.collect_list(F.struct(c, *[f"{n}{e}" for n in names for e in ("_lo", "_hi")])).alias("_x"))


def hypervolume(df: DataFrame, a: str, b: str, ref: tuple[float, float], keys=(), chunk="spread") -> DataFrame:
    """Area dominated by the front up to the reference point."""
    k = cols(keys)
    inside = front_points(df.where((F.col(a) < ref[0]) & (F.col(b) < ref[1])), a, b, k, chunk)
    d = value_scan(inside, k, a, {"_p": prev(b)}, chunk=chunk)
    area = (ref[0] - F.col(a)) * (F.coalesce(F.col("_p"), F.lit(float(ref[1]))) - F.col(b))
    return d.groupBy(*k).agg(F.sum(area).alias("hypervolume"), F.count(F.lit(1)).alias("points"))


def spacing(df: DataFrame, a: str, b: str, keys=(), chunk="spread") -> DataFrame:
    """Population spread of nearest-neighbour distances on the front; on a front the nearest neighbour is adjacent."""
    k = cols(keys)
    d = value_scan(front_points(df, a, b, k, chunk), k, a, {"_p": prev(F.struct(a, b)), "_n": following(F.struct(a, b))}, chunk=chunk)
    dist = lambda s: F.hypot(F.col(a) - F.col(f"{s}.{a}"), F.col(b) - F.col(f"{s}.{b}"))
    return d.groupBy(*k).agg(F.coalesce(F.stddev_pop(F.least(dist("_p"), dist("_n"))), F.lit(0.0)).alias("spacing"))


def maximum_spread(df: DataFrame, a: str, b: str, keys=(), ideal: tuple[float, float] | None = None) -> DataFrame:
    ra, rb = F.max(a) - F.min(a), F.max(b) - F.min(b)
    if ideal:
        ra, rb = ra / (ideal[0] + 1e-10), rb / (ideal[1] + 1e-10)
    return df.groupBy(*cols(keys)).agg((ra * rb).alias("max_spread"))


def _line(chunk, x: str) -> Column | None:
    return None if is_plain(chunk) else value_chunk(x)


def _hold(df: DataFrame, name: str, chunk) -> DataFrame:
    """Keep an intermediate that several scans read: as a written table, unless all is small."""
    return df if is_plain(chunk) else stage(df, name)


def epsilon_indicator(front: DataFrame, truth: DataFrame, a: str, b: str, keys=(), chunk="spread") -> DataFrame:
    """Smallest shift with which the front weakly dominates the true front.

    Along a front a - b rises, the gap in ``a`` grows and the gap in ``b`` shrinks,
    so the best partner of a true point is one of the two fronting its own a - b.
    """
    k = cols(keys)
    f = front.select(*k, (F.col(a) - F.col(b)).alias("_x"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    t = truth.select(*k, F.col(a).alias("ta"), F.col(b).alias("tb")).withColumn("_x", F.col("ta") - F.col("tb"))
    lo = asof_join(t, f, k, "_x", values=["_a", "_b"], chunk=_line(chunk, "_x")).withColumnsRenamed({"_a": "_la", "_b": "_lb"})
    both = asof_join(_hold(lo, "low", chunk), f, k, "_x", values=["_a", "_b"], direction="forward", chunk=_line(chunk, "_x"))
    gap = lambda p, q: F.greatest(F.col(p) - F.col("ta"), F.col(q) - F.col("tb"))
    # greatest skips NULLs: guard the sides that found no partner
    left = F.when(F.col("_la").isNotNull(), gap("_la", "_lb"))
    right = F.when(F.col("_a").isNotNull(), gap("_a", "_b"))
    return both.groupBy(*k).agg(F.max(F.least(left, right)).alias("epsilon"))


def igd_plus(front: DataFrame, truth: DataFrame, a: str, b: str, keys=(), chunk="spread") -> DataFrame:
    """Mean over true points of the smallest distance counting only worse coordinates.

    Points left of a true point compete by ``b`` alone and points below it by ``a``
    alone: two lookups give an upper bound. Only the front's stretch between them
    and within the bound can be closer, and it is a range of front numbers.
    """
    k = cols(keys)
    f = value_scan(front.select(*k, F.col(a).alias("_x"), F.col(b).alias("_fb")), k, "_x", {"_no": running_count()}, chunk=chunk)
    f = _hold(f, "front", chunk)
    t = truth.select(*k, F.col(a).alias("ta"), F.col(b).alias("tb"))
    at = _line(chunk, "_x")
    d = asof_join(t.withColumn("_x", F.col("ta")), f, k, "_x", values=["_fb", "_no"], chunk=at).withColumnsRenamed({"_fb": "_left", "_no": "_lo"}).drop("_x")
    g = f.select(*k, F.col("_fb").alias("_y"), F.col("_x").alias("_fa"))
    d = asof_join(d.withColumn("_y", F.col("tb")), g, k, "_y", values=["_fa"], chunk=_line(chunk, "_y")).drop("_y")
    by_b = F.when(F.col("_left").isNotNull(), F.greatest(F.col("_left") - F.col("tb"), F.lit(0.0)))
    by_a = F.when(F.col("_fa").isNotNull(), F.greatest(F.col("_fa") - F.col("ta"), F.lit(0.0)))
    d = _hold(d.withColumn("_u", F.coalesce(F.least(by_b, by_a), F.lit(float("inf")))).drop("_left", "_fa"), "bound", chunk)
    d = asof_join(d.withColumn("_x", F.col("ta") + F.col("_u")), f, k, "_x", values=["_no"], chunk=at).withColumnRenamed("_no", "_hi").drop("_x")
    d = _hold(d, "range", chunk)
    between = F.sequence(F.coalesce("_lo", F.lit(0).cast("long")) + 1, F.coalesce("_hi", F.lit(0).cast("long")))
    many = F.coalesce("_hi", F.lit(0).cast("long")) > F.coalesce("_lo", F.lit(0).cast("long"))
    near = d.where(many & (F.col("_u") > 0)).withColumn("_no", F.explode(between)).transform(match, f.select(*k, "_no", F.col("_x").alias("_fa"), "_fb"), [*k, "_no"])
    dist = F.hypot(F.greatest(F.col("_fa") - F.col("ta"), F.lit(0.0)), F.greatest(F.col("_fb") - F.col("tb"), F.lit(0.0)))
    closer = near.groupBy(*k, "ta", "tb").agg(F.min(dist).alias("_m"))
    out = d.transform(match, closer, [*k, "ta", "tb"], "left")
    return out.groupBy(*k).agg(F.avg(F.least("_u", "_m")).alias("igd_plus"))


LEAF = 64  # points of a front in a cell


def _cells(front: DataFrame, names, k, chunk) -> tuple[DataFrame, list[str]]:
    """The different points of a front with their cell: slices by rank along the first objective, of each along the second, and so on for up to three."""
    d = front.select(*k, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=list(names)).distinct()
    along = names[:3]
    most = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).collect()[0].n or 0
    parts = max(1, math.ceil((most / LEAF) ** (1 / len(along))))
    cells: list[str] = []
    for i, c in enumerate(along):
        by = [*k, *cells]
        d = value_scan(d, by, c, {"_no": running_count()}, chunk=chunk, tie=[x for x in names if x != c])
        size = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        d = match(d, size, by).withColumn(f"_c{i}", F.expr(f"(_no - 1) * {parts} DIV _size")).drop("_no", "_size")
        cells.append(f"_c{i}")
    return stage(d, "front"), cells


def _undominated(points: DataFrame, names, k) -> DataFrame:
    """The different complete points that no other point dominates."""
    d = points.select(*k, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=list(names)).distinct()
    return stage(front_many(stage(d, "points"), names, k), "undominated")


def _nearest(front: DataFrame, truth: DataFrame, names, k, measure, chunk) -> DataFrame:
    """For every different true point (with its number of rows ``_rows``) the smallest ``measure`` of what front points exceed it by, as ``_best``; infinite without a front.

    A measure never falls as a front point grows, so a front point that another one dominates is never needed and goes first.
    Branch and bound over nested cells of the rest: the lowest corner of a cell bounds all its points from below, and its highest corner
    shows a value that one of them reaches. Level by level a true point keeps one cell that reaches the smallest such value, and those that may hold less.
    """
    d, cells = _cells(_undominated(front, names, k), names, k, chunk)
    points = truth.select(*k, *[F.col(c).cast("double").alias(f"_t_{c}") for c in names]).dropna(subset=[f"_t_{c}" for c in names])
    t = [f"_t_{c}" for c in names]
    points = points.groupBy(*k, *t).agg(F.count(F.lit(1)).alias("_rows"))
    over = lambda x, end="": measure([F.greatest(x[f"{c}{end}"] - F.col(f"_t_{c}"), F.lit(0.0)) if measure is _length else x[f"{c}{end}"] - F.col(f"_t_{c}") for c in names])
    open_ = points.select(*k, *t)
    for i, c in enumerate(cells):
        near = match(open_, _corners(d, names, k, cells[:i], c), [*k, *cells[:i]])
        bounds = near.select(*k, *t, *cells[:i], F.transform("_x", lambda x: F.struct(x[c].alias(c), over(x, "_lo").alias("_least"), over(x, "_hi").alias("_most"))).alias("_b"))
        place = lambda b: F.struct(b["_most"].alias("most"), *[F.col(x).alias(x) for x in cells[:i]], b[c].alias(c))
        reach = F.min(F.array_min(F.transform("_b", place))).over(Window.partitionBy(*k, *t))
        may = lambda b: (b["_least"] < F.col("_reach.most")) | (place(b) == F.col("_reach"))
        kept = bounds.withColumn("_reach", reach).select(*k, *t, *cells[:i], F.inline(F.filter("_b", may)))
        open_ = kept.drop("_least", "_most")
    leaves = d.groupBy(*k, *cells).agg(F.collect_list(F.struct(*names)).alias("_x"))
    best = match(open_, leaves, [*k, *cells]).groupBy(*k, *t).agg(F.min(F.array_min(F.transform("_x", lambda x: over(x)))).alias("_best"))
    return match(points, best, [*k, *t], "left").withColumn("_best", F.coalesce("_best", F.lit(float("inf"))))


def _length(parts) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _largest(parts) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def igd_plus_many(front: DataFrame, truth: DataFrame, objectives, keys=(), chunk="spread") -> DataFrame:
    """Mean over true points of the smallest distance to the front that counts only worse coordinates, for any number of objectives.

    Points with a NULL or NaN objective take no part; without a front the mean is infinite.
    """
    k = cols(keys)
    near = _nearest(front, truth, list(objectives), k, _length, chunk)
    return near.groupBy(*k).agg((F.sum(F.col("_best") * F.col("_rows")) / F.sum("_rows")).alias("igd_plus"))


def epsilon_many(front: DataFrame, truth: DataFrame, objectives, keys=(), chunk="spread") -> DataFrame:
    """Smallest shift with which the front weakly dominates the true front, for any number of objectives. Odd points as in ``igd_plus_many``.

    A true point that another one dominates needs no larger shift than that one, so the true points no other dominates decide.
    """
    k, names = cols(keys), list(objectives)
    return _nearest(front, _undominated(truth, names, k), names, k, _largest, chunk).groupBy(*k).agg(F.max("_best").alias("epsilon"))


def convergence(df: DataFrame, value: str, keys, order: str, window: int = 20, tol: float = 1e-3, maximise: bool = True) -> DataFrame:
    """Relative improvement of the best over the two halves of the last ``window`` generations."""
    k = cols(keys)
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc(order)))).where(F.col("_r") <= window)
    old = F.col("_r") > window - window // 2
    best = F.max if maximise else F.min
    g = last.groupBy(*k).agg(F.count(value).alias("_n"), best(F.when(old, F.col(value))).alias("_o"), best(F.when(~old, F.col(value))).alias("_w"))
    gain = (F.col("_w") - F.col("_o")) / (F.col("_o") + 1e-10) * (1 if maximise else -1)
    return g.select(*k, F.when(F.col("_n") == window, gain).alias("improvement"),
                    F.coalesce((F.col("_n") == window) & (gain < tol), F.lit(False)).alias("converged"))


# ---------------------------------------------------------------------- rank tests


def average_ranks(df: DataFrame, value: str, keys=(), chunk="spread") -> DataFrame:
    """Attach the average rank of each row's value and the tie size."""
    k = cols(keys)
    r = value_ranks(df, k, value, chunk).select(*k, value, (F.col("below") + (F.col("n") + 1) / 2).alias("rank"), F.col("n").alias("ties"))
    return df.transform(match, r, [*k, value])


def _tie_sum(ties: str) -> Column:
    """Sum of t³ - t over groups of t equal values, from the t of every row; like any cube of a row count it is a double, as it may pass 64 bits."""
    t = F.col(ties).cast("double")
    return F.sum(t * t - 1)


def wilcoxon(df: DataFrame, x: str, y: str, keys=(), chunk="spread") -> DataFrame:
    """Signed-rank test of paired rows: zero differences dropped, normal approximation with tie correction."""
    k = cols(keys)
    d = df.select(*k, (F.col(x) - F.col(y)).alias("_d")).where(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    ranks = value_ranks(d, k, "_a", chunk).select(*k, "_a", (F.col("below") + (F.col("n") + 1) / 2).alias("_r"), F.col("n").alias("_t"))
    g = d.transform(match, ranks, [*k, "_a"]).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("_wp"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("_wm"), _tie_sum("_t").alias("_ties"))
    n = F.col("n_pairs").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    w = F.least("_wp", "_wm")
    z = (w - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))
    out = g.select(*k, "n_pairs", w.alias("statistic"), z.alias("z"), (F.abs(z) / F.sqrt(n)).alias("effect_r"))
    return out.withColumn("p_value", normal_two_sided("z"))


def _two_groups(df: DataFrame, value: str, group: str, x: str, y: str, keys, chunk):
    k = cols(keys)
    d = average_ranks(df.where(F.col(group).isin(x, y)).where(F.col(value).isNotNull()), value, k, chunk)
    is_x = F.col(group) == x
    return d.groupBy(*k).agg(F.count_if(is_x).alias("n_x"), F.count_if(~is_x).alias("n_y"),
                             F.sum(F.when(is_x, F.col("rank"))).alias("_r"), _tie_sum("ties").alias("_ties"))


def mann_whitney(df: DataFrame, value: str, group: str, x: str, y: str, keys=(), chunk="spread") -> DataFrame:
    """U of the first sample, normal p-value (tie and continuity corrected), effect r and A12 with its band."""
    g = _two_groups(df, value, group, x, y, keys, chunk)
    nx, ny = F.col("n_x"), F.col("n_y")
    n = nx + ny
    u = F.col("_r") - nx * (nx + 1) / 2
    var = nx * ny / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    z = F.greatest(F.abs(u - nx * ny / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.nullif(var, F.lit(0.0)))
    out = g.select(*cols(keys), "n_x", "n_y", u.alias("u"), (u / (nx * ny)).alias("a12"), z.alias("z"), (z / F.sqrt(n)).alias("effect_r"))
    return out.withColumns({"p_value": normal_two_sided("z"), "band": a12_band("a12")})


# Lower ends of the bands of the effect size, and the ranges of a feasible solution.
A12_BANDS = ((0.71, "large"), (0.64, "medium"), (0.56, "small"), (0.44, "negligible"), (0.36, "small (reversed)"), (0.29, "medium (reversed)"))
FEASIBLE = {"temp": (15, 30), "rh": (40, 90), "co2": (400, 1200)}
HISTORY_SPAN = {"temp": 15, "rh": 50}


def a12_band(a12: str) -> Column:
    """Band of the effect size."""
    out = F.lit("large (reversed)")
    for low, name in reversed(A12_BANDS):
        out = F.when(F.col(a12) >= low, name).otherwise(out)
    return out


def _rank_sums(df: DataFrame, value: str, group: str, chunk) -> tuple[DataFrame, DataFrame]:
    d = average_ranks(df.where(F.col(value).isNotNull()), value, (), chunk)
    per = d.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("rank").alias("_r"))
    total = d.agg(F.count(F.lit(1)).alias("_total"), _tie_sum("ties").alias("_ties"))
    return per, total  # a handful of groups, and one row


def kruskal_wallis(df: DataFrame, value: str, group: str, chunk="spread") -> DataFrame:
    """H with tie correction and its chi-square tail."""
    per, total = _rank_sums(df, value, group, chunk)
    s = attach_row(per.agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.count(F.lit(1)).alias("n_groups")), total)
    n = F.col("_total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    out = s.select("n_groups", F.col("_total").alias("n_total"), h.alias("h"))
    return out.withColumn("p_value", chi2_tail("h", (F.col("n_groups") - 1).cast("double")))


def friedman(df: DataFrame, value: str, group: str, block: str) -> DataFrame:
    """Friedman chi-square over blocks that hold every group once; ranks are taken inside a block."""
    groups = df.select(group).distinct().agg(F.count(F.lit(1)).alias("_k"))
    # a block has as many rows as there are groups
    rows = attach_row(df.groupBy(block).agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).alias("_a")), groups)
    full = rows.where(F.size("_a") == F.col("_k"))
    ranked = F.transform("_a", lambda e: F.struct(
        e["g"].alias("g"), (F.size(F.filter("_a", lambda o: o["v"] < e["v"])) + (F.size(F.filter("_a", lambda o: o["v"] == e["v"])) + 1) / 2).alias("r"),
        F.size(F.filter("_a", lambda o: o["v"] == e["v"])).alias("t")))
    d = full.select(block, "_k", F.explode(ranked).alias("e"))
    per = d.groupBy("e.g").agg(F.sum("e.r").alias("_r"), F.count(F.lit(1)).alias("_n"), F.max("_k").alias("_k"), F.sum(F.col("e.t") * F.col("e.t") - 1).alias("_ties"))
    s = per.agg(F.sum(F.col("_r") * F.col("_r")).alias("_s"), F.max("_n").alias("n_blocks"), F.max("_k").alias("n_groups"), F.sum("_ties").alias("_ties"))
    n, k = F.col("n_blocks"), F.col("n_groups")
    chi = (12 / (n * k * (k + 1)) * F.col("_s") - 3 * n * (k + 1)) / (1 - F.col("_ties") / (n * k * (k * k - 1)))
    out = s.select("n_blocks", "n_groups", chi.alias("chi2"))
    return out.withColumn("p_value", chi2_tail("chi2", (k - 1).cast("double")))


def dunn(df: DataFrame, value: str, group: str, chunk="spread") -> DataFrame:
    """Pairwise comparison of mean ranks with Bonferroni-corrected p-values; the pairs are the result."""
    per, total = _rank_sums(df, value, group, chunk)
    stats = F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), (F.col("_r") / F.col("_n")).alias("m"), F.col("_n").alias("n"))))
    d = attach_row(per.agg(stats.alias("_s")), total)
    d = d.select("*", F.explode("_s").alias("a")).select("*", F.explode(F.filter("_s", lambda e: e["g"] > F.col("a.g"))).alias("b"))
    n = F.col("_total")
    var = (n * (n + 1) / 12 - F.col("_ties") / (12 * (n - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    z = (F.col("a.m") - F.col("b.m")) / F.sqrt(F.nullif(var, F.lit(0.0)))
    out = d.select(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), z.alias("z"), F.size("_s").alias("_g"))
    pairs = F.col("_g") * (F.col("_g") - 1) / 2
    return out.withColumn("p_adjusted", F.least(normal_two_sided("z") * pairs, F.lit(1.0))).drop("_g")


def solution_quality(df: DataFrame, energy: str, growth: str, temp: str, rh: str, co2: str, hist_temp: float | Column, hist_rh: float | Column) -> DataFrame:
    """Efficiency, effectiveness, feasibility, stability against history, and their mean."""
    t, h = F.col(temp), F.col(rh)
    ok = sum(x.between(*FEASIBLE[n]).cast("int") for n, x in (("rh", h), ("co2", F.col(co2)))) + t.between(*FEASIBLE["temp"]).cast("int")
    stable = ((1 - F.abs(t - hist_temp) / HISTORY_SPAN["temp"]) + (1 - F.abs(h - hist_rh) / HISTORY_SPAN["rh"])) / 2
    out = df.withColumns({"energy_efficiency": 1 / (F.col(energy) + 1e-6), "growth_effectiveness": F.col(growth),
                          "feasibility": ok / 3, "stability": F.greatest(stable, F.lit(0.0))})
    return out.withColumn("overall_quality", (F.col("energy_efficiency") + F.col("growth_effectiveness") + F.col("feasibility") + F.col("stability")) / 4)
