"""Time joins: equality, as-of, interval, containment, nearest rows.

No join here carries a broadcast hint on data that can grow: plain equi-joins let
Spark compare the measured size with its broadcast threshold and fall back to a
sort-merge join, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import attach_row, bucket_no, cols, epoch, last_valid, match, micros, next_valid, row_frames, scan
from ..functions.stats import corr
from ..sources.tables import stage


def attach_external(df: DataFrame, ext: DataFrame, on: str | Sequence[str], suffix: str | None = None) -> DataFrame:
    """Left equi-join of external columns; clashing names get ``suffix``."""
    on = cols(on)
    clash = [c for c in ext.columns if c in df.columns and c not in on]
    if clash and suffix is None:
        raise ValueError(f"clashing columns {clash}; give a suffix")
    return df.join(ext.withColumnsRenamed({c: c + suffix for c in clash}), on, "left")


def join_daily(df: DataFrame, daily: DataFrame, keys, ts: str = "ts", day: str = "day") -> DataFrame:
    from ..functions.calendar import trunc

    return df.withColumn(day, trunc("day", ts)).join(daily, [*cols(keys), day], "left")


def missing_times(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.select(*cols(on)).distinct().join(b, cols(on), "left_anti")


def combine_strict(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Inner join that fails the job when a row of ``a`` has no partner."""
    out = a.join(b.withColumn("_found", F.lit(True)), cols(on), "left")
    text = F.concat(F.lit("no match for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in cols(on)]))
    return out.where(F.when(F.col("_found").isNull(), F.raise_error(text)).otherwise(F.lit(True))).drop("_found")


def asof_join(left: DataFrame, right: DataFrame, keys=(), ts: str = "ts", *, values: Sequence[str],
              direction: str = "backward", tolerance: str | None = None, matched_ts: str | None = None,
              chunk="1 day") -> DataFrame:
    """Attach the last right row at or before (``forward``: first at or after) each left row.

    Both sides are stacked and scanned once, so no pairs are formed and one long
    series is spread over its chunks. ``chunk`` may be a column monotone in ``ts``
    when ``ts`` is not a time.
    """
    keys, back = cols(keys), direction == "backward"
    payload = [c for c in left.columns if c not in (*keys, ts)]
    hit = F.struct(F.col(ts).alias("_t"), *values).alias("_r")
    # equal times: the right row comes first when looking back, last when looking ahead
    lhs = left.select(*keys, ts, F.lit(1 if back else 0).alias("_side"), F.struct(F.lit(1).alias("_one"), *payload).alias("_l"))
    rhs = right.select(*keys, ts, F.lit(0 if back else 1).alias("_side"), hit)
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    spec = last_valid("_r") if back else next_valid("_r")
    out = scan(both, keys, [ts, "_side"], {"_m": spec}, chunk=chunk).where(F.col("_l").isNotNull())
    m = F.col("_m")
    if tolerance is not None:
        m = F.when(F.abs(epoch(ts) - epoch(F.col("_m._t"))) <= micros(tolerance), m)
    made = [m[v].alias(v) for v in values] + ([m["_t"].alias(matched_ts)] if matched_ts else [])
    return out.select(*keys, ts, *[F.col("_l")[c].alias(c) for c in payload], *made)


def range_join(points: DataFrame, spans: DataFrame, ts: str, start: str, end: str, keys=(),
               width: str = "1 day", how: str = "inner") -> DataFrame:
    """All pairs with start <= ts <= end, as an equi-join on time buckets with a residual test."""
    keys = cols(keys)
    cut = spans.withColumn("_bucket", F.explode(F.sequence(bucket_no(start, width), bucket_no(end, width))))
    lhs = points.withColumn("_bucket", bucket_no(ts, width))
    same = [lhs[k].eqNullSafe(cut[k]) for k in keys]
    cond = lhs["_bucket"] == cut["_bucket"]
    for c in same:
        cond = cond & c
    inside = (lhs[ts] >= cut[start]) & (lhs[ts] <= cut[end])
    return lhs.join(cut, cond & inside, how).drop(cut["_bucket"]).drop("_bucket").select(
        *[lhs[c] for c in points.columns], *[cut[c] for c in spans.columns if c not in keys])


def interval_join(df: DataFrame, spans: DataFrame, ts: str, start: str, end: str, *, keys=(), row_id,
                  first_by: Sequence[str], width: str = "1 day", disjoint: bool = False, chunk=None) -> DataFrame:
    """Left join of each row to the first span containing it.

    ``disjoint`` spans of a key do not overlap: one scan then finds the last span begun, and no pairs are made.
    """
    row_id = cols(row_id)
    names = [c for c in spans.columns if c not in cols(keys)]
    if disjoint:
        begun = spans.select(*cols(keys), F.col(start).alias(ts), F.struct(*names).alias("_s"))
        out = asof_join(df, begun, keys, ts, values=["_s"], chunk=chunk)
        return out.select(*df.columns, *[F.when(F.col(ts) <= F.col("_s")[end], F.col("_s")[c]).alias(c) for c in names])
    pairs = range_join(df.select(*cols(keys), *[c for c in row_id if c not in cols(keys)],
                                 *([ts] if ts not in row_id and ts not in cols(keys) else [])),
                       spans, ts, start, end, keys, width)
    first = pairs.groupBy(*row_id).agg(F.min_by(F.struct(*names), F.struct(*first_by)).alias("_s"))
    return df.join(first, row_id, "left").select(*df.columns, *[F.col("_s")[c].alias(c) for c in names])


def parent_era(child: DataFrame, parent: DataFrame, keys=(), *, child_id, parent_cols: Sequence[str], prefix: str = "parent_",
               width: str = "7 days") -> DataFrame:
    """First parent span that contains the child span."""
    p = parent.select(*cols(keys), F.col("start_time").alias("_ps"), F.col("end_time").alias("_pe"),
                      *[F.col(c).alias(prefix + c) for c in parent_cols])
    slim = child.select(*dict.fromkeys([*cols(keys), *cols(child_id), "start_time", "end_time"]))
    pairs = range_join(slim, p, "start_time", "_ps", "_pe", keys, width).where(F.col("_pe") >= F.col("end_time"))
    names = [prefix + c for c in parent_cols]
    first = pairs.groupBy(*cols(child_id)).agg(F.min_by(F.struct(*names), F.struct("_ps", "_pe", *names)).alias("_p"))
    return child.join(first, cols(child_id), "left").select(*child.columns, *[F.col("_p")[n].alias(n) for n in names])


def era_progress(ts: str, start: str, end: str):
    """Share of the era elapsed, in [0, 1]; 0.5 for an era without length."""
    length = epoch(end) - epoch(start)
    raw = (epoch(ts) - epoch(start)) / F.nullif(length, F.lit(0))
    return F.when(length == 0, 0.5).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def era_hierarchy(signals: Sequence[str], hours_a: str, hours_c: str) -> dict:
    """Stability over the three levels' signals and the ratio of their time scales."""
    a, b, c = (F.col(s) for s in signals)
    known = a.isNotNull() & b.isNotNull() & c.isNotNull()
    return {"stability": F.when(known, F.when((a == b) & (b == c), "high").otherwise("mixed")),
            "time_scale_ratio": F.col(hours_a) / (F.col(hours_c) + 1e-6)}


# How eras change decision bounds, and the weights of the objectives by stability.
ERA_HALF_WIDTH = 0.4  # of the range of a set point under fine control
ERA_LIGHT_FLOOR = 1.2
ERA_WEIGHTS = {"energy_consumption": ("high", 1.2), "plant_growth": ("mixed", 1.3), "water_usage": ("high", 1.1), "crop_quality": ("mixed", 1.2)}


def era_bounds(bounds: Mapping[str, tuple[float, float]], fine: str, light_critical: str) -> dict:
    """Decision bounds by era: fine control shrinks set-point ranges by a fifth around their
    centre, light-critical eras raise the lower light bound by a fifth."""
    out = {}
    for name, (low, high) in bounds.items():
        mid, half = (low + high) / 2, (high - low) * ERA_HALF_WIDTH
        lo, hi = F.lit(float(low)), F.lit(float(high))
        if name in ("temperature_setpoint", "humidity_setpoint"):
            lo, hi = (F.when(F.col(fine), mid - half).otherwise(lo), F.when(F.col(fine), mid + half).otherwise(hi))
        if name == "light_intensity":
            lo = F.when(F.col(light_critical), low * ERA_LIGHT_FLOOR).otherwise(lo)
        out[f"{name}_low"], out[f"{name}_high"] = lo, hi
    return out


def era_weights(stability: str) -> dict:
    """Normalised objective weights: stable eras stress efficiency, mixed ones growth and quality."""
    s = F.col(stability)
    raw = {n: F.when(s == when, w).otherwise(1.0) for n, (when, w) in ERA_WEIGHTS.items()}
    total = sum(list(raw.values())[1:], list(raw.values())[0])
    return {n: w / total for n, w in raw.items()}


def window_external(windows: DataFrame, ext: DataFrame, ts: str, aggs: Mapping, keys=(), start: str = "window_start",
                    end: str = "window_end", width: str = "1 day") -> DataFrame:
    """Aggregate the external rows inside each window, both ends included."""
    ids = [*cols(keys), start, end]
    pairs = range_join(ext, windows.select(*ids).distinct(), ts, start, end, keys, width)
    return windows.join(pairs.groupBy(*ids).agg(*[c.alias(n) for n, c in aggs.items()]), ids, "left")


def pairwise_overlap(df: DataFrame, pairs: Sequence[tuple[str, str]], keys=()) -> DataFrame:
    """Rows where both signals are present, and their share of rows where either is."""
    parts = []
    for a, b in pairs:
        both = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
        either = F.count_if(F.col(a).isNotNull() | F.col(b).isNotNull())
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both.alias("overlap"),
                              F.try_divide(both.cast("double"), either).alias("ratio")))
    return df.groupBy(*cols(keys)).agg(F.array(*parts).alias("_r")).select(*cols(keys), F.inline("_r"))


def intersect_time(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.select(*cols(on)).intersect(b.select(*cols(on)))


def correlate_with(df: DataFrame, ext: DataFrame, on, target: str, factors: Sequence[str]) -> DataFrame:
    """Correlation of a series with external factors over the common times."""
    parts = [F.struct(F.lit(f).alias("factor"), corr(target, f).alias("corr"), F.count(F.when(
        F.col(target).isNotNull() & F.col(f).isNotNull(), 1)).alias("n")) for f in factors]
    return df.join(ext, cols(on)).agg(F.array(*parts).alias("r")).select(F.inline("r"))


def lagged(df: DataFrame, col: str, lags: Sequence[int], keys, order="ts", chunk="1 day") -> DataFrame:
    """Series beside its shifted copies, without a self-join."""
    reach = max(lags)
    return row_frames(df, keys, order, reach, 0,
                      lambda w: {f"{col}_lag_{n}": F.lag(col, n).over(w) for n in lags}, chunk=chunk)


CELL = 1024  # donors in a cell, about
MOST_CELLS = 1 << 16  # the driver holds their bounds; beyond it cells grow
SEEN = 8  # donors a cell's bounds are drawn from, about
ANCHORS = 256  # donors that every row may be compared with
ROWS = 4096  # rows that one group compares with the donors of a cell
PAIRS = 1 << 20  # distances in memory at a time


class Cells:
    """A k-d tree over a few donors: it cuts all of space into ``2 ** depth`` numbered cells.

    A node sends values below its cut to the left and the others to the right. Equal donors cannot be cut apart, so some cells may stay empty.
    """

    def __init__(self, points: np.ndarray, depth: int, anchors: int):
        self.depth, self.anchors = depth, points[:anchors]
        self.axis, self.cut = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        held = [points]
        for node in range(len(self.cut)):
            at, held[node] = held[node], None
            axis, cut = self._halved(at)
            self.axis[node], self.cut[node] = axis, cut
            below = at[:, axis] < cut
            held += [at[below], at[~below]]

    @staticmethod
    def _halved(at: np.ndarray) -> tuple[int, float]:
        """The widest feature and its median, or the next value above the least."""
        if len(at) < 2:
            return 0, np.inf
        low, high = at.min(0), at.max(0)
        wide = np.zeros(at.shape[1])
        np.subtract(high, low, out=wide, where=high > low)
        axis = int(wide.argmax())
        if not wide[axis]:
            return axis, np.inf
        x = at[:, axis]
        middle = np.partition(x, len(x) // 2)[len(x) // 2]
        return axis, middle if middle > low[axis] else x[x > low[axis]].min()

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that may hold a point not farther than ``bound`` in any feature; a NaN bound is none."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            v, b, cut = x[row, self.axis[node]], bound[row], self.cut[node]
            left, right = ~(v - b >= cut), ~(v + b < cut)
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return row, node - len(self.cut)

    def home(self, x: np.ndarray) -> np.ndarray:
        row, cell = self.within(x, np.zeros(len(x)))
        return cell[np.argsort(row)]


def _points(table, names: Sequence[str]) -> np.ndarray:
    """Feature columns of an Arrow table or batch, a row per point."""
    return np.column_stack([table.column(n).to_numpy() if isinstance(table, pa.Table) else table.column(n).to_numpy(zero_copy_only=False) for n in names])


def _distances(x: np.ndarray, donors: np.ndarray):
    """Blocks (first row, distances to all donors) of bounded size."""
    step = max(1, PAIRS // max(1, len(donors)))
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, len(x), step):
            block = x[a:a + step]
            yield a, np.sqrt(sum((np.square(block[:, i, None] - donors[None, :, i]) for i in range(x.shape[1])), 0.0))


def _kth(distances: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th distance, NaN if it has fewer."""
    return np.partition(distances, k - 1, axis=1)[:, k - 1] if distances.shape[1] >= k else np.full(len(distances), np.nan)


def knn_join(left: DataFrame, donors: DataFrame, features: Mapping[str, str], k: int, *, row_id: str,
             donor_id: str, target: str, chunk="spread") -> DataFrame:
    """Mean target of the ``k`` nearest donors (Euclidean, ties by donor id) for every left row.

    Exact without pairing every row with every donor. A k-d tree over a bounded sample of the donors cuts space into cells of about ``CELL``
    donors; the sample only places the cuts, every donor takes part. A row's own cell bounds its k-th distance; then the row visits
    every cell the bound reaches into. Rows and donors of a cell meet in one group, which holds at most about ``ROWS`` rows, so the donors of a cell with
    more rows are repeated. Donors travel twice and in no order, so shuffles grow with the rows. Of equal donors in a crowded cell the first ``k`` by id are kept.
    Rows with equal features are one place. Rows and donors with a NULL among id, target or features take no part. No group grows with the
    tables, so ``chunk`` has nothing to split.
    """
    names, size = list(features), max(CELL, 4 * k)
    d = donors.select(F.col(donor_id).alias("_id"), F.col(target).alias("_y"),
                      *[F.col(features[f]).cast("double").alias(f"_d_{f}") for f in features]).dropna()
    theirs = [f"_d_{f}" for f in names]
    rows = stage(left.select(row_id, *[F.col(f).cast("double").alias(f) for f in features]).dropna(), "rows")
    places, n = rows.select(*names).distinct(), d.count()
    depth = math.ceil(math.log2(min(MOST_CELLS, max(1.0, n / size))))
    wanted = max(SEEN << depth, 16 * size)
    some = d.select(*theirs)
    seen = (some if n <= wanted else some.sample(wanted / n, 1)).toArrow()
    cells = Cells(_points(seen, theirs), depth, max(ANCHORS, 4 * k))

    def celled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Append the number of the cell a row lies in."""
        def numbers(batches):
            for batch in batches:
                yield batch.append_column("_cell", pa.array(cells.home(_points(batch, columns)), pa.int32()))

        return df.mapInArrow(numbers, df.withColumn("_cell", F.lit(0)).schema)

    d = celled(d, theirs)
    crowded = [r["_cell"] for r in d.groupBy("_cell").count().where(F.col("count") > 8 * size).collect()]  # of at most MOST_CELLS
    if crowded:
        first = Window.partitionBy(*theirs).orderBy("_id", "_y")
        kept = d.where(F.col("_cell").isin(crowded)).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
        d = d.where(~F.col("_cell").isin(crowded)).unionByName(kept)

    def meeting(visits: DataFrame, donors: DataFrame, work: Callable, schema: str) -> DataFrame:
        """What ``work`` returns for the rows that visit a cell and the donors of the cell."""
        load = F.broadcast(visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_parts")))  # at most MOST_CELLS rows
        there = match(donors, load, ["_cell"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        here = match(visits, load, ["_cell"]).withColumn("_part", F.pmod(F.xxhash64(*names), F.col("_parts")).cast("int")).drop("_parts")
        return here.groupBy("_cell", "_part").cogroup(there.groupBy("_cell", "_part")).applyInArrow(work, schema)

    def bounds(here: pa.Table, there: pa.Table) -> pa.Table:
        x = _points(here, names)
        bound = np.full(len(x), np.nan)
        for near in (_points(there, theirs), cells.anchors):
            short = np.flatnonzero(np.isnan(bound))
            for a, distances in _distances(x[short], near):
                bound[short[a:a + len(distances)]] = _kth(distances, k)
        bound *= 1 + 1e-12
        row, cell = cells.within(x, bound)
        return pa.table([*x[row].T, bound[row], pa.array(cell, pa.int32())], [*names, "_bound", "_cell"])

    def nearest(here: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by([("_id", "ascending"), ("_y", "ascending")])
        x, bound, near = _points(here, names), here["_bound"].to_numpy(), _points(there, theirs)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, distances in _distances(x, near):
            limit = np.fmin(bound[a:a + len(distances)], _kth(distances, k))[:, None]
            row, donor = np.nonzero((distances <= limit) | np.isnan(limit))
            dist = distances[row, donor]
            order = np.lexsort((donor, dist, row))
            row, donor, dist = row[order], donor[order], dist[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[first] + a, donor[first], dist[first]))
        row, donor, dist = map(np.concatenate, zip(*found))
        return pa.table([*x[row].T, dist, there["_id"].take(donor), there["_y"].take(donor)], [*names, "_dist", "_id", "_y"])

    place = ", ".join(f"`{f}` double" for f in names)
    reach = stage(meeting(celled(places, names), d.select("_cell", *theirs), bounds, f"{place}, _bound double, _cell int"), "reach")
    types = {f.name: f.dataType.simpleString() for f in d.schema}
    pairs = meeting(reach, d, nearest, f"{place}, _dist double, _id {types['_id']}, _y {types['_y']}")
    ranked = Window.partitionBy(*names).orderBy("_dist", "_id", "_y")
    found = pairs.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k).groupBy(*names).agg(F.avg("_y").alias("_mean"))
    return rows.join(found, names).select(row_id, F.col("_mean").alias(target))


def literature_of(literature: DataFrame, species: str, phenotype: str, unit: str, *, columns: Sequence[str] = ("species", "phenotype_name", "phenotype_unit")) -> DataFrame:
    """Rows on a trait: the species contains the name, in any case; phenotype and unit are equal. NULLs do not match."""
    s, p, u = columns
    return literature.where(F.contains(F.lower(F.col(s)), F.lower(F.lit(species))) & (F.col(p) == phenotype) & (F.col(u) == unit))


def knn_lookup(df: DataFrame, literature: DataFrame, features: Mapping[str, str], *, row_id: str, donor_id: str,
               target: str, k: int = 3, chunk="spread") -> DataFrame:
    """Predict a trait from the nearest literature rows; unknown features take the literature mean."""
    means = literature.agg(*[F.avg(c).alias(f"_m_{f}") for f, c in features.items()])
    filled = attach_row(df, means).withColumns(
        {f: F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")) for f in features})
    return knn_join(filled, literature, features, k, row_id=row_id, donor_id=donor_id, target=target, chunk=chunk)


def knn_impute(df: DataFrame, col: str, features: Sequence[str], k: int, row_id: str, chunk="spread") -> DataFrame:
    """Fill NULLs of ``col`` by the mean of the ``k`` rows nearest on the other columns."""
    df = stage(df, "knn")  # it is read several times
    found = knn_join(df.where(F.col(col).isNull()), df.where(F.col(col).isNotNull()), {f: f for f in features}, k,
                     row_id=row_id, donor_id=row_id, target=col, chunk=chunk).withColumnRenamed(col, "_fill")
    return df.join(found, row_id, "left").withColumn(col, F.coalesce(col, "_fill")).drop("_fill")
