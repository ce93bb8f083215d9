"""Hourly feature flow: clean, hourly grid, conservative fill, price join, windows, window features.

One plan without an action. Per entity, signal and hour the readings shrink to one
row, and everything after that first aggregation stays partitioned by entity. The
window features never write out the grid: hours without a reading matter only inside
gaps short enough to be filled, so only those are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import bucket, epoch, floor_div, from_epoch
from ..functions import clean as fc
from ..operators.grid import densify
from ..operators.join import attach_external
from ..operators.rolling import pane_windows
from .views import SIGNALS, Views

# Plausible range and largest change per hour of each signal.
FILL = {f"{s}_mean": (0.0, 200.0, 30.0) for s in SIGNALS}
MAX_GAP = 12


def filled_hours(v: Views) -> DataFrame:
    """Complete hourly grid per entity with short gaps filled: the sparse hours that hold anything, brought together per hour and densified once."""
    filled = [F.max(f"{s}_mean").alias(f"{s}_mean") for s in SIGNALS]
    wide = present_hours(v).groupBy("entity", "hour").agg(F.sum("records").alias("total_records"), *filled)
    return densify(wide.withColumn("total_records", F.nullif("total_records", F.lit(0))), "1h", "entity", "hour")


def present_hours(v: Views) -> DataFrame:
    """The hours of the filled grid that hold anything, a row per entity, hour and signal: ``<signal>_mean`` and ``records``."""
    step = 3_600_000_000
    base = v.readings_n.groupBy("entity", "signal", bucket("ts", "1h").alias("hour")).agg(
        F.avg(fc.replace_sentinels("value", [-1.0])).alias("mean"), F.count(F.lit(1)).alias("records"))
    base = base.repartition("entity")  # serves every later window and aggregation
    # the next valid hour of the signal, by a window against the time
    w = Window.partitionBy("entity", "signal").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.last(F.when(F.col("mean").isNotNull(), F.struct(epoch("hour").alias("t"), F.col("mean").alias("v"))), ignorenulls=True).over(w)
    d = base.withColumn("_t", epoch("hour")).withColumn("_next", later)
    gap = floor_div(F.col("_next.t") - F.col("_t"), step) - 1
    slope = (F.col("_next.v") - F.col("mean")) / (gap + 1)
    low, high, most = FILL[f"{SIGNALS[0]}_mean"]
    inside = lambda x: x.between(low, high)
    fill = F.col("mean").isNotNull() & gap.between(1, MAX_GAP) & (F.abs(slope) <= most) & inside(F.col("mean") + slope)
    made = F.transform(F.sequence(F.lit(1).cast("long"), gap), lambda k: F.struct(
        (F.col("_t") + k * step).alias("t"), F.when(inside(F.col("mean") + slope * k), F.col("mean") + slope * k).alias("mean"), F.lit(0).cast("long").alias("records")))
    own = F.array(F.struct(F.col("_t").alias("t"), "mean", "records"))
    cells = d.select("entity", "signal", F.explode(F.when(fill, F.concat(own, made)).otherwise(own)).alias("c"))
    return cells.select("entity", from_epoch(F.col("c.t")).alias("hour"), "c.records",
                        *[F.when(F.col("signal") == s, F.col("c.mean")).alias(f"{s}_mean") for s in SIGNALS])


def hourly_features(v: Views) -> DataFrame:
    """24 h windows every 6 h per entity: statistics, coverage and peak/off-peak cost."""
    hours = attach_external(present_hours(v), v.price, "hour")
    use, cost = F.col("view_mean"), F.col("price")
    peak = F.hour("hour").between(7, 22)
    w = pane_windows(hours, "24h", "6h", "entity", [f"{s}_mean" for s in SIGNALS], extra={
        "records": F.col("records"), "cost": use * cost, "peak_use": F.when(peak, use), "offpeak_use": F.when(~peak, use)})
    named = [F.col(f"{s}_mean_{st}").alias(f"{s}_{st}") for s in SIGNALS for st in ("count", "mean", "std", "min", "max")]
    covered = sum((F.col(f"{s}_mean_count") for s in SIGNALS[1:]), F.col(f"{SIGNALS[0]}_mean_count")) / (24 * len(SIGNALS))
    return w.where(covered > 0).select(
        "entity", "window_no", "window_start", "records", *named, covered.alias("coverage"), "cost",
        F.when(F.col("offpeak_use") > 0, F.coalesce("peak_use", F.lit(0.0)) / F.col("offpeak_use")).alias("peak_ratio"))
