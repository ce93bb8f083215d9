"""Splitting a series must never change a result."""

import math
import random

import pytest
from conftest import at
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid import frames as fr


def noisy(spark, seed=1, n=300, keys=("a", "b")):
    rnd = random.Random(seed)
    rows = [(rnd.choice(keys), at(rnd.uniform(0, 6000)), None if rnd.random() < 0.3 else round(rnd.uniform(-9, 9), 2)) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double").cache()


def specs():
    return {"p": fr.prev("value"), "n": fr.following("value"), "l": fr.last_valid("value"), "ls": fr.last_valid("value", True),
            "r": fr.next_valid("value"), "rs": fr.next_valid("value", True), "s": fr.running_sum("value"), "c": fr.running_count(),
            "lo": fr.running_min("value"), "hi": fr.running_max("value"), "mb": fr.min_before("value"),
            "x": fr.running_product(F.lit(1.0) + F.col("value") / 100)}


def rows(df):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


@pytest.mark.parametrize("chunk", ["6 hours", "1 day", "hot", "all"])
def test_scan_chunked_equals_plain(spark, chunk):
    df = noisy(spark)
    cut = {"hot": fr.Split(("k",), (("a",),), "6 hours"), "all": fr.Split(("k",), None, "6 hours")}.get(chunk, chunk)
    assert rows(fr.scan(df, "k", "ts", specs(), chunk=cut)) == rows(fr.scan(df, "k", "ts", specs(), chunk=None))


@pytest.mark.parametrize("chunk", ["1 day", "hot"])
def test_row_frames_blocks_equal_plain(spark, chunk):
    df = noisy(spark, 2)
    cut = fr.Split(("k",), (("b",),), "1 day") if chunk == "hot" else chunk

    def build(w):
        f = w.rowsBetween(-5, 3)
        return {"s": F.sum("value").over(f), "g": F.lag("value", 4).over(w), "h": F.lead("value", 3).over(w)}

    plain = fr.row_frames(df, "k", "ts", 5, 3, build, chunk=None)
    assert rows(fr.row_frames(df, "k", "ts", 5, 3, build, chunk=cut, block=1)) == rows(plain)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(10, 500), st.integers(0, 200))
def test_time_frames_equal_plain(spark, back, ahead):
    df = noisy(spark, 3)

    def build(w):
        return {"s": F.sum("value").over(w.rangeBetween(-back * 60_000_000, ahead * 60_000_000))}

    w = Window.partitionBy("k").orderBy(fr.epoch("ts"))
    plain = df.withColumns(build(w))
    assert rows(fr.time_frames(df, "k", "ts", f"{back}min", f"{ahead}min", build, chunk="600min")) == rows(plain)


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_by_rank_equal_built_in(spark, keys):
    df = noisy(spark, 4)
    p = {"a": 0.05, "b": 0.5, "c": 0.77}
    assert rows(fr.exact_quantiles(df, keys, "value", p)) == rows(fr.exact_quantiles(df, keys, "value", p, chunk=None))


def test_split_hot_measures_keys(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 10)))
    big = fr.split_hot(df, "k", limit=500)
    assert big.found and big.hot.collect() == [("big",)]
    assert fr.split_hot(df, "k", limit=5).hot.count() == 11
    assert not fr.split_hot(df, "k").found and fr.is_plain(fr.split_hot(df, "k"))


def test_split_with_null_key(spark):
    df = spark.createDataFrame([(None, at(i), float(i)) for i in range(5)] + [("a", at(1), 1.0)], "k string, ts timestamp_ntz, value double")
    hot = fr.split_hot(df, "k", limit=3)
    assert hot.hot.collect() == [(None,)]
    assert hot.mark(df).where("_hot").count() == 5


def test_durations():
    assert fr.micros("15min") == 900_000_000 and fr.micros("2h") == fr.micros("2 hours") == 7_200_000_000
    assert fr.micros("1 day") == fr.DAY and fr.micros(5) == 5
    with pytest.raises(ValueError):
        fr.micros("soon")


def test_floor_div_below_zero(spark):
    got = [r[0] for r in spark.createDataFrame([(-7,), (-6,), (0,), (5,)], "v long").select(fr.floor_div(F.col("v"), 3)).collect()]
    assert got == [math.floor(v / 3) for v in (-7, -6, 0, 5)]


def test_no_unkeyed_window_on_rows(spark):
    """Spread quantiles never sort all rows in one task."""
    df = noisy(spark, 5)
    plan = fr.exact_quantiles(df, (), "value", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_chunk" in w for w in windows)


def test_checkpoint_cuts_lineage(spark):
    from tidegrid.session import checkpoint

    df = checkpoint(noisy(spark, 6).groupBy("k").count())
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 2


def test_slow_smoothing_is_not_refused(spark):
    from tidegrid.operators import rolling

    assert rolling.ewma(noisy(spark), "value", 1e-5, "k").count() == noisy(spark).count()
