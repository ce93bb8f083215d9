"""NULL keys, NULL times and many hot keys: the split computation equals the plain one."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegrid import frames
from tidegrid.operators import agg, rolling
from tidegrid.sources import tables


@pytest.fixture
def odd(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), i, None if r.random() < 0.2 else r.randrange(1000)) for i in range(600)]
    d = spark.createDataFrame(rows, "k string, j int, minute int, v int").withColumn("value", F.col("v").cast("double"))
    return d.withColumn("ts", (F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,minute * 20)")).cast("timestamp_ntz"))


def rows(df):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def splits(df, keys):
    return [None, frames.split_hot(df, keys, limit=0), frames.split_hot(df, keys, limit=60), "1 day", frames.Split(tuple(frames.cols(keys)), None)]


def test_scans_of_null_keys_do_not_depend_on_the_split(odd):
    specs = {"total": frames.running_sum("value"), "n": frames.running_count(), "p": frames.prev("value"), "f": frames.following("value"),
             "last": frames.last_valid("value"), "next": frames.next_valid("value")}
    got = [rows(frames.scan(odd, ["k", "j"], "minute" if c is None else ["ts", "minute"], specs, chunk=c)) for c in splits(odd, ["k", "j"])]
    assert all(g == got[0] for g in got[1:])


def test_scans_over_null_times(odd):
    d = odd.withColumn("ts", F.when(F.col("minute") % 5 > 0, F.col("ts")))
    got = [rows(frames.scan(d, "k", ["ts", "minute"], {"n": frames.running_count(), "p": frames.prev("value")}, chunk=c)) for c in splits(d, "k")]
    assert all(g == got[0] for g in got[1:])
    framed = frames.time_frames(d, "k", "ts", "1h", 0, lambda w: {"s": F.sum("value").over(w.rangeBetween(-3_600_000_000, 0))})
    assert framed.count() == d.count()


def test_frames_and_quantiles_of_null_keys(odd):
    build = lambda w: {"s": F.sum("value").over(w.rowsBetween(-3, 0))}
    got = [rows(frames.row_frames(odd, ["k", "j"], ["ts", "minute"], 3, 0, build, chunk=c, block=16)) for c in splits(odd, ["k", "j"])]
    assert all(g == got[0] for g in got[1:])
    got = [rows(frames.exact_quantiles(odd, ["k", "j"], "value", {"q": 0.3, "m": 0.5}, chunk=c)) for c in
           (None, frames.split_hot(odd, ["k", "j"], 0), frames.split_hot(odd, ["k", "j"], 60), "spread")]
    assert len(got[0]) == 9 and all(g == got[0] for g in got[1:])


def test_thousands_of_hot_keys(spark):
    d = spark.range(15_000).select((F.col("id") % 50).alias("a"), (F.col("id") % 5000).alias("b"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    hot = frames.split_hot(d, ["a", "b"], limit=2)
    assert hot.found and hot.hot.count() == 5000
    out = frames.scan(d.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")), ["a", "b"], "ts", {"n": frames.running_count()}, chunk=hot)
    assert out.groupBy("n").count().orderBy("n").collect() == [(1, 5000), (2, 5000), (3, 5000)]


@pytest.mark.parametrize("alpha, beta", [(0.3, 0.2), (0.0001, 0.5), (0.9, 0.0), (1.0, 1.0)])
def test_smoothing_has_no_horizon(spark, alpha, beta):
    r = random.Random(2)
    values = [None if i % 11 == 0 or i < 2 else r.uniform(-5, 40) for i in range(1500)]
    d = spark.createDataFrame([(None, i, v) for i, v in enumerate(values)], "k string, n int, value double")
    d = d.withColumn("ts", F.timestamp_seconds("n").cast("timestamp_ntz"))
    y = level = None
    trend, want = 0.0, []
    for x in values:
        if x is not None:
            y = x if y is None else (1 - alpha) * y + alpha * x
            if level is None:
                level = x
            else:
                new = alpha * x + (1 - alpha) * (level + trend)
                level, trend = new, beta * (new - level) + (1 - beta) * trend
        want.append((y, level, None if level is None else trend))
    for chunk in (None, "5min"):
        got = rolling.ewma(rolling.holt(d, "value", alpha, beta, "k", chunk=chunk), "value", alpha, "k", chunk=chunk).orderBy("n").collect()
        for row, (a, b, c) in zip(got, want):
            for g, w in ((row.ewma, a), (row.level, b), (row.trend, c)):
                assert (g is None) == (w is None) and (w is None or math.isclose(g, w, rel_tol=1e-8, abs_tol=1e-8))


def test_rows_with_null_keys_stay(odd):
    assert agg.partition_count(odd, ["k", "j"]).count() == odd.count()
    assert agg.daily_total(odd, "value", ["k"]).count() == odd.count()
    assert agg.ext_stats(odd, "value", ["k", "j"], chunk=None).count() == 9


def test_upsert_moves_and_empties_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = "id int, part string, v int"
    tables.save(spark.createDataFrame([(1, "x", 1), (2, "y", 1), (None, "y", 1), (3, "z", 1)], cols), path, ["part"])
    tables.upsert(spark, path, spark.createDataFrame([(1, "y", 2), (None, "w", 2), (4, "x y", 2)], cols), "id", ["part"])
    assert rows(spark.read.parquet(path).select("id", "part", "v")) == Counter([(1, "y", 2), (2, "y", 1), (None, "w", 2), (3, "z", 1), (4, "x y", 2)])


def test_insert_ignore_takes_one_of_several(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save(spark.createDataFrame([(1, 1), (None, 1)], "id int, v int"), path)
    tables.insert_ignore(spark, path, spark.createDataFrame([(1, 9), (2, 8), (2, 7), (None, 5)], "id int, v int"), "id")
    assert rows(spark.read.parquet(path)) == Counter([(1, 1), (None, 1), (2, 7)])
