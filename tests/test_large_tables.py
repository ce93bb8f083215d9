"""What only shows on large or differently shaped tables."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from tidegrid.functions.moments import Moments
from tidegrid.operators import pareto as op
from tidegrid.operators import changepoint, coupling, grid, model, rolling, spectral
from tidegrid.plans import registry
from tidegrid.plans.views import Views
from tidegrid.streaming import live


def test_rank_tests_beyond_two_million_rows(spark):
    """Cubes of row counts pass 64 bits."""
    n = 2_200_000
    d = spark.range(n).select(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("v"))
    for chunk in (None, "spread"):
        got = op.wilcoxon(d, "x", "y", chunk=chunk).collect()[0]
        ties = n * (n * n - 1)
        z = -(n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (got.n_pairs, got.statistic) == (n, 0.0) and math.isclose(got.z, z, rel_tol=1e-12)
    got = op.mann_whitney(d, "x", "g", "a", "b", chunk=None).collect()[0]
    assert (got.n_x, got.n_y, got.a12) == (n // 2, n // 2, 0.5)
    got = op.kruskal_wallis(d, "v", "g", chunk="spread").collect()[0]
    # ranks of a are odd numbers, of b even ones
    half = n // 2
    h = 12 / (n * (n + 1)) * (half * half ** 2 + half * (half + 1) ** 2) - 3 * (n + 1)
    assert (got.n_groups, got.n_total) == (2, n) and math.isclose(got.h, h, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("often", ["click", "purchase"])
def test_selected_columns_do_not_depend_on_which_signal_is_seen_most(spark, tmp_path, often):
    seen = [*["view", "click", "purchase"] * 3, *[often] * 4]
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i // 2), i % 2, s, float(i), "{}") for i, s in enumerate(seen)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = contract.queries()["clean_select_columns"](spark, str(tmp_path))
    assert got.columns == ["entity", "hour", "view", "click"]
    assert sorted(x.click for x in got.collect() if x.click is not None) == [float(i) for i, s in enumerate(seen) if s == "click"]


def test_dominated_points_are_never_searched(spark, monkeypatch):
    """Ten points decide whatever else the front and the true front hold."""
    seen, cells = [], op._cells
    monkeypatch.setattr(op, "_cells", lambda front, *rest: seen.append(front.count()) or cells(front, *rest))
    best = [(float(i), float(9 - i), 0.0) for i in range(10)]
    rest = [(a + 1 + i % 7, b + 1 + i % 5, 1.0 + i) for i in range(60) for a, b, _ in best]
    d = spark.createDataFrame([("a", *r) for r in best + rest], "k string, x double, y double, z double")
    front = d.where("x % 2 = 1")
    kept = [r for r in best + rest if r[0] % 2 == 1]
    over = lambda t: [[q - p for q, p in zip(f, t)] for f in kept]
    igd = [min(math.sqrt(sum(max(e, 0) ** 2 for e in f)) for f in over(t)) for t in best + rest]
    assert math.isclose(op.igd_plus_many(front, d, ["x", "y", "z"], "k").collect()[0].igd_plus, sum(igd) / len(igd))
    assert op.epsilon_many(front, d, ["x", "y", "z"], "k").collect()[0].epsilon == max(min(max(f) for f in over(t)) for t in best + rest)
    assert max(seen) <= 20


def test_moments_of_windows():
    r = np.random.default_rng(1)
    x, there = r.normal(1e6, 1, 301), r.random(301) < 0.8
    x[100:140] = 7.1
    begin = r.integers(0, 301, 400)
    end = np.minimum(begin + r.integers(0, 60, 400), 301)
    for b, e, n, s, q in zip(begin, end, *Moments(x, there).of(begin, end)):
        v = x[b:e][there[b:e]]
        assert n == len(v) and math.isclose(s, math.fsum(v)) and math.isclose(q, ((v - v.mean()) ** 2).sum() if n else 0.0, rel_tol=1e-9, abs_tol=1e-8)
        assert q == 0 or not len(v) or v.min() < v.max()


@pytest.mark.parametrize("closed", ["left", "right"])
def test_time_frames_do_not_read_each_frame_anew(spark, closed):
    """Equal times, rows without a time, NULLs; the plan has no window over the frame's rows."""
    rows = [(i, "ab"[i % 2] if i % 17 else None, None if i % 13 == 0 else datetime(2024, 1, 1) + timedelta(minutes=7 * (i // 3)), None if i % 5 == 0 else float(i % 29)) for i in range(900)]
    d = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, value double")
    out = rolling.rolling(d, "value", "6h", ["mean", "std", "count"], "k", closed=closed, min_n=2)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.id: x for x in out.collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        near = lambda o: (o is None) if t is None else o is not None and (timedelta(0) < t - o <= timedelta(hours=6) if closed == "left" else timedelta(0) <= t - o < timedelta(hours=6))  # noqa: B023, E731
        v = [r[3] for r in rows if r[1] == k and near(r[2]) and r[3] is not None]
        if len(v) < 2:
            assert got[i].value_mean is None and got[i].value_count is None
        else:
            assert got[i].value_count == len(v) and math.isclose(got[i].value_mean, np.mean(v)) and math.isclose(got[i].value_std, np.std(v, ddof=1), abs_tol=1e-9)


def test_transforms_by_fixed_weights(spark):
    """Two scales against the sum over all rows, a NULL, a short series; no list per row."""
    rows = [(k, i, None if (k, i) == ("a", 60) else math.sin(i) * i) for k, n in (("a", 90), ("b", 5)) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, ts int, x double")
    out = spectral.cwt(d, "x", [0.5, 1.5], "k", chunk=None)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    for g in out.collect():
        for j, s in enumerate((0.5, 1.5)):
            near = [(g.ts - i, x) for k, i, x in rows if k == g.k and abs(i - g.ts) <= math.ceil(9 * s)]
            if any(x is None for _, x in near):
                assert g[f"cwt_{j}"] is None
            else:
                re, im = (sum(x * math.exp(-0.5 * (o / s) ** 2) / math.sqrt(s) * fn(6 * o / s) for o, x in near) for fn in (math.cos, math.sin))
                assert math.isclose(g[f"cwt_{j}"], math.hypot(re, im), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_partitions_of_training_rows_are_bounded(spark, monkeypatch, kind):
    from pyspark.ml import Pipeline

    monkeypatch.setattr(model, "ROWS", 100, raising=False)
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) or fit(self, df))
    d = spark.range(0, 1000, 1, 1).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 34).cast("double").alias("y"),
                                          F.when(F.col("id") < 800, "train").otherwise("valid").alias("part"), F.lit("unused").alias("other"))
    made = model.train_regressor(d, ["x"], "y", kind=kind, part="part", rounds=2, depth=2)
    assert sum(seen) == (1000 if kind == "boosted" else 800) and max(seen) <= 200
    assert model.score(made, d).where(F.col("prediction").isNull()).isEmpty()


def test_boosting_computes_its_rows_once(spark, tmp_path, monkeypatch):
    """On a large table rows are grouped once and dealt once, whatever is trained and scored; the model is that of a small one."""
    from pyspark.ml import Pipeline

    day = lambda i: None if i % 41 == 0 else datetime(2024, 1, 1) + timedelta(days=i // 12)
    rows = [(i, None if i % 37 == 0 else i % 7, day(i), i % 4, None if i < 600 and i % 29 == 0 else float(1 + i * i % 50), (i % 11) / 100, float(100 + i * 31 % 997), (i % 9) / 100, "O") for i in range(1200)]
    spark.createDataFrame(rows + rows[::10], "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz, l_linenumber int, l_quantity double, l_discount double, "
                          "l_extendedprice double, l_tax double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(model, "ROWS", 100)
    build, seen, read, fit, complete = registry.load()["model_boosted"].build, [], [], Pipeline.fit, model.complete_rows
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append((df, df.storageLevel, df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    monkeypatch.setattr(model, "complete_rows", lambda df, *rest: read.append(df.inputFiles()) or complete(df, *rest))
    one, many = build(Views(spark, str(tmp_path))), build(Views(spark, str(tmp_path), limit=100))
    a, b = one.collect()[0].asDict(), many.collect()[0].asDict()
    assert a["n"] > 50 and a["rmse"] > 0 and a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-6, abs_tol=1e-9) for k in a)
    (small, _, _, n), (large, level, parts, m) = seen
    assert n == m > 500 and parts == math.ceil(m / 100)
    assert level == StorageLevel.DISK_ONLY and not (large.storageLevel.useDisk or small.storageLevel.useDisk)
    assert len(read) == 2 and all(read) and not any("lineitem" in f for f in [*read[1], *many.inputFiles()])


def test_shares_of_times_written_first(spark):
    """The same shares; rows without a time stay out. What is written is small, so rows are not shuffled to meet it."""
    d = spark.createDataFrame([(i, None if i % 13 == 0 else datetime(2024, 1, 1) + timedelta(days=i // 5)) for i in range(300)], "id int, ts timestamp_ntz")
    for chunk in (None, "spread"):
        first = model.time_split(d, chunk=chunk, write=True)
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and first.inputFiles()
        assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, model.time_split(d, chunk=chunk).collect()), key=str)


def test_ordered_streams_serve_many_keys_in_one_call(spark):
    """Keys are dealt into a bounded number of parts; each key of a part goes on from what it has kept, in order of time."""
    df = spark.createDataFrame([(i, datetime(2024, 1, 1), i, 1.0) for i in range(5000)], "k long, ts timestamp, no long, x double").withWatermark("ts", "1 day")
    plan = live.smoothed_in_order(df, "x", "k", ["ts", "no"], idle="3 days")._jdf.queryExecution().analyzed().toString()
    assert f"pmod(xxhash64(k" in plan and f"cast({live.GROUPS} as bigint)" in plan
    day = 86_400_000_000
    step = live.InOrder(lambda kept: live.Smoothed(0.3, 20.0, kept), "k", "x", T.StructType.fromDDL("k long, us__ long, no long, x double"),
                        T.StructType.fromDDL("k long, numbers array<double>, last long"), ["ewma", "edges", "since"], 3 * 86_400_000)
    rows = pd.DataFrame({"k": [2, 1, 2, 1, 3], "us__": [9 * day, 2 * day, 8 * day, 1 * day, 5], "no": [1, 2, 3, 4, 5], "x": [10.0, 30.0, 30.0, 10.0, 7.0]})
    kept = {2: ([50.0, 1.0, 0.0, 0.0], 7 * day), 1: ([50.0, 1.0, 4.0, 0.0], -9 * day)}
    got = {r.no: (r.ewma, r.edges, r.since) for r in step.advance(rows, kept).itertuples()}
    assert got == {3: (44.0, 0, 0), 1: (33.8, 1, 1), 4: (10.0, 0, 1), 2: (16.0, 1, 0), 5: (7.0, 0, 1)}
    assert kept[3] == ([7.0, 0.0, 0.0, 1.0], 5) and kept[1][1] == 2 * day and kept.keys() == {1, 2, 3}


def test_ordered_streams_keep_keys_beside_null_ones(spark, tmp_path):
    """A large number as key stays what it is where other rows of a batch have none."""
    rows = [(None if i % 3 == 0 else (1 << 60) + i % 3, datetime(2024, 1, 1) + timedelta(hours=i), i, float(i)) for i in range(60)]
    spark.createDataFrame(rows, "k long, ts timestamp, no long, x double").write.parquet(str(tmp_path / "in"))
    stream = live.timed(live.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "ts", "1 hour")
    with live.state_store(spark):
        got = {r.no: (r.k, r.ewma) for r in live.run_available(live.smoothed_in_order(stream, "x", "k", ["ts", "no"]), str(tmp_path)).collect()}
    want, now = {}, {}
    for k, _, no, x in rows[:59]:
        now[k] = 0.7 * now[k] + 0.3 * x if k in now else x
        want[no] = (k, now[k])
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1]) for i in want)


@pytest.mark.parametrize("n, most", [(4, 2), (20, 3)])
def test_rolling_lag_reads_each_series_once(spark, n, most):
    """Equal to the definition with gaps, constant stretches and series shorter than the window, and no frame is read anew."""
    g = np.random.default_rng(n)
    rows, want = [], {}
    for key, size in ((None, 1), ("a", 2500), ("b", n - 1), ("c", 57)):
        x = [None if g.random() < 0.05 else 5.0 if 30 < i < 70 else float(g.normal()) for i in range(size)]
        y = [None if g.random() < 0.02 else float(g.integers(3)) for i in range(size)]
        rows += [(key, i, x[i], y[i]) for i in range(size)]
        for i in range(size):
            frame, best = range(i, min(i + n, size)), []
            for k in range(most + 1):
                pairs = [(x[j], y[j + k]) for j in frame if j + k < size and x[j] is not None and y[j + k] is not None]
                a, b = np.array(pairs).T if pairs else (np.zeros(1), np.zeros(1))
                spread = a.std() * b.std()
                best.append((np.mean((a - a.mean()) * (b - b.mean())) / spread if spread > 1e-9 else -1.0, -k))
            full = sum(j + most < size and y[j + most] is not None for j in frame) == n
            want[key, i] = max(best) if full else None
    df = spark.createDataFrame(rows, "k string, ts long, x double, y double")
    out = coupling.rolling_lag(df, "x", "y", most, n, "k", chunk=None)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.ts): r for r in out.collect()}
    assert got.keys() == want.keys()
    assert all((got[k].corr is None) if w is None else math.isclose(got[k].corr, w[0], abs_tol=1e-9) for k, w in want.items())
    assert sum(w is not None for w in want.values()) > 500


def test_pelt_looks_at_several_readings_together(monkeypatch):
    """Costs are computed for as many readings at once as no segment may begin among, however the series is cut into batches."""
    calls, real = [], changepoint.segment_cost
    monkeypatch.setattr(changepoint, "segment_cost", lambda *a: calls.append(1) or real(*a))
    x = np.random.default_rng(3).poisson(4, 700).astype(float)
    whole = changepoint.Pelt("poisson", 5.0, 7)(x)
    assert len(calls) <= 100
    step = changepoint.Pelt("poisson", 5.0, 7)
    parts = [step(p) for p in np.split(x, [1, 2, 300, 305])]
    assert all(np.array_equal(np.concatenate(a), b) for a, b in zip(zip(*parts), whole))


def test_grids_are_dealt_into_bounded_partitions(spark, monkeypatch):
    """Whole keys, about as many grid rows in each partition however many keys there are; few rows stay as they are."""
    rows = [(k, at, 1.0) for k in range(60) for at in (datetime(2024, 1, 1), datetime(2024, 1, 5, 3))]
    df = spark.createDataFrame(rows, "entity long, ts timestamp_ntz, value double")
    assert grid.dealt(df, "1h", "entity").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    parts = grid.dealt(df, "1h", "entity", most=500)
    assert parts.rdd.getNumPartitions() == math.ceil(60 * 100 / 500)
    full = grid.densify(parts, "1h", "entity").withColumn("_p", F.spark_partition_id())
    sizes = full.groupBy("_p").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("k")).collect()
    assert sum(r.n for r in sizes) == 6000 and sum(r.k for r in sizes) == 60 and max(r.n for r in sizes) < 2000
    seen, real = [], grid.dealt
    monkeypatch.setattr(grid, "dealt", lambda *a, **k: seen.append(1) or real(*a, **k))
    contract.queries()["impute_linear"](spark, "/root/testdata/sf0.001")
    assert seen
