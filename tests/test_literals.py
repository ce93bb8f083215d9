"""Small cases with known answers."""

import math

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.functions import clean as fc
from tidegrid.functions import climate as cl
from tidegrid.functions import scores
from tidegrid.operators import actuator, changepoint, clean, complexity, grid, growth, join, rolling, segment, sparse, spectral
from tidegrid.operators import pareto as op


def close(got, want, tol=1e-6):
    assert len(got) == len(want), (got, want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (w is None or abs(g - w) < tol), (got, want)


@pytest.mark.parametrize("minutes,gap,want", [
    ([0, 5, 10, 70, 75], "30min", [0, 0, 0, 1, 1]),
    ([0, 5, 25, 30, 70], "15min", [0, 0, 1, 1, 2]),
    ([0, 15, 30 + 1 / 60], "15min", [0, 0, 1]),
    ([0], "15min", [0]),
])
@pytest.mark.parametrize("chunk", ["10min", None])
def test_islands(series, minutes, gap, want, chunk):
    df = series([("a", m, 1.0) for m in minutes])
    assert values(segment.label_islands(df, gap, "k", chunk=chunk), "segment_id") == want


def test_islands_empty(series):
    assert segment.label_islands(series([]), "15min", "k").count() == 0


def test_merge_small_gaps_keeps_sub_ids(series):
    df = segment.label_islands(series([("a", m, 1.0) for m in (0, 5, 25, 30, 40)]), "9min", "k", chunk=None)
    assert values(df, "segment_id") == [0, 0, 1, 1, 2]
    merged = segment.merge_small_gaps(df, "30min", "k")
    assert values(merged, "segment_id") == [0] * 5 and values(merged, "sub_segment_id") == [0, 0, 1, 1, 2]
    stats = segment.island_stats(merged, "k", gap="9min").collect()[0]
    assert stats["has_gaps"] and stats["gap_minutes"] == 30.0 and stats["minutes"] == 40.0


@pytest.mark.parametrize("chunk", ["1min", None])
def test_fills(one, chunk):
    df = one([10.0, None, None, 20.0, None])
    assert values(grid.ffill(df, "value", "k", limit=1, chunk=chunk), "value") == [10, 10, None, 20, 20]
    df = one([50.0, 60.0, None, 70.0, 80.0])
    assert values(grid.ffill(df, "value", "k", chunk=chunk), "value") == [50, 60, 60, 70, 80]
    df = one([None, 10.0, None, 20.0])
    assert values(grid.bfill(df, "value", "k", chunk=chunk), "value") == [10, 10, 20, 20]
    close(values(grid.interpolate(one([10.0, None, None, 40.0]), "value", "k", chunk=chunk), "value"), [10, 20, 30, 40])
    inside = grid.interpolate(one([None, 1.0, None, 3.0, None]), "value", "k", area="inside", chunk=chunk)
    close(values(inside, "value"), [None, 1, 2, 3, None])


def test_conservative_fill(one):
    rule = {"value": (0.0, 40.0, 2.0)}
    df = one([20.0, None, 22.0, None, None, None, 23.0, None, 33.0], 60)
    got = grid.conservative_fill(df, rule, "k", 2)
    close(values(got, "value"), [20, 21, 22, None, None, None, 23, None, 33])


def test_nearest_and_dense(one, series):
    df = series([("a", 10, 1.0), ("a", 55, 2.0), ("a", 200, 3.0)])
    got = grid.downsample_nearest(df, "1h", "k", "value", missing=0.0)
    assert values(got, "value") == [1, 2, 0, 3]
    assert grid.densify(one([1.0, 2.0], 180), "1h", "k").count() == 4


def test_vpd(spark):
    rows = [(25.0, 60.0), (12.0, 85.0), (32.0, 40.0), (None, 50.0), (20.0, 100.0)]
    df = spark.createDataFrame(rows, "t double, h double").select(cl.vpd("t", "h").alias("v"))
    close([r.v for r in df.collect()], [1.267070, 0.210378, 2.852772, None, 0.0])


def test_gdd(series):
    hourly = [("a", 60 * h, 15.0 + 10 * h / 23) for h in range(24)] + [("a", 1440 + 60 * h, 30.0 + 10 * h / 23) for h in range(24)]
    got = growth.gdd_daily(series(hourly), "value", "k", 10.0, 30.0).orderBy("day").collect()
    close([r.gdd_daily for r in got], [10, 20])
    close([r.gdd_cumulative for r in got], [10, 30])


def test_dli(one):
    df = one([0.0] * 6 + [500.0] * 12 + [0.0] * 6, 60)
    close(values(growth.dli(df, "value", "k"), "dli", "day"), [21.6])


def test_dif(one):
    df = one([15.0] * 6 + [25.0] * 12 + [15.0] * 6, 60)
    close(values(growth.dif(df, "value", cal.is_day_fixed("ts"), "k"), "dif", "day"), [10])
    lamps = one([(18.0, 0)] * 8 + [(22.0, 1)] * 8 + [(18.0, 0)] * 8, 60, "value double, lamp int")
    close(values(growth.dif(lamps, "value", cal.is_day_lamps(["lamp"]), "k"), "dif", "day"), [4])


def test_deltas(spark):
    df = spark.createDataFrame([(800.0,), (1000.0,), (1200.0,), (None,)], "c double").select(scores.delta("c", F.lit(900.0)).alias("d"))
    close([r.d for r in df.collect()], [-100, 100, 300, None])
    df = spark.createDataFrame([(x,) for x in (18.0, 20.0, 22.0, 25.0, 15.0, None)], "c double")
    close([r.d for r in df.select(scores.from_midpoint("c", 20, 24).alias("d")).collect()], [-4, -2, 0, 3, -7, None])
    df = spark.createDataFrame([(x,) for x in (18.0, 20.0, 21.5, 24.0, 25.0, 19.99, 24.01, None, 22.0)], "c double")
    assert [r.d for r in df.select(scores.in_range_flag("c", 20, 24).alias("d")).collect()] == [0, 1, 1, 1, 0, 0, 0, 0, 1]


def test_night_stress(one):
    df = one([26.0] * 6 + [15.0] * 12 + [26.0] * 6, 60)
    got = df.withColumn("s", scores.night_stress("value", cal.is_day_fixed("ts"), 25))
    assert values(got, "s") == [1] * 6 + [0] * 12 + [1] * 6


def test_rate_of_change(one):
    got = rolling.rate_of_change(one([10.0, 12.0, 14.0, 16.0, 18.0]), "value", "k")
    close(values(got, "value_rate"), [None] + [2 / 60] * 4)


def test_rolling_mean_left_closed(one):
    df = one([10.0] * 6 + [20.0] * 6 + [15.0] * 6, 10)
    want = [None] + [10] * 6 + [70 / 6, 80 / 6, 90 / 6, 100 / 6, 110 / 6, 20, 115 / 6, 110 / 6, 105 / 6, 100 / 6, 95 / 6]
    close(values(rolling.rolling(df, "value", "1h", ["mean"], "k"), "value_mean"), want)


def test_rolling_min_periods_and_std(one):
    df = one([1.0, 2.0, None, 4.0, 5.0], 60)
    close(values(rolling.rolling(df, "value", "3h", ["mean"], "k", min_n=2), "value_mean"), [None, None, 1.5, 1.5, 3.0])
    df = one([10.0] * 5 + [10.0, 12.0, 10.0, 8.0, 10.0], 10)
    close(values(rolling.rolling(df, "value", "30min", ["std"], "k"), "value_std"), [None, None, 0, 0, 0, 0, 0, 1.154701, 1.154701, 2.0])


def test_lag(one):
    got = join.lagged(one([float(i) for i in range(10)]), "value", [3], "k")
    assert values(got, "value_lag_3") == [None] * 3 + [float(i) for i in range(7)]


def test_actuator_days(one):
    df = one([(10.0, 50.0)] * 12 + [(20.0, 50.0)] * 12 + [(15.0, 0.0)] * 12 + [(25.0, 0.0)] * 12, 60, "vent double, curtain double")
    got = actuator.daily_summary(df, "k", ["vent", "curtain", "absent"])
    close(values(got, "vent_avg", "day"), [15, 20])
    close(values(got, "curtain_avg", "day"), [50, 0])
    assert values(got, "absent_avg", "day") == [None, None]


def test_sparse(one):
    df = one([1.0, None, None, 4.0, None, None, 7.0, None, None, 10.0], 60)
    r = sparse.coverage_gaps(df, "value", "k").collect()[0]
    assert r.coverage == 0.4 and r.points == 4 and r.longest_gap_hours == 3
    assert sparse.sparse_stats(df, "value", "k").collect()[0]["mean"] == 5.5
    full = one([float(i) for i in range(10)], 60)
    assert sparse.coverage_gaps(full, "value", "k").collect()[0].coverage == 1.0


def test_window_plan(spark):
    df = spark.createDataFrame([(0.95, 0.9, 0.9, 1.0), (0.2, 0.3, 0.4, 0.2)], "coverage double, continuity double, score double, availability double")
    got = sparse.window_plan(df).orderBy("coverage").collect()
    assert [(r.window_hours, r.overlap) for r in got] == [(48, 0.75), (12, 0.25)]


def test_era_progress_zero_length(spark):
    df = spark.createDataFrame([(at(0), at(0), at(0))], "t timestamp_ntz, a timestamp_ntz, b timestamp_ntz")
    assert df.select(join.era_progress("t", "a", "b")).collect()[0][0] == 0.5


def test_parsing(spark):
    df = spark.createDataFrame([("1,5",), ("3.0",), ("x",), ("on",), ("",), ("–",)], "s string").select(
        fc.parse_decimal("s").alias("d"), fc.parse_int("s").alias("i"), fc.parse_bool("s").alias("b"))
    got = df.collect()
    assert [r.d for r in got] == [1.5, 3.0, None, None, None, None]
    assert [r.i for r in got] == [None, 3, None, None, None, None]
    assert [r.b for r in got] == [None, None, None, True, False, False]
    with pytest.raises(ValueError):
        fc.clip("s", 5, 1)


def test_reversed_rule_is_rejected(one):
    with pytest.raises(ValueError):
        clean.apply_outlier_rules(one([1.0]), [clean.OutlierRule("value", "domain", low=5, high=1)], "k")


def test_combine_strict_fails_on_missing(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "t int"), spark.createDataFrame([(1, 5)], "t int, v int")
    with pytest.raises(Exception, match="no match for 2"):
        join.combine_strict(a, b, "t").collect()


def test_lempel_ziv():
    assert changepoint.lz_phrases("0001101001000101") == 6  # 0|001|10|100|1000|101
    assert changepoint.lz_phrases("0" * 20) == 2


def test_dwt_keeps_energy_and_round_trips(one):
    df = complexity.blocks(one([math.sin(i) + i / 7 for i in range(16)]), "value", "k", F.lit(0).alias("b"), size=16)
    dec = spectral.wavelet_features(spectral.dwt(df, 16, 3), 3).collect()[0]
    total = sum((math.sin(i) + i / 7) ** 2 for i in range(16))
    assert abs(sum(dec[f"energy_{c}"] for c in ("d1", "d2", "d3", "a")) - total) < 1e-9
    back = spectral.denoise(df, 16, 3, 0.0).collect()[0]
    close(back.denoised, back.x, 1e-9)


def test_spectrum_of_sine(one):
    df = complexity.blocks(one([math.sin(2 * math.pi * 3 * i / 24) for i in range(24)]), "value", "k", F.lit(0).alias("b"), size=24)
    r = spectral.spectral_features(spectral.magnitudes(df, 24), 24, 24.0, [(0, 12)]).collect()[0]
    assert abs(r.peak_frequency - 3.0) < 1e-9 and abs(r.peak_magnitude - 12.0) < 1e-9


def test_permutation_entropy_of_a_line(one):
    got = complexity.permutation_entropy(one([float(i) for i in range(50)]), "value", 3, "k").collect()[0]
    assert abs(got.permutation_entropy) < 1e-12


def test_shifted_pair_lag(one):
    x = [math.sin(i / 3) + (i * 7 % 5) for i in range(60)]
    df = one([(x[i], x[i - 2] if i >= 2 else 0.0) for i in range(60)], 1, "x double, y double")
    assert complexity.cross_correlation(df, "x", "y", 4, "k", chunk=None).collect()[0].best_lag == 2


def test_front_and_indicators(spark):
    pts = [(1.0, 5.0), (2.0, 3.0), (4.0, 1.0), (3.0, 4.0), (5.0, 5.0)]
    df = spark.createDataFrame(pts, "a double, b double")
    assert sorted(tuple(r) for r in op.non_dominated(df, "a", "b").collect()) == pts[:3]
    assert op.hypervolume(df, "a", "b", (6.0, 6.0)).collect()[0].hypervolume == 5 * 1 + 4 * 2 + 2 * 2


def test_indicators_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    f = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(60)]
    t = [(rnd.uniform(0, 8), rnd.uniform(0, 8)) for _ in range(60)]
    df, dt = spark.createDataFrame(f, "a double, b double"), spark.createDataFrame(t, "a double, b double")
    front, truth = op.front_points(df, "a", "b"), op.front_points(dt, "a", "b")
    F_, T_ = [tuple(r) for r in front.collect()], [tuple(r) for r in truth.collect()]
    igd = sum(min(math.hypot(max(x - u, 0), max(y - v, 0)) for x, y in F_) for u, v in T_) / len(T_)
    eps = max(min(max(x - u, y - v) for x, y in F_) for u, v in T_)
    for chunk in ("spread", None):
        assert abs(op.igd_plus(front, truth, "a", "b", chunk=chunk).collect()[0].igd_plus - igd) < 1e-9
        assert abs(op.epsilon_indicator(front, truth, "a", "b", chunk=chunk).collect()[0].epsilon - eps) < 1e-9


def test_a12_is_symmetric(spark):
    rows = [("x", float(i % 7)) for i in range(30)] + [("y", float(i % 5)) for i in range(25)]
    df = spark.createDataFrame(rows, "g string, v double")
    a, b = (op.mann_whitney(df, "v", "g", *p).collect()[0].a12 for p in (("x", "y"), ("y", "x")))
    assert abs(a + b - 1) < 1e-12


def test_knn_against_brute_force(spark):
    import random

    rnd = random.Random(9)
    rows = [(i, rnd.uniform(0, 5), rnd.uniform(0, 5)) for i in range(40)]
    donors = [(i, rnd.uniform(0, 5), rnd.uniform(0, 5), rnd.uniform(0, 1)) for i in range(50)]
    got = join.knn_join(spark.createDataFrame(rows, "id int, x double, y double"), spark.createDataFrame(donors, "d int, u double, w double, t double"),
                        {"x": "u", "y": "w"}, 3, row_id="id", donor_id="d", target="t")
    want = {i: sum(t for _, t in sorted((math.hypot(x - u, y - w), t) for _, u, w, t in donors)[:3]) / 3 for i, x, y in rows}
    for r in got.collect():
        assert abs(r.t - want[r.id]) < 1e-9
    assert got.count() == 40


def test_tails(spark):
    from tidegrid.functions.tails import chi2_tail, normal_two_sided, t_two_sided

    r = spark.createDataFrame([(1.959964, 3.841459, 1.0, 2.228139, 10.0)], "z double, c double, d double, t double, n double").select(
        normal_two_sided("z").alias("z"), chi2_tail("c", "d").alias("c"), t_two_sided("t", "n").alias("t")).collect()[0]
    close([r.z, r.c, r.t], [0.05, 0.05, 0.05], 1e-5)


def test_coherence_of_a_series_with_itself(one):
    df = one([(math.sin(i / 2) + i % 3, math.sin(i / 2) + i % 3) for i in range(60)], 1, "x double, y double")
    got = values(spectral.coherence(df, "x", "y", [2.0], 3, "k", chunk=None), "coherence_0")
    close(got, [1.0] * 60, 1e-9)


def test_threshold_shrinks_details(one):
    df = complexity.blocks(one([float(i % 2) for i in range(16)]), "value", "k", F.lit(0).alias("b"), size=16)
    flat = spectral.denoise(df, 16, 1, 10.0).collect()[0].denoised
    close(flat, [0.5] * 16, 1e-9)
