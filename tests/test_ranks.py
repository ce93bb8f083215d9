"""Order statistics of long frames against numpy."""

import math

import numpy as np
import pytest
from conftest import at

from tidegrid import frames
from tidegrid.functions.ranks import Ranks
from tidegrid.operators import rolling


def test_windows_of_an_array():
    r = np.random.default_rng(1)
    for x in (r.normal(size=300), r.integers(0, 5, 300).astype(float), np.full(40, 2.0), np.array([1.0]), np.array([])):
        ranks = Ranks(x)
        begin = r.integers(0, len(x) + 1, 200)
        end = np.minimum(begin + r.integers(0, 60, 200), len(x))
        windows = [x[a:b] for a, b in zip(begin, end)]
        for p in (0.0, 0.1, 0.5, 0.75, 1.0):
            assert np.allclose(ranks.quantile(begin, end, p), [np.quantile(w, p) if len(w) else np.nan for w in windows], equal_nan=True)
        assert np.allclose(ranks.median_deviation(begin, end), [np.median(abs(w - np.median(w))) if len(w) else np.nan for w in windows], equal_nan=True)


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("chunk", [None, "1 day", "split"])
def test_long_frames_equal_short_ones(spark, monkeypatch, ahead, chunk):
    """Several series, a NULL key, NULL values, blocks shorter than the series."""
    r = np.random.default_rng(2)
    rows = [(k, at(30 * i), None if r.random() < 0.1 else float(v)) for k, n in (("a", 700), (None, 90), ("b", 3)) for i, v in enumerate(r.normal(size=n))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double").repartition(4)
    if chunk == "split":
        chunk = frames.Split(("k",), [("a",)])
    real = frames.block_frames
    monkeypatch.setattr(rolling, "block_frames", lambda *a, **b: real(*a, **b, block=100))
    stats = ["q10", "median", "iqr", "mad", "mean", "count"]
    got = {(x.k, x.ts): x for x in rolling.rolling_rows(df, "value", 80, stats, "k", min_n=3, ahead=ahead, chunk=chunk).collect()}
    monkeypatch.setattr(rolling, "LONG", 1000)
    want = rolling.rolling_rows(df, "value", 80, stats, "k", min_n=3, ahead=ahead, chunk=chunk).collect()
    assert len(want) == len(rows) == len(got)
    for x in want:
        for s in stats:
            a, b = x[f"value_{s}"], got[x.k, x.ts][f"value_{s}"]
            assert (a is None and b is None) or math.isclose(a, b, abs_tol=1e-9), (s, a, b)


def test_frames_of_ten_thousand_rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=30_000).cumsum()
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, n long, value double")
    got = {row.n: row.value_median for row in rolling.rolling_rows(df, "value", 10_000, ["median", "mad"], "k", "n", chunk=None).collect()}
    for i in (0, 1, 9_999, 10_000, 29_999):
        assert math.isclose(got[i], np.median(x[max(0, i - 9_999):i + 1]))
