"""Operators as pipeline stages."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidegrid.operators import features
from tidegrid.steps import Step


def test_saved_pipeline_gives_equal_rows(spark, one, tmp_path):
    df = one([1.0, 99.0, 3.0, 4.0, None, 6.0])
    stages = [Step(function="operators.clean:clip_outliers", arguments={"rules": {"value": [2.0, 50.0]}}),
              Step(function="operators.rolling:rolling_rows", arguments={"col": "value", "n": 2, "stats": ["mean"], "keys": "k"}, keep=["k", "ts", "value", "value_mean"]),
              Step(function="operators.segment:apply_breaks", arguments={"is_break": {"expr": "value > 10"}, "keys": "k", "chunk": None})]
    model = Pipeline(stages=stages).fit(df)
    model.write().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    want = sorted(model.transform(df).collect(), key=str)
    assert sorted(loaded.transform(df).collect(), key=str) == want and loaded.transform(df).columns == ["k", "ts", "value", "value_mean", "era_id"]
    assert [r.value_mean for r in sorted(want, key=lambda r: r.ts)] == [2.0, 26.0, 26.5, 3.5, 4.0, 6.0]


@pytest.mark.parametrize("name", ["os:system", "operators.clean:_pick", "operators.clean:F", "operators.clean:absent", "operators.clean:DataFrame", "session:ready"])
def test_only_operators_are_called(spark, name):
    with pytest.raises(ValueError, match="no operator"):
        Step(function=name).transform(spark.range(1))


def test_distribution_features(spark):
    import numpy as np

    r = np.random.default_rng(1)
    series = {"a": r.normal(size=200), "b": np.full(5, 3.0), None: np.arange(10.0), "c": [None]}
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, x in series.items() for v in x], "k string, v double")
    for chunk in (None, "spread"):
        got = {x.k: x for x in features.distribution_features(df, "v", "k", chunk=chunk).collect()}
        assert set(got) == {"a", "b", None}
        for k in got:
            c = np.histogram(series[k], 10)[0]
            p = c[c > 0] / c.sum()
            assert abs(got[k].binned_entropy + (p * np.log(p)).sum()) < 1e-9
            assert all(abs(got[k][f"quantile_{q}"] - np.quantile(series[k], q / 100)) < 1e-9 for q in (10, 40, 90))
    assert features.distribution_features(df.where(F.lit(False)), "v", "k").count() == 0
