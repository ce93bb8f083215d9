"""Indicators of any number of objectives against all pairs."""

import math
import random

import pytest

from tidegrid.operators import pareto as op


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
@pytest.mark.parametrize("leaf", [2, 64])
def test_indicators_equal_all_pairs(spark, monkeypatch, dims, leaf):
    """Two keys, a NULL one among them, ties, repeated and odd points, a key without a front."""
    monkeypatch.setattr(op, "LEAF", leaf)
    r = random.Random(dims)
    names = [f"o{i}" for i in range(dims)]
    point = lambda: [float(r.randrange(6)) if r.random() < 0.3 else r.gauss(0, 2) for _ in names]
    truth = [(k, *point()) for k, n in (("a", 60), (None, 25), ("c", 4)) for _ in range(n)]
    truth += [truth[0]] * 3 + [("a", *([None] * dims)), ("a", *([math.nan] * dims))]
    front = [(k, *point()) for k, n in (("a", 90), (None, 30)) for _ in range(n)] + [("a", *([None] * dims))]
    schema = "k string, " + ", ".join(f"{n} double" for n in names)
    f, t = spark.createDataFrame(front, schema), spark.createDataFrame(truth, schema)
    whole = lambda p: all(x is not None and not math.isnan(x) for x in p[1:])

    def want(measure, total):
        out = {}
        for k in ("a", None, "c"):
            ts, fs = ([p[1:] for p in rows if p[0] == k and whole(p)] for rows in (truth, front))
            best = [min((measure([x - y for x, y in zip(q, p)]) for q in fs), default=math.inf) for p in ts]
            out[k] = total(best)
        return out

    igd = want(lambda d: math.sqrt(sum(max(x, 0) ** 2 for x in d)), lambda b: sum(b) / len(b))
    eps = want(max, max)
    for chunk in (None, "spread"):
        got = {x.k: x.igd_plus for x in op.igd_plus_many(f, t, names, "k", chunk=chunk).collect()}
        assert got.keys() == igd.keys() and all(math.isclose(got[k], igd[k], abs_tol=1e-12) for k in igd)
        got = {x.k: x.epsilon for x in op.epsilon_many(f, t, names, "k", chunk=chunk).collect()}
        assert got.keys() == eps.keys() and all(math.isclose(got[k], eps[k], abs_tol=1e-12) for k in eps)


@pytest.mark.parametrize("dims", [2, 3, 5])
@pytest.mark.parametrize("rows,leaf", [(20, 3), (70, 64), (10_000, 64)])
def test_front_equals_all_pairs(spark, monkeypatch, dims, rows, leaf):
    monkeypatch.setattr(op, "LEAF", leaf)
    r = random.Random(dims)
    names = [f"o{i}" for i in range(dims)]
    points = [(k, i, *[float(r.randrange(5)) if r.random() < 0.2 else r.gauss(0, 1) for _ in names]) for k, n in (("a", 130), (None, 40)) for i in range(n)]
    points += [("a", 900 + i, *points[i][2:]) for i in range(10)] + [("a", 990, *([None] * dims)), ("b", 991, *([1.0] * dims))]
    beats = lambda p, q: p[0] == q[0] and all(x <= y for x, y in zip(p[2:], q[2:])) and p[2:] != q[2:]
    whole = [p for p in points if None not in p[2:]]
    want = {p[:2] for p in whole if not any(beats(q, p) for q in whole)}
    df = spark.createDataFrame(points, "k string, i long, " + ", ".join(f"{n} double" for n in names))
    got = op.front_many(df, names, "k", rows=rows)
    assert got.columns == df.columns and {(x.k, x.i) for x in got.collect()} == want
