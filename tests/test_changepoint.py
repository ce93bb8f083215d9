"""Whole-series recurrences against plain computations over one array."""

import math

import numpy as np
import pytest
from conftest import at, values
from pyspark.sql import functions as F

from tidegrid import frames
from tidegrid.operators import changepoint as ch


@pytest.fixture
def many(spark):
    """Rows (k, ts, value) of several series, a NULL key among them, in small batches so that series span many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    def make(by_key):
        rows = [(k, at(60 * i), None if v is None else float(v)) for k, x in by_key.items() for i, v in enumerate(x)]
        return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double").repartition(5)

    yield make
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def breaks(df, key):
    rows = sorted((r.ts, r.is_break) for r in df.collect() if r.k == key)
    return [i for i, (_, b) in enumerate(rows) if b]


def cost(x, model, s, t):
    x, n = x[s:t], t - s
    if model == "l2":
        return float(((x - x.mean()) ** 2).sum())
    return float(x.sum() - x.sum() * math.log(x.sum() / n)) if x.sum() else 0.0


def optimum(x, model, penalty, size):
    """Exhaustive dynamic programming."""
    best, cut = {0: -penalty}, {}
    for t in range(size, len(x) + 1):
        best[t], cut[t] = min((best[s] + cost(x, model, s, t) + penalty, s) for s in best if t - s >= size)
    out, t = [], len(x)
    while cut.get(t):
        t = cut[t]
        out.append(t)
    return out[::-1]


@pytest.mark.parametrize("model,penalty,size", [("l2", 3.0, 4), ("l2", 0.5, 1), ("poisson", 2.0, 5)])
def test_pelt_is_optimal(many, model, penalty, size):
    r = np.random.default_rng(3)
    series = {"a": r.normal(size=90).cumsum(), "b": np.r_[r.normal(size=40), r.normal(9, 1, 41)], None: r.normal(size=50).cumsum(), "c": np.array([1.0]), "d": np.full(30, 2.0)}
    series = {k: np.round(abs(x)) if model == "poisson" else x for k, x in series.items()}
    got = ch.pelt(many(series), "value", "k", model=model, penalty=penalty, min_size=size)
    assert got.columns == ["k", "ts", "value", "is_break"]
    for k, x in series.items():
        assert breaks(got, k) == optimum(x, model, penalty, size), k


def test_pelt_finds_steps(many):
    x = np.r_[np.zeros(60), np.full(60, 5.0), np.zeros(60)] + np.sin(np.arange(180)) * 0.1
    for model, penalty in (("l2", 10.0), ("rbf", 5.0)):
        assert breaks(ch.pelt(many({"a": x, "b": x[:100]}), "value", "k", model=model, penalty=penalty, min_size=10), "a") == [60, 120]
    assert breaks(ch.pelt(many({"a": np.r_[np.full(40, 2.0), np.full(40, 9.0)]}), "value", "k", model="poisson", penalty=5.0, min_size=7), "a") == [40]


def test_pelt_across_a_month(spark):
    """A break one reading after a month has begun; rows without a value take no part; an empty table stays empty."""
    rows = [("a", at(60 * i), 0.0 if i <= 31 * 24 else 5.0) for i in range(40 * 24)] + [("a", at(30), None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = ch.pelt(df, "value", "k", model="l2", penalty=10.0, min_size=24)
    assert breaks(got, "a") == [31 * 24 + 1] and got.count() == 40 * 24
    assert ch.pelt(df.limit(0), "value", "k", model="l2").count() == 0


def test_random_waves_stand_for_the_kernel():
    x = np.random.default_rng(2).normal(size=300)
    phi = ch.sums_of(x, "rbf", 0.7)
    assert abs((phi @ phi.T) - np.exp(-0.7 * (x[:, None] - x[None, :]) ** 2)).mean() < 0.12


def posterior(x, lam):
    """All run lengths, none dropped."""
    mu, kappa, alpha, beta = (np.array([v]) for v in (0.0, 1.0, 1.0, 1.0))
    mass, hazard, out = np.array([1.0]), 1.0 / lam, []
    for t, v in enumerate(x):
        scale = beta * (kappa + 1) / (alpha * kappa)
        like = np.array([math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * math.pi * a * s) * (1 + (v - m) ** 2 / (2 * a * s)) ** -(a + 0.5)
                         for a, s, m in zip(alpha, scale, mu)])
        new = mass * like * np.where(np.arange(len(mass)) == 0, 1.0, 1.0 - hazard if t else 1.0)
        new /= new.sum()
        out.append(new[0] if t else 0.0)
        mu, kappa, alpha, beta = (np.r_[0.0, (kappa * mu + v) / (kappa + 1)], np.r_[1.0, kappa + 1], np.r_[1.0, alpha + 0.5],
                                  np.r_[1.0, beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1))])
        mass = np.r_[hazard, new]
    return out


def test_bocpd_equals_the_whole_posterior(many):
    r = np.random.default_rng(1)
    series = {"a": np.r_[r.normal(0, 0.1, 80), r.normal(8, 0.1, 40)], None: r.normal(size=33), "c": np.array([2.0])}
    got = ch.bocpd(many(series), "value", "k", lam=100.0)
    for k, x in series.items():
        p = [v for _, v in sorted((r.ts, r.cp_prob) for r in got.collect() if r.k == k)]
        assert np.allclose(p, posterior(x, 100.0), atol=1e-9)
        if k == "a":
            assert p[80] > 0.5 and max(p[20:80]) < 0.5


def test_run_lengths_stay_few():
    """The state of a series with a change now and then does not grow with the series."""
    r = np.random.default_rng(4)
    runs = ch.RunLengths(100.0, 1e-12)
    for i in range(20):
        runs(r.normal(5 * (i % 2), 0.3, 300))
    assert len(runs.mass) < 700
    assert abs(ch.gamma_ratio(np.array([5, 999, 1000, 5000])) - [math.lgamma(1.5 + x / 2) - math.lgamma(1 + x / 2) for x in (5, 999, 1000, 5000)]).max() < 1e-9


def baum_welch(obs, states, symbols, iterations):
    """Over one array, reading by reading."""
    a, b, pi = ch.start_parameters(states, symbols)
    n, onehot = len(obs), np.eye(symbols)[obs]
    for _ in range(iterations):
        e, fwd, bwd, c = b[:, obs].T, np.empty((n, states)), np.ones((n, states)), np.empty(n)
        for t in range(n):
            fwd[t] = (pi if t == 0 else fwd[t - 1] @ a) * e[t]
            c[t] = fwd[t].sum()
            fwd[t] /= c[t]
        for t in range(n - 2, -1, -1):
            bwd[t] = a @ (e[t + 1] * bwd[t + 1]) / c[t + 1]
        gamma = fwd * bwd
        gamma /= gamma.sum(1, keepdims=True)
        xi = a * (fwd[:-1].T @ (e[1:] * bwd[1:] / c[1:, None]))
        a = (xi + 1e-9) / (xi + 1e-9).sum(1, keepdims=True)
        b = gamma.T @ onehot + 1e-6
        b, pi = b / b.sum(1, keepdims=True), gamma[0]
    return a, b, pi


def viterbi(obs, a, b, pi):
    score, back = np.log(pi + 1e-300) + np.log(b[:, obs[0]]), []
    for o in obs[1:]:
        step = score[:, None] + np.log(a)
        back.append(step.argmax(0))
        score = step.max(0) + np.log(b[:, o])
    path = [int(score.argmax())]
    for came in back[::-1]:
        path.append(int(came[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_hidden_states_do_not_depend_on_parts(many, size):
    r = np.random.default_rng(7)
    draw = lambda n: np.concatenate([r.choice(4, 12, p=[[0.7, 0.2, 0.1, 0.0], [0.1, 0.2, 0.3, 0.4]][i % 2]) for i in range(n)])
    series = {"a": draw(7), None: draw(4), "c": np.array([3])}
    df = many(series).withColumn("symbol", F.col("value").cast("int"))
    parts = ch.hmm_chunks(df, "symbol", "k", size=size, chunk=None)
    fit = ch.hmm_fit(parts, "k", 2, 4, 3)
    want = {k: baum_welch(x, 2, 4, 3) for k, x in series.items() if len(x) > 1}
    for row in fit.collect():
        if row.k in want:
            assert all(np.allclose(np.ravel(g), np.ravel(w), atol=1e-8) for g, w in zip((row.a, row.b, row.pi), want[row.k]))
    got = ch.hmm_path(parts, fit, "k", 2).collect()
    for k, (a, b, pi) in want.items():
        assert [r.state for r in sorted((r for r in got if r.k == k), key=lambda r: r.ts)] == viterbi(series[k], a, b, pi)
        assert [r.symbol for r in sorted((r for r in got if r.k == k), key=lambda r: r.ts)] == series[k].tolist()


def test_hidden_states_of_two_levels(many):
    obs = np.r_[np.zeros(30), np.full(30, 3), np.zeros(30)]
    df = many({"a": obs}).withColumn("symbol", F.col("value").cast("int"))
    got = ch.hmm_states(df, "symbol", "k", 2, 4, iterations=5, size=16)
    assert values(got, "state") == [0] * 30 + [1] * 30 + [0] * 30
    assert ch.hmm_states(df.limit(0), "symbol", "k", 2, 4, iterations=1).count() == 0


def test_carried_hands_the_state_on(many):
    """A running sum per key, NULL keys included, both ways."""
    class Sum:
        def __init__(self):
            self.s = 0.0

        def __call__(self, x):
            out = self.s + np.cumsum(x)
            self.s = out[-1]
            return (out,)

    series = {"a": range(40), None: range(5), "b": [2]}
    df = many(series)
    on = frames.carried(df, "k", "ts", ["value"], "s double", Sum)
    back = frames.carried(df, "k", "ts", ["value"], "s double", Sum, back=True)
    for k, x in series.items():
        x = np.array(list(x), float)
        assert [r.s for r in sorted((r for r in on.collect() if r.k == k), key=lambda r: r.ts)] == np.cumsum(x).tolist()
        assert [r.s for r in sorted((r for r in back.collect() if r.k == k), key=lambda r: r.ts)] == np.cumsum(x[::-1])[::-1].tolist()
