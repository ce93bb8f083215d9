"""Entropies, phrases and transforms of blocks against plain computations."""

import math

import numpy as np
import pytest

from tidegrid.operators import complexity as cx
from tidegrid.operators import spectral as spx
from tidegrid.operators.changepoint import lz_phrases


def blocked(spark, blocks):
    return spark.createDataFrame([(k, i, [float(v) for v in x]) for i, (k, x) in enumerate(blocks)], "k string, b int, x array<double>")


def hits(x, m, n, r):
    t = np.array([x[i:i + m] for i in range(n)]).reshape(n, m)
    return (abs(t[:, None, :] - t[None, :, :]) <= r).all(axis=2)


def sampen(x, m, tol):
    x, n = np.asarray(x, float), len(x) - m
    if n < 1:
        return 0.0
    r = tol * x.std()
    b, a = (hits(x, k, n, r).sum() - n for k in (m, m + 1))
    return -math.log(a / b) if a > 0 and b > 0 else 0.0


def apen(x, m, tol):
    x = np.asarray(x, float)
    phi = lambda k: float(np.log(hits(x, k, len(x) - k + 1, tol * x.std()).mean(axis=1)).mean())
    return phi(m) - phi(m + 1) if len(x) > m else None


@pytest.mark.parametrize("m,tol", [(2, 0.2), (1, 0.5), (3, 0.3)])
def test_entropies_equal_the_definition(spark, m, tol):
    r = np.random.default_rng(2)
    blocks = [("a", r.normal(size=60)), (None, r.normal(size=60).cumsum()), ("b", np.tile([1.0, 2.0, 5.0], 15)), ("c", np.full(30, 7.0)), ("d", r.integers(0, 3, 50)),
              ("e", np.arange(m + 1)), ("f", np.sin(np.arange(80) / 5))]
    df = blocked(spark, blocks)
    got = {r.b: r.sample_entropy for r in cx.sample_entropy(df, m, tol).collect()}
    assert len(got) == len(blocks) and all(abs(got[i] - sampen(x, m, tol)) < 1e-9 for i, (_, x) in enumerate(blocks))
    got = {r.b: r.approximate_entropy for r in cx.approximate_entropy(df, m, tol).collect()}
    assert all(abs(got[i] - apen(x, m, tol)) < 1e-9 for i, (_, x) in enumerate(blocks))


def test_entropies_of_long_blocks(spark):
    """A day by the minute: random, and with few different values. Pairs that are compared stay far from all."""
    r = np.random.default_rng(3)
    blocks = [("a", r.normal(size=1440)), ("b", np.round(20 + 3 * np.sin(np.arange(1440) / 200), 1)), ("c", np.full(1440, 1.0))]
    df = blocked(spark, blocks)
    got = {x.k: x.sample_entropy for x in cx.sample_entropy(df).collect()}
    assert all(abs(got[k] - sampen(x, 2, 0.2)) < 1e-9 for k, x in blocks)
    pairs = {x["k"]: x["count"] for x in cx._near(cx._templates(df, "x", 3, cx.F.size("x") - 2, 0.2), 2).select("_k.k").groupBy("k").count().collect()}
    assert pairs["a"] < 1440 ** 2 / 20 and pairs["c"] == 1


def test_entropies_of_short_and_no_blocks(spark):
    df = blocked(spark, [("a", [1.0]), ("b", [])])
    assert {r.sample_entropy for r in cx.sample_entropy(df).collect()} == {0.0}
    assert {r.approximate_entropy for r in cx.approximate_entropy(df).collect()} == {None}
    assert cx.sample_entropy(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 24, 30, 31, 97, 131, 128, 1440])
def test_fourier_equals_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=(3, n))
    df = blocked(spark, [(str(i), row) for i, row in enumerate(x)])
    for r in df.select("b", spx.fourier(cx.F.col("x"), n).alias("f")).collect():
        got = np.array([v.re + 1j * v.im for v in r.f])
        assert np.allclose(got, np.fft.fft(x[r.b]), atol=1e-9)


def phrases(bits):
    """By searching every piece in what precedes its end."""
    i = n = 0
    while i < len(bits):
        size = 1
        while i + size <= len(bits) and bits[i:i + size] in bits[:i + size - 1]:
            size += 1
        n, i = n + 1, i + size
    return n


def test_phrases_by_suffix_automaton():
    r = np.random.default_rng(1)
    for _ in range(400):
        n, p = int(r.integers(0, 120)), r.choice([0.05, 0.5])
        bits = "".join("01"[int(b)] for b in r.random(n) < p)
        assert lz_phrases(bits) == phrases(bits), bits
    for bits in ("", "0", "01" * 60, "0" * 99 + "1", "001" * 30 + "0"):
        assert lz_phrases(bits) == phrases(bits)
    assert lz_phrases("01" * 200_000) == 3  # linear
