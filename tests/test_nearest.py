"""Nearest rows by cells of several features against brute force."""

import math
import random

import pytest

from tidegrid import frames
from tidegrid.operators import join


def brute(rows, donors, k):
    out = {}
    for i, x in rows:
        if None not in x:
            near = sorted((math.dist(x, d), j, y) for j, d, y in donors if None not in d and y is not None and j is not None)[:k]
            out[i] = sum(y for _, _, y in near) / len(near) if near else None
    return out


def tables(spark, rows, donors, dims):
    names = [f"f{i}" for i in range(dims)]
    left = spark.createDataFrame([(i, *x) for i, x in rows], "id long, " + ", ".join(f"{n} double" for n in names))
    right = spark.createDataFrame([(j, y, *d) for j, d, y in donors], "no long, y double, " + ", ".join(f"{n} double" for n in names))
    return left, right, {n: n for n in names}


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
@pytest.mark.parametrize("chunk", [None, "spread"])
def test_knn_equals_brute_force(spark, dims, chunk):
    """Dense and empty places, many equal donors, ties, rows far outside, repeated rows, NULLs."""
    r = random.Random(dims)

    def point():
        k = r.random()
        return tuple(r.gauss(0, 1) if k < 0.5 else r.gauss(50, 0.01) if k < 0.7 else float(r.randrange(3)) if k < 0.95 else 1000.0 * r.random() for _ in range(dims))

    donors = [(j, point(), float(r.randrange(100))) for j in range(600)] + [(1000 + j, (7.0,) * dims, 1.0 * j) for j in range(90)]
    donors += [(2000, (None,) * dims, 1.0), (2001, (0.0,) * dims, None)]
    rows = [(i, point()) for i in range(80)] + [(100 + i, (7.0,) * dims) for i in range(20)] + [(200, (None,) * dims), (201, (-1e6,) * dims)]
    left, right, names = tables(spark, rows, donors, dims)
    want = brute(rows, donors, 3)
    got = {x.id: x.y for x in join.knn_join(left, right, names, 3, row_id="id", donor_id="no", target="y", chunk=chunk).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_knn_of_few_donors(spark):
    rows = [(1, (0.0, 0.0)), (2, (5.0, 5.0))]
    for donors in ([], [(1, (1.0, 1.0), 4.0)], [(1, (1.0, 1.0), 4.0), (2, (2.0, 2.0), 6.0)]):
        left, right, names = tables(spark, rows, donors, 2)
        got = {x.id: x.y for x in join.knn_join(left, right, names, 3, row_id="id", donor_id="no", target="y", chunk=frames.split_hot(left, ())).collect()}
        assert got == ({i: y for i, y in brute(rows, donors, 3).items()} if donors else {})


def test_visited_cells_grow_with_the_rows(spark, monkeypatch):
    """A row looks at a few cells of bounded size however many donors there are: the pairs a row brings stay about the same."""
    import numpy as np

    per_row = []
    for n in (1_000, 16_000):
        x = np.random.default_rng(1).random((n, 2))
        df = spark.createDataFrame([(i, float(i % 7), float(a), float(b)) for i, (a, b) in enumerate(x)], "no long, y double, f0 double, f1 double")
        seen = []
        real = join.match
        monkeypatch.setattr(join, "match", lambda a, b, keys, *more: seen.append((a, keys)) or real(a, b, keys, *more))
        join.knn_join(df.withColumnRenamed("no", "id"), df, {"f0": "f0", "f1": "f1"}, 3, row_id="id", donor_id="no", target="y", chunk=None)
        per_row.append(seen[-1][0].count() / n)
        monkeypatch.undo()
    assert per_row[1] < 1.2 * per_row[0] and per_row[1] < 6


def test_features_of_few_values_bring_no_more_cells(spark, monkeypatch):
    """Donors that agree in a feature are cut along the others: a row still looks at a few cells only."""
    import numpy as np

    x = np.random.default_rng(2).random(40_000)
    df = spark.createDataFrame([(i, float(i % 7), float(a), float(i % 2)) for i, a in enumerate(x)], "no long, y double, f0 double, f1 double")
    seen = []
    real = join.match
    monkeypatch.setattr(join, "match", lambda a, b, keys, *more: seen.append(a) or real(a, b, keys, *more))
    join.knn_join(df.withColumnRenamed("no", "id"), df, {"f0": "f0", "f1": "f1"}, 3, row_id="id", donor_id="no", target="y", chunk=None)
    assert seen[-1].count() < 2 * len(x)


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_small_cells_equal_brute_force(spark, monkeypatch, dims):
    """Many cells, a cell crowded by equal donors, cells with more rows than a group holds, empty cells, far rows."""
    monkeypatch.setattr(join, "CELL", 16)
    monkeypatch.setattr(join, "ROWS", 8)
    r = random.Random(dims)

    def point():
        return tuple(r.gauss(0, 1) if r.random() < 0.5 else float(r.randrange(3)) for _ in range(dims))

    donors = [(j, point(), float(r.randrange(100))) for j in range(500)] + [(5000 - j, (7.0,) * dims, 1.0 * j) for j in range(300)]
    rows = [(i, point()) for i in range(150)] + [(200 + i, (7.0,) * dims) for i in range(20)] + [(300, (-1e6,) * dims), (301, (6.9,) * dims)]
    left, right, names = tables(spark, rows, donors, dims)
    want = brute(rows, donors, 3)
    got = {x.id: x.y for x in join.knn_join(left, right, names, 3, row_id="id", donor_id="no", target="y").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_cells_hold_every_point(spark):
    """A point lies in the cell that a bound of 0 finds, and all points within a bound in the cells it finds; equal points are not cut."""
    import numpy as np

    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(300, 2)), np.ones((100, 2)), r.integers(0, 2, (100, 2)).astype(float)))
    cells = join.Cells(x[::3], 5, 8)
    home = cells.home(x)
    assert len(set(home[300:400])) == 1 and len(set(home)) > 20
    row, cell = cells.within(x, np.full(len(x), 0.3))
    reached = set(zip(row.tolist(), cell.tolist()))
    near = np.abs(x[:, None] - x[None]).max(2) <= 0.3
    assert all((i, home[j]) in reached for i, j in zip(*np.nonzero(near)))
    assert len(cells.within(x[:1], np.array([np.nan]))[0]) == 32


def test_literature_filter(spark):
    rows = [("Kalanchoe Blossfeldiana", "height", "cm", 1), ("kalanchoe", "height", "mm", 2), ("KALANCHOE x", "width", "cm", 3), (None, "height", "cm", 4), ("rose", "height", "cm", 5), ("k.lanchoe", "height", "cm", 6)]
    df = spark.createDataFrame(rows, "species string, phenotype_name string, phenotype_unit string, i int")
    assert [r.i for r in join.literature_of(df, "kalanchoe", "height", "cm").collect()] == [1]
    assert join.literature_of(df, "k.lan", "height", "cm").collect()[0].i == 6
