"""Top-k search over repeated rows: the best candidate fills no rank of another one."""

import numpy as np
import pytest

from tidegrid.llm import topk


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 16])
def test_the_best_candidate_many_times_in_one_block(scale):
    """Vectors 7 and 8 are best and stand there nine times each."""
    r = np.random.default_rng(2)
    c = np.floor(r.normal(size=(100, 40)) * 256) * scale
    q = np.abs(c[50:51]) + 1
    c[7], c[8] = q[0] * 3, q[0] * 2
    ids = np.concatenate([np.arange(100), [7] * 8, [8] * 8])
    rows = np.concatenate([c, np.repeat(c[7:8], 8, axis=0), np.repeat(c[8:9], 8, axis=0)])
    want = sorted({(-sum(int(a) * int(b) for a, b in zip(q[0], row)), int(i)) for i, row in zip(ids, rows) if i != 50})[:5]
    _, got, _ = topk.best(q, np.array([50]), rows, ids, 5)
    assert got.tolist() == [i for _, i in want] and len(set(got.tolist())) == 5


def test_scores_beyond_doubles_over_several_blocks():
    """Scores that are equal as doubles keep their order."""
    n = lambda *x: np.array(x, np.int64)
    _, y, s = topk.top([(n(0), n(1), n(1 << 60)), (n(0), n(2), n((1 << 60) + 1))], 1)
    assert y.tolist() == [2] and s.tolist() == [(1 << 60) + 1]
    _, y, _ = topk.top([(n(0, 0), n(5, 3), n(-(1 << 63), (1 << 63) - 1)), (n(0), n(4), n((1 << 63) - 1))], 3)
    assert y.tolist() == [3, 4, 5]


@pytest.mark.parametrize("block", [1, 3])
def test_search_of_huge_vectors_in_blocks(spark, block):
    rows = [(0, [float(1 << 22), 1.0])] + [(i, [float(1 << 22), float(i % 7)]) for i in range(1, 30)]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    got = [tuple(r) for r in topk.search(v, v.where("id = 0"), 5, block).collect()]
    whole = lambda x: [int(256 * e) for e in x]
    q = whole(rows[0][1])
    want = sorted((-sum(a * b for a, b in zip(q, whole(x))), i) for i, x in rows[1:])[:5]
    assert sorted(got) == [(0, r, i, -s) for r, (s, i) in enumerate(want, 1)]
