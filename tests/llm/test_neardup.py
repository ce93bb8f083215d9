"""Near-duplicate search: ids of several texts, large buckets, members that are not the smallest of their component."""

import random

import numpy as np

from tidegrid.llm import neardup


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_ids_of_several_texts(spark):
    """Texts A and B share id 1; id 7 has forty different texts, and each of them a near copy elsewhere."""
    r = random.Random(3)
    a, b = (" ".join(words(r, 80)) for _ in range(2))
    many = [words(r, 120) for _ in range(40)]
    near = [" ".join([*m[:-1], "changed"]) for m in many]
    rows = [(0, a), (1, a), (1, b), (5, b), (1, None), (6, "")]
    docs = spark.createDataFrame(rows + [(7, " ".join(m)) for m in many] + [(100 + i, t) for i, t in enumerate(near)], "doc_id long, text string").repartition(4)
    got = {x.id: x.class_id for x in neardup.classes(docs).collect()}
    assert got == {0: 0, 1: 0, 5: 0, 6: 6, 7: 7} | {100 + i: 7 for i in range(40)}
    kept = sorted(((x.doc_id, x.text or "") for x in neardup.keep_one(docs).collect()))
    assert kept == sorted([(0, a), (1, b), (1, ""), (6, "")] + [(7, " ".join(m)) for m in many])


def bucket(spark, members, comps=(), band=0):
    """One bucket of signatures given as rows of numbers, as ``across`` takes it, with (id, comp) of linked members."""
    members = members.copy()
    members[:, band * neardup.ROWS:(band + 1) * neardup.ROWS] = 7  # that is why they share the bucket
    buckets = spark.createDataFrame([(5, band, i) for i in range(len(members))], "key long, band int, rep long")
    sigs = spark.createDataFrame([(i, 100, bytearray(m.astype("<u4").tobytes()), bytearray(m.astype(np.uint8).tobytes())) for i, m in enumerate(members)],
                                 "rep long, size long, sig binary, few binary")
    return buckets, spark.createDataFrame(list(comps), "id long, comp long"), sigs


def links(spark, buckets, comp, sigs, texts):
    weights = spark.sparkContext.broadcast(neardup.Weights(np.zeros((neardup.DEPTH, neardup.WIDTH), np.uint64), 1000))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {(x.u, x.v) for x in neardup.across(buckets, comp, sigs, rows, weights).collect()}


def test_all_pairs_of_a_large_bucket(spark, monkeypatch):
    """500 unlinked members with 60 planted pairs of near copies, in one and in several blocks."""
    r = np.random.default_rng(4)
    members = r.integers(0, 1 << 32, (500, neardup.SAMPLES), dtype=np.uint64)
    words = [[f"w{r.integers(0, 1 << 40)}" for _ in range(120)] for _ in range(500)]
    for i in range(60):
        members[440 + i] = np.where(r.random(neardup.SAMPLES) < 0.85, members[i], members[440 + i])
        words[440 + i] = [*words[i][:-4], *words[440 + i][:4]]
    want = {(440 + i, i) for i in range(60)}
    for size in (neardup.MEMBERS, 90):
        monkeypatch.setattr(neardup, "MEMBERS", size)
        assert links(spark, *bucket(spark, members), [" ".join(w) for w in words]) == want


def test_near_misses_leave_no_rows(spark):
    """500 members whose signatures agree in 0.7 of the samples, all below the threshold; only 20 of them are near copies."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 32, neardup.SAMPLES, dtype=np.uint64)
    members = np.where(r.random((500, neardup.SAMPLES)) < 0.85, base, r.integers(0, 1 << 32, (500, neardup.SAMPLES), dtype=np.uint64))
    shared = [f"w{i}" for i in range(90)]
    texts = [" ".join([*shared, *(f"x{i}y{k}" for k in range(30))]) for i in range(500)]
    args = bucket(spark, members)
    assert links(spark, *args, texts) == set()
    for i in range(20):
        texts[i] = " ".join([*shared, *(f"z{k}" for k in range(30)), str(i)])
    got = links(spark, *args, texts)
    assert len(got) == 19 and {x for pair in got for x in pair} == set(range(20))  # a tree, not all pairs


def test_a_pair_is_compared_in_its_first_common_band(spark):
    members = np.tile(np.arange(neardup.SAMPLES, dtype=np.uint64), (2, 1))
    for band, want in ((0, {(1, 0)}), (3, set())):
        buckets, comp, sigs = bucket(spark, members, band=band)
        assert links(spark, buckets, comp, sigs, ["a b c d e f g h"] * 2) == want


def test_members_that_are_not_the_smallest_of_their_component(spark):
    """Two linked groups of 40 in one bucket; of all pairs between them only two are alike. One link joins them."""
    r = np.random.default_rng(5)
    members = r.integers(0, 1 << 32, (80, neardup.SAMPLES), dtype=np.uint64)
    members[70, :105], members[75, :105] = members[30, :105], members[35, :105]
    words = [[f"w{i}x{k}" for k in range(100)] for i in range(80)]
    words[70], words[75] = [*words[30][:-3], "end"], [*words[35][:-3], "end"]
    comps = [(i, 0) for i in range(1, 40)] + [(i, 40) for i in range(41, 80)]
    args, texts = bucket(spark, members, comps), [" ".join(w) for w in words]
    assert links(spark, *args, texts) in ({(70, 30)}, {(75, 35)})
    assert links(spark, args[0], spark.createDataFrame([(i, 0) for i in range(1, 80)], "id long, comp long"), args[2], texts) == set()


def test_weights_do_not_depend_on_the_size_of_the_corpus():
    """Tables as the sketch makes them of corpora of documents with 400 shingles each of their own and five that a share of all have."""
    r = np.random.default_rng(8)
    shares = [1.0, 0.3, 0.05, 0.01, 0.004]
    common = r.integers(0, 1 << 63, len(shares), dtype=np.uint64)
    exact = 1 + neardup.LIFT * np.log([*shares, neardup.RARE]) / np.log(neardup.RARE)
    for documents in (20_000, 200_000, 2_000_000, 12_000_000):
        table = r.poisson(400 * documents / neardup.WIDTH, (neardup.DEPTH, neardup.WIDTH)).astype(np.uint64)
        for row, at in zip(table, neardup.cells(common)):
            row[at] += (np.array(shares) * documents).astype(np.uint64)
        w = neardup.Weights(table, documents)
        own = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        got = np.concatenate([w.of(common, np.ones(len(common))), [w.of(own, np.ones(2000)).mean()]])
        assert np.abs(got / exact - 1).max() < 0.01, documents
