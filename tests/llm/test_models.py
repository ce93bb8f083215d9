"""Classifiers on held-out rows, near duplicates against brute force, and the pipeline against its parts."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidegrid.llm import bpe, decontaminate, neardup, quality, secrets, toxicity
from tidegrid.llm.common import table

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture
def odd(spark):
    """Odd documents: null and empty texts, one very long, repeated rows, clashing columns."""
    rows = [(None, "no id but some words here", 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (3, "!!! ###", 1, "x"), (4, "word " * 30_000, 1, "x"),
            (5, "One two three four five six seven.", 1, "x"), (5, "One two three four five six seven.", 1, "x"), (6, "one TWO three; four five six seven", 1, "x"),
            (7, "one two", 1, "x"), (8, "One, two", 1, "x"), (9, "é" * 50, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, stats string")


@pytest.mark.parametrize("run, label, least, sf_dir", [
    (quality.classify, "quality", (0.95, 0.95), SF),
    (toxicity.classify, "toxic", (0.9, 0.9), SF),
    (toxicity.classify, "toxic", (0.99, 0.85), "/root/testdata/sf0.1"),
])
def test_held_out_accuracy(spark, run, label, least, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r.doc_id: r for r in run(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out == held(i) for i, r in got.items())
    truth = [(r.doc_id, r[label]) for r in labels.collect() if held(r.doc_id)]
    for k in (0, 1):
        right = [got[i].predicted == k for i, y in truth if y == k]
        assert np.mean(right) >= least[k], (k, len(right))


def test_labels_of_held_out_rows_teach_nothing(spark):
    from pyspark.sql import functions as F

    from tidegrid.llm.common import held_out

    docs, labels = table(spark, TINY, "documents"), table(spark, TINY, "labels")
    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for run in (quality.classify, toxicity.classify):
        a, b = (sorted((r.doc_id, round(r.score, 6)) for r in run(docs, x).collect()) for x in (labels, turned))
        assert a == b


def test_classifiers_on_odd_rows(spark, odd):
    none = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {1.0}
    assert {r.score for r in toxicity.classify(odd, none).collect()} == {0.0}
    labels = table(spark, TINY, "labels")
    docs = table(spark, TINY, "documents").select("doc_id", "text").unionByName(odd.select((-1 - odd.doc_id).alias("doc_id"), "text"))
    for run in (quality.classify, toxicity.classify):
        got = run(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert run(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(odd, none)
    assert kept.schema == odd.schema and kept.count() == odd.count()


def test_discriminant_equals_the_densities():
    r = np.random.default_rng(0)
    stats = r.integers(0, 50, (400, len(quality.COUNTS))).astype(float) + 50
    label = r.integers(0, 2, 400)
    stats[label == 0, 5] += 30
    shares = np.full(len(quality.SHARES), 0.1)
    x = quality.features(stats, shares)
    m = quality.discriminant({k: (float((label == k).sum()), x[label == k].sum(0), x[label == k].T @ x[label == k]) for k in (0, 1)}, shares)
    cov = [np.linalg.inv(w) @ np.linalg.inv(w).T for w in m.whiteners]
    log = [m.prior[k] - 0.5 * np.linalg.slogdet(cov[k])[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m.means[k], np.linalg.inv(cov[k]), x - m.means[k]) for k in (0, 1)]
    assert np.allclose(m.score(stats), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_offending_sentences(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    sentence = lambda bad: " ".join(["vile"] * bad + [r.choice(words) for _ in range(8)])
    rows = [(i, ". ".join(sentence(i % 3 == 0 and k == 2) for k in range(6)) + ".", int(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(docs, docs.select("doc_id", "toxic"), locate=0.3).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([x.predicted == x.toxic for x in got]) > 0.97
    found = [x.text[s.start:s.stop] for x in got if x.toxic for s in x.offending]
    assert found and np.mean(["vile" in s for s in found]) > 0.97
    assert not [x for x in got if not x.toxic and x.offending]


def noisy_or(weights, bias, text):
    """1 - prod(1 - p) over the sentences, one by one."""
    rest = 1.0
    for sentence in toxicity.SENTENCE.findall((text or "").lower()):
        words = set(toxicity.WORD.findall(sentence))
        if words:
            z = bias + sum(weights[b] for w in words for b in toxicity.buckets(w))
            rest *= 1 - 1 / (1 + np.exp(-z))
    return 1 - rest


def test_document_scores_are_the_noisy_or_of_sentences():
    r = np.random.default_rng(3)
    weights = np.where(r.random(toxicity.BUCKETS) < 0.3, r.exponential(1.5, toxicity.BUCKETS), 0.0)
    vocabulary = [f"word{i}" for i in range(200)]
    for bias in (-5.0, -0.5):
        scorer = toxicity.Scorer(weights, bias)
        for _ in range(100):
            text = " ".join(r.choice(vocabulary) + r.choice(["", "", ".", "!\n", "? ..."]) for _ in range(r.integers(0, 60)))
            assert abs(scorer.score(text) - noisy_or(weights, bias, text)) < 1e-9
            assert abs(1 - np.prod([1 - p for _, _, p in scorer.sentence_scores(text)]) - scorer.score(text)) < 1e-9
    assert scorer.score(None) == scorer.score("") == scorer.score("... !") == 0.0


def test_the_fit_follows_the_gradient_of_the_likelihood():
    """One step from the start moves bias and weights against the numeric gradient of the weighted log loss."""
    r = np.random.default_rng(1)
    docs, label = 12, np.array([0, 1] * 6)
    sizes = r.integers(1, 4, docs)
    doc_of = np.repeat(np.arange(docs), sizes)
    sentence_of = np.repeat(np.arange(len(doc_of)), 3)
    feature = r.integers(0, 6, len(sentence_of))
    weight = r.random(docs) + 0.5

    def loss(w, b):
        z = b + np.bincount(sentence_of, w[feature], minlength=len(doc_of))
        rest = np.bincount(doc_of, np.logaddexp(0, z), minlength=docs)
        return -(weight * np.where(label == 1, np.log(-np.expm1(-rest)), -rest)).sum() / weight.sum()

    start, h = np.zeros(6), 1e-6
    numeric = np.array([(loss(start + h * e, toxicity.START) - loss(start - h * e, toxicity.START)) / (2 * h) for e in np.eye(6)])
    slope = (loss(start, toxicity.START + h) - loss(start, toxicity.START - h)) / (2 * h)
    w, b = toxicity.fit_bags(label, weight, doc_of, sentence_of, feature, rounds=1, penalty=0.0, least=1)
    step = 0.3 / (np.sqrt(0.1 * numeric ** 2 + 0.9e-12) + 1e-4)
    assert np.allclose(w[:6], np.maximum(-step * numeric, 0), rtol=1e-3, atol=1e-6)
    assert np.isclose(b, toxicity.START - 0.1 * slope / (np.sqrt(0.1 * slope ** 2 + 0.9e-12) + 1e-6), rtol=1e-4)


def test_a_labelled_id_of_many_rows_teaches_once(spark):
    """The sample holds one row per id and no more bytes than it may."""
    rows = [(1, f"text {i} of one id") for i in range(3000)] + [(i, "nice day. " * 20) for i in range(2, 60)] + [(i, "awful thing. nice day.") for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(1, 90)], "doc_id long, toxic int")
    every = toxicity.F.lit(True)
    table, weights = toxicity.sample(docs, labels, "toxic", "doc_id", "text", every, toxicity.MOST)
    assert table.num_rows == 89 and weights == {0: 1.0, 1: 1.0}
    table, weights = toxicity.sample(docs, labels, "toxic", "doc_id", "text", every, toxicity.MOST, 3000)
    taken = table.column("__label").to_pylist()
    assert 10 < len(taken) < 60 and abs(weights[0] * taken.count(0) - 59) < 1e-9 and abs(weights[1] * taken.count(1) - 30) < 1e-9


def brute_classes(rows, weights):
    """Every pair that shares a shingle, by exact weighted Jaccard; classes by union."""
    vec = {}
    for i, t in rows:
        h, c, words = neardup.shingles(t)
        if words:
            vec[i] = dict(zip(h.tolist(), weights.of(h, c).tolist()))
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = {}
    for i, v in vec.items():
        for h in v:
            post.setdefault(h, []).append(i)
    for a, b in {(a, b) for m in post.values() for a in m for b in m if a < b}:
        shared = sum(min(w, vec[b][h]) for h, w in vec[a].items() if h in vec[b])
        if shared / (sum(vec[a].values()) + sum(vec[b].values()) - shared) >= neardup.SIMILAR:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def test_classes_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(rows, neardup.Weights(*neardup.sketch(docs)))
    got = {r.id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_classes_of_a_large_group_of_near_copies(spark):
    """Hundreds of different near copies of one text, and as many texts that only share a passage."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[r.randrange(200)] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([word() for _ in range(150)] + base[:60])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.class_id for r in neardup.classes(docs).collect()}
    assert {got[i] for i in range(300)} == {0}
    assert all(got[i] == i for i in got if i >= 1000)
    assert neardup.keep_one(docs).count() == 301


def test_weighted_samples_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(1)
    both, own = (r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (600, 200))
    w = r.uniform(1, 2, 800)
    a, b = np.concatenate([both, own]), both
    agree = np.mean([(neardup.signature(neardup.mixed(a + np.uint64(k)), w) == neardup.signature(neardup.mixed(b + np.uint64(k)), w[:600])).mean() for k in range(40)])
    assert abs(agree - w[:600].sum() / w.sum()) < 0.02


def test_classes_of_odd_rows(spark, odd):
    got = {r.id: r.class_id for r in neardup.classes(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    kept = neardup.keep_one(odd)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 5, 7, 9]
    assert kept.schema == odd.schema
    assert neardup.classes(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(201, 200), (202, 201), (202, 200), (129, 203)]
    got = {r.id: r.comp for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200, 202: 200, 203: 100}
    assert got == want


def test_pipeline_equals_its_parts(spark):
    """Each stage against a plain version of its decision on the stage's own input."""
    docs, labels, bench = (table(spark, SF, n) for n in ("documents", "labels", "benchmark"))
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "benchmark decontamination", "secret scan", "bpe encoding"]
    kept = {r.doc_id for r in steps["quality classifier"](spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean & kept) >= 0.97 * len(clean)

    one = steps["near-dedup"](spark, docs, SF)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == set(brute_classes([(r.doc_id, r.text) for r in docs.collect()], neardup.Weights(*neardup.sketch(docs))).values())

    cut = steps["benchmark decontamination"](spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    before = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.scan(docs, bench)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in cut.collect():
        assert (r.text == texts[r.doc_id]) == (before[r.doc_id] == 0) and r.n_chars == len(r.text)

    hidden = steps["secret scan"](spark, docs, SF)
    assert hidden.columns == docs.columns and secrets.find(hidden).where("size(secrets) > 0").count() == 0

    ids = steps["bpe encoding"](spark, docs, SF)
    codec = bpe.Codec(open(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).read())
    for r in ids.limit(50).collect():
        assert codec.decode(r.ids) == texts[r.doc_id] and len(r.ids) == r.n_tokens


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    extra = spark.createDataFrame([(None, None, None, None, None, "e"), (1, "", "en", "s", 0, "e"), (2, "a " * 9, "en", "s", 18, "e"), (2, "a " * 9, "en", "s", 18, "e")],
                                  "doc_id long, text string, lang string, source string, n_chars long, hits string")
    for docs in (extra, extra.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, TINY)
            assert out.count() <= docs.count()
            if "ids" not in out.columns:
                assert out.columns == docs.columns


def test_run(spark):
    got = corpus_pipeline.run(spark, TINY)
    assert 0 < got.count() < table(spark, TINY, "documents").count()
    assert re.fullmatch("[0-9a-f]{64}", got.first().ids_sha256)
