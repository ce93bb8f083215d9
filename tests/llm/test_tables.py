"""Top-k search, sharding, decontamination and WARC against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow.fs
import pytest

from tidegrid.llm import decontaminate, shards, topk, warc


def brute_topk(rows, k):
    clean = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {i for i, _ in clean if i % 50 == 0}:
        met = {(y, max(-1 << 63, min((1 << 63) - 1, sum(a * b for a, b in zip(x, w))))) for p, x in clean if p == q for y, w in clean if y != q}
        for rank, (y, s) in enumerate(sorted(met, key=lambda m: (-m[1], m[0]))[:k], 1):
            out.add((q, rank, y, s))
    return out


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_topk_equals_brute_force(spark, block):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(40)]) for i in range(300)]
    rows += [(1000 + i, [float(i % 3)] * 40) for i in range(60)]  # ties
    rows += [(7, rows[7][1]), (50, rows[50][1]), (None, [1.0] * 40), (2000, None), (2001, [None] * 40), (2002, [math.nan] * 40),
             (2050, [math.inf] * 40), (3000, []), (3050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "1 AS score", "2 AS rank").repartition(4)
    vectors = topk.integers(df)
    got = topk.search(vectors, vectors.where("id % 50 = 0"), 5, block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_topk(rows, 5))


def test_topk_of_few_huge_or_no_vectors(spark):
    make = lambda rows: topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for rows in ([], [(50, [1.0])], [(50, [1.0]), (1, [2.0])], [(0, [1e15, 1.0]), (1, [1.0, 3.0]), (2, [1e14, -2.0])]):
        v = make(rows)
        assert set(map(tuple, topk.search(v, v.where("id % 50 = 0"), 5).collect())) == brute_topk(rows, 5)


@pytest.fixture
def docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta é".split()) for _ in range(r.randint(0, 30))), "a") for i in range(400)]
    rows += [(5, "hot text " + str(i), "b") for i in range(150)] + [(None, None, None), (None, "no id", "c"), (9000, "long " * 3000, "d"), (9001, "", "e")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, depth string").repartition(5)


def bits(doc_id, text):
    md5 = lambda s, n: int(hashlib.md5(s.encode()).hexdigest()[:n], 16)
    return format(md5("" if doc_id is None else str(doc_id), 8) << 28 | md5(text or "", 7), "060b")


def brute_shards(rows, limit):
    """Split recursively, bit by bit."""
    out = []

    def split(members, prefix):
        size = sum(len((t or "").encode()) for _, t in members)
        if size <= limit or len(prefix) == shards.BITS:
            out.extend((i, len((t or "").encode()), prefix, len(prefix), size, size <= limit) for i, t in members)
            return
        for b in "01":
            if part := [m for m in members if bits(*m)[len(prefix)] == b]:
                split(part, prefix + b)

    split(rows, "")
    return Counter(out)


@pytest.mark.parametrize("limit", [200, 1000, 1 << 20])
def test_shards_equal_recursive_splitting(spark, docs, limit):
    got = shards.shard(docs, limit=limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits").collect()
    assert Counter(map(tuple, got)) == brute_shards([(r.doc_id, r.text) for r in docs.collect()], limit)


def test_shards_of_nothing_and_written(spark, docs, tmp_path):
    assert shards.shard(docs.limit(0)).count() == 0
    shards.write(shards.shard(docs, limit=1000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    words, hit, met = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            window = w[i:i + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p:p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    met.add("null" if item is None else str(item))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


@pytest.fixture
def leaks(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(["É", "the", "cat", "Sat", "on", "mat", "42", "x-y", "naïve"]) for _ in range(n))
    items = [(i, some(r.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(10, None), (11, ""), (None, some(12)), (3, "!!!")]
    items.append(items[0])
    texts = [None, "", "...", some(4000), "É " * 200] + [some(r.randint(0, 40)) for _ in range(80)]
    texts += [some(7) + " -- " + items[r.randrange(12)][1].upper() + "! " + some(7) for _ in range(60)]
    docs = [(i, t, i, [0]) for i, t in enumerate(texts)] + [(4, texts[4], 4, None), (None, texts[-1], 0, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, n_words long, HITS array<int>").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"), texts, items)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_hits_equal_brute_force_in_any_number_of_passes(leaks, most):
    docs, bench, texts, items = leaks
    got = decontaminate.digest(decontaminate.scan(docs, bench, most_windows=most)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == brute_hits(texts[-1] if r.doc_id is None else texts[r.doc_id], items)


def test_nothing_to_scan(leaks):
    docs, bench, _, _ = leaks
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    clean = decontaminate.digest(decontaminate.scan(docs, bench.limit(0)))
    assert clean.where("contaminated").count() == 0 and clean.count() == docs.count()


def test_removal(spark, leaks):
    docs, bench, texts, items = leaks
    long = [(i, t) for i, t in items if t and len(split(t)) >= 10]
    bench = spark.createDataFrame(long, "item_id long, text string")
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    for r in cut.where("doc_id IS NOT NULL").collect():
        n, hit, *_ = brute_hits(texts[r.doc_id], long)
        assert (r.text == texts[r.doc_id]) if not hit else len(split(r.text)) == n - hit
    left = decontaminate.remove_documents(docs, bench)
    assert left.count() == sum(not brute_hits(texts[-1] if r.doc_id is None else r.text, long)[4] for r in docs.collect())


@pytest.fixture
def pages(spark):
    body = "<p>" + "same body " * 20 + "</p>"
    rows = [(i, f"http://x/{i}", body if i % 3 else f"<p>{i}</p>" * 30, "a") for i in range(60, 0, -1)]
    rows += [(100, None, None, "b"), (101, "u", "", "b"), (102, "u", "short", "b"), (103, "u", "short", "b"), (104, "two\nlines", "é" * 50, "c"),
             (105, "u", "é" * 50, "c"), (106, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 4, "d"), (107, "u", "x" * 3_000_000, "e"),
             (1, "http://x/1", body, "a"), (2, "http://x/2", body, "a"), (None, "n", "no id", "f")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(4)


def brute_warc(rows):
    first = {}
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 100:
            first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    out = []
    for r in rows:
        raw, to = (r.html or "").encode(), first.get(r.html)
        again = len(raw) >= 100 and to is not None and to != r.page_id
        out.append((r.page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return Counter(out)


@pytest.mark.parametrize("size", [500, 64 << 20])
def test_archives_give_the_pages_back(pages, size):
    got = warc.round_trip(pages, size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == brute_warc(pages.collect())


def test_normalised_files(spark, pages, tmp_path):
    import gzip
    import json

    made = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    assert sum(r.records for r in made) == pages.count()
    for r in made:
        raw = open(r.path, "rb").read()
        entries = [json.loads(x) for x in open(r['index'])]
        assert [e["offset"] for e in entries] == [sum(e["length"] for e in entries[:i]) for i in range(len(entries))] and len(entries) == r.records
        for e in entries:
            assert gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
        whole = tmp_path / "w" / "whole" / r.path.rsplit("/", 1)[1]
        assert gzip.decompress(raw) == gzip.decompress(whole.read_bytes())
    assert not [f for f in (tmp_path / "w" / "members").iterdir() if f.name.startswith(".")]


def test_damaged_and_empty_archives(spark, pages, tmp_path):
    assert warc.round_trip(pages.limit(0)).count() == 0
    import gzip

    bad = tmp_path / "cut.warc.gz"
    bad.write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 100\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(pyarrow.fs.LocalFileSystem(), str(bad))))
    many = tmp_path / "many.warc.gz"
    one = warc.record(1, "u", b"x", "d", None)
    many.write_bytes(gzip.compress(one) + gzip.compress(one + one))
    assert len(list(warc.records(warc.inflated(pyarrow.fs.LocalFileSystem(), str(many))))) == 3
