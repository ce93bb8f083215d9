"""Benchmark decontamination: training texts against the word windows of test items.

Windows of ``size`` consecutive normalised words of every item form a hash set
that is broadcast to the tasks; each text is scanned once, window hashes that
are in the set are verified word by word, and the words inside verified windows
are hit. The set never exceeds ``most_windows`` windows per broadcast: a larger
benchmark is dealt into that many more passes by window hash, whose hits are
merged per text. Results do not depend on the number of passes.

Defined results: a null or empty text has no words and no hits; items without
words have no windows; repeated items with one id count once; a null item id
reads ``null``; repeated documents are each answered; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import map_texts, quoted

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # on UTF-8 bytes: digits, letters after lower-casing A-Z, all beyond ASCII
SIZE = 10
MOST_WINDOWS = 2_000_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def item_windows(benchmark: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row (item, window) per distinct window: words joined by one space."""
    def make():
        def each(texts):
            out = []
            for t in texts.to_pylist():
                w = words(t)
                grams = {b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else ()
                out.append([g.decode() for g in grams])
            return [out]
        return each

    ids = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))
    made = map_texts(ids, "text", "windows array<string>", make, drop=["text"])
    return made.select("item", F.explode("windows").alias("window")).distinct()


class WindowSet:
    """A hash set of windows of word numbers, with an exact check behind each hash."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = defaultdict(list)
        for item, window in rows:
            key = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in window.encode().split(b" "))
            self.items[key].append(item)
        random = np.random.default_rng(20_240_101)
        self.value = random.integers(0, 1 << 63, len(self.numbers) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.hashes = {}
        for length in {len(k) for k in self.items}:
            keys = np.array([k for k in self.items if len(k) == length], dtype=np.int64)
            self.hashes[length] = np.sort(self._hash(keys.ravel(), length)[::length])

    def _hash(self, ids: np.ndarray, length: int) -> np.ndarray:
        """Hash of the window that starts at each position."""
        out = np.zeros(len(ids) - length + 1, dtype=np.uint64)
        value = self.value[ids]
        for k in range(length):
            out = out * np.uint64(0x9E3779B97F4A7C15) + value[k:k + len(out)]
        return out

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """Per text: merged hit word ranges [start, end), and the items met, sorted."""
        joined: list[bytes] = []
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            joined += t
            joined.append(b"")  # no window reaches across
            starts[i + 1] = len(joined)
        get = self.numbers.get
        ids = np.fromiter((get(w, -1) for w in joined), dtype=np.int64, count=len(joined))
        ranges: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for length, known in self.hashes.items():
            if len(ids) < length:
                continue
            whole = np.flatnonzero(unknown[length:] == unknown[:-length])  # windows of known words alone
            if not len(whole):
                continue
            h = np.zeros(len(whole), dtype=np.uint64)
            for k in range(length):
                h = h * np.uint64(0x9E3779B97F4A7C15) + self.value[ids[whole + k]]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for p in whole[known[at] == h].tolist():
                met = self.items.get(tuple(ids[p:p + length].tolist()))
                if met:
                    i = int(np.searchsorted(starts, p, side="right")) - 1
                    s = p - int(starts[i])
                    ranges[i].append((s, s + length))
                    items[i].update(met)
        return [(merged(r), sorted(m)) for r, m in zip(ranges, items)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = "n_words long, hits array<struct<start:int,stop:int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Append ``n_words``, ``hits`` (word ranges, stop exclusive, disjoint and sorted) and ``items`` (sorted ids) to every row."""
    spark = docs.sparkSession
    windows = checkpoint(item_windows(benchmark, size, item_id, item_text))
    passes = max(1, -(-windows.count() // most_windows))
    part = F.pmod(F.xxhash64("window"), F.lit(passes))

    def one(df, k):
        kept = windows if passes == 1 else windows.where(part == k)
        shared = spark.sparkContext.broadcast(WindowSet([(r.item, r.window) for r in kept.toLocalIterator()]))

        def make():
            found = shared.value

            def each(texts):
                tokens = [words(t) for t in texts.to_pylist()]
                met = found.scan(tokens)
                return [len(t) for t in tokens], [[{"start": a, "stop": b} for a, b in r] for r, _ in met], [m for _, m in met]
            return each

        return map_texts(df, text, HITS, make)

    if passes == 1:
        return one(docs, 0)
    key = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)  # equal texts have equal hits
    found = reduce(DataFrame.unionByName, [
        one(docs.select(key.alias("__key"), F.col(text)).dropDuplicates(["__key"]), k).select("__key", "n_words", "hits", "items")
        for k in range(passes)])
    found = found.groupBy("__key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # ranges of several passes are merged in order
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))
    ).otherwise(F.concat(acc, F.array(x)))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    found = found.withColumn("hits", F.aggregate(F.array_sort("hits"), empty, step))
    taken = {"n_words", "hits", "items"}
    kept = docs.select(*[c for c in docs.columns if c.lower() not in taken], key.alias("__key"))
    return kept.join(found, "__key").drop("__key")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Cut every hit word range out of the text, from its first to its last word; what stood around it stays."""
    found, schema = _packed(docs, benchmark, options), docs.schema
    at = schema.names.index(options.get("text", "text"))

    def run(batches):
        for batch in batches:
            columns = batch.column("row").flatten()
            rows = zip(columns[at].to_pylist(), batch.column("hits").to_pylist())
            columns[at] = pa.array([cut(t, h) if h else t for t, h in rows], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.select("row", "hits").mapInArrow(run, schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Drop every document with a hit."""
    return _packed(docs, benchmark, options).where(F.size("hits") == 0).select("row.*")


def _packed(docs: DataFrame, benchmark: DataFrame, options: dict) -> DataFrame:
    """Scanned rows whose own columns, whatever their names, are one struct."""
    text = options.get("text", "text")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(text)).alias("__scanned"))
    return scan(rows, benchmark, **(options | {"text": "__scanned"}))


def cut(text: str, hits) -> str:
    """The text without the hit word ranges."""
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for h in hits:
        out.append(raw[at:spans[h["start"]][0]])
        at = spans[h["stop"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The result rows of the query: counts and a digest of the items met."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["stop"] - h["start"])
    return found.select(F.col(doc_id), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
