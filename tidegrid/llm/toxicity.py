"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its word features; the document's score is their noisy-or, 1 - prod(1 - p). Labels
exist for documents only: the gradient of the document's likelihood shares its
error among the sentences by what each contributes, so that the sentences that
explain a label learn it. Features are hashed words and word beginnings. Weights
are not negative, as no word excuses another; an L1 penalty leaves ordinary words
without weight.

The model is fitted on a bounded sample of labelled documents (``most`` per class,
those with the smallest hash of the id, and of these in the same order as many as have
``MOST_BYTES`` in all, weighted back to all labelled ones);
scoring covers all documents and all of their text, and the same weights locate
the offending sentences.

Defined results: a null text counts as empty; of several texts of a labelled id that with the smallest hash teaches; a text without words has no
sentences and score 0; rows without a label or an id teach nothing; without
labels of both classes no word has weight and every score is 0.
"""

from __future__ import annotations

import re
from math import exp, expm1, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import held_out, map_texts

BUCKETS = 1 << 18
MOST = {0: 8_000, 1: 4_000}
MOST_BYTES = 256 << 20  # of texts that are learned from
ROUNDS, RATE, START = 150, 0.3, -5.0
PENALTY = 0.2  # documents that a unit of weight must explain; chosen, like LEAST, by cross-validation in the rows not held out
LEAST = 3  # documents a feature must occur in
THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
PREFIX = 4
MOST_WORDS = 1 << 18


def buckets(word: str) -> tuple[int, int]:
    """The features of a lower-case word: itself and its beginning."""
    return crc32(word.encode()) % BUCKETS, crc32(b"^" + word[:PREFIX].encode()) % BUCKETS


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Ranges of sentences that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text or "") if WORD.search(m[0])]


class Scorer:
    """Sentence and document scores of a fitted model."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.kept = weights, bias, {}

    def weight(self, word: str) -> float:
        w = self.kept.get(word)
        if w is None:
            w = float(sum(self.weights[b] for b in buckets(word)))
            if len(word) <= 64:
                if len(self.kept) >= MOST_WORDS:
                    self.kept.clear()
                self.kept[word] = w
        return w

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence."""
        out = []
        weight = self.weight
        for m in SENTENCE.finditer((text or "")):
            if words := WORD.findall(m[0].lower()):
                z = self.bias + sum(map(weight, set(words)))
                out.append((m.start(), m.end(), 1.0 / (1.0 + exp(-min(max(z, -500.0), 500.0)))))
        return out

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences."""
        weight, rest, least = self.weight, 0.0, log1p(exp(self.bias)) if self.bias < 30 else self.bias
        for s in SENTENCE.findall((text or "").lower()):
            if words := WORD.findall(s):
                z = sum(map(weight, set(words)))
                # -log(1 - p); most sentences have no word with weight
                rest += least if z == 0.0 else log1p(exp(z)) if (z := z + self.bias) < 30 else z
        return -expm1(-rest)


def sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, learn, most: dict[int, int],
           most_bytes: int = MOST_BYTES) -> tuple[pa.Table, dict[int, float]]:
    """Features of the sampled documents, (label, sentence sizes, features), and the weight of a row of each class."""
    usable = labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("__label"))
    counts = {r["__label"]: r["n"] for r in usable.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, taken = {}, []
    for k, limit in most.items():
        part = usable.where(F.col("__label") == k)
        taken.append(part.orderBy(F.xxhash64("__id"), "__id").limit(limit))
        weights[k] = counts.get(k, 0) / max(1, min(limit, counts.get(k, 0)))
    chosen = taken[0].unionByName(taken[1])
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__t")).join(chosen, "__id")
    # one text per id, found before the shuffle: an id may have any number of rows
    rows = checkpoint(rows.groupBy("__id", "__label").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t")))
    sizes = rows.select("__id", "__label", F.coalesce(F.octet_length("__t"), F.lit(0)).cast("long").alias("__size"))  # as many rows as ``most`` has
    before = F.sum("__size").over(Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    fits = sizes.withColumn("__fits", before < most_bytes)
    for r in fits.groupBy("__label").agg(F.count(F.lit(1)).alias("n"), F.count_if("__fits").alias("kept")).collect():
        weights[r["__label"]] *= r["n"] / max(1, r["kept"])
    rows = rows.join(fits.where("__fits").select("__id"), "__id").select("__label", "__t")

    def make():
        kept: dict[str, tuple] = {}

        def of(word):
            if word not in kept:
                if len(kept) > MOST_WORDS:
                    kept.clear()
                kept[word] = buckets(word)
            return kept[word]

        def each(texts):
            sizes, found = [], []
            for t in texts.to_pylist():
                bags = [{b for w in set(words) for b in of(w)} for s in SENTENCE.findall((t or "").lower()) if (words := WORD.findall(s))]
                sizes.append([len(b) for b in bags])
                found.append([x for b in bags for x in b])
            return sizes, found
        return each

    made = map_texts(rows, "__t", "sizes array<int>, found array<int>", make, drop=["__t"])
    return made.toArrow(), weights


def fit_bags(label: np.ndarray, weight: np.ndarray, doc_of: np.ndarray, sentence_of: np.ndarray, feature: np.ndarray,
             rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY, least: int = LEAST) -> tuple[np.ndarray, float]:
    """Weights and bias: full gradients with per-weight step sizes, and a proximal step for the penalty and the sign.

    ``doc_of`` gives the document of each sentence; ``sentence_of`` and ``feature`` list
    what sentences hold, both in order. Gradients add up over pieces of whole documents, so
    that beside the input only a piece is held.
    """
    docs, total = len(label), weight.sum()
    # a feature of few documents can only be learned by heart
    seen_in = np.zeros(BUCKETS, np.int32)
    for d, s, f in pieces(docs, doc_of, sentence_of):
        met = np.unique(doc_of[sentence_of[f]].astype(np.int64) * BUCKETS + feature[f])
        seen_in += np.bincount(met % BUCKETS, minlength=BUCKETS).astype(np.int32)
    used = np.flatnonzero(seen_in >= least)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    kept = number[feature] >= 0
    sentence_of, feature = sentence_of[kept], number[feature[kept]]
    parts = list(pieces(docs, doc_of, sentence_of))
    w, b = np.zeros(len(used)), START
    seen_w, seen_b = np.full(len(used), 1e-12), 1e-12
    for _ in range(rounds):
        gw, gb = np.zeros(len(used)), 0.0
        for d, s, f in parts:
            doc, sentence, what = doc_of[s] - d.start, sentence_of[f] - s.start, feature[f]
            z = b + np.bincount(sentence, w[what], minlength=s.stop - s.start)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            rest = np.bincount(doc, np.logaddexp(0.0, z), minlength=d.stop - d.start)  # -log of the chance that no sentence is toxic
            pull = np.where(label[d] == 1, -np.exp(-rest) / np.maximum(-np.expm1(-rest), 1e-9), 1.0) * weight[d] / total
            g = pull[doc] * p
            gw += np.bincount(what, g[sentence], minlength=len(used))
            gb += g.sum()
        seen_w, seen_b = 0.9 * seen_w + 0.1 * gw * gw, 0.9 * seen_b + 0.1 * gb * gb
        step = rate / (np.sqrt(seen_w) + 1e-4)
        w -= step * gw
        w = np.maximum(w - step * penalty / docs, 0.0)
        b -= 0.1 * gb / (np.sqrt(seen_b) + 1e-6)
        rate *= 0.985
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


def pieces(docs: int, doc_of: np.ndarray, sentence_of: np.ndarray, size: int = 1 << 19):
    """Slices (documents, sentences, features) of whole documents with about ``size`` features each."""
    first = np.searchsorted(doc_of, np.arange(docs + 1))  # of each document's sentences
    begin = np.searchsorted(sentence_of, first)
    a = 0
    while a < docs:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + size, side="right")) - 1)
        b = min(b, docs)
        yield slice(a, b), slice(int(first[a]), int(first[b])), slice(int(begin[a]), int(begin[b]))
        a = b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", learn=None,
        most: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows for which ``learn`` holds (default: those not held out), at most ``most`` of each class."""
    table, weights = sample(docs, labels, label, doc_id, text, ~held_out(doc_id) if learn is None else learn, most or MOST)
    label_of = table.column("__label").to_numpy()
    if len(set(label_of.tolist())) < 2:
        return np.zeros(BUCKETS), -1000.0
    sizes, found = table.column("sizes").combine_chunks(), table.column("found").combine_chunks()
    doc_of = np.repeat(np.arange(len(label_of), dtype=np.int32), sizes.value_lengths().to_numpy())
    size, feature = sizes.flatten().to_numpy(), found.flatten().to_numpy()
    sentence_of = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return fit_bags(label_of, np.array([weights[k] for k in label_of.tolist()]), doc_of, sentence_of, feature)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", locate: float | None = None) -> DataFrame:
    """Append ``score``, and with ``locate`` also ``offending``: the ranges of sentences that score at least as much."""
    used = np.flatnonzero(model[0])
    shared = docs.sparkSession.sparkContext.broadcast((used, model[0][used], model[1]))

    def make():
        at, value, bias = shared.value
        weights = np.zeros(BUCKETS)
        weights[at] = value
        scorer = Scorer(weights, bias)

        def each(texts):
            found = texts.to_pylist()
            scores = [scorer.score(t) for t in found]
            if locate is None:
                return [pa.array(scores, pa.float64())]
            # no sentence scores more than its document
            return pa.array(scores, pa.float64()), [
                [{"start": a, "stop": b, "score": float(p)} for a, b, p in scorer.sentence_scores(t) if p >= locate] if whole >= locate else []
                for t, whole in zip(found, scores)]
        return each

    fields = "score double" + (", offending array<struct<start:int,stop:int,score:double>>" if locate is not None else "")
    return map_texts(docs, text, fields, make, drop=[text])


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD, locate: float | None = None) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted[, offending]) for every document."""
    rows = docs.select(F.col(doc_id), F.col(text))
    found = score(rows, fit(rows, labels, label, doc_id, text), text, locate)
    return found.select(F.col(doc_id), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                        *(["offending"] if locate is not None else []))
