"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Counts are taken from every whole text once (``statistics``, kept as a narrow table).
Each becomes a share, drawn toward the share of the whole corpus by a few pseudo
counts so that short texts do not scatter, and then a logarithm. Per class the
labelled rows give a mean and a covariance, from sums that are added up by Spark;
each covariance is shrunk toward the pooled one and toward a multiple of the
identity. A score is the posterior of class 1: class shares and the difference of
the Gaussian log densities, whose Mahalanobis distances use the Cholesky factors
computed once.

Defined results: a null text counts as empty, and an empty one is scored like any
other; rows without a label or an id teach nothing; documents labelled several
times count as often. Without any row of class 0 every score is 1, also with no
labels at all; with class 0 alone every score is 0.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import held_out, map_texts, quoted

TO_POOLED, TO_IDENTITY = 0.05, 0.01
PSEUDO = 10.0  # pseudo counts that draw a share to that of the corpus; like the shrinkage, the lowest log loss of cross-validation in the rows not held out
THRESHOLD = 0.7

# Counts of a text, each with the count it is a share of.
COUNTS = {
    "words": None, "letters": None, "characters": None, "sentences": None,
    "upper": "letters", "digits": "characters", "marks": "characters", "signs": "characters", "space": "characters",
    "short": "words", "long": "words", "same_as_last": "words", "distinct": "words", "top_word": "words",
    "repeated_triples": "words", "repeated_sentences": "sentences", "sign_words": "words", "upper_words": "words",
}
SHARES = [c for c, of in COUNTS.items() if of]
LOWER, UPPER, DIGIT, SPACE, MARK, SIGN = range(6)
SENTENCE = re.compile(r"[.!?\n]+")


@cache
def character_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        table[c] = (UPPER if kind in ("Lu", "Lt") else LOWER if kind[0] in "LM" else DIGIT if kind[0] == "N"
                    else SPACE if kind[0] == "Z" or chr(c).isspace() else SIGN)
    table[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
    return table


def statistics(text: str | None) -> list[int]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    text = text or ""
    kinds = np.bincount(character_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=6).tolist()
    words = text.split()
    n = len(words)
    seen = Counter(words)
    sentences = [s for s in map(str.strip, SENTENCE.split(text)) if s]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        n, kinds[LOWER] + kinds[UPPER], len(text), len(sentences),
        kinds[UPPER], kinds[DIGIT], kinds[MARK], kinds[SIGN], kinds[SPACE],
        int((lengths <= 3).sum()), int((lengths >= 12).sum()), sum(map(str.__eq__, words, words[1:])), len(seen),
        max(seen.values(), default=0), max(n - 2, 0) - len(set(zip(words, words[1:], words[2:]))), len(sentences) - len(set(sentences)),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words), sum(map(str.isupper, words)),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``stats``: the counts of every whole text."""
    return map_texts(docs, text, "stats array<long>", lambda: lambda texts: [[statistics(t) for t in texts.to_pylist()]], drop=[text])


def corpus_shares(measures: DataFrame) -> np.ndarray:
    """The share of each count over all documents together."""
    sums = measures.agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(c) for i, c in enumerate(COUNTS)]).first()
    return np.array([(sums[c] + 1.0) / (sums[COUNTS[c]] + 2.0) for c in SHARES])


def features(stats: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Feature vectors (rows) of statistics (rows)."""
    names = list(COUNTS)
    column = {c: stats[:, i].astype(float) for i, c in enumerate(names)}
    out = [np.log1p(column["words"])]
    out += [np.log((column[c] + PSEUDO * p) / (column[COUNTS[c]] + PSEUDO)) for c, p in zip(SHARES, shares)]
    n = column["words"]
    out.append((column["letters"] + PSEUDO * 5) / (n + PSEUDO))  # mean word length
    # distinct words fall with length: what is left after the usual fall
    out.append(np.log((column["distinct"] + 5) / (np.power(n, 0.85) + 5)))
    out.append(np.log((column["top_word"] + 5) / (0.05 * n + 5)))
    return np.column_stack(out)


WIDTH = len(SHARES) + 4


@dataclass
class Model:
    shares: np.ndarray
    prior: tuple[float, float]  # log shares of the classes
    means: np.ndarray
    whiteners: np.ndarray  # inverses of the Cholesky factors
    log_determinants: np.ndarray
    only: float | None = None  # the score of every text if a class has no rows

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(stats), self.only)
        x = features(stats, self.shares)
        log = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiteners[k].T
            log.append(self.prior[k] - 0.5 * np.square(z).sum(axis=1) - self.log_determinants[k])
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def moments(labelled: DataFrame, shares: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum, and sum of outer products of the feature vectors. ``labelled`` has ``label`` and ``stats``."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            stats = np.array(batch.column("stats").flatten()).reshape(batch.num_rows, len(COUNTS))
            x = np.column_stack([np.ones(len(stats)), features(stats, shares)])
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = x[label == k]
                yield pa.RecordBatch.from_pydict({"label": pa.array([k] * (WIDTH + 1) ** 2, pa.int32()),
                                                  "cell": pa.array(np.arange((WIDTH + 1) ** 2), pa.int32()),
                                                  "value": pa.array((part.T @ part).ravel())})

    rows = (labelled.select("label", "stats").mapInArrow(run, "label int, cell int, value double")
            .groupBy("label", "cell").agg(F.sum("value").alias("value")).collect())  # two small matrices
    sums = np.zeros((2, (WIDTH + 1) ** 2))
    for r in rows:
        sums[r.label, r.cell] = r.value
    out = {}
    for k in (0, 1):
        m = sums[k].reshape(WIDTH + 1, WIDTH + 1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def discriminant(sums, shares: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    n = [sums[k][0] for k in (0, 1)]
    if min(n) < 1:
        return Model(shares, (0.0, 0.0), np.zeros(0), np.zeros(0), np.zeros(0), 0.0 if n[0] >= 1 else 1.0)
    means = [sums[k][1] / n[k] for k in (0, 1)]
    scatter = [sums[k][2] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(sum(n) - 2, 1)
    whiteners, logs = [], []
    for k in (0, 1):
        own = (1 - to_pooled) * scatter[k] / max(n[k] - 1, 1) + to_pooled * pooled
        own = (1 - to_identity) * own + to_identity * max(np.trace(pooled) / WIDTH, 1e-6) * np.eye(WIDTH)
        factor = np.linalg.cholesky(own)
        whiteners.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    total = sum(n)
    return Model(shares, (np.log(n[0] / total), np.log(n[1] / total)), np.array(means), np.array(whiteners), np.array(logs))


def fit(measures: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", learn=None) -> Model:
    """Fit on the labelled rows; ``learn`` is a condition on the labels' rows (default: those not held out)."""
    shares = corpus_shares(measures)
    learn = ~held_out(doc_id) if learn is None else learn
    taught = labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
    labelled = measures.select(F.col(doc_id).cast("long").alias("__id"), "stats").join(taught, "__id").select("label", "stats")
    return discriminant(moments(labelled, shares), shares)


def score(measures: DataFrame, model: Model) -> DataFrame:
    """Append ``score`` in place of ``stats``."""
    shared = measures.sparkSession.sparkContext.broadcast(model)
    at = measures.columns.index("stats")
    kept = [f for f in measures.schema if f.name.lower() not in ("stats", "score")]
    names = [f.name for f in kept]

    def run(batches):
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                stats = np.array(batch.column(at).flatten()).reshape(batch.num_rows, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(m.score(stats))], names=[*names, "score"])

    schema = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept] + ["score double"])
    return measures.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document."""
    measures = checkpoint(measured(docs.select(F.col(doc_id), F.col(text)), text))
    found = score(measures, fit(measures, labels, label, doc_id))
    return found.select(F.col(doc_id), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, unchanged. The model is fitted on narrow statistics; texts are not moved."""
    measures = checkpoint(measured(docs.select(F.col(doc_id), F.col(text)), text))
    model = docs.sparkSession.sparkContext.broadcast(fit(measures, labels, label, doc_id))
    at, schema = docs.columns.index(text), docs.schema

    def run(batches):
        m = model.value
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(m.score(stats) >= threshold))

    return docs.mapInArrow(run, schema)
