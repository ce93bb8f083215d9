"""Periodic runs of words: multi-scale minimizers seed, exact comparison extends.

A run is a stretch of consecutive words with smallest period q and a length of at
least max(6, 4 q) that no neighbouring word extends with the same period.

* Periods below ``SHORT`` are found by scanning every such lag over all words.
* Longer periods are searched scale by scale. Scale w serves periods 2 w to 4 w - 1
  and looks at shingles of 2 w words. A position is a minimizer if its shingle's hash is
  smallest among the w positions before it and smaller than those of the w after it, so
  that minimizers are more than w apart. Inside a run the pattern of minimizers repeats
  at period distance, and one exists: were all occurrences of the smallest hash at most w
  apart, their distances would be periods of a shingle twice as long, so would be their
  greatest common divisor, and the run would have that smaller period. A run of four
  periods has room for a minimizer and its repetition with both their windows, and of the
  minimizers that follow the first only three can be nearer than 4 w. So at each scale
  pairs of a minimizer and the next three with equal hash are the seeds: at most 3 n / w.
* Around every seed the words themselves are compared at its distance, far enough to reach the
  ends of a run or the next seed, so that no run is lost and hashes decide nothing. Work and
  memory are linear per scale whatever the text repeats. Scales grow by two up to the longest text.
* A stretch found with a multiple of its period has the ends of the run of the smallest
  period and goes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Texts are worked on in pieces of bounded size; one longer text is a piece by itself.

Defined results: null, empty and wordless texts have no runs and collapse to an empty text;
a word is dropped from the collapsed text if any run holds it after that run's first q
words; rows that repeat are each answered; an empty table gives no rows; columns of the
input that are named like a result are replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mixed, tokenized

SHORT = 16  # lags below are scanned directly; a power of two
LEAST, TIMES = 6, 4  # a run has at least so many words, and so many periods
AT_ONCE = 1 << 22  # words compared at once
RUN = "struct<start: bigint, length: bigint, period: bigint>"
FIELDS = f"runs array<{RUN}>, collapsed string"

U = np.uint64
NONE = U(0xFFFFFFFFFFFFFFFF)


def stretches(ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, open_low: np.ndarray, open_high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (start, end, period) seen by comparing words x and x + q for x from low to high.

    One that reaches an open end of its range is left to another range.
    """
    size = high - low
    first = np.concatenate(([0], np.cumsum(size)))
    x = np.arange(first[-1]) + np.repeat(low - first[:-1], size)
    lag = np.repeat(q, size)
    same = ids[x] == ids[x + lag]
    edge = np.zeros(len(x) + 1, bool)
    edge[first] = True
    fails = np.ones(len(x) + 2, bool)
    fails[1:-1] = ~same
    begin = np.flatnonzero(same & (fails[:-2] | edge[:-1]))
    end = np.flatnonzero(same & (fails[2:] | edge[1:])) + 1
    long = end - begin >= (TIMES - 1) * lag[begin]
    begin, end = begin[long], end[long]
    of = np.searchsorted(first, begin, side="right") - 1
    cut = (open_low[of] & (begin == first[of])) | (open_high[of] & (end == first[of + 1]))
    begin, end, of = begin[~cut], end[~cut], of[~cut]
    return x[begin], x[begin] + (end - begin) + q[of], q[of]


def smallest_of(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``w`` values from each position on, w a power of two."""
    out, step = values.copy(), 1
    while step < w:
        out[:-step] = np.minimum(out[:-step], out[step:])
        step *= 2
    return out


def seeds(value: np.ndarray, place: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of minimizers, and the distance to an equal one of the next three."""
    padded = np.full(len(value) + 2 * w + 1, NONE)
    padded[w:w + len(value)] = value
    low = smallest_of(padded, w)
    minimizer = np.flatnonzero((value != NONE) & (value <= low[:len(value)]) & (value < low[w + 1:w + 1 + len(value)]))
    at, apart = [], []
    for step in (1, 2, 3):
        i, j = minimizer[:-step], minimizer[step:]
        d = place[j] - place[i]
        ok = (value[i] == value[j]) & (d >= 2 * w) & (d < 4 * w)
        at.append(place[i[ok]])
        apart.append(d[ok])
    return np.concatenate(at), np.concatenate(apart)


def find(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of the texts between ``bounds`` in ``codes``, in order of start and period."""
    size = np.diff(bounds)
    longest = int(size.max(initial=0))
    of = np.repeat(np.arange(len(size)), size)
    ids = of * (int(codes.max(initial=0)) + 1) + codes  # no word of one text equals one of another
    found = []
    for q in range(1, SHORT):
        if longest < max(LEAST, TIMES * q):
            break
        differ = np.concatenate(([-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]))
        long = np.flatnonzero(np.diff(differ) - 1 >= max(LEAST, TIMES * q) - q)
        found.append((differ[long] + 1, differ[long + 1] + q, np.full(len(long), q)))

    w, shingle, place, value = SHORT // 2, 1, np.arange(len(ids)), mixed(ids.astype(U) + U(1))
    while longest >= 2 * TIMES * w:
        live = size[of[place]] >= 2 * TIMES * w
        if not live.all():
            place, value = place[live], value[live]
        end = bounds[of[place] + 1]
        while shingle < 2 * w:
            doubled = np.full(len(value), NONE)
            doubled[:-shingle] = mixed(value[:-shingle] * U(0xD6E8FEB86659FD93) + mixed(value[shingle:] + U(shingle)))
            shingle *= 2
            doubled[place + shingle > end] = NONE
            value = doubled
        at, q = seeds(value, place, w)
        if len(at):
            order = np.lexsort((at, q))
            at, q = at[order], q[order]
            begin, stop = bounds[of[at]], bounds[of[at] + 1] - q
            low, high = np.maximum(at - 3 * q // 2 - 2, begin), np.minimum(at + 5 * q // 2 + 2, stop)
            new = np.ones(len(at), bool)
            new[1:] = (q[1:] != q[:-1]) | (low[1:] > high[:-1])
            head = np.flatnonzero(new)
            tail = np.concatenate((head[1:], [len(at)])) - 1
            low, high, lag = low[head], high[tail], q[head]
            part = np.cumsum(high - low) // AT_ONCE
            for p in np.unique(part):
                s = part == p
                found.append(stretches(ids, lag[s], low[s], high[s], low[s] > begin[head][s], high[s] < stop[tail][s]))
        w *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    once = np.ones(len(q), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[once], end[once], q[once]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The words between bounds, joined by one space."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    after = np.ones(n, np.int64)
    after[bounds[1:][np.diff(bounds) > 0] - 1] = 0  # no space after the last word of a text
    spaces = np.concatenate(([0], np.cumsum(after)))
    out = np.full(len(letters) + int(spaces[-1]), 32, np.uint8)
    at = np.ones(len(out), bool)
    at[(offsets[1:] + spaces[:-1])[after > 0]] = False
    out[at] = letters
    ends = offsets[bounds] + spaces[bounds]
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def collapse(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of every text of a piece."""
    words, bounds = tokenized(texts)
    start, end, q = find(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds)
    text = np.searchsorted(bounds, start, side="right") - 1
    per = np.searchsorted(text, np.arange(len(bounds)))
    fields = [pa.array(x, pa.int64()) for x in (start - bounds[text], end - start, q)]
    runs = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    if len(start):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + q, 1)
        np.add.at(depth, end, -1)
        kept = np.cumsum(depth)[:-1] == 0
        words = words.take(pa.array(np.flatnonzero(kept)))
        bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    return runs, joined(words, bounds)


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``runs``, all runs of the text in order of start and period, and ``collapsed``, the text without repetitions."""
    return map_texts(docs, text, FIELDS, lambda: collapse)


def with_planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The text in which every tenth document, by a checksum of its id, repeats a stretch of its words to its end.

    With h the checksum and g = h / 10: where h is a multiple of ten, each of the n words from
    number a = g % n on is replaced by those from there on, repeated with period 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    x = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__w"))
    a = F.when(F.col("__n") > 0, g % F.col("__n"))
    p = (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8)))
    x = x.withColumn("__a", a).withColumn("__p", p)

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("__a"), w).otherwise(F.get("__w", (F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p"))).cast("int")))

    return x.withColumn(text, F.when(F.col("__n") > 0, F.array_join(F.transform("__w", word), " ")).otherwise(F.col(text))).drop("__w", "__n", "__a", "__p")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one, and digests of the list of runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    x = found.withColumn("__best", best)
    return x.select(doc_id, F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.start")).alias("start"), F.col("__best.length").alias("length"),
                    (-F.col("__best.period")).alias("period"), F.floor(F.lit(1000) * F.col("__best.length") / -F.col("__best.period")).alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
