"""Exact top-k search by inner product: columnar branch and bound.

Vectors are scaled to integers. Candidates are packed into blocks of bounded
size, and so are queries; every candidate block meets every query block once, as
one row of a join on the number of the candidates' group. Within a pair the
candidates lie in vertical layout (one row per dimension). Scores accumulate
dimension block by dimension block; after each, the remaining mass (the
product of the norms of what is left of both vectors) bounds every unfinished
score from above and below, the k-th best lower bound is a threshold, and only
survivors are compacted and carried on. A task meets one
query block after the other and keeps the k best per query from block to block, so that the
threshold rises; the few survivors of all tasks are ranked per query at the end.

Defined results: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; a missing tail of a shorter vector counts as
zeros; rows that share the query's id are its own; repeated rows count once;
equal scores go to the smaller id; scores beyond a long are held at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 2048  # vectors in a block of candidates or queries
DIMENSIONS = 16  # dimensions accumulated between two bounds
EXACT = 2.0 ** 53


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (id, v) with whole numbers floor(scale * x) as doubles, for the vectors that take part."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(parts, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Bounded blocks: ``ids`` and ``data`` as little-endian longs and doubles, ``width`` doubles a vector."""
    def run(batches):
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, size - count)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                count += piece.num_rows
                if count == size:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    return vectors.mapInArrow(run, "ids binary, data binary, width int")


def packed(batches) -> pa.RecordBatch:
    ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches]).astype("<i8")
    lists = [b.column(1) for b in batches]
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
    width = int(sizes.max(initial=0))
    data = np.zeros((len(ids), width), "<f8")
    data[np.arange(width) < sizes[:, None]] = flat
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})


def unpacked(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    who = np.frombuffer(ids, "<i8")
    return who, np.frombuffer(data, "<f8").reshape(len(who), width)


def best(queries, query_ids, candidates, candidate_ids, k: int, floor: np.ndarray | None = None, step: int = DIMENSIONS):
    """The k best distinct (candidate id, score) of every query: arrays of query number, candidate id, score.

    ``floor`` holds scores that k candidates met before reach already. Pairs of one id are left out.
    """
    width = max(queries.shape[1], candidates.shape[1])
    q = np.zeros((len(queries), width))
    q[:, :queries.shape[1]] = queries
    c = np.zeros((len(candidates), width))
    c[:, :candidates.shape[1]] = candidates
    with np.errstate(over="ignore"):
        safe = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) < EXACT
    if not safe:  # huge components: whole numbers of any size
        q, c = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
        scores = [[max(-1 << 63, min((1 << 63) - 1, sum(a * b for a, b in zip(x, y)))) for y in c] for x in q]
        found = [sorted({(-s, int(candidate_ids[j])) for j, s in enumerate(row) if candidate_ids[j] != query_ids[i]})[:k] for i, row in enumerate(scores)]
        flat = [(i, y, -s) for i, row in enumerate(found) for s, y in row]
        return (np.array([x[n] for x in flat], dtype=np.int64) for n in range(3))
    order = np.argsort(-np.square(c).sum(axis=0), kind="stable")  # heavy dimensions first: bounds tighten sooner
    q, columns = q[:, order], np.ascontiguousarray(c[:, order].T)
    left_q = np.sqrt(np.cumsum(np.square(q)[:, ::-1], axis=1)[:, ::-1])
    left_c = np.sqrt(np.cumsum(np.square(columns)[::-1], axis=0)[::-1])
    names, name = np.unique(candidate_ids, return_inverse=True)
    repeated = len(names) < len(candidate_ids)
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(candidate_ids != query_ids[i])
        score = np.zeros(len(alive))
        least = -np.inf if floor is None else floor[i]
        for at in range(0, width, step):
            score += q[i, at:at + step] @ (columns[at:at + step] if len(alive) == columns.shape[1] else columns[at:at + step, alive])
            done = at + step >= width
            rest = 0.0 if done else left_q[i, at + step] * left_c[at + step, alive] * (1 + 1e-9) + 1e-6
            if len(alive) > k:
                low = score - rest
                if repeated:  # rows of one id count once
                    rows, low = low, np.full(max(len(names), k), -np.inf)
                    np.maximum.at(low, name[alive], rows)
                least = max(least, np.partition(low, len(low) - k)[len(low) - k])
            keep = score + rest >= least
            if not done and keep.mean() > 0.7 and len(alive) > 64:
                continue  # compacting would cost more than it saves
            alive, score = alive[keep], score[keep]
        take = np.lexsort((candidate_ids[alive], -score))
        if repeated and len(take):
            take = take[np.concatenate(([True], (np.diff(candidate_ids[alive[take]]) != 0) | (np.diff(score[take]) != 0)))]
        take = take[:k]
        out.append((np.full(len(take), i), candidate_ids[alive[take]], score[take].astype(np.int64)))
    return (np.concatenate([x[n] for x in out]) if out else np.zeros(0, np.int64) for n in range(3))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``, both as ``integers`` gives them."""
    spark = vectors.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    theirs = blocks(vectors, block).select(F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("grp"), F.struct("ids", "data", "width").alias("c"))
    # every group of candidates meets all query blocks: they are copied once per group, the candidates not at all
    ours = blocks(queries, block).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"),
                                         F.xxhash64("ids").alias("part"), F.struct("ids", "data", "width").alias("q"))
    # a merge join streams the left side: a task meets one query block after the other, each with all its candidate blocks
    pairs = ours.join(theirs.hint("merge"), "grp")

    def run(batches):
        part, floor, held = None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                now, c, q = (batch.column(n)[row].as_py() for n in ("part", "c", "q"))
                ids, vecs = unpacked(q["ids"], q["data"], q["width"])
                if (now, q["ids"]) != part:
                    yield from kept(held, k)
                    part, floor, held = (now, q["ids"]), np.full(len(ids), -np.inf), []
                who, cand = unpacked(c["ids"], c["data"], c["width"])
                i, y, s = best(vecs, ids, cand, who, k, floor)
                held = [top(held + [(ids[i], y, s)], k)]
                floor = thresholds(ids, held[0], k)
        yield from kept(held, k)

    met = pairs.select("part", "c", "q").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top(parts, k: int):
    """The k best distinct (vec_id, score) per query id of several result sets."""
    q, y, s = (np.concatenate([p[n] for p in parts]) for n in range(3))
    order = np.lexsort((y, ~s, q))  # ~s falls as s grows, without rounding
    q, y, s = q[order], y[order], s[order]
    if len(q):
        fresh = np.concatenate(([True], (np.diff(q) != 0) | (np.diff(y) != 0) | (np.diff(s) != 0)))
        q, y, s = q[fresh], y[fresh], s[fresh]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], y[keep], s[keep]


def thresholds(ids: np.ndarray, held, k: int) -> np.ndarray:
    """Per query the score of its k-th best so far, or minus infinity while it has fewer."""
    q, _, s = held
    last = np.searchsorted(q, ids, side="right") - 1
    full = np.searchsorted(q, ids, side="right") - np.searchsorted(q, ids) >= k
    return np.where(full, s[np.maximum(last, 0)] if len(s) else -np.inf, -np.inf).astype(np.float64)


def kept(held, k: int):
    if held:
        q, y, s = held[0]
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(y, pa.int64()), "score": pa.array(s, pa.int64())})
