"""Prefix trie over conversations: ternary search trees per range shard, merged where shards meet.

1. ``turn_lists``: every turn becomes a digest of its role and text (16 bytes) and the number of
   its words; from here on no text moves. A conversation's path is the row of its turns' digests.
2. ``nodes``: paths are sorted into ranges by (path, conversation id), so that neither a common
   first turn nor copies of one conversation meet in one task. A task reads its range as a
   stream and cuts it into shards of at most ``TURNS`` turns, so its memory is bounded however
   large a range is. Within a shard the turns are encoded by a sorted dictionary, and the distinct
   paths go into a ternary search tree, medians first, which balances it. One iterative
   traversal adds up members, leaves and savings from the leaves to the root.
3. Nodes off the first and last path of a shard are complete. Those on them may go on in a
   neighbouring shard: at most two paths per shard, merged by node afterwards. Each merged node
   adds its leaves and savings to its ancestors, which all are such nodes too.
4. ``ends_sha256`` of a complete node is made in its shard. For the others the ids come
   in pieces of text, one per node and shard, and a digest runs over them in order of ids, so
   that copies of one conversation, however many, are never gathered.

Defined results: a null role or text counts as empty; turns are ordered by number, null first,
ties by their digest; repeated rows are turns of their own; rows without a
conversation id take no part; an empty table has no conversations and gives no node, not
even a root; columns beyond conv_id, turn, role and text are ignored. A conversation's digests (16 bytes a
turn) stand in one row, its texts do not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

TURNS = 1 << 18  # turns in a shard at most, but for one longer conversation
DIGEST = 16
SENT = 100_000  # nodes of several shards that every task may get, 32 bytes each
NIL = -1
FIELDS = ("whole boolean, key binary, parent binary, ancestors array<binary>, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
          "n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends string")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns in order, as structs of digest and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"),
                    F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
                    F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, every: int = 20) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``every``, h from a checksum of c modulo 4."""
    first = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, 3).alias("__first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    x = lists.withColumns({"__h": h, "__base": F.col("conv_id") - F.col("conv_id") % every}).join(first, "__base", "left")
    own = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    borrowed = F.slice(F.coalesce("__first", F.slice("turns", 1, 0)), F.lit(1), F.col("__h"))
    return x.select("conv_id", F.concat(borrowed, own).alias("turns"))


class Tree:
    """A ternary search tree over rows of dictionary codes. Node 0 is the root of the trie; others have a turn, two siblings and a first child."""

    def __init__(self):
        self.code, self.less, self.more, self.down, self.up = [NIL], [NIL], [NIL], [NIL], [NIL]

    def insert(self, codes) -> list[int]:
        """The nodes of a row, from the root on, which are added where missing."""
        code, less, more, down = self.code, self.less, self.more, self.down
        here, met = 0, [0]
        for c in codes:
            links, at, node = down, here, down[here]
            while node != NIL and code[node] != c:
                links, at = (less if c < code[node] else more), node
                node = links[at]
            if node == NIL:
                node = len(code)
                code.append(c)
                for x in (less, more, down):
                    x.append(NIL)
                self.up.append(here)
                links[at] = node
            here = node
            met.append(node)
        return met

    def upwards(self) -> list[int]:
        """All nodes, each before its parent, by an explicit stack."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += [x for x in (self.less[node], self.more[node], self.down[node]) if x != NIL]
        depth = self.depths()
        out.sort(key=depth.__getitem__, reverse=True)
        return out

    def depths(self) -> list[int]:
        depth = [0] * len(self.code)
        for node in range(1, len(self.code)):  # a parent is older than its children
            depth[node] = depth[self.up[node]] + 1
        return depth


def medians_first(n: int) -> list[int]:
    """0 to n - 1, the middle of every range before the rest of it."""
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            out.append(mid)
            todo += [(mid + 1, b), (a, mid)]
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_nodes(rows: list[tuple[int, bytes, list[int]]]):
    """The nodes of one shard: rows (conv_id, path, words per turn) in order of path and id."""
    paths, ids, words = [], [], []
    for conv, path, w in rows:
        if not paths or paths[-1] != path:
            paths.append(path)
            ids.append([])
            words.append(w)
        ids[-1].append(conv)
    turns = np.frombuffer(b"".join(paths), f"V{DIGEST}")
    _, codes = np.unique(turns.view("S1").reshape(-1, DIGEST).view(f"V{DIGEST}").ravel(), return_inverse=True) if len(turns) else (None, np.zeros(0, np.int64))
    codes, cut = codes.tolist(), np.concatenate(([0], np.cumsum([len(p) // DIGEST for p in paths]))).tolist()
    tree, met = Tree(), [None] * len(paths)
    for k in medians_first(len(paths)):
        met[k] = tree.insert(codes[cut[k]:cut[k + 1]])
    n = len(tree.code)
    depth, up = tree.depths(), tree.up
    least, convs, kids, leaves, saved, last = [None] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    ends, key = {}, [b""] * n
    for nodes, own, path, w in zip(met, ids, paths, words):
        end = nodes[-1]
        ends[end], least[end], convs[end] = own, own[0], len(own)
        for d in range(len(nodes) - 1, 0, -1):  # ancestors that another path has set are set wholly
            if key[nodes[d]]:
                break
            last[nodes[d]] = w[d - 1]
            key[nodes[d]] = path[(d - 1) * DIGEST:d * DIGEST]
    for node in range(1, n):  # the key of a node covers its whole prefix; a parent is older than its children
        key[node] = hashlib.md5(key[up[node]] + key[node]).digest()
    edge = set(met[0]) | set(met[-1])
    for node in tree.upwards():  # children first
        inner = node not in edge
        if inner:
            leaves[node] = leaves[node] or 1
            saved[node] += (convs[node] - 1) * last[node]
        if node:
            above = up[node]
            convs[above] += convs[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
            if inner:
                kids[above] += 1
                leaves[above] += leaves[node]
                saved[above] += saved[node]
    for node in range(n):
        if node in edge:
            continue
        above = up[node]
        known = above not in edge
        yield (True, None, None if known else key[above], None, depth[node], least[node], least[above] if known else None, convs[node], kids[node], leaves[node], saved[node],
               last[node], sha(",".join(map(str, ends.get(node, ())))))
    first, last_path = met[0], met[-1]
    shared = next((d for d, (x, y) in enumerate(zip(first, last_path)) if x != y), min(len(first), len(last_path)))  # nodes on both paths
    for nodes, begin in ((first, 0), (last_path, shared)):
        for d, node in enumerate(nodes[begin:], begin):
            yield (False, key[node], key[up[node]] if node else None, [key[x] for x in nodes[:d + 1]], d, least[node], None, convs[node], kids[node], leaves[node], saved[node],
                   last[node], ",".join(map(str, ends[node])) if node in ends else None)


def shard_batches(batches, most: int = TURNS):
    """Cut a sorted range into shards and give their nodes."""
    schema = pa.schema([("whole", pa.bool_()), ("key", pa.binary()), ("parent", pa.binary()), ("ancestors", pa.list_(pa.binary())),
                        *[(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")], ("ends", pa.string())])

    def give(rows):
        made = []
        for row in shard_nodes(rows):
            made.append(row)
            if len(made) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    held, turns = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            size = len(row[1]) // DIGEST + 1
            if held and turns + size > most:
                yield from give(held)
                held, turns = [], 0
            held.append(row)
            turns += size
    if held:
        yield from give(held)


def digest_of_ends(batches):
    """Rows (key, first id, ids as text) in order to (key, digest of all ids joined by commas)."""
    key, running, out = None, None, []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["key", "sha"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key is not None and k == key:
                running.update(b",")
            else:
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            running.update(ids.encode())
        if len(out) >= 1000:
            yield packed()
            out = []
    if key is not None:
        out.append((key, running.hexdigest()))
    if out:
        yield packed()


def nodes(lists: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie over rows (conv_id, turns) with unique ids, as ``turn_lists`` gives them."""
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    dealt = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = checkpoint(dealt.mapInArrow(lambda batches: shard_batches(batches, turns), FIELDS))

    part = made.where("NOT whole")
    merged = part.groupBy("key").agg(*[F.first(c).alias(c) for c in ("parent", "ancestors", "depth", "words")], F.min("conv_id").alias("conv_id"),
                                     *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = checkpoint(merged)  # at most two paths per shard
    below = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("__kids"))
    own = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("__kids", F.lit(0)))
    gives = own.select(F.explode("ancestors").alias("key"), (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("l"),
                       (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("s"))
    sums = gives.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    texts = part.where("ends IS NOT NULL").withColumn("first", F.substring_index("ends", ",", 1).cast("long")).select("key", "first", "ends")
    shas = texts.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(digest_of_ends, "key binary, sha string")
    names = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("__parent_conv"))
    if merged.count() <= SENT:  # else Spark splits the children of a large node, the root's above all
        names = F.broadcast(names)
    edges = (own.drop("n_leaves", "saved_tokens").join(sums, "key").join(shas, "key", "left").join(names, "parent", "left")
             .select("conv_id", "depth", F.col("__parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                     F.coalesce("sha", F.lit(sha(""))).alias("ends_sha256")))
    columns = [*edges.columns[:-1], F.col("ends").alias("ends_sha256")]
    inner = made.where("whole AND parent IS NULL").select(*columns)
    hung = made.where("whole AND parent IS NOT NULL").drop("parent_conv_id").join(names, "parent").withColumnRenamed("__parent_conv", "parent_conv_id").select(*columns)
    return edges.unionByName(inner).unionByName(hung)
