"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles.

1. ``sketch``: document frequencies of all word shingles of all documents, in a
   count-min sketch of fixed size (8 MB however large the corpus). What a cell counts of other
   shingles is a fixed share of the number of documents; it is taken off.
2. ``signed``: a shingle weighs (1 + ln tf) * (1 + ``LIFT`` * min(1, ln(N / df) / ln(1 / ``RARE``))): the
   weight depends on the share of documents that hold it, and all shingles that less than the
   share ``RARE`` hold weigh the same, so a corpus ten times as large has the same weights.
   Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document;
   two documents agree in a sample with the probability of their weighted Jaccard
   similarity. Equal word sequences are one content from here on.
3. Each band of a signature is a bucket. Members of a bucket are compared with its
   smallest member, so that a bucket of any size costs a comparison per member,
   and a document has at most as many as there are bands.
4. Where a bucket still holds members of different components, they are dealt into blocks,
   and every two blocks meet in one task. From their signatures a task finds the members with a likely
   partner in another component; only these leave it, not the pairs. They come back with their
   texts, are compared exactly, all with one at a time by lists of shared shingles, and joined in
   a union-find of the task, which gives away only the links that joined something: no
   table has more rows than members and blocks, and no link is lost to that.
5. Every link is verified by the exact weighted Jaccard similarity of the
   whole texts (pairs whose signatures agree in far fewer samples than the
   threshold asks for are not compared). Connected components of the links
   are the classes, named by their smallest id.

Defined results: texts with fewer words than a shingle are one shingle; null,
empty and wordless texts are duplicates of nothing; rows that share an id are one
document in ``classes``, which joins the classes of its texts, while ``keep_one`` takes
each of its texts for itself; rows without an id get no class and are kept; exact copies
(equal lower-case words) always share a class; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..sources.tables import stage
from .common import slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
MARGIN = 0.2  # estimated similarity below SIMILAR - MARGIN: five deviations off, not read
WIDTH, DEPTH = 1 << 20, 2  # cells and rows of the document frequency sketch
RARE = 0.002  # share of documents below which all shingles weigh the same; several times what chance counts in a cell
LIFT = 0.5  # how much more a rare shingle weighs than one that all documents hold
SKETCH_BLOCKS = 64
MEMBERS = 2048  # members of a bucket in a block
BLOCK_BYTES = 32 << 20  # and bytes of their weighted shingles
COMPARED = 1 << 18  # pairs of signatures that are compared at once
SPREAD = 16  # partial sums of a sketch block

U = np.uint64
POWER, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def inverse(odd: np.uint64) -> np.uint64:
    """Inverse modulo 2^64."""
    x = int(odd)
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return U(y)


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """A random value per byte, and whether it belongs to a word: digits, small letters, all bytes beyond ASCII."""
    value = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return value, inside


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, POWER, np.uint64))
        down = np.cumprod(np.full(n, inverse(POWER), np.uint64))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lower-case text, all at once from running sums."""
    value, inside = letters()
    data = np.frombuffer(raw, np.uint8)
    word = inside[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = 1 << 12
    while size < len(data):
        size <<= 1
    up, down = powers(size)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[data] * up[:len(data)])))
    return mixed((run[end] - run[begin]) * down[begin])


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct shingle hashes, how often each occurs, and a digest of the word sequence (empty without words)."""
    words = word_hashes(text.lower().encode()) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words, np.zeros(0, np.int64), b""
    n = max(len(words) - size + 1, 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        total = total * STEP + words[k:k + n]
    return *np.unique(mixed(total), return_counts=True), hashlib.md5(words.tobytes()).digest()


def shingle_hashes(texts: pa.Array) -> list[np.ndarray]:
    return [shingles(t)[0] for t in texts.to_pylist()]


def cells(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> U(20 * d)) & U(WIDTH - 1)).astype(np.intp) for d in range(DEPTH)]


def sketch(docs: DataFrame, text: str = "text", sets=None) -> tuple[np.ndarray, int]:
    """Document frequencies of the shingles of all texts, and the number of documents with words.

    ``sets(texts)`` gives the distinct shingle hashes of every text of an Arrow array, those of this module by default.
    """
    block = WIDTH * DEPTH // SKETCH_BLOCKS

    def count(batches):
        table, n = np.zeros((DEPTH, WIDTH), np.uint32), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [h for h in (sets or shingle_hashes)(piece.column("text")) if len(h)]
                if found:
                    n += len(found)
                    for row, at in zip(table, cells(np.concatenate(found))):
                        row += np.bincount(at, minlength=WIDTH).astype(np.uint32)
        if n:
            salt = int(hash((n, int(table[0, 0]), int(table[:, :64].sum()))) % SPREAD)
            flat = table.ravel().astype(np.uint64)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([*range(SKETCH_BLOCKS), -1], pa.int32()), "salt": pa.array([salt] * (SKETCH_BLOCKS + 1), pa.int32()),
                "counts": pa.array([pack(flat[i * block:(i + 1) * block]) for i in range(SKETCH_BLOCKS)] + [pack(np.array([n], np.uint64))], pa.binary())})

    def add(batches):
        """Sums per block (and salt), one array of fixed size for each block met."""
        sums: dict = {}
        for batch in batches:
            for b, s, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = unpack(c)
                sums[b, s] = sums[b, s] + got if (b, s) in sums else got
        for (b, s), v in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "salt": pa.array([s], pa.int32()), "counts": pa.array([pack(v)], pa.binary())})

    fields = "block int, salt int, counts binary"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, fields).repartition(parts, "block", "salt").mapInArrow(add, fields)
    whole = first.repartition(min(parts, SKETCH_BLOCKS), "block").select("block", F.lit(0).alias("salt"), "counts").mapInArrow(add, fields)
    table, n = np.zeros(WIDTH * DEPTH, np.uint64), 0
    for r in whole.collect():  # 64 blocks of fixed size
        if r.block < 0:
            n = int(unpack(r.counts)[0])
        else:
            table[r.block * block:(r.block + 1) * block] = unpack(r.counts)
    return table.reshape(DEPTH, WIDTH), n


def pack(counts: np.ndarray) -> bytes:
    """Counts in the smallest width that holds them, which the first byte names, compressed: most cells of one task's sketch are zero."""
    size = next(s for s in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * s))
    return bytes([size]) + zlib.compress(counts.astype(f"<u{size}").tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.uint64)


class Weights:
    """Weights of shingles by the share of documents that hold them."""

    def __init__(self, table: np.ndarray, documents: int):
        width = np.uint32 if table.max(initial=0) < 1 << 32 else np.uint64
        self.table, self.documents = table.astype(width), max(documents, 1)
        self.noise = float(table.sum()) / table.size  # what a cell counts of other shingles

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = cells(hashes)
        df = np.minimum(*(row[i] for row, i in zip(self.table, at))) - self.noise
        share = np.clip(df / self.documents, RARE, 1.0)
        return (1 + np.log(counts)) * (1 + LIFT * np.log(share) / np.log(RARE))


TABLE = 1 << 12


@cache
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random variates by 12 bits of a hash and sample: r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), b ~ U(0, 1)."""
    random = np.random.default_rng(7)
    shape = (TABLE, SAMPLES)
    return (random.gamma(2.0, 1.0, shape).astype(np.float32), np.log(random.gamma(2.0, 1.0, shape)).astype(np.float32),
            random.random(shape).astype(np.float32))


def signature(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 32-bit value per sample; equal values mean the same shingle and level were drawn.

    Each variate of a shingle comes from its own bits of the hash, and the value from all of them.
    """
    r_of, c_of, b_of = variates()
    least = np.full(SAMPLES, np.inf, np.float32)
    drawn, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    log = np.log(weights).astype(np.float32)[:, None]
    everyone = np.arange(SAMPLES)
    for at in range(0, len(hashes), 512):
        h = hashes[at:at + 512]
        r, b = r_of[(h & U(TABLE - 1)).astype(np.intp)], b_of[((h >> U(12)) & U(TABLE - 1)).astype(np.intp)]
        t = np.floor(log[at:at + 512] / r + b)
        a = c_of[((h >> U(24)) & U(TABLE - 1)).astype(np.intp)]
        a -= r * (t - b + 1)  # ln c - ln y - r, with ln y = r (t - b)
        i = a.argmin(axis=0)
        found = a[i, everyone]
        lower = found < least
        least[lower], drawn[lower], level[lower] = found[lower], h[i[lower]], t[i[lower], everyone[lower]]
    return (mixed(drawn ^ (level.astype(np.int64).astype(np.uint64) * STEP)) >> U(32)).astype(np.uint32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole else 0.0


def signed(docs: DataFrame, weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, content, size, sig, few) for every row with an id; ``size`` counts shingles, ``few`` is the lowest byte of each sample.

    The content of a text without words is empty. Signatures are given once per content and task.
    """
    def run(batches):
        w, seen = weights.value, set()
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for i, t in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist()):
                    hashes, counts, content = shingles(t)
                    fresh = bool(content) and content not in seen
                    if fresh:
                        if len(seen) >= 1 << 17:
                            seen.clear()
                        seen.add(content)
                    sig = signature(hashes, w.of(hashes, counts)) if fresh else None
                    out.append((i, content, len(hashes), sig.tobytes() if fresh else None, sig.astype(np.uint8).tobytes() if fresh else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 2))],
                                                     names=["id", "content", "size", "sig", "few"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, content binary, size long, sig binary, few binary")


def digested(docs: DataFrame, text: str) -> DataFrame:
    """Append the digest of the words as ``__content``."""
    return docs.withColumn("__content", F.udf(lambda t: shingles(t)[2], "binary")(F.col(text).cast("string")))


def verified(pairs: DataFrame, texts: DataFrame, weights, similar: float = SIMILAR) -> DataFrame:
    """The pairs (u, v) whose texts, given as (id, text), are similar enough, each compared once."""
    left = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")

    def run(batches):
        w, last = weights.value, (None, None)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                b = b.as_py()
                if last[0] != b:  # pairs of one leader come one after another
                    last = (b, vector(b, w))
                keep.append(similarity(vector(a.as_py(), w), last[1]) >= similar)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long").distinct()


def vector(text: str, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts, _ = shingles(text)
    return hashes, w.of(hashes, counts)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that is connected with each end of an edge, by alternating large and small stars.

    Every step sends an edge to a smallest neighbour, found by a pre-aggregated
    minimum; no list of neighbours is gathered.
    """
    e = checkpoint(edges.select("u", "v").where("u <> v"))
    few = max(1, e.count() >> 18)  # partitions: a step's tables are never larger than the edges, and mostly small
    while True:
        e = e.coalesce(few)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few).distinct().coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = checkpoint(small.select("x.u", "x.v").where("u <> v").coalesce(few).distinct()).coalesce(few)
        # done when every end has one edge, to one that has none
        if new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        e = new


def with_comp(rows: DataFrame, comp: DataFrame, column: str, name: str) -> DataFrame:
    """Append the component of an id; an id without links is its own."""
    found = comp.select(F.col("id").alias(column), F.col("comp").alias("__c"))
    return rows.join(found, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")


def searched(docs: DataFrame, doc_id: str, text: str, similar: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``signed`` gives; contents (content, id, rep) with their smallest id and a number of their own;
    verified links (u, v) between those numbers; ids of several rows, with ``mixed`` where their contents differ."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(Weights(*sketch(docs, text)))
    signs = checkpoint(signed(docs, weights, doc_id, text))
    # one number stands for all with the same words; an id would not do, as it can have several texts
    first = checkpoint(signs.where("length(content) > 0").groupBy("content").agg(F.min("id").alias("id")).withColumn("rep", F.monotonically_increasing_id()))
    repeated = checkpoint(signs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
                          .where("n > 1").select("id", F.expr("lo <> hi").alias("mixed")))
    sigs = checkpoint(signs.where(F.col("sig").isNotNull()).join(first.select("content", "rep"), "content")
                      .groupBy("rep").agg(*[F.first(c).alias(c) for c in ("size", "sig", "few")]))
    bands = sigs.select("rep", F.posexplode(F.array(*[
        F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * ROWS * k, 4 * ROWS)) for k in range(BANDS)])).alias("band", "key"))
    leaders = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("__max")).where("leader <> __max").select("key", "leader")
    buckets = checkpoint(bands.join(leaders, "key").select("key", "band", "rep", "leader"))  # buckets of two or more

    # only texts that share a bucket with another one are ever compared, each read from one row
    met = buckets.select(F.explode(F.array("rep", "leader")).alias("rep")).distinct().join(first, "rep").select("rep", "id", "content")
    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = given.join(met.join(repeated, "id", "left_anti").select("id", "rep"), "id").select(F.col("rep").alias("id"), "text")
    if not repeated.isEmpty():
        rows = digested(given.join(repeated, "id", "left_semi"), "text").withColumnRenamed("__content", "content").dropDuplicates(["id", "content"])
        found = found.unionByName(rows.join(met, ["id", "content"]).select(F.col("rep").alias("id"), "text"))
    texts = stage(found, "texts")

    tried = checkpoint(likely(buckets.where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")).distinct(), sigs, similar))
    links = checkpoint(verified(tried, texts, weights, similar))
    links = links.unionByName(checkpoint(across(buckets, components(links), sigs, texts, weights, similar)))
    return signs, first, links, repeated


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Rows (id, class_id) for every id: the smallest id of the texts that are linked with it."""
    signs, first, links, repeated = searched(docs, doc_id, text, similar)
    several = repeated.where("mixed")
    if not several.isEmpty():  # the texts of an id belong together
        own = signs.join(several, "id").select("id", "content").distinct().join(first.select("content", "rep"), "content")
        links = links.unionByName(own.join(own.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v"))
    reps = with_comp(first, components(links), "rep", "comp")
    names = reps.groupBy("comp").agg(F.min("id").alias("class_id"))
    found = signs.join(reps.join(names, "comp").select("content", "class_id"), "content").groupBy("id").agg(F.min("class_id").alias("class_id"))
    return signs.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def likely(pairs: DataFrame, sigs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs whose signatures agree in a share of samples that a pair at the threshold does not fall short of."""
    both = (pairs.join(sigs.select(F.col("rep").alias("u"), F.col("few").alias("a")), "u")
            .join(sigs.select(F.col("rep").alias("v"), F.col("few").alias("b")), "v"))

    def run(batches):
        for batch in batches:
            a, b = (np.array([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()]).reshape(-1, SAMPLES) for c in "ab")
            yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= similar - MARGIN))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def across(buckets: DataFrame, comp: DataFrame, sigs: DataFrame, texts: DataFrame, weights, similar: float = SIMILAR) -> DataFrame:
    """Links (u, v) that join components among the members (key, rep) of buckets, at most one per member and task."""
    def dealt(rows):
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    met = checkpoint(dealt(blocks(buckets, comp, sigs)).mapInArrow(lambda batches: with_partner(batches, similar), "key long, i int, j int, band int, comp long, rep long, block int"))
    whole = (met.join(sigs.select("rep", "sig"), "rep").join(texts.select(F.col("id").alias("rep"), "text"), "rep")
             .select("key", "i", "j", "band", "comp", "rep", "block", "sig", "text"))
    return dealt(whole).mapInArrow(lambda batches: joining_links(batches, weights.value, similar), "u long, v long")


def blocks(buckets: DataFrame, comp: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members (key, i, j, band, comp, rep, block, few) of buckets with several components, once for every pair (i, j) of blocks that theirs is in."""
    here = with_comp(buckets.select("key", "band", "rep"), comp, "rep", "comp").join(sigs.select("rep", "size"), "rep")
    sizes = (here.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
             .select("key", F.ceil(F.greatest(F.col("n") / MEMBERS, 16 * F.col("size") / BLOCK_BYTES)).cast("int").alias("parts")))
    return (here.select("key", "band", "comp", "rep").join(sizes, "key")
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "comp", "rep", "block")
            .join(sigs.select("rep", "few"), "rep").select("key", "i", "j", "band", "comp", "rep", "block", "few"))


def gathered(batches):
    """Tables of the rows with one (key, i, j), from sorted batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(3)]
        cuts = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in now], axis=0)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if held and any(held[-1].column(n)[0] != batch.column(n)[at] for n in range(3)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def with_partner(batches, similar: float):
    """Of every pair of blocks the members whose signature is like one of another component (of the other block, if there are two)."""
    for t in gathered(batches):
        t = t.sort_by("comp")  # members of one component are not compared
        comp, block = (t.column(c).to_numpy() for c in ("comp", "block"))
        few = np.frombuffer(b"".join(t.column("few").to_pylist()), np.uint8).reshape(-1, SAMPLES)
        one = t.column("i")[0] == t.column("j")[0]
        found = np.zeros(len(comp), bool)
        at = 0
        while at < len(comp):
            after = int(np.searchsorted(comp, comp[at], side="right"))
            if after == len(comp):
                break
            end = at + max(1, COMPARED // (len(comp) - after))
            mine, theirs = slice(at, end), slice(after, None)
            alike = (comp[mine, None] < comp[None, theirs]) & ((few[mine, None] == few[None, theirs]).mean(axis=2) >= similar - MARGIN)
            if not one:
                alike &= block[mine, None] != block[None, theirs]
            found[mine] |= alike.any(axis=1)
            found[theirs] |= alike.any(axis=0)
            at = end
        if found.any():
            yield from t.filter(pa.array(found)).drop_columns(["few"]).combine_chunks().to_batches()


def joining_links(batches, w: Weights, similar: float):
    """Of every pair of blocks of texts the links (u, v), u > v, that join components."""
    for t in gathered(batches):
        comp, rep, block = (t.column(c).to_numpy() for c in ("comp", "rep", "block"))
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, BANDS, ROWS)
        one = t.column("i")[0] == t.column("j")[0]
        links = spanning([vector(x, w) for x in t.column("text").to_pylist()], sigs, t.column("band")[0].as_py(), comp, None if one else block, similar)
        if links:
            ends = rep[np.array(links)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], names=["u", "v"])


def spanning(vectors, sigs: np.ndarray, band: int, comp: np.ndarray, block: np.ndarray | None, similar: float) -> list[tuple[int, int]]:
    """Pairs of members that are similar enough and join components, given those joined before.

    Two members that meet in several buckets are compared in that of their first common band.
    The similarity of one member to all others comes from lists of the members that hold a shingle; shingles of one member are in no list.
    """
    size = np.array([len(h) for h, _ in vectors])
    of, weight = np.repeat(np.arange(len(vectors)), size), np.concatenate([x for _, x in vectors])
    _, code, held = np.unique(np.concatenate([h for h, _ in vectors]), return_inverse=True, return_counts=True)
    total = np.array([x.sum() for _, x in vectors])
    shared = held[code] > 1
    of, weight, code = of[shared], weight[shared], code[shared]
    by_code = np.argsort(code, kind="stable")
    begin, holder, held_weight = np.searchsorted(code[by_code], np.arange(len(held))), of[by_code], weight[by_code]
    mine = np.searchsorted(of, np.arange(len(vectors) + 1))
    up = {int(c): int(c) for c in comp}

    def top(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for x in range(len(vectors) - 1):
        equal = sigs[x + 1:] == sigs[x]
        likely = (equal.mean(axis=(1, 2)) >= similar - MARGIN) & (equal.all(axis=2).argmax(axis=1) == band)
        if block is not None:
            likely &= block[x + 1:] != block[x]
        likely[likely] = [top(int(c)) != top(int(comp[x])) for c in comp[x + 1:][likely]]
        if not likely.any():
            continue
        lists = code[mine[x]:mine[x + 1]]
        n = held[lists]
        at = np.repeat(begin[lists] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(holder[at], np.minimum(held_weight[at], np.repeat(weight[mine[x]:mine[x + 1]], n)), minlength=len(vectors))[x + 1:]
        for y in np.flatnonzero(likely & (common >= similar * (total[x] + total[x + 1:] - common))):
            a, b = top(int(comp[x])), top(int(comp[x + 1 + y]))
            if a != b:
                up[a] = b
                out.append((x, x + 1 + int(y)))
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Of every group of linked texts the one with the smallest id, all texts without words, and rows without an id.

    Rows count here, not ids: an id with different texts loses only those that another kept row stands for.
    """
    signs, first, links, repeated = searched(docs, doc_id, text, similar)
    best = with_comp(first, components(links), "rep", "comp").groupBy("comp").agg(F.min(F.struct("id", "content")).alias("x")).select("x.id", "x.content")
    keep = checkpoint(best.unionByName(signs.where("length(content) = 0").select("id", "content").distinct()).toDF("__keep", "__words"))
    twice = repeated.select(F.col("id").alias("__twice"))
    who = F.col(doc_id).cast("long")
    out = docs.join(keep.join(twice, F.col("__keep") == F.col("__twice"), "left_anti"), who == F.col("__keep"), "left_semi")
    if not repeated.isEmpty():
        rows = digested(docs.join(twice, who == F.col("__twice"), "left_semi"), text)
        out = out.unionByName(rows.join(keep, (who == F.col("__keep")) & (F.col("__content") == F.col("__words")), "left_semi").drop("__content"))
    return out.unionByName(docs.where(F.col(doc_id).isNull()))
