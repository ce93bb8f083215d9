"""Exact Jaccard join of word shingle sets, size-aware: subsets for small sets, inverted lists for large ones.

Two documents link when 100 * |A and B| >= 85 * |A or B|. The result is the components
of these links; no link between different sets is lost.

1. ``sets_of``: every text becomes its set of 64-bit shingle hashes, named by a 64-bit digest,
   so that copies are one set. Shingles are ranked by an estimate of how many documents hold
   them (a sketch of fixed size, ``neardup.sketch``), rare ones first, then by hash. The
   estimate only decides what is cheap, never what is found.
2. Small sets, of at most ``boundary`` shingles, give all their subsets of the sizes in which
   two of them must overlap: sharing one is overlapping that much. Large sets give
   the first n - ceil(0.85 n) + 1 shingles in rank, one of which linked sets share
   (a small set that could be linked with a large one gives these too). The boundary
   is the size at which subsets given and list entries scanned are fewest in sum,
   counted over all small sets of the corpus.
3. Keys that two sets share make lists; lists with the same members are one list. Two
   members of a list may link only if their sizes are near enough and, as no shingle before
   the first shared one is shared, if enough shingles follow it in both: so a pair counts in a list
   only if sizes and positions allow it. Each member is compared with the list's smallest one,
   which costs a pair per entry.
4. All other pairs of a list stay inside tasks. Members are dealt into blocks, and every two blocks meet in
   one task, which gives away only members that have a possible partner. This is done
   with sizes and positions; then with the first shingles, where each that only one side has
   is a difference; then, for members of different components, with parity rows of about
   a byte per shingle, whose differing bits are a lower bound of differing shingles; and what is
   left brings its whole sets. The last step compares exactly, skips what its own
   union-find has joined, and gives away only links that joined something, at most one
   per member. So no table grows with the square of a group.
5. Whole sets are only made of documents that are still in question, which tasks know by a bit table of
   bounded size (``MOST_BITS``); documents that it lets through in vain go in a join.

Defined results: null, empty and wordless texts have an empty set, which is linked with
nothing, and are their own component; a text of fewer words than a shingle is one shingle; repeated rows and
rows that repeat an id are documents of their own; a null id takes part, but never names a
component that has other ids; an empty table gives no rows; of the input only id and text
are read. Sets are compared by 64-bit hashes of shingles and named by 64-bit digests: two
different ones get one name with probability 2^-64 per pair.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..sources.tables import stage
from .common import mixed, quoted, slices, tokenized
from .neardup import cells, components, sketch, with_comp

SHINGLE = 4
SHARE = 85  # hundredths
SMALL = 20  # sets of more shingles are never enumerated
BLOCK = 2048  # members in a block
BLOCK_BYTES = 16 << 20  # and bytes of their parity rows
LEAST_BITS, MOST_BITS = 20, 28  # powers of two of bits in a table of keys or ids

U = np.uint64
STEP = U(0xD6E8FEB86659FD93)


def needed(a: int, b: int, share: int = SHARE) -> int:
    """Smallest overlap at which sets of these sizes link."""
    return -(-share * (a + b) // (100 + share))


def prefix(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // 100) + 1


@cache
def subset_sizes(n: int, boundary: int, share: int = SHARE) -> tuple[int, ...]:
    """Overlaps that a set of n shingles needs with partners of at most ``boundary``."""
    partners = [m for m in range(1, boundary + 1) if 100 * min(n, m) >= share * max(n, m)]
    return tuple(sorted({needed(n, m, share) for m in partners}))


@cache
def chosen(n: int, size: int) -> np.ndarray:
    """All subsets of ``size`` of n positions, one row each, as a 0/1 matrix."""
    rows = list(combinations(range(n), n - size))
    out = np.ones((len(rows), n), U)
    for row, gone in zip(out, rows):
        row[list(gone)] = 0
    return out


def subset_keys(hashes: np.ndarray, boundary: int, share: int = SHARE) -> np.ndarray:
    """Keys of the subsets of a small set; the order of its hashes does not matter."""
    each = mixed(hashes + STEP)
    return np.concatenate([mixed((chosen(len(hashes), c) * each).sum(axis=1, dtype=U) ^ U(c)) for c in subset_sizes(len(hashes), boundary, share)])


@cache
def n_keys(n: int, boundary: int, share: int = SHARE) -> int:
    return sum(len(chosen(n, c)) for c in subset_sizes(n, boundary, share))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, bounds = tokenized(texts, fold=True)
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], U)
    one = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, U)
    rounds, total = [], np.zeros(len(one), U)
    for k in range(SHINGLE):
        total = mixed(total[:len(one) - k] * STEP + one[k:])
        rounds.append(total)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        size = min(b - a, SHINGLE)
        out.append(np.unique(rounds[size - 1][a:b - size + 1]) if size else one[:0])
    return out


def named(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


class Ranks:
    """How many documents hold a shingle, from the sketch."""

    def __init__(self, table: np.ndarray):
        self.table = np.minimum(table, (1 << 32) - 1).astype(np.uint32)
        self.noise = float(table.sum()) / max(table.size, 1)  # what a cell counts of other shingles

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(*(row[i] for row, i in zip(self.table, cells(hashes))))

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """A bounded estimate, then the hash, shortened. With the hash behind it this orders all shingles."""
        return (np.minimum(self.of(hashes), (1 << 20) - 1).astype(U) << U(44)) | (hashes >> U(20))

    def first(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The n first of sorted shingles in rank."""
        return hashes[np.argsort(self.rank(hashes), kind="stable")[:n]]


def each_set(batch: pa.RecordBatch):
    """(id, set) of the rows of a batch (id, text)."""
    for piece in slices(batch, "text"):
        yield from zip(piece.column("id").to_pylist(), shingle_sets(piece.column("text")))


def sets_of(given: DataFrame, ranks, share: int) -> DataFrame:
    """Rows (id, n, rep, first, scans) for every row (id, text): size and name of its set, once per task and set its
    first shingles in rank (of small sets: all), and what scanning their lists would cost."""
    def run(batches):
        r, seen = ranks.value, set()
        for batch in batches:
            out = []
            for i, s in each_set(batch):
                rep = named(s) if len(s) else None
                fresh = rep is not None and rep not in seen
                if fresh:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(rep)
                first = r.first(s, prefix(len(s), share) if len(s) > SMALL else len(s)) if fresh else None
                scans = float(np.maximum(r.of(first[:prefix(len(s), share)]) - r.noise, 0).sum()) if fresh and len(s) <= SMALL else None
                out.append((i, len(s), rep, first.tobytes() if fresh else None, scans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64()))],
                                                 names=["id", "n", "rep", "first", "scans"])

    return given.mapInArrow(run, "id long, n long, rep long, first binary, scans double")


def cheapest(costs: dict[int, tuple[int, float]], share: int = SHARE) -> int:
    """The boundary (0: no set is small) at which keys of subsets and scanned list entries are fewest. ``costs``: sets and scans by size."""
    def cost(x):
        enumerated = sum(c * n_keys(n, x, share) for n, (c, _) in costs.items() if n <= x)
        return enumerated + sum(c * prefix(n, share) + s for n, (c, s) in costs.items() if 100 * n >= share * (x + 1))

    return min(range(SMALL + 1), key=lambda x: (cost(x), x))


def keys_of(sets: DataFrame, boundary: int, share: int, known=None) -> DataFrame:
    """Rows (key, rep, n, pos): keys under which a set can meet those linked with it, and how many of its shingles come
    before; with ``known`` only those in this bit table."""
    def run(batches):
        bits = known.value if known is not None else None
        for batch in batches:
            keys, places, reps, sizes = [], [], [], []
            for rep, n, first in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first = np.frombuffer(first, U)
                parts = []
                if n <= boundary:  # what shares a subset overlaps enough, wherever
                    subsets = subset_keys(first, boundary, share)
                    parts.append((subsets, np.zeros(len(subsets), np.int32)))
                if 100 * n >= share * (boundary + 1):
                    parts.append((first[:prefix(n, share)], np.arange(prefix(n, share), dtype=np.int32)))
                for k, pos in parts:
                    if bits is not None:
                        near = inside(bits, k)
                        k, pos = k[near], pos[near]
                    keys.append(k)
                    places.append(pos)
                    reps.append(np.full(len(k), rep, np.int64))
                    sizes.append(np.full(len(k), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ([k.view(np.int64) for k in keys], reps, sizes, places)], names=["key", "rep", "n", "pos"])

    return sets.where(F.col("first").isNotNull()).select("rep", "n", "first").mapInArrow(run, "key long, rep long, n long, pos int")


def may_link(n, pos, m, other, share: int):
    """Whether sets of n and m shingles that share one, with so many before it, and none of these, can link. Of numbers, arrays or columns."""
    least = F.least if hasattr(n, "alias") else np.minimum
    most = F.greatest if hasattr(n, "alias") else np.maximum
    enough = (100 + share) * least(n - pos, m - other) >= share * (n + m)
    return (100 * least(n, m) >= share * most(n, m)) & enough


def bit_table(numbers: DataFrame, column: str) -> np.ndarray:
    """A table with the bit of every number's low digits set, a few bits per number but never more than 2^MOST_BITS (32 MB)."""
    power = min(max(LEAST_BITS, (8 * numbers.count()).bit_length()), MOST_BITS)
    at = F.col(column).bitwiseAND(F.lit((1 << power) - 1))
    rows = (numbers.select(F.shiftright(at, 6).cast("int").alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("w")
            .agg(F.expr("bit_or(shiftleft(1L, b))").alias("x")))
    table, found = np.zeros(1 << (power - 6), U), rows.toArrow()
    table[found.column("w").to_numpy()] = found.column("x").to_numpy().view(U)
    return table


def inside(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers.view(U) & U(64 * len(table) - 1)
    return (table[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) > 0


def parity(s: np.ndarray) -> np.ndarray:
    """One bit per cell, whether an odd number of shingles fall there: four to eight cells per shingle, a power of two."""
    width = 4 << max(int(len(s) - 1).bit_length(), 3)
    odd = np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(row: np.ndarray, size: int) -> np.ndarray:
    """A parity row with fewer cells, which are sums of the old ones modulo two."""
    while len(row) > size:
        row = row[:len(row) // 2] ^ row[len(row) // 2:]
    return row


def can_differ(a, b, share: int = SHARE):
    """In how many shingles at most linked sets of these sizes differ."""
    return a + b - 2 * (-(-share * (a + b) // (100 + share)))


def whole_sets(given: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (rep, n, odd, set) of the named sets, made again from the texts of documents that have them."""
    spark = given.sparkSession
    # one id stands for a set; its rows with other texts go in the join
    ids = sets.join(wanted, "rep", "left_semi").groupBy("rep").agg(F.min(F.coalesce("id", F.lit(0))).alias("id"))
    bits = spark.sparkContext.broadcast(bit_table(ids, "id"))

    def run(batches):
        known, seen = bits.value, set()
        for batch in batches:
            near = inside(known, np.array([i or 0 for i in batch.column("id").to_pylist()], np.int64))
            rows = batch.filter(pa.array(near))
            for piece in slices(rows, "text"):
                out = []
                for s in shingle_sets(piece.column("text")):
                    rep = named(s) if len(s) else None
                    if rep is not None and rep not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add(rep)
                        out.append((rep, len(s), parity(s).tobytes(), s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["rep", "n", "odd", "set"])

    made = given.mapInArrow(run, "rep long, n long, odd binary, set binary").join(wanted, "rep", "left_semi")
    return stage(made.groupBy("rep").agg(F.first(F.struct("n", "odd", "set")).alias("x")).select("rep", "x.*"), "sets")


def near(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) that parity rows do not rule out."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.struct("n", "odd").alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist()):
                x, y = (np.frombuffer(z["odd"], np.uint8) for z in (a, b))
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= can_differ(a["n"], b["n"], share))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) that link."""
    def run(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(a, U), np.frombuffer(b, U), share) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("rep").alias("u"), F.col("set").alias("a")), "u")
    return left.join(sets.select(F.col("rep").alias("v"), F.col("set").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def groups(batches, keys: int):
    """Rows with the same first ``keys`` columns, gathered from sorted batches; a group is one pair of blocks."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in now], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and any(held[-1].column(n)[0] != batch.column(n)[a] for n in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def sized_pairs(n: np.ndarray, pos: np.ndarray, block: np.ndarray, one: bool, share: int):
    """(x, all y that sizes and positions allow), x before y in order of size, of different blocks unless it is ``one``."""
    order = np.argsort(n, kind="stable")
    sizes, places, blocks = n[order], pos[order], block[order]
    for i, x in enumerate(order[:-1]):
        end = np.searchsorted(sizes, 100 * sizes[i] // share, side="right")
        ok = may_link(sizes[i], places[i], sizes[i + 1:end], places[i + 1:end], share)
        if not one:
            ok &= blocks[i + 1:end] != blocks[i]
        if ok.any():
            yield x, order[i + 1:end][ok]


def paired(batches, pairs_of):
    """Of every pair of blocks the members that are in a pair (x, all y)."""
    for t in groups(batches, 3):
        found = np.zeros(t.num_rows, bool)
        for x, y in pairs_of(t, t.column("i")[0] == t.column("j")[0]):
            if len(y):
                found[x], found[y] = True, True
        if found.any():
            yield from t.select(["key", "i", "j", "rep", "block", "n", "pos"]).filter(pa.array(found)).combine_chunks().to_batches()


def sized(t: pa.Table, one: bool, share: int):
    return sized_pairs(*(t.column(c).to_numpy() for c in ("n", "pos", "block")), one, share)


def sharing_first(t: pa.Table, one: bool, share: int, ranks: Ranks):
    """Of the pairs that sizes allow those whose first shingles do not differ too much already.

    A shingle among the first of one set, and not beyond the last of the first of the other, is in both lists or not in both sets.
    """
    firsts = [np.frombuffer(f, U) for f in t.column("first").to_pylist()]
    n = t.column("n").to_numpy()
    firsts = [f[:prefix(int(k), share)] for f, k in zip(firsts, n)]
    every, code = np.unique(np.concatenate(firsts), return_inverse=True)
    order = np.empty(len(every), np.int64)
    order[np.lexsort((every, ranks.rank(every)))] = np.arange(len(every))
    code = order[code]  # numbers in the order of ranks
    size = np.array([len(f) for f in firsts])
    begin = np.concatenate(([0], np.cumsum(size)))
    of, by_code = np.repeat(np.arange(len(size)), size), np.argsort(code, kind="stable")
    held = np.bincount(code, minlength=len(every))
    at_code = np.concatenate(([0], np.cumsum(held)))
    last = code[begin[1:] - 1]
    for x, y in sized(t, one, share):
        mine = code[begin[x]:begin[x + 1]]
        count = held[mine]
        at = np.repeat(at_code[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        common = np.bincount(of[by_code[at]], minlength=len(size))[y]
        theirs = np.add.reduceat(code <= last[x], begin[:-1])[y]
        apart = np.searchsorted(mine, last[y], side="right") + theirs - 2 * common
        yield x, y[apart <= can_differ(n[x], n[y], share)]


def close_pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, block: np.ndarray, odd: list[np.ndarray], one: bool, share: int):
    """Of the pairs that sizes allow those of different components that parity rows do not rule out."""
    tables: dict = {}
    for size in sorted({len(o) for o in odd}):
        # partners have this width, or the next one, which folds to it
        at = np.flatnonzero([len(o) in (size, 2 * size) for o in odd])
        tables[size] = (np.searchsorted(at, np.arange(len(odd))), np.stack([folded(odd[k], size) for k in at]))
    for x, y in sized_pairs(n, pos, block, one, share):
        y = y[comp[y] != comp[x]]
        if len(y):
            place, rows = tables[len(odd[x])]
            apart = np.bitwise_count(rows[place[y]] ^ odd[x]).sum(axis=1, dtype=np.int64)
            yield x, y[apart <= can_differ(n[x], n[y], share)]


def unlike(t: pa.Table, one: bool, share: int):
    odd = [np.frombuffer(o, np.uint8) for o in t.column("odd").to_pylist()]
    return close_pairs(*(t.column(c).to_numpy() for c in ("n", "pos", "comp", "block")), odd, one, share)


def joining_links(batches, share: int):
    """Of each pair of blocks of whole sets, links (u, v) that join components, found with a local union-find."""
    for t in groups(batches, 3):
        comp, rep, block, pos = (t.column(c).to_numpy() for c in ("comp", "rep", "block", "pos"))
        sets = [np.frombuffer(s, U) for s in t.column("set").to_pylist()]
        n, up, out = np.array([len(s) for s in sets]), {}, []

        def top(c):
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        for x, several in close_pairs(n, pos, comp, block, [parity(s) for s in sets], t.column("i")[0] == t.column("j")[0], share):
            for y in several:
                a, b = top(int(comp[x])), top(int(comp[y]))
                if a != b and linked(sets[x], sets[y], share):
                    up[a] = b
                    out.append((int(rep[x]), int(rep[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])


MEMBER = "key long, i int, j int, rep long, block int, n long, pos int"


def in_blocks(rows: DataFrame) -> DataFrame:
    """Deal rows so that those of a pair of blocks come one after another in one task."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def dealt(lists: DataFrame) -> DataFrame:
    """Members (key, i, j, rep, block, n, pos) of lists, once for every pair (i, j) of blocks that theirs is in."""
    sizes = lists.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, 2 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("parts"))
    return (lists.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "n", "pos"))


def possible(lists: DataFrame, firsts: DataFrame, ranks, share: int) -> DataFrame:
    """Members of lists that sizes, positions and first shingles allow to link with another one."""
    near = checkpoint(in_blocks(dealt(lists)).mapInArrow(lambda batches: paired(batches, lambda t, one: sized(t, one, share)), MEMBER))
    return checkpoint(in_blocks(near.join(firsts, "rep").select(*near.columns, "first")).mapInArrow(
        lambda batches: paired(batches, lambda t, one: sharing_first(t, one, share, ranks.value)), MEMBER))


def across(met: DataFrame, comp: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (u, v) that join components among members that may link."""
    here = with_comp(met, comp, "rep", "comp")
    several = here.groupBy("key", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "i", "j")
    rows = here.join(several, ["key", "i", "j"], "left_semi").join(sets.select("rep", "odd"), "rep").select(*met.columns, "comp", "odd")
    close = checkpoint(in_blocks(rows).mapInArrow(lambda batches: paired(batches, lambda t, one: unlike(t, one, share)), MEMBER))
    whole = with_comp(close, comp, "rep", "comp").join(sets.select("rep", "set"), "rep").select(*close.columns, "comp", "set")
    return in_blocks(whole).mapInArrow(lambda batches: joining_links(batches, share), "u long, v long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """Rows (id, n_shingles, component_id), one per row of ``docs``: the smallest id reachable by links of at least ``share`` hundredths."""
    spark = docs.sparkSession
    given = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    table, _ = sketch(given, "text", shingle_sets)
    ranks = spark.sparkContext.broadcast(Ranks(table))
    sets = checkpoint(sets_of(given, ranks, share))
    costs = {r.n: (r.c, r.s) for r in sets.where(f"n <= {SMALL} AND scans IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("scans").alias("s")).collect()}  # SMALL rows
    boundary = cheapest(costs, share)

    shared = checkpoint(keys_of(sets, boundary, share).groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("hi")).where("lead <> hi").select("key", "lead"))
    bits = spark.sparkContext.broadcast(bit_table(shared, "key"))
    listed = checkpoint(keys_of(sets, boundary, share, bits).join(shared, "key").distinct())
    # lists of the same members are one: that of the first of their shingles, which comes first in all members
    same = listed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(F.xxhash64("rep"), 32)).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"),
                                     F.first("lead").alias("lead"), F.sum("pos").alias("p"))
    one = same.groupBy("m", "s", "x", "lead").agg(F.min_by("key", F.struct("p", "key")).alias("key")).select("key")
    lists = checkpoint(listed.join(one, "key", "left_semi"))

    # once per set
    firsts = sets.where(F.col("first").isNotNull()).select("rep", "first").join(lists.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.first("first").alias("first"))
    met = possible(lists.select("key", "rep", "n", "pos"), firsts, ranks, share)
    whole = whole_sets(given, met.select("rep").distinct(), sets.select("id", "rep"))

    leads = met.groupBy("key", "i", "j").agg(F.min("rep").alias("v"))
    pairs = met.join(leads, ["key", "i", "j"]).where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    links = checkpoint(verified(checkpoint(near(pairs, whole, share)), whole, share))
    links = links.unionByName(checkpoint(across(met, components(links), whole, share)))

    names = with_comp(sets.where("rep IS NOT NULL").groupBy("rep").agg(F.min("id").alias("least")), components(links), "rep", "comp")
    best = names.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = names.select("rep", "comp").join(best, "comp").select("rep", "component_id")
    return (sets.select("id", "n", "rep").join(found, "rep", "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")))
