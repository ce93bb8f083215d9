"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits. A directory, indexed by a prefix of these bits,
names the shard of every prefix: a bucket whose bytes exceed the limit is split
on one more bit, all others stay as they are. The bytes of all prefixes come from
a small table of cells (prefixes some bits longer than the average shard needs),
pre-aggregated before its shuffle. Prefix sums only fall with depth, so the shard
of a cell is its shortest prefix that fits. Cells that do not fit are refined by
further bits, with only their own rows.

The key is the row's id together with a digest of its text, so that one id with a
third of all rows still splits. Only rows equal in both share all bits: if they
exceed the limit together (or a single row does), they form a shard of their own
at full depth and ``fits`` is false there.

Defined results: a null id hashes as an empty string and a null text has no bytes;
repeated rows lie in the same shard; an empty table has no shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

BITS = 60
LIMIT = 1 << 20
CELL_BITS = 6  # a cell is about this many halvings smaller than a shard
STEP = 8  # bits a cell is refined by when it does not fit


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append ``n_bytes`` (UTF-8 bytes of the text) and ``bits``: 32 bits of the key's md5, then 28 of the text's.

    Input columns with these names are replaced.
    """
    part = lambda s, n: F.conv(F.substring(F.md5(F.coalesce(F.col(s).cast("string"), F.lit("")).cast("binary")), 1, n), 16, 10).cast("long")
    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long"),
                             "bits": part(key, 8) * F.lit(1 << 28) + part(text, 7)})


def prefix(depth: int, bits: str = "bits") -> Column:
    """The first ``depth`` bits as a number."""
    return F.shiftright(F.col(bits), BITS - depth)


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per cell: ``cell_depth``, ``cell`` (its prefix), ``depth``, ``shard`` (bits of its shard's prefix as text),
    ``shard_bytes`` and ``fits``. ``rows`` holds ``bits`` and ``n_bytes``.
    """
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    depth = min(BITS, max(0, (max(total, 1) // limit).bit_length()) + CELL_BITS)
    open_rows, low, done = rows.select("bits", "n_bytes"), 0, []
    while True:
        cells = checkpoint(open_rows.groupBy(prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        # the bytes of every prefix of every cell, from the shortest that is still open
        each = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"))
        each = each.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = checkpoint(each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")))
        fit = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        over = sums.where((F.col("shard_bytes") > limit) & (F.col("depth") < BITS)).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        # a shard fits, and the prefix one bit shorter does not
        leaves = checkpoint(fit.join(over, ["depth", "prefix"], "left_semi").unionByName(fit.where(F.col("depth") == low)))
        # cells look for their shard only at depths that shards have, so no prefix holds more than a few cells
        depths = [r.depth for r in leaves.select("depth").distinct().collect()]
        look = cells.select("cell", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(f"shiftright(cell, {depth - d})").alias("prefix")) for d in depths])).alias("x"))
        leaf = look.select("cell", "x.depth", "x.prefix").join(leaves, ["depth", "prefix"]) if depths else cells.limit(0).select(
            "cell", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.col("bytes").alias("shard_bytes"))
        leaf = leaf.select("cell", F.struct("depth", "prefix", "shard_bytes").alias("s"))
        done.append(leaf.select(F.lit(depth).alias("cell_depth"), "cell", "s.depth",
                                bit_text(F.col("s.prefix"), F.col("s.depth")).alias("shard"), "s.shard_bytes",
                                (F.col("s.shard_bytes") <= limit).alias("fits")))
        over = cells.where(F.col("bytes") > limit).select("cell")
        if depth == BITS or over.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_rows = open_rows.withColumn("cell", prefix(depth)).join(over, "cell").select("bits", "n_bytes")
        low, depth = depth + 1, min(BITS, depth + STEP)


def bit_text(value: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth.cast("int"), "0"))


def assign(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Append ``shard``, ``depth``, ``shard_bytes`` and ``fits``: each row by the directory entry of its cell."""
    depths = sorted(r.cell_depth for r in entries.select("cell_depth").distinct().collect())  # a handful of refinements at most
    if not depths:
        return rows.select("*", F.lit(None).cast("string").alias("shard"), F.lit(None).cast("int").alias("depth"),
                           F.lit(None).cast("long").alias("shard_bytes"), F.lit(None).cast("boolean").alias("fits")).limit(0)
    wanted = F.explode(F.array(*[F.struct(F.lit(d).alias("cell_depth"), prefix(d).alias("cell")) for d in depths]))
    if len(depths) == 1:
        spread = rows.select("*", F.lit(depths[0]).alias("cell_depth"), prefix(depths[0]).alias("cell"))
    else:
        spread = rows.select("*", wanted.alias("__c")).select("*", "__c.cell_depth", "__c.cell").drop("__c")
    return spread.join(entries, ["cell_depth", "cell"]).drop("cell_depth", "cell")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row with its shard. Columns named like a result are replaced."""
    rows = hashed(docs.drop("shard", "depth", "shard_bytes", "fits", "cell", "cell_depth"), key, text)
    small = checkpoint(rows.select("bits", "n_bytes"))
    return assign(rows, directory(small, limit)).drop("bits")


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard are brought together, and none holds more than the limit unless it cannot be split."""
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
