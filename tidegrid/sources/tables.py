"""Partitioned parquet tables: scans, upserts, slices, stage outputs.

Writes replace whole partitions (dynamic partition overwrite): a failed job
leaves the old partitions in place and a repeated one gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import cols, match
from ..session import shared_dir


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place the cluster names."""
    return f"{shared_dir(spark)}/tidegrid-{uuid.uuid4().hex}"


def with_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("date", F.to_date(ts))


def save(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write parquet; with partition columns rows are gathered per partition, so files stay few and large."""
    w = df.write.mode(mode)
    if partition:
        w = w.partitionBy(*partition)
    w.parquet(path)
    return path


def save_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)
    return path


def scan_range(spark: SparkSession, path: str, start: str, end: str, columns: Sequence[str] | None = None, ts: str = "ts",
               closed: bool = False) -> DataFrame:
    """Rows in [start, end) (``closed``: [start, end]); the date partition filter is derived from the range."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    df = spark.read.parquet(path)
    cond = (F.col(ts) >= lo) & ((F.col(ts) <= hi) if closed else (F.col(ts) < hi))
    if "date" in df.columns:
        cond = cond & F.col("date").between(F.to_date(lo), F.to_date(hi))
    out = df.where(cond)
    return out if columns is None else out.select(*dict.fromkeys([ts, *columns]))


def merged(target: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Target rows without a newer version, plus the new rows. NULL keys equal each other."""
    return match(target, new.select(*cols(keys)).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys, partition: Sequence[str]) -> None:
    """Insert or replace by key, rewriting only the partitions the new rows touch or leave.

    Partitions whose last row has moved are emptied in a second write. A job that ends between the two leaves
    such rows in both places; the same call again mends that, as it finds and empties them anew.
    """
    parts, old = list(partition), spark.read.parquet(path)
    left = match(old, new.select(*cols(keys)).distinct(), keys, "left_semi").select(*parts).distinct()
    fresh = new.select(*parts).distinct()
    kept = merged(match(old, left.union(fresh).distinct(), parts, "left_semi"), new, keys)
    # a partition whose last row moved elsewhere has no row to overwrite it with: the few of them are emptied by name
    gone = match(left, kept.select(*parts).distinct(), parts, "left_anti").select(
        F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in parts]).alias("p")).collect()
    _overwrite(kept, path, partition)
    empty = old.drop(*parts).limit(0)
    for r in gone:
        empty.write.mode("overwrite").parquet(f"{path}/{r.p}")


def replace_slice(df: DataFrame, path: str, partition: Sequence[str] = ("signal", "level", "stage")) -> None:
    """Replace the slices present in ``df``, leave all others."""
    _overwrite(df, path, partition)


def _overwrite(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def insert_ignore(spark: SparkSession, path: str, new: DataFrame, keys, partition: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """Append only rows whose key is not there yet. Of new rows with one key, the first along ``order`` (default: all columns) is taken."""
    k = cols(keys)
    one = new.groupBy(*k).agg(F.min_by(F.struct(*new.columns), F.struct(*(order or new.columns))).alias("_row")).select("_row.*")
    save(match(one, spark.read.parquet(path).select(*k).distinct(), k, "left_anti"), path, partition, mode="append")


def stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a stage result and go on from the written table: lineage ends, lost executors re-read files."""
    spark = df.sparkSession
    path = f"{root or scratch(spark)}/{name}"
    save(df, path)
    return spark.read.parquet(path)


def stage_report(df: DataFrame, name: str, ts: str | None = None) -> DataFrame:
    """Rows, columns and time range of a stage."""
    extra = [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")] if ts else []
    return df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), *extra)


def write_features(df: DataFrame, path: str, run_date: str, ts: str = "ts", entity: str = "entity") -> None:
    """Daily feature partition with ``event_timestamp`` and a default entity."""
    out = df if entity in df.columns else df.withColumn(entity, F.lit(1))
    out = out.withColumns({"event_timestamp": F.col(ts) if ts in df.columns else F.lit(run_date).cast("timestamp_ntz"),
                           "date": F.lit(run_date).cast("date")})
    _overwrite(out, path, ["date"])


def jdbc_options(source: Mapping[str, str], start: str, end: str, ts: str, parts: int, columns: Sequence[str] = ("*",)) -> dict[str, str]:
    """Options of a JDBC read in ``parts`` queries, each over an equal part of [start, end] of ``ts``.

    The period is also a condition of the query itself, so that the first and the last part, which Spark leaves open, do not
    read what lies outside. What ``source`` sets itself stays; without a ``dbtable`` (a name) it is taken as it is.
    """
    if parts < 1:
        raise ValueError("at least one part")
    if "dbtable" not in source:
        return dict(source)
    table, rest = source["dbtable"], {k: v for k, v in source.items() if k != "dbtable"}
    query = f"(SELECT {', '.join(columns)} FROM {table} WHERE {ts} >= '{start}' AND {ts} <= '{end}') AS part"
    return {"partitionColumn": ts, "lowerBound": start, "upperBound": end, "numPartitions": str(parts), "fetchsize": "10000", **rest, "dbtable": query}


def read_external(spark: SparkSession, source: Mapping[str, str] | str, start: str, end: str, ts: str, area: str | None = None,
                  area_col: str = "area", parts: int = 8) -> DataFrame:
    """Weather or prices of a period and area, from parquet or from JDBC options by ``parts`` parallel queries (filters are pushed down)."""
    if isinstance(source, str):
        df = spark.read.parquet(source)
    else:
        df = spark.read.format("jdbc").options(**jdbc_options(source, start, end, ts, parts)).load()
    out = df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) <= F.lit(end).cast("timestamp_ntz")))
    return out if area is None else out.where(F.col(area_col) == area)
