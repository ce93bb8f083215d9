"""Config-driven readers for delimited and JSON sensor logs.

A spec says where the files are, how a timestamp is written and which source
column fills which target field. Every reader gives lineage columns and splits
rows without a valid timestamp into a rejects frame instead of failing. Files that cannot be
read go to a table of failed files, and none of their rows is kept.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as fc
from .tables import stage

# Strftime directives and the pattern letters Spark uses for them.
_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%f": "SSSSSS", "%b": "MMM"}


def pattern(fmt: str) -> str:
    for directive, letters in _DIRECTIVES.items():
        fmt = fmt.replace(directive, letters)
    return fmt


@dataclass(frozen=True)
class ColumnSpec:
    source: str | int  # header name or 0-based position
    target: str
    dtype: str = "float"  # float | int | bool | string


@dataclass(frozen=True)
class FileSpec:
    path: str | list[str]
    format: str = "csv"  # csv | interval_csv | stream_json
    columns: tuple[ColumnSpec, ...] = ()
    delimiter: str = ","
    quote: str | None = '"'
    header_rows: int = 1  # rows before the data; the last of them holds the names
    datetime: str | int | None = None
    date: str | int | None = None
    time: str | int | None = None
    unix_ms: str | int | None = None
    fmt: str = "%Y-%m-%d %H:%M:%S"
    null_markers: tuple[str, ...] = fc.NULL_MARKERS
    source_system: str | None = None
    lamp_group: str | None = None
    streams: Mapping[str, str] = field(default_factory=dict)  # stream_json: uuid -> target
    multi_line: bool = True  # stream_json: one document per file; False: one per line


def load_specs(text: str) -> list[FileSpec]:
    """Specs from JSON: a list of objects with the fields of ``FileSpec``."""
    out = []
    for raw in json.loads(text):
        raw = dict(raw)
        raw["columns"] = tuple(ColumnSpec(**c) for c in raw.get("columns", ()))
        if "null_markers" in raw:
            raw["null_markers"] = tuple(raw["null_markers"])
        out.append(FileSpec(**raw))
    return out


def _typed(c: Column, spec: ColumnSpec, markers: Sequence[str]) -> Column:
    boolean = spec.dtype in ("bool", "boolean")
    raw = fc.null_markers(c, markers, boolean)
    if boolean:
        return fc.parse_bool(F.coalesce(raw, F.lit("")))
    blank = F.when(F.trim(raw) != "", raw)
    if spec.dtype in ("int", "integer"):
        return fc.parse_int(blank)
    return fc.finite(fc.parse_decimal(blank)) if spec.dtype == "float" else F.trim(blank)


def _instant(spec: FileSpec, at) -> Column:
    if spec.unix_ms is not None:
        return F.timestamp_millis(F.trim(at(spec.unix_ms)).try_cast("long")).cast("timestamp_ntz")
    if spec.date is not None:
        text = F.concat_ws(" ", F.trim(at(spec.date)), F.trim(at(spec.time)))
    else:
        text = F.trim(at(spec.datetime))
    return F.try_to_timestamp(text, F.lit(pattern(spec.fmt))).cast("timestamp_ntz")


def _lineage(spec: FileSpec, file: str = "_metadata.file_path") -> dict[str, Column]:
    return {"source_file": F.col(file), "source_system": F.lit(spec.source_system).cast("string"),
            "format_type": F.lit(spec.format), "lamp_group": F.lit(spec.lamp_group).cast("string")}


@dataclass(frozen=True)
class Parsed:
    rows: DataFrame
    rejects: DataFrame  # source_file, raw, reason
    failed: DataFrame  # source_file, reason: files that cannot be read


def _split(df: DataFrame, keep: Sequence[str], failed: DataFrame) -> Parsed:
    ok = F.col("ts").isNotNull()
    return Parsed(df.where(ok).select("ts", *keep), df.where(~ok).select("source_file", "raw", F.lit("invalid timestamp").alias("reason")), failed)


COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
HEAD_BYTES = 1 << 22  # header lines are looked for so far into a file


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    parts = urlparse(uri)
    return (pyarrow.fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """A stream of a file's bytes, decompressed by its ending."""
    fs, path = place(uri)
    return fs.open_input_stream(path, compression="detect")


def first_lines(uri: str, rows: int) -> list[str]:
    """The first lines of a file, fewer if it has fewer. Compressed files are read to their end, which finds broken ones."""
    head, whole = b"", uri.lower().endswith(COMPRESSED)
    with opened(uri) as stream:
        while more := stream.read(1 << 16):
            if head.count(b"\n") < rows:
                head += more
                if len(head) > HEAD_BYTES:
                    raise ValueError(f"no {rows} lines in the first {HEAD_BYTES} bytes")
            elif not whole:
                break
    return [line.removesuffix("\r") for line in head.decode("utf-8", "replace").split("\n")[:rows] if line or head.count(b"\n") >= rows]


def inspected(spark: SparkSession, path: str | Sequence[str], rows: int) -> DataFrame:
    """One row per file (file, head, reason): its first ``rows`` lines, or why it cannot be read.

    Tasks read the first kilobytes of plain files (nothing if no lines are wanted) and all of compressed ones.
    """
    def run(batches):
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                try:
                    out.append((uri, first_lines(uri, rows) if rows or uri.lower().endswith(COMPRESSED) else [], None))
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file is a reason, and the others go on
                    out.append((uri, None, (str(e).splitlines() or [type(e).__name__])[0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.string()), pa.string()))], names=["file", "head", "reason"])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))  # a listing: contents are not read
    return stage(files.mapInArrow(run, "file string, head array<string>, reason string"), "files")


def _sound(raw: DataFrame, bad: DataFrame | None) -> DataFrame:
    return raw if bad is None else raw.join(bad, raw["_file"] == bad["source_file"], "left_anti")


def _failed(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The failed files, and the same if there are any."""
    failed = files.where(F.col("reason").isNotNull()).select(F.col("file").alias("source_file"), "reason")
    return failed, None if failed.isEmpty() else failed


def read_csv(spark: SparkSession, spec: FileSpec) -> Parsed:
    """Delimited files by header names or positions.

    Every file is read by its own header: the first lines of all files are a table, of which
    planning only looks at the different ones. Files with several headers are read in one scan
    and marked by a join on the file name. All columns are read
    as text and parsed leniently, so a bad cell is NULL and a bad time a reject.
    """
    files = inspected(spark, spec.path, spec.header_rows)
    failed, bad = _failed(files)
    heads: list[tuple[str, ...]] = [()]
    if spec.header_rows:
        heads = sorted(tuple(r.head) for r in files.where("size(head) > 0").select("head").distinct().collect())  # different headers only
        if not heads:
            raise ValueError(f"no header in {spec.path}")
    names = [[n.strip() for n in next(csv.reader([h[-1]], delimiter=spec.delimiter, quotechar=spec.quote or None, quoting=csv.QUOTE_MINIMAL if spec.quote else csv.QUOTE_NONE), [])]
             if h else [] for h in heads]
    refs = [c.source for c in spec.columns] + [r for r in (spec.datetime, spec.date, spec.time, spec.unix_ms) if r is not None]

    def position(ref, of: Sequence[str]) -> int:
        if isinstance(ref, int):
            return ref
        if ref not in of:
            raise ValueError(f"column {ref!r} not in header {of}")
        return of.index(ref)

    widths = [max([len(n), *[position(r, n) + 1 for r in refs]]) for n in names]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(max(widths))])
    raw = (spark.read.schema(schema).option("sep", spec.delimiter).option("quote", spec.quote or "").option("header", False)
           .option("ignoreCorruptFiles", bad is not None).option("mode", "PERMISSIVE").csv(spec.path))
    raw = _sound(raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")), bad)
    if len(heads) > 1:
        known = spark.createDataFrame([(list(h), i) for i, h in enumerate(heads)], "head array<string>, _head int")
        raw = raw.join(files.join(known, "head").select(F.col("file").alias("_file"), "_head"), "_file")

    def by_head(of) -> Column:
        made = [of(i) for i in range(len(heads))]
        return made[0] if len(made) == 1 else F.element_at(F.array(*made), F.col("_head") + 1)

    cells = [F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(max(widths))]
    at = lambda ref: by_head(lambda i: F.col(f"_c{position(ref, names[i])}"))
    line = by_head(lambda i: F.concat_ws(spec.delimiter, *cells[:widths[i]]))
    out = raw.withColumns({**_lineage(spec, "_file"), "raw": line, "ts": _instant(spec, at),
                           **{c.target: _typed(at(c.source), c, spec.null_markers) for c in spec.columns}})
    if spec.header_rows:
        # preamble lines are shorter than the data: compare without trailing separators, at the beginning of files only
        plain = [[(h.replace(spec.quote, "") if spec.quote else h).rstrip(spec.delimiter) for h in head] for head in heads]
        preamble = by_head(lambda i: F.rtrim("raw", F.lit(spec.delimiter)).isin(plain[i]))
        out = out.where(~(preamble & F.col("ts").isNull() & (F.col("_start") == 0)))
    return _split(out, [c.target for c in spec.columns] + ["source_file", "source_system", "format_type", "lamp_group"], failed)


def read_interval_csv(spark: SparkSession, spec: FileSpec, start: str = "Start", end: str = "End") -> Parsed:
    """Interval rows: the start is the timestamp, the end is kept as ``ts_end``."""
    cols = (*spec.columns, ColumnSpec(end, "ts_end", "string"))
    spec = FileSpec(**{**spec.__dict__, "columns": cols, "datetime": start, "quote": None})
    parsed = read_csv(spark, spec)
    stop = F.try_to_timestamp(F.col("ts_end"), F.lit(pattern(spec.fmt))).cast("timestamp_ntz")
    return Parsed(parsed.rows.withColumn("ts_end", stop), parsed.rejects, parsed.failed)


STREAM_SCHEMA = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("Readings", T.ArrayType(T.ArrayType(T.DoubleType()))),
                              T.StructField("_corrupt_record", T.StringType())])


def map_streams(df: DataFrame, targets: Mapping[str, str], uuid: str = "uuid") -> DataFrame:
    """Name streams by a configured dictionary; unknown streams are skipped.

    The dictionary is part of the plan as a map literal, so nothing is shuffled.
    """
    lookup = F.create_map(*[x for k, t in targets.items() for x in (F.lit(k), F.lit(t))])
    return df.withColumn("target", lookup[F.col(uuid)]).where(F.col("target").isNotNull())


def read_stream_json(spark: SparkSession, spec: FileSpec) -> Parsed:
    """Files holding ``[{"uuid": ..., "Readings": [[ms, value], ...]}, ...]``; one row per reading.

    A multi-line file is one JSON document and is parsed by one task, so keep such
    files moderate; documents on single lines (``multi_line=False``) are split. What
    is no JSON is a reject; a whole document of a file makes it a failed one.
    """
    failed, bad = _failed(inspected(spark, spec.path, 0))
    raw = (spark.read.schema(STREAM_SCHEMA).option("multiLine", spec.multi_line).option("mode", "PERMISSIVE")
           .option("ignoreCorruptFiles", bad is not None).json(spec.path))
    raw = _sound(raw.select("*", F.col("_metadata.file_path").alias("_file")), bad)
    broken = raw.where(F.col("_corrupt_record").isNotNull() & F.col("uuid").isNull()).select(F.col("_file").alias("source_file"), F.col("_corrupt_record").alias("raw"), F.lit("corrupt document").alias("reason"))
    if spec.multi_line:
        failed = failed.unionByName(broken.select("source_file", "reason").distinct())
    known = map_streams(raw.withColumns(_lineage(spec, "_file")), spec.streams)
    flat = known.select("uuid", "target", "source_file", "source_system", "format_type", "lamp_group", F.explode("Readings").alias("_r"))
    out = flat.withColumns({"raw": F.to_json("_r"), "value": F.col("_r")[1],
                            "ts": F.timestamp_millis(F.col("_r")[0].cast("long")).cast("timestamp_ntz")})
    fields = sorted(set(spec.streams.values()))
    out = out.withColumns({t: F.when(F.col("target") == t, F.col("value")) for t in fields})
    made = _split(out, [*fields, "uuid", "source_file", "source_system", "format_type", "lamp_group"], failed)
    return Parsed(made.rows, made.rejects.unionByName(broken), made.failed)


READERS = {"csv": read_csv, "interval_csv": read_interval_csv, "stream_json": read_stream_json}


@dataclass(frozen=True)
class Ingested:
    rows: DataFrame | None
    rejects: DataFrame | None
    failed: tuple[tuple[FileSpec, str], ...]
    files: DataFrame | None = None  # source_file, reason: files that cannot be read


def ingest(spark: SparkSession, specs: Sequence[FileSpec]) -> Ingested:
    """One reader per spec, stacked by name. A spec that cannot be planned and a file that cannot be read are reported, the rest go on."""
    rows = rejects = files = None
    failed = []
    for spec in specs:
        try:
            got = READERS[spec.format](spark, spec)
            got.rows.schema  # noqa: B018  resolve now, so that missing files are caught here
        except Exception as e:  # noqa: BLE001
            failed.append((spec, str(e).splitlines()[0]))
            continue
        rows = got.rows if rows is None else rows.unionByName(got.rows, allowMissingColumns=True)
        rejects = got.rejects if rejects is None else rejects.unionByName(got.rejects)
        files = got.failed if files is None else files.unionByName(got.failed)
    return Ingested(rows, rejects, tuple(failed), files)


def flatten_groups(df: DataFrame, size: int, names: Sequence[str], skip: int = 0) -> DataFrame:
    """Repeated column groups side by side (separated by ``skip`` blank columns) as rows; blank times dropped."""
    c = df.columns
    starts = range(0, len(c) - size + 1, size + skip)
    groups = F.array(*[F.struct(*[F.col(f"`{c[s + i]}`").cast("string").alias(n) for i, n in enumerate(names)]) for s in starts])
    return df.select(F.inline(groups)).where(F.coalesce(F.trim(F.col(names[0])), F.lit("")) != "")


def parse_hourly_arrays(df: DataFrame, payload: str, fields: Sequence[str], root: str = "hourly") -> DataFrame:
    """Weather payloads: parallel arrays under ``hourly`` become one row per hour."""
    inner = ", ".join(["time: array<string>", *[f"{f}: array<double>" for f in fields]])
    h = F.from_json(F.col(payload), f"struct<{root}: struct<{inner}>>")[root]
    zipped = F.arrays_zip(h["time"].alias("time"), *[h[f].alias(f) for f in fields])
    rows = df.select(F.inline(zipped).alias("time", *fields))
    return rows.withColumn("time", F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz"))


# ------------------------------------------------------------------------- profiles


def profile_files(df: DataFrame, ts: str, labels: Sequence[str], file: str = "source_file") -> DataFrame:
    """Rows, time range, duplicate times and NULL labels per file."""
    per = df.groupBy(file, ts).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in labels])
    return per.groupBy(file).agg(F.sum("_n").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                                 F.sum(F.col("_n") - 1).alias("duplicate_times"), *[F.sum(f"{c}_null").alias(f"{c}_null") for c in labels])


def presence_matrix(df: DataFrame, columns: Sequence[str], file: str = "source_file") -> DataFrame:
    """Which columns hold any value in which file."""
    return df.groupBy(file).agg(*[(F.count(c) > 0).alias(c) for c in columns])


def reconcile_counts(source: DataFrame, table: DataFrame, key: str = "source_file") -> DataFrame:
    """Row counts per source in both places, and their difference."""
    a = source.groupBy(key).agg(F.count(F.lit(1)).alias("source_rows"))
    b = table.groupBy(key).agg(F.count(F.lit(1)).alias("table_rows"))
    out = a.join(b, key, "full_outer").fillna(0, ["source_rows", "table_rows"])
    return out.withColumn("difference", F.col("source_rows") - F.col("table_rows"))


def file_metadata(df: DataFrame, ts: str, file: str = "source_file") -> DataFrame:
    return df.groupBy(file).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows"))
