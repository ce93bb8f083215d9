"""Streaming forms of the windowed operators.

Event time must be a zoned timestamp for watermarks, so every entry point casts
it. State is bounded by the watermark (windows, sessions, duplicates, joins, readings
that wait for their turn) or by one small record per key (``series_state``, ``in_order``, which keeps those of a part of the keys together).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..frames import cols, micros
from ..operators.changepoint import RunLengths


def read_files(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", fmt: str = "parquet",
               max_files: int | None = None) -> DataFrame:
    """Watch a folder for files with an explicit schema."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.format(fmt).load(path)


def timed(df: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a zoned timestamp with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def split_rejects(df: DataFrame, valid):
    """For ``foreachBatch``: accepted and rejected rows of one batch."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def ingest_to(df: DataFrame, valid, rows_path: str, rejects_path: str, checkpoint: str):
    """Write accepted and rejected rows to two tables, exactly once per batch (the batch number is a partition)."""
    def write(batch: DataFrame, number: int) -> None:
        for part, path in zip(split_rejects(batch, valid), (rows_path, rejects_path)):
            (part.withColumn("batch", F.lit(number)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(df: DataFrame, value: str, keys, ts: str = "ts", every: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows of decomposable statistics; epoch-aligned."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return (df.groupBy(*cols(keys), w.alias("w")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))
        .select(*cols(keys), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean", "min", "max", "count"))


def islands(df: DataFrame, gap: str, keys, ts: str = "ts") -> DataFrame:
    """Islands as session windows; a session ends ``gap`` after its last reading."""
    return (df.groupBy(*cols(keys), F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("rows"))
            .select(*cols(keys), F.col("s.start").alias("start_time"), F.col("s.end").alias("session_end"), "rows"))


def distinct_events(df: DataFrame, ids) -> DataFrame:
    """Suppress repeats that arrive within the watermark."""
    return df.dropDuplicatesWithinWatermark(cols(ids))


def join_static(df: DataFrame, static: DataFrame, on) -> DataFrame:
    """Stream with a static series; Spark broadcasts the static side if its measured size allows."""
    return df.join(static, cols(on), "left")


def join_live(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, keys: Mapping[str, str], within: str) -> DataFrame:
    """Inner join of two streams on keys and a time bound; both sides need watermarks to let state go."""
    cond = (left[left_ts] >= right[right_ts]) & (left[left_ts] <= right[right_ts] + F.expr(f"INTERVAL {within}"))
    for a, b in keys.items():
        cond = cond & (left[a] == right[b])
    return left.join(right, cond)


STATE = T.StructType([T.StructField("ewma", T.DoubleType()), T.StructField("on", T.BooleanType()), T.StructField("edges", T.LongType()),
                      T.StructField("since", T.LongType())])


def _advance(state: tuple, x: float, alpha: float, threshold: float) -> tuple:
    """One reading: smoothed value, on/off, edges so far, readings since the last one above the threshold."""
    ewma, was_on, edges, since = state
    on = x > threshold
    first = ewma is None
    return (x if first else (1 - alpha) * ewma + alpha * x, on, edges + (0 if first else int(on != was_on)), 0 if on else since + 1)


def series_state(df: DataFrame, value: str, key: str, order: Sequence[str], alpha: float = 0.3, threshold: float = 20.0) -> DataFrame:
    """Running smoothing, edge count and recovery per key over an unbounded stream, one small state record each.

    Readings of a key are taken in time order inside every batch.
    """
    key_type = df.schema[key].dataType.simpleString()
    carry = [c for c in order if c != key]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    out = ", ".join([f"`{key}` {key_type}", *[f"`{c}` {types[c]}" for c in carry], "ewma double", "edges bigint", "since bigint"])

    def run(k, batches, state):
        now = state.get if state.exists else (None, False, 0, 0)
        frames = [b for b in batches]
        pdf = pd.concat(frames).sort_values(list(order), kind="stable") if frames else pd.DataFrame()
        rows = []
        for x in pdf[value]:
            now = _advance(tuple(now), float(x), alpha, threshold)
            rows.append((now[0], now[2], now[3]))
        state.update(tuple(now))
        made = pd.DataFrame(rows, columns=["ewma", "edges", "since"])
        yield pd.concat([pdf[[key, *carry]].reset_index(drop=True), made], axis=1)

    return df.groupBy(key).applyInPandasWithState(run, out, STATE, "append", "NoTimeout")


GROUPS = 1024  # parts the keys of a stream are dealt into: a call of Python serves all keys of a part
BLOCK = 1000  # rows that lie in the state as one record


def packed(schema: T.StructType) -> T.StructType:
    """The schema of a record that holds a block of rows, column by column."""
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])


def pack(columns: Sequence[list]) -> list[tuple]:
    return [tuple(c[i:i + BLOCK] for c in columns) for i in range(0, len(columns[0]), BLOCK)]


def unpack(state, width: int) -> list[list]:
    """The columns of all blocks of a list state."""
    columns = [[] for _ in range(width)]
    for block in state.get() if state.exists() else ():
        for column, more in zip(columns, block):
            column.extend(more)
    return columns


class InOrder(StatefulProcessor):
    """Holds the readings of a part of the keys until the watermark has passed them, then gives them to a recurrence per key in order.

    ``start(numbers)`` makes the recurrence of a key from what it has kept (None at first): a call takes the next
    readings and returns one array per result, ``numbers()`` gives what to keep. Timers wake a part when its earliest
    reading is due. After ``idle`` milliseconds without a reading the recurrence of a key starts anew, and what it has kept goes.
    """

    def __init__(self, start, key: str, value: str, waiting: T.StructType, kept: T.StructType, made: Sequence[str], idle: int | None):
        self.start, self.key, self.value, self.ids = start, key, value, waiting.names[2:-1]
        self.schema, self.keeps, self.made, self.idle = waiting, kept, list(made), idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", packed(self.schema))
        self.kept = handle.getListState("kept", packed(self.keeps))

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([pdf[self.schema.names] for pdf in rows])
        self.waiting.appendList(pack(self.columns(new)))
        self.wake(new["us__"].min())
        return iter(())

    def columns(self, rows: pd.DataFrame) -> list[list]:
        """Rows as they are kept."""
        return [rows[c].astype(object).tolist() for c in self.schema.names]

    def wake(self, us) -> None:
        self.handle.registerTimer(int(-(-int(us) // 1000)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(dict(zip(self.schema.names, unpack(self.waiting, len(self.schema)))))
        due = rows["us__"].to_numpy(dtype="int64") <= now
        rest = rows[~due]
        if not due.any() and (self.idle is None or not self.kept.exists()):
            return
        kept = {k: (numbers, last) for k, numbers, last in zip(*unpack(self.kept, len(self.keeps)))}
        if due.any():
            if len(rest):
                self.waiting.put(pack(self.columns(rest)))
                self.wake(rest["us__"].min())
            else:
                self.waiting.clear()
            yield self.advance(rows[due], kept)
        if self.idle is not None:
            busy = set(rest[self.key].tolist())
            quiet = {k: last for k, (_, last) in kept.items() if k not in busy}
            gone = [k for k, last in quiet.items() if last + self.idle * 1000 < now]
            for k in gone:
                del kept[k], quiet[k]
            if quiet:
                self.handle.registerTimer(int(min(quiet.values()) // 1000 + self.idle + 2))
            if not due.any() and not gone:
                return
        if kept:
            self.kept.put(pack([list(kept), [numbers for numbers, _ in kept.values()], [last for _, last in kept.values()]]))
        else:
            self.kept.clear()

    def advance(self, rows: pd.DataFrame, kept: dict) -> pd.DataFrame:
        """Results of the rows, key by key; ``kept`` is brought up to date."""
        code, _ = pd.factorize(rows[self.key])
        rows = rows.assign(_code=code).sort_values(["_code", "us__", *self.ids], kind="stable")
        code, all_us, all_x = rows.pop("_code").to_numpy(), rows["us__"].to_numpy(dtype="int64"), rows.pop(self.value).to_numpy(dtype=float)
        ends = [*(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        names, parts = rows[self.key].tolist(), []
        for begin, end in zip([0, *ends], ends):
            name, us, x = names[begin], all_us[begin:end], all_x[begin:end]
            numbers, last = kept.get(name, (None, None))
            gap = np.diff(us, prepend=us[0] if last is None else last)
            anew = set(np.flatnonzero(gap > self.idle * 1000).tolist()) if self.idle is not None else set()
            cuts = [*sorted(anew | {0}), len(x)]
            for a, b in zip(cuts, cuts[1:]):
                step = self.start(None if a in anew else numbers)
                parts.append(step(x[a:b]))
            kept[name] = ([float(v) for v in step.numbers()], int(us[-1]))
        return rows.reset_index(drop=True).assign(**{n: np.concatenate(c) for n, c in zip(self.made, zip(*parts))})

    def close(self) -> None:
        pass


class Smoothed:
    """Smoothed value, edges of the state above a threshold, and readings since the last one above it."""

    def __init__(self, alpha: float, threshold: float, numbers=None):
        self.alpha, self.threshold = alpha, threshold
        self.now = (None, False, 0, 0) if numbers is None else (numbers[0], bool(numbers[1]), int(numbers[2]), int(numbers[3]))

    def __call__(self, x):
        rows = []
        for v in x:
            self.now = _advance(self.now, float(v), self.alpha, self.threshold)
            rows.append((self.now[0], self.now[2], self.now[3]))
        return tuple(np.array(c) for c in zip(*rows))

    def numbers(self):
        return [float(v) for v in self.now]


class Holt:
    """Level and trend; the first reading is the level, without trend."""

    def __init__(self, alpha: float, beta: float, numbers=None):
        self.alpha, self.beta, self.now = alpha, beta, numbers

    def __call__(self, x):
        out = np.empty((len(x), 2))
        for k, v in enumerate(x):
            if self.now is None:
                self.now = (float(v), 0.0)
            else:
                level = self.alpha * v + (1 - self.alpha) * (self.now[0] + self.now[1])
                self.now = (level, self.beta * (level - self.now[0]) + (1 - self.beta) * self.now[1])
            out[k] = self.now
        return out[:, 0], out[:, 1]

    def numbers(self):
        return list(self.now)


def in_order(df: DataFrame, value: str, key: str, order: Sequence[str], start, made: str, idle: str | None = None) -> DataFrame:
    """A recurrence along each key of an unbounded stream with a watermark on ``order[0]``, in order of time also across batches.

    Rows (key, order, made) come out once the watermark has passed them; ``order`` has to be unique per key. Rows
    without a value take no part; a reading more than ``idle`` after the last one starts anew. Needs the RocksDB state store, as ``state_store`` sets it.
    """
    ts, ids, number = order[0], order[1:], T.StructField("us__", T.LongType())
    name = T.StructField("key__", T.StringType())  # the key as text that is never NULL: a number beside a NULL would reach Python as a float
    waiting = T.StructType([name, number, *(df.schema[c] for c in ids), T.StructField(value, T.DoubleType())])
    kept = T.StructType([name, T.StructField("numbers", T.ArrayType(T.DoubleType())), T.StructField("last", T.LongType())])
    added = T.StructType.fromDDL(made)
    out = T.StructType([name, number, *(df.schema[c] for c in ids), *added])
    processor = InOrder(start, name.name, value, waiting, kept, added.names, None if idle is None else micros(idle) // 1000)
    text, part = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), F.pmod(F.xxhash64(key), F.lit(GROUPS))
    # the time itself stays among the rows, as the watermark is on it
    rows = df.where(F.col(value).isNotNull()).select(text.alias("key__"), *order, F.col(value).cast("double").alias(value), F.unix_micros(ts).alias("us__"), part.alias("part__"))
    found = rows.groupBy("part__").transformWithStateInPandas(processor, out, "Append", "EventTime")
    back = F.when(F.col("key__") != "", F.expr("substr(key__, 2)").cast(df.schema[key].dataType)).alias(key)
    return found.select(back, F.timestamp_micros("us__").alias(ts), *ids, *added.names)


def smoothed_in_order(df: DataFrame, value: str, key: str, order: Sequence[str], alpha: float = 0.3, threshold: float = 20.0, idle: str | None = None) -> DataFrame:
    return in_order(df, value, key, order, lambda kept: Smoothed(alpha, threshold, kept), "ewma double, edges bigint, since bigint", idle)


def holt(df: DataFrame, value: str, key: str, order: Sequence[str], alpha: float = 0.4, beta: float = 0.3, idle: str | None = None) -> DataFrame:
    """Double exponential smoothing of a stream."""
    return in_order(df, value, key, order, lambda kept: Holt(alpha, beta, kept), "level double, trend double", idle)


def bocpd(df: DataFrame, value: str, key: str, order: Sequence[str], lam: float = 200.0, tolerance: float = 1e-12, idle: str | None = None) -> DataFrame:
    """Online changepoint probability of a stream; the state of a key is its plausible run lengths."""
    return in_order(df, value, key, order, lambda kept: RunLengths(lam, tolerance, kept), "cp_prob double", idle)


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet under ``path`` and read it back."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")
