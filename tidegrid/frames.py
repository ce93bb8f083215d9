"""Ordered computation over keyed series that never puts one hot series in one task.

A plain ``Window.partitionBy(keys)`` sorts a whole series in a single task, so a
series holding a third of all rows decides the run time of the job. The helpers
here split long series and stay exact:

* ``scan`` (previous/next row, fills, running totals) cuts a series into time
  chunks. Each chunk is reduced to one row, the small chunk table is scanned per
  key, and the carried value is joined back; rows are only ordered inside chunks.
* ``row_frames`` numbers the rows with ``scan`` and cuts the numbering into equal
  blocks; rows near a block edge are copied to the neighbour that needs them.
* ``time_frames`` does the same for time-range frames, straight from the clock.
* ``exact_quantiles`` finds order statistics by bucketing values instead of
  holding a key's values in one buffer.

Every function takes ``chunk``, which says which series are split:

* a duration (``"1 day"``) or a column monotone in the order: all of them;
* a ``Split`` from ``split_hot``: only the keys measured to be too large, so that
  ordinary keys keep the cheap one-shuffle window;
* ``None``: none. Correct to use where rows per key are bounded by construction,
  as on a fixed grid (span / step rows per key).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000,
          "d": 86_400_000_000, "w": 604_800_000_000}
_NAMES = {"second": "s", "sec": "s", "minute": "m", "min": "m", "t": "m", "hour": "h",
          "day": "d", "week": "w"}

DAY = _UNITS["d"]
HOUR = _UNITS["h"]


def micros(duration: str | int) -> int:
    """``"15min"``, ``"1 day"``, ``"2h"`` as microseconds; integers pass through."""
    if isinstance(duration, int):
        return duration
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", duration.lower())
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    unit = m.group(2)
    if unit not in _UNITS:
        unit = unit[:-1] if unit.endswith("s") and unit[:-1] in _NAMES else unit
        unit = _NAMES[unit]
    return int(m.group(1)) * _UNITS[unit]


def epoch(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def from_epoch(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(value: Column, width: int) -> Column:
    """Integer division rounding down, also below zero, without a detour by double."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def bucket_no(ts: str | Column, step: str | int) -> Column:
    return floor_div(epoch(ts), micros(step))


def bucket(ts: str | Column, step: str | int) -> Column:
    """Start of the left-closed bucket of width ``step`` holding ``ts``."""
    e = epoch(ts)
    return from_epoch(e - F.pmod(e, F.lit(micros(step))))


def cols(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


# -------------------------------------------------------------------------- split


@dataclass(frozen=True)
class Split:
    """Which keys are too large for one task: those listed in ``hot``, or every key if that is None.

    ``hot`` is a table of keys (or a few tuples); rows are marked by a null-safe join
    with it, so its length does not matter. ``found`` says whether any key is too large.
    The split and the plain computation give the same rows.
    """

    keys: tuple[str, ...]
    hot: DataFrame | Sequence[tuple] | None
    chunk: str | int = "1 day"
    found: bool = True

    def mark(self, df: DataFrame, name: str = "_hot") -> DataFrame:
        """Append whether a row belongs to a key that is split."""
        if self.hot is None or not self.keys:
            return df.withColumn(name, F.lit(self.found))
        hot = self.hot if isinstance(self.hot, DataFrame) else df.sparkSession.createDataFrame(list(self.hot), df.select(*self.keys).schema)
        listed = hot.select(*self.keys, F.lit(True).alias(name))
        return match(df, listed, self.keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def split_hot(df: DataFrame, keys, limit: int = 2_000_000, chunk: str | int = "1 day") -> Split:
    """Find the keys that hold more than ``limit`` rows: one map-side combined count.

    The driver only learns whether there are any.
    """
    k = cols(keys)
    hot = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return Split(tuple(k), hot.select(*k) if k else None, chunk, not hot.isEmpty())


def is_plain(chunk) -> bool:
    """Whether no series has to be split."""
    return chunk is None or (isinstance(chunk, Split) and not chunk.found)


def match(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys equal each other, as they do in a grouping. Keys come from the left side."""
    keys = cols(keys)
    if not keys:
        return attach_row(left, right)
    other = right.select(*[F.col(k).alias(f"_match_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = all_of(F.col(k).eqNullSafe(F.col(f"_match_{k}")) for k in keys)
    return left.join(other, same, how).drop(*[f"_match_{k}" for k in keys])


# --------------------------------------------------------------------------- scan


@dataclass(frozen=True)
class Scan:
    """One ordered computation: chunk summary, carried value, value inside the chunk.

    ``carry`` and ``local`` get a window; with ``back`` it runs against the order,
    because a frame ending at ``unboundedFollowing`` costs Spark quadratic time.
    """

    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    local: Callable[[WindowSpec], Column]
    merge: Callable[[Column, Column], Column]
    back: bool = False


_BEFORE = (Window.unboundedPreceding, -1)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prev(x: str | Column) -> Scan:
    """Value of the preceding row."""
    v = F.struct(_c(x).alias("v"))
    return Scan(lambda o: F.max_by(v, o), lambda s, w: F.lag(s).over(w),
                lambda w: F.lag(v).over(w), lambda a, b: F.coalesce(a, b)["v"])


def following(x: str | Column) -> Scan:
    """Value of the next row."""
    v = F.struct(_c(x).alias("v"))
    return Scan(lambda o: F.min_by(v, o), lambda s, w: F.lead(s).over(w),
                lambda w: F.lead(v).over(w), lambda a, b: F.coalesce(a, b)["v"])


def last_valid(x: str | Column, strict: bool = False) -> Scan:
    """Latest non-null value up to this row (``strict``: before it)."""
    v = _c(x)
    end = -1 if strict else 0
    return Scan(lambda o: F.max_by(v, F.when(v.isNotNull(), o)),
                lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*_BEFORE)),
                lambda w: F.last(v, ignorenulls=True).over(w.rowsBetween(_BEFORE[0], end)),
                F.coalesce)


def next_valid(x: str | Column, strict: bool = False) -> Scan:
    """Earliest non-null value from this row on (``strict``: after it)."""
    v = _c(x)
    end = -1 if strict else 0
    return Scan(lambda o: F.min_by(v, F.when(v.isNotNull(), o)),
                lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*_BEFORE)),
                lambda w: F.last(v, ignorenulls=True).over(w.rowsBetween(_BEFORE[0], end)),
                F.coalesce, back=True)


def _running(agg: Callable[[Column], Column], x: str | Column, merge) -> Scan:
    v = _c(x)
    return Scan(lambda o: agg(v), lambda s, w: agg(s).over(w.rowsBetween(*_BEFORE)),
                lambda w: agg(v).over(w.rowsBetween(_BEFORE[0], 0)), merge)


def running_sum(x: str | Column) -> Scan:
    return _running(F.sum, x, lambda a, b: F.coalesce(a + b, a, b))


def running_count() -> Scan:
    return running_sum(F.lit(1).cast("long"))


def running_product(x: str | Column) -> Scan:
    return _running(F.product, x, lambda a, b: F.coalesce(a * b, a, b))


def running_min(x: str | Column) -> Scan:
    return _running(F.min, x, F.least)


def min_before(x: str | Column) -> Scan:
    """Smallest value of the rows before this one."""
    v = _c(x)
    return Scan(lambda o: F.min(v), lambda s, w: F.min(s).over(w.rowsBetween(*_BEFORE)),
                lambda w: F.min(v).over(w.rowsBetween(*_BEFORE)), F.least)


def running_max(x: str | Column) -> Scan:
    return _running(F.max, x, F.greatest)


def scan(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
         specs: Mapping[str, Scan], *, chunk: str | int | Column | Split | None = "1 day",
         keep_chunk: bool = False) -> DataFrame:
    """Append one column per spec, computed along ``order`` within ``keys``.

    ``order`` must be unique per key; its first column is the time unless
    ``chunk`` is a column that is monotone along ``order``. ``keep_chunk`` leaves
    the chunk column in place so that a following scan reuses the partitioning.
    """
    keys, order = cols(keys), cols(order)
    if "_chunk" not in df.columns and is_plain(chunk):
        w = _both_ways(keys, order)
        return df.withColumns({n: s.merge(s.local(w[s.back]), F.lit(None)) for n, s in specs.items()})
    given = "_chunk" in df.columns
    rows = chunk.mark(df) if isinstance(chunk, Split) else df.withColumn("_hot", F.lit(True))
    if not given:
        no = chunk if isinstance(chunk, Column) else bucket_no(order[0], chunk.chunk if isinstance(chunk, Split) else chunk)
        rows = rows.withColumn("_chunk", F.when(F.col("_hot"), no).otherwise(F.lit(0).cast("long")))
    rank = F.struct(*order)  # never NULL, even where the time is
    heads = rows.where("_hot").groupBy(*keys, "_chunk").agg(
        *[s.summary(rank).alias(f"_s_{n}") for n, s in specs.items()])
    across = _both_ways(keys, ["_chunk"])
    carried = heads.select(*keys, "_chunk", *[
        s.carry(F.col(f"_s_{n}"), across[s.back]).alias(f"_k_{n}") for n, s in specs.items()])
    w = _both_ways([*keys, "_chunk"], order)
    out = match(rows, carried, [*keys, "_chunk"], "left")
    kept = [c for c in df.columns if c != "_chunk"] + (["_chunk"] if keep_chunk else [])
    return out.select(*kept, *[
        s.merge(s.local(w[s.back]), F.col(f"_k_{n}")).alias(n) for n, s in specs.items()])


def _both_ways(keys, order) -> tuple[WindowSpec, WindowSpec]:
    """The window along the order and the one against it."""
    w = Window.partitionBy(*keys)
    return w.orderBy(*order), w.orderBy(*[F.desc(c) for c in order])


# ------------------------------------------------------------------------- frames


def row_frames(df: DataFrame, keys, order, before: int, after: int,
               build: Callable[[WindowSpec], Mapping[str, Column]], *,
               chunk: str | int | Column | Split | None = "1 day", block: int = 1 << 18) -> DataFrame:
    """Append frames reaching at most ``before`` rows back and ``after`` ahead."""
    keys, order = cols(keys), cols(order)
    if is_plain(chunk):
        return df.withColumns(dict(build(Window.partitionBy(*keys).orderBy(*order))))
    size = max(block, 8 * (before + after))
    no, zero = F.col("_no") - 1, F.lit(0).cast("long")
    copies = F.sequence(F.greatest(floor_div(no - after, size), zero), floor_div(no + before, size))
    home = floor_div(no, size)
    numbered = scan(df, keys, order, {"_no": running_count()}, chunk=chunk)
    if isinstance(chunk, Split):
        numbered, hot = chunk.mark(numbered), F.col("_hot")
        copies, home = F.when(hot, copies).otherwise(F.array(zero)), F.when(hot, home).otherwise(zero)
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    made = dict(build(w))
    return (spread.select(*df.columns, "_home", "_block", *[c.alias(n) for n, c in made.items()])
            .where("_home = _block").select(*df.columns, *made))


def block_frames(df: DataFrame, keys, order, before: int, after: int, given: Sequence[str], made: str, compute: Callable, *,
                 chunk: str | int | Column | Split | None = "1 day", block: int = 1 << 16) -> DataFrame:
    """Append columns ``made`` (a DDL string) that ``compute`` gives for whole blocks of a series at once.

    ``compute`` gets the columns ``given`` of consecutive rows as numpy arrays, with up to ``before`` rows of context ahead and ``after``
    behind, and returns an array per made column. Blocks are cut and copied as in ``row_frames``, so a task holds one block.
    """
    keys, order = cols(keys), cols(order)
    size = max(block, 8 * (before + after))
    no, zero = F.col("_no") - 1, F.lit(0).cast("long")
    copies = F.sequence(F.greatest(floor_div(no - after, size), zero), floor_div(no + before, size))
    numbered = scan(df, keys, order, {"_no": running_count()}, chunk=chunk)
    spread = numbered.withColumn("_home", floor_div(no, size)).withColumn("_block", F.explode(copies))
    return _computed(spread, keys, "_no", df, given, made, compute)


def time_block_frames(df: DataFrame, keys, ts: str, before: str | int, after: str | int, given: Sequence[str], made: str, compute: Callable) -> DataFrame:
    """Append columns ``made`` that ``compute`` gives for whole blocks of time, cut and copied as in ``time_frames``.

    ``compute`` gets the microseconds (0 where there is no time), whether the block is that of the rows without a time, and the columns ``given``.
    """
    none, us = F.lit(-(1 << 62)).cast("long"), F.col("_us")
    spread = _time_blocks(df, ts, micros(before), micros(after)).withColumns({
        "_home": F.coalesce("_home", none), "_block": F.coalesce("_block", none), "_timeless": us.isNull(), "_us": F.coalesce(us, F.lit(0).cast("long"))})
    return _computed(spread, cols(keys), "_us", df, ["_us", "_timeless", *given], made, compute)


def _computed(spread: DataFrame, keys: list[str], along: str, df: DataFrame, given: Sequence[str], made: str, compute: Callable) -> DataFrame:
    """The columns of ``df`` and those ``compute`` made, for the rows at home in each ``_block``."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(made)
    kept = [f for f in df.schema if f.name.lower() not in {a.name.lower() for a in added}]
    schema = StructType(kept + added.fields)
    names = [f.name for f in kept]
    by = [*keys, "_block"]

    def run(batches):
        out = to_arrow_schema(schema)

        def finish(held):
            t = pa.Table.from_batches(held)
            columns = compute(*[t.column(c).to_numpy() for c in given])
            mine = pa.array(t.column("_home").to_numpy() == t.column("_block").to_numpy())
            whole = pa.Table.from_arrays([*(t.column(n) for n in names), *(pa.chunked_array([c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True)]) for c in columns)], names=out.names)
            yield from whole.filter(mine).cast(out).to_batches()

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in by:
                code = batch.column(batch.schema.get_field_index(k)).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch.column(batch.schema.get_field_index(k))[a].as_py() for k in by)
                if held and key != last:
                    yield from finish(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(held)

    return spread.repartition(*by).sortWithinPartitions(*by, along).mapInArrow(run, schema)


def linear_scan(df: DataFrame, keys, order, given: Column, term: Column, step: Sequence[Sequence[float]], name: str, *, chunk="1 day", block: int = 128,
                levels: int = 2) -> DataFrame:
    """Append the state of the recurrence s' = step s + term, an array of doubles, started at zero.

    ``term`` is an array that may use ``_n``, the number (from 0) of the rows so far for
    which ``given`` holds; the others keep the state. Exact and linear in the rows for
    any step matrix: states inside blocks of ``block`` terms are folded from zero, the
    last state of each full block is one term of the same recurrence with the matrix
    raised to ``block``, and what that gives is added back. After ``levels`` such steps
    the few blocks left of a series are folded at once.
    """
    import numpy as np

    keys, order, a = cols(keys), cols(order), np.asarray(step, float)
    d = df.withColumn("_some", F.when(given, F.lit(1).cast("long")))
    d = scan(d, keys, order, {"_n": running_sum("_some")}, chunk=chunk).withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")) - 1)
    out = _linear(d.withColumn("_term", F.when(given, term)), keys, order, a, name, block, levels)
    return out.withColumn(name, F.when(F.col("_n") >= 0, F.col(name))).select(*df.columns, name)


def _linear(d: DataFrame, keys, order, a, name: str, block: int, levels: int) -> DataFrame:
    import numpy as np

    size = len(a)

    def times(m, s):
        return F.array(*[sum((F.lit(float(m[i][j])) * s[j] for j in range(1, size)), F.lit(float(m[i][0])) * s[0]) for i in range(size)])

    zero = F.array(*[F.lit(0.0)] * size)
    fold = lambda terms: F.aggregate(terms, zero, lambda s, x: F.zip_with(times(a, s), x, lambda p, q: p + q))
    if not levels:
        return d.withColumn(name, fold(F.collect_list("_term").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*(_BEFORE[0], 0)))))
    d = d.withColumns({"_b": floor_div(F.col("_n"), block), "_i": F.pmod("_n", F.lit(block))})
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(_BEFORE[0], 0)
    d = d.withColumn("_local", fold(F.collect_list("_term").over(w)))
    ends = d.where((F.col("_i") == block - 1) & F.col("_term").isNotNull()).select(*keys, F.col("_b").alias("_n"), F.col("_local").alias("_term"))
    carried = _linear(ends, keys, ["_n"], np.linalg.matrix_power(a, block), "_state", block, levels - 1)
    both = match(d, carried.select(*keys, (F.col("_n") + 1).alias("_b"), F.col("_state").alias("_carry")), [*keys, "_b"], "left")
    powers = F.array(*[F.array(*[F.lit(float(x)) for x in np.linalg.matrix_power(a, i + 1).ravel()]) for i in range(block)])
    m = F.element_at(powers, F.col("_i").cast("int") + 1)
    moved = F.array(*[sum((m[i * size + j] * F.col("_carry")[j] for j in range(1, size)), m[i * size] * F.col("_carry")[0]) for i in range(size)])
    state = F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(F.zip_with("_local", moved, lambda p, q: p + q))
    return both.withColumn(name, state).drop("_b", "_i", "_local", "_carry")


def carried(df: DataFrame, keys, order, given: Sequence[str], made: str, start: Callable[[], Callable], *, back: bool = False) -> DataFrame:
    """Append columns ``made`` (a DDL string) of a recurrence that only a pass along each series can compute.

    ``start()`` gives the function for a new series; it gets the columns ``given`` of its next
    rows as numpy arrays and returns one array per made column, and may keep a state. Series are
    dealt out by key and read in order, batch by batch, so no task holds one: its memory
    is a batch and the state. ``back`` runs against the order.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keys, order = cols(keys), cols(order)
    added = StructType.fromDDL(made)
    gone = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in gone]
    at = {f.name: i for i, f in enumerate(kept)}
    schema = StructType(kept + added.fields)
    given, at_keys = [at[c] for c in given], [at[c] for c in keys]

    def run(batches):
        out, last, step = to_arrow_schema(schema), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in at_keys:
                code = batch.column(k).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), n]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch.column(k)[a].as_py() for k in at_keys)
                if step is None or key != last:
                    last, step = key, start()
                parts.append(step(*[batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in given]))
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *columns], out)], schema=out)

    rows = df.select(*[f.name for f in kept])
    rows = rows.repartition(*keys) if keys else rows.repartition(1)
    along = [*keys, *[F.desc(c) for c in order]] if back else [*keys, *order]
    return rows.sortWithinPartitions(*along).mapInArrow(run, schema)


def time_frames(df: DataFrame, keys, ts: str, before: str | int, after: str | int,
                build: Callable[[WindowSpec], Mapping[str, Column]], *,
                chunk: str | int | None = None) -> DataFrame:
    """Append time-range frames. ``build`` gets a window ordered by microseconds.

    The series is cut into chunks eight windows long (at least a day), so about
    an eighth of the rows travels twice and no task holds a whole series.
    """
    keys = cols(keys)
    spread = _time_blocks(df, ts, micros(before), micros(after), chunk)
    made = dict(build(Window.partitionBy(*keys, "_block").orderBy("_us")))
    return (spread.select(*df.columns, "_home", "_block", *[c.alias(n) for n, c in made.items()])
            .where("_home <=> _block").select(*df.columns, *made))


def _time_blocks(df: DataFrame, ts: str, back: int, ahead: int, chunk: str | int | None = None) -> DataFrame:
    width = max(micros(chunk) if chunk else DAY, back + ahead, 8 * (back + ahead) if not chunk else 0)
    t = F.col("_us")
    return (df.withColumn("_us", epoch(ts))
            .withColumn("_home", floor_div(t, width))
            # a row without a time is in the frame of no other, but stays
            .withColumn("_block", F.explode_outer(F.sequence(
                floor_div(t - ahead, width),
                floor_div(t + back, width)))))


# ---------------------------------------------------------------------- quantiles


def value_chunk(x: str | Column) -> Column:
    """Number of a value's bucket: monotone, logarithmic in size, eight thousand buckets per factor e.

    A fixed rule needs no pass over the data and no bounds to hand around, and
    splits a range of any magnitude finely.
    """
    c = _c(x).cast("double")
    size = F.least(F.abs(c), F.lit(1e290)) * 1e9
    return (F.signum(c) * F.floor(F.log1p(size) * 8192)).cast("long")


def value_scan(df: DataFrame, keys, col: str, specs: Mapping[str, Scan], *, chunk="spread", tie=()) -> DataFrame:
    """``scan`` along a numeric column instead of time."""
    if is_plain(chunk):
        return scan(df, keys, [col, *tie], specs, chunk=None)
    part = chunk if isinstance(chunk, Column) else value_chunk(col)
    return scan(df.withColumn("_chunk", part), keys, [col, *tie], specs)


def value_ranks(df: DataFrame, keys, col: str, chunk="spread") -> DataFrame:
    """One row per key and distinct value: count ``n``, rows below ``below``, rows up to it ``upto``."""
    keys = cols(keys)
    merged = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    return value_scan(merged, keys, col, {"upto": running_sum("n")}, chunk=chunk).withColumn("below", F.col("upto") - F.col("n"))


def exact_quantiles(df: DataFrame, keys, col: str, probs: Mapping[str, float], *, chunk="spread") -> DataFrame:
    """Linearly interpolated quantiles per key, one row per key.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer, which suits ordinary keys. For hot ones (all, with ``"spread"``) equal
    values are merged first, counts per value bucket give rank offsets, and only
    values around a wanted rank are picked.
    """
    keys = cols(keys)
    if is_plain(chunk):
        return _built_in(df, keys, col, probs)
    if isinstance(chunk, Split) and chunk.hot is not None:
        d = chunk.mark(df)
        return _built_in(d.where("NOT _hot"), keys, col, probs).unionByName(_by_rank(d.where("_hot"), keys, col, probs)).where(
            F.col(next(iter(probs))).isNotNull() if not keys else F.lit(True))
    return _by_rank(df, keys, col, probs)


def _built_in(df, keys, col, probs):
    q = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(
        F.percentile(F.col(col).cast("double"), F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q"))
    return q.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def _by_rank(df, keys, col, probs):
    ranked = value_ranks(df, keys, col)
    total = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    placed = match(ranked, total, keys) if keys else attach_row(ranked, total)
    wanted = F.array(*[F.struct(F.lit(n).alias("name"),
                                (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
                       for n, p in probs.items()])
    hit = (placed.withColumn("_v", F.col(col).cast("double")).withColumn("_w", F.explode(wanted))
           .withColumn("_f", F.floor("_w.pos")).withColumn("_g", F.ceil("_w.pos"))
           .where(((F.col("below") <= F.col("_f")) & (F.col("_f") < F.col("upto")))
                  | ((F.col("below") <= F.col("_g")) & (F.col("_g") < F.col("upto")))))
    ends = hit.groupBy(*keys).agg(*[
        F.struct(F.min(F.when(F.col("_w.name") == n, F.col("_v"))).alias("a"),
                 F.max(F.when(F.col("_w.name") == n, F.col("_v"))).alias("b"),
                 F.max(F.when(F.col("_w.name") == n, F.col("_w.pos") - F.col("_f"))).alias("t")
                 ).alias(n) for n in probs])
    return ends.select(*keys, *[(F.col(n)["a"] + (F.col(n)["b"] - F.col(n)["a"]) * F.col(n)["t"]).alias(n)
                                for n in probs])


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Append the columns of a one-row result (a global aggregate) to every row as a scalar subquery."""
    row = one.select(F.struct("*").alias("_row")).scalar()
    return df.select("*", row.alias("_row")).select(*df.columns, "_row.*")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
