"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts take about ``limit`` bytes; one longer text is a piece of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_texts(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[pa.Array], Sequence]],
              drop: Sequence[str] = (), limit: int = SLICE_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """Append the columns ``fields`` (a DDL string) that Python computes from a text column.

    ``make()`` runs once per task and returns the function that gets the texts of
    a bounded piece as an Arrow array and returns one array or list per field.
    ``done()`` runs when a task has ended.
    Input columns named like a result (in any case) or in ``drop`` are left out.
    """
    added = StructType.fromDDL(fields)
    gone = {f.name.lower() for f in added} | {c.lower() for c in drop}
    kept = [f for f in df.schema if f.name.lower() not in gone]
    schema = StructType(kept + added.fields)
    names = [f.name for f in kept]
    whole = "__text"
    while whole.lower() in {n.lower() for n in names}:  # a column may be called so
        whole += "_"
    inputs = df.select(*[F.col(quoted(n)) for n in names], F.col(quoted(text)).cast("string").alias(whole))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        each = make()
        for batch in batches:
            for piece in slices(batch, whole, limit):
                made = each(piece.column(whole))
                columns = [piece.column(i) for i in range(len(names))]
                columns += [m if isinstance(m, pa.Array) else pa.array(m, out.field(len(names) + i).type)
                            for i, m in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(out.field(i).type) for i, c in enumerate(columns)], schema=out)
        if done:
            done()

    return inputs.mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenized(texts: pa.Array, fold: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, runs of bytes other than white space, as one binary array, and where each text begins and ends in it.

    With ``fold`` the letters A-Z count as a-z.
    """
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = SPACE[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:], after[:-1] = gap, gap
    before[at], after[at] = True, True  # a text ends a word
    begin = np.flatnonzero(~gap & before[:-1])
    end = np.flatnonzero(~gap & after[1:]) + 1
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~gap]))])
    return words, np.searchsorted(begin, at)
