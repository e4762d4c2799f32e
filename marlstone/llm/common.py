"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.stages import checkpointed, kept, kept_buckets, shared_folder  # noqa: F401

#: The bytes that end a word; ``bytes.split()`` splits on exactly these.
WHITESPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that a task holds as Python objects at once, unless one text alone is longer.
SLICE = 1 << 20
#: Rows that Spark hands to Python at once: it holds them all outside its heap, and so does the worker.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns named, whatever the case in which they are written."""
    low = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in low])


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, written as it is or else, as Spark reads names, in another case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as no column of ``df`` bears it."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name += "_"
    return name


def _comparable(c: Column, kind: T.DataType) -> Column:
    """``c`` with maps as their entries in order and variants as text, so that equal values have equal hashes."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_comparable(e["key"], kind.keyType).alias("key"), _comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _comparable(x, kind.elementType)) if _unordered(kind) else c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_comparable(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])) if _unordered(kind) else c
    return F.to_json(c) if isinstance(kind, T.VariantType) else c


def _unordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of ``df``, maps and variants included at any depth; equal rows have equal ones."""
    return F.xxhash64(*[_comparable(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields])


def text_slices(batch: pa.RecordBatch, column: int, size: int = SLICE):
    """The rows of a batch, whole and in order, in slices of about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(part)]):
        yield batch.slice(lo, hi - lo)


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive the task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Have this session hand whole texts to Python in batches of ``BATCH_ROWS`` rows at most; fewer, if set, stay so.

    Spark's 10,000 rows are some 30 MB of texts in each task, beside as much in its worker. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def append_columns(df: DataFrame, text_col: str, fields: Sequence[T.StructField], factory: Callable[[], Callable]) -> DataFrame:
    """``df`` with columns computed from the whole texts of ``text_col``, without a shuffle.

    ``factory()`` runs once per task and gives a function from a list of UTF-8 byte strings (null: empty) to one
    list or array per field. Columns of ``df`` that bear the name of a computed one are replaced.
    """
    bounded_batches(df.sparkSession)
    base = without(df, [f.name for f in fields if f.name.lower() != text_col.lower()])
    plain = base.toDF(*[f"c{i}" for i in range(len(base.columns))])  # Spark's Python operators cannot name a column with a dot
    schema = T.StructType([*plain.schema.fields, *fields])
    arrow = to_arrow_schema(T.StructType(list(fields)))
    names = schema.fieldNames()
    at = place_of(base, text_col)

    def run(batches):
        compute = factory()
        for b in (part for whole in batches for part in text_slices(whole, at)):
            texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            got = compute(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, type=f.type) for x, f in zip(got, arrow, strict=True))], names=names)
        del compute
        release()

    return plain.mapInArrow(run, schema).toDF(*base.columns, *(f.name for f in fields))


def sorted_groups(batches, keys: Sequence[str]):
    """Cut a stream of record batches that is sorted by ``keys`` so that no run of equal keys spans two tables.

    Memory is bounded by one batch plus the largest run.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        first_key = tuple(b.column(k)[0].as_py() for k in keys)
        end_key = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
        cut = _start_of(b, keys, end_key)
        if held and first_key != last:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
        last = end_key
    if held:
        yield pa.Table.from_batches(held)


def _start_of(b: pa.RecordBatch, keys: Sequence[str], key: tuple) -> int:
    """The first row of a sorted batch that holds ``key``, its last one."""
    lo, hi = 0, b.num_rows - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if tuple(b.column(k)[mid].as_py() for k in keys) == key:
            hi = mid
        else:
            lo = mid + 1
    return lo
