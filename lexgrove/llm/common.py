"""Helpers shared by the corpus operators: tables, ids, word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.sources.workspace import dropped, stored  # noqa: F401

#: The six ASCII characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_go() -> None:
    """Gives memory that this process has freed back to the system: a worker goes on, and would keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def tidy(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function of a group's rows that lets go of what it took."""

    def tidied(key, rows):
        out = run(key, rows)
        let_go()
        return out

    return tidied


def tidy_both(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The same for the rows of two cogrouped tables."""

    def tidied(key, left, right):
        out = run(key, left, right)
        let_go()
        return out

    return tidied


def slices(batch: pa.RecordBatch, size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about so many bytes of text each, one row at least."""
    total = np.r_[0, np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64))]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def texts_in(column: pa.Array) -> list[str | None]:
    """The texts of an Arrow column; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def id_text(docs: DataFrame, name: str) -> Column:
    """The id as text, so that a null beside it costs a Python stage no digits; id_back undoes it. NULL stays NULL."""
    kind, column = docs.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"the id column {name} is of the type {kind.simpleString()}")
    return column.cast("string")


def id_back(text: Column | str, kind: T.DataType) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    if isinstance(kind, T.BinaryType):
        return F.unhex(column)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(column.cast("long"))
    return column.cast(kind)


def id_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(column.cast("string")) % divisor
