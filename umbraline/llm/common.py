"""Shared pieces of the training-data operators: words, hashes, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import passing, remove_at_exit, scratch, scratch_dir  # noqa: F401  the operators take them from here

#: ASCII white space as the operators' contracts define it, as a regex class body.
SPACE = r"\x20\x09-\x0D"
SPACES = f"[{SPACE}]+"
WORD = f"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, as ``str.lower`` would also change other scripts."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def let(value: Column, body) -> Column:
    """Binds ``value`` once for use in ``body``, so that lambdas do not compute it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20, row: int = 64) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts, with ``row`` bytes more for each, have about ``size`` bytes, one row at least, so that work on them has bounded memory."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + row)
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        # copied out: kernels that cast strings misread the offsets of a slice
        yield batch.take(pa.array(np.arange(start, stop)))
        start = stop


def release() -> None:
    """Gives memory that a worker has freed back to the machine; workers idle between tasks beside their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a column that tells its rows apart, equal rows too, and the column's name.

    A file's rows have their file and place. A table that is no plain read of
    files is written to the shared folder first, as its rows may come in
    another order when they are computed again.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"row_id{i or ''}" for i in range(len(taken) + 1)) if n not in taken)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # a source without places
            own = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
            return docs.withColumn(name, own), name
    own = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))
    columns = [f"c{i}" for i in range(len(docs.columns))]  # any names, equal but for their case too
    rows = scratch(docs.toDF(*columns).withColumn(name, own), "numbered")
    return rows.toDF(*docs.columns, name), name


def without(docs: DataFrame, own: str, gone: DataFrame) -> DataFrame:
    """The rows whose row id is not in the one column of ``gone``, without that id."""
    gone = gone.toDF("gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != own]).alias("row"), F.col(own).alias("own"))
    rows = rows.join(gone, F.col("own") == F.col("gone"), "left_anti")
    return rows.select("row.*")
