"""Tables that an operator writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, the folder that all executors share.

    Where that setting is absent (local tests), a temporary folder takes its
    place, which is right only as driver and executors are one process there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_MADE: list[str] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage.

    Lost executors then cost a read, not a recomputation. The folder is removed
    when the driver ends, or by ``passing``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    _MADE.append(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """At its end, removes the scratch tables that were made inside; what is read later must have been written elsewhere by then."""
    first = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[first:]:
            _remove(spark, path)
        del _MADE[first:]


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place.getParent(), True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            _remove(spark, path)

    atexit.register(remove)
