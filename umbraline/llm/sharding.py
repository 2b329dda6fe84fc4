"""Shuffled shards by a two-pass external shuffle.

Pass one scatters rows uniformly into buckets by a seeded hash of all their
columns, so that neither a repeated key nor a repeated text makes a large
bucket; a bucket is sized to fit in a task's memory. Pass two orders each bucket by a
Fisher-Yates permutation seeded with the bucket's number. The buckets laid end
to end are one uniform permutation of the table, which is cut into shards of
equal row counts.

Scale: one shuffle of the rows, into as many partitions as there are buckets (up
to ``PARTITIONS``, whose tasks then take one bucket after the other). Only a
count per bucket is summed beyond it: the table of first positions has a row for
each ``bucket_bytes`` of input.
"""

from __future__ import annotations

from collections.abc import Iterator  # noqa: F401  (types of the Arrow functions)

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 40
SEED = 20_250_101
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16
PARTITIONS = 100_000


def shuffled_shards(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Returns the rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Law: the shards' row counts differ by one at most. The outcome depends on
    the rows, the seed and the sizes only, not on partitions or task order:
    a bucket is put in key order (ties by text and hash) before it is permuted.

    Columns named ``shard`` or ``slot`` are replaced; others pass through.
    Null keys and null texts are rows like others; rows that are equal in all
    columns are interchangeable, and share a bucket. An empty table gives an
    empty result.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    k, t = names[columns.index(key)], names[columns.index(text)]
    total = rows.agg(F.sum(F.octet_length(F.coalesce(F.col(t).cast("string"), F.lit(""))) + ROW_BYTES)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    whole = [n for n in names if "map<" not in rows.schema[n].dataType.simpleString()]  # maps have no hash
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), *whole)).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").count()
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("bucket", F.coalesce(F.sum("count").over(everything), F.lit(0)).alias("first"))
    n_rows = counts.agg(F.sum("count")).first()[0] or 0
    bounds = np.array([s * n_rows // shards for s in range(shards + 1)], dtype=np.int64)
    schema = T.StructType(
        [T.StructField(n, rows.schema[n].dataType) for n in names] + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )

    def permute(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([(k, "ascending"), (t, "ascending"), ("hash", "ascending")])
        number, first = bucket["bucket"][0].as_py(), bucket["first"][0].as_py()
        # numpy's permutation is a Fisher-Yates shuffle
        order = np.random.Generator(np.random.PCG64([seed, number])).permutation(bucket.num_rows)
        place = first + np.arange(bucket.num_rows, dtype=np.int64)
        shard = np.searchsorted(bounds, place, side="right") - 1
        bucket = bucket.select(names).take(pa.array(order))
        bucket = bucket.append_column("shard", pa.array(shard, pa.int32()))
        return bucket.append_column("slot", pa.array(place - bounds[shard], pa.int64()))

    dealt = rows.join(F.broadcast(firsts) if buckets <= PARTITIONS else firsts, "bucket").repartition(int(min(buckets, PARTITIONS)), "bucket")
    out = dealt.groupBy("bucket").applyInArrow(permute, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], "shard", "slot")


def digest(sharded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``size`` (UTF-8 bytes and ``ROW_BYTES``), ``text_crc32``, ``law``, shard, slot and ``grown_shard`` (null, as the law is not by key)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return sharded.select(
        key, (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shuffled shards as Parquet folders ``shard=0`` and so on; order within a shard is ``slot``."""
    shuffled_shards(docs, **options).write.partitionBy("shard").parquet(path)
