import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from umbraline.llm.sharding import SEED, digest, shuffled_shards, write_shards


def test_law_of_rows(odd):
    got = shuffled_shards(odd, shards=7, bucket_bytes=4_000).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == odd.count()
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in odd.collect())


def test_same_outcome_however_rows_are_dealt(odd):
    key = lambda df: sorted((str(r.doc_id), str(r.text), r["shard"], r.slot) for r in df.collect())
    a = key(shuffled_shards(odd, shards=5, bucket_bytes=4_000))
    assert a == key(shuffled_shards(odd.repartition(7), shards=5, bucket_bytes=4_000))
    assert a != key(shuffled_shards(odd, shards=5, bucket_bytes=4_000, seed=3))


def test_more_shards_than_rows_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.slot for r in shuffled_shards(df).collect()) == [0, 0]
    assert shuffled_shards(empty).count() == 0


def test_it_shuffles(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    rows = sorted(shuffled_shards(df, shards=4, bucket_bytes=10_000).collect(), key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in rows]
    assert sum(abs(a - b) for a, b in zip(ids, ids[1:])) / len(ids) > 1000  # about a third of the range, as for a random order


def test_files(spark, tmp_path):
    df = spark.range(50).selectExpr("id as doc_id", "'t' as text")
    write_shards(df, str(tmp_path / "out"), shards=5)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().filter("count = 10").count() == 5


def brute(rows, total, shards, bucket_bytes):
    """All buckets as lists in one process: rows (hash, key, text), permuted and laid end to end."""
    n = max(1, -(-total // bucket_bytes))
    buckets = {}
    for h, k, t in rows:
        buckets.setdefault(h % n, []).append((k is None, k, t is None, t, h))
    line = []
    for b in sorted(buckets):
        own = sorted(buckets[b], key=lambda r: (r[0], r[1] or 0, r[2], r[3] or "", r[4]))
        line += [own[i] for i in np.random.Generator(np.random.PCG64([SEED, b])).permutation(len(own))]
    ends = [s * len(line) // shards for s in range(shards + 1)]
    out = []
    for s in range(shards):
        for slot, (_, k, _, t, _) in enumerate(line[ends[s] : ends[s + 1]]):
            body = (t or "").encode()
            out.append((k, len(body) + 16, zlib.crc32(body), "rows", s, slot, None))
    return sorted(out, key=str)


def test_digest_against_lists(odd, spark, small):
    for docs, size in ((odd.select("doc_id", "text"), 4_000), (spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), 100_000)):
        rows = [tuple(r) for r in docs.select(F.xxhash64(F.lit(SEED), "doc_id", "text"), "doc_id", "text").collect()]
        total = sum(len((t or "").encode()) + 16 for _, _, t in rows)
        got = digest(shuffled_shards(docs, shards=7, bucket_bytes=size))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, total, 7, size)


def test_hot_key_and_hot_text_are_spread(spark):
    """One key, or one text, of all rows makes no large bucket."""
    for cols in (("cast(null as long) as doc_id", "concat('t', id) as text"), ("id as doc_id", "'t' as text")):
        df = spark.range(3000).selectExpr(*cols)
        n, total = 30, 3000 * 21
        sizes = df.groupBy(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(n))).count().agg(F.max("count"))
        assert sizes.first()[0] < 200
        assert shuffled_shards(df, shards=4, bucket_bytes=total // n).groupBy("shard").count().filter("count = 750").count() == 4
