import hashlib
import re

from pyspark.sql import functions as F

from umbraline.llm.exact_dedup import drop_exact, exact_groups


def brute(rows):
    groups = {}
    norm = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for k, t in rows]
    for k, t in norm:
        groups.setdefault(t, []).append(k)
    out, had = [], set()
    for k, t in norm:
        keys = [x for x in groups[t] if x is not None]
        keep = min(keys) if keys else None
        out.append((k, keep, len(groups[t]), k == keep and t not in had, hashlib.sha256(t.encode()).hexdigest()))
        if k == keep:
            had.add(t)
    return sorted(out, key=str)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, exact_groups(odd).collect()), key=str) == brute(rows)


def test_empty(empty):
    assert exact_groups(empty).count() == 0 and drop_exact(empty).count() == 0


def test_late_differences_and_equal_prefixes(spark):
    base = "a" * 70_000
    texts = [base, base + "b", base + "c", base, base[:64], base[:65], base[:1088], base[:1089], base[:-1] + "z", base[:-1] + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for first in (1, 64):
        assert sorted(map(tuple, exact_groups(df, first=first).collect()), key=str) == brute(list(enumerate(texts)))


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 50)).otherwise(F.concat(F.lit("t" * 80), F.col("id").cast("string"))).alias("text"))
    got = exact_groups(df)
    assert got.filter("kept").count() == 2001
    assert got.agg(F.max("group_size")).first()[0] == 1000
    assert drop_exact(df).count() == 2001


def test_repeated_key_with_other_texts(spark):
    """Two groups that share their least key stay apart."""
    a, b = "p" * 64 + "1" * 100, "q" * 64 + "1" * 100
    rows = [(1, a), (1, b), (2, a), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_groups(df).collect()), key=str) == brute(rows)


def test_drop_goes_by_row(spark, tmp_path):
    """Repeated and null keys lose no text, and equal rows leave one, from files and from other tables."""
    rows = [(1, "B", 1), (5, "A", 2), (5, "B", 3), (None, "C", 4), (None, "B", 5), (7, "D", 6), (7, "D", 6), (None, None, 7), (None, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_id long").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = drop_exact(docs)
        assert got.columns == docs.columns
        assert sorted(r.text or "" for r in got.collect()) == ["", "A", "B", "C", "D"]
        assert {(r.doc_id, r.text) for r in got.collect()} >= {(1, "B"), (5, "A"), (None, "C"), (7, "D")}
