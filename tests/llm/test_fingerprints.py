import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from umbraline.llm import fingerprints as fp

PARAGRAPH = re.compile(r"[^\n.!?]{1,160}[ \t\n\x0b\f\r.!?]*|[\n.!?]+")


def paragraphs(t):
    return set(PARAGRAPH.findall(t))


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df):
    """Likeness equals that of the paragraphs' sets, whatever sketches it took."""
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])
    want = {}
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after), edited)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert got.keys() == want.keys()
    prints = {}
    for k, r in got.items():
        n, sha, near_edited, near_next, edited = want[k]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near_edited, abs=1e-12) and r.near_next == pytest.approx(near_next, abs=1e-12)
        for text, own in ((dict(rows)[k], r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, own) == own
    assert len(set(prints.values())) == len({frozenset(paragraphs(t)) for t in prints})


def test_driver_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_sizes_and_scripts(spark):
    """Texts from none to thousands of paragraphs, alike and not, in several scripts; equal neighbours, one paragraph a thousand times."""
    r = random.Random(3)
    line = lambda: " ".join(r.choice("alpha βeta 한글 𝔘x gamma, delta".split()) + str(r.randrange(999)) for _ in range(r.randint(1, 40)))
    rows, text = [], ""
    for i in range(90):
        if i % 5:
            text += "".join(line() + r.choice(["\n", ". ", "! ", "?\n\n"]) for _ in range(r.choice([1, 3, 40])))
        elif i % 2:
            text = line()
        rows.append(text)
    rows += [None, "", "", ".", "...", "\n\n", "same. " * 1000, "same. " * 1001, "x" * 5000, "é" * 3, "ab", "abc", "abcd", "abcde"]
    rows += ["".join(f"{r.random()}. " for _ in range(6000)), "".join(f"{r.random()}. " for _ in range(5000))]
    check(spark.createDataFrame([(i * 3, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5))


def test_odd_rows(odd):
    """Null and repeated keys, equal rows: one result for each row, next ones in a circle."""
    got = fp.fingerprints(odd).collect()
    assert len(got) == odd.count()
    some = [r for r in got if r.doc_id is not None]
    later = sorted({r.doc_id for r in some})
    for r in some:
        assert r.next_key in (r.doc_id, None) or r.next_key == next(x for x in [*later, later[0]] if x > r.doc_id)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_empty_and_single(spark, empty):
    assert fp.fingerprints(empty).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(5, "One. Two. Three. Four.")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.next_key, r.near_next) for r in one] == [(5, 5, 1.0)]


def test_order_over_ranges(spark, small, monkeypatch):
    """Each row is followed by the next one, also over the ends of ranges."""
    docs = spark.range(0, 500).selectExpr("cast((id * 37) % 500 as long) as k", "string(id % 3) as t", "id as own").repartition(6)
    got = {r.own: r.next for r in fp.next_rows(docs, "own", "k", "t").collect()}
    keys = {r.own: r.k for r in docs.collect()}
    assert sorted(got) == sorted(got.values()) == sorted(keys)
    assert all(keys[b] == (keys[a] + 1) % 500 for a, b in got.items())


def test_larger_sketches_and_failures(spark):
    """A full sketch tells that it fails; larger ones give the difference; an emptied one has nothing left."""
    rows = [(n, [f"a{i}" for i in range(n)], [f"a{i}" for i in range(n // 2, n + n // 3)]) for n in (0, 1, 4, 9, 30, 200, 3000)]
    df = spark.createDataFrame(rows, "n int, a array<string>, b array<string>")
    df = df.select("n", *[F.array_sort(F.transform(c, lambda x: fp._digest(F.xxhash64(x)))).alias(c) for c in "ab"])
    df = df.withColumns({"sa": fp.base_sketch(F.col("a")), "sb": fp.base_sketch(F.col("b"))})
    first = fp.peeled(fp.subtracted(F.col("sa"), F.col("sb")), F.lit(fp.CELLS), F.lit(0))
    got = df.select("n", first.alias("first"), fp.difference(*[F.col(c) for c in ("a", "b", "sa", "sb")]).alias("d"), fp._block_difference(F.col("a"), F.col("b")).alias("block")).collect()
    for r in got:
        want = r.n // 2 + r.n // 3
        assert r.d == want and r.block == want and r.first in (want, None)
    assert {r.n for r in got if r["first"] is None} >= {200, 3000}
