import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from umbraline.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(key, text):
    t = text or ""
    u = UNIT.findall(t)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(u)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return key, n, form, len(p), len(m), sha(out), sha(t)


def check(df):
    got = sorted(map(tuple, infill.digest(infill.infill(df)).collect()), key=str)
    assert got == sorted((brute(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_odd_rows(odd):
    check(odd)


def test_empty(empty):
    assert infill.infill(empty).count() == 0


def test_driver_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_edges(spark):
    texts = ["a", "é", "aé", "éa", "한글 text", "𝔘x", "<", "<P", "x<S>y", "a<M", ">S<", "\n\r\t", "ÀB", "a1b2", "z" * 300_000, "é" * 100_001, "a " * 200_000, "\x00a\x00"]
    check(spark.createDataFrame([(i * 37 + j, t) for i, t in enumerate(texts) for j in range(9)], "doc_id long, text string"))


def test_select_and_units():
    r = random.Random(2)
    for size in (1, 2, 63, 64, 65, 1000):
        bits = r.getrandbits(size) | 1 << (size - 1)
        places = [i for i in range(size) if bits >> i & 1]
        assert [infill.select(bits, k) for k in range(len(places))] == places
    for _ in range(300):
        t = "".join(r.choice("aZ é한𝔘.\n0") for _ in range(r.randrange(40)))
        ends = [len(t[: m.start()].encode()) for m in UNIT.finditer(t)]
        assert infill.units(t.encode()) == sum(1 << e for e in ends)


def test_shares_marks_and_kept_columns(odd):
    got = infill.infill(odd, keep=["lang", "n", "bucket"], seed=7, plain=0, spm=100, marks=infill.Marks("[p]", "[s]", "[m]"))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "lang", "n", "bucket"]
    rows = got.select("doc_id", "form", "output").collect()
    assert len(rows) == odd.count() and {r.form for r in rows} == {"plain", "spm"}
    back = got.select("output", infill.restored(F.col("output"), F.col("form"), infill.Marks("[p]", "[s]", "[m]")).alias("t"))
    assert sorted(r.t for r in back.collect()) == sorted(r.text or "" for r in odd.select("text").collect())


@pytest.mark.parametrize("marks", [("", "b", "c"), ("ab", "ba", "c"), ("aa", "b", "c"), ("x", "xy", "z"), ("a", "a", "b")])
def test_marks_that_overlap(marks):
    with pytest.raises(ValueError):
        infill.Marks(*marks)
