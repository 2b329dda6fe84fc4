import random

from pyspark.sql import functions as F

from umbraline.llm import langid
from umbraline.llm.common import crc_mod


def phrases(text: bytes, reference: bytes) -> int:
    """Greedy longest matches, by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in reference:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_parse_against_substring_search():
    samples = {"a": b" the house in the green garden by the river", "b": b" der garten am fluss und das haus"}
    model = langid.Model(samples)
    texts = ["the garden", "das haus der", "zebra the", "the house in the green garden by the river", "x"]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [phrases(langid.letters(t), samples[x]) for x in model.langs]


def test_long_texts_against_substring_search(monkeypatch):
    """Phrases reach over blocks; texts that repeat themselves never meet the walk from a block's start."""
    r = random.Random(2)
    words = "the house in a green garden by river und das haus am fluss q ".split(" ")
    samples = {"a": b" the house in the green garden by the river aaaa", "b": b" der garten am fluss und das haus abab", "c": b"zz"}
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (5, 40, 300)] + ["a" * 700, "ab" * 333, "the house " * 60, "z", ""]
    for block in (1, 7, 16, 64, 1024):
        monkeypatch.setattr(langid, "BLOCK", block)
        model = langid.Model(samples)
        got = model.phrases(texts)
        for i, t in enumerate(texts):
            assert got[i].tolist() == [phrases(langid.letters(t), samples[x]) for x in model.langs]


def test_bounded_model(monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 1 << 20)
    r = random.Random(3)
    model = langid.Model({f"l{i}": "".join(r.choice("abcdefgh ") for _ in range(9000)).encode() for i in range(10)})
    assert sum(t.nbytes for t in model.tables) <= 1 << 20


def test_repeated_and_null_keys(spark):
    """Rows are no keys: each counts, with null texts, null languages and rows that repeat."""
    en, de = "the house in the green garden by the river ", "der garten am fluss und das haus im gruenen "
    rows = [(None, en * 3, "en"), (None, de * 3, "de"), (None, None, "en"), (1, de * 2, "de"), (1, None, "de"), (1, en * 2, None), (1, "12", "fr")] + [(2, en, "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, rows=4)
    assert model.langs == ["de", "en"]
    got = langid.identify(df, model, keep=["lang"]).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got if r.lang and r.n_letters > 20)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    got = langid.held_out(langid.identify(docs, model)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95


def test_odd_tables(odd, empty):
    model = langid.fit(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k in (100, 101, 102, 103):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[1].lang_pred == "en" and by[0].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_many_blocks_equal_their_sum():
    model = langid.Model({"a": b" the house", "b": b" das haus"})
    long = "the house " * 1000
    assert (model.phrases([long, "das"])[0] == model.phrases([long])[0]).all()


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than fit the sample: their shares shrink, none is left out, in and beyond the broadcast of their bounds."""
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 300 * 20)
    rows = [(i, f"l{i % 300:03d}", f"{chr(0x4E00 + i % 300)}{chr(0x5E00 + i % 300)} " * 8) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for most in (65_536, 10):
        monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", most)
        model = langid.fit(docs)
        assert model.langs == sorted({r[1] for r in rows}) and max(model.sizes.values()) <= 20 + 2  # a space before each row
        assert langid.identify(docs, model, keep=["lang"]).filter("lang != lang_pred").count() == 0
