import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_mixing import brute_slots  # noqa: E402
from test_near_dedup import WORD, shingles  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from umbraline.llm import exact_dedup, langid, mixing, near_dedup, pieces  # noqa: E402
from umbraline.llm.common import crc_mod  # noqa: E402


def test_stages_on_their_own_inputs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(stage(spark, seen[-1], small).cache())
    before, named, exact, near, mixed, coded = seen
    for df in (named, exact, near, mixed):
        assert df.columns == docs.columns
    letters = [r.doc_id for r in before.filter(r"text rlike '\\p{L}'").collect()]
    assert sorted(r.doc_id for r in named.collect()) == sorted(letters)
    kept = exact_dedup.exact_groups(named).filter("kept")
    assert sorted(r.doc_id for r in exact.collect()) == sorted(r.doc_id for r in kept.collect())
    kept = near_dedup.near_groups(exact).filter("kept")
    assert sorted(r.doc_id for r in near.collect()) == sorted(r.doc_id for r in kept.collect())
    ids = {r.doc_id for r in near.collect()}
    assert {r.doc_id for r in mixed.collect()} <= ids and mixed.groupBy("doc_id").count().filter("count > 2").count() == 0
    assert coded.count() == mixed.count() and coded.filter("not lossless").count() == 0


def test_language_id_decides(spark, small):
    """Gibberish and contradicted labels go; clean, short and unlearned ones stay, and a missing label is filled."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    of = {r.lang: r.text for r in docs.filter("length(text) > 2000 and lang in ('en', 'de', 'fr')").orderBy("doc_id").collect()}
    r = random.Random(1)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(600))
    mixed = "".join(r.sample(of["en"], 1500))
    cases = [(of["fr"], "de"), (of["en"], "fr"), (noise, "en"), (mixed, "en"), (noise, None)]
    stay = [(of["en"], "en"), (of["de"], "de"), (of["fr"], None), (of["fr"][:40], "de"), (of["en"], "xx"), (noise[:60], "en")]
    # the cases are no labelled text to learn from: only keys of the held-out remainder are planted
    keys = [k for k in range(10_000_000, 10_001_000) if zlib.crc32(str(k).encode()) % 4 == P.HELD_OUT]
    planted = [(k, t, lang, "s", len(t)) for k, (t, lang) in zip(keys, cases + stay)]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {x.doc_id: x.lang for x in P.language_id(spark, both, small).collect()}
    assert [k in got for k in keys[: len(planted)]] == [False] * len(cases) + [True] * len(stay)
    assert got[keys[len(cases) + 2]] == "fr"
    assert len(got) == docs.filter(r"text rlike '\\p{L}'").count() + len(stay)


def test_stages_against_lists(spark, odd, empty):
    """All stages by plain code over lists, with repeated and null keys, equal rows, nulls in all columns and columns of clashing names."""
    columns = odd.columns
    docs = odd
    model = langid.fit(odd.filter(crc_mod(F.col("doc_id"), 4) != P.HELD_OUT))

    def named(rows):
        for r in rows:
            if not any(c.isalpha() for c in r.text or ""):
                continue
            (lang,), (score,), (disorder,), (size,) = model.judge([r.text])
            sure = r.lang is None or model.sizes.get(r.lang, 0) >= P.MIN_LEARNED
            bad = (disorder >= P.MAX_DISORDER and sure and max(model.sizes.values()) >= P.MIN_LEARNED) or (r.lang in model.sizes and r.lang != lang and score >= P.CONTRADICTION)
            if size < P.MIN_LETTERS or not bad:
                yield Row(**(r.asDict() | {"lang": r.lang or lang}))

    def one_each(rows, group):
        best = {}
        for i, r in enumerate(rows):
            g = (r.doc_id is None, r.doc_id or 0)
            if group[i] not in best or g < best[group[i]][0]:
                best[group[i]] = (g, r)
        return [r for _, r in best.values()]

    def exact(rows):
        return one_each(rows, [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows])

    def near(rows):
        return one_each(rows, components([r.text for r in rows], 5))

    for (name, stage), by_list in zip(P.STAGES[:3], (lambda rows: list(named(rows)), exact, near)):
        rows = docs.collect()
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns, name
        # rows of one key that tie may stay for each other: what is compared is what the tie leaves open, key and text
        a, b = ([(str(r.doc_id), re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in x] for x in (docs.collect(), by_list(rows)))
        assert sorted(a) == sorted(b), name
    rows = docs.collect()
    took = {(k, n): (2 * t + n) // (2 * n) if n else 0 for k, n, t, _, _ in brute_slots(rows, mixing.BLOCK)}
    docs = P.mix(spark, docs, "").cache()
    want = Counter({(str(r.doc_id), r.text): took[str(r.doc_id), len(WORD.findall(r.text or ""))] for r in rows})
    assert Counter((str(r.doc_id), r.text) for r in docs.collect()) == +want
    rows = docs.collect()
    coded = P.encode(spark, docs, "").collect()
    vocabulary = pieces.load(public_tokenizers.path(P.TOKENIZER))
    assert all(r.lossless and r.n_pieces == len(r.ids or []) for r in coded)
    assert Counter((str(r.doc_id), pieces.join(vocabulary, r.ids)) for r in coded) == Counter((str(r.doc_id), r.text) for r in rows)


def components(texts, width):
    sets, up = [shingles(t, width) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def test_run_leaves_its_result_only(spark, small):
    got = P.run(spark, small)
    assert got.count() > 100 and got.filter("not lossless").isEmpty()
    assert {"doc_id", "ids", "n_pieces"} <= set(got.columns)


def test_empty(spark, empty):
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
