import math
import random
import re
import unicodedata
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from umbraline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0.0, kl(p) + kl(q)) / 2)


def classes(t):
    solid = "".join(WORD.findall(t or ""))
    digits, symbols = sum(c in "0123456789" for c in solid), sum(c in quality.SYMBOLS for c in solid)
    letters = sum(unicodedata.category(c)[0] == "L" for c in solid)
    return [letters, digits, symbols, len(solid) - letters - digits - symbols]


def brute_references(docs):
    """Each language's common words with their shares of all words, and class shares, from plain counts."""
    out = {}
    for lang in sorted({r.lang for r in docs if r.lang is not None}):
        own = [r for r in docs if r.lang == lang]
        whole = [r for r in own if len(WORD.findall(r.text or "")) >= quality.MIN_WORDS]
        if not whole:
            continue
        count, bits = Counter(), {}
        for r in own:
            bit = 0 if r.text is None else xxhash.xxh64_intdigest(r.text.encode(), 42) % 64
            for w in WORD.findall(r.text or ""):
                count[w] += 1
                bits.setdefault(w, set()).add(bit)
        usual = sorted((w for w in count if len(bits[w]) >= quality.MIN_TEXTS and any(unicodedata.category(c)[0] == "L" for c in w)), key=lambda w: (-count[w], w.encode()))[: quality.WIDE]
        total, shape = sum(count.values()), [sum(x) for x in zip(*(classes(r.text) for r in whole))]
        out[lang] = ([(w, count[w] / total) for w in usual], [x / sum(shape) for x in shape])
    return out


def brute_kept(text, refs):
    n, _, _, _, repeated = base(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False
    count, shape = Counter(WORD.findall(text)), classes(text)
    for common, class_shares in refs.values():
        head, more = common[: quality.COMMON], common[quality.COMMON :]
        q = [x for _, x in head] + [sum(x for _, x in more)]
        q.append(max(0.0, 1 - sum(q)))
        p = [count[w] / n for w, _ in head] + [sum(count[w] for w, _ in more) / n]
        p.append(max(0.0, 1 - sum(p)))
        none = [0.0] * (len(q) - 1) + [1.0]
        bound = min(quality.MAX_WORD_DISTANCE, quality.MAX_OF_ZERO * js(none, q))
        if js([x / sum(shape) for x in shape], class_shares) <= quality.MAX_CLASS_DISTANCE and js(p, q) <= bound + 1e-12:
            return True
    return not refs


def test_kept_against_plain_counts(spark, odd, small):
    for table in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = table.collect()
        refs = brute_references(rows)
        found = quality.references(table)
        assert [(r["lang"], len(r["words"]) + len(r["more"])) for r in found] == [(x, len(c)) for x, (c, _) in refs.items()]
        got = sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.quality(table, found).collect())
        assert got == sorted((str(r.doc_id), len(WORD.findall(r.text or "")), brute_kept(r.text or "", refs)) for r in rows)


def test_every_language_is_judged(spark):
    """A text beyond the word bound of the nearest language, and within both bounds of another one, stays."""
    one = {"lang": "a", "words": [], "shares": [], "more": [], "more_share": 0.0, "classes": [1.0, 0.0, 0.0, 0.0]}
    words = [f"w{chr(97 + i)}" for i in range(10)]
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    near = one | {"lang": "b", "words": hashes, "shares": [0.06] * 10, "classes": [0.8, 0.2, 0.0, 0.0]}
    df = spark.createDataFrame([(1, " ".join(words[:5] + [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]))], "doc_id long, text string")
    assert not quality.quality(df, [near | {"classes": [1.0, 0.0, 0.0, 0.0]}], max_word=0.2).first().kept
    assert quality.quality(df, [near, one | {"classes": [0.95, 0.05, 0.0, 0.0]}], max_word=0.2).first().kept


def test_cost_of_languages(spark):
    """One lookup a word: forty references are judged by the same words as one."""
    refs = [{"lang": f"l{i}", "words": list(range(i * 24, i * 24 + 24)), "shares": [0.01] * 24, "more": [], "more_share": 0.0, "classes": [1.0, 0.0, 0.0, 0.0]} for i in range(40)]
    df = spark.range(20).selectExpr("id as doc_id", "repeat('some words of a text ', 100) as text")
    assert quality.quality(df, refs).count() == 20


def test_base_counts(odd):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(odd, []).collect())
    assert got == sorted((str(r.doc_id), *base(r.text)) for r in odd.collect())


def test_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b c x a b c", "a b", "", "l1 w\nl1 w\n\n \nl1 w", "x | y # <z>", "a b c d a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(df, []).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_distance(spark):
    for counts, shares in (([1, 1], [0.5, 0.5]), ([4, 0], [0.0, 1.0]), ([3, 1, 0], [0.2, 0.3, 0.5])):
        got = spark.range(1).select(quality.distance(F.array(*[F.lit(float(c)) for c in counts]), shares)).first()[0]
        assert got == pytest.approx(js([c / sum(counts) for c in counts], shares), abs=1e-6)
    assert spark.range(1).select(quality.distance(F.array(F.lit(0.0)), [1.0])).first()[0] is None


def test_junk_goes_and_prose_stays(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    refs = quality.references(docs)
    clean = docs.filter("length(text) > 2000").limit(5).selectExpr("doc_id + 1000 as doc_id", "text", "lang").collect()
    junk = [(2000, " | ".join(f"x{i}" for i in range(200)), "en"), (2001, " ".join(f"{i}$$$ {i}###" for i in range(100)), "en"), (2002, " ".join(str(i) for i in range(300)), "de")]
    both = spark.createDataFrame([tuple(r) for r in clean] + junk, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.quality(both, refs).collect()}
    assert not any(got[k] for k in (2000, 2001, 2002))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = quality.quality(docs, refs).join(labels.filter("quality = 1"), "doc_id").filter("not base_failed")
    assert good.filter("kept").count() >= 0.97 * good.count()


def test_no_common_word_no_pass(spark, small):
    """Letter-only junk, and junk between pipes where a reference lacks the pipe, lie within the class bound and beyond the word bound."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    refs = quality.references(docs)
    pipe = spark.range(1).select(F.xxhash64(F.lit("|"))).first()[0]
    assert refs and all(pipe not in [*r["words"], *r["more"]] for r in refs)
    r = random.Random(1)
    made = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(9, 14))) for _ in range(200)]
    junk = spark.createDataFrame([(1, " ".join(made)), (2, " | ".join(made)), (3, " | ".join(made) + ".")], "doc_id long, text string")
    got = quality.quality(junk, refs).collect()
    assert not any(x.base_failed or x.kept for x in got) and all(x.class_distance <= quality.MAX_CLASS_DISTANCE for x in got)
    piped = docs.filter("size(split(text, ' [|] ')) > 30 and 0.3 * size(split(text, ' ')) < size(split(text, ' [|] '))")
    bad = quality.quality(piped, refs).filter("not base_failed")
    assert bad.count() and bad.filter("kept").count() == 0


def test_empty(spark, empty, odd):
    assert quality.references(empty) == [] and quality.quality(empty, []).count() == 0
    refs = quality.references(odd)
    assert quality.quality(odd, refs).count() == odd.count()
    assert not any(r.kept for r in quality.quality(odd, refs).collect() if r.doc_id in (100, 101, 102, 103, 104))
