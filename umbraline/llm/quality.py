"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
with those of each language of the corpus by the Jensen-Shannon distance; it is
kept if it lies close enough to one of them, whichever that is. Short documents, whose histograms
say little, are left to the base rules. A language's ``COMMON`` most frequent
words have a cell each in the word histogram, its next ones up to ``WIDE`` share
one, and all other words the last.

Scale: one aggregation over all words with map-side combining gives the
languages' references, of which the driver gets ``WIDE`` words and the class
counts of each language. The rules themselves are one map-only pass of built-in
functions without a shuffle; inside a document, repeated windows and counts of
common words are found by sorting hashes, in n log n. A word is looked up once,
among all languages' common words; the languages are then compared on the
document's distinct common words, of which they have ``WIDE`` each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, words

MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
#: Common words of each language's reference: those with a cell of their own, and all of them.
COMMON, WIDE = 24, 512
#: A common word has a letter, and stands in so many different texts of its language; passages that one text repeats are not common.
MIN_TEXTS = 3
#: Languages with a reference at most, those with the most words.
LANGUAGES = 256
#: Largest distances (square root of the divergence in bits, 0 to 1) of a kept document.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.31
#: Largest word distance from a reference as a share of the distance of a text without any of its common words.
MAX_OF_ZERO = 0.9
#: Below so many words, the word histogram is not judged.
MIN_WORDS_FOR_WORDS = 50
CLASSES = ("letters", "digits", "symbols", "others")


def base_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, the array w of words, and the counts that the rules need; one row per row.

    Null text has no words. Counts of characters are counts of code points.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    out = docs.select(F.col(key).alias("k"), F.regexp_replace(body, SPACES, "").alias("solid"), words(body).alias("w"), lines.alias("lines"))
    out = out.select("k", "w", F.length("solid").cast("long").alias("word_chars"), F.regexp_replace("solid", r"\p{L}+", "").alias("rest"),
                     (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    return out.select(
        "k", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), "word_chars", "n_dup_lines", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("rest", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("rest", "[^0-9]+", "")).cast("long").alias("n_digits"), F.length("rest").cast("long").alias("n_rest"),
    )


def repeated_words(h: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, given the words' hashes."""
    # bound once: an optimiser that moves a filter over this column would else put the text's whole splitting inside the lambdas
    return let(h, lambda own: _repeated_words(own, width))


def _repeated_words(h: Column, width: int) -> Column:
    n = F.size(h) - (width - 1)
    windows = F.transform(
        F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)])
    )

    def covered(ws: Column) -> Column:
        tagged = F.array_sort(F.transform(ws, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        hits = let(tagged, lambda s: F.filter(s, lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"])))
        spread = F.flatten(F.transform(hits, lambda e: F.array(*[e["i"] + j for j in range(width)])))
        return F.size(F.array_distinct(spread))

    # most texts repeat no window and are done after one hash set
    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), 0).otherwise(covered(ws))).cast("long")


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON, wide: int = WIDE) -> list[dict]:
    """For each language of the corpus: its common words, the shares of the first ``common`` and of all others, and the shares of its character classes.

    Over all rows with a language; one with a text of ``MIN_WORDS`` words is a
    reference, whatever the size of the corpus. The result has at most ``wide``
    words for each of ``LANGUAGES``. A language without common words has a word
    histogram of one cell, from which no text differs.
    """
    named = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    # each text sets one of 64 bits, equal texts the same; the bits that a word has tell few texts from many
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("t"), F.lit(64)).cast("int"))
    # in a select of its own, or it would be computed for each word
    each = named.select("l", "t", bit.alias("bit")).select("l", "bit", F.explode(words(F.col("t"))).alias("w"))
    counts = each.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("texts"))
    # two steps, as one language may hold most words: first within (language, part), then among the parts' best
    part = Window.partitionBy("l", "part").orderBy(F.desc("n"), "w")
    usual = counts.filter((F.bit_count("texts") >= MIN_TEXTS) & F.col("w").rlike(r"\p{L}")).drop("texts")
    top = usual.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64))).withColumn("nth", F.row_number().over(part)).filter(F.col("nth") <= wide)
    top = top.withColumn("nth", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).filter(F.col("nth") <= wide)
    top = top.select("l", "nth", F.xxhash64("w").alias("h"), "n")
    feats = base_features(named.withColumn("l2", F.col("l")), "l2", "t").withColumn("whole", F.col("n_words") >= MIN_WORDS)
    shapes = feats.groupBy("k").agg(F.count_if("whole").alias("rows"), F.sum("n_words").alias("total"), *[F.sum(F.when(F.col("whole"), c)).alias(name) for name, c in _classes()])
    shapes = shapes.filter(F.col("rows") > 0).orderBy(F.desc("total"), "k").limit(LANGUAGES).collect()
    found, totals = {r["k"]: [r[c] for c in CLASSES] for r in shapes}, {r["k"]: r["total"] for r in shapes}
    out: dict[str, dict] = {}
    for lang_, shape in sorted(found.items()):
        out[lang_] = {"lang": lang_, "words": [], "shares": [], "more": [], "more_share": 0.0, "classes": [x / sum(shape) for x in shape]}
    for r in sorted(top.filter(F.col("l").isin(list(found))).collect() if found else [], key=lambda r: (r["l"], r["nth"])):
        if r["l"] in out:
            ref = out[r["l"]]
            share = r["n"] / totals[r["l"]]
            if r["nth"] <= common:
                ref["words"].append(r["h"])
                ref["shares"].append(share)
            else:
                ref["more"].append(r["h"])
                ref["more_share"] += share
    return list(out.values())


def _classes() -> list[tuple[str, Column]]:
    others = F.col("n_rest") - F.col("n_digits") - F.col("n_symbols")
    return list(zip(CLASSES, (F.col("word_chars") - F.col("n_rest"), F.col("n_digits"), F.col("n_symbols"), others), strict=True))


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance in [0, 1] of a histogram of counts from fixed shares; null for an empty histogram."""
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    fixed = sum(q * math.log2(q) for q in shares if q > 0) / 2  # the entropy terms: H((p + q) / 2) - (H(p) + H(q)) / 2

    def bits(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        own = let(total, lambda t: F.transform(counts, lambda c: c / t))
        terms = F.zip_with(own, _doubles(shares), lambda p, q: plogp(p) / 2 - plogp((p + q) / 2))
        return F.when(total > 0, F.aggregate(terms, F.lit(fixed), lambda a, x: a + x))

    return let(let(counts, bits), lambda b: F.when(b.isNotNull(), F.sqrt(F.greatest(b, F.lit(0.0)))))


def runs(values: Column) -> Column:
    """The distinct values of an array in order, as structs of ``x`` and its number ``n``."""

    def counted(s: Column, ends: Column) -> Column:
        return F.transform(ends, lambda z, j: F.struct(F.get(s, z - 1).alias("x"), (z - F.coalesce(F.get(ends, j - 1), F.lit(0))).alias("n")))

    last = lambda s: F.filter(F.transform(s, lambda x, i: F.when(x == F.get(s, i + 1), F.lit(None)).otherwise(i + 1)), lambda z: z.isNotNull())
    return let(F.sort_array(values), lambda s: let(last(s), lambda ends: counted(s, ends)))


def _term(p: Column, q: Column) -> Column:
    """A cell's part of the divergence, without that of q alone."""
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    return plogp(p) / 2 - plogp((p + q) / 2)


def word_distance(present: Column, n_words: Column, ref: dict) -> Column:
    """Distance of a document's word histogram from a reference, from its distinct common words and their numbers; null without words."""
    log = lambda q: q * math.log2(q) if q > 0 else 0.0
    shares = _word_shares(ref)
    # as if no common word was there; each that is there then changes its cell's part
    absent = sum(log(q) / 2 for q in shares) - sum(log(q / 2) for q in ref["shares"])
    total = lambda es: F.aggregate(es, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    inside = total(F.filter(present, lambda e: e["x"].isin([*ref["words"], *ref["more"]])))

    def bits(mine: Column, inside: Column) -> Column:
        share = F.map_from_arrays(F.array(*[F.lit(h) for h in ref["words"]]), _doubles(ref["shares"]))
        plain = lambda q: F.when(q > 0, q / 2 * F.log2(q / 2)).otherwise(0.0)
        both = lambda e, q: _term(e["n"] / n_words, q) + plain(q)
        cells = F.aggregate(mine, F.lit(absent), lambda a, e: a + let(F.element_at(share, e["x"]), lambda q: both(e, q)))
        own = total(mine)
        return cells + _term((inside - own) / n_words, F.lit(shares[-2])) + _term((n_words - inside) / n_words, F.lit(shares[-1]))

    mine = F.filter(present, lambda e: e["x"].isin(ref["words"])) if ref["words"] else F.filter(present, lambda e: F.lit(False))
    found = let(mine, lambda m: let(inside, lambda i: bits(m, i))) if ref["words"] else _term(F.lit(0.0), F.lit(0.0)) + absent + _term(F.lit(1.0), F.lit(1.0))
    return F.when(n_words > 0, F.sqrt(F.greatest(found, F.lit(0.0))))


def _word_shares(ref: dict) -> list[float]:
    """The word histogram of a reference: its first words, its other common words, all others."""
    return [*ref["shares"], ref["more_share"], max(0.0, 1 - sum(ref["shares"]) - ref["more_share"])]


def _word_bound(ref: dict, most: float) -> float:
    """The largest word distance from a reference, below that of a text without any of its common words."""
    rest = _word_shares(ref)[-1]
    bits = (1 - rest) / 2 - math.log2((1 + rest) / 2) / 2 + (rest * math.log2(2 * rest / (1 + rest)) / 2 if rest else 0)
    return min(most, MAX_OF_ZERO * math.sqrt(max(0.0, bits)))


def quality(
    docs: DataFrame, refs: list[dict], key: str = "doc_id", text: str = "text", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE
) -> DataFrame:
    """Counts, base verdict, smallest distances and final verdict of each row.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance and word_distance (of the language with
    the smallest sum of both; null without words or references).

    A row is kept if the base rules pass and, for some language, both distances
    are within their bounds; without references, if the base rules pass. Null
    and empty texts fail the base rules. Rows are judged one by one, so rows
    that repeat get the same verdict. Other columns are ignored.
    """
    rows = base_features(docs, key, text).withColumn("n_repeat_words", repeated_words(F.col("h")))
    if refs:
        every = sorted({h for r in refs for h in (*r["words"], *r["more"])})
        common = F.filter("h", lambda x: x.isin(every)) if every else F.slice("h", 1, 0)
        rows = rows.withColumn("present", runs(common)).drop("h")
        shape = F.array(*[c.cast("double") for _, c in _classes()])
        found = [
            F.struct(
                distance(shape, r["classes"]).alias("class_distance"), word_distance(F.col("present"), F.col("n_words"), r).alias("word_distance"),
                F.lit(_word_bound(r, max_word)).alias("bound"),
            )
            for r in refs
        ]
        rows = rows.withColumn("each", F.array(*found)).drop("present")
        scored = F.transform("each", lambda x: F.struct((x["class_distance"] + x["word_distance"]).alias("sum"), x["class_distance"], x["word_distance"]))
        rows = rows.withColumn("best", F.array_min(F.filter(scored, lambda x: x["sum"].isNotNull())))
        few = F.col("n_words") < MIN_WORDS_FOR_WORDS
        close = F.exists("each", lambda x: F.coalesce((x["class_distance"] <= max_class) & (few | (x["word_distance"] <= x["bound"])), F.lit(False)))
        distances = [F.col("best.class_distance").alias("class_distance"), F.col("best.word_distance").alias("word_distance")]
    else:
        close, distances = F.lit(True), [F.lit(None).cast("double").alias(c) for c in ("class_distance", "word_distance")]
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return rows.select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & close).alias("kept"), *distances,
    )
