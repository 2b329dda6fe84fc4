"""Spans of a text as arrays of (start, end, category, confidence, text).

Offsets are half-open and count code points. Everything here is a Column
expression; a text without a hit costs one regex test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import LITERAL_SIGNS, SIGNS

SPAN = "struct<start:int,end:int,category:string,confidence:double,text:string>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), f"array<{SPAN}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once for several uses, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Arrays of spans are worked on in blocks of so many, so that work is not the square of their number.
BLOCK = 64
#: Spans whose part of a text is cut out at once when it is rewritten.
PIECE = 512


def _blocks(values: Column, size: int = BLOCK) -> Column:
    """The array, which must be bound, cut into arrays of ``size`` values; a last one may be shorter, or empty."""
    return F.transform(F.sequence(F.lit(0), (F.size(values) / size).cast("int")), lambda b: F.slice(values, b * size + 1, F.lit(size)))


def sums_before(sizes: Column) -> Column:
    """For each block of an array of numbers, the sum of all numbers before it."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    each = F.transform(F.sequence(F.lit(0), (F.size(sizes) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    return let(each, lambda t: F.transform(t, lambda x, b: total(F.slice(t, F.lit(1), b))))


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, text) of the pattern's matches, which must not be empty strings; the pattern may differ by row.

    The pieces between the matches and the matches themselves come from the same
    regex engine, so their lengths add up to offsets.
    """

    def located(pieces: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(pieces, i)))
        return let(sizes, lambda n: let(sums_before(n), lambda bases: F.transform(hits, lambda h, i: at(pieces, n, bases, h, i))))

    def at(pieces: Column, sizes: Column, bases: Column, hit: Column, i: Column) -> Column:
        block = (i - i % BLOCK) / BLOCK
        inside = F.aggregate(F.slice(sizes, i - i % BLOCK + 1, i % BLOCK), F.lit(0), lambda a, x: a + x)
        return F.struct((F.get(bases, block.cast("int")) + inside + F.length(F.get(pieces, i))).alias("start"), hit.alias("text"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,text:string>>")

    def search(text: Column, pattern: Column) -> Column:
        # the matches first, as most texts have none and need no pieces; the text is bound with them, as an expression with lambdas
        # of its own would be resolved anew inside of this one, and Spark's analyser gives up after a number of rounds
        both = lambda x: let(F.struct(F.split(x["t"], pattern, -1).alias("p"), x["h"].alias("h")), lambda y: located(y["p"], y["h"]))
        found = F.struct(text.alias("t"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("h"))
        return let(found, lambda x: F.when(F.size(x["h"]) > 0, both(x)).otherwise(none))

    if isinstance(pattern, Column):
        return let(F.struct(text.alias("t"), pattern.alias("p")), lambda x: search(x["t"], x["p"]))
    sign = SIGNS.get(pattern)
    found = search(text, F.lit(pattern))
    some = text.rlike(pattern) if sign is None else (text.contains(sign) if sign in LITERAL_SIGNS else text.rlike(sign)) & text.rlike(pattern)
    return F.when(some, found).otherwise(none)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed before anything that uses it.

    Arrow functions cannot take arguments in which lambdas stand within lambdas,
    as spans' do; an optimiser that put them there again stops at a generator.
    """
    return df.withColumn("__settled", value).select("*", F.explode(F.array("__settled")).alias(name)).drop("__settled")


def span(start: Column, text: Column, category: str | Column, confidence: float | Column) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    confidence = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    start = start.cast("int")
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), category.alias("category"), confidence.alias("confidence"), text.alias("text"))


def find_spans(
    text: Column, pattern: str | Column, category: str, confidence: float, keep: Callable[[Column], Column] | None = None, trim: str | None = None
) -> Column:
    """Spans of the pattern's matches, cut by ``trim`` at their end and filtered by ``keep`` on their text."""
    found = matches(text, pattern)
    if trim:
        found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["text"], trim, "").alias("text")))
    if keep:
        found = F.filter(found, lambda m: keep(m["text"]))
    return F.transform(found, lambda m: span(m["start"], m["text"], category, confidence))


def _ranked(spans: Column) -> Column:
    """Spans by start, then longer, surer, earlier first."""
    tagged = F.transform(
        spans, lambda s, i: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["confidence"]).alias("c"), i.alias("i"), s.alias("s"))
    )
    return F.sort_array(tagged)["s"]


def _folded(spans: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Bound spans in order, each met with the last one that stays: ``step`` gives the span to stay in its place, or null where the new one comes after it.

    A fold copies its state at every step, so it goes over one group of blocks
    at a time: a block is joined to the one before if its first span begins
    before an end in any block before.
    """

    def put(acc: Column, s: Column) -> Column:
        # the first span has nothing before it
        instead = F.when(acc["last"].isNotNull(), step(acc["last"], s))
        moves = acc["last"].isNotNull() & instead.isNull()
        return F.struct(F.when(moves, F.concat(acc["some"], F.array(acc["last"]))).otherwise(acc["some"]).alias("some"), F.coalesce(instead, s).alias("last"))

    def free(most: Column) -> Column:
        begins = lambda b: (b == 0) | (F.get(spans, b * BLOCK)["start"] >= F.array_max(F.slice(most, F.lit(1), b)))
        return F.filter(F.sequence(F.lit(0), F.size(most) - 1), begins)

    def folds(at: Column, most: Column) -> Column:
        size = lambda b, i: (F.coalesce(F.get(at, i + 1), F.size(most)) - b) * BLOCK
        return F.flatten(F.transform(at, lambda b, i: fold(F.slice(spans, b * BLOCK + 1, size(b, i)))))

    start = F.struct(no_spans().alias("some"), F.lit(None).cast(SPAN).alias("last"))
    fold = lambda g: F.aggregate(g, start, put, lambda a: F.concat(a["some"], F.array(a["last"])))
    ends = lambda b: F.array_max(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))["end"])
    most = F.transform(F.sequence(F.lit(0), (F.size(spans) / BLOCK).cast("int")), ends)
    return let(most, lambda m: let(free(m), lambda at: folds(at, m)))


def merge_longest(spans: Column) -> Column:
    """Disjoint spans: one that overlaps its predecessor replaces it if longer, or as long and surer; else it goes."""

    def step(last: Column, s: Column) -> Column:
        size, had = s["end"] - s["start"], last["end"] - last["start"]
        better = (size > had) | ((size == had) & (s["confidence"] > last["confidence"]))
        return F.when(s["start"] < last["end"], F.when(better, s).otherwise(last))

    return let(_ranked(spans), lambda r: F.when(F.size(r) > 1, _folded(r, step)).otherwise(r))


def merge_leftmost(spans: Column) -> Column:
    """Disjoint spans: the leftmost, then longest, stays; what overlaps it goes."""

    def ordered(spans: Column) -> Column:
        tagged = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s")))
        return F.sort_array(tagged)["s"]

    step = lambda last, s: F.when(s["start"] < last["end"], last)
    return let(ordered(spans), lambda r: F.when(F.size(r) > 1, _folded(r, step)).otherwise(r))


MERGES = {"longest": merge_longest, "leftmost": merge_leftmost}


def overlapping(spans: Column) -> Column:
    """True if two of the spans overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("z"))))
    return let(ordered, lambda o: F.exists(F.transform(o, lambda s, i: (i > 0) & (s["a"] < F.get(o, i - 1)["z"])), lambda x: x))


def assert_disjoint(spans: Column) -> Column:
    """The spans; an error for the row if two overlap."""
    return let(spans, lambda s: F.when(F.coalesce(overlapping(s), F.lit(False)), F.raise_error(F.lit("overlapping spans"))).otherwise(s))


def rewrite(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each of the disjoint spans, in order, replaced."""

    def part(own: Column, first: Column, spans: Column, s: Column, i: Column) -> Column:
        last = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(first)
        return F.concat(F.substring(own, last - first + 1, s["start"] - last), replacement(s))

    def block(spans: Column, first: Column) -> Column:
        # cut out once, as each cut counts characters from the text's start
        own = F.substring(text, first + 1, F.element_at(spans, -1)["end"] - first)
        return let(F.struct(own.alias("own"), first.alias("first")), lambda b: F.array_join(F.transform(spans, lambda s, i: part(b["own"], b["first"], spans, s, i)), ""))

    def parts(spans: Column) -> Column:
        ends = lambda bs, i: F.when(i > 0, F.element_at(F.get(bs, i - 1), -1)["end"]).otherwise(F.lit(0))
        blocks = let(F.filter(_blocks(spans, PIECE), lambda b: F.size(b) > 0), lambda bs: F.transform(bs, lambda b, i: block(b, ends(bs, i))))
        tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(blocks, ""), tail)

    return let(F.sort_array(spans), lambda s: F.when(F.size(s) > 0, parts(s)).otherwise(text))


def redact(text: Column, spans: Column, filler: str = "·") -> Column:
    """The text with each span overwritten by as many fillers, so that offsets stay."""
    if len(filler) != 1:
        raise ValueError("the filler must be one character")
    return rewrite(text, merge_longest(spans), lambda s: F.repeat(F.lit(filler), s["end"] - s["start"]))


def placeholders(text: Column, spans: Column, prefix: str = "") -> Column:
    """The text with each span as ``[LABEL]``; the detection service's wire form has the prefix ``OPF:``."""
    return rewrite(text, spans, lambda s: F.concat(F.lit(f"[{prefix}"), label(s["category"]), F.lit("]")))


def label(category: Column) -> Column:
    """Token label of a category; the category itself where it has none."""
    from .patterns import LABELS

    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, category), category)


def only(spans: Column, categories: list[str]) -> Column:
    return F.filter(spans, lambda s: s["category"].isin(list(categories)))


def without(spans: Column, categories: list[str]) -> Column:
    return F.filter(spans, lambda s: ~s["category"].isin(list(categories))) if categories else spans


def confident(spans: Column, least: float) -> Column:
    return spans if least <= 0 else F.filter(spans, lambda s: s["confidence"] >= least)


def expand_person_words(text: Column, spans: Column) -> Column:
    """Person spans that cut a Latin word, widened to all of it; merge again afterwards."""

    def widened(s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        left, right = F.substring(text, F.lit(1), s["start"]), F.substring(text, s["end"] + 1, F.length(text))
        more_left = F.when(own.rlike("^[A-Za-z0-9_]"), F.length(F.regexp_extract(left, "[A-Za-z0-9_]+$", 0))).otherwise(0)
        more_right = F.when(own.rlike("[A-Za-z0-9_]$"), F.length(F.regexp_extract(right, "^[A-Za-z0-9_]+", 0))).otherwise(0)
        start, end = s["start"] - more_left, s["end"] + more_right
        return F.struct(
            start.alias("start"), end.alias("end"), s["category"].alias("category"), s["confidence"].alias("confidence"),
            F.substring(text, start + 1, end - start).alias("text"),
        )

    return F.transform(spans, lambda s: F.when((s["category"] == "private_person") & (s["end"] > s["start"]), widened(s)).otherwise(s))


def masked_chars(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])


def histogram(spans: Column) -> Column:
    """Map of category to its number of spans."""
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["category"])))
    count = lambda c: F.size(F.filter(spans, lambda s: s["category"] == c)).cast("long")
    return F.map_from_arrays(names, F.transform(names, count))
