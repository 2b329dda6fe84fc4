"""Fingerprints of documents as invertible Bloom lookup sketches, in DataFrame functions alone.

A text's paragraphs (``PARAGRAPH``: lines, long ones cut behind sentences and
after 160 characters) become a set of digests. A sketch has three rows of cells;
a digest is put into one cell of each row, which holds how many digests fell
into it and their exclusive or. Two sketches are subtracted cell by cell, which
leaves the digests that only one of the texts has. A cell with one digest left
tells it, as a digest carries 16 bits of a hash of its other 48; taken out of its
two other cells it makes more of them tell theirs, until nothing is left: the
differing digests are known, and with the sizes of both sets their likeness.

If that fails, there were more differences than the sketch can hold. The sets
are then parted into blocks by the digests' leading bits, so many that a block
has ``LOAD`` digests or so, each with sketches of its own; those of a block that
fails again are made larger, with other places for the digests, up to
``ATTEMPTS`` times. All of that goes on inside a row: work is linear in the
digests, and nothing is shuffled for it. A block that fails in all its attempts
(one in 1e15) is compared digest by digest.

The base sketch of a whole text, written out, is its fingerprint. Equal texts
have equal fingerprints. Null text counts as empty; two texts without paragraphs
are alike (1.0). Paragraphs of two texts are taken for equal if 48 bits of their
hash are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, let, scratch

#: A paragraph with what ends it; every character of a text is part of one.
PARAGRAPH = r"[^\n.!?]{1,160}+[ \t\n\x0B\f\r.!?]*+|[\n.!?]++"
#: Cells in each of the three rows of a fingerprint.
CELLS = 8
#: Digests of both texts that share a block of larger sketches, at most on the mean; one block in ten or so then takes a second sketch.
LOAD = 12
#: Sketches that are tried for a block, each with twice the cells of the one before.
ATTEMPTS = 5
#: Rounds of taking digests out; a sketch that can be emptied at all is so after few of them.
ROUNDS = 24

LOW = 0xFFFF
_SKETCH = "array<struct<n:int,w:bigint,s:int,q:int>>"
_DIGESTS = "array<bigint>"


def _digest(hash_: Column) -> Column:
    """48 bits of a hash, and 16 bits of a hash of these."""
    high = hash_.bitwiseAND(F.lit(~LOW))
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(LOW)))


def _genuine(word: Column) -> Column:
    return F.xxhash64(word.bitwiseAND(F.lit(~LOW))).bitwiseAND(F.lit(LOW)) == word.bitwiseAND(F.lit(LOW))


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PARAGRAPH})"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: _digest(F.xxhash64(p)))))


def _places(digests: Column, attempt: Column) -> Column:
    """Digests (w) with the bits (p) that choose their cells."""
    return F.transform(digests, lambda w: F.struct(w.alias("w"), F.xxhash64(w, attempt).alias("p")))


def _cell(p: Column, shift: Column, cells: Column) -> Column:
    """The cell that a digest's bits choose in the row whose bits begin at ``shift``; ``cells`` is a power of two."""
    return F.call_function("shiftrightunsigned", p, shift).bitwiseAND(cells - 1).cast("int")


def _xor(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["w"]))


def sketch(digests: Column, cells: Column, attempt: Column) -> Column:
    """The cells of a set of digests: n of them, their exclusive or w, and where the cell is (bits s, place q)."""

    def row(placed: Column, shift: Column) -> Column:
        # each digest's cell is computed once, so that the filters, one a cell, only compare two numbers
        at = F.transform(placed, lambda x: F.struct(x["w"].alias("w"), _cell(x["p"], shift, cells).alias("q")))
        own = let(at, lambda a: F.transform(F.sequence(F.lit(0), cells - 1), lambda q: F.filter(a, lambda x: x["q"] == q)))
        return F.transform(own, lambda o, q: F.struct(F.size(o).alias("n"), _xor(o).alias("w"), shift.alias("s"), q.alias("q")))

    rows = F.array(F.lit(0), F.lit(16), F.lit(32))
    return F.flatten(let(_places(digests, attempt), lambda placed: F.transform(rows, lambda s: row(placed, s))))


def base_sketch(digests: Column) -> Column:
    return sketch(digests, F.lit(CELLS), F.lit(0))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["w"].bitwiseXOR(y["w"]).alias("w"), x["s"].alias("s"), x["q"].alias("q")))


def peeled(difference: Column, cells: Column, attempt: Column) -> Column:
    """How many digests a difference of sketches holds, as all of them are taken out of it; null if it cannot be emptied."""

    def without(cell: Column, gone: Column) -> Column:
        n = cell["n"] - F.aggregate(gone, F.lit(0), lambda a, k: a + k["n"])
        less = F.struct(n.alias("n"), cell["w"].bitwiseXOR(_xor(gone)).alias("w"), cell["s"].alias("s"), cell["q"].alias("q"))
        return F.when(F.size(gone) > 0, less).otherwise(cell)

    def round_(state: Column) -> Column:
        single = F.filter(state["c"], lambda x: (F.abs(x["n"]) == 1) & _genuine(x["w"]))
        known = F.array_distinct(F.transform(single, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), F.xxhash64(x["w"], attempt).alias("p"))))

        def taken(k: Column) -> Column:
            gone = F.transform(state["c"], lambda x: F.filter(k, lambda y: _cell(y["p"], x["s"], cells) == x["q"]))
            left = F.zip_with(state["c"], gone, without)
            return F.struct(left.alias("c"), (state["found"] + F.size(k)).alias("found"), (F.size(k) > 0).alias("more"))

        return let(known, taken)

    start = F.struct(difference.cast(_SKETCH).alias("c"), F.lit(0).alias("found"), F.lit(True).alias("more"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.when(s["more"], round_(s)).otherwise(s))
    return let(end, lambda e: F.when(~F.exists(e["c"], lambda x: (x["n"] != 0) | (x["w"] != 0)), e["found"]))


def _blocks(digests: Column, levels: Column) -> Column:
    """The digests parted by their leading ``levels`` bits, halving by halving."""
    side = lambda g, bit, v: F.filter(g, lambda w: F.getbit(w, 63 - bit) == v)
    halved = lambda groups, bit: F.flatten(F.transform(groups, lambda g: F.array(side(g, bit, 0), side(g, bit, 1))))
    return F.aggregate(F.sequence(F.lit(0), levels - 1), F.array(digests).cast(f"array<{_DIGESTS}>"), halved)


def _block_difference(a: Column, b: Column) -> Column:
    """How many digests only one of two blocks has, from sketches that are made larger until they can be emptied."""

    def tried(done: Column, attempt: Column) -> Column:
        cells = F.call_function("shiftleft", F.lit(CELLS), attempt - 1)
        again = lambda c: peeled(subtracted(sketch(a, c, attempt), sketch(b, c, attempt)), c, attempt)
        return F.when(done >= 0, done).otherwise(F.coalesce(let(cells, again), F.lit(-1)))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(-1), tried)
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return let(end, lambda done: F.when(done >= 0, done).otherwise(exact))


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """How many digests only one of two sets has: from their fingerprints' difference, or, where that is too full, from larger sketches."""
    # so many blocks that each has LOAD digests or fewer on the mean
    levels = F.greatest(F.lit(1), F.ceil(F.log2((F.size(a) + F.size(b)) / F.lit(LOAD))).cast("int"))
    pairs = F.zip_with(_blocks(a, levels), _blocks(b, levels), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    larger = F.aggregate(pairs, F.lit(0), lambda s, p: s + _block_difference(p["x"], p["y"]))
    return let(peeled(subtracted(sketch_a, sketch_b), F.lit(CELLS), F.lit(0)), lambda d: F.when(d.isNotNull(), d).otherwise(larger))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Jaccard similarity of two sets of digests (0 to 1), from their sizes and their difference; 1 if both are empty."""
    both = (F.size(a) + F.size(b)).cast("double")
    return let(difference(a, b, sketch_a, sketch_b), lambda d: F.when(both == 0, 1.0).otherwise((both - d) / (both + d)))


def written(sketch: Column) -> Column:
    """A sketch as text: number and word of each cell that is not empty, by its place."""
    cell = lambda x, c: F.when(x["n"] > 0, F.concat_ws(":", c.cast("string"), x["n"].cast("string"), F.lpad(F.hex(x["w"]), 16, "0")))
    return F.array_join(F.transform(sketch, cell), " ")


def next_rows(docs: DataFrame, own: str, key: str, text: str) -> DataFrame:
    """own, next (row id of the next row in ascending order of the key, the first one's after the last) and n_chars.

    Null keys come first; rows of one key follow each other by a hash of their
    text, then by their place. Rows are dealt by ranges of that order; the last
    row of a range is followed by the first one of the next range, which are
    found in a table of one row a range.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = ["k", "tie", "own"]
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text_).alias("tie"), F.col(own).alias("own"), F.length(text_).cast("long").alias("n_chars"))
    rows = scratch(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    first = rows.groupBy("part").agg(F.min_by("own", F.struct(*order)).alias("first"))
    ranged = Window.orderBy("part")
    every = ranged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select(F.col("part").alias("p"), F.coalesce(F.lead("first").over(ranged), F.first("first").over(every)).alias("after"))
    inside = rows.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(F.broadcast(first), F.col("part") == F.col("p")).select("own", F.coalesce("next", "after").alias("next"), "n_chars")


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, text, edited (its last quarter replaced by the next document's beginning), next_key, the digests of the text, the edited and the next one, and the sketches of the first and the last.

    Only the beginning that is needed of each next document travels to the row
    before it, with its digests and its sketch, which are computed once for both
    uses; whole texts are shuffled once.
    """
    rows, own = identified(docs)
    rows = rows.select(F.col(own).alias("own"), F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    own = "own"
    links = scratch(next_rows(rows, own, "k", "t"), "links")
    dealt = rows.select(F.col(own).alias("own"), "k", F.coalesce("t", F.lit("")).alias("t")).withColumn("x", digests(F.col("t"))).withColumn("s", base_sketch(F.col("x")))
    # both joins deal the texts, with their digests and sketches, by row id, which is one exchange
    needs = links.select(F.col("own").alias("reader"), F.col("next").alias("giver"), F.floor(F.col("n_chars") / 4).cast("int").alias("need"))
    given = dealt.join(needs.hint("merge"), F.col("own") == F.col("giver"))
    given = given.select("reader", F.col("k").alias("next_key"), F.substring("t", F.lit(1), F.col("need")).alias("head"), "need", F.col("x").alias("next_digests"), F.col("s").alias("next_sketch"))
    met = dealt.join(given.hint("merge"), F.col("own") == F.col("reader"))
    n = F.length("t")
    met = met.select(F.col("k").alias(key), n.cast("long").alias("n_chars"), F.col("t").alias("text"), F.concat(F.substring("t", F.lit(1), n - F.col("need")), "head").alias("edited"), "next_key", F.col("x").alias("digests"), F.col("s").alias("sketch"), "next_digests", "next_sketch")
    return met.withColumn("edited_digests", digests(F.col("edited")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and next_key of each row of documents."""
    rows = versions(docs, key, text)
    names = ("digests", "edited_digests", "next_digests")
    own, edited, after = (F.col(c) for c in names)

    def told(s: Column) -> Column:
        return F.struct(
            written(s["a"]).alias("fingerprint"), written(s["b"]).alias("edited_fingerprint"), likeness(own, edited, s["a"], s["b"]).alias("near_edited"),
            likeness(own, after, s["a"], s["c"]).alias("near_next"),
        )

    sketches = F.struct(F.col("sketch").alias("a"), base_sketch(edited).alias("b"), F.col("next_sketch").alias("c"))
    rows = rows.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_key", let(sketches, told).alias("r"))
    return rows.select(key, "n_chars", "edited_sha256", "r.*", "next_key")
