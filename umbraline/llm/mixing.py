"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots. Slot i maps the i-th golden-ratio point through the
cumulative block counts of the sources and so belongs to one of them; its rank
among the slots of that source names a block of that source's token stream. A
source's stream is its documents in seeded random order, repeated without end
and cut into blocks of equal size, the last one at the source's target.

Golden-ratio points miss a source's exact block count by a few slots; those
slots go, in order, to the sources that came out short, so each block of each
source has one slot. What the mix takes of a document is what its blocks with a
slot hold of it; a document's place in the mix is its first slot.

Scale: positions in the stream and ranks are prefix sums in two levels (sums of
parts, then windows inside a part), as one source may hold most documents.
Parts are runs of a hash of key and text, so no group grows with a source, nor
with a repeated key. Only sums for each source, each part and each 65,536 slots
meet in one window; the number of sources must suit one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import identified, scratch, words

WEIGHTS = (5, 2, 1)
BLOCK = 512
SEED = "mix"
#: Golden-ratio multiplier of the points, odd, over a period of 2**31.
GOLDEN, PERIOD = 1_327_217_885, 1 << 31
CHUNK = 1 << 16
CELLS = 4_096
PART_ROWS = 4_096


def sized(docs: DataFrame, own: str, key: str, text: str, source: str) -> DataFrame:
    """Narrow table of the rows: rid, own, key, source, words, and the order of the stream."""
    name, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, text))
    return scratch(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(own).alias("own"), F.col(key).alias("k"), F.col(source).alias("src"),
            F.size(words(F.col(text))).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{SEED}-"), name, F.lit("-"), F.md5(body))).alias("ord"),
        ),
        "sized",
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each source its number, size and target.

    Targets share 3/2 of all words by weight. Sources are filled up in order of
    cap by weight: at the first one whose cap (twice its size) holds its share
    of what is left, it and all after it get shares, those before it their cap.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), nth + 1)
    sums = rows.groupBy("src").agg(F.sum("size").alias("s_size"))
    sums = sums.select("src", "s_size", F.row_number().over(by_name).alias("sid"), weight.alias("w"), (F.col("s_size") * 2).alias("cap"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("s_size").over(everything) * 3 - F.coalesce(F.sum("cap").over(before), F.lit(0)) * 2
    sums = sums.withColumn("level", left.cast("double") / (F.sum("w").over(after) * 2).cast("double")).withColumn("at", F.row_number().over(fill))
    holds = F.col("cap") >= F.col("level") * F.col("w")
    sums = sums.withColumn("first", F.min(F.when(holds, F.col("at"))).over(everything))
    share = F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(everything)
    target = F.when(F.col("at") < F.coalesce("first", F.col("at") + 1), F.col("cap").cast("double")).otherwise(share * F.col("w"))
    return sums.select("src", "sid", "s_size", target.alias("target"), F.floor(target).cast("long").alias("take"))


def _source_join(left: DataFrame, sources: DataFrame) -> DataFrame:
    return left.join(sources.withColumnRenamed("src", "s_src"), left["src"].eqNullSafe(F.col("s_src"))).drop("s_src")


def stream(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with ``lo``, their place in their source's stream."""
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / PART_ROWS, 16)))
    rows = _source_join(rows, sources).withColumn("part", F.substring("ord", 1, digits))
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    past = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "part").orderBy("ord", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, ["sid", "part"]).withColumn("lo", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row's share of each block of its source's stream."""
    turns = placed.filter(F.col("size") > 0).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    turns = turns.withColumn("a", F.col("epoch") * F.col("s_size") + F.col("lo"))
    turns = turns.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("take"))).filter(F.col("a") < F.col("z"))
    first, last = F.floor(F.col("a") / block).cast("long"), F.floor((F.col("z") - 1) / block).cast("long")
    out = turns.select("rid", "sid", "epoch", "a", "z", F.explode(F.sequence(first, last)).alias("rank"))
    start = F.greatest("a", F.col("rank") * block)
    return out.select("rid", "sid", "epoch", "rank", (start - F.col("a")).alias("from_word"), (F.least("z", (F.col("rank") + 1) * block) - start).alias("n"))


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: ``slot``, ``sid`` and ``rank``, each source's block once."""
    need = sources.select("sid", F.ceil(F.col("take") / block).cast("long").alias("need")).filter(F.col("need") > 0)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = need.withColumn("hi", F.sum("need").over(upto)).withColumn("lo", F.col("hi") - F.col("need"))
    total = need.agg(F.max("hi")).first()[0] or 0
    # whole-numbered bounds of the points, so that neighbours share them; equal cells turn the search for a point's source into an equi-join
    edge = lambda c: F.ceil(F.col(c).cast("double") * PERIOD / max(1, total)).cast("long")
    cells = need.select("sid", "need", edge("lo").alias("p"), edge("hi").alias("q")).filter(F.col("p") < F.col("q"))
    width = PERIOD // CELLS
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("p") / width), F.floor((F.col("q") - 1) / width))))
    point = F.pmod((F.pmod(F.col("id"), F.lit(PERIOD)) + 1) * GOLDEN, F.lit(PERIOD))
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("x"), F.floor(point / width).alias("cell"))
    slots = slots.join(cells, "cell").filter((F.col("x") >= F.col("p")) & (F.col("x") < F.col("q")))
    slots = slots.select("slot", "sid", "need", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    past = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("sid", "chunk", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = scratch(slots.join(sums, ["sid", "chunk"]).select("slot", "sid", "need", (F.col("base") + F.row_number().over(inside) - 1).alias("rank")), "slots")
    # the points' discrepancy: a few slots for each source are above its need, and as many blocks have none
    over = ranked.filter(F.col("rank") >= F.col("need")).select("slot", F.row_number().over(Window.orderBy("slot")).alias("j"))
    got = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    short = need.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter(F.col("got") < F.col("need"))
    short = short.select("sid", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    short = short.select("sid", "rank", F.row_number().over(Window.orderBy("sid", "rank")).alias("j"))
    moved = over.join(short, "j").select("slot", "sid", "rank")
    return ranked.filter(F.col("rank") < F.col("need")).select("slot", "sid", "rank").unionByName(moved)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix's parts and the rows with their sources.

    Parts: ``slot`` (order of the mix), rid, ``epoch`` (0, or 1 for a repeat),
    ``from_word`` and ``n`` words of the row's text. Rows: rid, k, src, size,
    s_size, target, take, lo.

    A null source is a source of its own, numbered last. Null texts and texts
    without words have size 0 and no part. Rows that repeat a key count each
    for itself; rows that are equal in key and text are interchangeable. Other
    columns are ignored. Empty tables give empty results.
    """
    return _mix(*identified(docs), key, text, source, weights, block)


def _mix(docs: DataFrame, own: str, key: str, text: str, source: str, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    rows = sized(docs, own, key, text, source)
    sources = scratch(targets(rows, weights), "sources")
    placed = scratch(stream(rows, sources), "placed")
    parts = pieces(placed, block).join(schedule(docs.sparkSession, sources, block), ["sid", "rank"])
    return parts.select("slot", "rid", "epoch", "from_word", "n"), placed


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Words that the mix takes of each row, repeats counted, the first of its slots, and the number of slots with a part of it.

    A row of which nothing is taken has a null ``first_slot`` and no slots.
    """
    parts, rows = mix(docs, key, text, source, **options)
    sums = parts.groupBy("rid").agg(F.sum("n").alias("n"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    out = rows.join(sums, "rid", "left")
    return out.select(
        F.col("k").alias(key), "size", F.col("s_size").alias("source_size"), "target", F.coalesce("n", F.lit(0)).alias("taken"), "first_slot",
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
    )


def copies(size: Column, n: Column) -> Column:
    """Whole copies of a document whose taken words are ``n``: rounded to the nearest."""
    return F.when(size > 0, F.floor((n * 2 + size) / (size * 2))).otherwise(0).cast("int")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, as whole rows in the order of the schedule, twice where it takes them twice.

    A copy stands where the mix first takes the document, the second one where
    it takes it again. Rows go by row, not by key: of rows that repeat a key,
    or are equal, each is taken for itself.
    """
    rows, own = identified(docs)
    parts, placed = _mix(rows, own, key, text, source)
    turns = parts.groupBy("rid", "epoch").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"))
    turns = turns.groupBy("rid").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("slot")).alias("slots"))  # two at most
    chosen = placed.join(turns, "rid").select("own", F.slice("slots", F.lit(1), copies(F.col("size"), F.col("n"))).alias("slots")).filter(F.size("slots") > 0)
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(own).alias("at"))
    out = whole.join(chosen, F.col("at") == F.col("own")).select("row", F.explode("slots").alias("slot"))
    return out.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")
