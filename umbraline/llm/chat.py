"""Chat formatting of logged conversations, of which only maximal ones stay.

A log that is written after each turn holds a conversation many times, each
copy a prefix of the next. Rolling hashes of turn prefixes find those copies: a
conversation whose whole hash is the prefix hash of a longer one is dropped by
an anti-join; of equal conversations the smallest id stays.

A prefix hash is the exclusive-or of 64-bit hashes of (position, role, text),
twice with different salts, so it rolls forward by one operation and sums up in
any order. Positions and prefix hashes are computed in two levels, over blocks
of turn numbers and inside a block, as one conversation may hold many turns.
Prefixes are made distinct with map-side combining before the join, so a
first turn that many conversations share is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Turn numbers in a block, and turns in a part of the rendered text.
BLOCK = 1_024
PART_TURNS = 256
#: Fixed values of the ChatML format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(salt: int) -> Column:
    """Hash of a turn at its position; null and empty differ."""
    parts = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(F.lit(salt), F.col("pos"), *parts)


def positions(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct turns as c, turn, role, text, with ``pos`` from 1 and prefix hashes ``a`` and ``b``."""
    names = {key: "c", turn: "turn", role: "role", text: "text"}
    rows = turns.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]).distinct()
    rows = scratch(rows.withColumn("block", F.floor(F.col("turn") / BLOCK)), "turns")

    def past(df: DataFrame, value: Column, fold, name: str) -> DataFrame:
        """Adds the fold of all earlier blocks of the row's conversation."""
        earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy("c", "block").agg(fold(value).alias("x"))
        sums = sums.select(F.col("c").alias("c2"), F.col("block").alias("b2"), F.coalesce(fold(F.col("x")).over(earlier), F.lit(0)).alias(name))
        return df.join(sums, F.col("c").eqNullSafe(F.col("c2")) & F.col("block").eqNullSafe(F.col("b2"))).drop("c2", "b2")

    inside = Window.partitionBy("c", "block").orderBy("turn", "role", "text")
    rows = past(rows, F.lit(1), F.sum, "before")
    rows = rows.withColumn("pos", F.col("before") + F.row_number().over(inside)).drop("before")
    rows = rows.withColumn("ha", _hash(1)).withColumn("hb", _hash(2))
    run = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for h, name in (("ha", "a"), ("hb", "b")):
        rows = past(rows, F.col(h), F.bit_xor, "base")
        rows = rows.withColumn(name, F.col("base").bitwiseXOR(F.bit_xor(h).over(run))).drop("base", h)
    return scratch(rows.drop("block"), "prefixes")


def maximal(rows: DataFrame) -> DataFrame:
    """c and n_turns of the conversations that are no proper prefix of another one, one of each group of equals."""
    sizes = rows.groupBy("c").agg(F.max("pos").alias("n_turns"))
    sizes = sizes.withColumnRenamed("c", "c2")
    sized = rows.join(sizes, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")
    whole = sized.filter(F.col("pos") == F.col("n_turns")).groupBy("n_turns", "a", "b").agg(F.min("c").alias("c"))
    longer = sized.filter(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("n_turns"), "a", "b").distinct()
    return whole.join(longer, ["n_turns", "a", "b"], "left_anti").select("c", "n_turns")


def render(role: Column, text: Column) -> Column:
    """One turn in the ChatML format; markers inside a text are broken up so that they cannot forge a turn."""
    body = F.coalesce(text, F.lit(""))
    for mark in (OPEN, CLOSE):
        body = F.replace(body, F.lit(mark), F.lit(mark.replace("|", "| ", 1)))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), body, F.lit(f"{CLOSE}\n"))


def chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Rendered maximal conversations: key, ``part``, ``n_turns`` (of the whole), ``part_turns`` and ``chat``.

    Parts of at most ``part_turns`` turns, joined in order, are the whole text,
    so that a conversation of any length stays within a task's memory.

    Turns are taken in order of turn number, then role, then text, nulls first;
    rows that repeat in all four columns count once. A null key is a
    conversation like others; a null role is rendered as ``unknown``, a null
    text as empty. Other columns are ignored. Empty tables give empty results.
    """
    rows = positions(turns, key, turn, role, text)
    best = maximal(rows).withColumnRenamed("c", "c2")
    kept = rows.join(best, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")
    part = F.floor((F.col("pos") - 1) / part_turns).cast("int")
    kept = kept.select("c", "n_turns", part.alias("part"), F.struct("pos", render(F.col("role"), F.col("text")).alias("t")).alias("x"))
    out = kept.groupBy("c", "n_turns", "part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return out.select(
        F.col("c").alias(key), "part", "n_turns", F.size("xs").alias("part_turns"), F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("chat")
    )
