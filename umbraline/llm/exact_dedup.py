"""Exact deduplication by distributed most-significant-digit radix partitioning.

A text is compared as a length-prefixed byte string: its first digit is its
length with its first 64 bytes, the next digits are successive runs of bytes,
each 16 times as wide as the one before. Each round splits every open group by
its next digit. A group closes when it has one member or when its texts have
ended; then its members are equal byte for byte, and no digest takes part.

Scale: a round is one map-side combined aggregation on (group, digit) and one
equi-join that hands the counts back, which adaptive execution splits where a
group is large. No group is gathered in a task. A row leaves the rounds as
soon as its group closes, so after the first round only texts that agree in
length and prefix move at all. Each round's state is a table in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, identified, scratch, without

FIRST_DIGIT = 64
WIDEN = 16


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _met(rows: DataFrame, group: list[str], *least: Column) -> DataFrame:
    """The rows with the size and least members of their group, null for a group of one.

    Groups of more are a table of their own first: both sides of the join then
    come from plain exchanges, which adaptive execution splits for a large group.
    """
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), *least).filter(F.col("size") > 1)
    # a sort-merge join at every size, as only that one is split
    return rows.join(scratch(sums, "groups").hint("merge"), group, "left").withColumn("size", F.coalesce("size", F.lit(1)))


def _groups(docs: DataFrame, own: str, key: str, text: str, first: int) -> DataFrame:
    """own, k, size, sha and ``keep`` of each row: the least member (no key last, key, row id) of its group, null for a group of one."""
    body = F.encode(normalised(F.col(text).cast("string")), "UTF-8")
    base = docs.select(F.col(own).alias("own"), F.col(key).alias("k"), body.alias("b")).select(
        "own", "k", "b", F.octet_length("b").alias("n"), F.substring("b", 1, first).alias("digit"), F.sha2("b", 256).alias("sha")
    )
    least = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "own"))
    met = _met(base, ["n", "digit"], least.alias("keep"))
    still = (F.col("size") > 1) & (F.col("n") > first)
    # The row id is fixed once the table is written; it names groups in later rounds.
    table = scratch(
        met.select(
            "own", "k", "sha", "n", "size", "keep", F.when(still, F.col("digit")).alias("head"),
            F.when(still, F.expr(f"substring(b, {first + 1})")).alias("rest"), F.monotonically_increasing_id().alias("rid"),
        ),
        "round1",
    )
    closed = [table.filter(F.col("rest").isNull()).select("own", "k", "sha", "size", "keep")]
    state = table.filter(F.col("rest").isNotNull()).select("own", "k", "sha", "n", F.struct("n", "head").alias("grp"), "rest", "rid")
    longest = state.agg(F.max("n")).first()[0] or 0
    done, width = first, first * WIDEN
    while done < longest:
        digit = F.substring("rest", 1, width)
        met = _met(state.withColumn("digit", digit), ["grp", "digit"], least.alias("keep"), F.min("rid").alias("low"))
        done += width
        still = (F.col("size") > 1) & (F.col("n") > done)
        table = scratch(
            met.select("own", "k", "sha", "n", "size", "keep", "low", "rid", F.when(still, F.expr(f"substring(rest, {width + 1})")).alias("rest")),
            f"bytes{done}",
        )
        closed.append(table.filter(F.col("rest").isNull()).select("own", "k", "sha", "size", "keep"))
        state = table.filter(F.col("rest").isNotNull()).select("own", "k", "sha", "n", F.col("low").alias("grp"), "rest", "rid")
        width *= WIDEN
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.select("own", "k", "sha", "size", F.when(F.col("size") > 1, F.col("keep")).alias("keep"))


def _stays() -> Column:
    return F.col("keep").isNull() | (F.col("keep.own") == F.col("own"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", first: int = FIRST_DIGIT) -> DataFrame:
    """Group of equal normalised texts for each row.

    Returns key, ``keep_id`` (smallest key of the group), ``group_size``,
    ``kept`` and ``text_sha256``, one row per input row.

    One row of each group is kept: that with the smallest key, any one of them
    if rows repeat that key. Null text counts as empty; all empty texts form one
    group. A null key comes after all others; a group of null keys only has a
    null ``keep_id``. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    rows, own = identified(docs)
    out = _groups(rows, own, key, text, first)
    keep = F.when(F.col("keep").isNull(), F.col("k")).otherwise(F.col("keep.k"))
    return out.select(F.col("k").alias(key), keep.alias("keep_id"), F.col("size").alias("group_size"), _stays().alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, the one that ``exact_groups`` keeps, with its own columns. Rows go by row, not by key."""
    rows, own = identified(docs)
    return without(rows, own, _groups(rows, own, key, text, FIRST_DIGIT).filter(~_stays()).select("own"))
