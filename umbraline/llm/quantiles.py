"""Mergeable quantile summaries by simultaneous bisection.

``summarise`` keeps, for each batch of each group, the values at evenly spaced
ranks, with their exact ranks. All cut values of all batches are searched at
once: every one lies in an interval of values, and a pass counts how many rows
of each interval lie in each part of it, which is ``HALVINGS`` steps of a binary
search. Only parts that hold a wanted rank are searched on, so the rows that
take part shrink with every pass; an interval with no more distinct values than
parts has a part for each of them and is finished. No group is sorted, and no
row meets another one: counting is an aggregation with a first step before its
shuffle, and rows are dealt by their part of their interval, not by their group.

``merge`` makes one summary of the batches' summaries alone. What is known of a
value's rank in a batch are the ranks of the batch's points around it; sums of
these bounds over the batches bound its rank in the whole. Merged summaries have
bounds in place of exact ranks and can be merged again, so that any number of
batches are merged in rounds of bounded size.

``estimate`` answers rank questions from a summary, ``ranks`` counts what truly
lies below and up to given values.

Null values are dropped, null groups are groups. Ties share a point. Empty
tables give empty results. ``by`` names any columns but those of the results.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Halvings of an interval in one pass over the rows.
HALVINGS = 8
PARTS = 1 << HALVINGS
#: Ranks that a batch's summary keeps: every 80th part of its rows.
CUTS = 80
#: Least distinct values that a summary keeps, as far as there are so many.
LEAST = 4
#: Ranks that a merged summary tells apart.
MERGED_CUTS = 160
#: Tasks that ``ranks`` deals each group to.
SALTS = 16


def counted(rows: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """by, x and m: how many rows of a group have each value."""
    some = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("x"), (F.lit(1) if weight is None else weight).cast("long").alias("m"))
    return some.groupBy(*by, "x").agg(F.sum("m").alias("m"))


def _same(by: list[str], a: str, b: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])


def summarise(values: DataFrame, by: list[str], cuts: int = CUTS, least: int = LEAST, wanted: str | None = None) -> DataFrame:
    """Points of each group of counted values (``counted``): by, n (its rows), x, below and upto (how many rows are below x, and up to x), and wanted.

    They stand at the ranks ceil(j * n / cuts) for j from 1 to ``cuts``, at the
    ``least`` least values, and at those that the boolean column ``wanted``
    marks, a bounded number in each group. A pass ends in two tables in the shared folder,
    from which the next one goes on. Values must lie within 2**52 of zero.
    """
    # groups go by 128 bits of a hash of their names, which are carried along
    ids = ["g1", "g2"]
    values = values.select(F.xxhash64(*by).alias("g1"), F.xxhash64(F.lit(1), *[c for b in by for c in (F.col(b).isNull(), F.col(b))]).alias("g2"), *by, "x", "m", (F.col(wanted) if wanted else F.lit(False)).alias("wanted"))
    first = values.groupBy(*ids).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    zero = F.lit(0).cast("long")
    place, state = ["start", "cell"], ["n", "d", "lo", "hi", "before", "ahead"]
    cells = scratch(first.withColumns({c: zero for c in ("before", "ahead", *place)}), "groups")
    rows = values.select(*ids, *by, "x", "m", "wanted", *[zero.alias(c) for c in place])
    found = None
    while True:
        rows = scratch(_dealt(rows, cells.select(*ids, *place, *state)), "rows")
        # a value that has a part of its own is counted already
        single = rows.filter(F.col("d") <= PARTS).select(*ids, *by, *place, "n", "before", "ahead", F.col("m").alias("c"), F.lit(1).cast("long").alias("d"), F.col("x").alias("lo"), F.col("x").alias("hi"), "wanted")
        shared = rows.filter(F.col("d") > PARTS)
        parts = shared.groupBy(*ids, *place).agg(
            *[F.first(c).alias(c) for c in (*by, "n", "before", "ahead")], F.sum("m").alias("c"), F.count(F.lit(1)).alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("wanted").alias("wanted")
        )
        order = Window.partitionBy(*ids, "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.unionByName(single).withColumns({"upto": F.col("before") + F.sum("c").over(order), "seen": F.col("ahead") + F.sum("d").over(order)})
        parts = parts.withColumns({"before": F.col("upto") - F.col("c"), "ahead": F.col("seen") - F.col("d")})
        reached = lambda c: F.floor(F.col(c) * cuts / F.col("n"))
        parts = parts.filter((reached("upto") > reached("before")) | (F.col("ahead") < least) | F.col("wanted"))
        parts = scratch(parts.select(*ids, *by, *place, *state, "upto", "wanted"), "parts")
        points = parts.filter(F.col("lo") == F.col("hi")).select(*by, "n", F.col("lo").alias("x"), F.col("before").alias("below"), "upto", "wanted")
        found = points if found is None else found.unionByName(points)
        cells = parts.filter(F.col("lo") < F.col("hi")).drop("upto", "wanted")
        if cells.isEmpty():
            return found
        rows = shared.select(*ids, *by, "x", "m", "wanted", *place)


def _dealt(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of the open intervals, each in its part: ``start`` is the interval's least value, ``cell`` the part's place in it."""
    on = ["g1", "g2", "start", "cell"]
    met = rows.join(cells.hint("merge"), on)
    width = (F.col("hi") - F.col("lo") + 1) / PARTS
    cell = F.when(F.col("d") <= PARTS, F.col("x")).otherwise(F.floor((F.col("x") - F.col("lo")) / width)).cast("long")
    own = [F.col(c) for c in rows.columns if c not in ("start", "cell")]
    return met.select(*own, F.col("lo").alias("start"), cell.alias("cell"), "n", "d", "before", "ahead")


BOUNDS = ("below_lo", "below_hi", "upto_lo", "upto_hi")


def bounded(points: DataFrame, by: list[str]) -> DataFrame:
    """Points with exact ranks as points with bounds."""
    both = {"below_lo": "below", "below_hi": "below", "upto_lo": "upto", "upto_hi": "upto"}
    return points.select(*by, "n", "x", *[F.col(c).alias(b) for b, c in both.items()])


def merge(points: DataFrame, by: list[str], batch: str, cuts: int = MERGED_CUTS, least: int = LEAST) -> DataFrame:
    """The summary of each group: by, n, x and bounds, from the bounded points of its batches (``by`` and ``batch``).

    A value's rank lies between the sums of what the batches know of it: at its
    own point a batch's bounds, elsewhere those of the points before and after.
    Of the merged points stay the first of each rank's ``cuts``-th part, the
    last, and the ``least`` least ones. A task reads the points of a group's
    batches, so that their number must be bounded; merge more of them in rounds.
    """
    # dealt by group once, which serves all that follows
    points = points.repartition(*by)
    own = Window.partitionBy(*by, batch).orderBy("x")
    before = lambda c: F.coalesce(F.lag(c).over(own), F.lit(0))
    after = lambda c, end: F.coalesce(F.lead(c).over(own), end)
    steps = points.withColumns(
        {
            # what a value below the point is known by goes to what the point is known by, and on to what a value above it is
            "at_below_lo": F.col("below_lo") - before("upto_lo"), "past_lo": F.col("upto_lo") - before("upto_lo"),
            "at_upto_hi": F.col("upto_hi") - F.col("below_hi"), "past_hi": after("below_hi", F.col("n")) - F.col("below_hi"),
            "base": F.when(F.row_number().over(own) == 1, F.col("below_hi")).otherwise(0), "own_n": F.when(F.row_number().over(own) == 1, F.col("n")).otherwise(0),
        }
    )
    sums = ["at_below_lo", "past_lo", "at_upto_hi", "past_hi", "base", "own_n"]
    steps = steps.groupBy(*by, "x").agg(*[F.sum(c).alias(c) for c in sums])
    every = Window.partitionBy(*by)
    order = every.orderBy("x")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    base, low, high = F.sum("base").over(every), so_far("past_lo"), so_far("past_hi")
    out = steps.withColumns(
        {
            "n": F.sum("own_n").over(every), "below_lo": low + F.col("at_below_lo"), "below_hi": base + high, "upto_lo": low + F.col("past_lo"),
            "upto_hi": base + high + F.col("at_upto_hi"), "place": F.row_number().over(order), "last": F.lead("x").over(order).isNull(),
        }
    )
    out = out.withColumn("part", F.floor((F.col("upto_lo") + F.col("upto_hi")) * cuts / (2 * F.col("n"))))
    new = F.coalesce(F.col("part") > F.lag("part").over(order), F.lit(True))
    out = out.withColumn("new", new).filter(F.col("new") | (F.col("place") <= least) | F.col("last"))
    return out.select(*by, "n", "x", *BOUNDS)


def estimate(points: DataFrame, by: list[str], parts: int = 10) -> DataFrame:
    """by, n, points, i, target (ceil(i * n / parts) for i below ``parts``), answer and its bounds.

    The answer is the point whose likely ranks are nearest to the target, the
    lesser of two. Points have bounds (``bounded``, ``merge``).

    A point stands for the targets up to half way between its last likely rank
    and the next point's first one, so each of a summary's points is read once.
    """
    own = Window.partitionBy(*by).orderBy("x")
    last = F.col("upto_lo") + F.col("upto_hi")
    first = F.col("below_lo") + F.col("below_hi") + 2
    # a target t is nearer to this point if 2 * (2 * t) is at most twice the sum of both, which are doubled ranks
    reach = F.floor((last + F.lead(first).over(own)) / 4)
    rows = points.withColumn("reach", F.coalesce(reach, F.col("n")))
    rows = rows.withColumns({"upper": F.greatest("reach", F.max("reach").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))})
    rows = rows.withColumns({"from": F.coalesce(F.lag("upper").over(own), F.lit(0)), "points": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    index = lambda t: F.least(F.floor(t * parts / F.col("n")), F.lit(parts - 1)).cast("int")
    rows = rows.withColumns({"i0": index(F.col("from")) + 1, "i1": index(F.col("upper"))}).filter(F.col("i0") <= F.col("i1"))
    rows = rows.select(*by, "n", "points", F.explode(F.sequence("i0", "i1")).alias("i"), F.col("x").alias("answer"), *BOUNDS)
    return rows.withColumn("target", F.ceil(F.col("i") * F.col("n") / parts).cast("long"))


def truth(points: DataFrame, by: list[str], parts: int = 10) -> DataFrame:
    """by, i and exact_x, the value of rank ceil(i * n / parts), from points of ``summarise`` whose cuts are a multiple of ``parts``."""
    index = lambda c: F.least(F.floor(F.col(c) * parts / F.col("n")), F.lit(parts - 1)).cast("int")
    rows = points.withColumns({"i0": index("below") + 1, "i1": index("upto")}).filter(F.col("i0") <= F.col("i1"))
    return rows.select(*by, F.explode(F.sequence("i0", "i1")).alias("i"), F.col("x").alias("exact_x"))


def ranks(values: DataFrame, asked: DataFrame, by: list[str], value: str = "answer", most: int = 9) -> DataFrame:
    """by, the asked value, n_below and n_upto: how many counted rows of the group are below it, and up to it.

    A group's asked values, ``most`` different ones, meet its rows as one sorted
    array, dealt to ``SALTS`` tasks by the rows' values; a row is counted between
    two of them, and sums over these gaps are the ranks.
    """
    lists = asked.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("list"))
    lists = lists.withColumn("list", F.when(F.size("list") > most, F.raise_error(F.lit("more values asked than ``most``"))).otherwise(F.col("list")))
    dealt = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = values.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
    met = rows.alias("r").join(dealt.alias("l").hint("merge"), (F.col("r.salt") == F.col("l.salt")) & _same(by, "r", "l"))

    def gap(upto: bool) -> Column:
        asked_at = [F.get("list", F.lit(i)) for i in range(most)]
        return functools.reduce(lambda a, b: a + b, [F.coalesce((a <= F.col("x")) if upto else (a < F.col("x")), F.lit(False)).cast("int") for a in asked_at])

    gaps = met.select(*[F.col(f"r.{c}").alias(c) for c in by], gap(True).alias("under"), gap(False).alias("over"), "m")
    gaps = gaps.groupBy(*by, "under", "over").agg(F.sum("m").alias("m"))
    # a row is below the values after the first ``under`` ones, and up to those after the first ``over`` ones
    summed = gaps.groupBy(*by).agg(F.collect_list(F.struct("under", "over", "m")).alias("gaps"))
    both = lists.alias("l").join(summed.alias("g").hint("merge"), _same(by, "l", "g"), "left").select(*[F.col(f"l.{c}").alias(c) for c in by], "list", "gaps")
    each = both.select(*by, "gaps", F.posexplode("list").alias("i", value))
    zero = F.lit(0).cast("long")
    count = lambda c: F.aggregate("gaps", zero, lambda s, g: s + F.when(g[c] <= F.col("i"), g["m"]).otherwise(zero))
    return each.select(*by, value, *[F.coalesce(count(c), zero).alias(n) for c, n in (("under", "n_below"), ("over", "n_upto"))])


def report(values: DataFrame, by: list[str], batch: str, parts: int = 10, least_rows: int = 20, percent: int = 5) -> DataFrame:
    """Answers of every batch's summary and of the merged ones (batch -1), held against exact ranks.

    ``values``: counted values of ``by`` and ``batch``. For summaries of
    ``least_rows`` rows or more: by, batch, i, n, target, exact_x, points,
    answer, n_below, n_upto, rank_error, and within (whether the error is at most
    that percentage of the rows).
    """
    each = [*by, batch]
    points = summarise(values, each)
    large = points.filter(F.col("n") >= least_rows)
    own = estimate(bounded(large, each), each, parts).withColumns({"n_below": F.col("below_lo"), "n_upto": F.col("upto_lo")})
    own = _with(own, truth(large, each, parts), [*each, "i"])
    whole = merge(bounded(points, each), by, batch).filter(F.col("n") >= least_rows)
    asked = scratch(estimate(whole, by, parts), "answers")
    # answers are values of the group, so their ranks are searched with the exact cut values, in the same passes
    marks = asked.select(*by, F.col("answer").alias("x"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("asked"))
    every = values.select(*by, "x", "m", F.lit(False).alias("asked")).unionByName(marks)
    every = scratch(every.groupBy(*by, "x").agg(F.sum("m").alias("m"), F.max("asked").alias("asked")), "every")
    exact = summarise(every, by, cuts=parts, least=0, wanted="asked")
    placed = exact.filter("wanted").select(*by, F.col("x").alias("answer"), F.col("below").alias("n_below"), F.col("upto").alias("n_upto"))
    joined = _with(_with(asked, truth(exact, by, parts), [*by, "i"]), placed, [*by, "answer"]).withColumn(batch, F.lit(-1))
    columns = [*each, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto"]
    out = own.select(*columns).unionByName(joined.select(*columns))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", error).withColumn("within", F.col("rank_error") * 100 <= F.col("n") * percent)


def _with(rows: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """The rows with the columns of ``more``, which has one row for each."""
    new = [c for c in more.columns if c not in on]
    met = rows.alias("r").join(more.alias("m").hint("merge"), _same(on, "r", "m"))
    return met.select("r.*", *[F.col(f"m.{c}") for c in new])
