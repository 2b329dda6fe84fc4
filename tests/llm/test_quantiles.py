import math
import random
from collections import defaultdict

import pytest

from umbraline.llm import quantiles

SCHEMA = "stream string, grp string, batch int, v long, m long, x long, n long, cell string"


def rows_of(seed):
    """Groups of every kind: tiny, tied, skewed, wide, with null names; one holds most rows."""
    r = random.Random(seed)
    out = []

    def add(stream, grp, n, draw):
        for _ in range(n):
            out.append((stream, grp, r.randrange(8), draw(), 1, 2, 3, "y"))

    add("a", "one value", 300, lambda: 7)
    add("a", "rare", 500, lambda: r.choice([5] * 200 + [1, 2, 9, 11]))
    add("a", "wide", 900, lambda: r.randrange(-(10**12), 10**12))
    add("a", "tail", 3000, lambda: int(r.paretovariate(0.6) * 100))
    add("b", "hot", 9000, lambda: int(r.gauss(0, 4000)))
    add("b", None, 60, lambda: r.randrange(40))
    add(None, None, 25, lambda: r.randrange(4))
    for i in range(30):
        add("c", f"g{i}", 1 + i * 3, lambda: r.randrange(1000))
    out += [("a", "null", 0, None, 1, 2, 3, "y")]
    r.shuffle(out)
    return out


def held(rows):
    """Values by group and batch, and by group with batch -1."""
    groups = defaultdict(list)
    for s, g, b, x, *_ in rows:
        if x is not None:
            groups[s, g, b].append(x)
            groups[s, g, -1].append(x)
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize(("seed", "parts"), [(1, 8), (2, 4)])
def test_report_against_sorted_lists(spark, monkeypatch, seed, parts):
    """Ranks are exact, answers lie within the bound, with few and with many halvings in a pass."""
    monkeypatch.setattr(quantiles, "PARTS", 1 << parts)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    values = quantiles.counted(df, ["stream", "grp", "batch"], "v")
    got = quantiles.report(values, ["stream", "grp"], "batch").collect()
    want = {k: v for k, v in held(rows).items() if len(v) >= 20}
    assert len(got) == 9 * len(want)
    last = {}
    for r in sorted(got, key=lambda r: (str(r[:3]), r.i)):
        key = (r.stream, r.grp, r.batch)
        v = want[key]
        n, t = len(v), math.ceil(r.i * len(v) / 10)
        assert (r.n, r.target, r.exact_x) == (n, t, v[t - 1])
        assert r.n_below == sum(x < r.answer for x in v) and r.n_upto == sum(x <= r.answer for x in v)
        assert r.rank_error == max(0, r.n_below + 1 - t, t - r.n_upto) and r.within and 1000 * r.rank_error <= 50 * n
        assert v[0] <= r.answer <= v[-1] and last.get(key, r.answer) <= r.answer
        assert min(4, len(set(v))) <= r.points <= min(n, 400)
        last[key] = r.answer


def test_points_are_exact_and_few(spark):
    rows = rows_of(3)
    by = ["stream", "grp", "batch"]
    points = defaultdict(list)
    for r in quantiles.summarise(quantiles.counted(spark.createDataFrame(rows, SCHEMA), by, "v"), by).collect():
        points[r.stream, r.grp, r.batch].append((r.x, r.below, r.upto, r.n))
    want = {k: v for k, v in held(rows).items() if k[2] >= 0}
    assert points.keys() == want.keys()
    for k, v in want.items():
        wanted = {v[math.ceil(j * len(v) / 80) - 1] for j in range(1, 81)} | set(sorted(set(v))[:4])
        assert {p[0] for p in points[k]} == wanted and len(points[k]) == len(wanted)
        assert all((b, u, n) == (sum(y < x for y in v), sum(y <= x for y in v), len(v)) for x, b, u, n in points[k])


def test_merged_bounds_hold_and_merge_again(spark):
    """Bounds of merged summaries, and of summaries merged from merged ones, hold the true ranks."""
    rows = rows_of(4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("stream", "grp", "batch", "batch % 2 as half", "v")
    by = ["stream", "grp", "half", "batch"]
    points = quantiles.bounded(quantiles.summarise(quantiles.counted(df, by, "v"), by), by)
    once = quantiles.merge(points.drop("half"), ["stream", "grp"], "batch")
    twice = quantiles.merge(quantiles.merge(points, ["stream", "grp", "half"], "batch"), ["stream", "grp"], "half")
    for merged in (once, twice):
        for r in merged.collect():
            v = held(rows)[r.stream, r.grp, -1]
            assert r.n == len(v) and r.x in v
            assert r.below_lo <= sum(y < r.x for y in v) <= r.below_hi and r.upto_lo <= sum(y <= r.x for y in v) <= r.upto_hi


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quantiles.report(quantiles.counted(df, ["stream", "grp", "batch"], "v"), ["stream", "grp"], "batch").count() == 0
