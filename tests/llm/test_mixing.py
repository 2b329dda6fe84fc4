import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from umbraline.llm import mixing


def fill(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Targets by sharing again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_takes(odd):
    got = mixing.taken(odd, block=16).collect()
    sizes, took = defaultdict(int), defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += words(r.text)
    want = fill(sizes)
    by_size = {(v): s for s, v in sizes.items()}
    for r in got:
        assert r.taken <= 2 * r.size
        took[by_size[r.source_size]] += r.taken
        assert abs(r.target - want[by_size[r.source_size]]) < 1e-6
    for s in sizes:
        assert took[s] == int(want[s] + 1e-9)


def test_schedule_spreads_sources(spark):
    rows = [(i, "w " * 100, "abc"[i % 3]) for i in range(300)]
    parts, placed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=50)
    got = parts.join(placed, "rid").select("slot", "src", "n").collect()
    total = sum(r.n for r in got)
    early = sum(r.n for r in got if r.slot < max(x.slot for x in got) / 10)
    assert abs(early / total - 0.1) < 0.02
    share = {s: sum(r.n for r in got if r.src == s) / total for s in "abc"}
    first = [r for r in got if r.slot < 60]
    for s in "abc":
        assert abs(sum(r.n for r in first if r.src == s) / sum(r.n for r in first) - share[s]) < 0.1


def test_reruns_and_partitions_agree(odd):
    key = lambda df: sorted((str(r.doc_id), r.size, r.taken) for r in df.collect())
    assert key(mixing.taken(odd.dropDuplicates(["doc_id", "text"]))) == key(mixing.taken(odd.dropDuplicates(["doc_id", "text"]).repartition(5)))


def test_empty_and_wordless(spark, empty):
    assert mixing.taken(empty).count() == 0
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.taken(df).collect()] == [(0, 0.0, 0)] * 2


def brute_slots(docs, block):
    """Slots of each row, from the whole schedule as a list: golden-ratio points, leftovers moved to the sources that are short."""
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    want, names = fill(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    take = {s: int(want[s] + 1e-9) for s in names}
    need = [-(-take[s] // block) for s in names]
    total, ranks, over, slots = sum(need), [0] * len(names), [], {}
    edges = [math.ceil(sum(need[:i]) * 2**31 / max(1, total)) for i in range(len(need) + 1)]
    for slot in range(total):
        x = (slot + 1) * mixing.GOLDEN % 2**31
        at = next(i for i in range(len(names)) if edges[i] <= x < edges[i + 1])
        if ranks[at] < need[at]:
            slots[at, ranks[at]] = slot
        else:
            over.append(slot)
        ranks[at] += 1
    short = [(i, k) for i in range(len(names)) for k in range(ranks[i], need[i])]
    slots |= dict(zip(short, over, strict=True))
    out = []
    for i, s in enumerate(names):
        own = [(hashlib.md5(f"mix-{'' if r.doc_id is None else r.doc_id}-{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest(), words(r.text), r) for r in docs if r.source == s]
        lo = 0
        for _, n, r in sorted(own, key=lambda x: x[:2]):
            mine, got = set(), 0
            for a in (lo, lo + sizes[s]):
                z = min(a + n, take[s])
                if a < z:
                    got += z - a
                    mine |= {(a, slots[i, k]) for k in range(a // block, (z - 1) // block + 1)}
            out.append((str(r.doc_id), n, got, min((x for _, x in mine), default=None), len(mine)))
            lo += n
    return sorted(out, key=str)


def test_slots_against_a_list(odd, spark, small):
    for docs, block in ((odd.dropDuplicates(["doc_id", "text"]), 16), (spark.read.parquet(f"{small}/documents.parquet"), 512)):
        got = [(str(r.doc_id), r.size, r.taken, r.first_slot, r.n_slots) for r in mixing.taken(docs, block=block).collect()]
        assert sorted(got, key=str) == brute_slots(docs.collect(), block)


def test_documents_of_the_mix(spark, tmp_path):
    """Whole rows in the order of their slots, by row: null and repeated keys and equal rows add or lose none."""
    rows = [(i if i % 3 else None if i % 2 else 6, "w " * (10 + i), "ab"[i > 30]) for i in range(40)] + [(99, "x y z", "b")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = mixing.mix_documents(docs)
        assert got.columns == docs.columns
        # a copy for each whole time that the words are taken
        want = Counter()
        for r in mixing.taken(docs.withColumn("source", F.col("source"))).collect():
            want[str(r.doc_id), r.size] += (2 * r.taken + r.size) // (2 * r.size)
        assert Counter((str(r.doc_id), words(r.text)) for r in got.collect()) == +want
        assert max(Counter(map(tuple, got.filter("text != 'x y z'").collect())).values()) == 2


def test_documents_keep_the_order_of_slots(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    at = {r.doc_id: r.first_slot for r in mixing.taken(docs).collect()}
    seen, places = set(), []
    for r in mixing.mix_documents(docs).collect():
        if r.doc_id not in seen:
            places.append(at[r.doc_id])
        seen.add(r.doc_id)
    assert places == sorted(places) and len(places) > 50


def test_hot_key_is_spread(spark):
    """Rows that share a key lie in the stream by their texts."""
    df = spark.range(9000).selectExpr("cast(null as long) as doc_id", "concat('t ', id) as text", "'s' as source")
    rows = mixing.stream(mixing.sized(df.withColumn("own", F.struct("text")), "own", "doc_id", "text", "source"), mixing.targets(df.selectExpr("source as src", "2L as size")))
    assert rows.groupBy("part").count().agg(F.max("count")).first()[0] < 1500
