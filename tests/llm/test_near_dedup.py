import random
import re

import numpy as np
import pyarrow as pa
import pytest

from umbraline.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, width):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    """Components of all pairs, by position; rows may repeat keys."""
    sets, up = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return sorted(((k, len(s), least.get(top(i)), k == least.get(top(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def check(df, width):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(map(tuple, near_dedup.near_groups(df, width=width).collect()), key=str)
    assert got == brute(rows, width)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(odd, width):
    check(odd, width)


def test_empty(empty):
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.drop_near(empty).count() == 0


@pytest.mark.parametrize(("small_tasks", "seed", "parts"), [(False, 4, 3), (True, 4, 3), (True, 5, 1), (True, 6, 7)])
def test_groups_of_near_copies(spark, monkeypatch, small_tasks, seed, parts):
    """Hub-and-variants groups, chains and families just under the bound, with tasks so small that every path is taken."""
    if small_tasks:
        monkeypatch.setattr(near_dedup, "TASK_MEMBERS", 3)
        monkeypatch.setattr(near_dedup, "TASK_SHINGLES", 500)
        monkeypatch.setattr(near_dedup, "CROWD", 2)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(4):
        text = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(25):
            own = list(text)
            for i in r.sample(range(len(own)), r.choice([3, 6, 8, 10, 12])):
                own[i] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
        chain = list(text)
        for i in range(0, 60, 5):
            chain[i] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(chain)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    check(df, 2)


def test_long_look_alikes(spark):
    """Growing prefixes of one text, each with some words changed: a bucket of many sizes whose tasks often hold nothing that fits a row."""
    r = random.Random(7)
    base = [f"w{r.randrange(60000)}" for _ in range(98_000)]
    rows = []
    for i in range(25):
        own = base[: 10_000 + i * 88_000 // 24]
        for j in r.sample(range(len(own)), len(own) * 3 // 100):
            own[j] = f"c{i}x{j}"
        rows.append((i, " ".join(own)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2)


def test_agreement_of_nothing():
    sig = np.zeros((0, near_dedup.BINS), np.uint8)
    assert near_dedup._agreeing(sig, np.zeros(near_dedup.BINS, np.uint8)).shape == (0,)
    assert near_dedup._alike(0, 0, np.array([10]), np.array([1]), np.zeros((1, near_dedup.BINS), np.uint8), 80).shape == (0,)


def test_driver_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"), 2)


def test_drop_keeps_one_of_each_group(spark):
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {'!' * (i % 2)}", "x") for i in range(6)] + [(9, "other text here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = near_dedup.drop_near(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} >= {0, 9}
    assert got.count() <= 3


def test_drop_goes_by_row(spark, tmp_path):
    """Repeated and null keys lose no text, and equal rows leave one, from files and from other tables."""
    t, u = (" ".join(f"{x}{i}" for i in range(40)) for x in "tu")
    rows = [(1, t), (5, u), (5, f"{t} more"), (None, "short"), (None, t), (None, "short"), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = near_dedup.drop_near(docs)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, t), (5, u), (None, "short"), (8, None), (8, None)], key=str)


@pytest.mark.parametrize("width", [1, 2])
def test_short_texts(spark, width):
    """Small sets over few words: every link by one shingle, and all groups that hang together by them."""
    r = random.Random(9)
    rows = []
    for _ in range(700):
        base = [f"v{r.randrange(300)}" for _ in range(r.randint(1, 12))]
        rows.append((len(rows), " ".join(base)))
        if r.random() < 0.6:
            more = base + [f"v{r.randrange(300)}" for _ in range(r.randint(1, 2))]
            rows.append((len(rows), " ".join(more)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), width)


def pairs_at_the_bound(n_pairs, sizes):
    """Pairs of sets of one-word shingles with a similarity of exactly 0.8: n of the larger set's 5 n / 4."""
    rows = []
    for size in sizes:
        for p in range(n_pairs):
            words = [f"s{size}p{p}w{i}" for i in range(size * 5 // 4)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:size]))]
    return rows


def test_no_link_at_the_bound_is_lost(spark):
    """Similarity of exactly 0.8 at 4 to 400 shingles, small sets by their exact way and large ones by signatures."""
    rows = pairs_at_the_bound(400, (4, 8, 12, 20, 40, 100)) + [(k + 10**6, t) for k, t in pairs_at_the_bound(60, (400,))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_groups(df, width=1)
    assert got.filter("component_id = doc_id").count() == len(rows) // 2


@pytest.mark.parametrize("n", [8, 40, 64, 400])
def test_least_agreement(n):
    """Signatures of 4,000 pairs with a similarity of exactly 0.8: none agrees less than what is fetched."""
    r = np.random.default_rng(n)
    pairs = 4000 if n < 100 else 500
    with np.errstate(over="ignore"):
        sets = [np.unique(r.integers(0, 1 << 63, n * 5 // 4, dtype=np.uint64) * np.uint64(2)) for _ in range(pairs)]
        both = [x for s in sets for x in (s, np.sort(r.permutation(s)[:n]))]
        sig = near_dedup.signatures(np.concatenate(both), np.cumsum([0, *map(len, both)])).astype(np.uint8)
    agree = (sig[::2] == sig[1::2]).mean(axis=1)
    assert agree.min() >= near_dedup._floor(np.array([n]))[0]


def test_signatures_by_table_and_by_attempts(monkeypatch):
    r = np.random.default_rng(3)
    sets = np.sort(r.integers(0, 1 << 63, 30, dtype=np.uint64))
    with np.errstate(over="ignore"):
        a = near_dedup.signatures(sets, np.array([0, 30]))
        monkeypatch.setattr(near_dedup, "FEW_BINS", 0)
        assert (a == near_dedup.signatures(sets, np.array([0, 30]))).all()


def test_crowded_bucket_of_dissimilar_texts(spark, monkeypatch):
    """Texts that share half of their words fall into common buckets without being links; a few pairs among them are."""
    monkeypatch.setattr(near_dedup, "CROWD", 20)
    r = random.Random(5)
    frame = [f"f{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(30)]
        rows.append((len(rows), " ".join(frame + own)))
        if i % 50 == 0:
            rows.append((len(rows), " ".join(frame + own[:-2] + ["z", f"y{i}"])))
    r.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 1)


def test_signatures_estimate_similarity():
    r = random.Random(1)
    for n, same in ((30, 27), (400, 380), (3000, 2400)):
        words = [f"x{r.random()}" for _ in range(2 * n)]
        a, b = " ".join(words[:n]), " ".join(words[:same] + words[n : 2 * n - same])
        with np.errstate(over="ignore"):
            sets, at = near_dedup.shingle_sets(pa.array([a, b, None, "", "one"]), 1)
            sig = near_dedup.signatures(sets, at)
        x, y = set(sets[: at[1]].tolist()), set(sets[at[1] : at[2]].tolist())
        assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.12
        assert np.diff(at).tolist()[2:] == [0, 0, 1] and len(set(sig[4].tolist())) == 1


def test_slices_of_batches(spark, monkeypatch, small):
    """Texts are worked on in slices; their bounds must not matter."""
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    check(docs.limit(120), 5)
