import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from umbraline.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    tokens = [[*WORD.findall((t or "").translate(LOW)), ""] for _, t in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total = sum(c.values())
    return [
        (k, h, len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws))
        for (k, _), ws, h in zip(rows, tokens, held)
    ]


def compare(df, **options):
    got = sorted(lm.score(df, **options).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
    return got


@pytest.mark.parametrize("vocabulary", [4, 40, 10_000])
def test_base_of_odd_rows(odd, vocabulary):
    got = compare(odd, vocabulary=vocabulary)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_beats_the_base(spark, small):
    got = compare(spark.read.parquet(f"{small}/documents.parquet"))
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain a token", gain)
    assert gain > 0.1


def test_empty(empty):
    assert lm.score(empty).count() == 0


def test_all_held_out(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = lm.score(df, held=F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2
    assert all(math.isfinite(r.score) for r in got)


def small_model(n=30, seed=1):
    rng = np.random.default_rng(seed)
    words = {f"w{i}": i + 1 for i in range(n)}
    model = lm.Model(words, np.array([50, *rng.integers(1, 90, n)]), np.ones(lm.RARE_LEAVES, dtype=np.int64) + rng.integers(0, 9, lm.RARE_LEAVES), 2000, 60)
    lm.classify(model, rng.random((model.known + 1, 2 * lm.NEIGHBOURS)))
    model.rows = [rng.normal(size=r.shape).astype(np.float32) for r in model.rows]
    return model


def test_it_is_a_distribution():
    """Over all frequent words and all leaves of other words, probabilities sum to one after any history."""
    model = small_model()
    every = np.concatenate([np.arange(model.known), lm.RARE + np.arange(lm.RARE_LEAVES)]).astype(np.int32)
    for history in ([3, 7], [30, 1], [lm.RARE + 12345678, 2]):
        ids = np.array([[*history, w] for w in every], dtype=np.int32)
        p = 10 ** model.score(ids.ravel(), np.arange(len(ids)) * 3)[2::3]
        # the words of a leaf of other words share (N + V + 1) / (N + V + 1) of it
        p[model.known :] *= model.other_totals
        empty = 1e-3  # leaves without a word have next to nothing
        assert p.sum() == pytest.approx(1, abs=empty)


def brute_score(model, ids, counts):
    """log10 probability of a text, branch by branch, in plain numbers."""
    out = 0.0
    begin = (1 << 31) - 1
    mask = (1 << 64) - 1
    mixed = lambda x, salt: (y := (x * 8 + salt) * 0x9E3779B97F4A7C15 & mask) ^ (y >> 29)
    for t, w in enumerate(ids):
        one = ids[t - 1] if t else begin
        two = ids[t - 2] if t > 1 else begin
        leaf = int(model.place[w]) if w < lm.RARE else lm.RARE + (w - lm.RARE) % lm.RARE_LEAVES
        for level in range(lm.LEVELS):
            node, branch = leaf // 16 ** (lm.LEVELS - level), leaf // 16 ** (lm.LEVELS - level - 1) % 16
            rows = [(((h + node & mask) << 2) + level & mask) * 0xBF58476D1CE4E5B9 % 2**64 >> 48 for h in (mixed(one, 1), mixed(two, 2), mixed(one * 1_000_003 + two, 3))[: lm.FEATURES[level]]]
            logits = [float(model.bias[level][node][b]) + sum(float(model.rows[level][r][b]) for r in rows) for b in range(16)]
            out += (logits[branch] - math.log(sum(map(math.exp, logits)))) / math.log(10)
        if w >= lm.RARE:
            out += math.log10((counts.get(w, 0) + 1) / model.other_totals[(w - lm.RARE) % lm.RARE_LEAVES])
    return out


def test_score_branch_by_branch():
    model = small_model(200, 4)
    rng = np.random.default_rng(5)
    for n in (1, 2, 40):
        ids = np.where(rng.random(n) < 0.2, lm.RARE + rng.integers(0, 1 << 30, n), rng.integers(0, 201, n)).astype(np.int32)
        assert model.score(ids, np.array([0])).sum() == pytest.approx(brute_score(model, ids.tolist(), {}), abs=1e-4)


def test_step_is_the_gradient():
    """One update against sums over tokens one by one."""
    rng = np.random.default_rng(2)
    rows, at = rng.integers(0, 5, (40, 3)).astype(np.uint16), rng.integers(0, lm.WAYS, 40)
    weights, past, uses = rng.normal(size=(6, lm.WAYS)).astype(np.float32), np.zeros(6, np.float32), np.zeros(6, np.float32)
    grad = np.zeros((6, lm.WAYS))
    for r, a in zip(rows, at):
        logits = weights[r].sum(axis=0).astype(np.float64)
        p = np.exp(logits) / np.exp(logits).sum()
        p[a] -= 1
        for x in r:
            grad[x] += p
    want = weights - lm.RATE * grad / np.sqrt((grad**2).sum(axis=1) / lm.WAYS + 1e-6)[:, None]
    lines = np.ascontiguousarray(rows.T)
    lm._step(lm._summed_rows(np.zeros((1, lm.WAYS), np.float32), np.zeros(40, np.int64), weights, lines), at, lines, weights, past, uses)
    assert np.allclose(weights, want, atol=1e-4) and uses.tolist() == np.bincount(rows.ravel(), minlength=6).tolist()


def test_segment_sums():
    rng = np.random.default_rng(4)
    e = rng.normal(size=(50, lm.WAYS)).astype(np.float32)
    for sizes in ([1, 2, 40, 7, 8, 9, 1], [1], [30], [1] * 20):
        at = rng.integers(0, 50, sum(sizes))
        first = np.cumsum(sizes) - sizes
        got = lm._segment_sums(e, at, first, np.array(sizes))
        assert np.allclose(got, [e[at[a : a + n]].sum(axis=0) for a, n in zip(first, sizes)], atol=1e-4)


def test_scores_do_not_depend_on_the_layout(spark, small, monkeypatch):
    """However the rows are dealt, and whatever the default parallelism; several training tasks."""
    monkeypatch.setattr(lm, "TASK_TOKENS", 30_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    score = lambda df: {r.doc_id: r.score for r in lm.score(df).collect()}
    a = score(docs)
    for n in (1, 7):
        b = score(docs.repartition(n, "text"))
        assert all(b[k] == pytest.approx(v, rel=1e-6) for k, v in a.items())


def test_history_of_rare_words_counts(spark):
    """After a word beyond the vocabulary, the word that always follows it is likelier than elsewhere."""
    rows = [(i, " ".join(f"rare{i % 7} tail{i % 7} x{j} y{j}" for j in range(60))) for i in range(70)]
    df = spark.createDataFrame(rows + [(1000, "rare3 tail3"), (1001, "rare3 tail4")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.score for r in lm.score(df, held=F.col("doc_id") >= 1000, vocabulary=3).collect()}
    assert got[1000] > got[1001] + 0.5


def test_codes_words_as_the_contract_does():
    model = lm.Model({"the": 1, "é": 2}, np.array([1, 1, 1]), np.ones(lm.RARE_LEAVES, dtype=np.int64), 3, 3)
    texts = ["The  the\n\x0bÉ é ", "", None, " ", "a\x1cb\x85c\u3000d the"]
    ids, starts, rare = model.code(pa.array(texts))
    bounds = [*starts.tolist()[: len(texts)], len(ids)]
    got = [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])]
    assert [len(x) for x in got] == [5, 1, 1, 1, 3]
    assert got[0][:2] == [1, 1] and got[0][3] == 2 and got[0][2] >= lm.RARE and all(x[-1] == 0 for x in got)
    assert rare.to_pylist() == [["É"], [], [], [], ["a\x1cb\x85c\u3000d"]]
