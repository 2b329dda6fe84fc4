import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from umbraline.llm import pieces, token_counts  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\na", "a \n b", "a\n\n\nb", "▁", "▁▁x ▁", "a\tb\r\nc", "<s>x</s>", "\x00", "é𝔘🙂", "   x   y   ", "\n", " \n ", "a" * 5000]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_vocabulary_allows_the_split(model):
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    assert not [p for p in names if "\n" in p or any(a != "▁" and b == "▁" for a, b in zip(p, p[1:]))]


def test_counts_of_odd_texts(model):
    count = token_counts.counter(PATH)
    assert count(pa.array(ODD)).tolist() == [len(model.encode(t)) for t in ODD]
    assert count(pa.array([None, "a", None])).tolist() == [0, 1, 0]
    assert count(pa.array(["a b"] * 3, pa.string())).tolist() == [2, 2, 2]


def test_token_counts_equal_the_library(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        n = len(model.encode(r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 4096)


def test_token_counts_of_odd_tables(odd, empty, model):
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd, PATH).collect())
    assert got == sorted((str(r.doc_id), len(model.encode(r.text or ""))) for r in odd.collect())
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_lossless(spark, odd, empty):
    coded = pieces.decode(pieces.encode(odd, PATH, keep=["lang", "text"]), PATH).collect()
    assert len(coded) == odd.count()
    assert all(r.decoded == r.text and r.lossless for r in coded)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert all(r.lossless for r in pieces.round_trip(df, PATH).collect())
    assert pieces.encode(empty, PATH).count() == 0


def test_reproducible_and_seeded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    a = key(pieces.round_trip(docs, PATH))
    assert a == key(pieces.round_trip(docs.repartition(5), PATH))
    assert a != key(pieces.round_trip(docs, PATH, seed=12))


def test_draws_do_not_depend_on_slices(spark, small):
    """The same ids, however rows share a slice, and where a text's pre-tokens stand in its lattices."""
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()][:120] + ODD
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(77)
    sampler = pieces.Sampler(pieces.load(PATH))
    with np.errstate(over="ignore"):
        whole = sampler.segment(texts, keys)
        alone = [sampler.segment([t], keys[i : i + 1])[0] for i, t in enumerate(texts)]
        turned = sampler.segment(texts[::-1], keys[::-1])[::-1]
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(whole, alone, turned, strict=True))


def test_size_of_slices(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = (sorted((r.doc_id, r.ids) for r in pieces.encode(docs, PATH, size=n).collect()) for n in (10_000, 1 << 20))
    assert a == b


def test_samples_follow_the_weights():
    v = pieces.load(PATH)
    n = 40_000
    with np.errstate(over="ignore"):
        ids = pieces.Sampler(v).segment(["hello"] * n, np.arange(n, dtype=np.uint64))
    seen, word, weights = Counter(tuple(x.tolist()) for x in ids), "▁hello", {}
    for m in range(2 ** (len(word) - 1)):
        cuts = [0, *(i + 1 for i in range(len(word) - 1) if m >> i & 1), len(word)]
        parts = [word[a:z] for a, z in zip(cuts, cuts[1:])]
        if all(p in v.pieces for p in parts):
            weights[tuple(v.pieces[p][0] for p in parts)] = math.exp(sum(v.pieces[p][1] for p in parts))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    assert max(abs(seen[k] / n - w / total) for k, w in weights.items()) < 0.01
