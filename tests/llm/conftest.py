from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k long, rid long, n long, bucket string, shard string, lang_pred string, ids string, kept string"


def fill(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, 3, "x", "y", "z", "w", "v")


def prose(seed: int, n: int, words: list[str]) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


EN = "the of and house river stone walk green light morning table under window letter garden winter silver market".split()
DE = "der und die haus fluss stein gehen grün licht morgen tisch unter fenster brief garten winter silber markt".split()


def odd_rows() -> list[tuple]:
    rows = [fill(i, prose(i, 60 + i % 40, EN if i % 3 else DE), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows += [
        fill(100, None), fill(101, ""), fill(102, " \t\n "), fill(103, "12 34 !!"), fill(104, "word"), fill(105, "Two Words"),
        fill(106, "two  words"), fill(None, prose(1, 80, EN)), fill(107, prose(3, 63, EN), None, None), fill(108, prose(5, 3000, EN), "en", "long"),
        fill(109, "x" * 50_000), fill(110, "tab\tand  spaces\n\n ▁ \x00 é 𝔘 end "), fill(3, prose(3, 63, DE), "de", "s3"),
    ]
    return rows + rows[:5] + [fill(None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows and keys, columns with names that operators use."""
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
