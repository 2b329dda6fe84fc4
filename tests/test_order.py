"""Deltas out of order, words under spans, entries near a miss, calibrated tags: each against plain code."""

from __future__ import annotations

import itertools
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from umbraline.operators import images, ner
from umbraline.operators import restore as R
from umbraline.streaming import deltas as D

from test_vaults import Handle

TOKEN = "{{OPF:EMAIL:4ov1qksihef66la1}}"
COLUMNS = ["seq", "chunk", "is_last", "at_ms"]


class Clock(Handle):
    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def told(frames):
    return [tuple(r)[1:] for f in frames for r in f.itertuples(index=False)]


def feed(p, clock, *rows):
    return told(p.handleInputRows(("k",), iter([pd.DataFrame(list(rows), columns=COLUMNS)]), clock))


def expire(p, clock, now):
    clock.now = now
    due = [t for t in clock.timers if t <= now]
    for t in due:
        clock.timers.remove(t)
    return told(p.handleExpiredTimer(("k",), clock, clock)) if due else []


def start():
    clock, p = Clock(), D.ReorderProcessor()
    p.init(clock)
    return clock, p


def test_any_order_gives_the_text():
    text = f"a {TOKEN} b {{ {TOKEN[:9]}"
    chunks = [text[i : i + 5] for i in range(0, len(text), 5)]
    rows = [(i, c, i == len(chunks) - 1, i) for i, c in enumerate(chunks)]
    for seed in range(20):
        clock, p = start()
        order = rows * 2  # each delta twice
        random.Random(seed).shuffle(order)
        got = [x for i in range(0, len(order), 4) for x in feed(p, clock, *order[i : i + 4])]
        assert "".join(x[2] for x in got) == text and [x[0] for x in got] == list(range(len(got))) and not any(x[3] for x in got)
        assert any(TOKEN in x[2] for x in got)  # no piece ends inside the token


def test_gaps_close_behind_the_watermark():
    clock, p = start()
    assert feed(p, clock, (0, "x {{OPF:EM", False, 10)) == [(0, 0, "x ", 0)] and clock.timers == []
    assert feed(p, clock, (2, "AIL:4ov1qksihef66la1}} y", False, 30), (5, "z", False, 50)) == [] and clock.timers == [30]
    # what was held goes out by itself, so the pieces around the gap make no token
    assert expire(p, clock, 30) == [(1, 0, "{{OPF:EM", 0), (2, 2, "AIL:4ov1qksihef66la1}} y", 1)] and clock.timers == [50]
    assert feed(p, clock, (1, "late", False, 60), (3, "3", False, 40)) == [(3, 3, "3", 0)]
    assert feed(p, clock, (6, "!", True, 55), (6, "again", True, 56)) == []
    assert expire(p, clock, 50) == [(4, 5, "z", 1), (5, 6, "!", 0)] and clock.timers == [51]
    assert feed(p, clock, (7, "after the end", False, 70)) == [] and clock.timers == [70]
    assert expire(p, clock, 70) == [] and not p.state.exists() and not p.waiting and not clock.timers


def test_shuffled_batches_give_the_same_text(spark, tmp_path):
    rng, rows, want = random.Random(3), [], {}
    for s in range(5):
        want[f"s{s}"] = "".join(rng.choice([TOKEN, "word ", "{{", "é"]) for _ in range(12))
        cut = [want[f"s{s}"][i : i + 7] for i in range(0, len(want[f"s{s}"]), 7)]
        rows += [(f"s{s}", i, c, i == len(cut) - 1, f"2024-01-01T00:00:{i:02d}Z") for i, c in enumerate(cut)]
    rng.shuffle(rows)
    schema = "stream_id string, seq long, chunk string, is_last boolean, at timestamp"
    for i in range(3):
        pd.DataFrame(rows[i::3], columns=["stream_id", "seq", "chunk", "is_last", "at"]).to_json(tmp_path / f"in{i}.json", orient="records", lines=True)
        os.utime(tmp_path / f"in{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    made = D.reordered_stream(source, "10 minutes").writeStream.format("memory").queryName("in_order").outputMode("append")
    query = made.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = spark.table("in_order").orderBy("stream_id", "n").collect()
    assert {s: "".join(r.text for r in got if r.stream_id == s) for s in want} == want and not any(r.missing for r in got)
    for s in want:
        pieces = [r.text for r in got if r.stream_id == s]
        assert sum(x.count(TOKEN) for x in pieces) == want[s].count(TOKEN)


def test_words_under_spans(spark):
    rng = random.Random(5)
    words = [("i", k // 9, k, "x" * rng.choice([0, 1, 2, 7, 300]), k, 0, 3, 3, 1.0) for k in range(150)]
    words += [("j", 0, 0, "only", 0, 0, 3, 3, 1.0)]
    table = spark.createDataFrame(words, images.WORD)
    length = sum(len(w[3]) + 1 for w in words[:-1])
    cuts = [sorted((rng.randrange(length), rng.randrange(length) if k % 3 else 0)) for k in range(40)] + [[7, 7], [0, length], [length, length + 500]]
    spans = spark.createDataFrame([("i", k, a, z, "c") for k, (a, z) in enumerate(cuts)] + [("j", 99, 1, 2, "c"), ("none", 98, 0, 9, "c")], "image_id string, span_id int, start int, end int, category string")
    at, want = 0, []
    for w in words[:-1]:
        want += [(k, w[2]) for k, (a, z) in enumerate(cuts) if at + len(w[3]) > a and at < z]
        at += len(w[3]) + 1
    got = [(r.span_id, r.word_index) for r in images.covered_words(table, spans).collect()]
    assert sorted(got) == sorted([*want, (99, 0)])
    assert images.covered_words(table.limit(0), spans).count() == 0


def test_many_words_on_a_page(spark):
    n = 100_000
    words = spark.range(n).selectExpr("'i' image_id", "cast(id div 20 as int) line_index", "cast(id as int) word_index", "'word' text", "0 left", "0 top", "9 width", "9 height", "1d confidence")
    spans = spark.range(n // 2).selectExpr("'i' image_id", "cast(id as int) span_id", "cast(id * 10 as int) start", "cast(id * 10 + 4 as int) end", "'c' category")
    met = images.covered_words(words, spans)
    assert met.count() == n // 2 and met.filter("word_index != span_id * 2").count() == 0
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "__at" in plan[plan.index("Join") :].splitlines()[0]  # the stretch is a key of the join


def test_only_entries_near_a_miss_go_on(spark):
    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz0123456789"
    hashes = ["".join(rng.choice(letters) for _ in range(16)) for _ in range(5_000)]
    vault = spark.createDataFrame([("s", "CARD", h, h) for h in hashes] + [("t", "CARD", h, h) for h in hashes[:50]] + [(None, "CARD", hashes[0], "none")], "session_id string, label string, hash string, text string")
    h = hashes[17]
    edits = [h[:i] + c + h[j:] for i in range(17) for j, c in ((i + 1, ""), (i + 1, "_"), (i, "_")) if i < 16 or j == i]
    schema = "session_id string, label string, hash string"
    for edit in edits:
        assert set(_halves(h)) & set(_halves(edit)), edit
    missed = spark.createDataFrame([("s", "CARD", e) for e in edits] + [("s", "EMAIL", hashes[3]), (None, "CARD", hashes[0][:8] + "_" + hashes[0][9:])], schema)
    got = {(r["__s"], r["__h"]) for r in R.near_entries(missed, vault).collect()}
    assert got == {("s", h), (None, hashes[0])}
    assert R.near_entries(missed.limit(0), vault).count() == 0
    column = spark.createDataFrame([(e,) for e in edits], "e string").select("e", R.halves(F.col("e")).alias("p")).collect()
    assert all(r.p == _halves(r.e) for r in column)


def _halves(h):
    return ["<" + h[:7], ">" + h[-7:]]


def test_biases_against_all_paths():
    tags = ["O", *[f"{b}-{c}" for c in ("x", "y") for b in "BIES"]]
    rng = np.random.default_rng(2)
    allowed = {("O", "O"), ("O", "B"), ("O", "S"), ("E", "O"), ("S", "O"), ("E", "B"), ("E", "S"), ("S", "B"), ("S", "S"), ("B", "I"), ("I", "I"), ("B", "E"), ("I", "E")}
    kinds = {"O": "background", "E": "end", "S": "end", "B": "inside", "I": "inside"}
    for n in (1, 2, 3, 4):
        biases = ner.calibration(json.dumps({"operating_points": {"default": {"biases": {k: float(v) for k, v in zip(sorted(set(ner.BIASES.values())), rng.normal(size=6) * 2, strict=True)}}}}))

        def bias(a, b, biases=biases):
            to = {"O": "stay" if a == "O" else "to_background", "B": "to_start", "S": "to_start", "I": "to_continue", "E": "to_end"}[b]
            return biases[f"transition_bias_{kinds[a]}_{to}"]

        def score(path, x):
            total, before = 0.0, "O"
            for i, t in enumerate(path):
                tag = tags[t]
                if (before[0], tag[0]) not in allowed or (tag[0] in "IE" and before[2:] != tag[2:]):
                    return -np.inf
                total, before = total + bias(before[0], tag[0]) + x[i, t], tag
            return total if before[0] in "OES" else -np.inf

        x = rng.normal(size=(3, n, len(tags)))
        want = [max(itertools.product(range(len(tags)), repeat=n), key=lambda p, s=s: score(p, s)) for s in x]
        assert ner.best_paths(list(x), tags, biases) == [list(w) for w in want]
    assert ner.calibration('[{"transition_bias_end_to_start": 1}]')["transition_bias_background_stay"] == 0.0
    for bad in ('{"transition_bias_end_to_start": true}', '{"transition_bias_end_to_start": "1"}', '{"a": [1, {}]}'):
        with pytest.raises(ValueError):
            ner.calibration(bad)
