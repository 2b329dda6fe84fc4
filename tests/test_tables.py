import itertools
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from umbraline import api
from umbraline.functions import spans as S
from umbraline.operators import audit, detect, evals, images, messages, ner
from umbraline.operators import mask as M
from umbraline.sources import config, files
from umbraline.streaming import deltas as D

OPT = M.MaskOptions("k")


def bodies(spark, *items):
    return spark.createDataFrame([(i, "s", json.dumps(b, ensure_ascii=False)) for i, b in enumerate(items)], "id int, session_id string, body string")


@pytest.mark.parametrize(
    ("provider", "body", "texts"),
    [
        ("anthropic", {"system": "be a@b.co", "messages": [{"role": "user", "content": "x a@b.co"}, {"role": "user", "content": [{"type": "text", "text": "y a@b.co"}, {"type": "image", "source": "a@b.co"}, {"type": "tool_result", "content": "z a@b.co"}]}]}, 4),
        ("openai", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "a@b.co"}]}]}, 1),
        ("responses", {"instructions": "i a@b.co", "input": [{"content": [{"type": "input_text", "text": "a@b.co"}]}, {"arguments": "{\"q\": \"a@b.co\"}"}]}, 3),
    ],
)
def test_requests(spark, provider, body, texts):
    df = bodies(spark, body)
    got = messages.mask_bodies(df, provider, OPT, "id").first().masked
    assert got.count("{{OPF:EMAIL:") == texts and got.count("placeholders matching") == 1
    again = bodies(spark, json.loads(got))
    assert messages.mask_bodies(again, provider, OPT, "id").first().masked == got
    vault = M.build_vault(messages.mask_tokens(df, provider, OPT, "id", "session_id"), "session_id", "order")
    assert vault.count() == 1


def test_responses_restored(spark):
    masked = M.mask(spark.createDataFrame([(1, "s", "a@b.co")], "id int, session_id string, text string"), OPT)
    vault, token = M.build_vault(masked, "session_id", "id"), masked.first().masked
    cases = {
        "anthropic": {"content": [{"type": "text", "text": f"hi {token}"}, {"type": "tool_use", "input": {"a": [token, 1]}}, {"type": "thinking", "thinking": token}]},
        "openai": {"choices": [{"message": {"content": token, "tool_calls": [{"function": {"arguments": messages.dump({"x": token})}}, {"function": {"arguments": f"raw {token}"}}]}}]},
        "responses": {"output": [{"content": [{"type": "output_text", "text": token}]}, {"arguments": messages.dump([token])}], "output_text": token},
        "tree": {"path": token, "deep": [{"x": token}]},
    }
    for provider, body in cases.items():
        got = messages.restore_bodies(bodies(spark, body), provider, vault, "k", "id").first().restored
        assert "OPF" not in got and got == messages.dump(json.loads(json.dumps(body).replace(token, "a@b.co")))


def test_tree_skips_plumbing(spark):
    body = {"file_path": "/home/a@b.co/x", "note": "mail to a@b.co", "short": "a@b.co", "user_id": "a@b.co a@b.co", "list": ["write to a@b.co"]}
    got = json.loads(messages.mask_bodies(bodies(spark, body), "tree", OPT, "id").first().masked)
    assert [k for k, v in got.items() if "OPF" in str(v)] == ["note", "list"]
    got = json.loads(messages.mask_bodies(bodies(spark, body), "tree_strict", OPT, "id").first().masked)
    assert sum("OPF" in str(v) for v in got.values()) == 5


def test_routes_and_headers(spark):
    paths = {
        "/health": ("health", None), "/anthropic/v1/messages": ("provider", "anthropic_messages"), "/anthropic/v1/other": ("provider", "anthropic_messages"),
        "/anthropic/api/x": ("provider", "passthrough"), "/openai/v1/chat/completions": ("provider", "openai_chat"), "/openai/v1/responses": ("provider", "responses"),
        "/openai/v1/models": ("provider", "passthrough"), "/codex/v1/responses": ("provider", "responses"), "/codexx": ("not_found", None), "/codex": ("provider", "passthrough"),
    }
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", messages.route(F.col("p")).alias("r")).collect()
    assert {r.p: (r.r.kind, r.r.transform) for r in got} == paths
    h = F.create_map(*[F.lit(x) for x in ("Host", "h", "Cookie", "c", "X", "x", "Content-Encoding", "gzip")])
    r = spark.range(1).select(messages.forwardable(h).alias("a"), messages.forwardable(h, True).alias("b"), messages.loggable(h).alias("c"), messages.session_of(F.lit("x" * 200)).alias("d"), messages.session_of(F.lit(" me ")).alias("e"), messages.display_tool(F.lit("My_Display"), suffixes=("_display",)).alias("f")).first()
    assert set(r.a) == {"Cookie", "X", "Content-Encoding"} and set(r.b) == {"Cookie", "X"} and r.c["Cookie"] == "<redacted>" and (r.d, r.e, r.f) == ("proxy:default", "proxy:me", True)


def test_thinking(spark):
    cache = spark.createDataFrame([("s1", "raw", 1), ("s2", "x" * 100, 2), ("s3", "mid", 3)], "signature string, thinking string, used_at int")
    blocks = spark.createDataFrame([("s1", "shown"), ("s9", "lost"), ("s8", "")], "signature string, thinking string")
    assert sorted((r.signature, r.thinking) for r in messages.replay_thinking(blocks, cache).collect()) == [("s1", "raw"), ("s8", "")]
    assert {r.signature for r in messages.thinking_cache(cache, 2, 50).collect()} == {"s3", "s1"}


def test_audit(spark, tmp_path):
    lines = [
        {"timestamp": "2025-01-02", "event": "mask", "provider": "p", "session_id": "a", "categories": {"card": 2}, "minted_count": 2, "text_length": 100, "masked_char_count": 10},
        {"timestamp": "2025-01-03", "event": "restore", "provider": "p", "session_id": "a", "restored_count": 3, "unknown_token_count": 1, "dead_token_count": 1, "path_skip_count": 0},
        {"timestamp": "2025-01-04", "event": "restore", "session_id": "b", "restored_count": 1, "unknown_token_count": 2, "path_skip_count": 1},
        {"timestamp": "2025-01-05", "event": "restore", "restored_count": 1}, {"timestamp": "2025-01-06", "event": "odd"}, {"event": "mask"},
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([*map(json.dumps, lines), "{broken", "", "[1]"]) + "\n")
    log = files.audit_log(spark, str(path)).cache()
    events = files.well_formed(log)
    assert files.malformed(spark, str(path)) == 2
    rows = {(r.provider, r.is_total): r for r in audit.report(events).collect()}
    assert set(rows) == {("p", False), ("(unset)", False), ("ALL", True)}
    assert rows["ALL", True].observed == 9 and rows["p", False].token_restore_rate == 0.75 and rows["(unset)", False].mask_density is None
    i = audit.integrity(events).first()
    assert (i.stale_restore_events, i.partition_mismatches, i.sessions_with_restores, i.last_timestamp) == (1, 1, 2, "2025-01-05")
    assert audit.window(events, "2025-01-03", "2025-01-04").count() == 2
    assert [tuple(r) for r in audit.category_totals(events).collect()] == [("card", 2)]
    assert "| ALL" in audit.markdown(audit.report(events), ["provider", "observed", "mask_density"])
    files.append_audit(events.withColumn("error", F.lit("bad a@b.co 010-1234-5678 900101-1234567 4242 4242 4242 4242")), str(tmp_path / "out"))
    assert set(spark.read.json(str(tmp_path / "out")).select("error").distinct().first()[0].split()) == {"bad", "[REDACTED_EMAIL]", "[REDACTED_PHONE]", "[REDACTED_RRN]", "[REDACTED_NUMBER]"}


def test_events_of_operators(spark):
    from umbraline.operators import restore as R

    df = spark.createDataFrame([(1, "s", "a@b.co a@b.co c@d.co"), (2, "s", "none")], "id int, session_id string, text string")
    masked = M.mask(df, OPT)
    events = audit.mask_events(masked, "session_id", F.lit("p"), F.lit("2025-01-01"))
    r = events.orderBy(F.desc("minted_count")).first()
    assert (r.minted_count, r.categories, r.text_length, r.masked_char_count) == (2, {"private_email": 3}, 20, 18)
    back = R.restore(masked.select("id", "session_id", "masked"), M.build_vault(masked, "session_id", "id"), "k", "id", "masked")
    done = audit.restore_events(back, "session_id", F.lit("p"), F.lit("2025-01-01"))
    assert [(r.restored_count, r.event) for r in done.collect()] == [(3, "restore")]
    assert audit.report(events.unionByName(done, allowMissingColumns=True)).filter("is_total").first().token_reference_rate == 1.5


def test_precision_recall(spark):
    rows = lambda *x: spark.createDataFrame(x, "id int, category string, text string")
    got = evals.precision_recall(rows((1, "card", "a"), (1, "card", "b"), (2, "rrn", "c")), rows((1, "card", "a"), (1, "card", "z")), ["id"])
    assert {r.category: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in got.collect()} == {"card": (1, 1, 1, 0.5, 0.5), "rrn": (0, 0, 1, None, 0.0)}


def test_latency_index(spark):
    got = audit.latency(spark.createDataFrame([("a", float(i)) for i in range(100)], "g string, v double"), "v", ["g"]).first()
    assert (got.n, got.p50, got.p95, got.p99, got.avg) == (100, 50.0, 95.0, 99.0, 49.5)


def test_latency_against_sorting(spark):
    r = random.Random(3)
    rows = [(g, r.choice([r.random() * 1000, 5.0, float(r.randrange(20))])) for g in ("a", "b", None) for _ in range(r.randrange(50, 900))] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for ranges in (2, 7, 512):
        got = {x.g: x for x in audit.latency(df, "v", ["g"], ranges).collect()}
        assert set(got) == {"a", "b", "c", None}
        for g, x in got.items():
            own = sorted(v for k, v in rows if k == g and v is not None)
            want = [own[min(int(len(own) * p), len(own) - 1)] for p in (0.5, 0.95, 0.99)]
            assert [x.n, x.p50, x.p95, x.p99] == [len(own), *want] and abs(x.avg - sum(own) / len(own)) < 1e-6


TOKEN = "{{OPF:EMAIL:4ov1qksihef66la1}}"


def test_every_split():
    text = f"a { '{' } {TOKEN} b {TOKEN}{TOKEN} {{{{OPF"
    fix = D.by_table({TOKEN: "x@y"})
    whole = fix(text)
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            buffer = D.DeltaBuffer()
            out = "".join(fix(buffer.take(c)) for c in (text[:i], text[i:j], text[j:])) + fix(buffer.take("", last=True))
            assert out == whole
    for n in (1, 2, 3):
        buffer = D.DeltaBuffer()
        assert "".join(fix(buffer.take(text[i : i + n])) for i in range(0, len(text), n)) + fix(buffer.take("", last=True)) == whole
    with pytest.raises(ValueError):
        D.DeltaBuffer(window=5)


def test_sse():
    raw = ": note\nevent: a\ndata: 1\ndata: 2\n\n\r\ndata: x\r\n\r\nevent: end\n\ndata: tail"
    want = [{"event": "a", "data": "1\n2"}, {"event": None, "data": "x"}, {"event": "end", "data": ""}, {"event": None, "data": "tail"}]
    for n in (1, 2, 5, 100):
        parser = D.SseParser()
        assert [e for i in range(0, len(raw), n) for e in parser.push(raw[i : i + n])] + parser.flush() == want
    assert D.write_event("a", "1\n2") == "event: a\ndata: 1\ndata: 2\n\n"


def stream(provider, events):
    r = D.EventRestorer(provider, D.by_table({TOKEN: 'x"y'}))
    return [json.loads(d) if d[:1] == "{" else d for e in events for _, d in r.push(None, e if isinstance(e, str) else json.dumps(e))] + [json.loads(d) for _, d in r.finish()], r


def test_anthropic_stream():
    delta = lambda **d: {"type": "content_block_delta", "index": 0, "delta": d}
    out, r = stream("anthropic", [
        delta(type="thinking_delta", thinking=TOKEN[:9]), delta(type="thinking_delta", thinking=TOKEN[9:]), delta(type="signature_delta", signature="S"), {"type": "content_block_stop", "index": 0},
        delta(type="text_delta", text=f"a {TOKEN[:5]}"), delta(type="text_delta", text=f"{TOKEN[5:]}"), delta(type="input_json_delta", partial_json='{"q": "' + TOKEN[:7]),
        delta(type="input_json_delta", partial_json=TOKEN[7:] + '"}'), {"type": "content_block_stop", "index": 0},
    ])
    assert r.signed == {"S": TOKEN}
    got = lambda k: "".join(e["delta"].get(k, "") for e in out if e["type"] == "content_block_delta")
    assert got("thinking") == 'x"y' and got("text") == 'a x"y' and json.loads(got("partial_json")) == {"q": 'x"y'}


def test_openai_stream():
    chunk = lambda d, end=None: {"choices": [{"index": 0, "delta": d, "finish_reason": end}]}
    out, _ = stream("openai", [chunk({"content": TOKEN[:4]}), chunk({"content": TOKEN[4:] + " and"}), chunk({"tool_calls": [{"index": 0, "function": {"arguments": json.dumps({"a": TOKEN})}}], "content": "!"}), chunk({}, "stop"), "[DONE]"])
    deltas = [c["delta"] for e in out if e != "[DONE]" for c in e["choices"]]
    assert "".join(d.get("content", "") for d in deltas) == 'x"y and!'
    assert json.loads("".join(c["function"]["arguments"] for d in deltas for c in d.get("tool_calls", []))) == {"a": 'x"y'} and out[-1] == "[DONE]"


def test_responses_stream():
    text = lambda t: {"type": "response.output_text.delta", "output_index": 0, "delta": t}
    out, _ = stream("responses", [text(TOKEN[:6]), text(TOKEN[6:]), {"type": "response.output_text.done", "output_index": 0, "text": TOKEN}, {"type": "response.function_call_arguments.delta", "output_index": 1, "delta": json.dumps({"a": TOKEN})}, {"type": "response.function_call_arguments.done", "output_index": 1, "arguments": json.dumps({"a": TOKEN})}, {"type": "response.completed", "response": {"x": TOKEN}}])
    assert "".join(e["delta"] for e in out if e["type"] == "response.output_text.delta") == 'x"y'
    assert TOKEN not in json.dumps(out)


def test_streaming_state_equals_batch(spark, tmp_path):
    text = f"one {TOKEN} two {TOKEN}"
    rows = [("s", i, text[i * 5 : i * 5 + 5], i * 5 + 5 >= len(text)) for i in range(-(-len(text) // 5))]
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        pd.DataFrame(part, columns=["stream_id", "seq", "chunk", "is_last"]).to_json(tmp_path / f"in{i}.json", orient="records", lines=True)
        os.utime(tmp_path / f"in{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    query = D.rejoin_stream(source).writeStream.format("memory").queryName("rejoined").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    join = lambda df: "".join(r.text for r in sorted(df.collect(), key=lambda r: r.seq))
    batch = D.rejoin(spark.createDataFrame(rows, schema))
    assert join(spark.table("rejoined")) == join(batch) == text
    assert all(r.text.count("{{") == r.text.count("}}") for r in batch.collect())


def test_event_tables(spark):
    chunks = spark.createDataFrame([("a", 0, "data: {\"choices\": [{\"index\": 0, \"delta\": {\"content\": \"" + TOKEN[:8]), ("a", 1, TOKEN[8:] + "\"}}]}\n\ndata: [DONE]\n\n")], "stream_id string, seq long, chunk string")
    events = D.parse_sse(chunks).withColumn("session_id", F.lit("s"))
    vault = spark.createDataFrame([("s", TOKEN, "x@y")], "session_id string, token string, text string")
    got = [r.data for r in sorted(D.restore_events(events, vault, "openai").collect(), key=lambda r: r.n)]
    assert len(got) >= 2 and "x@y" in "".join(got) and got[-1] == "[DONE]"


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"detection": {"categories": ["card"], "disabled_categories": ["rrn"]}, "masking": {"bypass": "${OFF:-no}"}}))
    got = config.load([str(tmp_path / "none.json"), str(file)], {"OFF": "yes"})
    assert got["detection"]["categories"] == ["card"] and got["masking"]["bypass"] == "yes" and got["restoration"]["lenient"]
    assert config.options(got, "k").policy == "passthrough"
    assert config.load([], {})["masking"]["bypass"] == ""
    file.write_text(json.dumps({"detection": {"disabled_categories": ["bogus"]}}))
    with pytest.raises(ValueError):
        config.load([str(file)], {})


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"id": "1", "lang": "en", "surface": "prose", "text": "mail a@b.co", "spans": [{"text": "a@b.co", "category": "private_email"}]}]}))
    assert files.corpus(spark, str(tmp_path / "c.json")).first().spans[0].text == "a@b.co"
    (tmp_path / "d.json").write_text(json.dumps({"entries": [{"id": "1", "lang": "en", "surface": "prose", "text": "mail", "spans": [{"text": "x", "category": "card"}]}]}))
    with pytest.raises(Exception, match="span is not in"):
        files.corpus(spark, str(tmp_path / "d.json")).collect()
    wire = json.dumps({"spans": [{"start": 0, "end": 2, "label": "B-private_email", "score": 0.5}, {"start": 3, "end": 3, "category": "card"}, {"start": 0, "end": 1, "category": "bogus"}, {"start": 4, "end": 6, "category": "card"}]})
    got = spark.range(1).select(files.spans_from_wire(F.lit(wire)).alias("s"), files.hook_input(F.lit('{"prompt": "p"}')).alias("h")).first()
    assert [(s.category, s.confidence) for s in got.s] == [("private_email", 0.5), ("card", 0.9)] and got.h.prompt == "p"


def test_api(spark):
    df = spark.createDataFrame([(1, "s", "mail a@b.co"), (2, "s", "again a@b.co")], "id int, session_id string, text string")
    masked, vault = api.sanitize(df, OPT, "session_id", "id")
    assert vault.count() == 1 and masked.selectExpr("sum(token_count)").first()[0] == 2
    back = api.desanitize(masked.select("id", "session_id", F.col("masked").alias("text")), vault, "k", "id", "session_id")
    assert sorted(r.restored for r in back.collect()) == ["again a@b.co", "mail a@b.co"]
    assert "text" not in api.analyze(df).first().spans[0].asDict()
    assert json.loads(api.detect_json(df, OPT).first().json)["tokens"][0]["category"] == "private_email"
    assert [r.leaked for r in audit.leaks(masked, lambda t: M.detections(t)).collect()] == [0, 0]


def test_tag_decoding():
    tags = ["O", "B-private_person", "I-private_person", "E-private_person", "S-private_person"]
    high = lambda *best: np.array([[5.0 if i == b else 0.0 for i in range(5)] for b in best])
    one = lambda scores: ner.best_paths([scores], tags)[0]
    assert one(high(0, 1, 3, 0)) == [0, 1, 3, 0]
    assert one(high(2, 0)) in ([0, 0], [4, 0], [1, 3])
    several = [high(0, 1, 3, 0), high(2, 0), np.zeros((0, 5)), high(4), high(1, 2, 2, 3, 0, 4)]
    assert ner.best_paths(several, tags) == [one(x) for x in several] and ner.best_paths([], tags) == []
    rng, moves = np.random.default_rng(1), ner.transitions(tags)
    for n in (1, 2, 4):
        x = rng.normal(size=(n, len(tags)))
        allowed = lambda p: all(moves[a, b] == 0 for a, b in zip((0, *p), (*p, 0)))
        best = max((p for p in itertools.product(range(len(tags)), repeat=n) if allowed(p)), key=lambda p: sum(x[i, t] for i, t in enumerate(p)))
        assert one(x) == list(best)
    text, offsets = "see Al Bo now", [(0, 3), (4, 6), (6, 9), (10, 13)]
    scores = high(0, 1, 3, 0)
    spans = ner.bioes_spans(text, offsets, one(scores), scores, tags)
    assert [(a, z, c) for a, z, c, _ in spans] == [(4, 9, "private_person")] and one(np.zeros((0, 5))) == []
    bio = ["O", "B-PS", "I-PS", "B-LC"]
    s = np.array([[0, 9, 0, 0], [0, 0, 9, 0], [9, 0, 0, 0], [0, 0, 0, 9.0], [0, 9, 0, 0]])
    assert [(a, z) for a, z, *_ in ner.bio_spans([(0, 1), (1, 3), (3, 4), (4, 6), (6, 7)], s, bio)] == [(0, 3)]
    assert ner.windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and ner.windows(3, 4, 1) == [(0, 3)]


def test_model_detector(spark):
    tags = ["O", "S-private_person"]

    def load():
        def model(texts):
            out = []
            for t in texts:
                offsets = [(i, i + 1) for i in range(len(t))]
                out.append((offsets, np.array([[0.0, 9.0] if c == "X" else [9.0, 0.0] for c in t]).reshape(len(t), 2)))
            return out

        return model

    find = ner.model_detector(load, tags, {"private_person": "private_person"}, size=5, overlap=2)
    df = spark.createDataFrame([("abXcdefXgh" * 2,), (None,), ("",)], "t string").select(find(F.col("t")).alias("s"))
    got = [r.s for r in df.collect()]
    assert [s.start for s in got[0]] == [2, 7, 12, 17] and got[1] is None and got[2] == []


def test_image_regions(spark):
    words = spark.createDataFrame([("i", 0, 0, "mail", 0, 0, 10, 5, 0.9), ("i", 0, 1, "a@b.co", 12, 1, 20, 6, 0.8), ("i", 1, 2, "end", 0, 10, 8, 5, 0.2)], images.WORD)
    page = images.page_text(words).first()
    assert page.text == "mail a@b.co\nend"
    offsets = {r.text: (r.start, r.end) for r in images.word_offsets(words).collect()}
    assert all(page.text[a:z] == w for w, (a, z) in offsets.items())
    spans = spark.createDataFrame([("i", 1, 5, 15, "private_email")], "image_id string, span_id int, start int, end int, category string")
    boxes = sorted((r.line_index, r.left, r.top, r.right, r.bottom) for r in images.regions(words, spans, 1).collect())
    assert boxes == [(0, 11, 0, 33, 8), (1, -1, 9, 9, 16)]
    assert images.decision(images.by_confidence(words, 0.5)[1], "block").first().decision == "block"


def test_unfinished_tails():
    whole = "{{OPF:EMAIL:4ov1qksihef66la1}}"
    for n in range(1, len(whole)):
        assert D.unfinished(whole[:n]), n
        assert D.unfinished(whole[:n].lower())
    for text in (whole, whole + "x", "{x", "{{OPF:1", "{{OPF:E MAIL", "{{OPF:EMAIL:abc}", "{{OPF:EMAIL:4ov1qksihef66la1x", "{{OPF:EMAIL:4ov1qksihef66la1}x"):
        assert not D.unfinished(text), text
    buffer = D.DeltaBuffer()
    assert buffer.take("a {{OPF:" + "L" * 100) == "a {{OPF:" + "L" * 100  # longer than any token


def test_layers_of_configuration():
    base = {"a": {"b": 1, "c": [1, 2]}, "d": {}, "e": "x"}
    assert config.overlay(base, {"a": {"b": 2}, "d": {"n": 1}}) == {"a": {"b": 2, "c": [1, 2]}, "d": {"n": 1}, "e": "x"}
    assert config.overlay(base, {"a": {"c": [3]}, "e": None}) == {"a": {"b": 1, "c": [3]}, "d": {}, "e": "x"}
    assert config.overlay(base, {"a": 5}) == {"a": 5, "d": {}, "e": "x"} and config.overlay(base, {}) == base
    environ = {"X": "1", "EMPTY": ""}
    cases = {"${X}": "1", "a${X}b${NO}c": "a1bc", "${NO:-d}": "d", "${EMPTY:-d}": "d", "${X:-d}": "1", "$X ${1a} ${X": "$X ${1a} ${X", "": ""}
    for raw, want in cases.items():
        assert config.expanded({"k": [raw]}, environ) == {"k": [want]}


def _stream(spark, tmp_path, rows, schema, name, make, batches=3):
    """Rows as a stream of files, one a batch, through ``make`` into a table in memory."""
    columns = [c.split()[0] for c in schema.split(", ")]
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        pd.DataFrame(part, columns=columns).to_json(tmp_path / f"in{i}.json", orient="records", lines=True)
        os.utime(tmp_path / f"in{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name)


def test_event_stream_equals_whole_streams(spark, tmp_path):
    delta = lambda t: json.dumps({"choices": [{"index": 0, "delta": {"content": t}}]})
    text = f"to {TOKEN} and {TOKEN}"
    data = [delta(text[i : i + 7]) for i in range(0, len(text), 7)] + [json.dumps({"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}), "[DONE]"]
    rows = [("a", "s", i, None, d, i == len(data) - 1) for i, d in enumerate(data)]
    schema = "stream_id string, session_id string, n long, event string, data string, is_last boolean"
    vault = spark.createDataFrame([("s", TOKEN, "x@y.org"), ("t", TOKEN, "wrong")], "session_id string, token string, text string")
    got = _stream(spark, tmp_path, rows, schema, "events_back", lambda df: D.restore_event_stream(df, vault, "openai"))
    whole = D.restore_events(spark.createDataFrame(rows, schema).drop("is_last"), vault, "openai")
    said = lambda df: "".join(json.loads(r.data)["choices"][0]["delta"].get("content", "") for r in sorted(df.collect(), key=lambda r: r.n) if r.data != "[DONE]")
    assert said(got) == said(whole) == "to x@y.org and x@y.org"
    assert [r.n for r in sorted(got.collect(), key=lambda r: r.n)] == list(range(got.count()))


def test_sse_stream_equals_whole_streams(spark, tmp_path):
    raw = ": note\nevent: a\ndata: 1\ndata: 2\n\n\r\ndata: x\r\n\r\nevent: end\n\ndata: tail"
    rows = [("s", i, raw[i * 3 : i * 3 + 3], i * 3 + 3 >= len(raw)) for i in range(-(-len(raw) // 3))]
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    got = _stream(spark, tmp_path, rows, schema, "sse_back", D.parse_sse_stream)
    whole = D.parse_sse(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and got.count() == 4


def test_thinking_cache_as_state(spark, tmp_path):
    w = lambda i, s, t: ("s", i, s, t)
    rows = [w(0, "a", "A"), w(1, "b", "B"), w(2, "a", None), w(3, "c", "C"), w(4, "b", None), w(5, "a", None), w(6, "big", "x" * 50), w(7, "big", None), w(8, "d", "D" * 9), w(9, "c", None), w(10, "d", None)]
    got = _stream(spark, tmp_path, rows, "session_id string, seq long, signature string, thinking string", "thinking_back", lambda df: D.thinking_stream(df, entries=2, size=10))
    assert {r.seq: r.thinking for r in got.collect()} == {2: "A", 4: None, 5: "A", 7: None, 9: None, 10: "D" * 9}


def test_stream_to_a_callback(spark, tmp_path):
    seen = []
    pd.DataFrame([{"a": 1}, {"a": 2}]).to_json(tmp_path / "in.json", orient="records", lines=True)
    source = spark.readStream.schema("a long").json(str(tmp_path / "in*.json"))
    files.stream_to(source, lambda df, n: seen.extend((n, r.a) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [(0, 1), (0, 2)]


def _spans_or_null(spark, strategy, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r.i: r.s if r.s is None else [x.text for x in r.s] for r in df.select("i", strategy.attempt(F.col("text")).alias("s")).collect()}


def test_failures_of_backends(spark):
    """A backend that fails for a text is left out; a critical one, or all of them, fail the text; policies decide what follows."""
    def backend(word):
        def run(ts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None or word in t else [{"start": 0, "end": 1, "category": "secret", "confidence": 0.9, "text": t[:1]}] for t in ts], dtype=object)

        return pandas_udf(run, f"array<{S.SPAN}>")

    local = detect.local(["private_email"])
    texts = ["q a@b.co", "bad a@b.co", "worse a@b.co", None]
    soft, hard = detect.Backend(backend("bad"), "soft"), detect.Backend(backend("worse"), "hard", critical=True)
    assert _spans_or_null(spark, detect.Strategy(local, remote=[soft]), texts) == {0: ["q", "a@b.co"], 1: ["a@b.co"], 2: ["w", "a@b.co"], 3: None}
    both = detect.Strategy(local, remote=[soft, hard])
    assert _spans_or_null(spark, both, texts) == {0: ["q", "a@b.co"], 1: ["b", "a@b.co"], 2: None, 3: None} and both.name == "local+soft+hard"
    # as expressions: an Arrow function cannot follow the local patterns in one column
    column = lambda word: lambda t: F.when(~t.contains(word), F.array(S.span(F.lit(0), F.substring(t, 1, 1), "secret", 0.9)))
    late, first = detect.Backend(column("worse"), "late", critical=True), column("bad")
    assert _spans_or_null(spark, detect.Strategy(local, remote=[late], kind="tiered"), texts) == {0: ["q", "a@b.co"], 1: ["b", "a@b.co"], 2: None, 3: None}
    assert _spans_or_null(spark, detect.Strategy(first, remote=[late], kind="tiered", local_failure="skip_remote"), texts)[1] == []
    assert _spans_or_null(spark, detect.Strategy(first, remote=[late], kind="tiered"), texts)[1] is None
    assert _spans_or_null(spark, detect.Strategy(backend("bad"), remote=[soft]), texts)[1] is None
    df = spark.createDataFrame([(2, texts[2])], "id int, text string")
    with pytest.raises(Exception, match="detection failed"):
        M.mask(df, M.MaskOptions("k", both)).collect()
    assert M.mask(df, M.MaskOptions("k", both, policy="hybrid")).first().masked.startswith("worse {{OPF:EMAIL:")
    assert M.mask(df, M.MaskOptions("k", both, policy="open")).first().masked == texts[2]
    # a model in an Arrow function after the local patterns, in texts that these have blanked out
    tiered = M.mask(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), M.MaskOptions("k", detect.Strategy(local, remote=[soft], kind="tiered")))
    assert [(r.masked or "").split("{{")[0] for r in tiered.orderBy("id").collect()] == ["", "bad ", "", ""]
    with pytest.raises(ValueError):
        detect.Strategy(local, local_failure="guess")


def test_remote_detector(spark):
    """Tries again while a service is unavailable; what it refuses, or never answers, has no spans at all."""

    def send(body):
        import json

        text = json.loads(body)["text"]
        turns = send.__dict__.setdefault("turns", {})
        turns[text] = turns.get(text, 0) + 1
        if text == "down" or (text.startswith("late") and turns[text] < 3):
            raise files.Unavailable("try later")
        if text == "refused":
            raise ValueError("no")
        return "no json" if text == "broken" else json.dumps({"detections": [{"start": 0, "end": 4, "label": "private_person", "score": 0.8}]})

    find = files.remote_detector(send, retries=2, wait=0)
    df = spark.createDataFrame([(t,) for t in ("late Ann", "down", "refused", "broken", "Anna x", None)], "text string").coalesce(1)
    got = {r.text: r.s if r.s is None else [tuple(x) for x in r.s] for r in df.select("text", find(F.col("text")).alias("s")).collect()}
    assert got["late Ann"] == [(0, 4, "private_person", 0.8, "late")] and got["Anna x"] == [(0, 4, "private_person", 0.8, "Anna")]
    assert [got[t] for t in ("down", "refused", "broken", None)] == [None] * 4


def test_message_parts(spark):
    mail = "a@b.co"
    parts = [
        {"type": "text", "text": mail}, {"type": "tool", "tool": "x", "state": {"input": {"path": mail, "n": 1}, "output": f"to {mail}"}}, {"type": "subtask", "prompt": mail, "description": mail, "agent": mail},
        {"type": "file", "source": {"text": {"value": mail}}, "url": mail}, {"type": "compaction", "text": f"{mail} {TOKEN}"}, {"type": "new kind", "id": mail, "deep": [{"x": mail}]},
    ]
    df = spark.createDataFrame([(1, json.dumps(p)) for p in parts] + [(1, None)], "id int, part string")
    got = {r.part: r.masked for r in messages.mask_parts(df, OPT).collect()}
    token = M.mask(spark.createDataFrame([(mail,)], "text string"), OPT).first().masked
    out = [json.loads(got[json.dumps(p)]) for p in parts]
    assert out[0]["text"] == token and out[1]["state"] == {"input": {"path": token, "n": 1}, "output": f"to {token}"}
    assert out[2] == {"type": "subtask", "prompt": token, "description": token, "agent": mail}
    assert out[3] == {"type": "file", "source": {"text": {"value": token}}, "url": mail}
    assert out[4]["text"] == "[REDACTED] [REDACTED]" and out[5] == {"type": "new kind", "id": mail, "deep": [{"x": token}]} and got[None] is None


def test_bodies_that_share_a_key(spark):
    body = lambda t: json.dumps({"messages": [{"role": "user", "content": t}]})
    rows = [(1, body("a@b.co")), (1, body("no mail")), (None, body("c@d.co")), (1, body("a@b.co"))]
    got = messages.mask_bodies(spark.createDataFrame(rows, "id int, body string"), "openai", OPT, "id").collect()
    assert len(got) == 4
    for r in got:
        said = json.loads(r.masked)["messages"][-1]["content"]
        assert (said == "no mail") == ("no mail" in r.body) and "@" not in said


def test_settings_of_the_environment():
    got = config.load([], {"UMBRALINE_US_SSN": "yes", "UMBRALINE_DISABLED_CATEGORIES": "card, rrn", "UMBRALINE_MIN_CONFIDENCE": "0.5", "UMBRALINE_POLICY": "Hybrid", "UMBRALINE_MODE": " "})
    assert got["detection"]["us_ssn"] is True and got["detection"]["disabled_categories"] == ["card", "rrn"] and got["detection"]["min_confidence"] == 0.5
    assert got["masking"]["policy"] == "hybrid" and got["masking"]["mode"] == "token"
    for name, bad in (("UMBRALINE_US_SSN", "maybe"), ("UMBRALINE_MIN_CONFIDENCE", "2"), ("UMBRALINE_POLICY", "guess"), ("UMBRALINE_DISABLED_CATEGORIES", "nothing")):
        with pytest.raises(ValueError, match="nothing" if "CATEGORIES" in name else name):
            config.load([], {name: bad})


def _png(grid, colour, filters):
    """A PNG image whose rows have the given filters, by the format's definition."""
    import struct
    import zlib

    height, width, step = grid.shape
    flat, lines = grid.reshape(height, -1).astype(int), []
    for y in range(height):
        kind, line = filters[y % len(filters)], []
        for x in range(width * step):
            a = flat[y, x - step] if x >= step else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            line.append((flat[y, x] - guess) % 256)
        lines.append(bytes([kind, *line]))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"note\0secret") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_black_boxes(spark, tmp_path):
    rng = np.random.default_rng(1)
    for colour, step in ((0, 1), (2, 3), (4, 2), (6, 4)):
        grid = rng.integers(0, 256, (9, 7, step)).astype(np.uint8)
        want = grid.copy()
        want[2:5, 1:4] = 0
        want[7:, 5:] = 0
        if step in (2, 4):
            want[2:5, 1:4, -1] = want[7:, 5:, -1] = 255
        got = images.blacken(_png(grid, colour, [0, 1, 2, 3, 4]), [(1, 2, 4, 5), (5, 7, 99, 99)])
        # read back by the same format: without filters, its rows are the pixels
        assert b"secret" not in got
        data = b"".join(d for k, d in images._chunks(got) if k == b"IDAT")
        back = images._pixels(__import__("zlib").decompress(data), 7, 9, step).reshape(9, 7, step)
        assert (back == want).all()
    (tmp_path / "a.png").write_bytes(_png(grid, 6, [4]))
    (tmp_path / "b.png").write_bytes(b"no image")
    found = files.images(spark, str(tmp_path / "*.png"))
    boxes = spark.createDataFrame([(r.image_id, 0, 0, 7, 9) for r in found.collect()], "image_id string, left int, top int, right int, bottom int")
    out = {r.image_id[-5]: r for r in images.redact_images(found, boxes).collect()}
    assert out["a"].error is None and out["b"].redacted is None and "PNG" in out["b"].error
    with pytest.raises(Exception, match="too large"):
        files.images(spark, str(tmp_path / "*.png"), most=5).collect()
