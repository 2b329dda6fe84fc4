"""Restoring tokens in text that arrives in deltas.

A buffer per stream (and block) holds back what may be the start of a token.
The same class serves the streaming processor, where its text is the keyed
state, and the batch form, which replays a stream's rows in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.tokens import CLOSE, HASH_CHARS, MAX_TOKEN, OPEN

WINDOW = 2 * MAX_TOKEN
_TOKEN = re.compile(rf"\{{\{{OPF:([A-Za-z][A-Za-z0-9_]*):([A-Za-z0-9]{{{HASH_CHARS}}})(?:\}}\}})?(?![A-Za-z0-9_])", re.I)
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_DIGITS = frozenset("0123456789")

Restore = Callable[[str], str]


def unfinished(tail: str) -> bool:
    """True if the tail is the beginning of a token, but not a whole one."""
    low = tail.lower()
    if len(low) <= len(OPEN):
        return OPEN.lower().startswith(low)
    if not low.startswith(OPEN.lower()):
        return False
    label, colon, digest = low[len(OPEN) :].partition(":")
    if label[:1] not in _LETTERS or not set(label) <= _LETTERS | _DIGITS | {"_"}:
        return False
    body = digest[:HASH_CHARS]
    if not set(body) <= _LETTERS | _DIGITS:
        return False
    return not colon or len(digest) < HASH_CHARS or digest[HASH_CHARS:] in ("", CLOSE[:1])


class DeltaBuffer:
    """Text of a stream that waits for what follows it: a tail, no longer than the window, from a brace that may open a token."""

    def __init__(self, held: str = "", window: int = WINDOW) -> None:
        if window < MAX_TOKEN:
            raise ValueError("a window shorter than a token would release its start")
        self.held, self.window = held, window

    def take(self, chunk: str, last: bool = False) -> str:
        """What can go out after a chunk: all, if it is the last one."""
        whole = self.held + chunk
        cut = len(whole)
        if not last:
            at = whole.find(OPEN[0], max(0, cut - self.window))
            while at >= 0 and not unfinished(whole[at:]):
                at = whole.find(OPEN[0], at + 1)
            cut = at if at >= 0 else cut
        self.held = whole[cut:]
        return whole[:cut]


def by_table(entries: dict[str, str]) -> Restore:
    """Restores strict and lenient tokens from a table of tokens."""

    def one(m: re.Match) -> str:
        return entries.get(f"{OPEN}{m[1].upper()}:{m[2].lower()}}}}}", m[0])

    return lambda text: _TOKEN.sub(one, text)


# Server-sent events ------------------------------------------------------------


def parse_block(block: str) -> dict | None:
    """Event and data of a block of lines; none if it has neither. Lines that start with a colon are comments."""
    event, data = None, []
    for line in re.split(r"\r?\n", block):
        if line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
    return None if event is None and not data else {"event": event, "data": "\n".join(data)}


class SseParser:
    """Blocks of events from chunks that may end anywhere."""

    _END = re.compile(r"\r\n\r\n|\n\n")

    def __init__(self, held: str = "") -> None:
        self.held = held

    def push(self, chunk: str) -> list[dict]:
        self.held += chunk
        out = []
        while end := self._END.search(self.held):
            block, self.held = self.held[: end.start()], re.sub(r"^(?:\r?\n)+", "", self.held[end.end() :])
            if event := parse_block(block):
                out.append(event)
        return out

    def flush(self) -> list[dict]:
        block, self.held = self.held, ""
        event = parse_block(block) if block else None
        return [event] if event else []


def write_event(event: str | None, data: str) -> str:
    lines = [f"event: {event}"] if event else []
    if data:
        lines += [f"data: {x}" for x in data.split("\n")]
    return "\n".join([*lines, "", ""])


def restore_json(raw: str, restore: Restore) -> str:
    """Restores the string leaves of a JSON text, or the text itself if it is none."""

    def walk(x):
        if isinstance(x, str):
            return restore(x)
        if isinstance(x, list):
            return [walk(v) for v in x]
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else x

    try:
        return json.dumps(walk(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return restore(raw)


class EventRestorer:
    """Restores the events of one model stream.

    Text deltas go through a buffer for each block; tool arguments are gathered
    until their block ends, as a JSON text can be restored only as a whole.
    Signed thinking is kept as it came, in ``signed``, and shown restored.
    """

    def __init__(self, provider: str, restore: Restore) -> None:
        if provider not in ("anthropic", "openai", "responses"):
            raise ValueError(f"unknown provider: {provider}")
        self.provider, self.restore = provider, restore
        self.text: dict[str, DeltaBuffer] = {}
        self.args: dict[str, str] = {}
        self.thinking: dict[str, str] = {}
        self.signatures: dict[str, str] = {}
        self.signed: dict[str, str] = {}

    def held(self) -> str:
        """What waits, as a JSON text, for a restorer of a later batch."""
        text = {key: buffer.held for key, buffer in self.text.items()}
        return json.dumps([text, self.args, self.thinking, self.signatures])

    def resume(self, held: str) -> None:
        text, self.args, self.thinking, self.signatures = json.loads(held)
        self.text = {key: DeltaBuffer(waiting) for key, waiting in text.items()}

    def _piece(self, key: str, chunk: str) -> str:
        return self.restore(self.text.setdefault(key, DeltaBuffer()).take(chunk))

    def _rest(self, key: str) -> str:
        buffer = self.text.pop(key, None)
        return self.restore(buffer.take("", last=True)) if buffer else ""

    def push(self, event: str | None, data: str) -> list[tuple[str | None, str]]:
        try:
            body = json.loads(data)
        except ValueError:
            return [*(self.finish() if data.strip() == "[DONE]" else []), (event, data)]
        if not isinstance(body, dict):
            return [(event, data)]
        return getattr(self, f"_{self.provider}")(event, body)

    def _out(self, event: str | None, body: dict) -> tuple[str | None, str]:
        return event, json.dumps(body, ensure_ascii=False, separators=(",", ":"))

    def _anthropic(self, event: str | None, body: dict) -> list[tuple[str | None, str]]:
        key, delta = str(body.get("index", 0)), body.get("delta") or {}
        kind = delta.get("type")
        if body.get("type") == "content_block_delta":
            if kind == "text_delta":
                piece = self._piece(f"text/{key}", delta.get("text", ""))
                return [self._out(event, {**body, "delta": {**delta, "text": piece}})] if piece else []
            if kind == "input_json_delta":
                self.args[key] = self.args.get(key, "") + delta.get("partial_json", "")
                return []
            if kind == "thinking_delta":
                self.thinking[key] = self.thinking.get(key, "") + delta.get("thinking", "")
                piece = self._piece(f"thinking/{key}", delta.get("thinking", ""))
                return [self._out(event, {**body, "delta": {**delta, "thinking": piece}})] if piece else []
            if kind == "signature_delta":
                self.signatures[key] = self.signatures.get(key, "") + delta.get("signature", "")
        if body.get("type") == "content_block_stop":
            if key in self.thinking and self.signatures.get(key):
                self.signed[self.signatures[key]] = self.thinking[key]
            self.thinking.pop(key, None)
            return [*self._ends(key), self._out(event, body)]
        if body.get("type") == "message_stop":
            return [*self.finish(), self._out(event, body)]
        return [self._out(event, body)]

    def _ends(self, key: str) -> list[tuple[str | None, str]]:
        """What is held back of an Anthropic block, as deltas."""
        out, name = [], "content_block_delta"
        put = lambda delta: out.append(self._out(name, {"type": name, "index": int(key), "delta": delta}))
        if rest := self._rest(f"thinking/{key}"):
            put({"type": "thinking_delta", "thinking": rest})
        if rest := self._rest(f"text/{key}"):
            put({"type": "text_delta", "text": rest})
        if raw := self.args.pop(key, ""):
            put({"type": "input_json_delta", "partial_json": restore_json(raw, self.restore)})
        return out

    def _openai(self, event: str | None, body: dict) -> list[tuple[str | None, str]]:
        before: list[tuple[str | None, str]] = []
        for choice in body.get("choices") or []:
            delta, key = choice.get("delta") or {}, str(choice.get("index", 0))
            if isinstance(delta.get("content"), str):
                delta["content"] = self._piece(key, delta["content"])
            for call in delta.get("tool_calls") or []:
                function = call.get("function") or {}
                if isinstance(function.get("arguments"), str):
                    place = f"{key}/{call.get('index', 0)}"
                    self.args[place] = self.args.get(place, "") + function["arguments"]
                    function["arguments"] = ""
            if choice.get("finish_reason"):
                before += self._closing(key, body)
        return [*before, self._out(event, body)]

    def _closing(self, key: str, body: dict) -> list[tuple[str | None, str]]:
        frame = {k: v for k, v in body.items() if k not in ("choices", "usage")}
        out = []
        if rest := self._rest(key):
            out.append(self._out(None, {**frame, "choices": [{"index": int(key), "delta": {"content": rest}}]}))
        for place in [p for p in self.args if p.split("/")[0] == key]:
            call = {"index": int(place.split("/")[1]), "function": {"arguments": restore_json(self.args.pop(place), self.restore)}}
            out.append(self._out(None, {**frame, "choices": [{"index": int(key), "delta": {"tool_calls": [call]}}]}))
        return out

    def _responses(self, event: str | None, body: dict) -> list[tuple[str | None, str]]:
        kind, key = body.get("type", ""), str(body.get("output_index", 0))
        if kind == "response.output_text.delta":
            piece = self._piece(key, body.get("delta", ""))
            return [self._out(event, {**body, "delta": piece})] if piece else []
        if kind == "response.function_call_arguments.delta":
            self.args[key] = self.args.get(key, "") + body.get("delta", "")
            return []
        before = []
        if kind == "response.output_text.done" and (rest := self._rest(key)):
            before.append(self._out("response.output_text.delta", {"type": "response.output_text.delta", "output_index": int(key), "delta": rest}))
        if kind == "response.function_call_arguments.done":
            raw = self.args.pop(key, "") or body.get("arguments", "")
            before.append(self._out("response.function_call_arguments.delta", {"type": "response.function_call_arguments.delta", "output_index": int(key), "delta": restore_json(raw, self.restore)}))
            if "arguments" in body:
                body = {**body, "arguments": restore_json(body["arguments"], self.restore)}
        elif kind.endswith((".done", ".completed")):
            body = json.loads(restore_json(json.dumps(body, ensure_ascii=False), self.restore))
        return [*before, self._out(event, body)]

    def finish(self) -> list[tuple[str | None, str]]:
        """What is still held back when a stream ends; nothing of it is dropped."""
        out: list[tuple[str | None, str]] = []
        if self.provider == "anthropic":
            for key in dict.fromkeys([*(k.split("/")[1] for k in self.text), *self.args]):
                out += self._ends(key)
        elif self.provider == "openai":
            for key in dict.fromkeys([*self.text, *(p.split("/")[0] for p in self.args)]):
                out += self._closing(key, {"object": "chat.completion.chunk"})
        else:
            for key in list(self.text):
                if rest := self._rest(key):
                    out.append(self._out("response.output_text.delta", {"type": "response.output_text.delta", "output_index": int(key), "delta": rest}))
            for key in list(self.args):
                raw = restore_json(self.args.pop(key), self.restore)
                out.append(self._out("response.function_call_arguments.delta", {"type": "response.function_call_arguments.delta", "output_index": int(key), "delta": raw}))
        return out


# Spark forms ----------------------------------------------------------------------

RELEASED = "stream_id string, seq long, text string"


def _released(rows: pd.DataFrame, buffer: DeltaBuffer) -> Iterator[tuple[int, str]]:
    for r in rows.sort_values("seq").itertuples():
        out = buffer.take(r.chunk or "", bool(r.is_last))
        if out:
            yield r.seq, out


def rejoin(deltas: DataFrame) -> DataFrame:
    """Batch form: deltas (stream_id, seq, chunk, is_last) as pieces that no token crosses."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(rows["stream_id"].iloc[0], seq, text) for seq, text in _released(rows.sort_values("seq"), DeltaBuffer())]
        return pd.DataFrame(found, columns=["stream_id", "seq", "text"])

    return deltas.select("stream_id", "seq", "chunk", "is_last").groupBy("stream_id").applyInPandas(run, RELEASED)


class RejoinProcessor(StatefulProcessor):
    """Streaming form: the held-back tail of each stream is its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "held string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer = DeltaBuffer(self.state.get()[0] if self.state.exists() else "")
        found = [(key[0], seq, text) for seq, text in _released(pd.concat(list(rows)), buffer)]
        if buffer.held:
            self.state.update((buffer.held,))
        else:
            self.state.clear()
        yield pd.DataFrame(found, columns=["stream_id", "seq", "text"])

    def close(self) -> None:
        return None


def rejoin_stream(deltas: DataFrame) -> DataFrame:
    """Streaming ``rejoin``; needs the RocksDB state store. Rows of a stream must come in order of seq over batches."""
    return (
        deltas.select("stream_id", "seq", "chunk", "is_last")
        .groupBy("stream_id")
        .transformWithStateInPandas(RejoinProcessor(), outputStructType=RELEASED, outputMode="Append", timeMode="None")
    )


PIECES = "stream_id string, n long, seq long, text string, missing long"


class ReorderProcessor(StatefulProcessor):
    """Deltas that arrive in any order: they wait for those before them, or until the watermark has passed one that came after a gap.

    State: the deltas that wait, the next one's number, the held-back tail, the
    number of pieces so far. A gap is closed when a waiting delta's time is
    behind the watermark: what is missing before it would be dropped as late.
    What is held back goes out before a gap, so no token is joined across it.
    """

    def __init__(self, first: int = 0) -> None:
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string, is_last boolean, at long")
        self.state = handle.getValueState("state", "next long, held string, n long, ended boolean")

    def _state(self) -> tuple[int, str, int, bool]:
        if not self.state.exists():
            return self.first, "", 0, False
        due, held, n, ended = self.state.get()
        return int(due), held, int(n), bool(ended)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, _, _, ended = self._state()
        last_at = None
        for r in pd.concat(list(rows)).itertuples():
            seq, at = int(r.seq), int(r.at_ms)
            if not ended and seq >= due and not self.waiting.containsKey((seq,)):
                self.waiting.updateValue((seq,), (r.chunk or "", bool(r.is_last), at))
            last_at = at if last_at is None else max(last_at, at)
        yield self._released(key, None, last_at, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._state()[3]:
            self.waiting.clear()
            self.state.clear()
            return
        passed = expiredTimerInfo.getExpiryTimeInMs()
        behind = [int(k[0]) for k, v in self.waiting.iterator() if int(v[2]) <= passed]
        yield self._released(key, max(behind, default=None), passed, timerValues)

    def _released(self, key, closed: int | None, at: int, timerValues) -> pd.DataFrame:
        """The pieces that can go out, with gaps before ``closed`` left open no longer."""
        due, held, n, ended = self._state()
        buffer, out, missing = DeltaBuffer(held), [], 0
        order = sorted(int(k[0]) for k, _ in self.waiting.iterator()) if closed is not None else []

        def put(seq: int, text: str) -> None:
            nonlocal n, missing
            if text or missing:
                out.append((key[0], n, seq, text, missing))
                n, missing = n + 1, 0

        while not ended:
            if not self.waiting.containsKey((due,)):
                after = next((s for s in order if s > due), None)
                if after is None or after > closed:
                    break
                put(due - 1, buffer.take("", last=True))
                due, missing = after, after - due
            chunk, ended, _ = self.waiting.getValue((due,))
            self.waiting.removeKey((due,))
            put(due, buffer.take(chunk, bool(ended)))
            due += 1
        self.state.update((due, buffer.held, n, bool(ended)))
        self._wake(bool(ended), at, timerValues)
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    def _wake(self, ended: bool, at: int, timerValues) -> None:
        """One timer: at the time of the first waiting delta, or, of a stream that ended, when no more deltas of it can come."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [at] if ended else [int(v[2]) for _, v in self.waiting.iterator()]
        if times:
            self.handle.registerTimer(max(min(times), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        return None


def reordered_stream(deltas: DataFrame, lateness: str = "1 minute", first: int = 0) -> DataFrame:
    """Pieces that no token crosses, from deltas (stream_id, seq, chunk, is_last, at) in any order over batches.

    Numbers run from ``first`` without gaps. A repeated number is dropped, the
    first one stays. A delta that is later than ``lateness`` is dropped, by the
    watermark or because its place was given up; the piece after it has in
    ``missing`` how many were. ``n`` numbers a stream's pieces. Null chunks are
    empty, rows without a number or stream are left out. Needs the RocksDB
    state store.
    """
    rows = deltas.withWatermark("at", lateness).filter(F.col("stream_id").isNotNull() & F.col("seq").isNotNull())
    rows = rows.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", F.coalesce("is_last", F.lit(False)).alias("is_last"), "at", F.coalesce(F.unix_millis("at"), F.lit(0)).alias("at_ms"))
    return rows.groupBy("stream_id").transformWithStateInPandas(ReorderProcessor(first), outputStructType=PIECES, outputMode="Append", timeMode="EventTime")


def parse_sse(chunks: DataFrame) -> DataFrame:
    """Events (stream_id, n, event, data) of the chunks (stream_id, seq, chunk) of whole streams."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parser = SseParser()
        found = [e for c in rows.sort_values("seq")["chunk"] for e in parser.push(c or "")] + parser.flush()
        return pd.DataFrame([(rows["stream_id"].iloc[0], i, e["event"], e["data"]) for i, e in enumerate(found)], columns=["stream_id", "n", "event", "data"])

    return chunks.select("stream_id", "seq", "chunk").groupBy("stream_id").applyInPandas(run, "stream_id string, n long, event string, data string")


def restore_events(events: DataFrame, vault: DataFrame, provider: str) -> DataFrame:
    """Restored events of whole model streams (stream_id, session_id, n, event, data).

    A session's vault, which its cap bounds, travels with each of its streams.
    """
    tables = vault.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "text"))).alias("entries"))
    rows = events.groupBy("stream_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("n", "event", "data"))).alias("events"))
    rows = rows.join(tables, "session_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                restorer = EventRestorer(provider, by_table(dict(r.entries or {})))
                found = [x for e in r.events for x in restorer.push(e["event"], e["data"])] + restorer.finish()
                out += [(r.stream_id, r.session_id, i, event, data) for i, (event, data) in enumerate(found)]
            yield pd.DataFrame(out, columns=["stream_id", "session_id", "n", "event", "data"])

    return rows.mapInPandas(run, "stream_id string, session_id string, n long, event string, data string")


EVENTS = "stream_id string, session_id string, n long, event string, data string"


class EventProcessor(StatefulProcessor):
    """Restores a model stream's events as they come: what is held back of it, and how many events went out, are its state."""

    def __init__(self, provider: str) -> None:
        self.provider = provider

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "held string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("n")
        held, n = self.state.get() if self.state.exists() else (None, 0)
        entries: dict[str, str] = {}
        for own in batch["entries"]:
            entries |= dict(own) if own is not None else {}
        restorer = EventRestorer(self.provider, by_table(entries))
        if held:
            restorer.resume(held)
        found = []
        for r in batch.itertuples():
            found += [(r.session_id, *x) for x in restorer.push(r.event, r.data)]
            if r.is_last:
                found += [(r.session_id, *x) for x in restorer.finish()]
        if bool(batch["is_last"].iloc[-1]):
            self.state.clear()
        else:
            self.state.update((restorer.held(), int(n) + len(found)))
        out = [(key[0], session, int(n) + i, event, data) for i, (session, event, data) in enumerate(found)]
        yield pd.DataFrame(out, columns=["stream_id", "session_id", "n", "event", "data"])

    def close(self) -> None:
        return None


def restore_event_stream(events: DataFrame, vault: DataFrame, provider: str) -> DataFrame:
    """Streaming ``restore_events``: events (stream_id, session_id, n, event, data, is_last), in order of n over batches; needs the RocksDB state store.

    The vault is a table that each batch joins as it then is; a session's
    entries, which its cap bounds, travel with its events. A stream's state ends
    with its last event.
    """
    tables = vault.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "text"))).alias("entries"))
    rows = events.select("stream_id", "session_id", "n", "event", "data", "is_last").join(tables, "session_id", "left")
    return rows.groupBy("stream_id").transformWithStateInPandas(EventProcessor(provider), outputStructType=EVENTS, outputMode="Append", timeMode="None")


class SseProcessor(StatefulProcessor):
    """Events of chunks that may end anywhere: the chunk's rest and the number of events are the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "rest string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        rest, n = self.state.get() if self.state.exists() else ("", 0)
        parser, found, last = SseParser(rest), [], False
        for r in batch.itertuples():
            found += parser.push(r.chunk or "")
            last = bool(r.is_last)
        if last:
            found += parser.flush()
            self.state.clear()
        else:
            self.state.update((parser.held, int(n) + len(found)))
        yield pd.DataFrame([(key[0], int(n) + i, e["event"], e["data"]) for i, e in enumerate(found)], columns=["stream_id", "n", "event", "data"])

    def close(self) -> None:
        return None


def parse_sse_stream(chunks: DataFrame) -> DataFrame:
    """Streaming ``parse_sse``: chunks (stream_id, seq, chunk, is_last), in order of seq over batches."""
    rows = chunks.select("stream_id", "seq", "chunk", "is_last")
    return rows.groupBy("stream_id").transformWithStateInPandas(
        SseProcessor(), outputStructType="stream_id string, n long, event string, data string", outputMode="Append", timeMode="None"
    )


class ThinkingCache(StatefulProcessor):
    """Signed thinking texts of a session, the least recently used of which go beyond ``entries`` texts or ``size`` bytes.

    A row with a text writes it, one without reads it. A text over the size is
    not kept; a read refreshes what it finds.
    """

    def __init__(self, entries: int = 256, size: int = 4 << 20) -> None:
        self.entries, self.size = entries, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "signature string", "thinking string, bytes long, used long")
        self.clock = handle.getValueState("clock", "now long, bytes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, total = self.clock.get() if self.clock.exists() else (0, 0)
        now, total, out = int(now), int(total), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now += 1
            old = self.texts.getValue((r.signature,)) if self.texts.containsKey((r.signature,)) else None
            if r.thinking is None:
                if old is not None:
                    self.texts.updateValue((r.signature,), (old[0], old[1], now))
                out.append((key[0], int(r.seq), r.signature, old[0] if old is not None else None))
                continue
            n = len(r.thinking.encode())
            if n > self.size:
                continue
            total += n - (int(old[1]) if old is not None else 0)
            self.texts.updateValue((r.signature,), (r.thinking, n, now))
            by_age = sorted((int(v[2]), int(v[1]), k[0]) for k, v in self.texts.iterator())
            while len(by_age) > self.entries or total > self.size:
                _, gone, signature = by_age.pop(0)
                self.texts.removeKey((signature,))
                total -= gone
        self.clock.update((now, total))
        yield pd.DataFrame(out, columns=["session_id", "seq", "signature", "thinking"])

    def close(self) -> None:
        return None


def thinking_stream(blocks: DataFrame, entries: int = 256, size: int = 4 << 20) -> DataFrame:
    """Answers to the reads among rows (session_id, seq, signature, thinking), null where a text is not, or no longer, known."""
    return blocks.select("session_id", "seq", "signature", "thinking").groupBy("session_id").transformWithStateInPandas(
        ThinkingCache(entries, size), outputStructType="session_id string, seq long, signature string, thinking string", outputMode="Append", timeMode="None"
    )


class IdleSessions(StatefulProcessor):
    """Sessions with their last access; a session idle for ``ttl_ms`` is given out as expired and forgotten."""

    def __init__(self, ttl_ms: int = 3_600_000) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "uses long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        uses = (self.state.get()[0] if self.state.exists() else 0) + sum(len(r) for r in rows)
        self.state.update((uses,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "uses": [uses], "status": ["live"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        uses = self.state.get()[0] if self.state.exists() else 0
        self.state.clear()
        yield pd.DataFrame({"session_id": [key[0]], "uses": [uses], "status": ["expired"]})

    def close(self) -> None:
        return None


def idle_sessions(accesses: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Streaming table of sessions (from rows with session_id), live after an access and expired after the time to live."""
    return accesses.groupBy("session_id").transformWithStateInPandas(
        IdleSessions(ttl_ms), outputStructType="session_id string, uses long, status string", outputMode="Update", timeMode="ProcessingTime"
    )
