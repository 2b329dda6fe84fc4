"""Masking and restoring chat bodies.

A body's text leaves are taken out by an Arrow function, go through the same
table operators as any other text, and are put back. So detection, hashing and
vault joins are written once, whatever the shape of the body.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .mask import SYSTEM_NOTE, MaskOptions, mask
from .restore import RestoreOptions, restore

PROVIDERS = ("part", "anthropic", "openai", "responses", "tree", "tree_strict")
Path = list[str | int]
_JSON = "#json"  # path step into a JSON text

# Fields of tool arguments that are plumbing, and fields that even the strict walk leaves alone.
SKIP_FIELDS = (
    "file_path", "filepath", "path", "cwd", "workdir", "worktree", "uri", "url", "directory", "dir", "root", "pattern", "glob", "include",
    "exclude", "tool", "command", "action", "id", "session_id", "sessionid", "call_id", "callid", "request_id", "requestid",
)
STRICT_SKIP_FIELDS = ("type", "id", "callid", "tool", "sessionid", "messageid", "partid")
SKIP_SUFFIX = re.compile(r"_(?:path|dir|file|id|uri|url|name)$", re.I)
MIN_CHARS = 8
_IN_TYPES, _OUT_TYPES = ("input_text", "output_text", "text"), ("output_text", "text")


def _strings(value: Any, at: Path, skip: Callable[[str | None], bool], least: int, parent: str | None = None) -> Iterator[tuple[Path, str]]:
    """All string leaves of a tree whose field is not skipped and which are longer than ``least`` when trimmed."""
    if isinstance(value, str):
        if not skip(parent) and len(value.strip()) > least:
            yield at, value
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from _strings(x, [*at, i], skip, least, parent)
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from _strings(x, [*at, k], skip, least, k)


def _never(_: str | None) -> bool:
    return False


def _plumbing(field: str | None) -> bool:
    return field is not None and (field.lower() in SKIP_FIELDS or bool(SKIP_SUFFIX.search(field)))


def _strict(field: str | None) -> bool:
    return field is not None and field.lower() in STRICT_SKIP_FIELDS


def _text_parts(parts: Any, at: Path, types: tuple[str, ...] | None = ("text",)) -> Iterator[tuple[Path, str]]:
    if isinstance(parts, str):
        yield at, parts
    elif isinstance(parts, list):
        for i, p in enumerate(parts):
            if isinstance(p, dict) and isinstance(p.get("text"), str) and (types is None or p.get("type") in types):
                yield [*at, i, "text"], p["text"]


def _arguments(raw: Any, at: Path) -> Iterator[tuple[Path, str]]:
    """Leaves of tool arguments in a JSON text; the text itself if it is no JSON."""
    if not isinstance(raw, str) or not raw:
        return
    try:
        parsed = json.loads(raw)
    except ValueError:
        yield at, raw
        return
    yield from _strings(parsed, [*at, _JSON], _never, -1)


def _items(value: Any, *keys: str) -> Iterator[tuple[Path, dict]]:
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    for i, x in enumerate(value if isinstance(value, list) else []):
        if isinstance(x, dict):
            yield [*keys, i], x


def request_leaves(body: Any, provider: str, tool_results: bool = True) -> list[tuple[Path, str]]:
    """Texts of a request that go to the model. ``tool_results``: also those that tools gave or were given."""
    out: list[tuple[Path, str]] = []
    if provider == "tree":
        return list(_strings(body, [], _plumbing, MIN_CHARS))
    if provider == "tree_strict":
        return list(_strings(body, [], _strict, 0))
    if provider == "part":
        return list(_part_leaves(body))
    if provider == "responses":
        if isinstance(body.get("instructions"), str):
            out.append((["instructions"], body["instructions"]))
        if isinstance(body.get("input"), str):
            out.append((["input"], body["input"]))
        for at, item in _items(body, "input"):
            if isinstance(item.get("content"), (list, str)):
                out += _text_parts(item["content"], [*at, "content"], _IN_TYPES)
            elif tool_results:
                out += _arguments(item.get("arguments"), [*at, "arguments"])
                out += _text_parts(item.get("output"), [*at, "output"], None)
        return out
    for at, message in _items(body, "messages"):
        out += _text_parts(message.get("content"), [*at, "content"])
        if tool_results and provider == "anthropic":
            for inner, block in _items(message, "content"):
                if block.get("type") == "tool_result":
                    out += _text_parts(block.get("content"), [*at, *inner, "content"])
    if provider == "anthropic":
        out += _text_parts(body.get("system"), ["system"], None)
    return out


#: Fields of message parts that carry text, by the part's type (fixed values). Other types are walked as a whole.
PART_FIELDS = {
    "text": (("text",),), "reasoning": (("text",),), "compaction": (("text",), ("summary",)), "subtask": (("prompt",), ("description",)),
    "file": (("source", "text", "value"),), "agent": (("source", "value"),),
    "tool": (("state", "input"), ("state", "output"), ("state", "error"), ("state", "title"), ("state", "raw")),
}


def _part_leaves(part: Any) -> Iterator[tuple[Path, str]]:
    """Texts of a message part: the fields of its type, trees below them too; of an unknown type, all strings but its names."""
    kind = part.get("type") if isinstance(part, dict) else None
    if kind not in PART_FIELDS:
        yield from _strings(part, [], _strict, 0)
        return
    for path in PART_FIELDS[kind]:
        value = part
        for name in path:
            value = value.get(name) if isinstance(value, dict) else None
        yield from _strings(value, list(path), _never, -1)


def response_leaves(body: Any, provider: str, tool_results: bool = True) -> list[tuple[Path, str]]:
    """Texts of a response that may hold tokens."""
    out: list[tuple[Path, str]] = []
    if provider in ("tree", "tree_strict"):
        return list(_strings(body, [], _never, -1))
    if provider == "anthropic":
        out += _text_parts(body.get("content") if isinstance(body.get("content"), list) else None, ["content"])
        for at, block in _items(body, "content"):
            if block.get("type") == "tool_use":
                out += _strings(block.get("input"), [*at, "input"], _never, -1)
            elif block.get("type") == "thinking" and isinstance(block.get("thinking"), str):
                out.append(([*at, "thinking"], block["thinking"]))
    elif provider == "openai":
        for at, choice in _items(body, "choices"):
            message = choice.get("message")
            if isinstance(message, dict):
                out += _text_parts(message.get("content"), [*at, "message", "content"])
                for inner, call in _items(message, "tool_calls"):
                    if isinstance(call.get("function"), dict):
                        out += _arguments(call["function"].get("arguments"), [*at, "message", *inner, "function", "arguments"])
    else:
        for at, item in _items(body, "output"):
            out += _text_parts(item.get("content"), [*at, "content"], _OUT_TYPES)
            out += _arguments(item.get("arguments"), [*at, "arguments"])
        if isinstance(body.get("output_text"), str):
            out.append((["output_text"], body["output_text"]))
    return out


def put(body: Any, at: Path, text: str) -> Any:
    """The body with the leaf replaced; a JSON text on the way is parsed and written again."""
    if not at:
        return text
    step, rest = at[0], at[1:]
    if step == _JSON:
        return dump(put(json.loads(body), rest, text))
    body[step] = put(body[step], rest, text)
    return body


def dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def with_note(body: Any, provider: str) -> Any:
    """The request with the system note, once, after what the system already says."""
    if provider == "anthropic":
        system = body.get("system")
        if isinstance(system, list):
            if not any(isinstance(b, dict) and b.get("text") == SYSTEM_NOTE for b in system):
                body["system"] = [*system, {"type": "text", "text": SYSTEM_NOTE}]
        else:
            body["system"] = _joined(system)
    elif provider == "openai":
        messages = body.get("messages") or []
        last = max((i for i, m in enumerate(messages) if isinstance(m, dict) and m.get("role") == "system"), default=-1)
        if last >= 0 and isinstance(messages[last].get("content"), str):
            messages[last]["content"] = _joined(messages[last]["content"])
        else:
            messages.insert(last + 1, {"role": "system", "content": SYSTEM_NOTE})
        body["messages"] = messages
    elif provider == "responses":
        body["instructions"] = _joined(body.get("instructions"))
    return body


def _joined(text: Any) -> str:
    if not isinstance(text, str) or not text:
        return SYSTEM_NOTE
    return text if SYSTEM_NOTE in text else f"{text}\n\n{SYSTEM_NOTE}"


LEAF = "struct<path:string,text:string>"


def leaves(body: Column, provider: str, response: bool = False, tool_results: bool = True) -> Column:
    """Array of (path, text) of a JSON body's leaves."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider}")
    find = response_leaves if response else request_leaves

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else [{"path": json.dumps(p), "text": t} for p, t in find(json.loads(b), provider, tool_results)])

    return pandas_udf(run, f"array<{LEAF}>").asNondeterministic()(body)


def rebuilt(body: Column, new: Column, provider: str, response: bool = False, note: bool = True) -> Column:
    """The JSON body with new texts at their paths."""

    def run(bodies: pd.Series, texts: pd.Series) -> pd.Series:
        def one(b: str | None, leaves: Any) -> str | None:
            if b is None:
                return None
            tree = json.loads(b)
            for leaf in leaves if leaves is not None else []:
                tree = put(tree, json.loads(leaf["path"]), leaf["text"])
            return dump(with_note(tree, provider) if note and not response and isinstance(tree, dict) else tree)

        return pd.Series([one(b, t) for b, t in zip(bodies, texts, strict=True)], dtype=object)

    return pandas_udf(run, "string")(body, new)


def _through(df: DataFrame, key: str, body: str, provider: str, response: bool, tool_results: bool, change: Callable[[DataFrame], DataFrame], out: str, note: bool) -> DataFrame:
    """Takes leaves out, lets ``change`` add a column ``new`` to rows (key, leaf, path, text, and the row's other columns), and puts them back."""
    del key  # rows need none: a row's result depends on its columns alone, so equal rows share it
    rest = [c for c in df.columns if c not in (body, "path", "text", "leaf")]
    plain = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    ids = [F.xxhash64(F.lit(salt), *[x for c in plain for x in (F.col(c).isNull(), F.col(c))]).alias(f"__body{salt}") for salt in (1, 2)]
    cut = df.select(*ids, *rest, F.posexplode(leaves(F.col(body), provider, response, tool_results)).alias("leaf", "__l"))
    cut = cut.select("__body1", "__body2", *rest, "leaf", "__l.path", "__l.text").dropDuplicates(["__body1", "__body2", "leaf"])
    new = change(cut).groupBy(F.col("__body1").alias("__same1"), F.col("__body2").alias("__same2")).agg(F.array_sort(F.collect_list(F.struct("leaf", "path", F.col("new").alias("text")))).alias("__n"))
    rows = df.withColumns({f"__body{i}": c for i, c in enumerate(ids, 1)})
    rows = rows.join(new, [rows["__body1"] == new["__same1"], rows["__body2"] == new["__same2"]], "left").drop("__body1", "__body2", "__same1", "__same2")
    texts = F.transform("__n", lambda n: F.struct(n["path"].alias("path"), n["text"].alias("text")))
    return rows.withColumn(out, rebuilt(F.col(body), texts, provider, response, note)).drop("__n")


def mask_bodies(df: DataFrame, provider: str, options: MaskOptions, key: str, body: str = "body", out: str = "masked", tool_results: bool = True) -> DataFrame:
    """Adds the masked request. ``tool_results`` masks tool results and tool arguments too."""
    return _through(df, key, body, provider, False, tool_results, lambda cut: mask(cut, options, out="new"), out, True)


def mask_tokens(df: DataFrame, provider: str, options: MaskOptions, key: str, session: str, body: str = "body", tool_results: bool = True) -> DataFrame:
    """The tokens that ``mask_bodies`` mints, as rows for ``build_vault``: session, order and ``tokens``."""
    cut = df.select(F.col(key).alias("k"), F.col(session).alias("session_id"), F.posexplode(leaves(F.col(body), provider, False, tool_results)).alias("leaf", "__l"))
    done = mask(cut.select("k", "session_id", "leaf", "__l.text"), options)
    return done.select("session_id", F.struct("k", "leaf").alias("order"), "tokens")


def restore_bodies(df: DataFrame, provider: str, vault: DataFrame, secret: str, key: str, session: str = "session_id", body: str = "body", out: str = "restored", options: RestoreOptions | None = None) -> DataFrame:
    """Adds the restored response."""

    def change(cut: DataFrame) -> DataFrame:
        return restore(cut, vault, secret, session=session, options=options).withColumn("new", F.col("restored"))

    return _through(df, key, body, provider, True, True, change, out, False)


def mask_parts(df: DataFrame, options: MaskOptions, part: str = "part", out: str = "masked") -> DataFrame:
    """Adds masked message parts, JSON bodies with a ``type``: each type's own fields, and all strings of a part of an unknown type.

    Compaction summaries also lose every token. A null part stays null; a part
    that is no object is walked as one of an unknown type.
    """
    from ..functions.tokens import sweep

    done = _through(df, "", part, "part", False, True, lambda cut: mask(cut, options, out="new"), out, False)
    return done.withColumn(out, F.when(F.get_json_object(part, "$.type") == "compaction", sweep(F.col(out))).otherwise(F.col(out)))


# Thinking blocks ------------------------------------------------------------


def replay_thinking(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Thinking blocks (signature, thinking) with the bytes the model signed; blocks without a signed text are dropped, empty ones stay."""
    known = cache.select(F.col("signature").alias("__s"), F.col("thinking").alias("__t"))
    rows = blocks.join(known, F.col("signature") == F.col("__s"), "left")
    kept = rows.filter(F.col("__t").isNotNull() | (F.coalesce("thinking", F.lit("")) == ""))
    return kept.withColumn("thinking", F.coalesce("__t", "thinking")).drop("__s", "__t")


def thinking_cache(blocks: DataFrame, entries: int = 256, size: int = 4 << 20) -> DataFrame:
    """The last ``entries`` signed texts that fit into ``size`` bytes, most recently used first; a text over the size is not kept."""
    from pyspark.sql import Window

    last = blocks.filter(F.octet_length("thinking") <= size).groupBy("signature").agg(F.max_by("thinking", "used_at").alias("thinking"), F.max("used_at").alias("used_at"))
    recent = last.orderBy(F.desc("used_at"), "signature").limit(entries)
    so_far = F.sum(F.octet_length("thinking")).over(Window.orderBy(F.desc("used_at"), "signature"))
    return recent.withColumn("__b", so_far).filter(F.col("__b") <= size).drop("__b")


# Routes and headers -----------------------------------------------------------

# Paths, and header names.
CHAT_PATH, RESPONSES_PATH, ACCOUNT_PREFIX = "/v1/chat/completions", "/v1/responses", "/api/"
HOP_BY_HOP = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length",
)
SENSITIVE_HEADERS = ("authorization", "x-api-key", "anthropic-api-key", "openai-api-key", "cookie", "set-cookie", "proxy-authorization")


def route(path: Column) -> Column:
    """(kind, transform, provider, upstream, upstream_path) of a request path.

    An unknown path of the first provider is masked, as it may carry a whole
    conversation; only its account paths pass.
    """
    name = F.regexp_extract(path, r"^/(anthropic|openai|codex)(?:/|$)", 1)
    rest = F.regexp_extract(path, r"^/(?:anthropic|openai|codex)(/.*)?$", 1)
    upstream = F.when(rest == "", "/").otherwise(rest)
    transform = (
        F.when((name == "anthropic") & ~upstream.startswith(ACCOUNT_PREFIX), "anthropic_messages")
        .when((name == "openai") & (upstream == CHAT_PATH), "openai_chat")
        .when(name.isin("openai", "codex") & (upstream == RESPONSES_PATH), "responses")
        .otherwise("passthrough")
    )
    provider = F.when(transform == "passthrough", F.concat(F.lit("passthrough_"), name)).otherwise(name)
    none = F.lit(None).cast("string")
    found = F.struct(F.lit("provider").alias("kind"), transform.alias("transform"), provider.alias("provider"), name.alias("upstream"), upstream.alias("upstream_path"))
    bare = lambda kind: F.struct(F.lit(kind).alias("kind"), *[none.alias(c) for c in ("transform", "provider", "upstream", "upstream_path")])
    return F.when(path == "/health", bare("health")).when(name != "", found).otherwise(bare("not_found"))


def forwardable(headers: Column, response: bool = False) -> Column:
    """Headers that travel on: no hop-by-hop ones, and for responses no content encoding."""
    gone = [*HOP_BY_HOP, *(["content-encoding"] if response else [])]
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(gone))


def loggable(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_HEADERS), "<redacted>").otherwise(v))


def session_of(header: Column, default: str = "proxy:default", most: int = 128) -> Column:
    """Session of a request: its header's value, if it has one that is not too long."""
    value = F.trim(header)
    return F.when((F.length(value) > 0) & (F.length(value) <= most), F.concat(F.lit("proxy:"), value)).otherwise(default)


def display_tool(name: Column, names: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> Column:
    """True for tools that only show something, by name or suffix in any letter case."""
    low = F.lower(name)
    by_suffix = [low.endswith(s.lower()) for s in suffixes]
    hit = low.isin([n.lower() for n in names]) if names else F.lit(False)
    for s in by_suffix:
        hit = hit | s
    return hit & ~low.isin([x.lower() for x in excluded]) if excluded else hit
