"""Restoring masked text from the vault.

Matches are found per row; only they travel. Exact hits are one equi-join on
(session, token). Misses are repaired by an equi-join too: two hashes are within
one edit only if they share one of their one-character deletions, so a vault of
any size is never paired with all misses, and only the entries of sessions with
a miss are looked at for that. What a text becomes depends on it and its session
alone, so matches are gathered and joined back by a hash of both: rows that share
a key never meet, and equal texts of a session are resolved once.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions import tokens as T
from ..functions.patterns import HANGUL, JS_SPACE, W
from ..sources.scratch import scratch
from .vaults import session_key


@dataclass(frozen=True)
class RestoreOptions:
    """``unknown`` and ``partial``: what becomes of strict and of lenient tokens without an entry: keep or placeholder."""

    lenient: bool = True
    repair: bool = True
    skip_paths: bool = True
    origin: str = "model"
    unknown: str = "keep"
    partial: str = "keep"

    def __post_init__(self) -> None:
        for value in (self.unknown, self.partial):
            if value not in ("keep", "placeholder"):
                raise ValueError(f"unknown handling: {value}")


COUNTERS = (
    "restored_count", "partial_match_count", "lenient_restored_count", "repaired_count", "unknown_token_count", "foreign_count",
    "dead_token_count", "ambiguous_count", "path_skip_count",
)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def deletions(digest: Column) -> Column:
    """The hash itself and all it gives by deleting one character."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(digest)), lambda i: F.concat(F.substring(digest, F.lit(1), i - 1), F.substring(digest, i + 1, F.length(digest)))
    )
    return F.array_distinct(F.concat(F.array(digest), cut))


_SPACE = re.compile(f"[{JS_SPACE}]")
_PATH_START = re.compile(r"[A-Za-z]:[\\/]|\\\\|/|\.\.?[/\\]|[A-Za-z][A-Za-z0-9+.-]*://")


class PathTest:
    """Tells whether a token of a text is part of a path or URL, with a search for white space instead of a scan of what lies around it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spaces = [m.start() for m in _SPACE.finditer(text)]

    def __call__(self, start: int, after: tuple[bool, int]) -> bool:
        """``after``: whether what follows the token begins with a separator, and its separators up to the next white space."""
        at = bisect.bisect_left(self.spaces, start)
        before = self.text[self.spaces[at - 1] + 1 if at else 0 : start]
        separators = before.count("/") + before.count("\\") + after[1]
        touches = before[-1:] in ("/", "\\") and before != "" or after[0]
        return _PATH_START.match(before) is not None or (touches and separators >= 2)


def leading(piece: str, after: tuple[bool, int]) -> tuple[bool, int]:
    """``after`` of ``PathTest`` for what follows, when a piece is put before it."""
    if not piece:
        return after
    space = _SPACE.search(piece)
    run = piece[: space.start()] if space else piece
    return run[:1] in ("/", "\\") and run != "", run.count("/") + run.count("\\") + (0 if space else after[1])


def halves(digest: Column) -> Column:
    """The first and the last characters of a hash; hashes within one edit share one of them, as an edit touches one half only."""
    n = (T.HASH_CHARS - 1) // 2
    return F.array(F.concat(F.lit("<"), F.substring(digest, 1, n)), F.concat(F.lit(">"), F.right(digest, F.lit(n))))


def near_entries(missed: DataFrame, vault: DataFrame) -> DataFrame:
    """Entries (__s, __l, __h, __text) of a vault that may be within one edit of a missed match (session_id, label, hash), some of them twice.

    Only their sessions' entries are looked at, and of those only the ones that
    share a half with a miss go on: none where nothing was missed.
    """
    sessions = missed.select(F.col("session_id").alias("__m")).distinct()
    some = vault.join(sessions, F.col("session_id").eqNullSafe(F.col("__m")), "left_semi").select(
        F.col("session_id").alias("__s"), F.col("label").alias("__l"), F.col("hash").alias("__h"), F.col("text").alias("__text"), F.explode(halves(F.col("hash"))).alias("__half")
    )
    wanted = missed.select(F.col("session_id").alias("__m"), F.col("label").alias("__k"), F.explode(halves(F.col("hash"))).alias("__p")).distinct()
    same = F.col("__s").eqNullSafe(F.col("__m")) & (F.col("__l") == F.col("__k")) & (F.col("__half") == F.col("__p"))
    return some.join(wanted, same, "left_semi").drop("__half")


def resolve(matches: DataFrame, vault: DataFrame, secret: str, repair: bool = True) -> DataFrame:
    """Adds ``found`` (the entry's text), ``repaired`` and ``cause`` (foreign, expired or ambiguous) to matches.

    ``matches`` has session_id, label, hash, normalized and a unique ``mid``. A
    stored vault (``VaultTable.entries``) is not shuffled for exact matches.
    """
    if "session_key" in vault.columns:  # a stored vault, which is joined by its buckets
        entries = vault.select(F.col("session_key").alias("__s"), F.col("token").alias("__t"), F.col("text").alias("found"))
        hit = matches.withColumn("__k", session_key(F.col("session_id"))).join(entries, (F.col("__k") == F.col("__s")) & (F.col("normalized") == F.col("__t")), "left")
    else:
        entries = vault.select(F.col("session_id").alias("__s"), F.col("token").alias("__t"), F.col("text").alias("found"))
        hit = matches.join(entries, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("normalized") == F.col("__t")), "left")
    hit = hit.drop("__k", "__s", "__t")
    if not repair:
        return hit.select(*matches.columns, "found", F.lit(False).alias("repaired"), F.when(F.col("found").isNull(), "expired").alias("cause"))
    own = F.substring("hash", 1, T.EPOCH_CHARS) == T.epoch(T.token_key(secret))
    # what a hash may be repaired to is the same wherever it was missed, so each is asked for once
    asked = hit.filter(F.col("found").isNull()).select("session_id", "label", "hash").distinct()
    miss = asked.withColumn("near", F.explode(deletions(F.col("hash"))))
    known = near_entries(asked, vault).distinct().withColumn("__n", F.explode(deletions(F.col("__h"))))
    # never broadcast: Spark takes these rows for no more than the vault's file, which is many times smaller
    near = miss.join(known.hint("merge"), F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("label") == F.col("__l")) & (F.col("near") == F.col("__n")))
    near = near.filter(within_one_edit(F.col("hash"), F.col("__h")))
    near = near.select(F.col("session_id").alias("__m"), F.col("label").alias("__k"), F.col("hash").alias("__d"), "__h", "__text")
    fixed = near.groupBy("__m", "__k", "__d").agg(F.count_distinct("__h").alias("__ways"), F.min("__text").alias("__fix"))
    out = hit.join(fixed, F.col("session_id").eqNullSafe(F.col("__m")) & (F.col("label") == F.col("__k")) & (F.col("hash") == F.col("__d")), "left")
    repaired = F.col("found").isNull() & (F.coalesce("__ways", F.lit(0)) == 1)
    cause = F.when(F.col("__ways") > 1, "ambiguous").when(own, "expired").otherwise("foreign")
    return out.select(
        *[c for c in matches.columns], F.when(repaired, F.col("__fix")).otherwise(F.col("found")).alias("found"), repaired.alias("repaired"),
        F.when(F.col("found").isNull() & ~repaired, cause).alias("cause"),
    )


def _rewriter(options: RestoreOptions):
    """Arrow function of a text and its resolved matches in order of start: text and counters.

    Right to left, as a path test sees what is already restored; each piece is
    put into a list once, so work grows with the text and its matches only.
    """
    fields = ("start", "end", "token", "label", "kind", "found", "repaired", "cause")

    def one(text: str, matches: list[dict]) -> tuple:
        counts = dict.fromkeys(COUNTERS, 0)
        pieces, at, after, path = [], len(text), (False, 0), PathTest(text)
        for m in reversed(matches):
            gap = text[m["end"] : at]
            pieces.append(gap)
            after = leading(gap, after)
            put = m["found"]
            counts["partial_match_count"] += m["kind"] == "lenient"
            if put is not None:
                counts["restored_count"] += 1
                counts["repaired_count"] += m["repaired"]
                counts["lenient_restored_count"] += m["kind"] == "lenient" and not m["repaired"]
            elif options.skip_paths and path(m["start"], after):
                put = m["token"]
                counts["path_skip_count"] += 1
            else:
                counts["unknown_token_count"] += 1
                counts[{"foreign": "foreign_count", "expired": "dead_token_count", "ambiguous": "ambiguous_count"}[m["cause"]]] += 1
                how = {"strict": options.unknown, "lenient": options.partial}.get(m["kind"], "keep")
                put = f"[UNRESTORABLE:{m['label']}/{m['cause']}]" if how == "placeholder" else m["token"]
            pieces.append(put)
            after = leading(put, after)
            at = m["start"]
        pieces.append(text[:at])
        return "".join(reversed(pieces)), *counts.values()

    kind = pa.struct([("text", pa.string()), *[(c, pa.int32()) for c in COUNTERS]])

    def solved(texts: pa.Array, columns: list[pa.Array]) -> pa.Array:
        rows = []
        for text, *arrays in zip(texts.to_pylist(), *[c.to_pylist() for c in columns], strict=True):
            if text is None or arrays[0] is None:
                rows.append((None, *[0] * len(COUNTERS)))
            else:
                rows.append(one(text, [dict(zip(fields, m, strict=True)) for m in zip(*arrays, strict=True)]))
        return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), kind, strict=True)], fields=list(kind))

    def run(texts: pa.Array, *columns: pa.Array) -> pa.Array:
        # a slice at a time, as Python's strings of a whole batch take several times its memory
        done = [solved(texts.slice(at, n), [c.slice(at, n) for c in columns]) for at, n in text_slices(texts)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    run.__annotations__ = {"texts": pa.Array, "columns": pa.Array, "return": pa.Array}
    call = arrow_udf(run, "text string, " + ", ".join(f"{c} int" for c in COUNTERS))
    return lambda text, matches: call(F.when(matches.isNotNull(), text), *[matches[f] for f in fields])


#: Bytes of text that are Python strings at once when texts are rewritten.
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of texts of about ``size`` bytes, one text at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield start, stop - start
        start = stop


def row_hash(text: Column, session: Column) -> list[Column]:
    """Two hashes, 128 bits in all, of text and session."""
    return [F.xxhash64(F.lit(salt), session.isNull(), session, text).alias(f"__h{salt}") for salt in (1, 2)]


def same_row(a: DataFrame, b: DataFrame) -> list[Column]:
    return [a[f"__h{salt}"] == b[f"__g{salt}"] for salt in (1, 2)]


def restore(df: DataFrame, vault: DataFrame, secret: str, key: str | None = None, text: str = "text", session: str = "session_id", options: RestoreOptions | None = None) -> DataFrame:
    """Adds ``restored`` and the counters to each row.

    Rows need no key (``key`` is not used): null and repeated keys, and rows
    that are equal, are each restored for themselves. unknown = foreign + dead +
    ambiguous; repaired are part of restored; ``residual_token_count`` counts
    matches left in a text that had any. Null text stays null with counters of 0.
    """
    options = options or RestoreOptions()
    found = T.scan(F.col(text), options.repair)
    if not options.lenient:
        found = F.filter(found, lambda m: m["kind"] == "strict")
    ids = row_hash(F.col(text), F.col(session))
    some = df.filter(T.has_token(F.col(text))).select(*ids, F.col(session).alias("session_id"), F.posexplode(found).alias("__i", "m"))
    matches = some.distinct().select("__h1", "__h2", "session_id", "m.*", F.struct("__h1", "__h2", "__i").alias("mid"))
    matches = scratch(matches, "matches")  # resolving reads them several times, and they are few beside the texts they were searched in
    solved = resolve(matches, vault, secret, options.repair)
    fields = ("start", "end", "token", "label", "kind", "found", "repaired", "cause")
    solved = solved.groupBy(F.col("__h1").alias("__g1"), F.col("__h2").alias("__g2")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__m"))
    rows = df.withColumns({f"__h{i}": c for i, c in enumerate(ids, 1)})
    rows = rows.join(solved, same_row(rows, solved), "left").drop("__h1", "__h2", "__g1", "__g2")
    rows = rows.withColumn("__r", _rewriter(options)(F.col(text), F.col("__m")))
    back = {"restored": F.when(F.col("__m").isNotNull(), F.col("__r.text")).otherwise(F.col(text))}
    rows = rows.withColumns(back | {c: F.coalesce(F.col(f"__r.{c}"), F.lit(0)) for c in COUNTERS})
    again = F.size(T.scan(F.col("restored"), options.repair))
    rows = rows.withColumn("residual_token_count", F.when(F.col("__m").isNotNull(), again).otherwise(0))
    model = F.lit(options.origin == "model")
    return (
        rows.withColumn("hallucinated_count", F.when(model, F.col("foreign_count")).otherwise(0))
        .withColumn("unminted_token_count", F.when(model, 0).otherwise(F.col("foreign_count")))
        .drop("__m", "__r")
    )


def observed(df: DataFrame) -> DataFrame:
    """Rows of ``restore`` in which any token was seen."""
    return df.filter(F.col("restored_count") + F.col("unknown_token_count") + F.col("path_skip_count") > 0)


def neutralise(df: DataFrame, vault: DataFrame, secret: str, key: str | None = None, text: str = "text", session: str = "session_id") -> DataFrame:
    """Adds ``neutral``: the text with each strict token that is not live as ``[UNRESTORABLE:LABEL/status]``. Rows need no key."""
    from ..functions.spans import rewrite
    from .mask import token_status

    ids = row_hash(F.col(text), F.col(session))
    some = df.filter(T.has_token(F.col(text))).select(*ids, F.col(session).alias("session_id"), F.explode(T.strict(F.col(text))).alias("m")).distinct()
    some = scratch(some, "matches")  # read twice
    status = token_status(some.select("__h1", "__h2", "session_id", "m.*").drop("kind").withColumnRenamed("token", "raw").withColumnRenamed("normalized", "token"), vault, secret)
    gone = F.concat(F.lit("[UNRESTORABLE:"), F.col("label"), F.lit("/"), F.col("status"), F.lit("]"))
    put = status.select(F.col("__h1").alias("__g1"), F.col("__h2").alias("__g2"), F.struct("start", "end", F.when(F.col("status") == "live", F.col("raw")).otherwise(gone).alias("put")).alias("s"))
    lists = put.groupBy("__g1", "__g2").agg(F.array_sort(F.collect_list("s")).alias("__s"))
    rows = df.withColumns({f"__h{i}": c for i, c in enumerate(ids, 1)})
    rows = rows.join(lists, same_row(rows, lists), "left").drop("__h1", "__h2", "__g1", "__g2")
    return rows.withColumn("neutral", F.when(F.col("__s").isNotNull(), rewrite(F.col(text), F.col("__s"), lambda s: s["put"])).otherwise(F.col(text))).drop("__s")


# Particles that may follow a synthetic Korean name.
SYNTHETIC_PARTICLES = ("이", "가", "은", "는", "을", "를", "의", "와", "과", "도", "만", "씨", "님", "군", "양")


def synthetic_restorer(keep_particle: bool = True):
    """Arrow function of (text, synthetic values, texts): all values in one pass of an automaton, of those that overlap the longest, whole words only.

    A value in Hangul may be followed by one particle; it stays, unless
    ``keep_particle`` is off.
    """
    syllable, word = re.compile(HANGUL), re.compile(W)

    def covers(text: str, start: int, end: int) -> int | None:
        """Where the replaced part ends; none if the value is not a word of its own there."""
        letter = syllable if syllable.search(text, start, end) else word
        joined = lambda i: 0 <= i < len(text) and letter.match(text[i]) is not None
        if joined(start - 1):
            return None
        if letter is syllable and text[end : end + 1] in SYNTHETIC_PARTICLES:
            return end if keep_particle or joined(end + 1) else end + 1
        return None if joined(end) else end

    def automaton(values: list[str], originals: list[str]):
        import ahocorasick

        out = ahocorasick.Automaton()
        for value, original in zip(values, originals, strict=True):
            if value and value not in out:
                out.add_word(value, (len(value), original))
        out.make_automaton()
        return out

    def one(text: str, machine) -> str:
        hits = []
        for last, (n, original) in machine.iter(text):
            stop = covers(text, last + 1 - n, last + 1)
            if stop is not None:
                hits.append((-n, last + 1 - n, stop, original))
        chosen: list[tuple[int, int, str]] = []  # in order of place, and disjoint
        for _, start, stop, original in sorted(hits):
            at = bisect.bisect_left(chosen, (start,))
            if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or chosen[at][0] >= stop):
                chosen.insert(at, (start, stop, original))
        pieces, at = [], 0
        for start, stop, original in chosen:
            pieces += [text[at:start], original]
            at = stop
        return "".join([*pieces, text[at:]])

    def run(texts: pd.Series, values: pd.Series, originals: pd.Series) -> pd.Series:
        machines: dict[tuple, object] = {}
        out = []
        for text, own, put in zip(texts, values, originals, strict=True):
            if text is not None and own is not None and len(own):
                pairs = (tuple(own), tuple(put))
                if pairs not in machines:
                    machines.clear()  # rows of one session stand together
                    machines[pairs] = automaton(*map(list, pairs))
                text = one(text, machines[pairs]) if len(machines[pairs]) else text
            out.append(text)
        return pd.Series(out, dtype=object)

    return pandas_udf(run, "string")


def restore_synthetic(df: DataFrame, vault: DataFrame, text: str = "text", session: str = "session_id", keep_particle: bool = True) -> DataFrame:
    """Adds ``restored``, with the session's synthetic values replaced by what they stand for.

    A session's synthetic values meet in one row of the vault side, which the vault's cap bounds.
    """
    pairs = vault.filter(F.col("synthetic_value").isNotNull()).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("synthetic_value", "text"))).alias("__p"))
    rows = df.join(pairs.withColumnRenamed("session_id", "__s"), F.col(session).eqNullSafe(F.col("__s")), "left").drop("__s")
    fix = synthetic_restorer(keep_particle)
    return rows.withColumn("restored", fix(F.col(text), F.col("__p.synthetic_value"), F.col("__p.text"))).drop("__p")
