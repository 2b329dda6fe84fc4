"""Evaluation: mutations of masked text, scoring of what comes back, precision and recall."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.patterns import LABELS
from ..functions.spans import let, matches, rewrite
from ..sources.scratch import scratch
from .restore import RestoreOptions, restore, row_hash, same_row

# Names that labels are changed to, particles that are glued on, and the text that an invented hash is made of.
ALIASES = {
    "PERSON": "NAME", "EMAIL": "MAIL", "PHONE": "TEL", "ADDRESS": "ADDR", "ACCOUNT": "ACCT", "DATE": "DOB", "URL": "LINK", "SECRET": "APIKEY",
    "RRN": "SSN", "BIZNUM": "COMPANY", "CARD": "PAN",
}
PARTICLES = ("님이", "씨는", "님께", "씨가")
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIDDLE = T.HASH_CHARS // 2


def _tokens(text: Column) -> Column:
    """Strict tokens as spans, for ``rewrite``."""
    found = matches(text, T.STRICT)
    part = lambda m, i: F.regexp_extract(m["text"], T.STRICT, i)
    return F.transform(
        found,
        lambda m, i: F.struct(
            m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end"), m["text"].alias("token"),
            part(m, 1).alias("label"), part(m, 2).alias("hash"), i.alias("i"),
        ),
    )


def _each(change: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda text, _: rewrite(text, _tokens(text), change)


def _token(label: Column, digest: Column) -> Column:
    return F.concat(F.lit(T.OPEN), label, F.lit(":"), digest, F.lit(T.CLOSE))


def _next(c: Column) -> Column:
    return F.translate(c, _DIGITS, _DIGITS[1:] + _DIGITS[0])


def _middle(h: Column) -> Column:
    return F.substring(h, MIDDLE + 1, 1)


def _head(h: Column) -> Column:
    return F.substring(h, 1, MIDDLE)


def invented_hash(seed: str = "invented-token/v1") -> str:
    """A hash of the right form that no key has made."""
    import hashlib

    return T.base36(hashlib.sha256(seed.encode()).digest(), T.HASH_CHARS)


def _swap_label(t: Column, live: Column) -> Column:
    other = F.get(F.filter(live, lambda x: x["label"] != t["label"]), F.lit(0))["label"]
    spare = F.when(t["label"] != "PERSON", F.lit("PERSON")).otherwise(F.lit("EMAIL"))
    return _token(F.coalesce(other, spare), t["hash"])


def _rotated(t: Column, live: Column) -> Column:
    def partner(hashes: Column) -> Column:
        at = F.array_position(hashes, t["hash"])
        return F.get(hashes, (at % F.size(hashes)).cast("int"))

    hashes = F.transform(live, lambda x: x["hash"])
    return _token(t["label"], F.when(F.array_position(hashes, t["hash"]) > 0, let(hashes, partner)).otherwise(t["hash"]))


def _json(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'^\{"t":([\s\S]*)\}$', 1), r"\\/", "/")


@dataclass(frozen=True)
class Mutation:
    """A change that a model may make to masked text; ``live`` is the text's array of (label, hash)."""

    number: int
    name: str
    kind: str
    apply: Callable[[Column, Column], Column]
    least_tokens: int = 1

    @property
    def probe(self) -> bool:
        return self.kind == "probe"


MUTATIONS = (
    Mutation(1, "case-flip", "surface", _each(lambda t: F.translate(t["token"], _LOW + _UP, _UP + _LOW))),
    Mutation(2, "drop-trailing-suffix", "surface", _each(lambda t: F.regexp_replace(t["token"], r"\}\}$", ""))),
    Mutation(3, "hash-char-substitution", "corruption", _each(lambda t: _token(t["label"], F.concat(_head(t["hash"]), _next(_middle(t["hash"])), F.substring(t["hash"], MIDDLE + 2, 99))))),
    Mutation(
        4, "hash-length-change", "corruption",
        _each(lambda t: _token(t["label"], F.when(t["i"] % 2 == 0, F.concat(_head(t["hash"]), _next(_middle(t["hash"])), F.substring(t["hash"], MIDDLE + 1, 99)))
                               .otherwise(F.concat(_head(t["hash"]), F.substring(t["hash"], MIDDLE + 2, 99))))),
    ),
    Mutation(5, "brace-strip", "surface", _each(lambda t: F.concat(F.lit("{"), F.substring(t["token"], F.lit(3), F.length(t["token"]) - 4), F.lit("}")))),
    Mutation(6, "backtick-wrap", "surface", _each(lambda t: F.concat(F.lit("`"), t["token"], F.lit("`")))),
    Mutation(8, "json-string-escape", "surface", lambda text, _: _json(text)),
    Mutation(9, "windows-path-embed", "surface", _each(lambda t: F.concat(F.lit("D:\\Git\\"), t["token"], F.lit("\\file.ts")))),
    Mutation(10, "korean-particle", "surface", _each(lambda t: F.concat(t["token"], F.element_at(F.array(*map(F.lit, PARTICLES)), (t["i"] % 4 + 1).cast("int"))))),
    Mutation(11, "category-rename", "probe", _each(lambda t: _token(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), t["label"]), F.lit("RENAMED")), t["hash"]))),
    Mutation(12, "category-swap", "probe", lambda text, live: rewrite(text, _tokens(text), lambda t: _swap_label(t, live))),
    Mutation(13, "hash-swap", "probe", lambda text, live: rewrite(text, _tokens(text), lambda t: _rotated(t, live)), 2),
    Mutation(14, "invented-token", "probe", lambda text, live: F.concat(text, F.lit(" "), _token(F.coalesce(F.get(live, F.lit(0))["label"], F.lit("PERSON")), F.lit(invented_hash())))),
    Mutation(15, "code-fence", "surface", lambda text, _: F.concat(F.lit("```txt\n"), text, F.lit("\n```"))),
    Mutation(16, "triple-repeat", "surface", _each(lambda t: F.concat_ws(" ", t["token"], t["token"], t["token"]))),
)


def splits(text: Column) -> Column:
    """Mutation 7: the text in two deltas, cut at every place."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))),
        lambda i: F.struct(i.alias("at"), F.substring(text, F.lit(1), i).alias("first"), F.substring(text, i + 1, F.length(text)).alias("second")),
    )


def located(text: Column, needles: Column) -> Column:
    """Start of each needle, looked for from the end of the one before; -1 where it is missing."""
    zero = F.struct(F.lit(0).alias("from"), F.from_json(F.lit("[]"), "array<int>").alias("found"))

    def step(acc: Column, n: Column) -> Column:
        rest = F.substring(text, acc["from"] + 1, F.length(text))
        at = F.instr(rest, n) - 1
        place = F.when(at >= 0, acc["from"] + at).otherwise(-1)
        return F.struct(F.when(at >= 0, place + F.length(n)).otherwise(acc["from"]).alias("from"), F.concat(acc["found"], F.array(place.cast("int"))).alias("found"))

    return F.aggregate(needles, zero, step, lambda a: a["found"])


def mutate(masked: DataFrame, text: str = "masked", key: str = "id") -> DataFrame:
    """Each masked text once for each mutation it has tokens enough for: class, kind, variant key, ``mutated`` and ``live``.

    ``live`` holds the text's distinct tokens in order of their first place.
    """
    live = F.array_distinct(F.transform(_tokens(F.col(text)), lambda t: F.struct(t["label"].alias("label"), t["hash"].alias("hash"))))
    rows = masked.withColumn("live", live)
    cases = [
        F.when(F.size("live") >= m.least_tokens, F.struct(F.lit(m.number).alias("class_id"), F.lit(m.name).alias("class_name"), F.lit(m.kind).alias("kind"), m.apply(F.col(text), F.col("live")).alias("mutated")))
        for m in MUTATIONS
    ]
    rows = rows.withColumn("__c", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())))
    return rows.select(*masked.columns, "live", "__c.*", F.concat_ws("/", F.col(key).cast("string"), F.col("__c.class_id").cast("string")).alias("case_id"))


def _valued(masked: DataFrame, vault: DataFrame, text: str, session: str) -> DataFrame:
    """The rows with ``__v``: label, hash and value of the text's distinct tokens that the session's vault holds."""
    ids = row_hash(F.col(text), F.col(session))
    named = masked.select(*ids, F.col(session).alias("__s0"), F.explode(_tokens(F.col(text))).alias("t")).select("__h1", "__h2", "__s0", "t.label", "t.hash").distinct()
    entries = vault.select(F.col("session_id").alias("__s"), F.col("label").alias("__l"), F.col("hash").alias("__h"), F.col("text").alias("value"))
    met = named.join(entries, F.col("__s0").eqNullSafe(F.col("__s")) & (F.col("label") == F.col("__l")) & (F.col("hash") == F.col("__h")))
    lists = met.groupBy(F.col("__h1").alias("__g1"), F.col("__h2").alias("__g2")).agg(F.collect_set(F.struct("label", "hash", "value")).alias("__found"))
    rows = masked.withColumns({f"__h{i}": c for i, c in enumerate(ids, 1)})
    rows = rows.join(lists, same_row(rows, lists), "left")
    none = F.from_json(F.lit("[]"), "array<struct<label:string,hash:string,value:string>>")
    return rows.select(*masked.columns, F.coalesce("__found", none).alias("__v"))


def scoreboard(masked: DataFrame, vault: DataFrame, secret: str, key: str = "id", text: str = "masked", session: str = "session_id", options: RestoreOptions | None = None, known_gaps: dict[str, float] | None = None) -> DataFrame:
    """For each mutation: cases, values expected and restored, residual tokens, and false restorations.

    A restoration is false if a probe gives a value that the mutated text did
    not name by label and hash. ``known_gaps``: shares of values, by class, that
    are known to come back, where that is less than all.
    """
    # values meet their texts before these are multiplied, and the mutated texts are written, as restoring reads them twice;
    # the texts that they were made of are not read again, and would travel with each
    cases = mutate(_valued(masked, vault, text, session), text, key).select(session, "class_id", "class_name", "kind", "mutated", "__v")
    done = restore(scratch(cases, "cases"), vault, secret, None, "mutated", session, options)
    count = lambda keep: F.size(F.array_distinct(F.transform(F.filter("__v", keep), lambda v: v["value"])))
    named = lambda v: F.col("mutated").contains(F.concat(F.lit(T.OPEN), v["label"], F.lit(":"), v["hash"]))
    back = lambda v: F.col("restored").contains(v["value"])
    foreign = F.when(F.col("kind") == "probe", count(lambda v: back(v) & ~F.col("mutated").contains(v["value"]) & ~named(v))).otherwise(0)
    scored = done.select("class_id", "class_name", "kind", "residual_token_count", count(lambda v: F.lit(True)).alias("expected"), count(back).alias("back"), foreign.alias("foreign"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    board = scored.groupBy("class_id", "class_name", "kind").agg(
        F.count(F.lit(1)).alias("cases"), total("expected").alias("expected"), total("back").alias("restored"),
        F.sum("residual_token_count").alias("residual"), total("foreign").alias("foreign_restorations"),
    )
    board = board.unionByName(delta_board(masked, vault, key, text, session))
    return board.withColumn("status", class_status(dict(known_gaps or {})))


def class_status(known_gaps: dict[str, float]) -> Column:
    """State of a class: a probe is withheld, or repaired by its hash alone whatever its label; others are whole, as far as is known to be possible, or worse."""
    share = F.col("restored") / F.col("expected")
    gap = functools.reduce(lambda a, kv: F.when(F.col("class_name") == kv[0], F.lit(float(kv[1]))).otherwise(a), known_gaps.items(), F.lit(None).cast("double"))
    return (
        F.when(F.col("foreign_restorations") > 0, "invariant-violated")
        .when((F.col("kind") == "probe") & F.col("class_name").isin(*LABEL_PROBES) & (F.col("restored") > 0), "category-blind-repair")
        .when(F.col("kind") == "probe", "probe-withheld")
        .when(F.col("restored") == F.col("expected"), "ok")
        .when(share >= gap, "baseline-gap")
        .otherwise("regression")
    )


#: Probes that change a token's label and leave its hash.
LABEL_PROBES = ("category-rename", "category-swap")


def delta_board(masked: DataFrame, vault: DataFrame, key: str = "id", text: str = "masked", session: str = "session_id") -> DataFrame:
    """Mutation 7 as a row of the scoreboard: each text in two deltas, cut at every place; a value counts as restored if every cut gives it back.

    A buffer holds back no more than its window, so only cuts as near to a token
    can matter, and what lies around it. Needs one text and the session's
    entries of its own tokens at a time.
    """
    tokens = masked.select(F.col(session).alias("session_id"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    named = tokens.select("session_id", "t", F.explode_outer(F.array_distinct(F.transform(_tokens(F.col("t")), lambda x: x["token"]))).alias("token"))
    entries = vault.select(F.col("session_id").alias("__s"), F.col("token").alias("__t"), F.col("text").alias("value"))
    met = named.join(entries, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("token") == F.col("__t")), "left")
    cases = met.groupBy("session_id", "t").agg(F.map_from_entries(F.collect_set(F.when(F.col("value").isNotNull(), F.struct("token", "value")))).alias("entries"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..streaming.deltas import WINDOW, DeltaBuffer, by_table

        def back(piece: str, cut: int, fix: Callable[[str], str]) -> str:
            buffer = DeltaBuffer()
            return fix(buffer.take(piece[:cut])) + fix(buffer.take(piece[cut:], last=True))

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                entries = dict(r.entries)
                fix, lost, left = by_table(entries), set(), 0
                for m in re.finditer(T.STRICT, r.t):
                    piece = r.t[max(0, m.start() - WINDOW) : m.end() + WINDOW]
                    if m[0] in entries and any(back(piece, cut, fix) != fix(piece) for cut in range(1, len(piece))):
                        lost.add(entries[m[0]])
                        left += 1
                rows.append((len(set(entries.values())), len(set(entries.values()) - lost), left))
            yield pd.DataFrame(rows, columns=["expected", "restored", "residual"])

    done = cases.mapInPandas(run, "expected long, restored long, residual long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    board = done.agg(F.count(F.lit(1)).alias("cases"), total("expected"), total("restored"), total("residual"))
    return board.select(
        F.lit(7).alias("class_id"), F.lit("delta-split").alias("class_name"), F.lit("surface").alias("kind"), "cases", "expected", "restored", "residual",
        F.lit(0).cast("long").alias("foreign_restorations"),
    )


def false_restoration_rate(board: DataFrame) -> DataFrame:
    """One row: probes, false restorations among them, and their share, 0 without probes."""
    probes = board.filter(F.col("kind") == "probe").agg(F.coalesce(F.sum("expected"), F.lit(0)).alias("probes"), F.coalesce(F.sum("foreign_restorations"), F.lit(0)).alias("foreign_restorations"))
    return probes.withColumn("false_restoration_rate", F.when(F.col("probes") > 0, F.col("foreign_restorations") / F.col("probes")).otherwise(0.0))


def precision_recall(expected: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Matches of (by, text, category) between two lists of spans, with precision, recall and F1 of each category; null where undefined."""
    cols = [*by, "category", "text"]
    count = lambda df, name: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "e").join(count(found, "f"), cols, "full")
    both = both.fillna(0, ["e", "f"])
    tp = F.sum(F.least("e", "f"))
    out = both.groupBy("category").agg(tp.alias("tp"), (F.sum("f") - tp).alias("fp"), (F.sum("e") - tp).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", ratio(tp * 2, tp * 2 + fp + fn))


def labels() -> list[str]:
    return list(LABELS.values())
