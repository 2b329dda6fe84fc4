"""Masking, and the vault of what was masked.

A token is a function of key, label and canonical text alone, so masking is a
map-only pass: no row waits for another one, and partitions never disagree. The
vault is an ordinary table, built from the masked rows by one aggregation whose
first step runs before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replacements
from ..functions import spans as S
from ..functions import tokens as T
from .detect import Strategy, detections, local

VAULT_HARD_CAP, VAULT_SOFT_CAP = 100_000, 10_000
#: Sent to models with masked text (fixed value).
SYSTEM_NOTE = (
    "Inputs may contain privacy-preserving placeholders matching the pattern {{OPF:<LABEL>:<HASH>}}. "
    "Treat them as the original semantic entity, but never generate, expand, or invent new placeholders. "
    "When summarizing or compressing conversation history, preserve every {{OPF:*__ token exactly as written."
)


@dataclass(frozen=True)
class MaskOptions:
    """What ``mask`` detects and puts in its place.

    ``mode``: token (reversible), synthetic (reversible made-up values), hmac
    (irreversible). ``rules`` overrides it by category with placeholders or
    partial masking. ``policy``: passthrough (or open) never detects; closed
    fails the query at a row that cannot be masked; hybrid goes back to the
    pattern detectors for that row.
    """

    secret: str
    strategy: Strategy = field(default_factory=lambda: Strategy(local()))
    mode: str = "token"
    rules: dict[str, dict] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()
    least_confidence: float = 0.0
    generic_secrets: bool = False
    hmac_chars: int = 16
    policy: str = "closed"

    def __post_init__(self) -> None:
        if self.mode not in ("token", "synthetic", "hmac"):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.policy not in ("passthrough", "open", "closed", "hybrid"):
            raise ValueError(f"unknown policy: {self.policy}")


def bypassed(value: str | None) -> bool:
    """True if a switch's value turns masking off."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


ASSIGNED = "array<struct<start:int,end:int,category:string,confidence:double,text:string,token:string,value:string>>"


def _assigned(spans: Column, tokens: Column, values: Column) -> Column:
    """The three arrays as one. Results of Arrow functions stay outside of lambdas, where they could not be evaluated."""
    put = F.zip_with(tokens, values, lambda t, v: F.struct(t.alias("token"), v.alias("value")))
    names = ("start", "end", "category", "confidence", "text")
    return F.zip_with(spans, put, lambda s, p: F.struct(*[s[n].alias(n) for n in names], p["token"].alias("token"), p["value"].alias("value")))


def mask(df: DataFrame, options: MaskOptions, text: str = "text", spans: str | None = None, out: str = "masked", tokens: str = "tokens") -> DataFrame:
    """Adds the masked text and its tokens to each row.

    A token has the span's fields, the reversible ``token``, and the ``value``
    put into the text. ``spans`` names a column of disjoint spans to take
    instead of detecting any; overlapping ones fail the row. Null text stays
    null with null tokens. Columns named ``out`` or ``tokens`` are replaced.
    """
    if options.policy in ("passthrough", "open"):
        return df.withColumn(out, F.col(text)).withColumn(tokens, F.when(F.col(text).isNotNull(), F.from_json(F.lit("[]"), ASSIGNED)))
    rows, ready = (df, None) if spans else options.strategy.prepared(df, F.col(text))
    found = S.assert_disjoint(F.col(spans)) if spans else detections(
        F.col(text), options.strategy, options.excluded, options.least_confidence, options.generic_secrets, fallback=options.policy == "hybrid", ready=ready
    )
    key = T.token_key(options.secret)
    rows = S.settled(rows, "__spans", found)
    labels = F.transform("__spans", lambda s: S.label(s["category"]))
    texts = F.transform("__spans", lambda s: T.canonical(s["text"]))
    rows = rows.withColumn("__tokens", T.token_udf(key)(labels, texts))
    values: Column = F.col("__tokens")
    if options.mode == "hmac":
        rows = rows.withColumn("__values", T.hmac_udf(options.secret, options.hmac_chars)(labels, F.transform("__spans", lambda s: s["text"])))
        values = F.col("__values")
    elif options.mode == "synthetic":
        digest = lambda t: F.regexp_extract(t, T.STRICT, 2)
        values = F.zip_with("__spans", "__tokens", lambda s, t: replacements.synthetic(s["category"], s["text"], replacements.seed(digest(t))))
    if options.rules:
        rule = replacements.by_type(options.rules)
        values = F.zip_with("__spans", values, lambda s, v: F.coalesce(rule(s), v))
    rows = rows.withColumn(tokens, _assigned(F.col("__spans"), F.col("__tokens"), values))
    masked = S.rewrite(F.col(text), F.col(tokens), lambda s: s["value"])
    return rows.withColumn(out, masked).drop("__spans", "__tokens", "__values", "__base", "__seen")


def build_vault(masked: DataFrame, session: str | Column, order: str | Column, tokens: str = "tokens", cap: int | None = VAULT_HARD_CAP) -> DataFrame:
    """The vault: session_id, token, label, text, canonical_text, hash, synthetic_value, uses.

    ``text`` is the first spelling by the rows' order and the span's start.
    A token that stands for two canonical texts, and a session with more tokens
    than ``cap``, fail the query.
    """
    session = F.col(session) if isinstance(session, str) else session
    order = F.col(order) if isinstance(order, str) else order
    rows = masked.select(session.alias("session_id"), order.alias("o"), F.explode(tokens).alias("t"))
    rows = rows.select("session_id", "o", "t", T.canonical(F.col("t.text")).alias("canonical_text"))
    place = F.struct("o", F.col("t.start"))
    vault = rows.groupBy("session_id", F.col("t.token").alias("token")).agg(
        F.min_by(F.col("t.text"), place).alias("text"), F.min("canonical_text").alias("canonical_text"), F.max("canonical_text").alias("__other"),
        F.first("t.category").alias("category"), F.min_by(F.col("t.value"), place).alias("__value"), F.count(F.lit(1)).alias("uses"),
    )
    clash = F.when(F.col("canonical_text") != F.col("__other"), F.raise_error(F.lit("one token stands for two texts")))
    vault = vault.withColumn("canonical_text", F.coalesce(clash, F.col("canonical_text")))
    if cap is not None:
        sizes = vault.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n"))
        vault = vault.join(sizes.withColumnRenamed("session_id", "__s"), F.col("session_id").eqNullSafe(F.col("__s"))).drop("__s")
        full = F.when(F.col("__n") > cap, F.raise_error(F.lit("a session's vault is full")))
        vault = vault.withColumn("token", F.coalesce(full, F.col("token")))
    part = lambda i: F.regexp_extract("token", f"^{T.STRICT}$", i)
    made_up = F.when((F.col("__value") != F.col("token")) & ~F.col("__value").startswith("["), F.col("__value"))
    return vault.select("session_id", "token", part(1).alias("label"), "category", "text", "canonical_text", part(2).alias("hash"), made_up.alias("synthetic_value"), "uses")


def merge_vaults(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both vaults; an old entry's text stays."""
    return old.unionByName(new.join(old, ["session_id", "token"], "left_anti"))


def synthetic_collisions(vault: DataFrame) -> DataFrame:
    """Synthetic values that stand for more than one token of a session, which cannot be restored."""
    some = vault.filter(F.col("synthetic_value").isNotNull())
    return some.groupBy("session_id", "synthetic_value").agg(F.count(F.lit(1)).alias("tokens")).filter(F.col("tokens") > 1)


def vault_sizes(vault: DataFrame, soft: int = VAULT_SOFT_CAP) -> DataFrame:
    """Entries of each session, and whether they are over the soft cap."""
    return vault.groupBy("session_id").agg(F.count(F.lit(1)).alias("size"), F.sum("uses").alias("uses")).withColumn("large", F.col("size") > soft)


def dispose(vault: DataFrame, sessions: Iterable[str] | None = None) -> DataFrame:
    """The vault without the sessions, or without any entry."""
    return vault.filter(F.lit(False)) if sessions is None else vault.filter(~F.col("session_id").isin(list(sessions)))


def retain(vault_uses: DataFrame, now: Column, ttl_seconds: int = 3_600, most: int = 100) -> DataFrame:
    """Sessions (session_id, last_access) that are idle for less than the time to live, the most recent ones first, and no more than ``most``."""
    live = vault_uses.filter(F.col("last_access") > now - F.make_interval(secs=F.lit(ttl_seconds)))
    return live.orderBy(F.desc("last_access"), "session_id").limit(most)


#: Parts that the rows of one token are dealt over when they meet its entry.
SHARES = 16


def _share(df: DataFrame) -> Column:
    """A number below ``SHARES`` from all that tells the row from others of its token."""
    names = [c.lower() for c in df.columns]
    plain = [f"`{c}`" for c, kind in df.dtypes if names.count(c.lower()) == 1 and not any(x in kind for x in ("map<", "variant"))]
    return F.pmod(F.xxhash64(F.lit(0), *plain), F.lit(SHARES))


def token_status(df: DataFrame, vault: DataFrame, secret: str, token: str = "token", session: str = "session_id") -> DataFrame:
    """Adds ``status`` of each row's token: live, expired (of this key), or foreign.

    One token may stand in most rows, so each is looked up once, and its rows
    meet what was found in ``SHARES`` parts. A stream's tokens meet the vault itself.
    """
    known = vault.select(F.col("session_id").alias("__s"), F.col("token").alias("__t"))
    if not df.isStreaming:
        seen = df.select(F.col(session).alias("__m"), F.col(token).alias("__k")).distinct()
        known = known.join(seen, F.col("__s").eqNullSafe(F.col("__m")) & (F.col("__t") == F.col("__k")), "left_semi")
    known = known.select("__s", "__t", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("__p"), F.lit(True).alias("__live"))
    rows = df.withColumn("__part", _share(df))
    rows = rows.join(known, (F.col(session).eqNullSafe(F.col("__s"))) & (F.col(token) == F.col("__t")) & (F.col("__part") == F.col("__p")), "left")
    own = F.substring(F.regexp_extract(token, T.STRICT, 2), 1, T.EPOCH_CHARS) == T.epoch(T.token_key(secret))
    status = F.when(F.col("__live"), "live").when(own, "expired").otherwise("foreign")
    return rows.withColumn("status", status).drop("__s", "__t", "__p", "__part", "__live")


def analyze(text: Column, strategy: Strategy | None = None, **options) -> Column:
    """Spans without their text."""
    found = detections(text, strategy, **options)
    return F.transform(found, lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "category", "confidence")]))


def with_note(prompt: Column) -> Column:
    """The prompt with the note on placeholders, once."""
    empty = prompt.isNull() | (prompt == "")
    return F.when(empty, F.lit(SYSTEM_NOTE)).when(prompt.contains(SYSTEM_NOTE), prompt).otherwise(F.concat(prompt, F.lit(f"\n\n{SYSTEM_NOTE}")))


def hook_decision(n_spans: Column, has_proxy: Column, failed: Column | None = None) -> Column:
    """What a prompt hook does: let through, warn, or block."""
    out = F.when(n_spans == 0, "allow_silent").when(has_proxy, "allow_warn").otherwise("block")
    return out if failed is None else F.when(failed, "block").otherwise(out)

