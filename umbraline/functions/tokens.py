"""Reversible tokens: grammar, keys, hashes, scanning."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import re
import secrets
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .patterns import JS_SPACE
from .spans import let, matches

# The format of the tokens and the messages of their keys, without which tokens would not be the same.
OPEN, CLOSE = "{{OPF:", "}}"
HASH_CHARS, EPOCH_CHARS = 16, 3
KEY_INFO, HMAC_INFO = b"deterministic-token-index", b"hmac-tokenization-key"
EPOCH_MESSAGE = b"opf-key-epoch-v1"
#: Salts of this engine's keys; a ``Secret`` can bring other ones.
KEY_SALT, HMAC_SALT = b"umbraline-token-key-1", b"umbraline-hmac-key-1"
STRICT = r"\{\{OPF:([A-Z][A-Z_]*):([a-z0-9]{16})\}\}"
LENIENT = r"(?i)\{\{OPF:([A-Za-z][A-Za-z0-9_]*):([a-z0-9]{16})(?:\}\})?(?![A-Za-z0-9_])"
REPAIR = r"(?i)\{\{?OPF:([A-Za-z][A-Za-z0-9_]*):([a-z0-9]{15,17})(?:\}\}?)?"
MAX_TOKEN = 32

_BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


class Secret(str):
    """A secret with salts of its own, for tokens that must equal those which another system made with the same secret."""

    key_salt: bytes
    hmac_salt: bytes

    def __new__(cls, secret: str, key_salt: bytes = KEY_SALT, hmac_salt: bytes = HMAC_SALT) -> Secret:
        out = super().__new__(cls, secret)
        out.key_salt, out.hmac_salt = key_salt, hmac_salt
        return out


def hkdf(secret: str, salt: bytes, info: bytes) -> bytes:
    """32 bytes of HKDF-SHA256 (RFC 5869)."""
    if not secret:
        raise ValueError("the secret must not be empty")
    extracted = hmac.new(salt, secret.encode(), hashlib.sha256).digest()
    return hmac.new(extracted, info + b"\x01", hashlib.sha256).digest()


def token_key(secret: str) -> bytes:
    return hkdf(secret, getattr(secret, "key_salt", KEY_SALT), KEY_INFO)


def base36(digest: bytes, chars: int) -> str:
    """The leading characters of the digest as a base-36 number."""
    n, out = int.from_bytes(digest, "big"), []
    while n:
        n, r = divmod(n, 36)
        out.append(_BASE36[r])
    return "".join(reversed(out))[:chars].rjust(chars, "0")


def epoch(key: bytes) -> str:
    """Three characters that name the key."""
    return base36(hmac.new(key, EPOCH_MESSAGE, hashlib.sha256).digest(), EPOCH_CHARS)


def token_hash(key: bytes, label: str, canonical: str) -> str:
    digest = hmac.new(key, f"{label}\0{canonical}".encode(), hashlib.sha256).digest()
    return epoch(key) + base36(digest, HASH_CHARS - EPOCH_CHARS)


def resolve_secret(env: str, path: str | None = None, environ: dict[str, str] | None = None) -> tuple[str, str]:
    """The secret and where it is from: the environment, else a file, which is made where it is missing, else a passing one."""
    found = (os.environ if environ is None else environ).get(env, "").strip()
    if found:
        return found, "environment"
    if path:
        file = Path(path).expanduser()
        try:
            if file.exists() and (text := file.read_text().strip()):
                return text, "file"
            made = secrets.token_hex(32)
            file.parent.mkdir(parents=True, exist_ok=True)
            with os.fdopen(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
                out.write(made)
            return made, "generated"
        except OSError:
            pass
    return secrets.token_hex(32), "ephemeral"


def canonical(text: Column) -> Column:
    """Trimmed, with each run of white space as one space; letter case stays."""
    one = F.regexp_replace(text, f"[{JS_SPACE}]+", " ")
    return F.regexp_replace(one, "^ | $", "")


def format_token(label: str, digest: str) -> str:
    if not re.fullmatch("[A-Z][A-Z_]*", label) or not re.fullmatch(f"[a-z0-9]{{{HASH_CHARS}}}", digest):
        raise TypeError("a token needs an upper-case label and a hash of 16 base-36 characters")
    return f"{OPEN}{label}:{digest}{CLOSE}"


def is_token(text: Column) -> Column:
    return text.rlike(f"^{STRICT}$")


def parsed(token: Column) -> Column:
    """(label, hash) of a token, null if it is none."""
    part = lambda i: F.regexp_extract(token, f"^{STRICT}$", i)
    return F.when(is_token(token), F.struct(part(1).alias("label"), part(2).alias("hash")))


def token_udf(key: bytes) -> Callable[[Column, Column], Column]:
    """Tokens of arrays of labels and canonical texts; the key travels with the function and never in a plan."""
    prefix = epoch(key)

    def mint(labels: pd.Series, texts: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], str] = {}

        def one(label: str, text: str) -> str:
            got = seen.get((label, text))
            if got is None:
                digest = hmac.new(key, f"{label}\0{text}".encode(), hashlib.sha256).digest()
                got = seen[label, text] = f"{OPEN}{label}:{prefix}{base36(digest, HASH_CHARS - EPOCH_CHARS)}{CLOSE}"
            return got

        return pd.Series([None if a is None else [one(x, t) for x, t in zip(a, b, strict=True)] for a, b in zip(labels, texts, strict=True)])

    # marked so that no optimiser rule copies or moves the call
    return pandas_udf(mint, "array<string>").asNondeterministic()


def hmac_udf(secret: str, chars: int = 16) -> Callable[[Column, Column], Column]:
    """Irreversible ``[LABEL:...]`` values of arrays of labels and raw texts."""
    if chars < 4:
        raise ValueError("at least 4 characters")
    key = hkdf(secret, getattr(secret, "hmac_salt", HMAC_SALT), HMAC_INFO)

    def mint(labels: pd.Series, texts: pd.Series) -> pd.Series:
        def one(label: str, text: str) -> str:
            digest = hmac.new(key, text.encode(), hashlib.sha256).digest()
            return f"[{label}:{base64.urlsafe_b64encode(digest).decode().rstrip('=')[:chars]}]"

        return pd.Series([None if a is None else [one(x, t) for x, t in zip(a, b, strict=True)] for a, b in zip(labels, texts, strict=True)])

    # marked so that no optimiser rule copies or moves the call
    return pandas_udf(mint, "array<string>").asNondeterministic()


MATCH = "struct<start:int,end:int,token:string,label:string,hash:string,normalized:string,kind:string>"


def has_token(text: Column) -> Column:
    """Cheap test that must hold for any kind of token."""
    return F.lower(text).contains("opf")


def _scan(text: Column, pattern: str, kind: str) -> Column:
    def match(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m["text"], pattern.replace("(?![A-Za-z0-9_])", ""), i)
        label, digest = F.upper(part(1)), F.lower(part(2))
        token = F.concat(F.lit(OPEN), label, F.lit(":"), digest, F.lit(CLOSE))
        return F.struct(
            m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end"), m["text"].alias("token"),
            label.alias("label"), digest.alias("hash"), token.alias("normalized"), F.lit(kind).alias("kind"),
        )

    return F.transform(matches(text, pattern), match)


def strict(text: Column) -> Column:
    """The strict matches of ``scan``, without a search for others."""
    return F.when(has_token(text), _scan(text, STRICT, "strict")).otherwise(F.from_json(F.lit("[]"), f"array<{MATCH}>"))


def scan(text: Column, repair: bool = False) -> Column:
    """Token matches in order of their start: strict ones, then lenient, then repairable ones where they do not overlap."""

    def apart(first: Column, more: Column) -> Column:
        return F.concat(first, F.filter(more, lambda m: ~F.exists(first, lambda o: (m["start"] < o["end"]) & (m["end"] > o["start"]))))

    found = let(_scan(text, STRICT, "strict"), lambda s: apart(s, _scan(text, LENIENT, "lenient")))
    if repair:
        found = let(found, lambda s: apart(s, _scan(text, REPAIR, "repair")))
    return F.when(has_token(text), F.array_sort(found)).otherwise(F.from_json(F.lit("[]"), f"array<{MATCH}>"))


def sweep(text: Column, replacement: str = "[REDACTED]") -> Column:
    """All strict tokens, in any letter case, replaced."""
    return F.regexp_replace(text, f"(?i){STRICT}", replacement)
