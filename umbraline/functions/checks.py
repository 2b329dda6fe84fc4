"""Validity checks of matched numbers and addresses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the check digits (fixed values).
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BIZ_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def _weighed(d: Column, weights: tuple[int, ...]) -> Column:
    return sum((_digit(d, i) * w for i, w in enumerate(weights[1:], 1)), _digit(d, 0) * weights[0])


def _of_length(text: Column, lengths: tuple[int, ...], check) -> Column:
    d = digits(text)
    return F.when(F.length(d).isin(*lengths), check(d)).otherwise(False)


def card_ok(text: Column) -> Column:
    """16 digits that satisfy Luhn's check."""
    return _of_length(text, (16,), lambda d: F.call_function("luhn_check", d))


def rrn_ok(text: Column) -> Column:
    """Korean resident number: 13 digits whose last one checks the weighed sum of the others."""
    return _of_length(text, (13,), lambda d: (F.lit(11) - _weighed(d, RRN_WEIGHTS) % 11) % 10 == _digit(d, 12))


def biz_ok(text: Column) -> Column:
    """Korean business number: 10 digits, weighed, with the carry of the ninth."""
    return _of_length(text, (10,), lambda d: (F.lit(10) - (_weighed(d, BIZ_WEIGHTS) + F.floor(_digit(d, 8) * 5 / 10)) % 10) % 10 == _digit(d, 9))


def kr_phone_ok(text: Column) -> Column:
    return F.length(digits(text)).isin(10, 11)


def ssn_ok(text: Column) -> Column:
    """US social security number: no area 000, 666 or 900 up, no group 00, no serial 0000."""
    area, group, serial = F.substring(text, 1, 3).cast("int"), F.substring(text, 5, 2), F.substring(text, 8, 4)
    return (area != 0) & (area != 666) & (area < 900) & (group != "00") & (serial != "0000")


#: Hosts whose pages need a login or never leave a private network (fixed values).
PRIVATE_SUFFIXES = (
    "internal", "intranet", "corp", "lan", "local", "localdomain", "home.arpa", "test", "invalid", "localhost",
    "ngrok.io", "ngrok.app", "ngrok-free.app", "trycloudflare.com", "loca.lt", "localtunnel.me", "serveo.net", "pagekite.me", "telebit.io",
    "devtunnels.ms", "github.dev",
    "atlassian.net", "sharepoint.com", "onedrive.live.com", "teams.microsoft.com", "slack.com", "okta.com", "oktapreview.com", "auth0.com",
    "service-now.com", "servicenow.com", "zendesk.com", "freshdesk.com", "lightning.force.com", "my.salesforce.com", "notion.so",
    "docs.google.com", "drive.google.com", "dropbox.com", "box.com",
)
#: Query keys that carry a credential (fixed values).
CREDENTIAL_KEYS = (
    "token", "access_token", "refresh_token", "id_token", "api_key", "apikey", "key", "secret", "client_secret", "password", "passwd", "pwd",
    "auth", "authorization", "session", "sessionid", "sig", "signature", "x-amz-signature", "x-amz-credential", "x-amz-security-token", "sas",
)
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_suffix(raw: str) -> str:
    """A suffix as operators write it (``*.acme.com``, ``.acme.com``), in the form that is compared."""
    raw = raw.strip().lower()
    return raw.removeprefix("*").strip(".")


def private_url(url: Column, strict: bool = False, extra_suffixes: Iterable[str] = ()) -> Column:
    """True if a stranger could not open the URL, or it carries a credential; with ``strict``, for any http(s) URL."""
    trimmed = F.trim(url)
    part = lambda i: F.regexp_extract(trimmed, _URL, i)
    web = F.lower(part(1)).isin("http", "https")
    if strict:
        return web
    authority = part(2)
    host = F.regexp_replace(F.lower(F.substring_index(authority, ":", 1)), r"\.+$", "")
    suffixes = [*PRIVATE_SUFFIXES, *filter(None, map(host_suffix, extra_suffixes))]
    known = "(?:^|\\.)(?:" + "|".join(f"\\Q{s}\\E" for s in suffixes) + ")$"
    keys = F.transform(F.split(part(4), "&"), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))))
    return web & (
        authority.contains("@")
        | authority.startswith("[")
        | (host == "")
        | host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
        | ~host.contains(".")
        | host.rlike(known)
        | F.exists(keys, lambda k: k.isin(*CREDENTIAL_KEYS))
    )
