"""Patterns of the detectors, for Java's regex engine.

``\\b`` is never used: Java counts Hangul as word characters there. ``B`` is the
ASCII word boundary, written out so that it holds on either side of any
character. The twins for DuckDB (``*_RE2``) may use ``\\b``, which is ASCII there.
"""

from __future__ import annotations

W = "[A-Za-z0-9_]"
B = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

#: White space as ECMAScript defines it (fixed values).
JS_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
HANGUL = r"[가-힣]"

EMAIL = f"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{B}"
URL = f"{B}https?://[^{JS_SPACE}<>\"'`)]+"
URL_TAIL = r"[.,;:!?)\]}>]+$"
CARD = f"{B}(?:\\d{{4}}[- ]?){{3}}\\d{{4}}{B}"
US_PHONE = f"{B}(?:\\+?1[-.{JS_SPACE}]?)?\\(?\\d{{3}}\\)?[-.{JS_SPACE}]\\d{{3}}[-.{JS_SPACE}]\\d{{4}}{B}"
KR_PHONE = f"{B}01[016-9]-?\\d{{3,4}}-?\\d{{4}}{B}"
RRN = f"{B}\\d{{6}}-?[1-4]\\d{{6}}{B}"
BIZ = f"{B}\\d{{3}}-?\\d{{2}}-?\\d{{5}}{B}"
SSN = f"{B}\\d{{3}}-\\d{{2}}-\\d{{4}}{B}"
HANGUL_RUN = r"[가-힣]{2,4}"

#: Cheap tests that a text with a match passes: a literal, or a pattern that starts with a plain class.
SIGNS = {EMAIL: "@", URL: "://", CARD: r"\d{4}[- ]?\d{4}", US_PHONE: r"\d{3}[-.\s\u0085\p{Z}\ufeff]\d{4}", KR_PHONE: r"01\d-?\d{3}", RRN: r"\d{6}-?[1-4]\d{6}", BIZ: r"\d{3}-?\d{2}-?\d{5}", SSN: r"\d-\d\d-\d"}
LITERAL_SIGNS = ("@", "://")

EMAIL_RE2 = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL_RE2 = r"\bhttps?://[^\s<>""'`)]+"
CARD_RE2 = r"\b(?:\d{4}[- ]?){3}\d{4}\b"
US_PHONE_RE2 = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
BIZ_RE2 = r"\b\d{3}-?\d{2}-?\d{5}\b"
SSN_RE2 = r"\b\d{3}-\d{2}-\d{4}\b"
KR_PHONE_RE2 = r"\b01[016-9]-?\d{3,4}-?\d{4}\b"
RRN_RE2 = r"\b\d{6}-?[1-4]\d{6}\b"

#: Token labels by category (fixed values).
LABELS = {
    "private_person": "PERSON",
    "private_email": "EMAIL",
    "private_phone": "PHONE",
    "private_address": "ADDRESS",
    "account_number": "ACCOUNT",
    "private_date": "DATE",
    "private_url": "URL",
    "secret": "SECRET",
    "rrn": "RRN",
    "biz_num": "BIZNUM",
    "card": "CARD",
}
CATEGORIES = tuple(LABELS)
