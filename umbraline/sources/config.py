"""Configuration: files with variables, defaults below them, environment settings."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

from ..functions.patterns import CATEGORIES

DEFAULTS: dict[str, Any] = {
    "detection": {
        "categories": list(CATEGORIES), "strict_rrn": True, "us_ssn": False, "generic_secret_scan": False, "url_policy": "heuristic",
        "private_url_hosts": [], "disabled_categories": [], "min_confidence": 0.3, "custom_patterns": [], "personal_data": [],
    },
    "masking": {"mode": "token", "rules": {}, "policy": "closed", "bypass": ""},
    "restoration": {"lenient": True, "repair": True, "skip_paths": True, "unknown": "keep", "partial": "keep"},
}


def leaves(value: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    """Paths and values of a nested object; lists, empty objects and all other values are leaves."""
    if isinstance(value, dict) and (value or not path):
        for name, inner in value.items():
            yield from leaves(inner, (*path, name))
    else:
        yield path, value


def overlay(*layers: Any) -> dict[str, Any]:
    """One object of the layers' leaves, later ones over earlier ones; a null leaf leaves what is below it."""
    flat: dict[tuple[str, ...], Any] = {}
    for path, value in (leaf for layer in layers for leaf in leaves(layer)):
        if value is None and any(known[: len(path)] == path for known in flat):
            continue
        if value == {} and any(known[: len(path)] == path for known in flat):
            continue
        for other in [known for known in flat if known != path and (known[: len(path)] == path or path[: len(known)] == known)]:
            del flat[other]
        flat[path] = value
    out: dict[str, Any] = {}
    for path, value in flat.items():
        place = out
        for name in path[:-1]:
            place = place.setdefault(name, {})
        place[path[-1]] = copy.deepcopy(value)
    return out


def expanded(value: Any, environ: dict[str, str]) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all strings put in; a variable that is not set, or empty, is its default, or empty."""
    if isinstance(value, dict):
        return {name: expanded(inner, environ) for name, inner in value.items()}
    if isinstance(value, list):
        return [expanded(inner, environ) for inner in value]
    if not isinstance(value, str):
        return value
    first, *rest = value.split("${")
    out = [first]
    for piece in rest:
        inside, closed, after = piece.partition("}")
        name, _, default = inside.partition(":-")
        known = closed and name.isascii() and name.isidentifier()
        out.append((environ.get(name) or default) + after if known else "${" + piece)
    return "".join(out)


def load(paths: Iterable[str] = (), environ: dict[str, str] | None = None) -> dict[str, Any]:
    """The defaults, over them the first of the JSON files that exists, and over that the environment's settings. An unknown category is an error."""
    environ = dict(os.environ) if environ is None else environ
    found = next((p for p in map(Path, paths) if p.expanduser().is_file()), None)
    config = overlay(DEFAULTS, expanded(json.loads(found.expanduser().read_text()), environ) if found else {}, environment(environ))
    for field in ("categories", "disabled_categories"):
        if unknown := set(config["detection"][field]) - set(CATEGORIES):
            raise ValueError(f"{field}: unknown {sorted(unknown)}")
    return config


def _flag(value: str) -> bool:
    low = value.strip().lower()
    if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
        raise ValueError(f"not a switch: {value!r}")
    return low in ("1", "true", "yes", "on")


def _names(value: str) -> list[str]:
    return [x for x in (part.strip().lower() for part in value.split(",")) if x]


def _share(value: str) -> float:
    number = float(value)
    if not 0 <= number <= 1:
        raise ValueError(f"not from 0 to 1: {value!r}")
    return number


def _one_of(*known: str):
    def read(value: str) -> str:
        low = value.strip().lower()
        if low not in known:
            raise ValueError(f"{value!r} is none of {', '.join(known)}")
        return low

    return read


#: Settings of the environment: the place of each in the configuration, and how its text is read.
SETTINGS = {
    "UMBRALINE_CATEGORIES": ("detection.categories", _names), "UMBRALINE_DISABLED_CATEGORIES": ("detection.disabled_categories", _names),
    "UMBRALINE_STRICT_RRN": ("detection.strict_rrn", _flag), "UMBRALINE_US_SSN": ("detection.us_ssn", _flag),
    "UMBRALINE_GENERIC_SECRETS": ("detection.generic_secret_scan", _flag), "UMBRALINE_URL_POLICY": ("detection.url_policy", _one_of("heuristic", "strict")),
    "UMBRALINE_PRIVATE_URL_HOSTS": ("detection.private_url_hosts", _names), "UMBRALINE_MIN_CONFIDENCE": ("detection.min_confidence", _share),
    "UMBRALINE_MODE": ("masking.mode", _one_of("token", "synthetic", "hmac")), "UMBRALINE_POLICY": ("masking.policy", _one_of("passthrough", "open", "closed", "hybrid")),
    "UMBRALINE_BYPASS": ("masking.bypass", str), "UMBRALINE_LENIENT": ("restoration.lenient", _flag), "UMBRALINE_REPAIR": ("restoration.repair", _flag),
    "UMBRALINE_SKIP_PATHS": ("restoration.skip_paths", _flag), "UMBRALINE_UNKNOWN": ("restoration.unknown", _one_of("keep", "placeholder")),
    "UMBRALINE_PARTIAL": ("restoration.partial", _one_of("keep", "placeholder")),
}


def environment(environ: dict[str, str] | None = None) -> dict[str, Any]:
    """The configuration layer that the environment's settings make; empty ones do not count, and one that cannot be read is an error that names it."""
    environ = dict(os.environ) if environ is None else environ
    out: dict[str, Any] = {}
    for name, (path, read) in SETTINGS.items():
        if not environ.get(name, "").strip():
            continue
        try:
            value = read(environ[name])
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e
        section, field = path.split(".")
        out.setdefault(section, {})[field] = value
    return out


def options(config: dict[str, Any], secret: str):
    """``MaskOptions`` of a configuration."""
    from ..operators.detect import CustomPattern, DictionaryEntry, Strategy, dictionary, local
    from ..operators.mask import MaskOptions, bypassed

    d, m = config["detection"], config["masking"]
    base = local(d["categories"], strict_rrn=d["strict_rrn"], ssn=d["us_ssn"], url_policy=d["url_policy"], private_hosts=d["private_url_hosts"])
    extra = [CustomPattern(**p).detector() for p in d["custom_patterns"]]
    if d["personal_data"]:
        extra.append(dictionary([DictionaryEntry(**e) for e in d["personal_data"]]))
    return MaskOptions(
        secret, Strategy(base, extra), m["mode"], m["rules"], tuple(d["disabled_categories"]), d["min_confidence"], d["generic_secret_scan"],
        policy="passthrough" if bypassed(m["bypass"]) else m["policy"],
    )
