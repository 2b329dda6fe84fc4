"""Model detectors: decoding of token tags, and models run in Arrow batches.

No model is part of the engine. A model is a function of a list of texts that
gives, for each, its tokens' offsets and scores of tags; everything after that
is here. Long texts are cut into overlapping windows, so no text is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..functions.spans import SPAN

Spans = list[tuple[int, int, str, float]]
#: A model: texts to (offsets of tokens, scores of tags) of each.
Tagger = Callable[[list[str]], list[tuple[list[tuple[int, int]], np.ndarray]]]
IMPOSSIBLE = -1e9
#: The names of the biases in a calibration file, by the first letters of the tags before and after.
BIASES = {
    "OO": "transition_bias_background_stay",
    "OB": "transition_bias_background_to_start",
    "OS": "transition_bias_background_to_start",
    "EO": "transition_bias_end_to_background",
    "SO": "transition_bias_end_to_background",
    "EB": "transition_bias_end_to_start",
    "ES": "transition_bias_end_to_start",
    "SB": "transition_bias_end_to_start",
    "SS": "transition_bias_end_to_start",
    "BI": "transition_bias_inside_to_continue",
    "II": "transition_bias_inside_to_continue",
    "BE": "transition_bias_inside_to_end",
    "IE": "transition_bias_inside_to_end",
}


def calibration(text: str) -> dict[str, float]:
    """Biases from the JSON text of a calibration file: the first object in it, at any depth, that names one; those it does not name are 0."""
    names = set(BIASES.values())
    todo = [json.loads(text)]
    while todo:
        at = todo.pop(0)
        if isinstance(at, dict) and names & at.keys():
            wrong = [k for k in names & at.keys() if isinstance(at[k], bool) or not isinstance(at[k], (int, float)) or not np.isfinite(at[k])]
            if wrong:
                raise ValueError(f"not a number: {', '.join(sorted(wrong))}")
            return {k: float(at.get(k, 0.0)) for k in sorted(names)}
        todo += list(at.values()) if isinstance(at, dict) else at if isinstance(at, list) else []
    raise ValueError("the file names no bias")


def transitions(tags: Sequence[str], biases: Mapping[str, float] | None = None) -> np.ndarray:
    """The bias of each move between BIOES tags (0 where none is given), a very low score where a tag may not follow another one."""
    out = np.full((len(tags), len(tags)), IMPOSSIBLE)
    for i, a in enumerate(tags):
        for j, b in enumerate(tags):
            name = BIASES.get(a[0] + b[0])
            if name and (b[0] in "OBS" or a[2:] == b[2:]):
                out[i, j] = (biases or {}).get(name, 0.0)
    return out


def best_paths(batch: Sequence[np.ndarray], tags: Sequence[str], biases: Mapping[str, float] | None = None) -> list[list[int]]:
    """Best tag path of each sequence of token scores that begins and ends outside of a span, all sequences in step.

    Max-plus algebra: the state before the first token is 'outside' alone, a
    token adds its scores to the state's product with the allowed moves and
    their biases, and a path ends where it may move to the outside, which costs
    nothing. A sequence without such a path gets each token's best tag.
    """
    size = np.array([len(x) for x in batch], dtype=np.int64)
    longest, k = int(size.max(initial=0)), len(tags)
    moves = transitions(tags, biases)
    to_end = transitions(tags)[:, tags.index("O")]  # a path may end wherever an outside tag could come next
    grid = np.zeros((longest, len(batch), k))
    for b, x in enumerate(batch):
        grid[: len(x), b] = x
    state = np.full((len(batch), k), IMPOSSIBLE)
    state[:, tags.index("O")] = 0.0
    came = np.zeros((longest, len(batch), k), dtype=np.int64)
    for t in range(longest):
        product = state[:, :, None] + moves
        came[t] = product.argmax(axis=1)
        state = np.where((t < size)[:, None], product.max(axis=1) + grid[t], state)
    ended = state + to_end
    at, out = ended.argmax(axis=1), np.zeros((longest, len(batch)), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        live = t < size
        out[t] = at
        at = np.where(live, came[t, np.arange(len(batch)), at], at)
    possible = ended.max(axis=1, initial=-np.inf) > IMPOSSIBLE / 2
    return [(out[:n, b] if ok else np.argmax(batch[b], axis=1)).tolist() if n else [] for b, (n, ok) in enumerate(zip(size.tolist(), possible, strict=True))]


def bioes_spans(text: str, offsets: Sequence[tuple[int, int]], path: Sequence[int], scores: np.ndarray, tags: Sequence[str]) -> Spans:
    """Spans of a tag path, without white space at their ends; a span's score is its least token probability."""
    odds = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    odds = odds / odds.sum(axis=1, keepdims=True) if len(scores) else odds
    out: Spans = []
    first = None
    for i, t in enumerate(path):
        tag = tags[t]
        if tag[:2] in ("B-", "S-"):
            first = i
        if tag[:2] in ("E-", "S-") and first is not None:
            start, end = offsets[first][0], offsets[i][1]
            covered = text[start:end]
            start, end = start + len(covered) - len(covered.lstrip()), end - (len(covered) - len(covered.rstrip()))
            if end > start:
                out.append((start, end, tag[2:], float(min(odds[k, path[k]] for k in range(first, i + 1)))))
            first = None
        if tag == "O":
            first = None
    return out


def bio_spans(offsets: Sequence[tuple[int, int]], scores: np.ndarray, tags: Sequence[str], keep: Sequence[str] = ("PS",), shortest: int = 2) -> Spans:
    """Spans of the best BIO tags, with their mean probability; only the kept types, as persons, and none shorter than ``shortest``."""
    odds = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    odds = odds / odds.sum(axis=1, keepdims=True) if len(scores) else odds
    found: list[list] = []
    for (a, z), row in zip(offsets, odds, strict=True):
        i = int(row.argmax())
        mark, _, kind = tags[i].partition("-")
        if mark == "B" or (mark == "I" and not (found and found[-1][2] == kind and found[-1][4])):
            if mark == "B":
                found.append([a, z, kind, [float(row[i])], True])
                continue
        elif mark == "I":
            found[-1][1] = z
            found[-1][3].append(float(row[i]))
            continue
        if found:
            found[-1][4] = False
    return [(a, z, "private_person", float(np.mean(p))) for a, z, kind, p, _ in found if kind in keep and z - a >= shortest]


def windows(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows over a text that cover all of it."""
    if size <= overlap:
        raise ValueError("a window must be longer than the overlap")
    out, a = [], 0
    while True:
        out.append((a, min(length, a + size)))
        if a + size >= length:
            return out
        a += size - overlap


def model_detector(load: Callable[[], Tagger], tags: Sequence[str], categories: dict[str, str], size: int = 1_500, overlap: int = 200, least: float = 0.0, tolerant: bool = False, biases: Mapping[str, float] | None = None):
    """A detector from a BIOES model, loaded once for each worker.

    Spans of overlapping windows are joined: of those that overlap, the longest
    stays. ``biases`` (``calibration``) are added to moves between tags. A model that raises for a text fails the query, or, if ``tolerant``,
    gives null spans for it, for the strategy to judge.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out = []
            for text in texts:
                if text is None:
                    out.append(None)
                    continue
                cuts = windows(len(text), size, overlap) if text else []
                spans: Spans = []
                try:
                    found = model([text[a:z] for a, z in cuts]) if cuts else []
                except Exception:
                    if not tolerant:
                        raise
                    out.append(None)
                    continue
                paths = best_paths([scores for _, scores in found], tags, biases)
                for (a, z), (offsets, scores), path in zip(cuts, found, paths, strict=True):
                    spans += [(a + s, a + e, c, p) for s, e, c, p in bioes_spans(text[a:z], offsets, path, scores, tags)]
                kept: Spans = []
                for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
                    if s[2] in categories and s[3] >= least and not any(s[0] < k[1] and s[1] > k[0] for k in kept):
                        kept.append(s)
                out.append([{"start": a, "end": z, "category": categories[c], "confidence": p, "text": text[a:z]} for a, z, c, p in sorted(kept)])
            yield pd.Series(out, dtype=object)

    def detect(text: Column) -> Column:
        return pandas_udf(run, f"array<{SPAN}>")(text)

    # annotations of nested functions are strings here; pandas_udf reads them, so they are given as objects
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return detect
