"""Token counts by a map-side two-tier lookup of pre-token lengths.

No piece of the vocabulary holds a space mark after another character, nor a
line feed. The tokens of a text are therefore those of its pre-tokens: runs of
space marks with the word after them, and what follows a line feed. A length
is looked up first in a broadcast table of frequent pre-tokens, then in the
worker's cache; only what misses both is encoded.

Scale: two map-only passes. The first finds frequent pre-tokens: each partition
keeps a pruned count and sends its ``PER_PARTITION`` most frequent ones, so what
is shuffled is bounded per partition, and never a pre-token of each row. The
broadcast table holds at most ``TABLE_ROWS`` pre-tokens of at most ``TABLE_BYTES``
bytes each, whatever the corpus holds. Neither bound touches the counts, only
how often the encoder runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = 65_536
TABLE_BYTES = 48
PER_PARTITION = 1_024
PRUNE_AT = 300_000
CACHE_ROWS = 500_000
CACHED_CHARS = 64
OVER_LIMIT = 4_096

MARK = "▁"
_UNEVEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts in a row, and where each text's begin (one more entry than texts).

    A pre-token stands for a space mark and what follows, or, where it starts
    with a line feed, for just itself. Empty and null texts have none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.replace_substring(texts, MARK, " ")
    uneven = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    split = pc.split_pattern(pc.replace_substring(pc.if_else(uneven, "", texts), "\n", " \n"), " ")
    flat, at = split.values, np.asarray(split.offsets).astype(np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    odd = np.asarray(uneven)
    if not (empty.any() or odd.any()):
        return flat, at
    n = np.diff(at)
    keep = np.ones(len(flat), dtype=bool)
    keep[at[:-1][empty | odd]] = False  # an emptied text still splits into one piece
    n[empty | odd] = 0
    parts, own = [], {}
    for i in np.flatnonzero(odd):
        own[i] = [x[1:] if x[0] == " " else x for x in _UNEVEN.findall(" " + texts[int(i)].as_py())]
    flat = flat.filter(pa.array(keep))
    starts = np.concatenate([[0], np.cumsum(n)])
    last = 0
    for i, found in own.items():  # put in at the place of their text
        parts += [flat.slice(last, starts[i] - last), pa.array(found, pa.large_string())]
        last, n[i] = starts[i], len(found)
    parts.append(flat.slice(last))
    return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(n)])


def load(path: str):
    """The sentencepiece processor of a model file, one per worker and path."""
    import sentencepiece

    if path not in _LOADED:
        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


_LOADED: dict = {}


def lengths(tokenizer, found: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    out = [len(x) for x in tokenizer.encode(found, num_threads=1)] if found else []
    # the encoder puts a space mark first: one more than a pre-token at a line feed has; it leaves the empty text empty
    return [1 if p == "" else n - (p[0] == "\n") for p, n in zip(found, out, strict=True)]


class _Worker:
    """Second tier: what a worker has encoded so far, emptied when full."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        self.tokenizer, self.table, self.cache = load(path), table, {}

    def count(self, texts: pa.Array) -> np.ndarray:
        flat, at = pretokens(texts)
        if not len(flat):
            return np.zeros(len(at) - 1, dtype=np.int64)
        coded = flat.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        table, cache = self.table, self.cache
        got = [table.get(p) or cache.get(p, 0) for p in kinds]
        missed = [i for i, n in enumerate(got) if not n]
        for i, n in zip(missed, lengths(self.tokenizer, [kinds[i] for i in missed]), strict=True):
            got[i] = n
            if len(kinds[i]) <= CACHED_CHARS:
                if len(cache) >= CACHE_ROWS:
                    cache.clear()
                cache[kinds[i]] = n
        total = np.concatenate([[0], np.cumsum(np.array(got, dtype=np.int64)[np.asarray(coded.indices)])])
        return total[at[1:]] - total[at[:-1]]


def frequent(docs: DataFrame, text: str = "text", rows: int = TABLE_ROWS) -> list[str]:
    """The most frequent pre-tokens over all rows, as far as each partition's pruned count knows them."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            flat, _ = pretokens(batch.column(0))
            counted = pc.value_counts(flat)
            short = counted.filter(pc.less_equal(pc.binary_length(counted.field("values")), TABLE_BYTES))
            short = short.filter(pc.greater(short.field("counts"), 1))
            for p, n in zip(short.field("values").to_pylist(), short.field("counts").to_pylist(), strict=True):
                seen[p] += n
            if len(seen) > PRUNE_AT:
                seen = Counter(dict(seen.most_common(PRUNE_AT // 3)))
        top = seen.most_common(PER_PARTITION)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["p", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(tally, "p string, n long")
    top = found.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(rows)
    return [r["p"] for r in top.collect()]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = OVER_LIMIT) -> DataFrame:
    """Returns key, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row.

    Counts equal those of the library on the whole text, without begin, end or
    added special tokens. Null and empty texts have no tokens. Texts are never
    cut; one long pre-token is encoded whole. Rows that repeat a key each get
    a row. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tokenizer = load(path)
    table = frequent(docs, text)
    shared = spark.sparkContext.broadcast(dict(zip(table, lengths(tokenizer, table), strict=True)))
    keys = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(path, shared.value)
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = worker.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    out = rows.mapInArrow(count, f"k {keys.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)


Counting = Callable[[pa.Array], np.ndarray]


def counter(path: str, table: dict[str, int] | None = None) -> Counting:
    """A counting function for use in other Arrow operators or tests."""
    return _Worker(path, table or {}).count
