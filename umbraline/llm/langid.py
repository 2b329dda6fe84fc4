"""Language identification by cross-parsing entropy.

For each language, labelled text is held in a suffix automaton. A document is
parsed against it greedily into longest matches; the language that needs the
fewest phrases, each weighed with the bits that point into its labelled text,
wins. Its cost over that of the language's own letters in random order tells
text from gibberish.

The automata become dense transition tables over byte classes, in which a
missing transition starts the next phrase. Texts are cut into blocks, which
advance in step, one byte each, with one table lookup per language. A block
begins as if a phrase did; then those into which a phrase reaches are walked
again from the state in which it does, until both walks meet, which gives the
phrases of the whole text.

Scale: labelled text is a bounded sample (``TRAIN_ROWS`` rows and ``TRAIN_BYTES``
bytes of each language, ``SAMPLE_BYTES`` of all, the rows with the lowest hashes
of key and text), and all tables together have ``MODEL_BYTES`` at most,
for which a language's share of bytes falls when there are many. A counted bound
on the hash leaves few candidates of each language, of which equal rows are one,
so no language's rows meet in a task. Prediction is one map-only pass over whole
texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, release, slices

#: Bounds of the labelled sample, for each language.
TRAIN_ROWS = 96
TRAIN_BYTES = 24_000
#: Characters that one of the sample's rows adds at most, from a hashed place in its text; less with more rows, so that all of them count.
ROW_CHARS = 1_000
#: Letters of the sample of all languages together; with many languages, each one's share shrinks, and none is left out.
SAMPLE_BYTES = 256 * TRAIN_BYTES
#: Languages up to which their bounds are broadcast, a few bytes each.
BROADCAST_LANGUAGES = 65_536
#: All transition tables together.
MODEL_BYTES = 64 << 20
#: Bytes of the blocks that advance in step.
BLOCK = 1_024
#: Text that advances in step at once, unless one text alone is longer.
SLICE_BYTES = 4 << 20
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased letters, with each run of other characters as one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def automaton(data: bytes, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Dense table of the suffix automaton of ``data``.

    Entry [state, class] holds (next state * n_classes) << 2, plus the number of
    phrases that end there: the one so far, if the match cannot go on, and the
    byte itself, if it does not occur in ``data``.
    """
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in data:
        c = int(classes[byte])
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
        last = cur
    table = np.empty((len(nexts), n_classes), dtype=np.int32)
    root = np.full(n_classes, 2, dtype=np.int32)
    for c, to in nexts[0].items():
        root[c] = (to * n_classes << 2) + 1
    table[:] = root
    table[0] -= 1
    for state, moves in enumerate(nexts):
        if moves:
            table[state, list(moves)] = np.fromiter(moves.values(), dtype=np.int64, count=len(moves)) * n_classes << 2
    return table.ravel()


class Model:
    """Transition tables and phrase weights of the learned languages."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.classes = np.full(256, len(used), dtype=np.int32)  # a byte not seen in training ends each phrase
        self.classes[used] = np.arange(len(used))
        self.n_classes = len(used) + 1
        most = max(1, MODEL_BYTES // (8 * self.n_classes * max(1, len(samples))))  # two states a byte at most, of 4 bytes a class
        samples = {x: s[:most] for x, s in samples.items()}
        self.tables = [automaton(samples[x], self.classes, self.n_classes) for x in self.langs]
        self.bits = np.array([np.log2(len(samples[x]) + 2) for x in self.langs])
        self.sizes = {x: len(samples[x]) for x in self.langs}
        # bits a byte of each sample's letters in random order
        found, sizes = self._parse([_shuffled(samples[x]) for x in self.langs])
        self.noise = found.diagonal() * self.bits / np.maximum(sizes, 1)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        return self._parse(texts)[0]

    def _parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and each text's bytes of letters."""
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        data = [letters(t) for t in texts]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        if not sizes.sum():
            return out, sizes
        codes = self.classes[np.frombuffer(b"".join(data), dtype=np.uint8)]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        size = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        live = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks with more than i bytes
        states = np.zeros((len(self.langs), len(owner)), dtype=np.int32)
        ended = np.zeros((len(self.langs), len(owner)), dtype=np.int32)
        for i in range(int(size[0])):
            n = live[i]
            now = codes[start[:n] + i]
            for k, table in enumerate(self.tables):
                got = table.take(states[k, :n] + now)
                ended[k, :n] += got & 3
                states[k, :n] = got >> 2
        place = np.empty(len(order), dtype=np.int64)  # of each block in the order above
        place[order] = np.arange(len(order))
        before = np.where(nth[order] > 0, place[order - 1], -1)
        after = np.full(len(order), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        for k, table in enumerate(self.tables):
            _carry(table, codes, start, size, before, after, states[k], ended[k])
            out[:, k] = np.bincount(owner, ended[k] + ((after < 0) & (states[k] != 0)), minlength=len(texts)).astype(np.int64)
        return out, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ties go to the first language by name.

        Score: by how much of the second-best language's bits the best one falls short, 0 to 1.
        """
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, disorder and bytes of letters of each text.

        Disorder: bits a byte over those of the language's letters in random
        order, the least of all languages; 1 is a text that no language orders.
        """
        found, sizes = self._parse(texts)
        cost = found * self.bits
        disorder = (cost / np.maximum(sizes, 1)[:, None] / np.maximum(self.noise, 1e-9)).min(axis=1)
        best = cost.argmin(axis=1) if len(texts) else np.zeros(0, dtype=np.int64)
        ordered = np.sort(cost, axis=1)
        second = ordered[:, 1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(second > 0, 1 - ordered[:, 0] / second, 0.0)
        return [self.langs[i] for i in best], np.clip(score, 0, 1), disorder, sizes


def _carry(table: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray, states: np.ndarray, ended: np.ndarray) -> None:
    """Last states and phrases of blocks that were walked from the first state, made those of a walk that goes on from the block before."""
    entry = np.zeros_like(states)
    at = np.flatnonzero(before >= 0)
    entry[at] = states[before[at]]
    at = at[entry[at] != 0]
    ours, theirs, i = entry[at], np.zeros(len(at), dtype=np.int32), 0
    changed: list[int] = []
    while len(at):
        now = codes[start[at] + i]
        a, b = table.take(ours + now), table.take(theirs + now)
        ended[at] += (a & 3) - (b & 3)
        ours, theirs, i = a >> 2, b >> 2, i + 1
        over = size[at] == i
        if over.any():
            states[at[over]] = ours[over]
            changed += at[over & (ours != theirs)].tolist()
        on = ~over & (ours != theirs)
        at, ours, theirs = at[on], ours[on], theirs[on]
    # blocks whose two walks did not meet, as in a text that repeats itself, hand another state on; one after the other
    for block in sorted((int(after[x]) for x in changed if after[x] >= 0), key=lambda x: int(start[x])):
        while block >= 0 and entry[block] != states[before[block]]:
            a, b = int(states[before[block]]), int(entry[block])
            entry[block] = a
            for c in codes[start[block] : start[block] + size[block]].tolist():
                x, y = int(table[a + c]), int(table[b + c])
                ended[block] += (x & 3) - (y & 3)
                a, b = x >> 2, y >> 2
                if a == b:
                    break
            else:
                states[block] = a
                block = int(after[block])
                continue
            break


def _shuffled(sample: bytes) -> str:
    chars = list(sample.decode("utf-8", "ignore"))
    random.Random(7).shuffle(chars)
    return "".join(chars)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model | None:
    """A model of the labelled rows' bounded sample; none if there is no labelled letter.

    Rows are told apart by key and text, so that null and repeated keys are
    rows like others, and rows equal in both count once.
    """
    named = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text), F.lit(7)).alias("r"))
    counts = named.groupBy("l").agg(F.approx_count_distinct("r", 0.02).alias("n"))
    top = sorted((r["l"], r["n"]) for r in counts.collect())  # a row a language
    if not top:
        return None
    size = max(1, min(size, SAMPLE_BYTES // len(top)))
    # of the hashes of a language's n rows, about four times as many lie below the bound as are wanted; all of them if there are few
    bound = lambda n: (1 << 63) - 1 if n <= 4 * rows else (4 * rows << 64) // n - (1 << 63)
    bounds = labelled.sparkSession.createDataFrame([(x, bound(n), max(1, min(ROW_CHARS, -(-size // min(n, rows))))) for x, n in top], f"x {labelled.schema[lang].dataType.simpleString()}, most long, chars int")
    bounds = F.broadcast(bounds) if len(top) <= BROADCAST_LANGUAGES else bounds
    some = named.join(bounds, (F.col("l") == F.col("x")) & (F.col("r") <= F.col("most")))
    first = F.pmod("r", F.greatest(F.length("t") - F.col("chars") + 1, F.lit(1))).cast("int") + 1
    some = some.groupBy("l", "r").agg(F.min(F.substring(F.col("t"), first, F.col("chars"))).alias("t"))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("l").orderBy("r"))).filter(F.col("nth") <= rows)
    samples: dict[str, bytes] = {}
    for r in sorted(some.collect(), key=lambda r: (r["l"], r["nth"])):
        have = samples.get(r["l"], b"")
        samples[r["l"]] = have + b" " + letters(r["t"])[: max(0, size - len(have))]
    samples = {k: v for k, v in samples.items() if v.strip()}
    return Model(samples) if samples else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Returns key, the columns to keep, ``lang_pred``, ``score``, ``disorder`` and ``n_letters`` (bytes of letters) for each row.

    Null texts, texts without a letter, and all texts where no language was
    learned, are ``und`` with score 0 and no letters. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = {f"c{i}": c for i, c in enumerate([key, *keep, text])}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in kept.items()])
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
    last = len(kept) - 1
    rows = rows.withColumn("some", F.coalesce(F.col(f"c{last}").rlike(r"\p{L}"), F.lit(False)))

    added = ("lang_pred", "score", "disorder", "n_letters")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in slices(whole, last, SLICE_BYTES)):
            at = np.flatnonzero(np.asarray(batch.column(last + 1))) if model is not None else []
            langs, (score, disorder), size = [UNDETERMINED] * batch.num_rows, np.zeros((2, batch.num_rows)), np.zeros(batch.num_rows, dtype=np.int64)
            if len(at):
                found, score[at], disorder[at], size[at] = model.judge(batch.column(last).take(pa.array(at)).to_pylist())
                for i, x in zip(at, found, strict=True):
                    langs[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(langs, pa.string()), pa.array(score), pa.array(disorder), pa.array(size)], [*list(kept)[:last], *added])
        release()

    out = rows.mapInArrow(run, schema.replace(f", c{last} {rows.schema[f'c{last}'].dataType.simpleString()}", "") + ", lang_pred string, score double, disorder double, n_letters long")
    names = list(kept.items())[:last]
    return out.select(*[F.col(n).alias(c) for n, c in names], *added)


def held_out(docs: DataFrame, key: str = "doc_id", n: int = 4, remainder: int = 2) -> DataFrame:
    """The rows' held-out flag: crc32 of the key as text leaves the remainder."""
    return docs.withColumn("held_out", crc_mod(F.col(key), n) == remainder)
