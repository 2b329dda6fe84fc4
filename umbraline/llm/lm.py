"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

All words stand at the leaves of a tree of ``WAYS`` branches and ``LEVELS``
levels: classes, subclasses, and so on. log P(word | history) is the sum of the
log probabilities of the branches that lead to it, each a softmax over hashed
features of the history, each with the node: the word before, the word two
before (a skip feature) and, for classes and subclasses, the pair of both. So
each factor learns from n-gram and skip features, that of the word itself too.

Frequent words have a leaf each, in an order by k-means over their neighbours,
below all classes but the last. All other words, unseen ones too, have leaves of
the last class by their hash, whatever their number. Words that share such a
leaf share its probability as (c + 1) / (N + V + 1) of that leaf, with one part
for all words not seen. As history, each word has a hash of its own.

Scale: word counts are one aggregation over all training text with map-side
combining. A two-tier lookup gives each token its count: frequent words
(``VOCABULARY`` at most) from a broadcast table, all others from an equi-join
with the table of counts. For training, coded texts are dealt by a hash of key
and text over tasks of ``TASK_TOKENS`` tokens, in the order of that hash, so
that neither the cores nor the layout of the table change a score. Each task
updates its own copy of the weights, and the copies are averaged, row by row, in
two levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, release, scratch, slices

#: Branches of a node, and levels of the tree.
WAYS, LEVELS = 16, 4
#: Leaves of the last class, and those of all others.
RARE_LEAVES = WAYS ** (LEVELS - 1)
RARE = (WAYS - 1) * RARE_LEAVES
#: Words with an entry of their own, beside the end of a text.
VOCABULARY = RARE - 1
#: Rows of hashed features at each level.
ROWS = 1 << 16
#: Buckets of a word's neighbours on either side, of which the first are single frequent words.
NEIGHBOURS, SINGLE = 16, 12
ROUNDS = 1
RATE = 0.3
BATCH = 32_768
#: Features of each level: the word before, the one before that, and both.
FEATURES = (3, 3, 3, 3)
#: Coded tokens of a training task.
TASK_TOKENS = 8_000_000
SPACES = " \t\n\x0b\x0c\r"


@dataclass
class Model:
    """What scoring needs. Ids: 0 is the end of a text, then frequent words, and from ``RARE`` on the hashes of all other words."""

    words: dict[str, int]
    counts: np.ndarray  # of the end and the frequent words
    other_totals: np.ndarray  # N + V + 1 of each leaf of other words
    tokens: int  # N
    types: int  # V
    place: np.ndarray = field(default=None)  # leaf of each frequent word
    bias: list = field(default=None)  # of each level, by node
    rows: list = field(default=None)  # weights of each level's features

    @property
    def known(self) -> int:
        return len(self.counts)

    def leaf(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < RARE, self.place[np.minimum(ids, self.known - 1)], RARE + (ids - RARE) % RARE_LEAVES)

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Ids of all texts in a row, an end after each, where each text's begin, and each text's words that are not frequent."""
        split, empty = _split(texts)
        flat, at = split.values, np.asarray(split.offsets).astype(np.int64)
        n = np.diff(at)
        coded = flat.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        table = np.array([self.words.get(w) or RARE + hashed(w) for w in kinds], dtype=np.int32)
        index = np.asarray(coded.indices)
        ids = np.zeros(len(flat) + len(n), dtype=np.int32)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
        ids[place] = table[index] if len(table) else 0
        starts = at + np.arange(len(at))
        if empty.any():  # trimmed to nothing, it still splits into one empty word
            gone = starts[:-1][empty]
            ids = np.delete(ids, gone)
            starts = np.concatenate([[0], np.cumsum(np.where(empty, 1, n + 1))])
        rare = table[index] >= RARE if len(table) else np.zeros(0, dtype=bool)
        if empty.any():
            rare[at[:-1][empty]] = False
        bounds = np.concatenate([[0], np.cumsum(rare)])[at].astype(np.int32)
        return ids, starts, pa.ListArray.from_arrays(pa.array(bounds), flat.filter(pa.array(rare)).cast(pa.string()))

    def features(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the branch to each token, the node that it leaves from, and the rows of its features, one line a feature."""
        begin = np.uint64((1 << 31) - 1)
        one = np.concatenate([[begin], ids[:-1].astype(np.uint64)])
        one[starts] = begin
        two = np.concatenate([[begin], one[:-1]])
        two[starts] = begin
        histories = [_mixed(one, 1), _mixed(two, 2), _mixed(one * np.uint64(1_000_003) + two, 3)]
        leaf, out = self.leaf(ids.astype(np.int64)), []
        for level in range(LEVELS):
            node = leaf // WAYS ** (LEVELS - level)
            at, rows = node.astype(np.uint64), np.empty((FEATURES[level], len(ids)), dtype=np.uint16)
            for i in range(len(rows)):
                rows[i] = _row(histories[i] + at, level)
            out.append((leaf // WAYS ** (LEVELS - level - 1) % WAYS, node, rows))
        return out

    def window(self, ids: np.ndarray, starts: np.ndarray, a: int, z: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``features`` of the tokens from a to z; their history may lie before a."""
        lo, z = max(0, a - 2), min(len(ids), z)
        own = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, z)] - lo
        return [tuple(v[..., a - lo :] for v in level) for level in self.features(ids[lo:z], own)]

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token, without log10(c + 1) of words that are not frequent."""
        out = np.zeros(len(ids))
        rare = ids >= RARE
        out[rare] = -np.log10(self.other_totals[(ids[rare] - RARE) % RARE_LEAVES])
        for a in range(0, len(ids), BATCH):
            for level, (branch, node, rows) in enumerate(self.window(ids, starts, a, a + BATCH)):
                out[a : a + BATCH] += _log_softmax(_summed_rows(self.bias[level], node, self.rows[level], rows), branch) / np.log(10)
        return out


def hashed(word: str) -> int:
    """30 bits of a word's hash."""
    return zlib.crc32(word.encode("utf-8", "replace")) >> 2


def rare_leaf_sql(word: Column) -> Column:
    """Leaf of a word that is not frequent, within the last class."""
    return F.shiftrightunsigned(F.crc32(word), 2) % RARE_LEAVES


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x * np.uint64(8) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _row(x: np.ndarray, level: int) -> np.ndarray:
    return (((x << np.uint64(2)) + np.uint64(level)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - ROWS.bit_length() + 1)


def _summed_rows(bias: np.ndarray, node: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = bias.take(node, axis=0)
    for own in rows:
        out += table.take(own, axis=0)
    return out


_ONES = np.ones(WAYS, dtype=np.float32)
#: Logits stay below this, so that no shift is needed before they are exponents.
MOST = 60.0


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums by row; the logits are bounded in place."""
    np.minimum(logits, MOST, out=logits)
    e = np.exp(logits)
    return e, np.maximum(e @ _ONES, 1e-30)


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = _exp(logits)[1]
    return logits[np.arange(len(at)), at] - np.log(total)


def _step(logits: np.ndarray, at: np.ndarray, rows: np.ndarray, weights: np.ndarray, past: np.ndarray, uses: np.ndarray) -> None:
    """One gradient update of the feature rows, at rates that fall with the gradients a row has had."""
    e, total = _exp(logits)
    e /= total[:, None]
    e[np.arange(len(at)), at] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # of 16 bits, in linear time
    sorted_rows = flat[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    found, size = sorted_rows[first], np.diff(np.append(first, len(flat)))
    grad = _segment_sums(e, order % len(at), first, size)
    past[found] += np.einsum("ij,ij->i", grad, grad) / WAYS
    uses[found] += size
    weights[found] -= (RATE / np.sqrt(past[found] + 1e-6))[:, None] * grad


def _segment_sums(e: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, turns: int = 8) -> np.ndarray:
    """Sums of the lines ``at`` of e over segments, most of which are short: their lines are added in turns, the rest of long ones by runs."""
    out, live = e.take(at[first], axis=0), np.flatnonzero(size > 1)
    turn = 1
    while len(live) and turn < turns:
        out[live] += e.take(at[first[live] + turn], axis=0)
        turn += 1
        live = live[size[live] > turn]
    if len(live):
        start, n = first[live] + turn, size[live] - turn
        ends = np.cumsum(n)
        out[live] += np.add.reduceat(e.take(at[np.repeat(start - ends + n, n) + np.arange(ends[-1])], axis=0), ends - n, axis=0)
    return out


def tokens_table(docs: DataFrame, model_of: Broadcast, key: str, text: str, held: Column) -> DataFrame:
    """Coded text of each row: rid, k, held_out, ids, and the words that are not frequent."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), held.alias("held_out"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in (part for whole in batches for part in slices(whole, 2)):
            ids, starts, rare = model.code(batch.column(2))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, rare], ["k", "held_out", "ids", "rare"])
        release()

    coded = rows.mapInArrow(run, f"k {kind}, held_out boolean, ids array<int>, rare array<string>")
    return scratch(coded.withColumn("rid", F.monotonically_increasing_id()), "coded")


def _split(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Words of each text with A-Z in lower case, and which texts have none, whose list holds one empty word."""
    texts = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())), characters=SPACES)
    return pc.ascii_split_whitespace(texts), np.asarray(pc.equal(pc.binary_length(texts), 0))


def word_counts(train: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Counts of all words of the training rows, and the number of rows, each of which has one end.

    Words are counted by slices of text before they leave their task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, 4 << 20)):
            found = _split(batch.column(0))[0].flatten().value_counts()
            words, counts = found.field("values"), found.field("counts")
            some = pc.not_equal(words, "")
            yield pa.RecordBatch.from_arrays([words.filter(some).cast(pa.string()), counts.filter(some)], ["w", "c"])
        release()

    found = train.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "w string, c long")
    return scratch(found.groupBy("w").agg(F.sum("c").alias("c")), "counts"), train.count()


def _frequent(counts: DataFrame, ends: int, size: int) -> tuple[Model, DataFrame]:
    """The model without classes, and the counts of the words that are not frequent."""
    top = [(r["w"], r["c"]) for r in counts.orderBy(F.desc("c"), "w").limit(size).collect()]
    if top:
        last_word, last_count = top[-1]
        others = counts.filter((F.col("c") < last_count) | ((F.col("c") == last_count) & (F.col("w") > last_word)))
    else:
        others = counts
    sums = others.groupBy(rare_leaf_sql(F.col("w")).alias("x")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    totals, tokens, types = np.ones(RARE_LEAVES, dtype=np.int64), ends + sum(c for _, c in top), len(top) + (ends > 0)
    for r in sums:
        totals[r["x"]] += r["n"] + r["v"]
        tokens, types = tokens + r["n"], types + r["v"]
    model = Model({w: i + 1 for i, (w, _) in enumerate(top)}, np.array([ends, *(c for _, c in top)], dtype=np.int64), totals, tokens, types)
    return model, others


def _summed(parts: DataFrame, n_parts: int) -> dict[int, np.ndarray]:
    """Sums of the tasks' float blocks by block number, in two levels of about sqrt(tasks) blocks each."""
    fan = max(1, round(n_parts**0.5))

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # rounding then is the same in all runs
        total = np.zeros(len(group["data"][0].as_py()) // 4)
        for x in group["data"]:
            total += np.frombuffer(x.as_py(), dtype=np.float32)
        part = pa.array([group["part"][0].as_py()], pa.int32())
        return pa.table({"block": group["block"][:1], "part": part, "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = PARTS
    some = parts.groupBy("block", F.pmod("part", F.lit(fan)).alias("fan")).applyInArrow(add, schema)
    whole = some.groupBy("block").applyInArrow(add, schema)
    return {r["block"]: np.frombuffer(bytes(r["data"]), dtype=np.float32) for r in whole.collect()}


BLOCK_FLOATS = 1 << 16
PARTS = "block int, part int, data binary"


def _emit(arrays: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    flat = np.concatenate([x.ravel() for x in arrays]).astype(np.float32)
    for i in range(0, len(flat), BLOCK_FLOATS):
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK_FLOATS], pa.int32()), pa.array([part], pa.int32()), pa.array([flat[i : i + BLOCK_FLOATS].tobytes()], pa.binary())], ["block", "part", "data"])
    release()


def _gather(parts: DataFrame, n_parts: int, size: int) -> np.ndarray:
    """Sum over parts of the ``size`` floats that each emitted."""
    found = _summed(parts, n_parts)
    return np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros(size, dtype=np.float32)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), (np.asarray(column.offsets)[:-1] - column.offsets[0].as_py()).astype(np.int64)


def neighbours(coded: DataFrame, ids: int) -> np.ndarray:
    """For each frequent word and one for all others, how often words of each bucket stand before and after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros(ids * 2 * NEIGHBOURS)
        for batch in batches:
            flat, starts = _lists(batch.column(0))
            if len(flat) < 2:
                continue
            flat = np.minimum(flat.astype(np.int64), ids - 1)
            bucket = np.where(flat < SINGLE, flat, SINGLE + flat % (NEIGHBOURS - SINGLE))
            inside = np.ones(len(flat), dtype=bool)
            inside[starts] = False
            at = np.flatnonzero(inside)
            sums += np.bincount(flat[at] * 2 * NEIGHBOURS + bucket[at - 1], minlength=len(sums))
            sums += np.bincount((flat[at - 1] * 2 + 1) * NEIGHBOURS + bucket[at], minlength=len(sums))
        yield from _emit([sums], TaskContext.get().partitionId())

    # counts are whole numbers, so their sums do not depend on how the rows are dealt
    parts = coded.select("ids").mapInArrow(run, PARTS)
    return _gather(parts, coded.rdd.getNumPartitions(), ids * 2 * NEIGHBOURS).reshape(ids, 2 * NEIGHBOURS)


def _k_means(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return np.arange(len(x))
    centre = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())]
    for _ in range(20):
        of = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, x * weight[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-12), x[rng.choice(len(x), k)])
    return (x @ centre.T).argmax(axis=1)


def classify(model: Model, table: np.ndarray) -> None:
    """Gives each frequent word its leaf, neighbours in the order of k-means over their neighbours, and the model the biases of all nodes."""
    known = model.known
    x = np.sqrt(table[:known] + 1e-3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = np.sqrt(np.maximum(model.counts, 1).astype(np.float64))
    group, inner = _k_means(x, weight, WAYS - 1, 1), np.zeros(known, dtype=np.int64)
    for g in range(WAYS - 1):
        at = np.flatnonzero(group == g)
        if len(at):
            inner[at] = _k_means(x[at], weight[at], WAYS, 2 + g)
    model.place = np.empty(known, dtype=np.int64)
    model.place[np.lexsort((np.arange(known), inner, group))] = np.arange(known) * RARE // known
    mass = np.zeros(RARE + RARE_LEAVES)
    mass[model.place] = np.maximum(model.counts, 1e-3)
    mass[RARE:] = model.other_totals
    model.bias, model.rows = [], []
    for level in range(LEVELS):
        nodes = mass.reshape(WAYS**level, WAYS, -1).sum(axis=2)
        share = nodes / np.maximum(nodes.sum(axis=1, keepdims=True), 1e-300)
        model.bias.append(np.where(share > 0, np.log(np.maximum(share, 1e-300)), -40.0).astype(np.float32))
        model.rows.append(np.zeros((ROWS, WAYS), dtype=np.float32))


def _trainer(shared: Broadcast):
    """Function of a task's texts that gives its weights, times their uses, and the uses."""

    def run(group: pa.Table) -> pa.Table:
        m, part = shared.value, group["task"][0].as_py()
        group = group.sort_by("h").combine_chunks()
        ids, starts = _lists(group["ids"].chunk(0))
        weights = [x.copy() for x in m.rows]
        past, uses = ([np.zeros(ROWS, np.float32) for _ in m.rows] for _ in range(2))
        for i in range(0, len(ids), BATCH):
            for k, (branch, node, rows) in enumerate(m.window(ids, starts, i, i + BATCH)):
                _step(_summed_rows(m.bias[k], node, weights[k], rows), branch, rows, weights[k], past[k], uses[k])
        return pa.Table.from_batches(_emit([*(w * u[:, None] for w, u in zip(weights, uses, strict=True)), *uses], part))

    return run


def train(coded: DataFrame, model: Model, tasks: int, rounds: int = ROUNDS) -> None:
    """Gradient updates over all training text (ids, task, h); after each round, a row becomes the mean of the tasks' rows by their uses."""
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)
        sizes = [ROWS * WAYS] * LEVELS + [ROWS] * LEVELS
        parts = coded.groupBy("task").applyInArrow(_trainer(shared), PARTS)
        found = np.split(_gather(parts, tasks, sum(sizes)), np.cumsum(sizes)[:-1])
        model.rows = [w.reshape(-1, WAYS) / np.maximum(u, 1)[:, None] for w, u in zip(found[:LEVELS], found[LEVELS:], strict=True)]
        shared.destroy()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, vocabulary: int = VOCABULARY) -> DataFrame:
    """Trains on the rows that are not held out and scores all of them.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score (this model), both log10 probabilities of the text with
    its end.

    Null and empty texts consist of their end. Without training rows every
    token is unknown. Rows that repeat a key are scored each for itself. Other
    columns are ignored. The row of a null key is a training row. The same rows
    give the same scores, but for the rounding of their sums, however many cores
    there are and however the rows are dealt.
    """
    spark = docs.sparkSession
    held = crc_mod(F.col(key), 7) == 2 if held is None else held
    counts, ends = word_counts(docs.filter(~held), text)
    model, others = _frequent(counts, ends, vocabulary)
    coded = tokens_table(docs, spark.sparkContext.broadcast(model), key, text, held)
    tasks = max(1, -(-model.tokens // TASK_TOKENS))
    rows = coded.filter(~F.col("held_out")).select("ids", F.xxhash64("k", "ids").alias("h"))
    classify(model, neighbours(rows, model.known + 1))
    train(rows.withColumn("task", F.pmod("h", F.lit(int(tasks))).cast("int")), model, tasks)
    base = model.tokens + model.types + 1
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # per id: log10 of base and of the model, without log10(c + 1) of words that are not frequent
        log_base = np.concatenate([np.log10(m.counts + 1.0), [0.0]]) - np.log10(float(base))
        is_known = np.concatenate([m.counts > 0, [False]])
        for batch in batches:
            ids, starts = _lists(batch.column(1))
            if not len(starts):
                continue
            own = np.minimum(ids, m.known)
            sums = [np.add.reduceat(v, starts) for v in (log_base[own], m.score(ids, starts), is_known[own].astype(np.int64))]
            n = np.diff(np.append(starts, len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], ["rid", "n_tokens", "n_known", "base", "score"])
        release()

    own = coded.select("rid", "ids").mapInArrow(run, "rid long, n_tokens long, n_known long, base double, score double")
    rare = coded.select("rid", F.explode("rare").alias("w")).join(others, "w")
    rare = rare.groupBy("rid").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("log_c"))
    out = coded.select("rid", "k", "held_out").join(own, "rid").join(rare, "rid", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + log_c).alias("base_score"), (F.col("score") + log_c).alias("score"),
    )
