"""Near-duplicate groups by MinHash with one permutation.

Each set of word shingles is cut by one hash into bins; a bin keeps its least
hash, and an empty bin takes over a filled one by optimal densification. Bands
of bins put similar sets into common buckets. In a bucket, a star (one centre
against all members) bounds the pairs; a pair is a link only if the full sets
are similar enough.

Sets that are equal are one node from the start, so a group of exact copies
costs one row in each step. A set so small that a link to it allows one shingle
of difference only (below 8 at a similarity of 0.8) has an exact way: the larger
set gives the digests of what remains without each one of its shingles, and an
equi-join with the smaller sets' digests finds all such links.

A star can miss two members that are similar to each other but not to the
centre. Buckets whose members are not all in one component afterwards are
compared by signatures in tasks of bounded size: all members outside the
bucket's largest component with all of its members. What leaves a task is a
spanning forest of the components that look alike, fewer rows than it read.
Components that hang together by such forests are a cluster; its rows outside
its largest component are compared with all of its rows on full sets, again in
tasks of bounded size, which give a spanning forest of the links found. A bucket
with too many members outside its largest component is first dealt anew by its
members' rarest shingles: similar sets share one of each other's rarest fifth,
so the members that share no rare shingle are never paired. Every pair of a
bucket is tested, connected, or shown to be no link, and none of it is capped.

Scale: a row of each distinct set goes to ``BANDS`` buckets. Buckets are counted
with map-side combining and joined back, which adaptive execution splits for a
large bucket. Candidates are thinned by set sizes and by their signatures
before any full set is fetched. Components are found by label propagation with
pointer jumping over tables in the shared folder. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, identified, release, scratch, slices, without

SHINGLE = 5
PERCENT = 80
#: A pair of similarity 0.8 shares no bucket with probability (1 - 0.8**7)**64 = 3e-7; one of 0.85, with 1e-11.
BANDS, ROWS = 64, 7
BINS = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share of the bins are not fetched. Of sets with a similarity of 0.8, that share has a standard
#: deviation of 0.018 to 0.022 from ``SMALL`` shingles on and of 0.024 below, so these bounds lie five and six of them below 0.8.
LEAST_AGREEMENT, LEAST_OF_SMALL, SMALL = 0.69, 0.65, 64
#: Members of a bucket that are compared in one task, on either side.
TASK_MEMBERS = 4_096
#: Members of a bucket outside its largest component beyond which its rarest shingles deal it anew.
CROWD = 4_096
#: Shingles on either side of a task that compares full sets.
TASK_SHINGLES = 500_000
#: Up to so many keys of 8 bytes are broadcast to pick rows; beyond that, rows are joined by a shuffle.
BROADCAST_KEYS = 500_000
SPACES = " \t\n\x0b\x0c\r"
#: Memory of a row's signature while it is made.
ROW_BYTES = 8 * 1_024


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, laid end to end, and where each text's begin (one more entry).

    A text with fewer words than a shingle has one, of all its words; one without words has none.
    """
    texts = pc.ascii_trim(pc.fill_null(texts, "").cast(pa.large_string()), characters=SPACES)
    split = pc.ascii_split_whitespace(texts)
    flat, at = split.values, np.asarray(split.offsets).astype(np.int64)
    n = np.diff(at)
    n[np.asarray(pc.equal(pc.binary_length(texts), 0))] = 0
    coded = flat.dictionary_encode()
    own = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(flat) else np.zeros(0, np.uint64)
    h = own[np.asarray(coded.indices)].astype(np.uint64)
    rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled = _mix(rolled * _ODD + h[i : len(h) - width + 1 + i] + np.uint64(1))
    out = []
    for a, size in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if size >= width:
            out.append(np.unique(rolled[a : a + size - width + 1]))
        elif size:
            x = np.zeros(1, dtype=np.uint64)
            for i in range(size):
                x = _mix(x * _ODD + h[a + i : a + i + 1] + np.uint64(1))
            out.append(_mix(x + np.uint64(size)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _other_bin(bin_: np.ndarray, attempt: int) -> np.ndarray:
    """Where an empty bin looks: the bin and the attempt alone decide, so that equal sets go the same way."""
    return (_mix(bin_.astype(np.uint64) * _ODD + np.uint64(attempt + 1)) % np.uint64(BINS)).astype(np.int64)


#: Sets with so few filled bins look up each empty bin's first attempt that hits a filled one, instead of making hundreds of attempts.
FEW_BINS = 48
_ATTEMPTS: list[np.ndarray] = []


def _first_attempts() -> np.ndarray:
    """Entry [b, j]: the first attempt at which the empty bin j looks into bin b; -1 in the diagonal, as a filled bin is its own."""
    if not _ATTEMPTS:
        table, bins, attempt = np.full((BINS, BINS), np.iinfo(np.int16).max, dtype=np.int16), np.arange(BINS), 0
        table[bins, bins] = -1
        while (table == np.iinfo(np.int16).max).any() and attempt < np.iinfo(np.int16).max:
            other = _other_bin(bins, attempt)
            table[other, bins] = np.minimum(table[other, bins], attempt)
            attempt += 1
        _ATTEMPTS.append(table)
    return _ATTEMPTS[0]


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each set, with optimal densification; zeros for an empty set."""
    d = len(at) - 1
    out, filled = np.zeros((d, BINS), dtype=np.uint64), np.zeros((d, BINS), dtype=bool)
    bins = ((sets >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    cell = np.repeat(np.arange(d), np.diff(at)) * BINS + bins
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else cell
    out.ravel()[cell[first]] = sets[first]
    filled.ravel()[cell[first]] = True
    held = filled.sum(axis=1)
    few = np.flatnonzero((held > 0) & (held <= FEW_BINS))
    for i in few.tolist():
        own = np.flatnonzero(filled[i])
        out[i] = out[i, own[_first_attempts()[own].argmin(axis=0)]]
    row, col = np.nonzero(~filled & (held > FEW_BINS)[:, None])
    attempt = 0
    while len(row):
        other = _other_bin(col, attempt)
        hit = filled[row, other]
        out[row[hit], col[hit]] = out[row[hit], other[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, (len(sig), BANDS)).copy()
    for i in range(ROWS):
        key = _mix(key * _ODD + sig.reshape(-1, BANDS, ROWS)[:, :, i])
    return key.view(np.int64)


def _least(percent: int) -> int:
    """Sets of fewer shingles link with another set only if one shingle is the whole difference."""
    # a difference of two needs 2 * percent / (100 - percent) common ones
    return -(-2 * percent // (100 - percent)) if percent < 100 else 1 << 62


def _sums(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set, which stand for its equality: 128 bits, with its size."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(_mix(sets + np.uint64(s)))]) for s in SALTS]
    return [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]


SALTS = (17, 29)


def _described(docs: DataFrame, own: str, key: str, text: str, width: int, percent: int) -> DataFrame:
    """own, rid, k, size and digest of the set, signature (low 8 bits of each bin), band keys, and digests without a shingle, of each row.

    Sets below ``_least`` have no band, sets above it no such digest.
    """
    kind, least = docs.schema[key].dataType.simpleString(), _least(percent)
    place = docs.schema[own].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in (part for whole in batches for part in slices(whole, 2, 4 << 20, ROW_BYTES)):
                sets, at = shingle_sets(batch.column(2), width)
                n = np.diff(at)
                large = n >= least
                sig = np.zeros((len(n), BINS), dtype=np.uint64)
                if large.any():
                    sig[large] = signatures(sets[np.repeat(large, n)], np.concatenate([[0], np.cumsum(n[large])]))
                d1, d2 = _sums(sets, at)
                small = (n > 1) & (n <= least)
                cut = sets[np.repeat(small, n)]
                shorter = [np.repeat(d[small], n[small]) - _mix(cut + np.uint64(s)).view(np.int64) for d, s in zip((d1, d2), SALTS, strict=True)]
                rows = [
                    batch.column(0), batch.column(1), pa.array(n), pa.array(d1), pa.array(d2), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()),
                    _lists(band_keys(sig[large]).ravel(), np.where(large, BANDS, 0)), *(_lists(x, np.where(small, n, 0)) for x in shorter),
                ]
                yield pa.RecordBatch.from_arrays(rows, ["own", "k", "n", "d1", "d2", "sig", "bands", "e1", "e2"])
        release()

    rows = docs.select(F.col(own).alias("own"), F.col(key).alias("k"), ascii_lower(F.col(text).cast("string")).alias("t"))
    fields = f"own {place}, k {kind}, n long, d1 long, d2 long, sig binary, bands array<long>, e1 array<long>, e2 array<long>"
    return scratch(rows.mapInArrow(run, fields).withColumn("rid", F.monotonically_increasing_id()), "described")


def _one_apart(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links of the sets below ``_least`` with sets that have one shingle more."""
    least = _least(percent)
    small = nodes.filter((F.col("rid") == F.col("node")) & (F.col("n") < least) & (F.col("n") * 100 >= (F.col("n") + 1) * percent))
    small = small.select(F.col("rid").alias("a"), (F.col("n") + 1).alias("n"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    pairs = rows.filter((F.col("n") > 1) & (F.col("n") <= least)).join(nodes.filter(F.col("rid") == F.col("node")).select("rid"), "rid", "left_semi")
    pairs = pairs.select(F.col("rid").alias("b"), "n", F.explode(F.arrays_zip("e1", "e2")).alias("e")).select("b", "n", "e.e1", "e.e2")
    return pairs.join(small, ["n", "e1", "e2"]).select("a", "b")


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))


def _classes(rows: DataFrame) -> DataFrame:
    """rid and node: the least rid of the rows with the same set; a row with an empty set is its own node."""
    some = rows.filter(F.col("n") > 0).select("rid", "n", "d1", "d2")
    shared = some.groupBy("n", "d1", "d2").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("node")).filter(F.col("m") > 1).drop("m")
    joined = rows.select("rid", "own", "k", "n", "d1", "d2").join(scratch(shared, "classes"), ["n", "d1", "d2"], "left")
    return scratch(joined.select("rid", "own", "k", "n", "d1", "d2", F.coalesce("node", "rid").alias("node")), "nodes")


def components(edges: DataFrame) -> DataFrame:
    """v and label (least vertex reachable) of the vertices of undirected edges (a, b)."""
    both = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["v"] == near["a"], "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        lower = scratch(lower, "lower")
        jump = lower.select(F.col("v").alias("w"), F.col("label").alias("far"))
        labels = lower.join(jump, F.col("label") == F.col("w"), "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        labels = scratch(labels, "labels")
        if labels.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.select("v", "label")


def _floor(n: np.ndarray) -> np.ndarray:
    return np.where(n < SMALL, LEAST_OF_SMALL, LEAST_AGREEMENT)


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree often enough."""
    one = sigs.select(F.col("rid").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    two = sigs.select(F.col("rid").alias("b"), F.col("sig").alias("sb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for i in (2, 3))
                ok = pa.array(_agreeing(x, y) >= _floor(np.asarray(batch.column(4))) * BINS)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])
        release()

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, own: str, text: str, width: int, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, size and full set of the wanted nodes, from their rows' texts."""
    picked = scratch(nodes.join(wanted, "rid", "left_semi").select("rid", F.col("own").alias("at")), "picked")
    few = picked.count() <= BROADCAST_KEYS
    rows = docs.select(F.col(own).alias("own"), ascii_lower(F.col(text).cast("string")).alias("t"))
    rows = rows.join(F.broadcast(picked) if few else picked, F.col("own") == F.col("at")).select("rid", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in (part for whole in batches for part in slices(whole, 1)):
                sets, at = shingle_sets(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), _lists(sets.view(np.int64), np.diff(at))], ["rid", "n", "shingles"])
        release()

    return rows.mapInArrow(run, "rid long, n long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("xa", "xb")))
    return met.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _stars(open_: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Each bucket's centres with its members of other components that are not too different in size."""
    pairs = open_.join(chosen, "bucket").filter((F.col("comp") != F.col("cc")) & (F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent))
    return pairs.select(F.least("rid", "c").alias("a"), F.greatest("rid", "c").alias("b")).distinct()


class _Forest:
    """Union-find that keeps the edges that joined something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int, edge: tuple[int, int]) -> None:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append(edge)

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array([a for a, _ in self.edges], pa.int64()), "b": pa.array([b for _, b in self.edges], pa.int64())})


def _agreeing(sig: np.ndarray, own: np.ndarray) -> np.ndarray:
    """In how many bins each signature agrees with one: bytes of 0 and 1 are summed eight at a time, in halves so that no byte overflows."""
    same = (sig == own).view(np.uint64).reshape(len(sig), 2, BINS // 16).sum(axis=2)
    return ((same * np.uint64(0x0101010101010101)) >> np.uint64(56)).sum(axis=1)


def _alike(i: int, every: int, n: np.ndarray, comp: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Of the first rows, which are in order of size, those of other components than row i whose sizes and signatures allow a link, most alike first."""
    a, z = np.searchsorted(n[:every], [-(-n[i] * percent // 100), n[i] * 100 // percent + 1])
    if a == z:  # a task deals with rows of any size; often none of them fits
        return np.zeros(0, np.int64)
    same = _agreeing(sig[a:z], sig[i])
    at = np.flatnonzero((same >= _floor(n[i]) * BINS) & (comp[a:z] != comp[i]))
    return at[np.argsort(-same[at].astype(np.int64), kind="stable")] + a


def _parts(x: Column, size: int) -> Column:
    return F.greatest(F.ceil(x / size), F.lit(1)).cast("int")


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """Rows dealt over the tasks (ci, ki) of their group: each row once to each of ``k`` tasks, and as a probe, if outside ``top``, to each of ``c``."""
    mark = lambda n: F.pmod(F.xxhash64("rid", F.lit(5)), n).cast("int")
    every = rows.select(group, "rid", "n", "comp", mark(F.col("c")).alias("ci"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("ki"), F.lit(False).alias("probe"))
    probes = rows.filter(F.col("comp") != F.col("top"))
    probes = probes.select(group, "rid", "n", "comp", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("ci"), mark(F.col("k")).alias("ki"), F.lit(True).alias("probe"))
    return every.unionByName(probes)


def _look_alikes(open_: DataFrame, buckets: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Forest of the components whose rows agree, as pairs of components, found bucket by bucket in tasks of bounded size."""
    sizes = buckets.select("bucket", "top", _parts(F.col("all"), TASK_MEMBERS).alias("c"), _parts(F.col("others"), TASK_MEMBERS).alias("k"))
    rows = _blocks(open_.select("bucket", "rid", "n", "comp").join(sizes, "bucket"), "bucket").join(sigs.select("rid", "sig"), "rid")

    def run(group: pa.Table) -> pa.Table:
        probe = group["probe"].to_numpy()
        order = np.lexsort((group["rid"].to_numpy(), group["n"].to_numpy(), probe))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)[order]
        n, comp, probe = group["n"].to_numpy()[order], group["comp"].to_numpy()[order], probe[order]
        forest, every = _Forest(), int((~probe).sum())
        for i in range(every, len(n)):
            for j in _alike(i, every, n, comp, sig, percent).tolist():
                forest.join(int(comp[i]), int(comp[j]), (int(comp[i]), int(comp[j])))
        return forest.table()

    return rows.groupBy("bucket", "ci", "ki").applyInArrow(run, "a long, b long").distinct()


def _by_rare_shingles(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Crowded rows (rid, n, comp) dealt anew, with ``bucket`` a shingle: each row to its rarest ones, of which similar sets share one.

    Of n shingles, n - ceil(n * percent / 100) + 1 are the rarest, by count among the crowd and then by hash, an order for all.
    """
    each = crowd.join(sets.select("rid", "shingles"), "rid").select("rid", "n", "comp", F.explode("shingles").alias("bucket"))
    each = scratch(each, "crowd")
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    ranked = each.join(counts, "bucket").groupBy("rid", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("m", "bucket"))).alias("s"))
    some = ranked.select("rid", "n", "comp", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("x"))
    return some.filter(F.col("x.m") > 1).select("x.bucket", "rid", "n", "comp")


def _links_in_clusters(rows: DataFrame, sets: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Forest of the confirmed links in each cluster (cluster, rid, n, comp), from comparing rows outside its largest component with all of its rows."""
    sizes = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("cluster").agg(F.max_by(F.struct("comp", "s"), F.struct("m", "comp")).alias("big"), F.sum("s").alias("s"))
    sizes = sizes.select("cluster", F.col("big.comp").alias("top"), _parts(F.col("s"), TASK_SHINGLES).alias("c"), _parts(F.col("s") - F.col("big.s"), TASK_SHINGLES).alias("k"))
    tasks = _blocks(rows.join(scratch(sizes, "clusters"), "cluster"), "cluster").join(sets.select("rid", "shingles"), "rid").join(sigs.select("rid", "sig"), "rid")

    def run(group: pa.Table) -> pa.Table:
        probe = group["probe"].to_numpy()
        order = np.lexsort((group["rid"].to_numpy(), group["n"].to_numpy(), probe))
        group, probe = group.take(pa.array(order)), probe[order]
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        rid, n, comp = (group[c].to_numpy() for c in ("rid", "n", "comp"))
        lists = group["shingles"].combine_chunks()
        flat, at = lists.values.to_numpy().view(np.uint64), np.asarray(lists.offsets)  # in order as unsigned numbers
        forest, every = _Forest(), int((~probe).sum())
        for i in range(every, len(n)):
            for j in _alike(i, every, n, comp, sig, percent).tolist():
                if forest.top(int(comp[i])) != forest.top(int(comp[j])):
                    a, b = flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]]
                    both = int((a.take(np.searchsorted(a, b), mode="clip") == b).sum())
                    if both * 100 >= (n[i] + n[j] - both) * percent:
                        forest.join(int(comp[i]), int(comp[j]), (int(comp[i]), int(comp[j])))
        return forest.table()

    return tasks.groupBy("cluster", "ci", "ki").applyInArrow(run, "a long, b long").distinct()


class _Linking:
    """Confirms candidate pairs on full sets and keeps the components of what was confirmed."""

    def __init__(self, docs: DataFrame, own: str, text: str, width: int, percent: int, reps: DataFrame, sigs: DataFrame) -> None:
        self.source, self.reps, self.sigs, self.percent = (docs, own, text, width), reps, sigs, percent
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None

    def fetch(self, wanted: DataFrame) -> None:
        """Adds the full sets of the rows that have none yet."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("rid"), "rid", "left_anti")
        wanted = scratch(wanted, "wanted")
        if self.sets is None or not wanted.isEmpty():
            more = scratch(_sets(*self.source, self.reps, wanted), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)

    def add(self, links: DataFrame) -> None:
        """Joins the components of linked rows or components."""
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = components(links)
        else:
            links = _relabel(_relabel(links, self.labels, "a"), self.labels, "b").filter(F.col("a") != F.col("b"))
            self.labels = scratch(_merge(self.labels, components(links)), "labels")

    def stars(self, pairs: DataFrame) -> None:
        likely = scratch(_agreement(scratch(pairs, "pairs"), self.sigs), "likely")
        self.fetch(likely.select(F.col("a").alias("rid")).unionByName(likely.select(F.col("b").alias("rid"))).distinct())
        self.add(scratch(_confirmed(likely, self.sets, self.percent), "links"))

    def rest(self, open_: DataFrame) -> None:
        """All pairs of the buckets (bucket, rid, n, comp) that are not in one component."""
        open_, buckets = self.unsettled(open_)
        many = buckets.filter(F.col("others") > CROWD)
        if not many.isEmpty():
            crowd = scratch(open_.join(many.select("bucket"), "bucket", "left_semi").select("rid", "n", "comp").distinct(), "crowd_rows")
            self.fetch(crowd.select("rid"))
            dealt = scratch(_by_rare_shingles(crowd, self.sets, self.percent), "dealt")
            self.compare(*self.unsettled(dealt))
        self.compare(open_, buckets.filter(F.col("others") <= CROWD))

    def unsettled(self, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows under their present components, and the buckets with more than one: its largest one, and how many rows lie outside."""
        open_ = scratch(self.relabelled(open_), "open")
        sizes = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
        buckets = sizes.groupBy("bucket").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("comp", F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
        return open_, scratch(buckets.filter(F.col("comps") > 1).withColumn("others", F.col("all") - F.col("most")), "unsettled")

    def compare(self, open_: DataFrame, buckets: DataFrame) -> None:
        forest = scratch(_look_alikes(open_, buckets, self.sigs, self.percent), "forest")
        if forest.isEmpty():
            return
        clusters = components(forest).select(F.col("v").alias("comp"), F.col("label").alias("cluster"))
        rows = self.relabelled(self.reps.select("rid", "n", F.col("rid").alias("comp"))).join(clusters, "comp")
        rows = scratch(rows.select("cluster", "rid", "n", "comp"), "cluster_rows")
        self.fetch(rows.select("rid"))
        self.add(scratch(_links_in_clusters(rows, self.sets, self.sigs, self.percent), "links"))

    def relabelled(self, df: DataFrame) -> DataFrame:
        return df if self.labels is None else _relabel(df, self.labels, "comp")


def _grouped(docs: DataFrame, own: str, key: str, text: str, width: int, percent: int) -> DataFrame:
    """own, k, n, and ``least`` (no key last, key, row id) of the row's component, null for a component of one."""
    rows = _described(docs, own, key, text, width, percent)
    nodes = _classes(rows)
    reps = nodes.filter((F.col("rid") == F.col("node")) & (F.col("n") > 0))
    banded = rows.filter(F.size("bands") > 0).join(reps.select("rid"), "rid", "left_semi")
    buckets = banded.select("rid", "n", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("bucket")
    members = scratch(buckets.join(scratch(full, "full"), "bucket"), "members")
    sigs = scratch(banded.join(members.select("rid").distinct(), "rid", "left_semi").select("rid", "n", "sig"), "signatures")
    step = _Linking(docs, own, text, width, percent, reps, sigs)
    open_ = members.select("bucket", "rid", "n", F.col("rid").alias("comp"))
    centres = open_.groupBy("bucket").agg(F.min_by(F.struct("rid", "n"), "rid").alias("c"))
    step.stars(_stars(open_, scratch(centres.select("bucket", F.col("c.rid").alias("c"), F.col("c.n").alias("cn"), F.col("c.rid").alias("cc")), "centres"), percent))
    step.rest(open_)
    step.add(scratch(_one_apart(rows, nodes, percent), "links"))
    out = nodes.withColumnRenamed("node", "comp")
    out = scratch(_relabel(out, step.labels, "comp") if step.labels is not None else out, "labelled")
    shared = out.groupBy("comp").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "own")).alias("least"), F.count(F.lit(1)).alias("m"))
    return out.join(scratch(shared.filter(F.col("m") > 1).drop("m"), "groups"), "comp", "left").select("own", "k", "n", "least")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of the documents linked by similar shingle sets.

    Returns key, ``n_shingles`` (set size), ``component_id`` (least key
    reachable) and ``kept`` (the key is the component's), one row per input row.

    Words are runs of characters other than ASCII white space, with A-Z in
    lower case. Null and empty texts have no shingle and link with nothing. A
    null key is no component's id unless all its keys are null. Rows that
    repeat a key are nodes of their own; all those that repeat the component's
    key are ``kept`` here, while ``drop_near`` keeps one row. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows, own = identified(docs)
    out = _grouped(rows, own, key, text, width, percent)
    least = F.when(F.col("least").isNull(), F.col("k")).otherwise(F.col("least.k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("k").eqNullSafe(least).alias("kept"))


def _relabel(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The column's vertices replaced by their labels, where they have one."""
    known = labels.select(F.col("v").alias("__v"), F.col("label").alias("__label"))
    joined = df.join(known, F.col(column) == F.col("__v"), "left")
    return joined.withColumn(column, F.coalesce("__label", column)).drop("__v", "__label")


def _merge(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after components were merged, given the labels of the components that were."""
    fresh = merged.join(labels, "v", "left_anti")
    return _relabel(labels, merged, "label").unionByName(fresh)


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: that with the least key, any one of them if rows repeat it. Rows go by row, not by key."""
    rows, own = identified(docs)
    out = _grouped(rows, own, key, text, width, percent)
    return without(rows, own, out.filter(F.col("least").isNotNull() & (F.col("least.own") != F.col("own"))).select("own"))
