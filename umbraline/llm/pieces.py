"""Sampled SentencePiece segmentations, and lossless decoding.

Each text is cut into pre-tokens that no vocabulary piece crosses. For each
distinct pre-token of a batch the piece lattice is filtered forward (total
weight of all segmentations of each prefix); each occurrence is then sampled
backward from its end, an edge at a time, so a segmentation is drawn with its
exact probability under the pieces' weights. Draws come from a counter-based
generator seeded by the row's key, the word's number and the step, so they do
not depend on batches, partitions or task order.

The vocabulary's scores are merge ranks. A piece of rank r weighs
1 / (r + SHIFT) to the power ``alpha``, after Zipf's law; a larger alpha
prefers frequent pieces, and so segmentations with fewer of them, more strongly.

Decoding is lossless for every text: characters outside the vocabulary, and a
literal space mark, are written as byte pieces.

Scale: map-only, in slices of bounded text; a worker holds one slice's lattices.
A pre-token's lattice is linear in its length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

MARK = "▁"
ALPHA = 1.5
SHIFT = 2.7
SEED = 11
#: Text that is segmented at once, unless one text alone is longer.
SLICE_BYTES = 1_500_000
#: Bits of the probabilities.
BITS = 36
_SPLIT = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Vocabulary:
    """Pieces of a SentencePiece model with their weights."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        first = min(normal)
        self.pieces = {model.id_to_piece(i): (i, -alpha * math.log(i - first + SHIFT)) for i in normal}
        self.byte_weight = -alpha * math.log(self.size + SHIFT)
        self._index()
        texts = [b""] * self.size
        for p, (i, _) in self.pieces.items():
            texts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            texts[i] = bytes([b])
        self.texts = texts

    def _index(self) -> None:
        """The pieces as a trie: sorted (node, character) keys, their children, and each node's piece."""
        moves: dict[tuple[int, int], int] = {}
        piece, weight = [-1], [0.0]
        for text, (i, w) in self.pieces.items():
            node = 0
            for c in text:
                node = moves.setdefault((node, ord(c)), len(piece))
                if node == len(piece):
                    piece.append(-1)
                    weight.append(0.0)
            piece[node], weight[node] = i, w
        keys = np.fromiter((n << 21 | c for n, c in moves), dtype=np.int64, count=len(moves))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.fromiter(moves.values(), dtype=np.int64, count=len(moves))[order]
        self.piece_of, self.weight_of = np.array(piece, dtype=np.int32), np.array(weight)


class Lattices:
    """Piece lattices of many pre-tokens, filtered forward.

    Nodes are the places between characters, numbered through all pre-tokens;
    ``end`` and ``root`` hold each pre-token's last and first node. Edges are in
    order of the node they end at; ``key`` is that node and, in ``BITS`` bits
    below, the summed probability of the edges before, ``back`` where the edge
    starts, ``piece`` its id, or the vocabulary's size plus the code point of a
    character without a piece. Probabilities are whole numbers, so that sums
    do not depend on what else the slice holds.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]) -> None:
        shown = [w if w[:1] == "\n" else " " + w for w in words]
        real = np.frombuffer("".join(shown).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        # spaces become marks; a mark that the text itself holds is hidden from the pieces
        char = np.where(real == 0x20, ord(MARK), np.where(real == ord(MARK), 0, real))
        n = np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))
        word = np.repeat(np.arange(len(n)), n)
        self.end = np.cumsum(n + 1) - 1
        self.root = self.end - n
        node = np.arange(len(char)) + word  # where each character starts
        left = np.repeat(np.cumsum(n), n) - np.arange(len(char))  # characters up to the word's end
        starts, stops, ids, weights = [], [], [], []
        at, state, size = np.arange(len(char)), np.zeros(len(char), dtype=np.int64), 0
        single = np.zeros(len(char), dtype=bool)
        while len(at):
            wanted = state << 21 | char[at + size]
            place = np.minimum(np.searchsorted(vocabulary.keys, wanted), len(vocabulary.keys) - 1)
            on = vocabulary.keys[place] == wanted
            at, state = at[on], vocabulary.children[place[on]]
            size += 1
            ends = vocabulary.piece_of[state] >= 0
            starts.append(node[at[ends]])
            stops.append(node[at[ends]] + size)
            ids.append(vocabulary.piece_of[state[ends]])
            weights.append(vocabulary.weight_of[state[ends]])
            if size == 1:
                single[at[ends]] = True
            more = left[at] > size
            at, state = at[more], state[more]
        lone = np.flatnonzero(~single)
        starts.append(node[lone])
        stops.append(node[lone] + 1)
        ids.append((vocabulary.size + real[lone]).astype(np.int32))
        weights.append(np.full(len(lone), vocabulary.byte_weight))
        start, stop, piece, weight = map(np.concatenate, (starts, stops, ids, weights))
        order = np.argsort(stop, kind="stable")
        start, stop, piece, weight = start[order], stop[order], piece[order], weight[order]
        self.key, self.back, self.piece = (stop << BITS) + self._filter(start, stop, weight, n), start, piece

    def _filter(self, start: np.ndarray, stop: np.ndarray, weight: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Forward filter; returns, for each edge, the summed probability of the edges before it at its end."""
        total = np.zeros(int(self.end[-1]) + 1)
        depth = np.arange(len(total)) - np.repeat(self.root, n + 1)
        by_depth = np.argsort(depth[stop], kind="stable")  # all edges' starts lie at lower depths than their ends
        value = np.empty(len(stop))
        cuts = np.searchsorted(depth[stop][by_depth], np.arange(1, int(n.max()) + 2))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_depth[a:z]
            to = stop[e]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            w = total[start[e]] + weight[e]
            top = np.maximum.reduceat(w, first)
            size = np.diff(np.append(first, len(e)))
            z_ = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, size)), first))
            total[to[first]] = z_
            value[e] = np.exp(w - np.repeat(z_, size))
        value = np.rint(value * (1 << BITS)).astype(np.int64)
        before = np.cumsum(value) - value
        first = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))
        before -= np.repeat(before[first], np.diff(np.append(first, len(stop))))
        return np.minimum(before, (1 << BITS) - 1)


class Sampler:
    """Batched backward sampling."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED) -> None:
        self.vocabulary, self.seed = vocabulary, seed

    def segment(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, given 64-bit hashes of the rows' keys."""
        words = [_SPLIT.findall(" " + t) if t else [] for t in texts]
        count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not count.sum():
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        flat = pa.array([w[1:] if w[0] == " " else w for ws in words for w in ws], pa.large_string()).dictionary_encode()
        del words
        lattices = Lattices(self.vocabulary, flat.dictionary.to_pylist())
        code = np.asarray(flat.indices)
        node, root = lattices.end[code], lattices.root[code]
        nth = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
        state = _mix(np.repeat(keys.astype(np.uint64), count) + np.uint64(self.seed) + _mix(nth.astype(np.uint64) + np.uint64(1)))
        # in the order of the lattices, so that searches for neighbouring nodes touch the same memory
        live, steps = np.argsort(code, kind="stable"), []
        node, root, state = node[live], root[live], state[live]
        length = np.zeros(len(code), dtype=np.int64)
        while len(live):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            u = (_mix(state) >> np.uint64(64 - BITS)).astype(np.int64)
            edge = np.searchsorted(lattices.key, (node << BITS) + u, side="right") - 1
            steps.append((live, lattices.piece[edge]))
            length[live] += 1
            node = lattices.back[edge]
            on = node != root
            live, node, root, state = live[on], node[on], root[on], state[on]
        stop = np.cumsum(length)
        out = np.empty(int(stop[-1]), dtype=np.int32)
        for step, (at, p) in enumerate(steps):
            out[stop[at] - 1 - step] = p
        bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
        size = self.vocabulary.size
        parts = [out[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        if (out >= size).any():
            parts = [self._as_bytes(x) if (x >= size).any() else x for x in parts]
        return parts

    def _as_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Byte pieces in place of the characters that have no piece."""
        size, byte_ids, out, last = self.vocabulary.size, self.vocabulary.byte_ids, [], 0
        for i in np.flatnonzero(ids >= size):
            out += [ids[last:i], np.array([byte_ids[b] for b in chr(int(ids[i]) - size).encode("utf-8")], dtype=np.int32)]
            last = i + 1
        return np.concatenate([*out, ids[last:]])


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Text of piece ids; the space mark put before the text is taken off again."""
    return b"".join(map(vocabulary.texts.__getitem__, ids))[1:].decode("utf-8")


_LOADED: dict = {}


def load(path: str, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary of a model file, one per worker."""
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Vocabulary(path, alpha)
    return _LOADED[path, alpha]


def _coded(docs: DataFrame, path: str, key: str, text: str, alpha: float, seed: int, keep: Sequence[str], fields: str, emit, size: int) -> DataFrame:
    """Key, the columns to keep, and what ``emit`` makes of the vocabulary, texts and ids of a slice of rows."""
    kept = {f"c{i}": c for i, c in enumerate([key, *keep])}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in kept.items()], F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
    rows = rows.withColumn("h", F.xxhash64("c0"))
    names = [f.split()[0] for f in fields.split(", ")]
    at = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path, alpha)
        sampler = Sampler(vocabulary, seed)
        for batch in (part for whole in batches for part in slices(whole, at, size)):
            texts, hashes = batch.column(at).to_pylist(), np.asarray(batch.column(at + 1)).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                ids = sampler.segment([t or "" for t in texts], hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *emit(vocabulary, texts, ids)], [*kept, *names])
        release()

    out = rows.mapInArrow(run, f"{schema}, {fields}")
    return out.select(*[F.col(n).alias(c) for n, c in kept.items()], *names)


def _same(vocabulary: Vocabulary, texts: list[str | None], ids: list[np.ndarray]) -> pa.Array:
    return pa.array([t is None or join(vocabulary, x.tolist()) == t for t, x in zip(texts, ids, strict=True)])


def _lists(texts: list[str | None], ids: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in texts]))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = SEED, keep: Sequence[str] = (), size: int = SLICE_BYTES) -> DataFrame:
    """Key, the columns to keep, ``ids`` (piece ids of a sampled segmentation) and ``lossless`` (they decode to the text).

    Equal keys and texts get equal segmentations, in every run. A null text has
    null ids, an empty one none. A null key counts as one more key. Other
    columns are left out, whatever their names.
    """
    return _coded(docs, path, key, text, alpha, seed, keep, "ids array<int>, lossless boolean", lambda v, t, x: [_lists(t, x), _same(v, t, x)], size)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids give null. A column named as ``out`` is replaced."""
    kept = [c for c in coded.columns if c != out]
    names = [f"c{i}" for i in range(len(kept))]
    at = kept.index(ids)
    rows = coded.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            column = batch.column(at)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            texts = [join(vocabulary, flat[a:z].tolist()) if ok else None for a, z, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    got = rows.mapInArrow(run, f"{schema}, decoded string")
    return got.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("decoded").alias(out))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Digest of encoding and decoding: key, ``n_pieces``, ``ids_crc32`` (of the ids as 32-bit little-endian integers), and ``lossless``."""

    def digest(vocabulary: Vocabulary, texts: list[str | None], ids: list[np.ndarray]) -> list[pa.Array]:
        n, crc = pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64())
        return [n, crc, _same(vocabulary, texts, ids)]

    return _coded(docs, path, key, text, alpha, seed, (), "n_pieces long, ids_crc32 long, lossless boolean", digest, SLICE_BYTES)
