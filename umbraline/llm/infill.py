"""Fill-in-the-middle transformation of whole texts.

A text is cut into units: runs of ASCII letters, and every other code point by
itself. Where the units begin is one big integer with a bit for each byte of the
text: ``bytes.translate`` marks the classes, one shift and two boolean
operations leave the boundaries, ``bit_count`` gives their number, and the k-th
one is found by halving the integer. Nothing is built for each unit, so memory
is the text and an eighth of it.

Two cuts, drawn from a hash of the key, part the units into prefix, middle and
suffix, which are put in another order behind marks: ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle). A share of the texts, and those that
are empty or hold a mark, stay plain.

Null text counts as empty, a null key as the empty string. Equal rows give equal
results; rows with one key share their draws. Columns of any name pass through
``keep``. Work is map-only: no shuffle, and no state beyond a slice of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Text that is worked on at once.
SLICE_BYTES = 1 << 20

_LETTERS = bytes(b"01"[chr(b).isalpha() and b < 128] for b in range(256))
#: Bytes that go on with a code point.
_INNER = bytes(b"01"[b & 0xC0 == 0x80] for b in range(256))


@dataclass(frozen=True)
class Marks:
    """Texts put before prefix, suffix and middle. No end of one may be the beginning of another, so that the first one found is the right one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.all
        if not all(marks) or len(set(marks)) < len(marks):
            raise ValueError("marks must be three different texts")
        for a in marks:
            for b in marks:
                if (a != b and a in b) or any(b.startswith(a[i:]) for i in range(1, len(a))):
                    raise ValueError(f"marks overlap: {a!r}, {b!r}")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def mask_of(text: bytes, classes: bytes) -> int:
    """A bit for each byte, the first byte's lowest, set where the class table has a one."""
    return int(text[::-1].translate(classes), 2) if text else 0


def units(text: bytes) -> int:
    """The bits of the bytes at which units begin."""
    letters = mask_of(text, _LETTERS)
    return ((1 << len(text)) - 1) & ~(letters & (letters << 1)) & ~mask_of(text, _INNER)


def select(bits: int, k: int) -> int:
    """Place of the k-th set bit, from 0: the half that holds it is halved again, so that all halves together are twice the integer."""
    at, size = 0, bits.bit_length()
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, size = low, half
        else:
            bits, size, at, k = bits >> half, size - half, at + half, k - n
    return at


def _transform(text: bytes, draws: Sequence[int], marks: tuple[bytes, ...], plain_from: int, spm_below: int) -> tuple:
    starts = units(text)
    n = starts.bit_count()
    if not text or any(m in text for m in marks) or draws[2] % 100 >= plain_from:
        return n, PLAIN, None, None, text
    a, b = sorted(d % (n + 1) for d in draws[:2])
    ends = [select(starts, x) if x < n else len(text) for x in (a, b)]
    prefix, middle, suffix = text[: ends[0]], text[ends[0] : ends[1]], text[ends[1] :]
    first = mask_of(prefix, _INNER).bit_count()
    inner = mask_of(middle, _INNER).bit_count()
    sizes = len(prefix) - first, len(middle) - inner
    if draws[3] % 100 < spm_below:
        return n, SPM, *sizes, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle))
    return n, PSM, *sizes, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle))


def infill(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Iterable[str] = (), seed: int = 1, plain: int = 10, spm: int = 20, marks: Marks | None = None
) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output, and the columns of ``keep``.

    ``plain``: of 100 texts, how many stay as they are; ``spm``: of 100 others,
    how many put the suffix first. ``prefix_chars`` and ``middle_chars`` count
    code points; null for plain texts.
    """
    marks, keep = marks or Marks(), list(keep)
    encoded = tuple(m.encode() for m in marks.all)
    columns = docs.columns
    own = [f"c{i}" for i in range(len(columns))]  # any names, clashing with the result's or not
    rows = docs.toDF(*own)
    at = dict(zip(columns, own, strict=True))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(at[key]).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    chosen = [at[key], *[at[c] for c in keep]]
    rows = rows.select(F.coalesce(F.col(at[text]).cast("string"), F.lit("")).cast("binary").alias("text"), *draws, *chosen)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in chosen]
    out = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            drawn = np.stack([np.asarray(batch.column(1 + i)) for i in range(4)], axis=1).tolist() if batch.num_rows else []
            made = [_transform(t.as_py(), d, encoded, 100 - plain, spm) for t, d in zip(batch.column(0), drawn, strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else [()] * 5
            new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([*new, *batch.columns[5:]], [*out, *chosen])
        release()

    got = rows.mapInArrow(run, f"n long, form string, prefix_chars long, middle_chars long, output binary, {', '.join(kinds)}")
    result = [F.col(at[key]).alias(key), *[F.col("output").cast("string").alias(c) if c == "output" else F.col(c) for c in out]]
    return got.select(*result, *[F.col(at[c]).alias(c) for c in keep])


def restored(output: Column, form: Column, marks: Marks | None = None) -> Column:
    """The text that an output and its form were made of."""
    marks = marks or Marks()
    p, s, m = (re.escape(x) for x in marks.all)
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digest(infilled: DataFrame, key: str = "doc_id") -> DataFrame:
    """The results with hashes in the place of texts: ``output_sha256`` and, of what is rebuilt from output and form, ``restored_sha256``."""
    back = restored(F.col("output"), F.col("form"))
    hashes = [F.sha2(x, 256).alias(c) for c, x in (("output_sha256", F.col("output")), ("restored_sha256", back))]
    return infilled.select(key, "n", "form", "prefix_chars", "middle_chars", *hashes)
