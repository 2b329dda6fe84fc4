"""Regions of images to black out, from recognised words and the spans in their text.

Recognition needs a library that is not part of the engine; the table algebra
after it is here, and black boxes in PNG images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a page at which words and spans are cut for their join.
STRETCH = 128
WORD = "image_id string, line_index int, word_index int, text string, left int, top int, width int, height int, confidence double"


def page_text(words: DataFrame) -> DataFrame:
    """Each image's words joined by spaces, lines by line feeds, and each word's offsets in it: image_id, text, words."""
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "word_index", F.col("text").alias("t"), "left", "top", "width", "height", "confidence")))
    pages = words.groupBy("image_id").agg(ordered.alias("ws"))
    glue = lambda w, i: F.when(i == 0, "").when(F.get(F.col("ws"), i - 1)["line_index"] != w["line_index"], "\n").otherwise(" ")
    pages = pages.withColumn("parts", F.transform("ws", lambda w, i: F.concat(glue(w, i), w["t"])))
    return pages.withColumn("text", F.array_join("parts", ""))


def word_offsets(words: DataFrame) -> DataFrame:
    """Words with start and end in their image's text."""
    order = Window.partitionBy("image_id").orderBy("line_index", "word_index")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("start", before.cast("int")).withColumn("end", (before + F.length("text")).cast("int"))


def _stretches(start: str, end: str) -> Column:
    """The stretches of ``STRETCH`` characters that an interval touches, as rows."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    return F.explode(F.sequence(F.floor(F.col(start) / STRETCH), F.floor(last / STRETCH)))


def covered_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Each word with each span of its image that covers a part of it, once.

    Both are cut at stretches of the text and joined by image and stretch; a
    pair that shares several of them is kept in the first. Work is linear in
    words, spans and pairs, and one large image is spread over many tasks.
    """
    w = word_offsets(words).withColumnsRenamed({"start": "w_start", "end": "w_end"}).withColumn("__at", _stretches("w_start", "w_end"))
    s = spans.withColumn("__at", _stretches("start", "end"))
    met = s.join(w, ["image_id", "__at"]).filter((F.col("w_end") > F.col("start")) & (F.col("w_start") < F.col("end")))
    return met.filter(F.col("__at") == F.floor(F.greatest("start", "w_start") / STRETCH)).drop("__at")


def regions(words: DataFrame, spans: DataFrame, padding: int = 0) -> DataFrame:
    """Box of each span (image_id, span_id, start, end, category) on each line it covers."""
    met = covered_words(words, spans)
    box = met.groupBy("image_id", "span_id", "category", "line_index").agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom")
    )
    return box.select(
        "image_id", "span_id", "category", "line_index", (F.col("left") - padding).alias("left"), (F.col("top") - padding).alias("top"),
        (F.col("right") + padding).alias("right"), (F.col("bottom") + padding).alias("bottom"),
    )


def by_confidence(words: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Words that recognition is sure of, and the others."""
    return words.filter(F.col("confidence") >= threshold), words.filter(F.col("confidence") < threshold)


def decision(uncertain: DataFrame, policy: str) -> DataFrame:
    """What becomes of images with uncertain words: their words are masked, a warning is given, or the image is blocked."""
    if policy not in ("mask", "warn", "block"):
        raise ValueError(f"unknown policy: {policy}")
    return uncertain.groupBy("image_id").agg(F.count(F.lit(1)).alias("uncertain_words")).withColumn("decision", F.lit(policy))


_PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by colour type, for 8 bits a channel: grey, colour, palette, grey and colour with opacity.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_PNG)
    while at + 8 <= len(content):
        (size,) = struct.unpack(">I", content[at : at + 4])
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        at += 12 + size


def _pixels(raw: bytes, width: int, height: int, step: int) -> np.ndarray:
    """Rows of bytes without the filters of the format, each of which adds what lies to the left, above, or both."""
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 1:
            own = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own = line + above
        elif kind in (3, 4):
            own = np.array(line)
            for x in range(width):
                a = own[(x - 1) * step : x * step].astype(np.int16) if x else np.zeros(step, np.int16)
                b = above[x * step : (x + 1) * step].astype(np.int16)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[(x - 1) * step : x * step].astype(np.int16) if x else np.zeros(step, np.int16)
                    p = a + b - c
                    near = np.abs(np.stack([p - a, p - b, p - c])).argmin(axis=0)
                    guess = np.choose(near, [a, b, c])
                own[x * step : (x + 1) * step] = (own[x * step : (x + 1) * step].astype(np.int16) + guess) % 256
        else:
            own = line
        out[y] = above = own
    return out


def blacken(content: bytes, boxes: Sequence[Sequence[int]]) -> bytes:
    """The PNG image with black boxes (left, top, right, bottom), cut to its size; text and other notes in the file are left out.

    Images of 8 bits a channel that are not interlaced can be drawn on; others raise.
    """
    if not content.startswith(_PNG):
        raise ValueError("not a PNG image")
    parts = list(_chunks(content))
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError("only images of 8 bits a channel, not interlaced")
    step = _CHANNELS[colour]
    grid = _pixels(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), width, height, step).reshape(height, width, step)
    palette = next((d for k, d in parts if k == b"PLTE"), b"")
    black = np.zeros(step, dtype=np.uint8)
    if colour == 3:  # a palette may lack black; its last entry is then made black, if it is free
        entries = [palette[i : i + 3] for i in range(0, len(palette), 3)]
        if b"\0\0\0" not in entries:
            if len(entries) == 256:
                raise ValueError("the palette is full and has no black")
            entries.append(b"\0\0\0")
            palette = b"".join(entries)
        black[0] = entries.index(b"\0\0\0")
    elif colour in (4, 6):
        black[-1] = 255
    for left, top, right, bottom in boxes:
        grid[max(0, top) : max(0, bottom), max(0, left) : max(0, right)] = black
    lines = np.concatenate([np.zeros((height, 1), np.uint8), grid.reshape(height, -1)], axis=1)
    out = [(b"IHDR", parts[0][1]), *([(b"PLTE", palette)] if palette else []), *[(k, d) for k, d in parts if k == b"tRNS"], (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
    return _PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in out)


def redact_images(files: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images (image_id, content) with ``redacted``, their black boxes drawn; ``error`` has the reason where that cannot be done.

    Such an image has null ``redacted``, so that it never passes as it was. An
    image without boxes is written anew too, without its notes.
    """
    own = boxes.groupBy(F.col("image_id").alias("__i")).agg(F.collect_list(F.array("left", "top", "right", "bottom").cast("array<int>")).alias("boxes"))
    rows = files.join(own, F.col("image_id") == F.col("__i"), "left").select("image_id", "content", "boxes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out.append((r.image_id, blacken(bytes(r.content), [] if r.boxes is None else r.boxes), None))
                except Exception as e:  # noqa: BLE001  one image must not stop the others
                    out.append((r.image_id, None, str(e)))
            yield pd.DataFrame(out, columns=["image_id", "redacted", "error"])

    return rows.mapInPandas(run, "image_id string, redacted binary, error string")
