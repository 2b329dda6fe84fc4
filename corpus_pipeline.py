"""The documents' way through language ID, exact and near deduplication, mixing, and piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

Clashing or extra columns pass through all stages but the last. Empty tables
give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraline.llm import exact_dedup, langid, mixing, near_dedup, pieces
from umbraline.llm.common import crc_mod, passing, remove_at_exit, scratch_dir
from umbraline.llm.queries import TOKENIZER

#: Of crc32(doc_id) mod 4, the remainder whose rows the language model does not learn from.
HELD_OUT = 2
#: Text that a task encodes at once; small, as idle workers of the stages before share the executor's memory.
SLICE_BYTES = 400_000
#: Language ID rejects texts of so many bytes of letters or more: those whose disorder is so large, gibberish in every language,
#: and those whose label another language contradicts with such a score.
MIN_LETTERS = 100
MAX_DISORDER = 0.85
CONTRADICTION = 0.2
#: A labelled language speaks for its texts' order if so many bytes of it were learned; less orders hardly any text.
MIN_LEARNED = 8_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. ``lang`` keeps its label, or gets the prediction where it has none.

    Those without text or without a letter go, as do gibberish and texts whose
    label the prediction contradicts with confidence. A label that was not
    learned (or, for gibberish, hardly) cannot be judged and stays.
    """
    model = langid.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != HELD_OUT))
    own = [f"c{i}" for i in range(len(docs.columns))]  # any names, clashing with the prediction's or not
    rows = docs.toDF(*own)
    at = {c: n for c, n in zip(docs.columns, own, strict=True)}
    found = langid.identify(rows, model, at["doc_id"], at["text"], keep=[c for c in own if c != at["doc_id"]])
    found = found.filter(F.col("lang_pred") != langid.UNDETERMINED)
    learned = model.sizes if model else {}
    sure = [x for x, size in learned.items() if size >= MIN_LEARNED]
    label = F.col(at["lang"])
    gibberish = (F.col("disorder") >= MAX_DISORDER) & (label.isin(sure) | (label.isNull() & F.lit(bool(sure))))
    contradicted = label.isin(list(learned)) & (F.col("lang_pred") != label) & (F.col("score") >= CONTRADICTION)
    found = found.filter(~F.coalesce((F.col("n_letters") >= MIN_LETTERS) & (gibberish | contradicted), F.lit(False)))
    found = found.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; those that it takes twice are there twice."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document: doc_id, lang, source, n_pieces, ids, and whether decoding gives the text back."""
    got = pieces.encode(docs, public_tokenizers.path(TOKENIZER), keep=["lang", "source"], size=SLICE_BYTES)
    return got.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids", "lossless")


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("pieces", encode)]

#: Language ID, MinHash candidates and sampled segmentations are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage wrote on its way goes at its end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with passing(spark):
            done = stage(spark, docs, sf_dir)
            path = f"{scratch_dir(spark)}/{name.replace(' ', '_')}"
            done.write.parquet(path)
        docs = spark.read.parquet(path)
        remove_at_exit(spark, path)
    return docs
