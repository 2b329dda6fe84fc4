"""Functions for whole tables, named as the tools that the engine stands in for: sanitize, desanitize, analyze, detect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import mask as M
from .operators.detect import Strategy
from .operators.restore import RestoreOptions, restore


def sanitize(df: DataFrame, options: M.MaskOptions, session: str, order: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Masked rows and the vault of their sessions; texts of a session share one vault."""
    done = M.mask(df, options, text)
    return done.withColumn("token_count", F.size("tokens")), M.build_vault(done, session, order)


def desanitize(df: DataFrame, vault: DataFrame, secret: str, key: str, session: str, text: str = "text") -> DataFrame:
    """Restored rows; misses count as tokens that no model made up."""
    return restore(df, vault, secret, key, text, session, RestoreOptions(origin="tool"))


def analyze(df: DataFrame, text: str = "text", strategy: Strategy | None = None) -> DataFrame:
    """Adds ``spans`` without the texts they cover."""
    return df.withColumn("spans", M.analyze(F.col(text), strategy))


def detect_json(df: DataFrame, options: M.MaskOptions, text: str = "text") -> DataFrame:
    """One JSON text for each row: masked text and tokens."""
    done = M.mask(df, options, text)
    return done.select(F.to_json(F.struct(F.col("masked").alias("masked"), F.col("tokens").alias("tokens"))).alias("json"))
