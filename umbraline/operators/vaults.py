"""Vaults as stored tables, laid out for restoring and for disposal.

A table is partitioned by a hash of the session, so that disposing of sessions
rewrites or drops their partitions only, and bucketed by session and token, so
that restoring joins it where it lies: matches move to the vault, and the vault
does not move. Its buckets should be as many as the shuffle partitions of the
jobs that read it, or more; with fewer, Spark deals the vault anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mask import merge_vaults

COLUMNS = ("session_id", "token", "label", "category", "text", "canonical_text", "hash", "synthetic_value", "uses")


def session_key(session: Column) -> Column:
    """The session as a key that is never null, so that plain equality joins it."""
    return F.when(session.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), session.cast("string")))


@dataclass(frozen=True)
class VaultTable:
    """A vault stored as a table of the session's catalog."""

    spark: SparkSession
    name: str
    partitions: int = 64
    buckets: int = 64

    def _laid_out(self, vault: DataFrame) -> DataFrame:
        key = session_key(F.col("session_id"))
        part = F.pmod(F.xxhash64(key), F.lit(self.partitions)).cast("int")
        return vault.select(*COLUMNS, key.alias("session_key"), part.alias("part"))

    def _saved(self, rows: DataFrame, name: str, mode: str = "errorifexists") -> None:
        # dealt by bucket first, as each task writes a file for each partition and bucket it holds
        dealt = rows.repartition(self.buckets, "session_key", "token")
        dealt.write.mode(mode).format("parquet").partitionBy("part").bucketBy(self.buckets, "session_key", "token").sortBy("session_key", "token").saveAsTable(name)

    def create(self, vault: DataFrame) -> None:
        """Stores a vault (``build_vault``) as a new table."""
        self._saved(self._laid_out(vault), self.name)

    def entries(self) -> DataFrame:
        """The vault, with ``session_key``, by which ``restore`` joins it in place."""
        return self.spark.table(self.name)

    def add(self, vault: DataFrame) -> None:
        """Adds entries that the table does not hold yet; of those it holds, the stored text stays."""
        new = self._laid_out(vault).join(self.entries().select("session_key", "token"), ["session_key", "token"], "left_anti")
        self._put(new.select(*self.entries().columns), overwrite=False)

    def dispose(self, sessions: Iterable[str | None]) -> None:
        """Removes the sessions' entries, and their files: other sessions of their partitions are written anew, partitions without any are dropped."""
        gone = self.spark.createDataFrame([(s,) for s in sessions], "session_id string").select(session_key(F.col("session_id")).alias("session_key")).distinct()
        parts = [r.part for r in gone.select(F.pmod(F.xxhash64("session_key"), F.lit(self.partitions)).cast("int").alias("part")).distinct().collect()]
        if not parts:
            return
        touched = self.entries().filter(F.col("part").isin(parts))
        kept = touched.join(gone, "session_key", "left_anti").select(*touched.columns)
        held = [r.part for r in kept.select("part").distinct().collect()]
        if held:
            self._put(kept, overwrite=True)
        for part in set(parts) - set(held):
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = {part})")

    def clear(self) -> None:
        """Removes all entries and the table."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _put(self, rows: DataFrame, overwrite: bool) -> None:
        """Writes rows into their partitions. They are staged in a table of their own first, as a table cannot be read while it is written."""
        staged = f"{self.name}_{uuid.uuid4().hex}"
        self._saved(rows, staged)
        # the setting holds for one write; a session without it has Spark's default
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            put = self.spark.table(staged).select(*self.entries().columns).repartition(self.buckets, "session_key", "token")
            put.write.insertInto(self.name, overwrite=overwrite)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
            self.spark.sql(f"DROP TABLE IF EXISTS {staged}")

    def merged(self, vault: DataFrame) -> DataFrame:
        """The stored entries and those of another vault, without writing any."""
        return merge_vaults(self.entries().select(*COLUMNS), vault.select(*COLUMNS))
