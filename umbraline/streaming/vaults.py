"""Vaults that a stream of masked rows builds as keyed state.

A session's entries are map state, so an access reads and writes one entry, not
the vault. A token whose canonical text differs from the stored one is refused
(``clash``), as is a new one in a full session (``full``); both are told, none
is stored. A session without a row for the time to live is told as ``expired``
and forgotten, by a timer of processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import tokens as T
from ..operators.mask import VAULT_HARD_CAP

ENTRIES = "session_id string, token string, label string, text string, canonical_text string, uses long, status string"
POOL = "pool_id string, session_id string, status string"
MINTED, SEEN, CLASH, FULL, EXPIRED = "minted", "seen", "clash", "full", "expired"
LIVE, EVICTED = "live", "evicted"


class _Idle(StatefulProcessor):
    """Keeps one timer for each key, moved on with every batch of its rows."""

    ttl_ms: int

    def _stay(self, timer_values) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def close(self) -> None:
        return None


class VaultProcessor(_Idle):
    """Mints a session's entries from its tokens in the order of rows and places; its entries and their number are the state."""

    def __init__(self, cap: int = VAULT_HARD_CAP, ttl_ms: int = 3_600_000) -> None:
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "token string", "label string, text string, canonical_text string, uses long")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size = int(self.size.get()[0]) if self.size.exists() else 0
        told: dict[tuple[str, str], tuple] = {}
        for r in pd.concat(list(rows)).sort_values(["seq", "start"], kind="stable").itertuples():
            held = self.entries.getValue((r.token,)) if self.entries.containsKey((r.token,)) else None
            if held is None and size >= self.cap:
                told[r.token, FULL] = (key[0], r.token, r.label, r.text, r.canonical_text, 0, FULL)
                continue
            if held is not None and held[2] != r.canonical_text:
                told[r.token, CLASH] = (key[0], r.token, r.label, r.text, r.canonical_text, 0, CLASH)
                continue
            size += held is None
            entry = (r.label, r.text, r.canonical_text, 1) if held is None else (*held[:3], int(held[3]) + 1)
            self.entries.updateValue((r.token,), entry)
            new = held is None or told.get((r.token, ""), (SEEN,))[-1] == MINTED
            told[r.token, ""] = (key[0], r.token, *entry, MINTED if new else SEEN)
        self.size.update((size,))
        self._stay(timerValues)
        yield pd.DataFrame(list(told.values()), columns=[c.split()[0] for c in ENTRIES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        uses = int(self.size.get()[0]) if self.size.exists() else 0
        self.entries.clear()
        self.size.clear()
        yield pd.DataFrame([(key[0], None, None, None, None, uses, EXPIRED)], columns=[c.split()[0] for c in ENTRIES.split(", ")])


def stream_vault(masked: DataFrame, session: str = "session_id", seq: str = "seq", tokens: str = "tokens", cap: int = VAULT_HARD_CAP, ttl_ms: int = 3_600_000) -> DataFrame:
    """Streaming table of vault entries from a stream of masked rows (``mask``).

    Each batch gives a row for every token it used: the entry as it is now
    (``minted`` or ``seen``, with all its uses), or why it was refused. Of an
    expired session there is one row without a token, whose ``uses`` are the
    entries it had. Rows of a null session belong to one session.
    """
    each = masked.select(F.col(session).cast("string").alias("session_id"), F.col(seq).cast("long").alias("seq"), F.explode(tokens).alias("t"))
    label = F.regexp_extract("t.token", f"^{T.STRICT}$", 1)
    rows = each.select("session_id", "seq", F.col("t.start").alias("start"), "t.token", label.alias("label"), "t.text", T.canonical(F.col("t.text")).alias("canonical_text"))
    return rows.groupBy("session_id").transformWithStateInPandas(VaultProcessor(cap, ttl_ms), outputStructType=ENTRIES, outputMode="Update", timeMode="ProcessingTime")


class PoolProcessor(_Idle):
    """The sessions of a pool with the order of their last use; the least recently used ones beyond ``most`` are evicted."""

    def __init__(self, most: int = 100, ttl_ms: int = 3_600_000) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "session_id string", "turn long")
        self.turn = handle.getValueState("turn", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, out = int(self.turn.get()[0]) if self.turn.exists() else 0, []
        held = {k[0]: int(v[0]) for k, v in self.used.iterator()}  # ``most`` of them
        for session in pd.concat(list(rows)).sort_values("seq", kind="stable")["session_id"]:
            turn += 1
            if session not in held:
                out.append((key[0], session, LIVE))
            held[session] = turn
            self.used.updateValue((session,), (turn,))
            if len(held) > self.most:
                oldest = min(held, key=held.__getitem__)
                del held[oldest]
                self.used.removeKey((oldest,))
                out.append((key[0], oldest, EVICTED))
        self.turn.update((turn,))
        self._stay(timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POOL.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(key[0], k[0], EXPIRED) for k, _ in self.used.iterator()]
        self.used.clear()
        self.turn.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POOL.split(", ")])


def stream_pool(accesses: DataFrame, most: int = 100, ttl_ms: int = 3_600_000) -> DataFrame:
    """Streaming table of a pool's sessions (from rows with pool_id, session_id, seq): live when first used, evicted beyond ``most``, expired with an idle pool."""
    rows = accesses.select("pool_id", F.coalesce("session_id", F.lit("")).alias("session_id"), "seq")
    return rows.groupBy("pool_id").transformWithStateInPandas(PoolProcessor(most, ttl_ms), outputStructType=POOL, outputMode="Update", timeMode="ProcessingTime")
