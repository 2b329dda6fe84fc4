from __future__ import annotations

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from umbraline.operators import audit
from umbraline.operators import mask as M
from umbraline.operators import restore as R
from umbraline.operators.vaults import VaultTable
from umbraline.streaming import vaults as V

SECRET = "example-secret"


def docs(spark, n=60):
    rows = [(i, f"s{i % 7}" if i % 11 else None, f"write to u{i % 9}@ex.org, or  u{i % 13}@ex.org and 4242 4242 4242 4242") for i in range(n)]
    return spark.createDataFrame([*rows, (n, "s1", None), (n + 1, "s2", "nothing")], "seq long, session_id string, text string")


@pytest.fixture
def table(spark):
    made = VaultTable(spark, "vault_under_test", partitions=5, buckets=8)
    made.clear()
    yield made
    made.clear()


def files(spark, name):
    return {f for f in spark.table(name).inputFiles()}


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stored_vault_restores_without_moving(spark, table):
    masked = M.mask(docs(spark), M.MaskOptions(SECRET))
    vault = M.build_vault(masked, "session_id", "seq")
    table.create(vault)
    rows = masked.select("seq", "session_id", "masked")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R.restore(rows, table.entries(), SECRET, text="masked", options=R.RestoreOptions(repair=False))
        plan = got._jdf.queryExecution().executedPlan().toString()
        stored = [i for i, line in enumerate(plan.splitlines()) if "FileScan" in line and "vault_under_test" in line]
        lines = plan.splitlines()
        for at in stored:
            above = []
            depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
            for line in reversed(lines[:at]):
                d = len(line) - len(line.lstrip(" :+-"))
                if d < depth:
                    above.append(line)
                    depth = d
            until = next(i for i, x in enumerate(above) if "Join" in x)
            assert not any("Exchange" in x for x in above[:until])
        assert stored and sorted_rows(got.select("seq", "restored")) == sorted_rows(docs(spark).select("seq", "text"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = R.restore(rows, vault, SECRET, text="masked")
    assert sorted_rows(R.restore(rows, table.entries(), SECRET, text="masked")) == sorted_rows(plain)


def test_disposed_sessions_leave_the_disk(spark, table):
    vault = M.build_vault(M.mask(docs(spark), M.MaskOptions(SECRET)), "session_id", "seq")
    table.create(vault)
    before = files(spark, table.name)
    table.dispose(["s1", None, "unknown"])
    left = vault.filter("session_id is not null and session_id <> 's1'")
    assert sorted_rows(table.entries().select(*vault.columns)) == sorted_rows(left)
    raw = spark.read.parquet(*{f.rsplit("/", 2)[0] for f in files(spark, table.name)})
    assert raw.filter("session_id is null or session_id = 's1'").isEmpty()
    gone = before - files(spark, table.name)
    assert gone and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in gone)
    table.dispose([f"s{i}" for i in range(7)])
    assert table.entries().count() == 0 and not files(spark, table.name)
    table.dispose([])


def test_added_entries_do_not_replace(spark, table):
    vault = M.build_vault(M.mask(docs(spark, 20), M.MaskOptions(SECRET)), "session_id", "seq")
    table.create(vault)
    more = M.build_vault(M.mask(docs(spark, 60), M.MaskOptions(SECRET)), "session_id", "seq").withColumn("text", F.concat("text", F.lit("!")))
    table.add(more)
    got = table.entries().select(*vault.columns)
    want = vault.unionByName(more.join(vault, (more.session_id.eqNullSafe(vault.session_id)) & (more.token == vault.token), "left_anti"))
    assert sorted_rows(got) == sorted_rows(want)


def run(spark, tmp_path, rows, schema, make, name, batches=3):
    columns = [c.split()[0] for c in schema.split(", ")]
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        pd.DataFrame(part, columns=columns).to_json(tmp_path / f"in{i}.json", orient="records", lines=True)
        os.utime(tmp_path / f"in{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    query = make(source).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    until = time.monotonic() + 240
    while query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < len(rows) and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()  # timers of processing time keep a query up
    return spark.table(name)


def test_stream_equals_batch_vault(spark, tmp_path):
    rows = [tuple(r) for r in docs(spark).orderBy("seq").collect()]
    schema = "seq long, session_id string, text string"
    got = run(spark, tmp_path, rows, schema, lambda s: V.stream_vault(M.mask(s, M.MaskOptions(SECRET))), "minted_entries")
    last = {}
    for r in got.collect():
        if r.uses >= last.get((r.session_id, r.token), (0,) * 6)[5]:
            last[r.session_id, r.token] = tuple(r)[:6]
    vault = M.build_vault(M.mask(docs(spark), M.MaskOptions(SECRET)), "session_id", "seq")
    want = {tuple(r) for r in vault.select("session_id", "token", "label", "text", "canonical_text", "uses").collect()}
    assert set(last.values()) == want
    assert got.filter("status = 'minted'").count() == len(want)


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.timers, self.now = [], 0

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def feed(processor, handle, rows, columns):
    got = list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=columns)]), handle))
    return [tuple(r) for r in pd.concat(got).itertuples(index=False)]


def test_refusals_and_expiry():
    handle, p = Handle(), V.VaultProcessor(cap=2, ttl_ms=100)
    p.init(handle)
    columns = ["seq", "start", "token", "label", "text", "canonical_text"]
    got = feed(p, handle, [(2, 0, "b", "L", "B", "B"), (1, 5, "a", "L", "A ", "A"), (1, 0, "a", "L", "A", "A"), (3, 0, "c", "L", "C", "C"), (4, 0, "a", "L", "Z", "Z")], columns)
    assert {(r[1], r[3], r[5], r[6]) for r in got} == {("a", "A", 2, "minted"), ("b", "B", 1, "minted"), ("c", "C", 0, "full"), ("a", "Z", 0, "clash")}
    assert handle.timers == [100]
    handle.now = 60
    assert [(r[1], r[5], r[6]) for r in feed(p, handle, [(5, 0, "a", "L", "A", "A")], columns)] == [("a", 3, "seen")]
    assert handle.timers == [160]
    end = pd.concat(list(p.handleExpiredTimer(("k",), handle, None)))
    assert (end.status[0], end.uses[0]) == ("expired", 2) and not p.entries and not p.size.exists()
    assert [r[6] for r in feed(p, handle, [(6, 0, "c", "L", "C", "C")], columns)] == ["minted"]


def test_pool_evicts_the_least_recently_used():
    handle, p = Handle(), V.PoolProcessor(most=2, ttl_ms=50)
    p.init(handle)
    got = feed(p, handle, [(i, s) for i, s in enumerate("abacab")], ["seq", "session_id"])
    assert [r[1:] for r in got] == [("a", "live"), ("b", "live"), ("c", "live"), ("b", "evicted"), ("b", "live"), ("c", "evicted")]
    end = pd.concat(list(p.handleExpiredTimer(("k",), handle, None)))
    assert set(zip(end.session_id, end.status, strict=True)) == {("a", "expired"), ("b", "expired")}


def test_pool_stream(spark, tmp_path):
    rows = [("p", "abcd"[i % 4], i) for i in range(12)]
    got = run(spark, tmp_path, rows, "pool_id string, session_id string, seq long", lambda s: V.stream_pool(s, most=2), "pool_sessions")
    assert got.filter("status = 'live'").count() == 12 and got.filter("status = 'evicted'").count() == 10


def test_figures_come_with_the_pass(spark, tmp_path):
    masked = M.mask(docs(spark), M.MaskOptions(SECRET))
    rows, seen = audit.observation(masked)
    assert rows.count() == docs(spark).count()
    got = seen.get
    flat = masked.select(F.explode("tokens").alias("t"))
    want = {f"n_{r.category}": r.n for r in flat.groupBy("t.category").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v for k, v in got.items() if k.startswith("n_") and v} == want
    sums = masked.agg(F.count("text"), F.sum(F.length("text")), F.sum(F.size("tokens"))).first()
    assert (got["mask_events"], got["text_length"], got["minted_count"], got["failed_texts"]) == (*sums, 1)
    assert got["masked_char_count"] == flat.agg(F.sum(F.col("t.end") - F.col("t.start"))).first()[0]

    batches = []
    listener = audit.MetricsListener(lambda batch, figures: batches.append(figures))
    spark.streams.addListener(listener)
    try:
        data = [tuple(r) for r in docs(spark).orderBy("seq").collect()]
        run(spark, tmp_path, data, "seq long, session_id string, text string", lambda s: audit.observed(M.mask(s, M.MaskOptions(SECRET))), "observed_rows")
        for _ in range(100):
            if sum(b["mask_events"] for b in batches) >= got["mask_events"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {k: sum(b[k] for b in batches) for k in got} == got
