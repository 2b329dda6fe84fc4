"""Detection and scans of whole texts happen once; what reads them several times reads a written table."""

import itertools
import re
import time

import pytest
from pyspark.sql import functions as F

from umbraline.operators import detect, evals
from umbraline.operators import mask as M
from umbraline.operators import restore as R
from umbraline.plans import queries as Q

SECRET = "golden-test-secret"


@pytest.mark.parametrize("name", ["mutation_scoreboard", "restore_counters", "token_status", "neutralised", "roundtrip_exact"])
def test_masked_documents_are_detected_once(spark, small, name):
    plan = Q.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "mint(" not in plan


def test_scoreboard_of_rows_that_share_a_key(spark):
    rows = [(1, "s", "mail ann@x.org"), (1, "s", "mail bob@y.org and ann@x.org"), (2, "t", "mail ann@x.org")]
    masked = M.mask(spark.createDataFrame(rows, "id int, session_id string, text string"), M.MaskOptions(SECRET))
    board = evals.scoreboard(masked.select("id", "session_id", "masked"), M.build_vault(masked, "session_id", "id"), SECRET)
    got = board.filter(F.col("class_name") == "brace-strip").first()
    assert (got.cases, got.expected, got.restored, got.status) == (3, 4, 4, "ok")


def test_families_of_credentials_are_searched_by_their_sign(spark):
    """Pairs of families in one text against the whole alternation, and a long run of letters, on which families that are not there took quadratic time."""
    planted = [a + secret + z for _, a, secret, z in Q.SECRET_CASES]
    texts = [f"{a}\n{b}" for a, b in itertools.permutations(planted, 2)] + ["", "no sign"]
    whole = re.compile("|".join(f"(?:{p})" for p in detect.SECRETS.values()), re.ASCII)
    token = re.compile(r"\{\{OPF:[A-Z][A-Z_]*:[a-z0-9]{16}\}\}")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detect.secret_spans()(F.col("t")).alias("s")).collect()
    for r in got:
        tokens = [m.span() for m in token.finditer(r.t)]
        assert [(s.start, s.text) for s in r.s] == [(m.start(), m[0]) for m in whole.finditer(r.t) if not any(m.start() < z and m.end() > a for a, z in tokens)]
    began = time.monotonic()
    long = "b" * 60_000 + " sk-" + "a1" * 16
    assert spark.createDataFrame([(long,)], "t string").select(F.size(detect.secret_spans()(F.col("t")))).first()[0] == 1
    assert time.monotonic() - began < 15


def test_rows_of_one_token_are_dealt_over_tasks(spark):
    vault = spark.createDataFrame([("s", "{{OPF:EMAIL:aaaaaaaaaaaaaaa1}}")], "session_id string, token string")
    rows = spark.range(2_000).select("id", F.lit("s").alias("session_id"), F.lit("{{OPF:EMAIL:aaaaaaaaaaaaaaa1}}").alias("token"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        dealt = M.token_status(rows, vault, SECRET).groupBy(F.spark_partition_id().alias("task"), "status").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.status for r in dealt} == {"live"} and sum(r["count"] for r in dealt) == 2_000
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 1_500


def test_texts_are_rewritten_a_slice_at_a_time(spark):
    import pyarrow as pa

    texts = pa.array(["a" * 900, None, "b" * 5_000, "", "c" * 900])
    got = list(R.text_slices(texts, 1_100))
    assert got == [(0, 2), (2, 1), (3, 2)] and list(R.text_slices(texts.slice(0, 0))) == []
    vault = spark.createDataFrame([("s", "{{OPF:EMAIL:aaaaaaaaaaaaaaa1}}", "EMAIL", "ann@x.org", "aaaaaaaaaaaaaaa1")], "session_id string, token string, label string, text string, hash string")
    own = F.concat(F.col("id").cast("string"), F.lit(" é{{OPF:EMAIL:aaaaaaaaaaaaaaa1}} "), F.repeat(F.lit("x"), 100_000))
    rows = spark.range(60).coalesce(1).select("id", F.lit("s").alias("session_id"), F.when(F.col("id") != 7, own).alias("text"))
    back = R.restore(rows, vault, SECRET).select("id", F.substring("restored", 1, 30).alias("t"), "restored_count").collect()
    assert {(r.id, r.t, r.restored_count) for r in back} == {(i, f"{i} éann@x.org " + "x" * (18 - len(str(i))), 1) for i in range(60) if i != 7} | {(7, None, 0)}


def test_repair_meets_the_vault_in_a_shuffle(spark, tmp_path):
    """By its file a vault looks small enough to broadcast; its entries' deletions are many times larger, and stay off the driver."""
    entry = F.concat(F.lit("own"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 13))
    made = spark.range(3_000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("session_id"), F.lit("EMAIL").alias("label"), F.format_string("%d@x.org", "id").alias("text"), entry.alias("hash"))
    made.withColumn("token", F.format_string("{{OPF:EMAIL:%s}}", "hash")).write.parquet(str(tmp_path / "vault"))
    vault = spark.read.parquet(str(tmp_path / "vault"))
    hurt = F.concat(F.substring("hash", 1, 9), F.lit("z"), F.substring("hash", 11, 6))
    rows = made.select("id", "session_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("own"), F.format_string("{{OPF:EMAIL:%s}}", hurt).alias("t"), "text")
    back = R.restore(rows.withColumn("text", F.concat("own", F.lit(" "), F.col("t"))), vault, SECRET)
    joins = [line for line in back._jdf.queryExecution().executedPlan().toString().splitlines() if "levenshtein" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    got = {(r.restored, r.repaired_count) for r in back.select("restored", "repaired_count").collect()}
    assert got == {(f"{own} {i}@x.org", 1) for own in "ab" for i in range(3_000)}
