"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fingerprints, infill, langid, lm, mixing, near_dedup, pieces, quality, quantiles, sharding, token_counts
from .common import crc_mod, scratch, table

TOKENIZER = "piece_bpe_32k.model"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=2)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.references(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    out = langid.held_out(langid.identify(docs, model))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat(table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM d),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l FROM p GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l),
pre AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM u)),
m AS (SELECT conv_id, len(l) AS n_turns FROM u WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.l = u.l))
SELECT conv_id, ((pos - 1) // 256)::INTEGER AS part, n_turns, count(*)::INTEGER AS part_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
    || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM p JOIN m USING (conv_id) GROUP BY conv_id, part, n_turns
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5('mix-' || coalesce(doc_id::VARCHAR, '') || '-' || md5(coalesce(text, ''))) AS ord FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS sid, 2 * s_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
  ((sum(s_size) OVER () * 3 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::DOUBLE
   / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 2)::DOUBLE) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / w, sid)),
s3 AS (SELECT min(pos) AS fst, arg_min(level, pos) AS level FROM s2 WHERE cap >= level * w),
s4 AS (SELECT s2.source, s2.sid, s2.s_size, CASE WHEN s3.fst IS NULL OR pos < s3.fst THEN cap::DOUBLE ELSE s3.level * w END AS target FROM s2, s3),
p AS (SELECT d.*, s4.s_size, s4.target, floor(s4.target)::BIGINT AS take,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
r AS (SELECT *, row_number() OVER () AS rid FROM (SELECT p.*, s4.sid FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source)),
need AS (SELECT sid, ceil(floor(target) / 512)::BIGINT AS need FROM s4 WHERE floor(target) > 0),
upto AS (SELECT *, (sum(need) OVER (ORDER BY sid))::BIGINT AS hi, (sum(need) OVER ())::BIGINT AS total FROM need),
cells AS (SELECT sid, need, ceil((hi - need)::DOUBLE * 2147483648 / total) AS p, ceil(hi::DOUBLE * 2147483648 / total) AS q FROM upto),
slots AS (SELECT slot, ((slot % 2147483648 + 1) * 1327217885) % 2147483648 AS x FROM (SELECT unnest(range((SELECT coalesce(max(hi), 0) FROM upto))) AS slot)),
ranked AS (SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM slots JOIN cells ON x >= p AND x < q),
over_ AS (SELECT slot, row_number() OVER (ORDER BY slot) AS j FROM ranked WHERE rank >= need),
got AS (SELECT sid, count(*) AS got FROM ranked GROUP BY sid),
short AS (SELECT sid, rank, row_number() OVER (ORDER BY sid, rank) AS j
  FROM (SELECT sid, unnest(range(coalesce(got, 0), need)) AS rank FROM need LEFT JOIN got USING (sid) WHERE coalesce(got, 0) < need)),
sched AS (SELECT slot, sid, rank FROM ranked WHERE rank < need UNION ALL SELECT slot, sid, rank FROM over_ JOIN short USING (j)),
turns AS (SELECT rid, sid, e * s_size + lo AS a, least(e * s_size + lo + size, take) AS z FROM r, (VALUES (0), (1)) AS t(e) WHERE size > 0),
parts AS (SELECT *, unnest(range(a // 512, (z - 1) // 512 + 1)) AS rank FROM turns WHERE a < z),
sums AS (SELECT rid, min(slot) AS first_slot, count(*) AS n_slots, sum(least(z, (rank + 1) * 512) - greatest(a, rank * 512))::BIGINT AS n
  FROM parts JOIN sched USING (sid, rank) GROUP BY rid)
SELECT doc_id, size, s_size AS source_size, target, coalesce(n, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM r LEFT JOIN sums USING (rid)
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""

def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def priced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted money values (``quantiles.counted``) by stream, grp and batch. Sale lines are counted by item before items are joined, so that no item or brand is hot."""
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.max(F.struct("client_id", "value")).alias("c"))
    clicks = clicks.select(F.lit("value").alias("stream"), F.col("c.client_id").cast("string").alias("grp"), crc_mod(F.col("click_id"), 8).cast("int").alias("batch"), F.col("c.value").alias("money"), F.lit(1).cast("long").alias("m"))
    lines = table(spark, sf_dir, "sale_lines").filter(F.col("item_id").isNotNull())
    lines = lines.groupBy("item_id", crc_mod(F.col("vendor_id"), 8).cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("m"))
    items = table(spark, sf_dir, "items").select(F.col("item_id").alias("own"), "brand", "price").hint("merge")
    prices = lines.join(items, F.col("item_id") == F.col("own")).select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", F.col("price").alias("money"), "m")
    rows = clicks.unionByName(prices).filter(F.col("grp").isNotNull() & F.col("money").isNotNull() & ~F.isnan("money"))
    rows = rows.withColumn("value", F.floor(F.col("money") * 100 + 0.5) + F.col("batch") * 1000)
    return scratch(quantiles.counted(rows, ["stream", "grp", "batch"], "value", F.col("m")), "counted")


def op12_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.report(priced_rows(spark, sf_dir), ["stream", "grp"], "batch")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.infill(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, t, u, len(u) AS n, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT for k in range(0, 4)] AS h FROM d),
k AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_pieces": op3_pieces,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_quantiles": op12_quantiles,
    "op13_infill": op13_infill,
}
SQL = {"op8_chat": OP8_SQL, "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op13_infill": OP13_SQL}
