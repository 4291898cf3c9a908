"""One query for each operator over its whole table, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, decontaminate, langid, licenses, lm, mixing, negatives, quality, sharding, simhash, toxicity, urls

#: Where the public tokenizers' files lie.
TOKENIZERS = "/opt/tokenizers"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good quality; background: all documents. Each is scored by the counts of all others."""
    docs = _read(spark, sf_dir, "documents")
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(lm.mark_ids(docs, good))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has a wrong label on purpose."""
    vectors = _read(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op13_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), sharding.tree_of(16), sharding.tree_of(17))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ann_search, op2_mix_sources, op3_decontaminate, op4_quality, op5_simhash, op6_license_scan, op7_language_id, op8_lm_score, op9_url_filter, op10_toxicity, op11_hard_negatives, op12_token_alignment, op13_shard)
    return {f.__name__: f for f in ops}


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || md5(coalesce(text, ''))) AS mix_key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, ([1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER fill AS place, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w WINDOW fill AS (ORDER BY source_size / weight, source NULLS LAST)
), g AS (
  SELECT *, (total - cap_before) / (weights - weight_before) AS share FROM f
), level AS (
  SELECT arg_min(share, place) AS level FROM g WHERE cap > weight * share
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM g
), own AS (
  SELECT *, round(target)::BIGINT AS goal, ceil(round(target) / 2048)::BIGINT AS blocks FROM t
), stretches AS (
  SELECT source, blocks, (sum(blocks) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) - blocks)::BIGINT AS first_point FROM own WHERE blocks > 0
), bits AS (
  SELECT greatest(1, length(bin(greatest(0, sum(blocks) - 1)::BIGINT)))::INT AS bits FROM stretches
), points AS (
  SELECT source, unnest(range(first_point, first_point + blocks)) AS point FROM stretches
), mirrored AS (
  SELECT source, list_sum(list_transform(range(bits), lambda k: ((point >> k) & 1) << (bits - 1 - k)))::BIGINT AS slot FROM points, bits
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM mirrored
), placed AS (
  SELECT row_number() OVER () AS rid, d.doc_id, d.source, d.size, o.source_size, o.target, o.goal,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mix_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM sized d JOIN own o ON d.source IS NOT DISTINCT FROM o.source
), runs AS (
  SELECT rid, source, start + e * source_size AS a, least(start + e * source_size + size, goal) AS b FROM placed, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND start + e * source_size < goal
), pieces AS (
  SELECT rid, source, a, b, unnest(range(a // 2048, (b - 1) // 2048 + 1)) AS nth FROM runs
), met AS (
  SELECT rid, sum(least(b, (nth + 1) * 2048) - greatest(a, nth * 2048))::BIGINT AS taken, count_if(a >= nth * 2048)::BIGINT AS epochs, min(slot) AS first_slot
  FROM pieces p JOIN slots s USING (nth) WHERE p.source IS NOT DISTINCT FROM s.source GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(epochs, 0) AS epochs, first_slot FROM placed LEFT JOIN met USING (rid)
"""

LEAKS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT dw.rid, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), hits AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM m) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hits.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hits.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""


NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))), 0) = len(embedding)
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, coalesce(list_dot_product(a.v, b.v), 0)::BIGINT AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""

SHARD_SQL = r"""
WITH leaf AS (
  SELECT s, CASE WHEN s < 16 THEN 'g' || (s // 8) ELSE 'own' || s END AS region, CASE WHEN s < 16 THEN s // 4 ELSE s END AS rack FROM range(17) t(s)
), node AS (
  SELECT s = 16 AS added, region, region || '/k' || rack AS rack, region || '/k' || rack || '/' || s AS name, s::INT AS shard FROM leaf
), crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS text_md5,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), r AS (
  SELECT rid, key, grown, arg_max(region, ln((('0x' || substr(md5(key || '/' || region), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656) / n) AS region
  FROM d, (SELECT region, added, count(*)::DOUBLE AS n FROM node GROUP BY region, added), (VALUES (false), (true)) g(grown) WHERE grown OR NOT added GROUP BY rid, key, grown
), k AS (
  SELECT rid, key, grown, arg_max(rack, ln((('0x' || substr(md5(key || '/' || rack), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656) / n) AS rack
  FROM r JOIN (SELECT region, rack, count(*)::DOUBLE AS n FROM node GROUP BY region, rack) USING (region) GROUP BY rid, key, grown
), p AS (
  SELECT rid, grown, arg_max(shard, ln((('0x' || substr(md5(key || '/' || name), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656)) AS shard FROM k JOIN node USING (rack) GROUP BY rid, grown
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY md5(key || ' ' || text_md5), doc_id, size, text_crc32) - 1 AS slot, b.shard AS grown_shard
FROM d JOIN p a ON d.rid = a.rid AND NOT a.grown JOIN p b ON d.rid = b.rid AND b.grown
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": MIX_SQL, "op3_decontaminate": LEAKS_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op13_shard": SHARD_SQL}
