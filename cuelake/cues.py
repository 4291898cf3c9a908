"""The cue table: one row per timed line of a media item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Schemas of the tables that operators take and return.
CUES = "media_id BIGINT, cue_idx INT, start_ms BIGINT, end_ms BIGINT, text STRING, translated_text STRING"
RAW_FILES = "path STRING, content BINARY"
RANGES = "media_id BIGINT, start_ms BIGINT, end_ms BIGINT"
GLOSSARY = (
    "glossary_id STRING, entry_id STRING, source_term STRING, sense STRING, translation STRING, aliases ARRAY<STRING>, occurrence_ids ARRAY<INT>, "
    "selection_source STRING, high_risk BOOLEAN, source_language STRING, target_language STRING, fingerprint STRING"
)
REQUEST_LOG = (
    "time TIMESTAMP, request_id STRING, task_id STRING, file_name STRING, stage STRING, role STRING, attempt INT, duration_ms BIGINT, status STRING, "
    "usage STRUCT<input_tokens:BIGINT,output_tokens:BIGINT,cache_read_tokens:BIGINT,cache_write_tokens:BIGINT>"
)


def in_order() -> WindowSpec:
    """Cues of one media item by start, then by index. All window operators use this key, so that one exchange serves a chain of them."""
    return Window.partitionBy("media_id").orderBy("start_ms", "cue_idx")


def of_media() -> WindowSpec:
    return Window.partitionBy("media_id")


def lead(col: str | Column, n: int = 1) -> Column:
    return F.lead(col, n).over(in_order())


def lag(col: str | Column, n: int = 1) -> Column:
    return F.lag(col, n).over(in_order())


def not_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", "")) > 0


def cue_view(documents: DataFrame) -> DataFrame:
    """Cues derived from ``documents``: a media item for each document, a cue for each line that isn't blank.

    Durations, gaps and translated sides follow from the text and position alone, so that SQL can derive the same rows.
    """
    raw = documents.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("cue_idx", "text"))
    t = raw.where(F.length(F.trim("text")) > 0).select(
        "media_id", "cue_idx", "text",
        (500 + (F.length("text") * 31 + F.col("cue_idx") * 97) % 7000).alias("dur"),
        ((F.col("media_id") * 53 + F.col("cue_idx") * 131) % 2600).alias("g"),
    )
    c = t.withColumn("gap", F.when(F.col("g") < 150, -F.col("g")).otherwise(F.col("g")))
    w = Window.partitionBy("media_id").orderBy("cue_idx")
    p = c.select(
        "media_id", "cue_idx", "text", "dur",
        (1000 + F.sum(F.col("dur") + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("dur")).cast("long").alias("start_ms"),
        F.lead("text").over(w).alias("nxt"),
    )
    side = F.col("cue_idx") % 5
    translated = F.when(side == 0, "").when(side == 1, F.col("text")).when(side == 2, F.regexp_replace("text", "[0-9]", "")).otherwise(F.coalesce("nxt", F.lit("")))
    return p.select("media_id", "cue_idx", "start_ms", (F.col("start_ms") + F.col("dur")).cast("long").alias("end_ms"), "text", translated.alias("translated_text"))


def read_cue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_view(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same view in DuckDB, as the head of a WITH clause.
CUES_SQL = """
WITH raw AS (
  SELECT doc_id AS media_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS cue_idx, unnest(string_split(text, chr(10))) AS text FROM documents
), t AS (
  SELECT media_id, cue_idx, text, 500 + (length(text) * 31 + cue_idx * 97) % 7000 AS dur, (media_id * 53 + cue_idx * 131) % 2600 AS g
  FROM raw WHERE length(trim(text)) > 0
), c AS (
  SELECT media_id, cue_idx, text, dur, CASE WHEN g < 150 THEN -g ELSE g END AS gap FROM t
), p AS (
  SELECT media_id, cue_idx, text, dur,
    1000 + sum(dur + gap) OVER (PARTITION BY media_id ORDER BY cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - dur AS start_ms,
    lead(text) OVER (PARTITION BY media_id ORDER BY cue_idx) AS nxt
  FROM c
), cues AS (
  SELECT media_id, CAST(cue_idx AS INT) AS cue_idx, CAST(start_ms AS BIGINT) AS start_ms, CAST(start_ms + dur AS BIGINT) AS end_ms, text,
    CASE cue_idx % 5 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN regexp_replace(text, '[0-9]', '', 'g') ELSE coalesce(nxt, '') END AS translated_text
  FROM p
)
"""
