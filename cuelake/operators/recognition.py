"""Recognised chunks: which of their times to trust, and how to cut those that are too large or failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_markup
from .metrics import alignment_problems
from .structure import speech_timing, transcript_pieces
from .windows import silence_boundary

#: Share of the transcript that times must cover to be kept in spite of problems.
LEAST_COVERAGE = 0.7
#: What neighbours of a retried chunk share at most, in ms, and the share of the predicted length that a payload may fill.
RETRY_OVERLAP_MS, FILLED = 3000, 0.95


def response_cues(responses: DataFrame, items: DataFrame, speech: DataFrame, need_words: bool = True, degraded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cues of recogniser responses, and how each was timed: ``(media_id, route, problems, coverage)``.

    ``responses(media_id, text, duration_ms)`` with ``items(media_id, start_ms, end_ms, text)`` where the service gave times,
    and ``speech(media_id, start_ms, end_ms)`` ranges. Markup goes first; a response without text is silence. Times are cut
    at the end of the audio and checked: without problems they stand (aligned). With problems, or without times, the response
    is rejected; where ``degraded`` ones are let in, times that cover enough of the text stay as they are (degraded), and
    else the text is cut in pieces and timed by its share of the speech (estimated). With ``need_words`` off, times stand
    unchecked and texts without times are estimated.
    """
    r = responses.select("media_id", strip_markup("text").alias("transcript"), F.greatest(F.lit(1).cast("long"), "duration_ms").alias("duration_ms"))
    given = items.join(r, "media_id").where((F.col("start_ms") < F.col("duration_ms")) | F.lit(not need_words))
    end = F.least("end_ms", "duration_ms") if need_words else F.col("end_ms")
    given = given.select("media_id", "start_ms", end.alias("end_ms"), "text").where(F.col("end_ms") > F.col("start_ms"))
    late = items.groupBy("media_id").agg(F.max("end_ms").alias("last_ms"))
    checked = alignment_problems(given, r.select("media_id", "duration_ms", "transcript"))
    j = r.join(checked, "media_id", "left").join(late, "media_id", "left")
    over = F.coalesce((F.col("last_ms") - F.col("duration_ms")) > F.col("duration_ms") * 0.05, F.lit(False))
    problems = F.array_union(F.coalesce("problems", F.array().cast("array<string>")), F.when(over, F.array(F.lit("overflow"))).otherwise(F.array().cast("array<string>")))
    timed = F.col("last_ms").isNotNull()
    enough = F.coalesce(F.col("coverage") >= LEAST_COVERAGE, F.lit(False))
    let_in = F.when(timed & enough, "degraded").otherwise("estimated") if degraded else F.lit("rejected")
    route = F.when(F.col("transcript") == "", "silence")
    route = route.when(timed & (F.size(problems) == 0), "aligned").otherwise(let_in) if need_words else route.when(timed, "aligned").otherwise("estimated")
    routed = j.select("media_id", "transcript", route.alias("route"), problems.alias("problems"), "coverage")
    kept = given.join(routed.where(F.col("route").isin("aligned", "degraded")).select("media_id"), "media_id", "left_semi")
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "text")
    kept = kept.select("media_id", (F.row_number().over(w) - 1).cast("int").alias("cue_idx"), "start_ms", "end_ms", "text")
    pieces = transcript_pieces(routed.where(F.col("route") == "estimated").select("media_id", F.col("transcript").alias("text")))
    spoken = speech.select("media_id", "start_ms", "end_ms").where(F.col("end_ms") > F.col("start_ms"))
    silent = r.join(spoken.select("media_id").distinct(), "media_id", "left_anti").select("media_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    estimated = speech_timing(pieces, spoken.unionByName(silent)).select("media_id", F.col("pos").alias("cue_idx"), "start_ms", "end_ms", "text")
    return kept.unionByName(estimated), routed.drop("transcript")


def retry_spans(chunks: DataFrame, silences: DataFrame | None = None, before_ms: int = 60_000, after_ms: int = 15_000, min_silence_ms: int = 300) -> DataFrame:
    """``(media_id, chunk_idx, part, start_ms, end_ms)`` within each of ``chunks(media_id, chunk_idx, total_ms, parts)``.

    Equal parts, the last one up to the end; with ``silences(media_id, chunk_idx, start_ms, end_ms)`` each inner cut moves to
    the best silence near it and neighbours overlap by RETRY_OVERLAP_MS, or a quarter of a part where that is less.
    """
    c = chunks.where(F.col("total_ms") > 0).withColumn("parts", F.greatest(F.lit(1), F.col("parts")))
    cut = c.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("k"))
    nominal = F.when(F.col("k") == F.col("parts"), F.col("total_ms")).otherwise(F.expr("total_ms div parts") * F.col("k") if silences is None else F.bround(F.col("total_ms") * F.col("k") / F.col("parts")).cast("long"))
    cut = cut.withColumn("at", nominal.cast("long"))
    overlap = F.lit(0).cast("long")
    if silences is not None:
        # Chunks stand for media items here; cuts are far enough apart for each to look for its own silence.
        least = F.greatest(F.lit(1000).cast("long"), F.expr("total_ms div (parts * 3)"))
        name = F.concat_ws("/", F.col("media_id").cast("string"), F.col("chunk_idx").cast("string"))
        near = cut.where(F.col("k") < F.col("parts")).select(
            name.alias("media_id"), F.col("k").alias("search_id"), F.col("at").alias("target_ms"),
            F.greatest(F.col("at") - before_ms, F.expr("total_ms div parts") * (F.col("k") - 1) + least).alias("start_ms"), F.least(F.col("at") + after_ms, F.col("total_ms") - least).alias("end_ms"),
        ).where(F.col("start_ms") < F.col("end_ms"))
        found = silence_boundary(near, silences.select(name.alias("media_id"), "start_ms", "end_ms"), min_silence_ms).select(F.col("media_id").alias("n"), "search_id", "boundary_ms")
        cut = cut.join(found, (name == F.col("n")) & (F.col("k") == F.col("search_id")), "left").withColumn("at", F.coalesce("boundary_ms", "at"))
        overlap = F.when(F.col("parts") > 1, F.least(F.lit(RETRY_OVERLAP_MS).cast("long"), F.expr("total_ms div (parts * 4)"))).otherwise(0)
    w = Window.partitionBy("media_id", "chunk_idx").orderBy("k")
    cut = cut.withColumn("from", F.coalesce(F.lag("at").over(w), F.lit(0).cast("long")))
    start, end = F.greatest(F.lit(0).cast("long"), F.col("from") - F.when(F.col("k") > 1, overlap).otherwise(0)), F.least("total_ms", F.col("at") + F.when(F.col("k") < F.col("parts"), overlap).otherwise(0))
    return cut.select("media_id", "chunk_idx", (F.col("k") - 1).alias("part"), start.alias("start_ms"), end.alias("end_ms")).where(F.col("end_ms") > F.col("start_ms"))


def payload_spans(chunks: DataFrame, most_bytes: int) -> DataFrame:
    """``(media_id, chunk_idx, part, start_ms, end_ms)``: ``chunks(media_id, chunk_idx, start_ms, end_ms, bytes)`` cut so that each part fits ``most_bytes``.

    Bytes spread evenly over time. A part too large is cut where FILLED of the limit is predicted to be reached, but not
    before a second; parts of a second or less stay. With even bytes all cuts of a chunk are one length apart.
    """
    length = F.col("end_ms") - F.col("start_ms")
    step = F.greatest(F.lit(1000).cast("long"), F.floor(length * F.lit(most_bytes) / F.greatest(F.lit(1).cast("long"), "bytes") * FILLED).cast("long"))
    c = chunks.where(length > 0).withColumn("step", F.least(step, F.greatest(F.lit(1).cast("long"), length - 1)))
    # A rest that fits the limit, or lasts a second at most, is not cut again.
    fits = F.floor(length * F.lit(most_bytes) / F.greatest(F.lit(1).cast("long"), "bytes")).cast("long")
    whole = (F.col("bytes") <= most_bytes) | (length <= 1000)
    cuts = F.when(whole, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.ceil((length - F.greatest(fits, F.lit(1000).cast("long"))) / F.col("step"))))
    c = c.withColumn("cuts", cuts.cast("long")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts"))).alias("part"))
    start = F.col("start_ms") + F.col("part") * F.col("step")
    return c.select("media_id", "chunk_idx", F.col("part").cast("int").alias("part"), start.alias("start_ms"), F.when(F.col("part") == F.col("cuts"), F.col("end_ms")).otherwise(start + F.col("step")).alias("end_ms"))
