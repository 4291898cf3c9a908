"""Row rules: placeholders, clean-up, integrity, layout and eligibility."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cues import in_order, lag, not_blank
from ..functions.text import count_words, mainly_cjk, once, only_punctuation, spaced_script, strip, trim_weak_tail
from .joins import substring_hits
from .windows import MUSIC

#: Whole lines that stand for sounds.
PLACEHOLDERS = (
    "music", "applause", "laughter", "laughs", "laugh", "chuckles", "chuckle", "sighs", "sigh", "silence", "inaudible", "foreign language",
    "speaking foreign language", "音乐", "掌声", "笑声", "笑", "叹气", "咳嗽", "沉默", "听不清",
)
#: Pairs of brackets that may wrap a placeholder, and openers of lines that transcription adds.
_WRAPPED = r"(?s)^(?:\[(.*)\]|\((.*)\)|【(.*)】|（(.*)）)$"
BRACKET_LED = r"^[【\[(（]"
#: Phrases that recognisers make up.
MADE_UP = ("请不吝点赞 订阅 转发", "打赏支持明镜")


def placeholder(text: Column | str, extra: tuple[str, ...] = ()) -> Column:
    """The whole line is music marks, or (within one pair of brackets) a sound word or "speaking ..."; false for null and blank."""
    t = F.col(text) if isinstance(text, str) else text
    words = [*PLACEHOLDERS, *[x.strip().lower() for x in extra]]
    # Most lines do not even begin as one, after white space, music and brackets.
    begins = rf"(?U)^[\s\\n{MUSIC[1:-1]}\[\](){{}}【】（）]*(?:{'|'.join(map(re.escape, words))}|speaking |$)"
    bare = lambda x: F.regexp_replace(x, rf"^(?:{MUSIC}|[ \t])+|(?:{MUSIC}|[ \t])+$", "")
    inner = lambda x: F.when(x.rlike(_WRAPPED) & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    sound = lambda key: key.isin(words) | key.rlike(r"^speaking [a-z ]+$")
    only_music = lambda x: F.regexp_replace(x, rf"{MUSIC}|(?U:\s)", "") == ""
    is_one = once(strip(F.regexp_replace(t, r"\\N|\n", " ")), lambda x: (x != "") & (only_music(x) | once(bare(x), lambda y: once(F.lower(strip(inner(y))), sound))))
    return F.when(F.lower(t).rlike(begins), is_one).otherwise(False)


def remove_placeholders(cues: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``action`` on both sides: drop (no side is left), blank (the translation alone is one), review (the original alone), keep."""
    c = cues.withColumn("a__", placeholder("text", extra)).withColumn("b__", placeholder("translated_text", extra))
    empty = F.length(strip(F.coalesce(F.col("translated_text"), F.lit("")))) == 0
    action = F.when(F.col("a__") & (F.col("b__") | empty), "drop").when(F.col("a__"), "review").when(F.col("b__"), "blank").otherwise("keep")
    return c.withColumn("action", action).withColumn("translated_text", F.when(F.col("action") == "blank", "").otherwise(F.col("translated_text"))).drop("a__", "b__")


def preprocess_words(cues: DataFrame, lower: bool = False) -> DataFrame:
    """Cues with a letter or digit, stripped; those of spaced scripts end with one space."""
    t = strip("text")
    t = F.lower(t) if lower else t
    return cues.where(~only_punctuation(F.col("text"))).withColumn("text", F.when(spaced_script(t), F.concat(t, F.lit(" "))).otherwise(t))


def trim_tails(cues: DataFrame) -> DataFrame:
    return cues.withColumn("text", trim_weak_tail("text")).withColumn("translated_text", trim_weak_tail("translated_text"))


def drop_made_up(cues: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Cues that don't open with a bracket and hold none of the phrases, the built-in ones and those of ``phrases(phrase)``."""
    t = F.ltrim("text")
    kept = cues.where(~t.rlike(BRACKET_LED))
    for p in MADE_UP:
        kept = kept.where(~F.contains("text", F.lit(p)))
    if phrases is None:
        return kept
    ids = ["media_id", "cue_idx"]
    return kept.join(substring_hits(kept.select(*ids, "text"), phrases.select(F.col("phrase").alias("form_id"), F.col("phrase").alias("form")), ids), ids, "left_anti")


def clamp(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Cues cut at the end of ``durations(media_id, duration_ms)``; later ones go. ``overflow`` is the part of the item's time past the end."""
    last = cues.groupBy("media_id").agg(F.max("end_ms").alias("last_ms"))
    d = durations.join(last, "media_id").select("media_id", "duration_ms", F.greatest(F.lit(0.0), (F.col("last_ms") - F.col("duration_ms")) / F.col("duration_ms")).alias("overflow"))
    c = cues.join(d, "media_id").where(F.col("start_ms") < F.col("duration_ms"))
    return c.withColumn("end_ms", F.least("end_ms", "duration_ms")).where(F.col("end_ms") > F.col("start_ms")).drop("duration_ms")


def shift(cues: DataFrame, offsets: DataFrame) -> DataFrame:
    """Times moved by ``offsets(media_id, chunk_idx, offset_ms)``."""
    c = cues.join(offsets, ["media_id", "chunk_idx"])
    return c.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms")).drop("offset_ms")


def side_text(layout: Column, prefer: str = "translate") -> tuple[Column, Column]:
    """Displayed primary text and the other side, for a layout column (translate_on_top, original_on_top, only_original, only_translate)."""
    a, b = F.nullif(strip("text"), F.lit("")), F.nullif(strip(F.coalesce(F.col("translated_text"), F.lit(""))), F.lit(""))
    first = F.when(layout == "only_original", F.lit(True)).when(layout == "only_translate", F.lit(False))
    if prefer == "layout":
        first = F.coalesce(first, layout == "original_on_top")
    else:
        first = F.coalesce(first, F.lit(prefer == "original"))
    return F.coalesce(F.when(first, F.coalesce(a, b)).otherwise(F.coalesce(b, a)), F.lit("")), F.coalesce(F.when(first, b).otherwise(a), F.lit(""))


def integrity(cues: DataFrame) -> DataFrame:
    """``(media_id, cue_idx, problem)``: negative start, no duration, out of order, no text."""
    empty = (F.length(strip("text")) == 0) & (F.length(strip(F.coalesce(F.col("translated_text"), F.lit("")))) == 0)
    # Texts are looked at where they are, and not shuffled.
    c = cues.select("media_id", "cue_idx", "start_ms", "end_ms", empty.alias("empty__"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("start_ms") < 0, "negative_start"),
            F.when(F.col("end_ms") <= F.col("start_ms"), "no_duration"),
            F.when(F.col("start_ms") < F.lag("start_ms").over(Window.partitionBy("media_id").orderBy("cue_idx")), "out_of_order"),
            F.when(F.col("empty__"), "no_text"),
        )
    )
    return c.withColumn("problems", problems).select("media_id", "cue_idx", F.explode("problems").alias("problem"))


def layout_of(cues: DataFrame) -> DataFrame:
    """``(media_id, layout, confidence)``: original on top at 0.5 if every cue has both sides, else original only at 1."""
    both = F.bool_and(not_blank(F.coalesce(F.col("translated_text"), F.lit(""))))
    return cues.groupBy("media_id").agg(both.alias("b")).select("media_id", F.when(F.col("b"), "original_on_top").otherwise("only_original").alias("layout"), F.when(F.col("b"), 0.5).otherwise(1.0).alias("confidence"))


def split_sides(cues: DataFrame, layout: str) -> DataFrame:
    """The first line is one side and the rest the other, for a layout with the original or the translation on top."""
    lines = F.split("text", "\n")
    first, rest = F.element_at(lines, 1), F.array_join(F.slice(lines, 2, 1_000_000), "\n")
    many = F.size(lines) > 1
    top, below = ("text", "translated_text") if layout == "original_on_top" else ("translated_text", "text")
    c = cues.select("*", F.when(many, first).alias("top__"), F.when(many, rest).alias("below__"))
    return c.withColumn(top, F.coalesce("top__", F.col(top))).withColumn(below, F.coalesce("below__", F.col(below))).drop("top__", "below__")


def too_long_to_speak(text: Column, duration_ms: Column, threshold: float = 1.0) -> Column:
    """More speech than time: 5.5 characters or 2.7 words a second times the threshold, over a tenth of a second at least."""
    seconds = F.greatest(F.lit(0.1), duration_ms / 1000)
    return F.when(mainly_cjk(text), F.length(F.regexp_replace(text, r"(?U)\s+", "")) / seconds > 5.5 * threshold).otherwise(count_words(text) / seconds > 2.7 * threshold)


def search_log(log: DataFrame, needle: str, cols: tuple[str, ...] = ("model", "request_id", "task_id", "file_name", "stage", "role", "status", "messages", "response")) -> DataFrame:
    """Rows with ``needle`` in any of ``cols`` that the log has, without regard to case."""
    cols = tuple(c for c in cols if c in log.columns)
    return log.where(F.contains(F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in cols])), F.lit(needle.lower())))


def primary_side(layout: Column, prefer: str = "translate") -> Column:
    """Which side is displayed first: text or translated_text, null where both are blank; and (``cjk_side``) which holds text without spaces."""
    blank = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit("")))) == 0
    first, _ = side_text(layout, prefer)
    return F.when(blank("text") & blank("translated_text"), F.lit(None).cast("string")).when(~blank("translated_text") & (first == strip("translated_text")) & (blank("text") | (first != strip("text")) | F.lit(prefer != "original")), "translated_text").otherwise("text")


def cjk_side() -> Column:
    """The side that is mainly of a script without spaces: the translation if it is, else the text if it is, else null."""
    return F.when(mainly_cjk("translated_text"), "translated_text").when(mainly_cjk("text"), "text")


def preflight(media: DataFrame, cues: DataFrame, most_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """``(media_id, failed)``: what keeps ``media(media_id, duration_ms, audio_tracks)`` from being aligned with its cues."""
    c = cues.groupBy("media_id").agg(F.max("end_ms").alias("last"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("end_ms") <= F.col("start_ms")).alias("bad"))
    j = media.join(c, "media_id", "left")
    failed = F.array_compact(
        F.array(
            F.when(F.coalesce("n", F.lit(0)) == 0, "no_cues"),
            F.when(F.coalesce("audio_tracks", F.lit(0)) == 0, "no_audio"),
            F.when(F.coalesce("duration_ms", F.lit(0)) <= 0, "no_duration"),
            F.when(F.col("duration_ms") > most_ms, "too_long"),
            F.when(F.col("last") > F.col("duration_ms") + 1000, "cues_past_end"),
            F.when(F.col("bad"), "bad_cue_times"),
        )
    )
    return j.select("media_id", failed.alias("failed"))


def eligible_windows(windows: DataFrame, cues: DataFrame) -> DataFrame:
    """Evidence windows of medium or high grade whose cues all exist."""
    graded = windows.where(F.col("grade").isin("MEDIUM", "HIGH"))
    ids = graded.select("media_id", "window_id", F.explode("cue_ids").alias("cue_id"))
    gone = ids.join(cues.select("media_id", F.col("cue_id")), ["media_id", "cue_id"], "left_anti").select("media_id", "window_id").distinct()
    return graded.join(gone, ["media_id", "window_id"], "left_anti")
