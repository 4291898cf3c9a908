"""Timing operators over ordered cues. All share one partitioning by media, so a chain of them shuffles once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cues import in_order, lag, lead, not_blank, of_media
from ..functions.text import count_words, mainly_cjk, strip, visible_units
from ..policy import PostprocessConfig, SpeedPolicy

_HEAD = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)

#: Marks of music or lyrics.
MUSIC = "[♪♫♬♩]"


def drop_blank(cues: DataFrame) -> DataFrame:
    """Cues with visible text, numbered from 1 in order of start; equal starts keep their index order."""
    return cues.where(not_blank(F.col("text"))).withColumn("cue_no", F.row_number().over(in_order()))


def word_level_cue(text: Column) -> Column:
    """One or two characters of a script without spaces, else exactly one word."""
    t = strip(text)
    return F.when(mainly_cjk(t), F.length(t) <= 2).otherwise((F.length(t) > 0) & ~t.rlike(r"(?U)\s"))


def word_level_media(cues: DataFrame) -> DataFrame:
    """``(media_id, word_level)``: at least 80% of a media item's cues are single words."""
    share = F.count_if(word_level_cue(F.col("text"))) * 5 >= F.count(F.lit(1)) * 4
    return cues.groupBy("media_id").agg(share.alias("word_level"))


def with_word_level(cues: DataFrame) -> DataFrame:
    share = F.sum(word_level_cue(F.col("text")).cast("int")).over(of_media()) * 5 >= F.count(F.lit(1)).over(of_media()) * 4
    return cues.withColumn("word_level", share)


def _meeting(end: Column, start: Column) -> Column:
    return (F.floor((end + start) / 2) + F.floor((start - end) / 4)).cast("long")


def _move_boundaries(cues: DataFrame, chosen) -> DataFrame:
    """Both sides of each boundary that ``chosen(gap)`` picks meet at three quarters of the gap. Word-level media stay."""
    c = with_word_level(cues)
    before, after = F.col("start_ms") - lag("end_ms"), lead("start_ms") - F.col("end_ms")
    start = F.when(chosen(before) & ~F.col("word_level"), _meeting(lag("end_ms"), F.col("start_ms"))).otherwise(F.col("start_ms"))
    end = F.when(chosen(after) & ~F.col("word_level"), _meeting(F.col("end_ms"), lead("start_ms"))).otherwise(F.col("end_ms"))
    return c.select("*", start.alias("new_start"), end.alias("new_end")).drop("word_level", "start_ms", "end_ms").withColumnsRenamed({"new_start": "start_ms", "new_end": "end_ms"})


def fix_flicker(cues: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """Cues closer than the threshold, overlapping ones too, meet."""
    return _move_boundaries(cues, lambda gap: F.coalesce(gap < threshold_ms, F.lit(False)))


def close_gaps(cues: DataFrame, cfg: PostprocessConfig = PostprocessConfig()) -> DataFrame:
    """Close gaps within the limits: a cue lasts until the next one, or both meet."""
    inside = lambda gap: F.coalesce(gap.between(cfg.min_gap_ms, cfg.max_gap_ms), F.lit(False))
    if cfg.gap_mode == "midpoint":
        return _move_boundaries(cues, inside)
    c = with_word_level(cues)
    end = F.when(inside(lead("start_ms") - F.col("end_ms")) & ~F.col("word_level"), lead("start_ms")).otherwise(F.col("end_ms"))
    return c.withColumn("end_ms", end).drop("word_level")


def compensation(gap: Column, cfg: PostprocessConfig = PostprocessConfig()) -> Column:
    """Time to add before a gap: none for closable ones, then rising with the gap up to the limit."""
    rise, span = cfg.max_compensation_ms - cfg.min_compensation_ms, cfg.max_compensation_gap_ms - cfg.max_gap_ms
    sloped = cfg.min_compensation_ms + F.bround(rise * (gap - cfg.max_gap_ms) / span).cast("long")
    return F.when(gap <= cfg.max_gap_ms, F.lit(0).cast("long")).when(gap >= cfg.max_compensation_gap_ms, F.lit(cfg.max_compensation_ms).cast("long")).otherwise(sloped)


def with_protection(cues: DataFrame, policy: SpeedPolicy = SpeedPolicy(), text: str = "text", explicit: Column | None = None, units: Column | None = None) -> DataFrame:
    """``protected_by``: why a cue may not be changed, the first that holds, else null. ``units``: the text's visible units, where they are measured already."""
    shown = F.col("end_ms") - F.col("start_ms")
    apart = lambda gap: F.coalesce(gap >= policy.rhythm.stop_ms, F.lit(True))
    alone = apart(F.col("start_ms") - lag("end_ms")) & apart(lead("start_ms") - F.col("end_ms"))
    c = cues.withColumn("units__", visible_units(text, policy) if units is None else units).withColumn("alone__", alone)
    why = (
        F.when(F.coalesce(explicit, F.lit(False)) if explicit is not None else F.lit(False), "explicit")
        .when(F.coalesce(F.col(text).rlike(MUSIC), F.lit(False)), "music_or_lyric_marker")
        .when((F.col("units__") <= 12) & (shown >= 4000), "short_text_long_display")
        .when((F.col("units__") <= 16) & (shown >= 2500) & F.col("alone__"), "isolated_title_card")
    )
    return c.withColumn("protected_by", why).drop("units__", "alone__")


def compensate_tails(cues: DataFrame, cfg: PostprocessConfig = PostprocessConfig(), policy: SpeedPolicy = SpeedPolicy(), text: str = "text") -> DataFrame:
    """Lengthen cues before long pauses, never past the longest display. Protected cues and word-level media stay."""
    c = with_protection(with_word_level(cues), policy, text)
    gap, room = lead("start_ms") - F.col("end_ms"), cfg.max_duration_ms - (F.col("end_ms") - F.col("start_ms"))
    extra = F.greatest(F.lit(0), F.least(compensation(gap, cfg), gap, room))
    ok = ~F.col("word_level") & F.col("protected_by").isNull() & gap.isNotNull() & (compensation(gap, cfg) > 0)
    return c.withColumn("end_ms", F.col("end_ms") + F.when(ok, extra).otherwise(0)).drop("word_level", "protected_by")


def with_rhythm(cues: DataFrame, reset_ms: int = 800, strict: bool = False, name: str = "rhythm_id") -> DataFrame:
    """Groups from 0 between pauses of ``reset_ms`` or more (of more than it, if ``strict``)."""
    gap = F.col("start_ms") - lag("end_ms")
    cut = F.when(gap > reset_ms if strict else gap >= reset_ms, 1).otherwise(0)
    return cues.withColumn("cut__", cut).withColumn(name, F.sum("cut__").over(in_order().rowsBetween(*_UPTO)).cast("int")).drop("cut__")


def overlaps(cues: DataFrame) -> DataFrame:
    """``(media_id, cue_idx, prev_idx, overlap_ms)`` for cues that start before the one before has ended."""
    c = cues.select("media_id", "cue_idx", lag("cue_idx").alias("prev_idx"), (lag("end_ms") - F.col("start_ms")).alias("overlap_ms"))
    return c.where(F.col("overlap_ms") > 0)


def largest_gap(cues: DataFrame) -> DataFrame:
    """``(media_id, max_gap_ms)``; 0 where no cue follows another after a pause."""
    gaps = cues.select("media_id", (lead("start_ms") - F.col("end_ms")).alias("gap"))
    return gaps.groupBy("media_id").agg(F.greatest(F.lit(0).cast("long"), F.max("gap")).alias("max_gap_ms"))


def with_context(cues: DataFrame, radius: int = 1) -> DataFrame:
    """``context``: the cue and its neighbours within ``radius``, in order."""
    one = F.struct("cue_idx", "start_ms", "end_ms", "text", "translated_text")
    return cues.withColumn("context", F.collect_list(one).over(in_order().rowsBetween(-radius, radius)))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges that cover the same time; touching ones merge, empty ones vanish."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    r = ranges.where(F.col("end_ms") > F.col("start_ms")).withColumn("seen", F.max("end_ms").over(w.rowsBetween(*_HEAD)))
    r = r.withColumn("island", F.sum(F.when(F.col("start_ms") > F.col("seen"), 1).otherwise(0)).over(w.rowsBetween(*_UPTO)))
    return r.groupBy("media_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def complement_ranges(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """What ``ranges`` leave free of ``[0, total_ms]`` of each media item in ``totals(media_id, total_ms)``."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    merged = merge_ranges(ranges).join(totals, "media_id")
    clipped = merged.select("media_id", "total_ms", F.greatest(F.lit(0), "start_ms").alias("start_ms"), F.least("total_ms", "end_ms").alias("end_ms")).where(F.col("end_ms") > F.col("start_ms"))
    heads = clipped.select("media_id", F.coalesce(F.lag("end_ms").over(w), F.lit(0).cast("long")).alias("a"), F.col("start_ms").alias("b"))
    tails = totals.join(clipped.groupBy("media_id").agg(F.max("end_ms").alias("last")), "media_id", "left").select("media_id", F.coalesce("last", F.lit(0).cast("long")).alias("a"), F.col("total_ms").alias("b"))
    return heads.unionByName(tails).where(F.col("b") > F.col("a")).select("media_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def linear_timing(pieces: DataFrame) -> DataFrame:
    """Times of ``pieces(media_id, pos, text, total_ms)`` by their share of words, each from the end of the one before and 1 ms long at least.

    The last one ends at the total, or later where there are more pieces than ms. An end that a longer share can't reach
    follows from the furthest one before: shares less their place, at their highest so far, plus the place.
    """
    w = Window.partitionBy("media_id").orderBy("pos")
    p = pieces.withColumn("weight", F.greatest(F.lit(1), count_words("text"))).withColumn("place", F.row_number().over(w))
    p = p.withColumn("upto", F.sum("weight").over(w.rowsBetween(*_UPTO))).withColumn("all", F.sum("weight").over(Window.partitionBy("media_id")))
    share = F.bround(F.greatest(F.lit(1).cast("long"), "total_ms") * F.col("upto") / F.col("all")).cast("long")
    p = p.withColumn("end_ms", F.col("place") + F.greatest(F.lit(0).cast("long"), F.max(share - F.col("place")).over(w.rowsBetween(*_UPTO))))
    return p.select("media_id", "pos", "text", F.coalesce(F.lag("end_ms").over(w), F.lit(0).cast("long")).alias("start_ms"), "end_ms")


#: A word, or one character of a script without spaces.
WORD_PIECE = r"[a-zA-ZÀ-ÿĀ-ſ']+|[Ѐ-ӿ]+|[Ͱ-Ͽ]+|[؀-ۿ]+|[֐-׿]+|\d+|[一-鿿]|[぀-ゟ]|[゠-ヿ]|[가-힯]|[฀-๿][ะ-ฺ็-๎]*|[ऀ-ॿ]|[ঀ-৿]|[຀-໿]|[က-႟]"


def _word_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media, cue, start, end, lists, *also = b.columns
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row, words = np.repeat(np.arange(len(size)), size), pc.list_flatten(lists)
        s, e = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (start, end))
        first = np.cumsum(size) - size
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        weight = -(-pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
        total = sums(weight)[first + size] - sums(weight)[first]
        took = np.floor(((e - s) / np.maximum(total, 1))[row] * weight).astype(np.int64)
        upto = sums(took)[1:] - sums(took)[first][row]
        known = pa.array(pc.and_(pc.is_valid(start), pc.is_valid(end)).to_numpy(zero_copy_only=False)[row])
        # A cue without a time gives its words its end.
        at = [pc.if_else(known, pa.array(np.minimum(s[row] + x, e[row])), end.take(pa.array(row))) for x in (upto - took, upto)]
        yield pa.RecordBatch.from_arrays([media.take(pa.array(row)), cue.take(pa.array(row)), pa.array(np.arange(len(row)) - first[row], pa.int32()), *at, words, *(c.take(pa.array(row)) for c in also)], names=["media_id", "cue_idx", "pos", "start_ms", "end_ms", "text", *b.schema.names[5:]])


def split_words(cues: DataFrame, *also: str) -> DataFrame:
    """A cue for each word, its time by the share of four-letter syllables, cut at whole milliseconds; columns ``also`` go along.

    Times are worked out within each cue's list of words, so words are neither shuffled nor sorted.
    """
    words = cues.select("media_id", "cue_idx", "start_ms", "end_ms", F.regexp_extract_all("text", F.lit(WORD_PIECE), F.lit(0)).alias("w"), *also)
    kinds, more = (", ".join(f"{n} {words.schema[n].dataType.simpleString()}" for n in names) for names in (("media_id", "cue_idx"), also))
    return words.mapInArrow(_word_times, f"{kinds}, pos int, start_ms long, end_ms long, text string" + (f", {more}" if also else ""))


def chunk_spans(media: DataFrame, length_ms: int = 600_000, overlap_ms: int = 10_000) -> DataFrame:
    """Spans of fixed length that overlap, up to the first that reaches the end of ``media(media_id, total_ms)``."""
    step = length_ms - overlap_ms
    last = F.greatest(F.lit(0), F.ceil((F.col("total_ms") - length_ms) / step))
    s = media.where(F.col("total_ms") > 0).select("media_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_idx"))
    return s.select("media_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), (F.col("chunk_idx") * step).alias("start_ms"), F.least("total_ms", F.col("chunk_idx") * step + length_ms).alias("end_ms"))


#: Milliseconds of a cell of the time axis, by which ranges find each other.
CELL_MS = 60_000


def ranges_that_meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left(media_id, start_ms, end_ms, ..)`` with each range ``a`` to ``b`` of ``right(media_id, start_ms, end_ms)`` that overlaps theirs.

    Both sides are laid out over cells of the time axis and join by media item and cell; a pair counts in the first cell that
    both reach. So a long media item is many small keys, and ranges meet only those of their minutes.
    """
    cell = lambda at: F.floor(at / CELL_MS)
    cells = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo)), cell(F.greatest(F.col(hi) - 1, F.col(lo)))))
    r = right.select(F.col("media_id").alias("m__"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).withColumn("c__", cells("a", "b"))
    x = left.withColumn("cell__", cells("start_ms", "end_ms"))
    j = x.join(r, (F.col("media_id") == F.col("m__")) & (F.col("cell__") == F.col("c__")))
    j = j.where((F.col("a") < F.col("end_ms")) & (F.col("b") > F.col("start_ms")) & (F.col("cell__") == F.greatest(cell(F.col("start_ms")), cell(F.col("a")))))
    return j.drop("m__", "c__", "cell__")


def silence_boundary(searches: DataFrame, silences: DataFrame, min_silence_ms: int = 300) -> DataFrame:
    """Best cut for ``searches(media_id, search_id, start_ms, end_ms, target_ms)``: the middle of the overlap with a long enough silence, nearest the target, longest among equals."""
    lo, hi = F.greatest("start_ms", "a"), F.least("end_ms", "b")
    j = ranges_that_meet(searches, silences)
    j = j.withColumn("boundary_ms", F.floor((lo + hi) / 2).cast("long")).withColumn("len", hi - lo).where(F.col("len") >= min_silence_ms)
    best = F.min_by("boundary_ms", F.struct(F.abs(F.col("boundary_ms") - F.col("target_ms")), -F.col("len"), "boundary_ms"))
    return j.groupBy("media_id", "search_id").agg(best.alias("boundary_ms"))


def quiet_spans(spans: DataFrame, speech: DataFrame) -> DataFrame:
    """``spans`` with ``speech_ms`` inside and whether it is too little: under 250 ms, and under 0.5% of the span if that is more."""
    span = ["media_id", "chunk_idx", "start_ms", "end_ms"]
    each = spans.select(*span).distinct()
    inside = ranges_that_meet(each, merge_ranges(speech)).groupBy(*span).agg(F.sum(F.least("end_ms", "b") - F.greatest("start_ms", "a")).alias("inside__"))
    out = each.join(inside, span, "left").select(*span, F.coalesce("inside__", F.lit(0).cast("long")).alias("speech_ms"))
    return out.withColumn("quiet", F.col("speech_ms") < F.greatest(F.lit(250.0), (F.col("end_ms") - F.col("start_ms")) * 0.005))


def repair_windows(cues: DataFrame, size: int = 5) -> DataFrame:
    """``(media_id, window_no, first_idx, last_idx, n_cues)``: runs of unprotected cues of one rhythm, cut every ``size``, with an unresolved cue.

    Takes ``rhythm_id``, ``protected`` and ``unresolved`` columns.
    """
    cut = F.when(F.col("protected") | lag("protected") | (F.col("rhythm_id") != lag("rhythm_id")), 1).otherwise(0)
    c = cues.withColumn("cut__", cut).withColumn("run", F.sum("cut__").over(in_order().rowsBetween(*_UPTO))).where(~F.col("protected"))
    inside = Window.partitionBy("media_id", "run").orderBy("start_ms", "cue_idx")
    c = c.withColumn("part", F.floor((F.row_number().over(inside) - 1) / size))
    g = c.groupBy("media_id", "run", "part").agg(F.min("cue_idx").alias("first_idx"), F.max("cue_idx").alias("last_idx"), F.count(F.lit(1)).alias("n_cues"), F.bool_or("unresolved").alias("open"))
    g = g.where("open")
    return g.select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("run", "part")).alias("window_no"), "first_idx", "last_idx", "n_cues")


def with_batches(cues: DataFrame, size: int = 10) -> DataFrame:
    return cues.withColumn("batch_no", F.floor((F.row_number().over(in_order()) - 1) / size).cast("int"))


def partition_points(cues: DataFrame, words_per_part: int = 500, reach: int = 30) -> DataFrame:
    """``(media_id, part_no, cut_after)``: rows after which a long media item is cut: the first largest gap near each nominal point.

    Every row knows the best cut around it, by one sliding window, and makes the points that are nominally its own: no pairs
    of points and rows.
    """
    w = in_order()
    c = cues.select("media_id", "start_ms", "cue_idx", (F.row_number().over(w) - 1).cast("long").alias("row"), (lead("start_ms") - F.col("end_ms")).alias("gap"), count_words("text").alias("words"))
    c = c.withColumn("n", F.count(F.lit(1)).over(of_media())).withColumn("parts", F.ceil(F.sum("words").over(of_media()) / words_per_part).cast("long"))
    best = F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("row")).alias("before"), F.col("row").alias("at")))).over(w.rowsBetween(-reach, reach - 1))
    # Of the points part_no * n / parts, cut at whole rows, those that fall on this one.
    c = c.withColumn("best", best).withColumn("lo", F.expr("greatest(1L, (row * parts + n - 1) div n)")).withColumn("hi", F.expr("least(parts - 1, ((row + 1) * parts + n - 1) div n - 1)"))
    points = c.where((F.col("hi") >= F.col("lo")) & F.col("best").isNotNull())
    return points.select("media_id", F.explode(F.sequence("lo", "hi")).alias("part_no"), F.col("best.at").alias("cut_after"))


def safe_boundaries(cues: DataFrame, most_ms: int = 250) -> DataFrame:
    """``safe_after``: neither the words nor the cues on both sides lie apart by more than ``most_ms`` or overlap. Takes ``speech_start_ms`` and ``speech_end_ms``."""
    near = lambda gap: gap.between(0, most_ms)
    ok = near(lead("speech_start_ms") - F.col("speech_end_ms")) & near(lead("start_ms") - F.col("end_ms"))
    return cues.withColumn("safe_after", F.coalesce(ok, F.lit(False)))


def infer_offsets(chunks: DataFrame, overlap_ms: int = 10_000) -> DataFrame:
    """Offsets of ``chunks(media_id, chunk_idx, length_ms)``: each starts where the one before ends, less the overlap."""
    w = Window.partitionBy("media_id").orderBy("chunk_idx")
    # Offsets are sums of steps that never fall under 0: the sum so far, less the least sum up to here where that is negative.
    upto = F.coalesce(F.sum(F.col("length_ms") - overlap_ms).over(w.rowsBetween(*_HEAD)), F.lit(0).cast("long"))
    c = chunks.withColumn("sum__", upto)
    return c.withColumn("offset_ms", F.col("sum__") - F.least(F.lit(0).cast("long"), F.min("sum__").over(w.rowsBetween(*_UPTO)))).drop("sum__")
