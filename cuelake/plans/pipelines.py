"""Whole flows: repair of cues, rewrites with rollback, and request rows for translation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cues import in_order
from ..functions.similarity import meaning_kept, sequence_ratio
from ..functions.text import audit_chars, count_words, mainly_cjk, reading_load, squeeze, trim_weak_line, trim_weak_tail
from ..operators import edit, filters, joins, metrics, structure, windows
from ..policy import PostprocessConfig, SpeedPolicy, speed_policy
from ..sources.writers import change_log
from ..storage import keep


@dataclass
class Repaired:
    """Results of ``postprocess``; the reports on ``before`` and ``cues`` are worked out when they are asked for."""

    before: DataFrame
    cues: DataFrame
    cfg: PostprocessConfig

    @cached_property
    def changes(self) -> DataFrame:
        return change_log(self.before, self.cues, "postprocess")

    @cached_property
    def issues(self) -> DataFrame:
        return metrics.audit(self.cues, self.cfg)

    @cached_property
    def metrics_before(self) -> DataFrame:
        return metrics.speed_metrics(self.before, speed_policy(self.cfg.speed_preset))

    @cached_property
    def metrics_after(self) -> DataFrame:
        return metrics.speed_metrics(self.cues, speed_policy(self.cfg.speed_preset))


_COLS = ("media_id", "cue_idx", "start_ms", "end_ms", "text", "translated_text")


def normalize(cues: DataFrame, cfg: PostprocessConfig) -> DataFrame:
    """Quotes as corner brackets and wider trimming for scripts without spaces; else just the full-width comma and stop go."""
    if cfg.normalize_quotes:
        c = edit.normalize_quotes(cues)
        trim = lambda x: F.when(mainly_cjk(x), trim_weak_line(x)).otherwise(trim_weak_tail(x))
        return c.withColumn("text", trim("text")).withColumn("translated_text", trim("translated_text")) if cfg.trim_trailing_punct else c
    return filters.trim_tails(cues) if cfg.trim_trailing_punct else cues


def speed_pass(cues: DataFrame, policy: SpeedPolicy, evidence: DataFrame | None = None, rewrites: DataFrame | None = None) -> DataFrame:
    """Times, then cue structure where ``evidence`` (as ``word_evidence`` gives it) allows, then accepted rewrites that make the times better.

    ``rewrites(window_no, media_id, attempt, cue_idx, text)``: candidates for ``repair_windows`` of the cues as they are then.
    """
    c = cues.select(*_COLS)
    if evidence is not None:
        timed = c.join(structure.evidence_bounds(evidence, policy), ["media_id", "cue_idx"], "left")
        c = edit.optimize_timing(keep(timed, "before-speed"), policy)[0].select(*_COLS)
        c = structure.edit_structure(c, evidence, policy)[0].select(*_COLS)
    else:
        c = edit.optimize_timing(c, policy)[0].select(*_COLS)
    return c if rewrites is None else structure.accept_repairs(c, repairs_of(c, rewrites, policy), policy)[0]


def repairs_of(cues: DataFrame, rewrites: DataFrame, policy: SpeedPolicy) -> DataFrame:
    """``(media_id, window_no, cue_ids, texts)``: for each window that needs repair its first acceptable rewrite."""
    c = windows.with_protection(windows.with_rhythm(cues, policy.rhythm.pause_ms), policy).withColumn("protected", F.col("protected_by").isNotNull())
    load = reading_load("text", F.col("end_ms") - F.col("start_ms"), policy)["hard_load"]
    w = windows.repair_windows(c.withColumn("unresolved", F.coalesce(load > 1, F.lit(False))))
    rows = structure.cues_of_windows(w, cues, "text")
    name = F.concat_ws("/", F.col("media_id").cast("string"), F.col("window_no").cast("string"))
    idx = F.format_string("%010d", F.col("cue_idx"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", F.col(c).alias("v")))), lambda x: x["v"])
    asked = rows.withColumn("key", idx).groupBy("media_id", "window_no").agg(in_order("key").alias("cue_ids"), F.array_join(in_order("text"), "\n").alias("before")).withColumn("window_id", name)
    taken = accept_rewrites(asked, rewrites.select(name.alias("window_id"), "attempt", idx.alias("cue_id"), "text"))
    taken = taken.where(F.col("verdict") == "accepted").join(asked.select("window_id", "media_id", "window_no", "cue_ids"), "window_id")
    return taken.select("media_id", "window_no", F.transform("cue_ids", lambda x: x.cast("int")).alias("cue_ids"), "texts")


def _whole(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, but media items that break a rule they did not break before stay as they were."""
    known = filters.integrity(before).select("media_id", "cue_idx", "problem")
    broken = filters.integrity(after).join(known, ["media_id", "cue_idx", "problem"], "left_anti").select("media_id").distinct()
    return after.join(broken, "media_id", "left_anti").unionByName(before.select(*_COLS).join(broken, "media_id", "left_semi"))


def postprocess(cues: DataFrame, cfg: PostprocessConfig = PostprocessConfig(), evidence: DataFrame | None = None, rewrites: DataFrame | None = None) -> Repaired:
    """Placeholders, normal form, gaps, speed, normal form again, tails, audit. A media item that a stage breaks keeps what the stage got.

    Tails come last of all that moves times. ``evidence`` and ``rewrites`` serve the speed pass, where that is on.
    """
    policy = speed_policy(cfg.speed_preset)
    c = cues.select(*_COLS)
    if cfg.remove_placeholders:
        c = filters.remove_placeholders(c, cfg.extra_placeholders).where(F.col("action") != "drop").drop("action")
    c = normalize(c, cfg)
    if cfg.fix_gaps:
        c = windows.close_gaps(c, cfg)
    if cfg.speed_optimize:
        c = keep(c.select(*_COLS), "gaps")
        c = normalize(_whole(c, speed_pass(c, policy, evidence, rewrites)), cfg)
    if cfg.tail_compensation:
        c = windows.compensate_tails(keep(c.select(*_COLS), "before-tails"), cfg, policy)
    c = keep(c.select(*_COLS), "repaired")
    return Repaired(cues, _whole(cues, c), cfg)


def accept_rewrites(windows_: DataFrame, candidates: DataFrame, most_graphemes: int = 84, attempts: int = 3) -> DataFrame:
    """The first acceptable rewrite of each window, or none: ``(window_id, attempt, after, texts, verdict, reasons)``; ``texts`` are those of the cues in order.

    ``windows_``: ``window_id, cue_ids, before``; ``candidates``: ``window_id, attempt, cue_id, text``. A candidate must name each
    cue once, leave none empty, change something, fit the limit and keep the meaning; those in review are kept as such.
    """
    per = candidates.where(F.col("attempt") <= attempts).groupBy("window_id", "attempt").agg(
        F.array_sort(F.collect_list("cue_id")).alias("ids"), F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "text"))), lambda x: x["text"]).alias("texts"),
    )
    j = windows_.join(per, "window_id").withColumn("after", F.array_join("texts", "\n"))
    fits = ~F.exists("texts", lambda t: (F.length(squeeze(t)) == 0) | (F.size(F.regexp_extract_all(t, F.lit(r"\X"), F.lit(0))) > most_graphemes))
    j = j.where((F.col("ids") == F.array_sort("cue_ids")) & fits & (F.col("after") != F.col("before")))
    j = j.withColumn("m", meaning_kept("before", "after")).select("window_id", "attempt", "after", "texts", "m.verdict", "m.reasons").where(F.col("verdict").isin("accepted", "review"))
    first = F.min_by(F.struct("attempt", "after", "texts", "verdict", "reasons"), F.struct(F.col("verdict") != "accepted", F.col("attempt")))
    return j.groupBy("window_id").agg(first.alias("r")).select("window_id", "r.*")


def apply_compressions(cues: DataFrame, candidates: DataFrame, cfg: PostprocessConfig = PostprocessConfig()) -> DataFrame:
    """Cues with ``candidates(media_id, cue_idx, side, text)`` that fit their limit and stay similar (0.3) to what they replace."""
    want = metrics.compression_candidates(cues, cfg).select("media_id", "cue_idx", "side", "limit")
    c = candidates.withColumnRenamed("text", "short").join(want, ["media_id", "cue_idx", "side"]).join(cues.select("media_id", "cue_idx", "text", "translated_text"), ["media_id", "cue_idx"])
    old = F.when(F.col("side") == 0, F.col("text")).otherwise(F.col("translated_text"))
    ok = c.where((F.length(squeeze("short")) > 0) & (audit_chars("short", mainly_cjk("short")) <= F.col("limit"))).where(sequence_ratio(old, F.col("short")) >= 0.3)
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("short")))
    fixes = ok.groupBy("media_id", "cue_idx").agg(pick(0).alias("a"), pick(1).alias("b"))
    return cues.join(fixes, ["media_id", "cue_idx"], "left").withColumn("text", F.coalesce("a", "text")).withColumn("translated_text", F.coalesce("b", "translated_text")).drop("a", "b")


def check_corrections(batch: DataFrame, corrected: DataFrame) -> DataFrame:
    """``(media_id, cue_idx, problem)`` of corrected texts: missing, extra, or too unlike the source (0.7; 0.3 up to ten words)."""
    keys = joins.key_differences(batch, corrected, ["media_id", "cue_idx"])
    j = batch.select("media_id", "cue_idx", "text").join(corrected.select("media_id", "cue_idx", "correction"), ["media_id", "cue_idx"])
    least = F.when(count_words("text") <= 10, 0.3).otherwise(0.7)
    return keys.unionByName(j.where(sequence_ratio("text", "correction") < least).select("media_id", "cue_idx", F.lit("too_different").alias("problem")))


def check_segmentation(source: DataFrame, parts: DataFrame, most_words: int = 18, most_cjk: int = 25) -> DataFrame:
    """``(media_id, similar, fits)`` of proposed parts ``(media_id, pos, text)`` against the source: 0.96 alike as a whole, each within a line."""
    p = parts.groupBy("media_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("joined"),
        F.bool_and(count_words("text") <= F.when(mainly_cjk("text"), most_cjk).otherwise(most_words)).alias("fits"),
    )
    return source.join(p, "media_id").select("media_id", (sequence_ratio(squeeze("text"), squeeze("joined")) >= 0.96).alias("similar"), "fits")


def request_rows(cues: DataFrame, glossary: DataFrame, prefix: str, size: int = 10, budget: int = 2000) -> DataFrame:
    """``(media_id, window_no, prefix, payload, problem)``: one row for each translation batch, with its terms; the prefix never varies.

    A batch with a ``problem`` (one cue over the budget) has no payload.
    """
    order = F.row_number().over(in_order()) - 1
    c = keep(cues.select("media_id", "cue_idx", "start_ms", "text", order.alias("pos")), "ordered-cues")
    b = keep(edit.translation_rows(c, size, budget), "batch-rows")
    terms = joins.term_hits(c, glossary).join(b.where(F.col("part") == 0).select("media_id", "cue_idx", "window_no"), ["media_id", "cue_idx"])
    named = glossary.select("entry_id", F.struct("source_term", "translation").alias("term"))
    # Terms of a batch, its rows and its texts go through one shuffle by media item.
    t = terms.join(named, "entry_id").groupBy("media_id", "window_no").agg(F.collect_set("term").alias("terms"))
    one = F.struct("cue_idx", F.struct(F.col("cue_idx").cast("string").alias("id"), F.col("text").alias("text")).alias("v"))
    rows = b.select("media_id", "pos", "window_no", "part", "problem").unionByName(t, True).unionByName(c.select("media_id", "pos", one.alias("one")), True).repartition("media_id")
    rows = rows.withColumn("one", F.max("one").over(Window.partitionBy("media_id", "pos"))).where(F.col("window_no").isNotNull())

    def texts(part: int) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("one")))), lambda x: x["v"])

    g = rows.groupBy("media_id", "window_no").agg(F.max("problem").alias("problem"), texts(-1).alias("before"), texts(1).alias("after"), texts(0).alias("subjects"), F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))
    payload = F.struct(F.struct("after", "before").alias("boundary_context"), F.col("terms"), F.col("subjects").alias("translation_subjects"))
    return g.select("media_id", "window_no", F.lit(prefix).alias("prefix"), F.when(F.col("problem").isNull(), F.to_json(payload)).alias("payload"), "problem")
