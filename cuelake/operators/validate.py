"""Checks of translations and rewrites, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import term_key
from ..functions.text import strip
from .joins import token_differences


def _blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def local_issues(cues: DataFrame) -> DataFrame:
    """``(media_id, cue_idx, category)``: empty translation, copied source, a protected token missing."""
    text, tr = F.col("text"), F.coalesce(F.col("translated_text"), F.lit(""))
    missing = token_differences(text, tr)
    categories = F.array_compact(
        F.array(
            F.when(_blank(tr), "empty_translation"),
            F.when(~_blank(tr) & (F.lower(strip(text)) == F.lower(strip(tr))), "source_copied"),
            F.when(~_blank(tr) & (F.size(missing) > 0), "token_missing"),
        )
    )
    return cues.select("media_id", "cue_idx", F.explode(categories).alias("category"))


def multiset_difference(left: DataFrame, right: DataFrame, by: list[str], item: str) -> DataFrame:
    """``(by.., item, missing, added)``: how often an item occurs more often on the left, or on the right."""
    a = left.groupBy(*by, item).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*by, item).agg(F.count(F.lit(1)).alias("b"))
    n = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    d = a.join(b, [*by, item], "full").select(*by, item, F.greatest(F.lit(0).cast("long"), n).alias("missing"), F.greatest(F.lit(0).cast("long"), -n).alias("added"))
    return d.where((F.col("missing") > 0) | (F.col("added") > 0))


def dispositions(issues: DataFrame) -> DataFrame:
    return issues.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def apply_fixes(cues: DataFrame, issues: DataFrame, accepted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cues with the last valid suggestion of each, and the issues with their disposition.

    ``issues``: ``media_id, cue_idx, issue_no, suggested_translation``. A suggestion is valid if it isn't blank, differs from
    the translation and keeps the source's protected tokens. With ``accepted(media_id, issue_no)`` only those are applied.
    """
    j = issues.join(cues.select("media_id", "cue_idx", "text", "translated_text"), ["media_id", "cue_idx"], "left")
    if accepted is not None:
        j = j.join(accepted.select("media_id", "issue_no").withColumn("ok__", F.lit(True)), ["media_id", "issue_no"], "left")
    else:
        j = j.withColumn("ok__", F.lit(True))
    s = F.col("suggested_translation")
    why = (
        F.when(F.col("text").isNull(), "unknown_cue")
        .when(_blank(s), "no_suggestion")
        .when(s == F.col("translated_text"), "unchanged")
        .when(F.size(token_differences(F.col("text"), s)) > 0, "invalid")
        .when(F.coalesce("ok__", F.lit(False)), "applied")
        .otherwise("declined")
    )
    j = j.withColumn("disposition", why)
    last = j.where(F.col("disposition") == "applied").groupBy("media_id", "cue_idx").agg(F.max_by("suggested_translation", "issue_no").alias("fix"))
    fixed = cues.join(last, ["media_id", "cue_idx"], "left").withColumn("translated_text", F.coalesce("fix", "translated_text")).drop("fix")
    return fixed, j.drop("text", "translated_text", "ok__")


#: Categories that a model's issue may name.
CATEGORIES = ("terminology", "mistranslation", "omission", "addition", "number", "grammar", "style", "consistency")


def check_model_issues(issues: DataFrame, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues whose cue exists, is named once, has known categories and a message; and the rest with the reason."""
    known = cues.select("media_id", "cue_idx").withColumn("known__", F.lit(True))
    n = issues.groupBy("media_id", "cue_idx").agg(F.count(F.lit(1)).alias("n__"))
    j = issues.join(known, ["media_id", "cue_idx"], "left").join(n, ["media_id", "cue_idx"], "left")
    odd = F.size(F.array_except("categories", F.array(*[F.lit(c) for c in CATEGORIES]))) > 0
    why = F.when(F.col("known__").isNull(), "unknown_cue").when(F.col("n__") > 1, "repeated_cue").when((F.size("categories") == 0) | odd, "unknown_category").when(_blank(F.col("message")), "no_message")
    j = j.withColumn("reason", why).drop("known__", "n__")
    return j.where(F.col("reason").isNull()).drop("reason"), j.where(F.col("reason").isNotNull())


def term_decisions(candidates: DataFrame, proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(candidate_id, decision, translation)``: accepted, corrected, the source itself, or not a term."""
    j = candidates.join(proposals.select("candidate_id", "proposed"), "candidate_id", "left").join(reviews.select("candidate_id", "verdict", "corrected"), "candidate_id", "left")
    decision = F.when(F.col("verdict") == "not_a_term", "not_a_term").when((F.col("verdict") == "correct") & ~_blank(F.col("corrected")), "corrected").when((F.col("verdict") == "accept") & ~_blank(F.col("proposed")), "accepted").otherwise("source_fallback")
    text = F.when(decision == "corrected", F.col("corrected")).when(decision == "accepted", F.col("proposed")).when(decision == "source_fallback", F.col("term"))
    return j.select("candidate_id", decision.alias("decision"), text.alias("translation"))


def resolve_reviews(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Windows in review settled by ``decisions(window_id, decision)``: accepted, rejected, or rejected for want of one."""
    j = verdicts.join(decisions.select("window_id", "decision"), "window_id", "left")
    out = F.when(F.col("verdict") != "review", F.col("verdict")).when(F.col("decision") == "accept", "accepted").otherwise("rejected")
    reason = F.when((F.col("verdict") == "review") & F.col("decision").isNull(), "review_unavailable").when((F.col("verdict") == "review") & (F.col("decision") != "accept"), "review_rejected").otherwise(F.col("reason"))
    return j.select("window_id", out.alias("verdict"), reason.alias("reason"))


def dedup_terms(candidates: DataFrame) -> DataFrame:
    """One row for each (term, sense) in normal form: the first candidate, all aliases in order of candidates, all occurrences sorted."""
    c = candidates.withColumn("k1", term_key("term")).withColumn("k2", term_key(F.coalesce("sense", F.lit(""))))
    g = c.groupBy("k1", "k2").agg(
        F.min_by(F.struct("candidate_id", "term", "sense"), "candidate_id").alias("first"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "aliases"))), lambda x: x["aliases"]))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("occurrences")))).alias("occurrences"),
    )
    return g.select("first.candidate_id", "first.term", "first.sense", "aliases", "occurrences")
