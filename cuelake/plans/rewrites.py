"""Rewrites in rounds: every answer judged cue by cue, and what was rejected asked again with the reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import meaning_kept
from ..functions.text import graphemes, strip
from ..operators.edit import spread
from ..storage import keep

#: Fixed value: a first answer and two more after feedback.
ATTEMPTS = 3


@dataclass
class Round:
    """What a round of answers leaves: texts that hold, windows that wait for a review, windows to ask again, and windows that stay as they were."""

    accepted: DataFrame
    reviews: DataFrame
    requests: DataFrame
    given_up: DataFrame
    history: DataFrame


def judge(targets: DataFrame, answers: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``(window_id, attempt, verdict, feedback)`` of every answer to a window: accepted, review, unresolved or rolled_back.

    ``targets(window_id, cue_id, before, most_graphemes)``: the cues that are to be changed, the limit null where there is none.
    ``answers(window_id, attempt, cue_id, text)``; attempts count from 1, one without rows is no answer. An answer must name each
    target once and nothing else, leave none blank or as it was, and fit the limits, else it is ``unresolved``. Then each cue's
    meaning is compared with its own text, so that one cue cannot make up for another; the worst verdict counts. Waiting
    reviews are settled by ``decisions(window_id, attempt, decision)``: accept, or else rolled back. ``feedback`` is sorted:
    ``cue_id: reason`` each, and of the whole answer ``missing: ..`` and ``extra: ..``. Null texts count as blank; answers to
    unknown windows are left out; equal target rows count once.
    """
    t = targets.where(F.col("window_id").isNotNull()).select("window_id", "cue_id", F.struct(strip(F.coalesce("before", F.lit(""))).alias("before"), "most_graphemes").alias("target"))
    a = answers.where(F.col("window_id").isNotNull() & F.col("attempt").isNotNull()).select("window_id", "attempt", "cue_id", strip(F.coalesce("text", F.lit(""))).alias("after"))
    # One shuffle of texts by window serves all that follows: which attempts there are, what meets what, and whether it is formed.
    rows, w = spread(t.unionByName(a, True), "window_id"), Window.partitionBy("window_id")
    rows = rows.withColumn("tries", F.collect_set("attempt").over(w)).withColumn("known", F.count("target").over(w) > 0).where("known")
    asked = F.col("target").isNotNull()
    rows = rows.select("window_id", "cue_id", "target", "after", F.explode(F.when(asked, F.col("tries")).otherwise(F.array("attempt"))).alias("attempt"), (asked & F.col("cue_id").isNull()).alias("nameless"))
    j = rows.groupBy("window_id", "attempt", "cue_id", "nameless").agg(F.collect_set("target").alias("targets"), F.count("after").alias("n"), F.max("after").alias("after"))
    j = j.select("window_id", "attempt", "cue_id", "n", "after", F.explode_outer("targets").alias("target")).select("window_id", "attempt", "cue_id", "n", "after", "target.before", "target.most_graphemes")
    size = F.size(graphemes("after"))
    why = F.array_compact(
        F.array(
            F.when(F.col("before").isNull(), "extra"),
            F.when(F.col("after").isNull(), "missing"),
            F.when(F.col("n") > 1, "repeated"),
            F.when(F.col("after") == "", "blank"),
            F.when(F.col("after") == F.col("before"), "unchanged"),
            F.when((F.length("after") > F.col("most_graphemes")) & (size > F.col("most_graphemes")), F.concat(size.cast("string"), F.lit(" graphemes, at most "), F.col("most_graphemes").cast("string"))),
        )
    )
    j = j.withColumn("why", F.when(F.col("before").isNull() | F.col("after").isNull(), F.slice(why, 1, 1)).otherwise(why))
    # Only answers of the right form are read for their meaning, which is the dear part.
    formed = F.max(F.size("why")).over(Window.partitionBy("window_id", "attempt")) == 0
    j = j.withColumn("formed", formed)
    j = j.withColumn("m", meaning_kept(F.when(F.col("formed"), F.col("before")), F.when(F.col("formed"), F.col("after"))))
    rank = F.when(~F.col("formed"), 4).when(F.col("m.verdict") == "rolled_back", 3).when(F.col("m.verdict") == "unresolved", 2).when(F.col("m.verdict") == "review", 1).otherwise(0)
    told = lambda reasons: F.transform(reasons, lambda r: F.concat_ws(": ", F.col("cue_id").cast("string"), r))
    g = j.groupBy("window_id", "attempt").agg(F.max(rank).alias("rank"), F.array_sort(F.flatten(F.collect_list(told(F.col("why"))))).alias("form"), F.array_sort(F.flatten(F.collect_list(told(F.col("m.reasons"))))).alias("meaning"))
    verdict = F.when(F.col("rank").isin(2, 4), "unresolved").when(F.col("rank") == 3, "rolled_back").when(F.col("rank") == 1, "review").otherwise("accepted")
    g = g.select("window_id", "attempt", verdict.alias("verdict"), F.when(F.col("rank") == 4, F.col("form")).otherwise(F.col("meaning")).alias("feedback"))
    if decisions is None:
        return g
    g = g.join(decisions.select("window_id", "attempt", "decision").dropDuplicates(["window_id", "attempt"]), ["window_id", "attempt"], "left")
    asked = (F.col("verdict") == "review") & F.col("decision").isNotNull()
    settled = F.when(asked & (F.col("decision") == "accept"), "accepted").when(asked, "rolled_back").otherwise(F.col("verdict"))
    return g.select("window_id", "attempt", settled.alias("verdict"), F.when(asked & (F.col("decision") != "accept"), F.concat("feedback", F.array(F.lit("review: rejected")))).otherwise(F.col("feedback")).alias("feedback"))


def settle(targets: DataFrame, answers: DataFrame, decisions: DataFrame | None = None, attempts: int = ATTEMPTS) -> Round:
    """All windows after the answers so far, each as its own transaction.

    Attempts count in their order up to the first that is accepted or waits for a review; later ones are not looked at.
    ``accepted(window_id, attempt, cue_id, text)``; ``reviews(window_id, attempt, feedback)``; ``requests(window_id, attempt,
    feedback)``: the next attempt and all feedback so far, oldest first, of windows with attempts left, those without any answer
    included; ``given_up(window_id, attempts, verdict, feedback)``: those without. ``history`` is what ``judge`` gives, written once for all four.
    """
    judged = keep(judge(targets, answers.where(F.col("attempt").between(1, attempts)), decisions), "rewrites-judged")
    w = Window.partitionBy("window_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.col("verdict").isin("accepted", "review")
    used = judged.withColumn("over", F.coalesce(F.bool_or(ended).over(w), F.lit(False))).where(~F.col("over")).drop("over")
    end = used.groupBy("window_id").agg(
        F.max("attempt").alias("attempt"), F.max_by("verdict", "attempt").alias("verdict"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "feedback"))), lambda x: x["feedback"])).alias("feedback"), F.max_by("feedback", "attempt").alias("latest"),
    )
    every = targets.select("window_id").distinct().join(end, "window_id", "left")
    taken = every.where(F.col("verdict") == "accepted").select("window_id", "attempt")
    texts = answers.join(taken, ["window_id", "attempt"]).select("window_id", "attempt", "cue_id", strip("text").alias("text"))
    failed = F.coalesce(~F.col("verdict").isin("accepted", "review"), F.lit(True))
    last = F.coalesce("attempt", F.lit(0))
    return Round(
        texts,
        every.where(F.col("verdict") == "review").select("window_id", "attempt", F.col("latest").alias("feedback")),
        every.where(failed & (last < attempts)).select("window_id", (last + 1).alias("attempt"), F.coalesce("feedback", F.array().cast("array<string>")).alias("feedback")),
        every.where(failed & (last >= attempts)).select("window_id", F.col("attempt").alias("attempts"), "verdict", "feedback"),
        judged,
    )
