"""Reading-speed samples, metrics, audits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cues import in_order, lag, lead
from ..functions.text import count_words, line_measure, mainly_cjk, once, reading_load, strip
from ..policy import PostprocessConfig, SpeedPolicy
from ..storage import keep
from .windows import with_protection, with_rhythm


def samples(cues: DataFrame, policy: SpeedPolicy = SpeedPolicy(), text: str = "text") -> DataFrame:
    """``(media_id, cue_idx, start_ms, duration_ms, rhythm_id, units, comfort_s, hard_s, comfort_load, hard_load)``, one row a cue."""
    c = with_rhythm(cues, policy.rhythm.pause_ms) if "rhythm_id" not in cues.columns else cues
    load = reading_load(text, F.col("end_ms") - F.col("start_ms"), policy)
    c = c.withColumn("load", load).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    return c.select("media_id", "cue_idx", "start_ms", "duration_ms", "rhythm_id", "load.units", "load.comfort_s", "load.hard_s", "load.comfort_load", "load.hard_load")


def weighted_percentiles(rows: DataFrame, by: list[str], value: str, weight: str, tie: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank weighted percentiles of each group: the first value, ordered by (value, tie), whose summed weight reaches the share.

    Values that are null or not finite and weights of zero or less don't count; a group without others has no row.
    """
    bad = F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf"))
    ok = rows.where(F.col(value).isNotNull() & ~bad & (F.col(weight) > 0))
    w = Window.partitionBy(*by)
    ok = ok.withColumn("upto__", F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all__", F.sum(weight).over(w))
    return ok.groupBy(*by).agg(*[F.min(F.when(F.col("upto__") >= q * F.col("all__"), F.col(value))).alias(name) for name, q in quantiles.items()])


def hard_deficit(s: DataFrame) -> DataFrame:
    """``(media_id, hard_deficit, unresolved_hard, invalid)``: display time missing at the hard limit, as a share of the time required."""
    valid = F.col("comfort_load").isNotNull()
    need = F.sum(F.when(valid, F.col("hard_s")))
    lack = F.sum(F.when(valid, F.greatest(F.lit(0.0), F.col("hard_s") - F.col("duration_ms") / 1000)))
    return s.groupBy("media_id").agg(
        F.when(F.coalesce(need, F.lit(0.0)) == 0, 0.0).otherwise(lack / need).alias("hard_deficit"),
        F.count_if(valid & (F.col("hard_load") > 1)).alias("unresolved_hard"),
        F.count_if(~valid).alias("invalid"),
    )


def speed_spread(s: DataFrame) -> DataFrame:
    """``(media_id, speed_spread)``: P90 over P10 of comfort loads, weighted by duration; null under three positive loads."""
    positive = s.where(F.col("comfort_load") > 0)
    n = positive.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    p = weighted_percentiles(positive, ["media_id"], "comfort_load", "duration_ms", "cue_idx", {"p10": 0.1, "p90": 0.9})
    return n.join(p, "media_id").select("media_id", F.when(F.col("n") >= 3, F.col("p90") / F.col("p10")).alias("speed_spread"))


def jumps(s: DataFrame, policy: SpeedPolicy = SpeedPolicy()) -> DataFrame:
    """``(media_id, cue_idx, ratio)`` of neighbouring loads within a rhythm, where the higher one is felt at all."""
    low, high = F.least(lag("comfort_load"), F.col("comfort_load")), F.greatest(lag("comfort_load"), F.col("comfort_load"))
    both = lag("comfort_load").isNotNull() & F.col("comfort_load").isNotNull() & (lag("rhythm_id") == F.col("rhythm_id"))
    j = s.select("media_id", "cue_idx", F.when(both & (low > 0) & (high >= policy.jump.felt), high / low).alias("ratio"))
    return j.where(F.col("ratio").isNotNull())


def adjacent_jump(s: DataFrame, policy: SpeedPolicy = SpeedPolicy()) -> DataFrame:
    """``(media_id, compared, emergencies, jump_p90)``; the percentile needs two jumps."""
    j = jumps(s, policy).withColumn("one", F.lit(1))
    n = j.groupBy("media_id").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("ratio") > policy.jump.never).alias("emergencies"))
    p = weighted_percentiles(j, ["media_id"], "ratio", "one", "cue_idx", {"p90": 0.9})
    return n.join(p, "media_id").select("media_id", "compared", "emergencies", F.when(F.col("compared") >= 2, F.col("p90")).alias("jump_p90"))


def speed_metrics(cues: DataFrame, policy: SpeedPolicy = SpeedPolicy(), text: str = "text") -> DataFrame:
    """One metric row for each media item. Texts are measured once; the parts read the kept numbers."""
    s = keep(samples(cues, policy, text), "samples")
    zero = F.lit(0).cast("long")
    return (
        hard_deficit(s)
        .join(speed_spread(s), "media_id", "left")
        .join(adjacent_jump(s, policy), "media_id", "left")
        .select("media_id", "hard_deficit", "unresolved_hard", "invalid", "speed_spread", F.coalesce("compared", zero).alias("compared"), F.coalesce("emergencies", zero).alias("emergencies"), "jump_p90")
    )


def _median(items: Column, total: Column, least: int) -> Column:
    """Weighted nearest-rank median of a sorted ``array<struct<load, weight, id>>`` with summed weight ``total``; null under ``least`` items."""
    fold = F.aggregate(
        items,
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("out")),
        lambda s, x: F.struct((s["upto"] + x["weight"]).alias("upto"), F.when(s["out"].isNull() & (2 * (s["upto"] + x["weight"]) >= total), x["load"]).otherwise(s["out"]).alias("out")),
        lambda s: s["out"],
    )
    return F.when(F.size(items) >= least, fold)


def local_targets(cues: DataFrame, policy: SpeedPolicy = SpeedPolicy(), text: str = "text") -> DataFrame:
    """``(media_id, cue_idx, target_load)``: the median load of near neighbours in the rhythm, else of the rhythm, else of the media item, else 1."""
    c = with_protection(with_rhythm(cues, policy.rhythm.pause_ms), policy, text)
    c = c.withColumn("l", reading_load(text, F.col("end_ms") - F.col("start_ms"), policy))
    counts = F.col("protected_by").isNull() & (F.col("l.comfort_load") > 0) & (F.col("l.hard_load") <= 1)
    c = c.select("media_id", "cue_idx", "start_ms", "rhythm_id", F.when(counts, F.col("l.comfort_load")).alias("load"), (F.col("end_ms") - F.col("start_ms")).alias("weight"))
    c = keep(c, "loads")  # numbers only; five uses follow
    item = F.struct("load", "weight", F.col("cue_idx").alias("id"))
    near = Window.partitionBy("media_id").orderBy("start_ms", "cue_idx").rowsBetween(-policy.rhythm.neighbours, policy.rhythm.neighbours)
    around = F.collect_list(F.when(F.col("load").isNotNull(), F.struct("rhythm_id", item.alias("item")))).over(near)
    mine = F.transform(F.filter("around", lambda x: (x["rhythm_id"] == F.col("rhythm_id")) & (x["item"]["id"] != F.col("cue_idx"))), lambda x: x["item"])
    local = c.withColumn("around", around).withColumn("mine", F.array_sort(mine))
    local = local.withColumn("total", F.aggregate("mine", F.lit(0).cast("long"), lambda s, x: s + x["weight"]))
    local = local.withColumn("local", _median(F.col("mine"), F.col("total"), 3))
    flat = c.where(F.col("load").isNotNull()).select("media_id", "rhythm_id", "load", "weight", F.col("cue_idx").alias("id"))

    def medians(by: list[str], name: str) -> DataFrame:
        n = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        m = weighted_percentiles(flat, by, "load", "weight", "id", {"m": 0.5})
        return n.join(m, by).select(*by, F.when(F.col("n") >= 3, F.col("m")).alias(name))

    out = local.join(medians(["media_id", "rhythm_id"], "of_rhythm"), ["media_id", "rhythm_id"], "left").join(medians(["media_id"], "of_media"), "media_id", "left")
    return out.select("media_id", "cue_idx", F.greatest(F.lit(policy.jump.felt), F.coalesce("local", "of_rhythm", "of_media", F.lit(1.0))).alias("target_load"))


def sides(cues: DataFrame) -> DataFrame:
    """One row for each side of a cue that has text: ``side``, ``value``, ``is_cjk``, ``chars``, ``cps`` (null without duration)."""
    each = F.transform(F.array("text", "translated_text"), lambda v: F.struct(v.alias("value"), line_measure(v).alias("m")))
    c = cues.select("media_id", "cue_idx", "start_ms", "end_ms", F.posexplode(each).alias("side", "v"))
    c = c.select("media_id", "cue_idx", "start_ms", "end_ms", "side", "v.value", "v.m.is_cjk", "v.m.chars").where(F.col("chars") > 0)
    ms = F.col("end_ms") - F.col("start_ms")
    return c.withColumn("cps", F.when(ms > 0, F.col("chars") / (ms / 1000)))


def audit(cues: DataFrame, cfg: PostprocessConfig = PostprocessConfig()) -> DataFrame:
    """``(kind, media_id, cue_idx, is_cjk, chars, cps, duration_ms)``: hard and comfort rates by side, short, long, short text shown long, overlap.

    Each text is measured once, before the cues are put in order; from there on only numbers go along.
    """
    c = cues.select("media_id", "cue_idx", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.transform(F.array("text", "translated_text"), line_measure).alias("sides"))
    c = c.withColumn("late", F.col("start_ms") < F.lag("end_ms").over(in_order()))
    ms = F.col("duration_ms")
    cps = lambda chars: F.when(ms > 0, chars / (ms / 1000))

    def rate(x: Column) -> Column:
        hard = F.when(x["is_cjk"], cfg.max_cps_cjk).otherwise(cfg.max_cps_latin)
        comfort = F.when(x["is_cjk"], cfg.comfort_cps_cjk).otherwise(cfg.comfort_cps_latin)
        return F.struct(F.when(x["chars"] > 0, F.when(cps(x["chars"]) > hard, "hard").when(cps(x["chars"]) > comfort, "comfort")).alias("kind"), x["is_cjk"].alias("is_cjk"), x["chars"].alias("chars"))

    cjk = [(ms > 0) & F.col("sides")[i]["is_cjk"] for i in (0, 1)]
    any_cjk = cjk[0] | cjk[1]
    main = F.when(any_cjk, F.greatest(*[F.when(k, F.col("sides")[i]["chars"]).otherwise(0) for i, k in enumerate(cjk)])).otherwise(F.col("sides")[0]["stripped"])
    kinds = F.array(
        F.when((ms > 0) & (ms < cfg.min_duration_ms), "short"),
        F.when(ms > cfg.max_duration_ms, "long"),
        F.when((ms > cfg.short_text_max_duration_ms) & main.between(1, cfg.short_text_max_chars), "short_text_long"),
        F.when(F.col("late"), "overlap"),
    )
    timed = once(F.struct(any_cjk.alias("is_cjk"), main.alias("chars")), lambda x: F.transform(kinds, lambda k: F.struct(k.alias("kind"), x["is_cjk"].alias("is_cjk"), x["chars"].alias("chars"))))
    issues = F.filter(F.concat(F.transform("sides", rate), timed), lambda x: x["kind"].isNotNull())
    rows = c.select("media_id", "cue_idx", "duration_ms", F.explode(issues).alias("x"))
    return rows.select("x.kind", "media_id", "cue_idx", "x.is_cjk", "x.chars", cps(F.col("x.chars")).alias("cps"), "duration_ms")


def audit_counts(issues: DataFrame) -> DataFrame:
    """``(kind, is_cjk, n, media)``."""
    return issues.groupBy("kind", "is_cjk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("media_id").alias("media"))


def top_issues(issues: DataFrame, k: int = 40) -> DataFrame:
    """The k worst of each kind in each media item, with how many are left out: fastest first, or longest for long displays."""
    worst = F.when(F.col("kind").isin("long", "short_text_long"), F.col("duration_ms").cast("double")).otherwise(F.round("cps", 1))
    w = Window.partitionBy("media_id", "kind").orderBy(worst.desc(), "cue_idx", "chars", "is_cjk", "cps")
    r = issues.withColumn("rank", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("media_id", "kind")))
    return r.where(F.col("rank") <= k).withColumn("left_out", F.greatest(F.lit(0).cast("long"), F.col("total") - k)).drop("total")


def stage_counters(changes: DataFrame, k: int = 20) -> DataFrame:
    """``(stage, changed, samples)`` of ``changes(stage, media_id, cue_idx, sample)``: the count and the first k samples."""
    w = Window.partitionBy("stage").orderBy("media_id", "cue_idx", "sample")
    first = changes.groupBy("stage").agg(F.count(F.lit(1)).alias("changed"))
    ranked = changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    kept = ranked.groupBy("stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda x: x["sample"]).alias("samples"))
    return first.join(kept, "stage")


def usage(log: DataFrame) -> DataFrame:
    """Calls and token sums by role and stage, with totals by role and overall; sums of missing counts only are null."""
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    return log.rollup("role", "stage").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(f"usage.{t}").alias(t) for t in tokens], F.grouping_id().cast("int").alias("level"))


def alignment_problems(words: DataFrame, media: DataFrame) -> DataFrame:
    """``(media_id, coverage, problems)`` of timed ``words(media_id, start_ms, end_ms, text)`` against ``media(media_id, duration_ms, transcript)``."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    x = words.withColumn("gap", F.lead("start_ms").over(w) - F.col("end_ms")).join(media, "media_id")
    units = F.sum(F.greatest(F.lit(1), count_words("text")))
    g = x.groupBy("media_id", "duration_ms", "transcript").agg(
        units.alias("aligned"), F.max("end_ms").alias("last"), F.coalesce(F.max("gap"), F.lit(0).cast("long")).alias("gap"),
    )
    expected = count_words("transcript")
    g = g.withColumn("coverage", F.when(expected > 0, F.col("aligned") / expected))
    over, tail = F.col("last") - F.col("duration_ms"), F.col("duration_ms") - F.col("last")
    problems = F.array_compact(
        F.array(
            F.when((expected >= 20) & (F.col("coverage") < 0.7), "low_coverage"),
            F.when(over > F.col("duration_ms") * 0.05, "overflow"),
            F.when((tail > 15_000) & (F.col("last") < F.col("duration_ms") * 0.85), "early_end"),
            F.when(F.col("gap") > 30_000, "wide_gap"),
        )
    )
    return g.select("media_id", "coverage", problems.alias("problems"))


def repeated_ngrams(texts: DataFrame, key: str = "media_id", n: int = 10, least: int = 3) -> DataFrame:
    """``(key, most, repeated)``: how often the commonest n words (characters, for scripts without spaces) of a text occur."""
    t = F.coalesce(F.col("text"), F.lit(""))
    parts = F.when(mainly_cjk(t), F.filter(F.split(t, ""), lambda x: x.rlike(r"(?U)\S"))).otherwise(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9']+"), F.lit(0)))
    p = texts.select(key, parts.alias("parts"))
    grams = F.transform(F.sequence(F.lit(1), F.size("parts") - n + 1), lambda i: F.xxhash64(F.concat_ws("\x1f", F.slice("parts", i, n))))
    # Equal ones stand side by side once sorted: the longest stretch is counted within the row.
    none = F.lit(0).cast("long")
    longest = F.aggregate(
        F.array_sort(grams),
        F.struct(F.lit(None).cast("long").alias("last"), none.alias("run"), none.alias("most")),
        lambda s, g: F.struct(g.alias("last"), F.when(s["last"].eqNullSafe(g), s["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.greatest(s["most"], F.when(s["last"].eqNullSafe(g), s["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("most")),
        lambda s: s["most"],
    )
    return p.select(key, F.when(F.size("parts") >= n, longest).otherwise(none).alias("most")).withColumn("repeated", F.col("most") >= least)


def dense_transcript(text: Column, duration_ms: Column) -> Column:
    """Too many words for the time: over 5.5 a second, or 7 for scripts without spaces."""
    rate = count_words(text) / F.when(duration_ms > 0, duration_ms / 1000)
    return F.coalesce(rate > F.when(mainly_cjk(text), 7.0).otherwise(5.5), F.lit(False))


def dub_fit(segments: DataFrame) -> DataFrame:
    """Tempo of ``segments(media_id, idx, start_ms, end_ms, synthesized_ms, text)``: factor, fitted time, overflow, and whether a retry may help."""
    target = F.greatest(F.lit(100).cast("long"), F.col("end_ms") - F.col("start_ms") - 80)
    s = segments.withColumn("target_ms", target).withColumn("needed", F.col("synthesized_ms") / target)
    s = s.withColumn("speed_factor", F.greatest(F.lit(1.0), F.least(F.lit(1.35), "needed")))
    s = s.withColumn("fitted_ms", F.floor(F.col("synthesized_ms") / F.col("speed_factor")).cast("long"))
    return s.withColumn("retry", (F.col("needed") > 1.35) & (F.length(strip("text")) <= 40)).drop("needed")


def dub_totals(fitted: DataFrame) -> DataFrame:
    """``(media_id, timeline_ms, overflowing, compressed)``."""
    end = F.col("start_ms") + F.col("fitted_ms")
    return fitted.groupBy("media_id").agg(F.max(F.greatest("end_ms", end)).alias("timeline_ms"), F.count_if(end - F.col("end_ms") > 80).alias("overflowing"), F.count_if(F.col("speed_factor") > 1.0).alias("compressed"))


#: The order of grades.
GRADES = ("HIGH", "MEDIUM", "LOW")


def grade_counts(evidence: DataFrame) -> DataFrame:
    """``(media_id, grade, n)``: windows of evidence by grade, in the order of grades within a media item."""
    rank = F.array_position(F.array(*map(F.lit, GRADES)), F.col("grade"))
    return evidence.groupBy("media_id", "grade").agg(F.count(F.lit(1)).alias("n")).orderBy("media_id", rank)


def run_table(runs: DataFrame) -> DataFrame:
    """``runs(label, variant, return_code, elapsed_s, duration_s, cues)`` with seconds to the ms, real-time factor (null without duration) and whether the run stands: ended well, with cues."""
    factor = F.round(F.col("elapsed_s") / F.when(F.col("duration_s") > 0, F.col("duration_s")), 3)
    ok = F.coalesce((F.col("return_code") == 0) & (F.col("cues") > 0), F.lit(False))
    return runs.select("label", "variant", "return_code", F.round("elapsed_s", 3).alias("elapsed_s"), F.round("duration_s", 3).alias("duration_s"), factor.alias("realtime_factor"), "cues", ok.alias("accepted"))


def stage_summaries(stages: DataFrame) -> DataFrame:
    """``(media_id, stage, line, status)`` of ``stages(media_id, stage, label, value, failed, warnings)``: one line a stage, counts in order of label, zero ones left out.

    ``failed`` rows with a value above zero degrade the stage.
    """
    g = stages.groupBy("media_id", "stage").agg(
        F.array_sort(F.collect_list(F.when(F.col("value") > 0, F.struct("failed", "label", "value")))).alias("counts"), F.bool_or(F.col("failed") & (F.col("value") > 0)).alias("bad"), F.max("warnings").alias("warnings"),
    )
    shown = F.transform("counts", lambda x: F.concat_ws(" ", x["value"].cast("string"), x["label"]))
    status = F.when(F.col("bad"), "degraded")
    line = F.concat(
        F.array_join(F.concat(F.array("stage"), shown), " · "), F.when(F.col("warnings") > 0, F.concat(F.lit(" · ⚠ "), F.col("warnings").cast("string"))).otherwise(""), F.when(F.col("bad"), " [degraded]").otherwise(""),
    )
    return g.select("media_id", "stage", line.alias("line"), status.alias("status"))


def failure_gate(results: DataFrame) -> DataFrame:
    """``(media_id, failed, total, status)``: error when half or more of the batches failed, warn when any did."""
    g = results.groupBy("media_id").agg(F.count_if("failed").alias("failed_n"), F.count(F.lit(1)).alias("total"))
    return g.select("media_id", F.col("failed_n").alias("failed"), "total", F.when(F.col("failed_n") * 2 >= F.col("total"), "error").when(F.col("failed_n") > 0, "warn").otherwise("ok").alias("status"))


def non_worsening(before: Column, after: Column) -> Column:
    """Whether metrics (structs of ``speed_metrics`` columns) are nowhere worse, with 1% room for spread and jump."""
    room = lambda b, a: F.when(b.isNull(), a.isNull()).otherwise(a.isNull() | (a <= b * 1.01 + 1e-9))
    return (
        (after["invalid"] <= before["invalid"]) & (after["hard_deficit"] <= before["hard_deficit"] + 1e-9) & (after["unresolved_hard"] <= before["unresolved_hard"]) & (after["emergencies"] <= before["emergencies"])
        & room(before["speed_spread"], after["speed_spread"]) & room(before["jump_p90"], after["jump_p90"])
    )


def accepted(before: Column, after: Column) -> Column:
    """Nowhere worse, and clearly better in one of deficit, emergencies, spread or jump."""
    better = lambda b, a: F.coalesce(a < b * 0.99 - 1e-9, F.lit(False))
    return non_worsening(before, after) & (
        (after["hard_deficit"] < before["hard_deficit"] - 1e-9) | (after["emergencies"] < before["emergencies"]) | better(before["speed_spread"], after["speed_spread"]) | better(before["jump_p90"], after["jump_p90"])
    )


def compression_candidates(cues: DataFrame, cfg: PostprocessConfig = PostprocessConfig()) -> DataFrame:
    """``(media_id, cue_idx, side, chars, limit, previous, following)``: sides over the hard rate of their script, and how long they may be."""
    s = sides(cues)
    rate = F.when(F.col("is_cjk"), cfg.max_cps_cjk).otherwise(cfg.max_cps_latin)
    near = cues.select("media_id", "cue_idx", lag("text").alias("previous"), lead("text").alias("following"))
    over = s.where(F.col("cps") > rate).withColumn("limit", F.floor((F.col("end_ms") - F.col("start_ms")) / 1000 * rate).cast("int"))
    return over.join(near, ["media_id", "cue_idx"]).select("media_id", "cue_idx", "side", "chars", "limit", "previous", "following")
