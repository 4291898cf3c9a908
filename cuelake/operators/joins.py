"""Joins of cues with translations, glossaries, chunks, speakers and caches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cues import in_order
from ..functions.similarity import term_key
from ..functions.text import contains_term, match_key, number_key, once, protected_tokens, strip
from . import edit


def attach_translations(cues: DataFrame, translated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues with ``translated(media_id, cue_idx, translation)`` where there is one, and the keys that got none."""
    t = translated.select("media_id", "cue_idx", "translation")
    out = cues.join(t, ["media_id", "cue_idx"], "left").withColumn("translated_text", F.coalesce("translation", "translated_text")).drop("translation")
    return out, cues.select("media_id", "cue_idx").join(t, ["media_id", "cue_idx"], "left_anti")


def attach_corrections(cues: DataFrame, corrected: DataFrame) -> DataFrame:
    """Texts replaced by ``corrected(media_id, cue_idx, correction)`` where there is one; translations go."""
    return cues.join(corrected.select("media_id", "cue_idx", "correction"), ["media_id", "cue_idx"], "left").withColumn("text", F.coalesce("correction", "text")).withColumn("translated_text", F.lit("")).drop("correction")


def pair_bilingual(rows: DataFrame) -> DataFrame:
    """One cue for each two rows of ``(media_id, pos, style, start_ms, end_ms, text)`` with equal times: Default holds one side, Secondary the other."""
    w = Window.partitionBy("media_id", "start_ms", "end_ms", "style").orderBy("pos")
    r = rows.withColumn("pair", F.row_number().over(w))
    side = lambda s: F.max(F.when(F.col("style") == s, F.col("text")))
    g = r.groupBy("media_id", "start_ms", "end_ms", "pair").agg(F.min("pos").alias("pos"), side("Default").alias("text"), side("Secondary").alias("translated_text"))
    return g.select("media_id", "pos", "start_ms", "end_ms", F.coalesce("text", "translated_text").alias("text"), F.when(F.col("text").isNotNull(), F.coalesce("translated_text", F.lit(""))).otherwise("").alias("translated_text"))


def evidence_of_cues(cues: DataFrame, windows: DataFrame) -> DataFrame:
    """Cues with the grade, movement budget and speech bounds of the last window that lists them.

    ``cues`` have ``cue_id``; ``windows``: ``media_id, pos, grade, cue_ids, anchors``.
    """
    w = windows.select("media_id", "pos", "grade", "anchors", F.explode("cue_ids").alias("cue_id"))
    last = w.groupBy("media_id", "cue_id").agg(F.max_by(F.struct("grade", "anchors"), "pos").alias("w"))
    mine = F.filter("w.anchors", lambda a: a["cue_id"] == F.col("cue_id"))
    e = last.select("media_id", "cue_id", F.col("w.grade").alias("grade"), F.array_min(F.transform(mine, lambda a: a["start_ms"])).alias("speech_start_ms"), F.array_max(F.transform(mine, lambda a: a["end_ms"])).alias("speech_end_ms"))
    budget = F.when(F.col("grade") == "HIGH", 1000).when(F.col("grade") == "MEDIUM", 500).otherwise(250)
    return cues.join(e, ["media_id", "cue_id"], "left").withColumn("boundary_budget_ms", budget)


def anchor_owner(anchors: DataFrame, cue_spans: DataFrame) -> DataFrame:
    """Anchors ``(window_id, anchor_no, from_char, to_char)`` with the cue of ``cue_spans(window_id, cue_id, ord, a, b)`` that holds their middle, else the window's last one.

    The spans of a window don't overlap, as they are stretches of one text; empty ones hold nothing. Spans and anchors of a
    window are put in one order, in which an anchor looks back to the span that began last: one shuffle, and no pairs. Anchors
    of windows without cues have none.
    """
    s = cue_spans.select("window_id", F.col("a").cast("double").alias("at__"), F.lit(0).alias("kind__"), F.when(F.col("b") > F.col("a"), F.struct("cue_id", "b")).alias("span__"), F.struct("ord", "cue_id").alias("end__"))
    a = anchors.select("window_id", ((F.col("from_char") + F.col("to_char")) / 2).alias("at__"), F.lit(1).alias("kind__"), F.struct(*anchors.columns).alias("anchor__"))
    w = Window.partitionBy("window_id").orderBy("at__", "kind__")
    j = s.unionByName(a, allowMissingColumns=True).withColumn("span__", F.last("span__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end__", F.max("end__").over(Window.partitionBy("window_id")))
    held = F.when(F.col("at__") < F.col("span__.b"), F.col("span__.cue_id"))
    return j.where(F.col("kind__") == 1).select("anchor__.*", F.coalesce(held, "end__.cue_id").alias("cue_id"))


def glossary_forms(glossary: DataFrame) -> DataFrame:
    """``(entry_id, form)``: every term and alias, blanks left out."""
    return glossary.select("entry_id", F.explode(F.array_distinct(F.concat(F.array("source_term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form")).where(F.length(strip("form")) > 0)


#: Letters of the pieces by which a form is looked up.
PIECE = 6


def _longest(parts: Column) -> Column:
    return F.get(F.array_sort(F.transform(parts, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]


#: Up to so many forms each text is looked through for each of them.
FEW_FORMS = 2000


def _substring_hits(texts: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """``substring_hits``, some of them more than once."""
    f = forms.where(F.length("form") > 0)
    if f.limit(FEW_FORMS + 1).count() <= FEW_FORMS:
        # Short forms stand in most words, so that words with their forms would be far more than the texts.
        return texts.join(F.broadcast(f.select("form_id", "form")), F.contains("text", F.col("form"))).select(*keys, "form_id")
    f = f.withColumn("run", F.coalesce(F.nullif(_longest(F.split("form", " ")), F.lit("")), F.lit(" ")))
    words = once(F.split("text", " "), lambda w: F.array_distinct(F.concat(w, F.when(F.size(w) > 1, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")))))
    w = texts.select(*keys, F.explode(words).alias("word")).where(F.col("word") != "")
    runs = f.select("run").distinct().withColumn("piece", F.substring("run", 1, PIECE))
    # An empty match looks ahead at each place, in one pass whatever the word's length.
    at = lambda n: F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    pieces = F.array_distinct(F.concat(*[at(n) for n in range(1, PIECE + 1)]))
    held = w.select("word").distinct().select("word", F.explode(pieces).alias("piece")).join(runs, "piece").where(F.contains("word", F.col("run"))).select("word", "run").distinct()
    near = w.join(held.join(f, "run").select("word", "form_id", F.when(F.col("form") != F.col("run"), F.col("form")).alias("form")), "word").select(*keys, "form_id", "form").distinct()
    long = near.where(F.col("form").isNotNull()).join(texts, keys).where(F.contains("text", F.col("form")))
    return near.where(F.col("form").isNull()).select(*keys, "form_id").unionByName(long.select(*keys, "form_id"))


def substring_hits(texts: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., form_id)`` where ``texts(keys.., text)`` holds a form of ``forms(form_id, form)``, letter by letter.

    Few forms are sent to every executor, and only hits are shuffled. Of more, the longest stretch of a form without spaces
    stands within one word of the text: forms meet the distinct words of all texts, by an equi join of their first PIECE
    letters, and texts meet forms by their words. A form without spaces is found by that; for others texts are fetched and
    looked through. Empty forms occur nowhere, those of spaces alone in all texts with one; null texts and forms don't count.
    """
    return _substring_hits(texts, forms, keys).distinct()


def _pairs(words: Column, gaps: Column) -> Column:
    return F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.get(gaps, i + 1), w))


def _words_and_pairs(text: Column) -> Column:
    """``struct(words, pairs)``: ASCII words, and neighbouring ones with what stands between them, in order."""
    parts = once(F.lower(text), lambda t: F.struct(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)).alias("words"), F.split(t, "[a-z0-9]+").alias("gaps")))
    return once(parts, lambda p: F.struct(p["words"].alias("words"), _pairs(p["words"], p["gaps"]).alias("pairs")))


def word_key(form: Column) -> Column:
    """The longest stretch of two ASCII words of a form that follow each other, or its only one, to look it up by. Null if it has none.

    Wherever the form occurs, its ASCII words stand alone and follow each other.
    """
    return once(_words_and_pairs(form), lambda x: F.coalesce(_longest(x["pairs"]), _longest(x["words"])))


def term_hits(cues: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(media_id, cue_idx, entry_id)`` where a cue's text holds a term or alias.

    Forms with an ASCII word meet only cues with their longest one, or two that follow each other, by an equi join of keys
    alone; a form that is its key is found by that. The others are found by their letters. Texts are fetched for what has met
    otherwise, and checked with the whole form; where all forms are keys, which the glossary says, none is fetched or looked
    through for others.
    """
    forms = glossary_forms(glossary).withColumn("key", word_key(F.col("form")))
    c, ids = cues.select("media_id", "cue_idx", "text"), ["media_id", "cue_idx"]
    words = c.select(*ids, F.explode(once(_words_and_pairs(F.col("text")), lambda x: F.array_distinct(F.concat(x["words"], x["pairs"])))).alias("key"))
    whole = F.col("key") == F.lower("form")
    if forms.where(~F.coalesce(whole, F.lit(False))).isEmpty():
        return words.join(forms.select("key", "entry_id"), "key").select(*ids, "entry_id").repartition("media_id").distinct()
    open_form = F.when(~whole, F.col("form")).alias("form")
    met = words.join(forms.where(F.col("key").isNotNull()).select("key", "entry_id", open_form), "key").select(*ids, "entry_id", "form")
    rest = forms.where(F.col("key").isNull()).select(F.struct("entry_id", "form").alias("form_id"), F.lower("form").alias("form"))
    # These forms hold no ASCII word, so texts need be looked through only where theirs are not.
    between = c.where(F.col("text").rlike(r"[^a-zA-Z0-9\s]")).withColumn("text", F.regexp_replace(F.lower("text"), "[a-z0-9]+", " "))
    marked = substring_hits(between, rest, ids).select(*ids, "form_id.entry_id", "form_id.form")
    checked = met.where(F.col("form").isNotNull()).unionByName(marked).distinct().join(c, ids).where(contains_term(F.col("text"), F.col("form")))
    return met.where(F.col("form").isNull()).select(*ids, "entry_id").unionByName(checked.select(*ids, "entry_id")).distinct()


def relevant_entries(glossary: DataFrame, cues: DataFrame) -> DataFrame:
    """``(media_id, entry_id)`` of entries that name one of a media item's cues among their occurrences, or whose form occurs in one.

    Occurrences are cue numbers of the glossary's ``media_id``; without that column only forms count.
    """
    by_text = term_hits(cues, glossary).select("media_id", "entry_id")
    if "media_id" in glossary.columns:
        named = glossary.select("media_id", "entry_id", F.explode("occurrence_ids").alias("cue_idx"))
        by_text = by_text.unionByName(named.join(cues.select("media_id", "cue_idx"), ["media_id", "cue_idx"], "left_semi").select("media_id", "entry_id"))
    return by_text.distinct()


def occurrences(cues: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(entry_id, media_id, cue_ids)`` of every entry that occurs: plain substrings of normalised texts, without regard to word ends."""
    texts = cues.select("media_id", "cue_idx", term_key(F.col("text")).alias("text"))
    forms = glossary_forms(glossary).select(F.col("entry_id").alias("form_id"), term_key(F.col("form")).alias("form"))
    # A set counts each cue once.
    hits = _substring_hits(texts, forms, ["media_id", "cue_idx"])
    return hits.groupBy(F.col("form_id").alias("entry_id"), "media_id").agg(F.array_sort(F.collect_set("cue_idx")).alias("cue_ids"))


def unenforced_terms(cues: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(media_id, cue_idx, entry_id)`` where the text holds a form but the translation lacks the agreed one."""
    g = glossary.select("entry_id", "translation")
    j = term_hits(cues, glossary).join(g, "entry_id").join(cues.select("media_id", "cue_idx", "translated_text"), ["media_id", "cue_idx"])
    return j.where(~F.contains(F.lower("translated_text"), F.lower("translation"))).select("media_id", "cue_idx", "entry_id")


def merge_issues(model: DataFrame, local: DataFrame) -> DataFrame:
    """One row a cue: categories and messages of both tables, the model's first, each once and in the order of ``issue_no``.

    Both: ``media_id, cue_idx, issue_no, categories, message``.
    """
    both = model.withColumn("origin", F.lit(0)).unionByName(local.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    rows = F.array_sort(F.collect_list(F.struct("origin", "issue_no", "categories", "message")))
    g = both.groupBy("media_id", "cue_idx").agg(rows.alias("r"))
    messages = F.array_distinct(F.filter(F.transform("r", lambda x: x["message"]), lambda m: m.isNotNull() & (m != "")))
    return g.select("media_id", "cue_idx", F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["categories"], F.array().cast("array<string>"))))).alias("categories"), F.array_join(messages, "; ").alias("message"))


def apply_speakers(utterances: DataFrame, profiles: DataFrame, voice: str, style: str = "") -> DataFrame:
    """Voice and style of each utterance's speaker, else of the profile named default, else those given. Blank values count as missing."""
    p = profiles.select(F.col("speaker"), F.nullif("voice", F.lit("")).alias("v1"), F.nullif("style", F.lit("")).alias("s1"))
    default = profiles.where(F.col("speaker") == "default").agg(F.first(F.struct(F.nullif("voice", F.lit("")).alias("v"), F.nullif("style", F.lit("")).alias("s"))).alias("d"))
    u = utterances.join(p, "speaker", "left").withColumn("d", default.scalar()).withColumn("v2", F.col("d.v")).withColumn("s2", F.col("d.s")).drop("d")
    return u.withColumn("voice", F.coalesce("v1", "v2", F.lit(voice))).withColumn("style", F.coalesce("s1", "s2", F.lit(style))).drop("v1", "s1", "v2", "s2")


def cache_lookup(work: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Work rows with a live, non-blank cached value, and those without one."""
    live = cache.where((F.col("expires_at") > now) & (F.length(strip("value")) > 0)).groupBy(key).agg(F.max_by("value", "expires_at").alias("value"))
    return work.join(live, key), work.join(live, key, "left_anti")


def key_differences(wanted: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either table that the other lacks, with ``problem`` missing or extra."""
    w, g = wanted.select(*keys).distinct(), given.select(*keys).distinct()
    return w.join(g, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(g.join(w, keys, "left_anti").withColumn("problem", F.lit("extra")))


def overlap_rows(pairs: DataFrame, overlap_ms: int = 10_000) -> DataFrame:
    """Rows of neighbouring chunks that may hold the same speech, of ``pairs(pair_id, side, pos, start_ms, end_ms, text)``.

    Of the left chunk those that start within the overlap before its end; of the right one those from its first row on that
    end within the overlap after its start, up to the first that doesn't.
    """
    w = Window.partitionBy("pair_id", "side")
    p = pairs.withColumn("last", F.max("end_ms").over(w)).withColumn("first", F.min("start_ms").over(w))
    inside = F.when(F.col("side") == "left", F.col("start_ms") >= F.col("last") - overlap_ms).otherwise(F.col("end_ms") <= F.col("first") + overlap_ms)
    p = p.withColumn("in__", inside).withColumn("all__", F.bool_and("in__").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.where(F.when(F.col("side") == "left", F.col("in__")).otherwise(F.col("all__")))
    return p.withColumn("at", F.row_number().over(w.orderBy("pos")) - 1).drop("in__", "all__", "last", "first")


def overlap_part(rows: Column, side: str, overlap_ms: int = 10_000) -> Column:
    """``overlap_rows`` of one chunk, whose ``struct<pos, start_ms, end_ms, ..>`` rows are a list in order of ``pos``."""
    if side == "left":
        return once(F.array_max(F.transform(rows, lambda x: x["end_ms"])) - overlap_ms, lambda late: F.filter(rows, lambda x: x["start_ms"] >= late))
    past = once(F.array_min(F.transform(rows, lambda x: x["start_ms"])) + overlap_ms, lambda early: F.array_position(F.transform(rows, lambda x: x["end_ms"] > early), True))
    return once(past, lambda n: F.when(n > 0, F.slice(rows, 1, (n - 1).cast("int"))).otherwise(rows))


def best_shift(left: list[tuple[int, str]], right: list[tuple[int, str]], n_left: int) -> tuple[int, int, float] | None:
    """``(shift, matches, score)`` of two sequences of ``(place, key)``, see ``best_alignment``; None without two matches."""
    at: dict[str, list[int]] = {}
    for r, k in right:
        at.setdefault(k, []).append(r)
    n: dict[int, int] = {}
    for x, k in left:
        for r in at.get(k, ()) if k else ():
            n[n_left - x + r] = n.get(n_left - x + r, 0) + 1
    best = max(((m / s + s / 10000, -s, m) for s, m in n.items() if m >= 2), default=None)
    return best and (-best[1], best[2], best[0])


def best_alignment(rows: DataFrame) -> DataFrame:
    """Best shift of two word sequences ``(pair_id, side, at, text)``: ``(pair_id, shift, matches, score)``; pairs without two matches have no row.

    Sliding one sequence over the other, ``shift`` words overlap at the ends; words match by their letters. The score is
    matches over shift plus a trifle for longer shifts; of equals the first wins. A pair is a small group, counted in one pass.
    """
    k = rows.select("pair_id", (F.col("side") == "right").cast("int").alias("side"), F.col("at").cast("long").alias("at"), match_key("text").alias("key"))

    def f(g: edit.Group) -> list:
        cut = int(np.searchsorted(g["side"], 1))
        words = list(zip(g["at"].tolist(), g["key"].tolist(), strict=True))
        best = best_shift(words[:cut], words[cut:], cut)
        return [[x] for x in (g["pair_id"][0], *best)] if best else [()] * 4

    kind = rows.schema["pair_id"].dataType.simpleString()
    return edit.per_key(edit.spread(k, "pair_id").sortWithinPartitions("pair_id", "side", "at"), ["pair_id"], f, f"pair_id {kind}, shift long, matches long, score double")


def representative_contexts(hits: DataFrame, cues: DataFrame, k: int = 5, radius: int = 2) -> DataFrame:
    """``(entry_id, media_id, hit_row, row, text)``: rows around at most k evenly spread hits of each entry in a media item."""
    c = cues.withColumn("row", F.row_number().over(in_order()))
    # Rows of hits and texts of rows are looked up among their neighbours in the media item, which lies together.
    marks = hits.where("media_id IS NOT NULL AND cue_idx IS NOT NULL").select("media_id", "cue_idx", "entry_id", F.lit(True).alias("hit"))
    h = c.select("media_id", "cue_idx", "row").unionByName(marks, allowMissingColumns=True).withColumn("row", F.max("row").over(Window.partitionBy("media_id", "cue_idx"))).where(F.col("hit") & F.col("row").isNotNull())
    w = Window.partitionBy("media_id", "entry_id")
    h = h.withColumn("i", F.row_number().over(w.orderBy("row")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (k - 1)).cast("long"))
    h = h.where((F.col("n") <= k) | F.array_contains(picks, F.col("i").cast("long"))).select("media_id", "hit", "entry_id", F.col("row").alias("hit_row"), F.explode(F.sequence(F.col("row") - radius, F.col("row") + radius)).alias("row"))
    t = c.select("media_id", "row", F.struct("text").alias("one")).unionByName(h, allowMissingColumns=True).withColumn("one", F.max("one").over(Window.partitionBy("media_id", "row")))
    return t.where(F.col("hit") & F.col("one").isNotNull()).select("entry_id", "media_id", "hit_row", "row", "one.text")


def missing_results(labels: DataFrame, variants: DataFrame, done: DataFrame) -> DataFrame:
    """Combinations of label and variant without a successful run; the variants are a short list."""
    every = variants.agg(F.array_sort(F.collect_set("variant")).alias("v"))
    return labels.withColumn("variant", F.explode(every.scalar())).join(done.where(F.col("status") == "ok").select("label", "variant"), ["label", "variant"], "left_anti")


def classify_import(imported: DataFrame, current: DataFrame, schema_version: int = 1) -> DataFrame:
    """``(glossary_id, verdict)``: exact (same fingerprint), seed (same languages), or incompatible."""
    c = current.select("source_language", "target_language", F.col("fingerprint").alias("fp")).distinct()
    j = imported.join(c, ["source_language", "target_language"], "left")
    verdict = F.when((F.col("schema_version") != schema_version) | F.col("fp").isNull(), "incompatible").when(F.col("fp") == F.col("fingerprint"), "exact").otherwise("seed")
    return j.groupBy("glossary_id").agg(F.min(F.struct(F.when(verdict == "exact", 0).when(verdict == "seed", 1).otherwise(2).alias("o"), verdict.alias("verdict"))).alias("v")).select("glossary_id", "v.verdict")


def reuse_evidence(work: DataFrame, sidecar: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence bundles from the sidecar, else the cache, by key; and the rows that need alignment."""
    j = work.join(sidecar.select("key", F.col("bundle").alias("s")), "key", "left").join(cache.select("key", F.col("bundle").alias("c")), "key", "left")
    found = j.withColumn("bundle", F.coalesce("s", "c")).withColumn("origin", F.when(F.col("s").isNotNull(), "sidecar").when(F.col("c").isNotNull(), "cache")).drop("s", "c")
    return found.where(F.col("bundle").isNotNull()), found.where(F.col("bundle").isNull()).drop("bundle", "origin")


#: How providers check voices, and the form of a voice name that stands for itself.
VOICE_RULES = {"gemini": "listed", "siliconflow": "qualified", "edge": "neural"}
_NEURAL = r"^[^-]*-[^-]*-.*Neural$"


def resolve_voices(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """``wanted(provider, model, voice)`` with the ``voice_id`` to ask for and a ``problem``, null where the provider will take it.

    ``aliases(provider, alias, voice_id)`` count in any case; of one that is repeated the smallest id holds. ``listed``
    providers know only the voices there; ``qualified`` ones take ``model:voice``, which a bare name becomes; ``neural`` ones
    also take full names such as ``de-DE-AbcNeural``; others take anything. Blank and null voices stay as they are and are no problem.
    """
    a = aliases.groupBy("provider", F.lower("alias").alias("k__")).agg(F.min("voice_id").alias("known__"))
    v = F.coalesce("voice", F.lit(""))
    j = wanted.withColumn("k__", F.lower("voice")).join(a, ["provider", "k__"], "left")
    rule = F.create_map(*[F.lit(x) for pair in VOICE_RULES.items() for x in pair])
    j = j.withColumn("rule__", F.try_element_at(rule, F.col("provider")))
    bare = (F.col("rule__") == "qualified") & ~v.contains(":") & ~v.contains("/") & (v != "")
    j = j.withColumn("voice_id", F.coalesce(F.when(v != "", F.col("known__")), F.when(bare, F.concat_ws(":", F.coalesce("model", F.lit("")), "voice")), F.col("voice")))
    problem = (
        F.when(v == "", F.lit(None)).when(F.col("known__").isNotNull(), F.lit(None)).when(F.col("rule__") == "listed", "unknown_voice")
        .when((F.col("rule__") == "qualified") & ~F.col("voice_id").contains(":"), "no_voice_id").when((F.col("rule__") == "neural") & ~F.col("voice_id").rlike(_NEURAL), "no_voice_id")
    )
    return j.withColumn("problem", problem.cast("string")).drop("k__", "known__", "rule__")


def attach_short_lines(utterances: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Utterances with the shortened line of ``short(media_id, idx, text)`` in ``rewritten_text`` where there is one, and ``(media_id, requested, applied)``."""
    s = short.select("media_id", "idx", strip("text").alias("short__")).where(F.length("short__") > 0)
    out = utterances.join(s, ["media_id", "idx"], "left").withColumnRenamed("short__", "rewritten_text")
    asked = short.groupBy("media_id").agg(F.countDistinct("idx").alias("requested"))
    done = out.where(F.col("rewritten_text").isNotNull()).groupBy("media_id").agg(F.count(F.lit(1)).alias("applied"))
    return out, asked.join(done, "media_id", "left").select("media_id", "requested", F.coalesce("applied", F.lit(0).cast("long")).alias("applied"))


def token_differences(source: Column, translation: Column) -> Column:
    """Protected tokens of the source that the translation lacks, numbers compared by value."""
    keys = F.transform(protected_tokens(translation), number_key)
    return F.filter(protected_tokens(source), lambda t: ~F.array_contains(keys, number_key(t)))
