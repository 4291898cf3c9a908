"""Answers of models, kept as text in a table, to checked rows: one parser a kind, each of which takes an answer whole or rejects it with a reason.

Every parser takes ``(batch_id, response)`` with extra columns allowed and gives ``(rows, rejects)``; ``rejects`` are
``(batch_id, reason)``, the first reason that holds. ``not_an_object`` covers null, broken JSON and JSON of another type. JSON
types are strict: a number is no string, true is no number, and a null is not there only where a default is stated. Empty
tables give empty tables; equal rows give equal rows. A ``batch_id`` names one answer; of one that is repeated each is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Decisions that an answer may hold.
TERM_DECISIONS = ("accept", "correct", "uncertain")
FINAL_DECISIONS = ("accept", "correct")
REVIEW_DECISIONS = ("accept", "reject", "uncertain")


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _type(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID; empty where there is nothing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def _is(v: Column, *types: str) -> Column:
    return _type(v).isin(*types)


def _items(v: Column) -> Column:
    """The items of an array; none of anything else."""
    return F.coalesce(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _texts(v: Column) -> Column:
    return F.transform(_items(v), lambda x: F.try_variant_get(x, "$", "string"))


def _text(v: Column) -> Column:
    """A value as text; empty where there is none or it is a JSON null."""
    return F.coalesce(F.when(~_is(v, "VOID"), F.try_variant_get(v, "$", "string")), F.lit(""))


def _list_of(v: Column, *types: str) -> Column:
    """An array whose items all have one of the types, or nothing at all."""
    return _is(v, "") | (_is(v, "ARRAY") & F.forall(_items(v), lambda x: _is(x, *types)))


def _blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def _first(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule whose condition holds; null where none does."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), name) for broken, name in rules])


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("batch_id", F.try_parse_json("response").alias("v"))


def _settled(judged: DataFrame, *cols: Column) -> tuple[DataFrame, DataFrame]:
    """Good answers with ``cols``, and the others with their reason."""
    return judged.where(F.col("reason").isNull()).select("batch_id", *cols), judged.where(F.col("reason").isNotNull()).select("batch_id", "reason")


def _no_object(v: Column) -> tuple[Column, str]:
    return ~_is(v, "OBJECT"), "not_an_object"


def translations(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(batch_id, id, text)`` of ``{"translations": [{"id": 1, "text": ".."}]}``: each id of ``wanted(batch_id, id)`` once, no other, no text blank.

    Reasons: not_an_object, no_list, bad_item (an item without an integer id), repeated_id, blank_text, missing_id, unknown_id.
    Ids wanted twice count once; an answer of a batch that wants nothing must be an empty list.
    """
    v = F.col("v")
    items = F.transform(_items(_at(v, "translations")), lambda x: F.struct(
        F.when(_is(_at(x, "id"), "BIGINT"), F.try_variant_get(x, "$.id", "bigint")).alias("id"), F.when(_is(_at(x, "text"), "STRING"), strip(F.try_variant_get(x, "$.text", "string"))).alias("text"),
    ))
    want = wanted.groupBy("batch_id").agg(F.collect_set(F.col("id").cast("bigint")).alias("want"))
    a = _read(rows).withColumn("items", items).join(want, "batch_id", "left").withColumn("want", F.coalesce("want", F.array().cast("array<bigint>")))
    ids = F.transform("items", lambda x: x["id"])
    reason = _first(
        _no_object(v), (~_is(_at(v, "translations"), "ARRAY"), "no_list"), (F.exists(ids, lambda x: x.isNull()), "bad_item"), (F.size(F.array_distinct(ids)) < F.size(ids), "repeated_id"),
        (F.exists("items", lambda x: _blank(x["text"])), "blank_text"), (F.size(F.array_except("want", ids)) > 0, "missing_id"), (F.size(F.array_except(ids, F.col("want"))) > 0, "unknown_id"),
    )
    good, bad = _settled(a.withColumn("reason", reason), F.explode("items").alias("x"))
    return good.select("batch_id", "x.id", "x.text"), bad


def analyses(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Briefs ``(batch_id, outline, background, themes, style_notes, translation_notes)``, candidates of terms, and rejects.

    Candidates: ``(batch_id, candidate_id, source_term, sense, aliases, occurrence_ids)``; an id that isn't given is made of
    term, sense and place; aliases are distinct and not blank; occurrences sorted, distinct and among ``wanted(batch_id, id)``
    where that has any of the batch. Reasons: not_an_object, no_brief, no_candidates, bad_list (of the brief), bad_candidate (no
    object), blank_term, bad_occurrence (no positive integer), outside_window, bad_alias.
    """
    v = F.col("v")
    brief, listed = _at(v, "brief"), ("themes", "style_notes", "translation_notes")
    found = _items(_at(v, "candidates"))
    term = lambda c: strip(_text(_at(c, "source_term")))
    places = lambda c: F.transform(_items(_at(c, "occurrence_ids")), lambda x: F.try_variant_get(x, "$", "bigint"))
    want = wanted.groupBy("batch_id").agg(F.collect_set(F.col("id").cast("bigint")).alias("want"))
    a = _read(rows).join(want, "batch_id", "left")
    reason = _first(
        _no_object(v), (~_is(brief, "OBJECT"), "no_brief"), (~_is(_at(v, "candidates"), "ARRAY"), "no_candidates"),
        (~(_list_of(_at(brief, listed[0]), "STRING") & _list_of(_at(brief, listed[1]), "STRING") & _list_of(_at(brief, listed[2]), "STRING")), "bad_list"),
        (F.exists(found, lambda c: ~_is(c, "OBJECT")), "bad_candidate"), (F.exists(found, lambda c: F.length(term(c)) == 0), "blank_term"),
        (F.exists(found, lambda c: ~_list_of(_at(c, "occurrence_ids"), "BIGINT") | F.exists(places(c), lambda x: x <= 0)), "bad_occurrence"),
        (F.col("want").isNotNull() & F.exists(found, lambda c: F.size(F.array_except(places(c), F.col("want"))) > 0), "outside_window"),
        (F.exists(found, lambda c: ~_list_of(_at(c, "aliases"), "STRING")), "bad_alias"),
    )
    a = a.withColumn("reason", reason)
    briefs, bad = _settled(a, _text(_at(brief, "outline")).alias("outline"), _text(_at(brief, "background")).alias("background"), *[_texts(_at(brief, n)).alias(n) for n in listed])
    c = a.where(F.col("reason").isNull()).select("batch_id", F.posexplode(found).alias("n", "c"))
    c = c.select("batch_id", "n", strip(_text(_at(F.col("c"), "id"))).alias("given"), term(F.col("c")).alias("source_term"), _text(_at(F.col("c"), "sense")).alias("sense"),
                 F.array_distinct(F.filter(_texts(_at(F.col("c"), "aliases")), lambda x: ~_blank(x))).alias("aliases"), F.array_sort(F.array_distinct(places(F.col("c")))).alias("occurrence_ids"))
    made = F.substring(F.sha2(F.concat_ws("\x00", "source_term", "sense", F.col("n").cast("string")), 256), 1, 16)
    c = c.select("batch_id", F.when(F.length("given") > 0, F.col("given")).otherwise(made).alias("candidate_id"), "source_term", "sense", "aliases", "occurrence_ids")
    return briefs, c, bad


def term_proposals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(batch_id, translation, reason)``; reasons of rejects: not_an_object, no_translation (no text, or blank)."""
    v = F.col("v")
    t = _at(v, "translation")
    a = _read(rows).withColumn("why", _text(_at(v, "reason"))).withColumn("reason", _first(_no_object(v), (~_is(t, "STRING") | _blank(_text(t)), "no_translation")))
    return _settled(a, strip(_text(t)).alias("translation"), F.col("why").alias("reason"))


def term_reviews(rows: DataFrame, final: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(batch_id, is_term, decision, translation, reason)`` of reviews; a ``final`` one may only accept or correct, and is of a term.

    Reasons: not_an_object, no_verdict (``is_term`` isn't true or false), unknown_decision, bad_translation (no text),
    no_correction (a term is to be corrected, but by nothing).
    """
    v = F.col("v")
    t, decision = _at(v, "translation"), _text(_at(v, "decision"))
    is_term = F.lit(True) if final else F.try_variant_get(v, "$.is_term", "boolean")
    rules = [_no_object(v)] if final else [_no_object(v), (~_is(_at(v, "is_term"), "BOOLEAN"), "no_verdict")]
    rules += [(~decision.isin(*(FINAL_DECISIONS if final else TERM_DECISIONS)), "unknown_decision")]
    rules += [] if final else [(~_is(t, "", "STRING"), "bad_translation")]
    rules += [(is_term & (decision == "correct") & (~_is(t, "STRING") | _blank(_text(t))), "no_correction")]
    a = _read(rows).withColumn("why", _text(_at(v, "reason"))).withColumn("reason", _first(*rules))
    return _settled(a, is_term.alias("is_term"), decision.alias("decision"), strip(_text(t)).alias("translation"), F.col("why").alias("reason"))


def rewrites(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(batch_id, window_id, pos, cue_id, text)`` of ``{"window_id": "..", "segments": [{"cue_id": "..", "text": ".."}]}``, repeated ids included: ``rewrites.judge`` looks at them.

    Reasons: not_an_object, no_segments, bad_segment (an item without a text as id and text), no_window.
    """
    v = F.col("v")
    parts = _items(_at(v, "segments"))
    reason = _first(
        _no_object(v), (~_is(_at(v, "segments"), "ARRAY"), "no_segments"), (F.exists(parts, lambda x: ~(_is(_at(x, "cue_id"), "STRING") & _is(_at(x, "text"), "STRING"))), "bad_segment"), (~_is(_at(v, "window_id"), "STRING"), "no_window"),
    )
    good, bad = _settled(_read(rows).withColumn("reason", reason), F.try_variant_get(v, "$.window_id", "string").alias("window_id"), F.posexplode(parts).alias("pos", "x"))
    return good.select("batch_id", "window_id", "pos", F.try_variant_get("x", "$.cue_id", "string").alias("cue_id"), F.try_variant_get("x", "$.text", "string").alias("text")), bad


def reviews(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(batch_id, window_id, decision, explanation, changed_facts)``; reasons: not_an_object, unknown_decision, bad_facts (no list of texts), no_window, bad_explanation."""
    v = F.col("v")
    decision = _text(_at(v, "decision"))
    reason = _first(
        _no_object(v), (~decision.isin(*REVIEW_DECISIONS), "unknown_decision"), (~_list_of(_at(v, "changed_facts"), "STRING"), "bad_facts"), (~_is(_at(v, "window_id"), "STRING"), "no_window"), (~_is(_at(v, "explanation"), "", "STRING"), "bad_explanation"),
    )
    return _settled(_read(rows).withColumn("reason", reason), F.try_variant_get(v, "$.window_id", "string").alias("window_id"), decision.alias("decision"), _text(_at(v, "explanation")).alias("explanation"), _texts(_at(v, "changed_facts")).alias("changed_facts"))
