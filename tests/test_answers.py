"""Strict parsers of model answers: every reason, and what good answers give."""

from __future__ import annotations

import json

import pytest

from cuelake.sources import answers


def asked(spark, responses):
    return spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r), "x") for i, r in enumerate(responses)], "batch_id long, response string, reason string")


def reasons(rejects):
    return {r["batch_id"]: r["reason"] for r in rejects.collect()}


BROKEN = [None, "", "{broken", "[1]", "7", "null"]


def check(spark, parse, good, bad):
    """``bad`` are (answer, reason); broken JSON is rejected by every parser; good answers aren't among the rejects."""
    every = [*good, *[a for a, _ in bad], *BROKEN]
    *rows, rejects = parse(asked(spark, every))
    want = [r for _, r in bad] + ["not_an_object"] * len(BROKEN)
    assert reasons(rejects) == {len(good) + i: r for i, r in enumerate(want)}
    *none, gone = parse(asked(spark, []))
    assert all(d.count() == 0 for d in [*none, gone])
    return rows


def test_translations(spark):
    t = lambda *items: {"translations": list(items)}
    one, two = {"id": 1, "text": " eins "}, {"id": 2, "text": "zwei"}
    bad = [({"x": 1}, "no_list"), ({"translations": {"1": "x"}}, "no_list"), (t(one, 3), "bad_item"), (t(one, {"id": "2", "text": "x"}), "bad_item"), (t(one, {"id": True, "text": "x"}), "bad_item"), (t(one, one, two), "repeated_id"),
           (t(one, {"id": 2, "text": " \n"}), "blank_text"), (t(one, {"id": 2, "text": 5}), "blank_text"), (t(one, {"id": 2}), "blank_text"), (t(one), "missing_id"), (t(), "missing_id"), (t(one, two, {"id": 3, "text": "x"}), "unknown_id")]
    wanted = spark.createDataFrame([(b, i) for b in range(40) for i in (1, 2, 2)], "batch_id long, id int")
    (rows,) = check(spark, lambda a: answers.translations(a, wanted), [t(two, one), t({**one, "note": [1]}, {"id": 2, "text": "😀" * 70_000})], bad)
    got = {(r["batch_id"], r["id"]): r["text"] for r in rows.collect()}
    assert got == {(0, 1): "eins", (0, 2): "zwei", (1, 1): "eins", (1, 2): "😀" * 70_000}
    ok, rejects = answers.translations(asked(spark, [t(), t(one)]), wanted.limit(0))
    assert ok.count() == 0 and reasons(rejects) == {1: "unknown_id"}


def test_analyses(spark):
    a = lambda *c, **brief: {"brief": brief, "candidates": list(c)}
    full = {"source_term": " cat ", "sense": "animal", "aliases": ["b", " ", "a", "b"], "occurrence_ids": [3, 1, 3]}
    bad = [({"brief": 1, "candidates": []}, "no_brief"), ({"brief": {}, "candidates": {}}, "no_candidates"), (a(themes="x"), "bad_list"), (a(style_notes=[1]), "bad_list"), (a(themes=None), "bad_list"), (a(5), "bad_candidate"), (a({"source_term": " "}), "blank_term"), (a({}), "blank_term"),
           (a({"source_term": "x", "occurrence_ids": [0]}), "bad_occurrence"), (a({"source_term": "x", "occurrence_ids": [1.5]}), "bad_occurrence"), (a({"source_term": "x", "occurrence_ids": 1}), "bad_occurrence"), (a({"source_term": "x", "occurrence_ids": [9]}), "outside_window"), (a({"source_term": "x", "aliases": [1]}), "bad_alias")]
    wanted = spark.createDataFrame([(b, i) for b in range(40) for i in (1, 2, 3)], "batch_id long, id int")
    briefs, terms = check(spark, lambda x: answers.analyses(x, wanted), [a(full, {"source_term": "dog", "id": "own"}, outline="o", themes=["t"]), a()], bad)
    got = [tuple(r) for r in briefs.orderBy("batch_id").collect()]
    assert got == [(0, "o", "", ["t"], [], []), (1, "", "", [], [], [])]
    first, second = terms.orderBy("source_term").collect()
    assert tuple(first)[2:] == ("cat", "animal", ["b", "a"], [1, 3]) and len(first["candidate_id"]) == 16
    assert tuple(second) == (0, "own", "dog", "", [], [])
    free = answers.analyses(asked(spark, [a({"source_term": "x", "occurrence_ids": [9]})]), wanted.limit(0))
    assert free[1].first()["occurrence_ids"] == [9] and free[2].count() == 0


def test_terms(spark):
    (p,) = check(spark, answers.term_proposals, [{"translation": " Katze ", "reason": "r"}, {"translation": "x"}], [({}, "no_translation"), ({"translation": " "}, "no_translation"), ({"translation": 5}, "no_translation")])
    assert [tuple(r) for r in p.orderBy("batch_id").collect()] == [(0, "Katze", "r"), (1, "x", "")]
    good = [{"is_term": True, "decision": "correct", "translation": " x "}, {"is_term": False, "decision": "correct"}, {"is_term": True, "decision": "uncertain"}]
    bad = [({"decision": "accept"}, "no_verdict"), ({"is_term": 1, "decision": "accept"}, "no_verdict"), ({"is_term": True, "decision": "maybe"}, "unknown_decision"), ({"is_term": True}, "unknown_decision"),
           ({"is_term": True, "decision": "accept", "translation": 5}, "bad_translation"), ({"is_term": True, "decision": "correct", "translation": " "}, "no_correction")]
    (r,) = check(spark, answers.term_reviews, good, bad)
    assert [tuple(x)[1:4] for x in r.orderBy("batch_id").collect()] == [(True, "correct", "x"), (False, "correct", ""), (True, "uncertain", "")]
    (f,) = check(spark, lambda x: answers.term_reviews(x, True), [{"decision": "accept"}, {"decision": "correct", "translation": "y"}], [({"decision": "uncertain"}, "unknown_decision"), ({"decision": "correct"}, "no_correction"), ({"decision": "correct", "translation": 5}, "no_correction")])
    assert [x["translation"] for x in f.orderBy("batch_id").collect()] == ["", "y"]


def test_rewrites_and_reviews(spark):
    s = lambda *items, w="w": {"window_id": w, "segments": list(items)}
    (r,) = check(spark, answers.rewrites, [s({"cue_id": "b", "text": "1"}, {"cue_id": "b", "text": ""}), s()], [({"window_id": "w"}, "no_segments"), (s(5), "bad_segment"), (s({"cue_id": 1, "text": "x"}), "bad_segment"), (s({"cue_id": "a"}), "bad_segment"), (s(w=None), "no_window")])
    assert [tuple(x) for x in r.orderBy("pos").collect()] == [(0, "w", 0, "b", "1"), (0, "w", 1, "b", "")]
    d = lambda **k: {"window_id": "w", "decision": "reject", **k}
    (v,) = check(spark, answers.reviews, [d(changed_facts=["7"], explanation="e"), d()], [(d(decision="no"), "unknown_decision"), (d(changed_facts="7"), "bad_facts"), (d(changed_facts=[7]), "bad_facts"), (d(window_id=1), "no_window"), (d(explanation=None), "bad_explanation")])
    assert [tuple(x)[1:] for x in v.orderBy("batch_id").collect()] == [("w", "reject", "e", ["7"]), ("w", "reject", "", [])]


@pytest.mark.parametrize("name", ["translations", "rewrites"])
def test_answers_stay_in_the_engine(spark, name):
    wanted = spark.createDataFrame([(1, 1)], "batch_id long, id int")
    good = answers.translations(asked(spark, []), wanted)[0] if name == "translations" else answers.rewrites(asked(spark, []))[0]
    assert "Python" not in good._jdf.queryExecution().executedPlan().toString()
