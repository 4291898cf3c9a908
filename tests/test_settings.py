"""Names, codes and stored settings: translators, languages, profiles, voices, stage files; and evidence for windows without words."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cuelake import profiles
from cuelake.functions.languages import CODES, OWN_CODES, service_codes, target_code
from cuelake.operators import edit, joins, structure
from cuelake.plans import translators
from cuelake.policy import PostprocessConfig
from cuelake.sources import writers


def cues(spark, rows, media=1):
    return spark.createDataFrame([(media, i, a, b, t, "") for i, (a, b, t) in enumerate(rows)], "media_id long, cue_idx int, start_ms long, end_ms long, text string, translated_text string")


def test_codes_of_services(spark):
    cases = [
        ("Norwegian", "bing", "nb"), ("norwegian", "google", "no"), (" English UK ", "DeepLX", "en-GB"), ("english-us", "bing", "en"), ("portuguese_pt", "google", "pt"), ("portuguese_pt", "bing", "pt-PT"), ("tagalog", "bing", "fil"),
        ("persian", "deeplx", "zh-Hans"), ("persian", "google", "fa"), ("klingon", "google", "zh-CN"), ("german", "nobody", "zh-CN"), (None, "bing", "zh-Hans"), ("german", None, "zh-CN"), ("", "deeplx", "zh-Hans"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, l string, s string")
    assert [r["c"] for r in df.select("i", target_code("l", "s").alias("c")).orderBy("i").collect()] == [c for _, _, c in cases]
    assert set(service_codes("google")) == set(CODES) and not service_codes("x") and all(set(v) <= set(CODES) for v in OWN_CODES.values())


def test_translators_by_name(spark):
    c = cues(spark, [(i * 10, i * 10 + 5, t) for i, t in enumerate(["a", " ", *"bcdefg"])])
    got = [tuple(r) for r in translators.requests(c, " Google ", "german").orderBy("batch_no").collect()]
    assert got == [(1, 0, "google", "de", [0, 2, 3, 4, 5], ["a", "b", "c", "d", "e"]), (1, 1, "google", "de", [6, 7], ["f", "g"])]
    assert [len(r["texts"]) for r in translators.requests(c, "openai", "German", size=4).orderBy("batch_no").collect()] == [4, 3]
    assert {r["target"] for r in translators.requests(c, "openai", "German").collect()} == {"German"} and {r["target"] for r in translators.requests(c, "bing").collect()} == {"zh-Hans"}
    table = spark.createDataFrame([(1, 0, "z"), (1, 0, "A"), (1, 2, " "), (9, 9, "q")], "media_id long, cue_idx int, translation string")
    out, missing = translators.translate(c, "BING", {"bing": table})
    assert [r["translated_text"] for r in out.orderBy("cue_idx").collect()][:3] == ["A", "", ""] and missing.count() == 7 and out.count() == 8
    assert translators.requests(c.limit(0), "bing").count() == 0
    with pytest.raises(ValueError, match="openai"):
        translators.translator("babel")
    with pytest.raises(ValueError, match="no table of 'google'"):
        translators.translate(c, "google", {"bing": table})


def test_profiles_keep_up_with_names():
    old = {"tail_dwell": True, "tail_dwell_long_ms": 700, "tail_dwell_long_gap_ms": 2500, "tail_dwell_short_ms": 5, "qa_report": True, "speed_profile": "smooth"}
    assert profiles.config_of(old) == PostprocessConfig(tail_compensation=True, max_compensation_ms=700, max_compensation_gap_ms=2500, speed_preset="smooth")
    assert profiles.migrated({"tail_dwell_long_ms": 700, "max_compensation_ms": 600}) == {"max_compensation_ms": 600}
    # The curve is too steep for today's rule: all three values fall back, the switch stays.
    assert profiles.config_of({"tail_dwell": True, "tail_dwell_long_ms": 5000, "max_gap_ms": 700}) == PostprocessConfig(tail_compensation=True, max_gap_ms=700)
    with pytest.raises(ValueError, match="unknown setting: tail_dwelling"):
        profiles.config_of({"tail_dwelling": 1})
    with pytest.raises(ValueError, match="gap_mode"):
        profiles.config_of({"gap_mode": "x", "tail_dwell_long_ms": 5000})
    p = profiles.Profile.read({"profile_id": "my.one", "name": " Mine ", "template": "loose", "settings": old})
    assert p.name == "Mine" and p.config.tail_compensation and p.reset().config == profiles.baseline("loose") == PostprocessConfig(speed_optimize=True, speed_preset="loose")
    for stored in ({"profile_id": "smooth"}, {"profile_id": "A"}, {"profile_id": "x" * 65}, {"name": " "}, {"name": "a\tb"}, {"name": "x" * 81}, {"template": "none"}):
        with pytest.raises(ValueError):
            profiles.Profile.read({"profile_id": "p", "name": "n", "template": "loose", **stored})


def test_profiles_in_a_column(spark):
    rows = [{"tail_dwell": True, "tail_dwell_long_ms": 700, "max_compensation_ms": 600, "tail_dwell_short_ms": 1, "min_gap_ms": 9}, {}, {"a": None}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(3, "{broken"), (4, None)], "i int, s string")
    got = [r["m"] for r in df.select("i", profiles.migrated_json("s").alias("m")).orderBy("i").collect()]
    assert got == [{"min_gap_ms": "9", "max_compensation_ms": "600", "tail_compensation": "true"}, {}, {"a": None}, None, None]


def test_voices_by_provider(spark):
    known = spark.createDataFrame([("gemini", "Puck", "Puck"), ("edge", "jenny", "en-US-JennyNeural"), ("siliconflow", "alex", "M:alex"), ("siliconflow", "ALEX", "Z:alex")], "provider string, alias string, voice_id string")
    cases = [
        ("gemini", "puck", "Puck", None), ("gemini", "Nobody", "Nobody", "unknown_voice"), ("gemini", "", "", None), ("gemini", None, None, None), ("edge", "JENNY", "en-US-JennyNeural", None), ("edge", "de-DE-XNeural", "de-DE-XNeural", None), ("edge", "x", "x", "no_voice_id"),
        ("edge", "de-XNeural", "de-XNeural", "no_voice_id"), ("siliconflow", "Alex", "M:alex", None), ("siliconflow", "new", "m:new", None), ("siliconflow", "a/b", "a/b", "no_voice_id"), ("siliconflow", "a:b", "a:b", None), ("other", "x", "x", None), (None, "x", "x", None),
    ]
    w = spark.createDataFrame([(i, p, "m", v) for i, (p, v, _, _) in enumerate(cases)], "i int, provider string, model string, voice string")
    got = [(r["voice_id"], r["problem"]) for r in joins.resolve_voices(w, known).orderBy("i").collect()]
    assert got == [(v, p) for _, _, v, p in cases]


def test_stages_follow_each_other_in_names(spark):
    cases = {"/a/【转录字幕】【字幕】film.ass": "/a/【x】film.srt", "film": "【x】film.srt", "s3://b/c.d/【其他】f.v1.vtt": "s3://b/c.d/【x】【其他】f.v1.srt", "/a/.hidden": "/a/【x】.hidden.srt", "/a/f【字幕】.srt": "/a/【x】f【字幕】.srt"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["q"] for r in df.select("p", writers.stage_path("p", "x").alias("q")).collect()} == cases


def test_anchors_equal_all_pairs(spark):
    spans = [(w, c, c, 7 * c, 7 * c + (0 if c == 2 else 7 if c != 4 else 3)) for w in ("u", "v") for c in range(6)]
    anchors = [(w, n, n * 3 - 2, n * 3 + 1) for w in ("u", "v", "none") for n in range(20)] + [("u", 5, 13, 16)]
    got = joins.anchor_owner(spark.createDataFrame(anchors, "window_id string, anchor_no long, from_char int, to_char int"), spark.createDataFrame(spans, "window_id string, cue_id int, ord int, a int, b int"))
    plain = lambda w, m: None if w == "none" else next((c for x, c, _, a, b in spans if x == w and a <= m < b), 5)
    assert sorted(str((r["window_id"], r["anchor_no"], r["cue_id"])) for r in got.collect()) == sorted(str((w, n, plain(w, (a + b) / 2))) for w, n, a, b in anchors)


def test_every_window_has_evidence(spark):
    c = cues(spark, [(0, 900, "one two"), (1000, 1900, "three"), (9000, 9900, "four"), (30_000, 31_000, "five")])
    plans = edit.alignment_windows(c, reset_ms=1500)
    words = spark.createDataFrame([(1, 0, 0, 0, 400, "one"), (1, 0, 1, 500, 900, "two"), (1, 0, 2, 1000, 1900, "three"), (1, 1, 0, 0, 10, "zzz")], "media_id long, window_no int, pos int, start_ms long, end_ms long, text string")
    graded = structure.word_evidence(plans, c, words)
    got = structure.with_fallback(graded.where("window_no < 2"), plans, c).orderBy("window_no").collect()
    assert [(r["window_no"], r["grade"], r["provenance"], r["failure"]) for r in got] == [(0, "HIGH", "alignment", None), (1, "LOW", "subtitle_input", "unaligned"), (2, "LOW", "subtitle_input", "no_words")]
    assert [[(a["cue_idx"], a["start_ms"], a["end_ms"]) for a in r["anchors"]] for r in got[1:]] == [[(2, 9000, 9900)], [(3, 30_000, 31_000)]]
    bounds = {r["cue_idx"]: (r["speech_start_ms"], r["boundary_budget_ms"]) for r in structure.evidence_bounds(structure.with_fallback(graded, plans, c)).collect()}
    assert bounds[2] == (9000, 250) and bounds[3] == (30_000, 250) and bounds[0][1] == 1000
    assert structure.edit_structure(c, structure.with_fallback(graded, plans, c))[0].where(F.col("media_id") == 1).count() >= 3
