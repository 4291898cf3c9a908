"""Findings of round 4: what is worked out again, shuffled or sorted more often than the result needs."""

from __future__ import annotations

import os

import regex
from pyspark.sql import functions as F

from cuelake.cues import CUES
from cuelake.functions import matching, similarity
from cuelake.operators import edit, filters, joins, structure
from cuelake.plans import pipelines, queries
from cuelake.policy import PostprocessConfig, SpeedPolicy
from cuelake.storage import shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_edits_measure_only_what_is_proposed(monkeypatch):
    # all cues of a media item were measured, grapheme by grapheme, where no edit was proposed, and for every proposal that changed facts.
    calls = []
    own = structure._Editor.metrics
    monkeypatch.setattr(structure._Editor, "metrics", lambda self, cues: calls.append(len(cues)) or own(self, cues))
    cue = lambda i, a, b, t: {"cue_idx": i, "start_ms": a, "end_ms": b, "text": t, "translated_text": "", "cue_id": str(i), "parents": [], "operation": None}
    said = lambda *w: {i: [(a, b, t)] for i, a, b, t in w}
    e = structure._Editor([cue(0, 0, 3000, "one two"), cue(1, 9000, 12_000, "three")], SpeedPolicy())
    e.apply([{"window_no": 0, "grade": "HIGH", "said": said((0, 0, 2900, "one"), (1, 9000, 11_000, "three"))}])
    assert calls == [] and [c["text"] for c in e.cues] == ["one two", "three"]
    # Graphemes are measured as before, one at a time or as letters.
    p = SpeedPolicy()
    for t, want in (("ab, c!", (0.0, 3 + p.marks.weak + p.marks.strong + p.marks.space)), ("é 漢字", (2.0, 1 + p.marks.space)), ("\r\n", (0.0, p.marks.space)), ("", (0.0, 0.0)), ("👩‍👧x", (0.0, 2.0))):
        assert structure.units(t, p) == want and structure._pieces(t) == regex.findall(r"\X", t), t


def test_windows_find_their_cues_without_a_join(spark):
    # cues were shuffled by cue, by media item and by cue again.
    c = spark.createDataFrame([(m, i, 10 * i, 10 * i + 9, f"t{i}", "") for m in (1, 2, None) for i in range(6)], CUES)
    plans = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 4, 4), (1, 2, 9, 9), (2, 0, 0, 5), (3, 0, 0, 1), (None, 0, 0, 1)], "media_id long, window_no int, first_idx int, last_idx int")
    got = structure.cues_of_windows(plans, c, "text")
    assert "Join" not in plan(got)
    assert sorted((r["media_id"], r["window_no"], r["cue_idx"], r["text"]) for r in got.collect()) == sorted([(1, 0, 1, "t1"), (1, 0, 2, "t2"), (1, 1, 4, "t4"), *[(2, 0, i, f"t{i}") for i in range(6)]])


def test_rows_are_packed_as_lists(spark):
    # each word was a row of its own in the shuffle.
    rows = [(1, None, 5, "a"), (1, None, 7, None), (1, 2, -3, "c"), (2, 2, 8, "d"), (2, 2, 1, "e")]
    t = spark.createDataFrame(rows, "m long, w int, n long, t string").coalesce(1)
    assert [(r["m"], r["w"], r["n"], r["t"]) for r in edit.packed(t, ["m", "w"], "n").collect()] == [(1, None, [5, 2], ["a", None]), (1, 2, [-3], ["c"]), (2, 2, [8, -7], ["d", "e"])]
    plans = spark.createDataFrame([(1, 0, 0, 1, 0, 1000, 0, 1500)], "media_id long, window_no int, first_idx int, last_idx int, cue_start_ms long, cue_end_ms long, clip_start_ms long, clip_end_ms long")
    c = spark.createDataFrame([(1, 0, 0, 500, "Ab, cd", ""), (1, 1, 500, 1000, "ef", "")], CUES)
    words = spark.createDataFrame([(1, 0, 2, 500, 990, " ef "), (1, 0, 0, 0, 200, "Ab,"), (1, 0, 1, 200, 480, "cd"), (1, 0, 1, 100, 150, "-"), (1, 0, 3, None, 5, "ef"), (7, 0, 0, 0, 9, "x")], "media_id long, window_no int, pos int, start_ms long, end_ms long, text string").repartition(3)
    e = structure.word_evidence(plans, c, words).collect()
    assert [(r["grade"], r["coverage"], [tuple(a) for a in r["anchors"]]) for r in e] == [("HIGH", 1.0, [(0, "Ab,", 0, 200), (0, "cd", 200, 480), (1, "ef", 500, 990)])]


def test_sentences_that_stand_in_the_words_are_found_at_once(monkeypatch):
    # every run of half to twice a sentence's words was bounded letter by letter, and compared, where its own words stood there.
    tried = []
    monkeypatch.setattr(structure, "ratio", lambda a, b: tried.append(b) or matching.ratio(a, b))
    words = ["So ", "we ", "went ", "home ", "-- ", "so ", "we ", "ran ", "a ", "way "]
    assert structure.matched_runs(words, [("So we went home", 4), ("so we ran", 3)], 0.5, 30, 100, 5) == [(0, 4, True), (4, 5, False), (5, 8, True), (8, 10, False)] and not tried
    # Of equal runs the one of words nearest to the size wins; other spaces leave one run to compare.
    r = structure._Runs(["a ", "-", "b ", "a ", "b "])
    assert r.best("a b", 3, 1, 5, 0, 30, 0.5) == (1.0, 0, 3) and r.best("a b", 2, 1, 5, 0, 30, 0.5) == (1.0, 3, 2) and r.best("b", 1, 1, 2, 0, 30, 0.5) == (1.0, 2, 1)
    q = structure._Runs(words).best("so  we  ran a way", 5, 2, 10, 0, 30, 0.5)
    assert q[1:] == (5, 5) and set(tried) == {"so we ran a way"}
    # Short texts are compared by the same rule: the longest stretch, first in one, then in the other.
    long = lambda x, y: matching.matching_letters(matching.Spots(x + "~" * 200), y)
    for x, y in (("abcab", "cabab"), ("xaby abz", "abzab"), ("so  we ran", "so we  ran"), ("", "a"), ("aaaa", "aa")):
        assert matching.matching_letters(matching.Spots(x), y) == long(x, y), (x, y)


def test_words_are_numbered_without_a_shuffle(spark):
    # words were shuffled and sorted for their numbers.
    c = spark.createDataFrame([(1, 2, 90, 120, "e f", ""), (1, 0, 0, 40, "a, b", ""), (1, 1, 40, 90, "c -- d", ""), (2, 0, 0, 9, "x", "")], CUES)
    got = queries._word_cues(c)
    assert plan(got).count("Exchange") == 1
    assert sorted((r["media_id"], r["cue_idx"], r["text"].strip()) for r in got.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (1, 4, "e"), (1, 5, "f"), (2, 0, "x")]


def test_rewrites_are_compared_until_it_is_sure(spark, monkeypatch):
    # all common stretches were looked for, of texts that hold too few letters in order too.
    looked = []
    monkeypatch.setattr(matching, "stretches", lambda *a, _own=matching.stretches, **k: looked.append(a) or _own(*a, **k))
    assert not matching.shares("abcdefgh", "hgfedcba", 0.55) and not looked
    assert matching.shares("abcdefgh", "xabcdeyfgh", 0.55) and len(looked) == 1
    rows = [("".join(chr(97 + (i * k + i * i // 7) % 9) for i in range(n)), "".join(chr(97 + (i * m + i // 5) % 9) for i in range(60))) for k in (1, 2, 5) for m in (1, 3, 4) for n in (1, 20, 70, 230)]
    for x, y in rows:
        n = matching.matching_letters(matching.Spots(x), y, frequent=False)
        assert n <= matching.in_order(x, y)
        for least in (0.1, n / len(x), 0.55, 1.0):
            assert matching.shares(x, y, least) == (n / len(x) >= least), (x, y, least)
    t = spark.createDataFrame([("a b", "A, b!"), ("", "x"), (None, None), ("abcd", "dcba"), ("abcd", "abxx"), ("--", "q")], "a string, b string")
    got = t.select(F.coalesce(similarity.keeps_letters("a", "b", F.lit(0.55)), F.lit(None)).alias("k"), (similarity.literal_coverage("a", "b") >= 0.55).alias("want")).collect()
    assert all(r["k"] == r["want"] for r in got) and [r["k"] for r in got] == [True, True, True, False, False, True]


def test_few_forms_meet_texts_where_they_are(spark, monkeypatch):
    # words of all texts were shuffled with every form that they hold, and texts again.
    t = spark.createDataFrame([(0, "the cats sat"), (1, "cats  "), (2, None), (3, "x"), (4, "")], "k long, text string")
    f = spark.createDataFrame([("s", " "), ("e", "cats "), ("w", "cats"), ("n", None), ("z", ""), ("m", "ts s"), ("w", "cat")], "form_id string, form string")
    few = joins.substring_hits(t, f, ["k"])
    monkeypatch.setattr(joins, "FEW_FORMS", 0)
    many = joins.substring_hits(t, f, ["k"])
    assert plan(few).count("Exchange hashpartitioning") == 1 < plan(many).count("Exchange hashpartitioning")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(0, "e"), (0, "m"), (0, "s"), (0, "w"), (1, "e"), (1, "s"), (1, "w")]


def test_contexts_need_no_join_of_texts(spark):
    # F8: texts were shuffled by media item and again by row, hits three times.
    c = spark.createDataFrame([(m, 10 - i, 100 * i, 100 * i + 50, None if i == 1 else f"{m}.{i}", "") for m in (1, 2, None) for i in range(4)], CUES)
    hits = spark.createDataFrame([(1, 10, "a"), (1, 9, "b"), (2, 7, "a"), (2, 99, "a"), (3, 1, "a"), (None, 10, "a")], "media_id long, cue_idx int, entry_id string")
    got = joins.representative_contexts(hits, c, radius=1)
    assert "Join" not in plan(got)
    assert sorted(((r["media_id"], r["entry_id"], r["hit_row"], r["row"], r["text"]) for r in got.collect()), key=str) == sorted([
        (1, "a", 1, 1, "1.0"), (1, "a", 1, 2, None), (1, "b", 2, 1, "1.0"), (1, "b", 2, 2, None), (1, "b", 2, 3, "1.2"), (2, "a", 4, 3, "2.2"), (2, "a", 4, 4, "2.3"),
    ], key=str)


def test_repairs_shuffle_measures_of_texts(spark):
    # texts were shuffled for their music marks and blank sides, and the table before the speed pass was kept twice.
    c = spark.createDataFrame([(1, 0, 0, 900, "a ♪ b", ""), (1, 1, 900, 900, " ", None), (1, 2, 800, 2000, "x", "y")], CUES)
    p = plan(filters.integrity(c.repartition(3)))
    assert p.index("trim(text") > p.index("hashpartitioning")
    assert sorted(map(tuple, filters.integrity(c).collect())) == [(1, 1, "no_duration"), (1, 1, "no_text"), (1, 2, "out_of_order")]
    kept = lambda: len([x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith("before-speed")])
    before = kept()
    done = pipelines.postprocess(c, PostprocessConfig(speed_optimize=True)).cues
    assert kept() == before and [(r["cue_idx"], r["text"]) for r in done.orderBy("cue_idx").collect()] == [(0, "a ♪ b"), (1, " "), (2, "x")]


def test_words_of_a_media_item_are_shuffled_as_lists(spark):
    # a row for each word was shuffled and sorted twice, for bundles and for the fold.
    rows = [(m, i, 400 * i + 700 * (i // 7), 400 * i + 700 * (i // 7) + 390, f"w{i} ", "") for m in (1, 2, None) for i in range(40)]
    c = spark.createDataFrame(rows[::-1], CUES).repartition(3)
    p = plan(edit.segment(c))
    assert p.count("hashpartitioning") == 2 and p.count("MapInArrow") == 2
    got = sorted(edit.segment(c).collect(), key=str)
    assert len(got) == 18 and sorted((r["cue_idx"], r["first_idx"], r["last_idx"], r["text"]) for r in got if r["media_id"] == 2)[:2] == [(0, 0, 6, "w0 w1 w2 w3 w4 w5 w6"), (1, 7, 13, "w7 w8 w9 w10 w11 w12 w13")]
