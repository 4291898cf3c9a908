"""Steps that must grow no faster than their tables: what their plans hold, and results on odd rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.similarity import facts, repeats
from cuelake.operators import edit, filters, joins, metrics, stitch, structure, windows
from cuelake.plans import pipelines, rewrites
from cuelake.plans import queries as plans
from cuelake.plans import stored_queries  # noqa: F401
from cuelake.policy import SpeedPolicy

_CUES = "media_id long, cue_idx int, start_ms long, end_ms long, text string, translated_text string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_points_make_no_pairs(spark, tiny):
    # points and rows were paired, sixty rows a point, in one broadcast.
    assert "Join" not in plan(plans.queries()["partition_points"](spark, tiny))
    c = spark.createDataFrame([(1, i, 100 * i + 10 * (i == 3), 100 * i + 50, "a b c d", "") for i in range(5)] + [(2, 0, 0, 9, "x " * 50, "")], _CUES)
    got = sorted(map(tuple, windows.partition_points(c, 2, 30).collect()))
    assert got == [(1, n, 2) for n in range(1, 10)]


def test_words_of_cues_are_not_sorted(spark, tiny):
    # F12
    p = plan(windows.split_words(spark.createDataFrame([], _CUES)))
    assert "Window" not in p and "Sort" not in p
    c = spark.createDataFrame([(1, 0, 0, 90, "abcdefgh ab", ""), (1, 1, 5, 7, None, ""), (1, 2, 100, 90, "ab ab", "")], _CUES)
    got = [tuple(r) for r in windows.split_words(c).orderBy("cue_idx", "pos").collect()]
    assert got == [(1, 0, 0, 0, 60, "abcdefgh"), (1, 0, 1, 60, 90, "ab"), (1, 2, 0, 90, 90, "ab"), (1, 2, 1, 90, 90, "ab")]


def test_chunks_are_shuffled_once(spark, tiny):
    # F1, F6
    for name in ("chunk_alignment", "stitched_chunks"):
        p = plan(plans.queries()[name](spark, tiny))
        assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_terms_are_looked_up_by_neighbouring_words(spark):
    # one common word or three letters let a form meet most cues.
    f = spark.createDataFrame([("the Cat",), ("dog",), ("a-bcd ef",), ("猫",)], "form string")
    assert [r[0] for r in f.select(joins.word_key(F.col("form"))).collect()] == ["the cat", "dog", "bcd ef", None]
    assert f.select(joins.word_key(F.lit("of the big.Dog"))).first()[0] == "big.dog"
    assert joins.PIECE > 3
    t = spark.createDataFrame([(1, 0, "xthe cat, the cats"), (1, 1, "THE CAT"), (1, 2, "the  cat")], "media_id long, cue_idx int, text string")
    g = spark.createDataFrame([("e", "the cat", ["t"])], "entry_id string, source_term string, aliases array<string>")
    assert [r["cue_idx"] for r in joins.term_hits(t, g).collect()] == [1]
    # Forms of spaces, with spaces at their ends, and within words.
    x = spark.createDataFrame([(0, "a bcatsy d"), (1, "bcats y"), (2, None), (3, "cats")], "k int, text string")
    y = spark.createDataFrame([("s", " "), ("e", "cats "), ("w", "cats"), ("n", None), ("z", ""), ("m", "tsy d")], "form_id string, form string")
    assert sorted(map(tuple, joins.substring_hits(x, y, ["k"]).collect())) == [(0, "m"), (0, "s"), (0, "w"), (1, "e"), (1, "s"), (1, "w"), (3, "w")]
    hit = joins.occurrences(t, g).collect()
    assert [(r["media_id"], r["cue_ids"]) for r in hit] == [(1, [0, 1, 2])]


def test_anchors_find_owners_in_one_shuffle(spark):
    # F9
    s = spark.createDataFrame([("w", 1, 0, 0, 5), ("w", 2, 1, 5, 5), ("w", 3, 2, 5, 9)], "window_id string, cue_id int, ord int, a int, b int")
    a = spark.createDataFrame([("w", 0, 1, 2), ("w", 1, 4, 8), ("w", 2, 40, 49), ("v", 3, 0, 1)], "window_id string, anchor_no long, from_char int, to_char int")
    out = joins.anchor_owner(a, s)
    assert "Join" not in plan(out)
    assert sorted((r["anchor_no"], r["cue_id"]) for r in out.collect()) == [(0, 1), (1, 3), (2, 3), (3, None)]


@pytest.mark.parametrize("name", ["segment_words", "speech_timing", "alignment_windows", "merge_short", "adaptive_groups", "analysis_windows", "translation_batches", "packed_summaries", "silence_spans", "aligned_lines", "matched_sentences", "evidence_grades"])
def test_small_groups_share_a_pass(spark, tiny, name):
    # A pandas group for each media item.
    p = plan(plans.queries()[name](spark, tiny))
    assert "GroupsInPandas" not in p and "MapInArrow" in p


def test_pairs_of_tables_by_media_item(spark):
    left = spark.createDataFrame([(1, 1, 0, "b"), (1, 0, 0, "a"), (None, 0, 0, "n"), (3, 0, 0, None)], "media_id long, pos int, k int, text string")
    right = spark.createDataFrame([(1, 5, 0), (2, 7, 0)], "media_id long, pos int, k int")
    f = lambda m, x, y: [[m], ["".join(t or "-" for t in x["text"])], [sum(y["pos"].tolist())]]
    got = edit.per_two(left, right, f, "media_id long, t string, n long").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "ab", 5), (2, "", 7), (3, "-", 0), (None, "n", 0)]


def test_repeats_of_phrases():
    # F23
    for text, least, want in (("abcdefgh" * 3, 3, True), ("abcdefgh" * 2 + "abcdefg", 3, False), ("xy" + "abcdefghi" * 3 + "z", 3, True), (" " * 40, 3, False), ("a" * 24, 3, True), ("a" * 23, 3, False), ("p" * 30 + "q" * 30, 9, False), ("", 3, False)):
        assert repeats(text, least) is want, text


def test_texts_are_measured_once_for_the_audit(spark, tiny):
    # two scans, with the measures of a text worked out again for each use of them.
    p = plan(plans.queries()["audit"](spark, tiny))
    assert "Union" not in p and p.count("FileScan") == 1
    c = spark.createDataFrame([(1, 0, 0, 1000, "\u3000" + "字" * 12 + " ", None), (1, 1, 900, 900, "x", "\u2003"), (1, 2, 900, 9000, None, "ab"), (1, 3, 9000, 9500, "a b" * 4, "字" * 5 + "ab cd")], _CUES)
    got = sorted(((r["cue_idx"], r["kind"], r["is_cjk"], r["chars"]) for r in metrics.audit(c).collect()), key=str)
    assert got == [(0, "hard", True, 12), (1, "overlap", False, 1), (2, "long", False, None), (3, "hard", False, 12), (3, "hard", True, 9), (3, "short", True, 9)]
    # Nothing of the old forms is lost: white space of any kind at the ends, classes by the letter.
    odd = "".join(chr(i) for i in (*range(1, 0x3100), *range(0xFE00, 0xFFFE)))
    t = spark.createDataFrame([(f"{w}a{w}b{w}",) for w in odd] + [("",), (None,), ("\u3000 \t",), ("é字" * 3,), ("a字\U0001f600",)], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    n = F.length(T.squeeze("t"))
    cjk = F.coalesce((n > 0) & (F.regexp_count("t", F.lit(T.NO_SPACE)) / F.when(n > 0, n) > 0.5), F.lit(False))
    assert t.where(~T.strip("t").eqNullSafe(old) | (T.mainly_cjk("t") != cjk) | ~T.count_of(F.col("t"), r"\p{P}").eqNullSafe(F.regexp_count("t", F.lit(r"\p{P}")))).count() == 0


def test_issues_are_counted_in_one_scan(spark, tiny):
    # F19
    p = plan(plans.queries()["audit_counts"](spark, tiny))
    assert "Union" not in p and p.count("FileScan") == 1
    c = spark.createDataFrame([(m, i, 100 * i, 100 * i + 150, "ab cd ef", None) for m in (1, 2) for i in range(3)] + [(3, 0, 0, 2000, "字" * 20, "")], _CUES)
    got = sorted(map(tuple, metrics.audit_counts(metrics.audit(c)).collect()))
    assert got == [("comfort", True, 1, 1), ("hard", False, 6, 2), ("overlap", False, 4, 2), ("short", False, 6, 2)]


def test_batches_meet_their_texts_by_place(spark, tiny):
    # every batch met all cues of its media item, by a range of cue numbers, and texts went through two shuffles and a look for odd terms.
    g = spark.createDataFrame([("e", "a  cat", ["Dog"], "K")], "entry_id string, source_term string, aliases array<string>, translation string")
    c = spark.createDataFrame([(1, 5, 0, 9, "a  CAT", ""), (1, 3, 10, 19, "x", ""), (1, 1, 20, 29, "dog\"", ""), (2, 0, 0, 5, None, "")], _CUES)
    got = {(r["media_id"], r["window_no"]): r for r in pipelines.request_rows(c, g, "p", size=2).collect()}
    assert got[1, 0]["payload"] == '{"boundary_context":{"after":[{"id":"1","text":"dog\\""}],"before":[]},"terms":[{"source_term":"a  cat","translation":"K"}],"translation_subjects":[{"id":"3","text":"x"},{"id":"5","text":"a  CAT"}]}'
    assert got[1, 1]["payload"] == '{"boundary_context":{"after":[],"before":[{"id":"3","text":"x"},{"id":"5","text":"a  CAT"}]},"terms":[{"source_term":"a  cat","translation":"K"}],"translation_subjects":[{"id":"1","text":"dog\\""}]}'
    assert got[2, 0]["payload"] == '{"boundary_context":{"after":[],"before":[]},"terms":[],"translation_subjects":[{"id":"0"}]}' and len(got) == 3
    p = plan(pipelines.request_rows(c, g, "p"))
    assert "cue_idx" not in "".join(x for x in p.splitlines() if "Join" in x and ">=" in x)
    # Texts are fetched only for forms that are no keys of their own.
    assert plan(joins.term_hits(c, g)).count("Join") == 1 and [r["cue_idx"] for r in joins.term_hits(c, g).orderBy("cue_idx").collect()] == [1, 5]


def test_reports_of_a_repair_wait_until_asked(spark):
    # metrics before and after were worked out for a query that returns the cues.
    from cuelake.policy import PostprocessConfig
    from cuelake.storage import shared_folder

    kept = lambda: len([x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith("samples")])
    before = kept()
    r = pipelines.postprocess(spark.createDataFrame([(1, 0, 0, 900, "a b c", "")], _CUES), PostprocessConfig(speed_optimize=True))
    assert r.cues.count() == 1 and kept() == before
    assert r.metrics_before.count() == r.metrics_after.count() == 1 and r.changes.count() == 0 and r.issues.columns[0] == "kind" and kept() == before + 2
    # A line is looked at as a placeholder only if it begins as one; those are all found.
    yes = ["♪", " [\\NMusic\\N] ", "(speaking old greek)", "　♪ 笑♪", "[]", "Ho [x", "【掌声】\n", "♪ [Laughs] ♪", "NOISE"]
    no = ["", None, "musical", "♪ a", "[music", "no music", "x [music]", "speaking", "n", "\\N", "¡music!"]
    t = spark.createDataFrame([(x, k) for k, xs in enumerate((no, yes)) for x in xs], "t string, k int")
    assert t.where(filters.placeholder("t", ("noise", "", " ho [x")) != (F.col("k") == 1)).collect() == []
    # Reading units, counted by what is left of a text, are those counted one by one.
    u = spark.createDataFrame([("a, b! c… «d»",), ("漢字かなカナ한글 x、y。",), ("é　ᄀ々〇",), ("",), (None,)], "t string")
    x = F.coalesce("t", F.lit(""))
    n = lambda p: F.regexp_count(x, F.lit(p))
    marks, strong, cjk, space = n(r"\p{P}"), n(T.STRONG), n(T.CHARACTER_SCRIPT), n(r"(?U)\s")
    want = (F.length(x) - space - marks - cjk) + (marks - strong) * 0.25 + strong * 0.5
    assert u.where(x.rlike(T._PLAIN) & (T.reading_units("t", SpeedPolicy())["non_cjk"] != want)).count() == 0


def test_texts_of_answers_are_shuffled_once(spark):
    # texts of targets and answers were shuffled five times, and each was read for facts and graphemes it could not hold.
    t = spark.createDataFrame([("w", "a", " No cats ", None), ("w", "a", "No cats", None), ("w", "b", "5 dogs", 6), ("w", None, "x", None), ("v", "a", "one", None), (None, "a", "y", None)], "window_id string, cue_id string, before string, most_graphemes int")
    a = spark.createDataFrame([("w", 1, "a", "No cats ok"), ("w", 1, "b", "5 dogs!!"), ("w", 1, None, "z"), ("w", 2, "c", "q"), ("w", 2, "b", "5 dogs"), ("w", 2, "b", ""), ("u", 1, "a", "k"), ("v", 1, "a", "one ok"), (None, 1, "a", "b")], "window_id string, attempt int, cue_id string, text string")
    out = rewrites.judge(t, a)
    # The second one carries verdicts and reasons only.
    assert plan(out).count("Exchange hashpartitioning") == 2 and "Join" not in plan(out)
    got = {(r["window_id"], r["attempt"]): (r["verdict"], r["feedback"]) for r in out.collect()}
    assert got == {
        ("v", 1): ("accepted", []),
        ("w", 1): ("unresolved", ["b: 8 graphemes, at most 6", "extra", "missing"]),
        ("w", 2): ("unresolved", ["a: missing", "b: repeated", "b: unchanged", "c: extra", "missing"]),
    }
    # Texts that hold no digit, operator, backtick or link hold no fact; those that do are still read.
    assert [[f["display"] for f in facts(x)] for x in ("no facts: a-b, c", "www.a.b x", "HTTPS://q", "a^b", "`c`", "٣", "百分之", "3 km", "WwW.x")] == [[], ["www.a.b"], ["HTTPS://q"], ["a^b"], ["`c`"], ["٣"], [], ["3 km"], ["WwW.x"]]
    n = spark.createDataFrame([("I cannot, won't; know NO one, 无需 不再 aren't isn't nothing WITHOUT weren't never",)], "t string")
    assert n.select(T.negations("t")).first()[0] == ["cannot", "won't", "no", "无需", "不再", "aren't", "isn't", "without", "weren't", "never"]
