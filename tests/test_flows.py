"""Whole flows, recogniser responses, spans, reports and the joins whose order or scope matters."""

from __future__ import annotations

import json
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuelake.cues import CUES
from cuelake.functions import text
from cuelake.operators import edit, filters, joins, metrics, recognition, structure, validate, windows
from cuelake.plans import pipelines
from cuelake.policy import PostprocessConfig, SpeedPolicy
from cuelake.sources import readers, writers


def cues(spark, rows, media=1):
    return spark.createDataFrame([(media, i, a, b, t, "") for i, (a, b, t) in enumerate(rows)], CUES)


def test_linear_timing_gives_every_piece_a_millisecond(spark):
    rng = random.Random(2)
    for total, pieces in ((3, ["w"] * 8), (0, ["a", "b c"]), (50, [" ".join(["x"] * rng.randint(1, 30)) for _ in range(40)]), (7, ["one"])):
        df = spark.createDataFrame([(1, i, t, total) for i, t in enumerate(pieces)], "media_id long, pos int, text string, total_ms long")
        got = [(r["start_ms"], r["end_ms"]) for r in windows.linear_timing(df).orderBy("pos").collect()]
        weights, at, upto, want = [max(1, len(t.split())) for t in pieces], 0, 0, []
        for i, w in enumerate(weights):
            upto += w
            end = max(total, 1) if i == len(pieces) - 1 else round(max(total, 1) * upto / sum(weights))
            end = max(end, at + 1)
            want.append((at, end))
            at = end
        assert got == want


def test_recogniser_responses_take_their_routes(spark):
    text_ = " ".join(f"w{i}" for i in range(30))
    responses = spark.createDataFrame([(1, f"<text>{text_}</text>", 30_000), (2, text_, 30_000), (3, text_, 10_000), (4, " <think> ", 5_000), (5, text_, 30_000)], "media_id long, text string, duration_ms long")
    item = lambda m, n, step: [(m, i * step, i * step + step - 10, f"w{i}") for i in range(n)]
    items = spark.createDataFrame(item(1, 30, 1000) + item(3, 30, 400) + item(5, 5, 1000), "media_id long, start_ms long, end_ms long, text string")
    speech = spark.createDataFrame([(2, 1_000, 9_000), (2, 20_000, 29_000)], "media_id long, start_ms long, end_ms long")
    got, routes = recognition.response_cues(responses, items, speech)
    by = {r["media_id"]: r["route"] for r in routes.collect()}
    assert by == {1: "aligned", 2: "estimated", 3: "degraded", 4: "silence", 5: "estimated"}
    rows = {}
    for r in got.orderBy("media_id", "cue_idx").collect():
        rows.setdefault(r["media_id"], []).append(r)
    assert set(rows) == {1, 2, 3, 5} and len(rows[1]) == 30 and max(r["end_ms"] for r in rows[3]) <= 10_000
    assert " ".join(r["text"] for r in rows[2]) == text_ and all(not (9_000 < r["start_ms"] < 20_000) for r in rows[2])
    _, strict = recognition.response_cues(responses, items, speech, degraded=False)
    assert {r["media_id"]: r["route"] for r in strict.collect()} == {1: "aligned", 2: "rejected", 3: "rejected", 4: "silence", 5: "rejected"}
    _, loose = recognition.response_cues(responses, items, speech, need_words=False)
    assert {r["media_id"]: r["route"] for r in loose.collect()} == {1: "aligned", 2: "estimated", 3: "aligned", 4: "silence", 5: "aligned"}


def test_retry_spans(spark):
    c = spark.createDataFrame([(1, 0, 10_001, 3), (1, 1, 60_000, 2), (1, 2, 0, 2)], "media_id long, chunk_idx int, total_ms long, parts int")
    rows = lambda d: [tuple(r) for r in d.orderBy("chunk_idx", "part").collect()]
    assert rows(recognition.retry_spans(c)) == [(1, 0, 0, 0, 3333), (1, 0, 1, 3333, 6666), (1, 0, 2, 6666, 10_001), (1, 1, 0, 0, 30_000), (1, 1, 1, 30_000, 60_000)]
    s = spark.createDataFrame([(1, 1, 26_000, 28_000)], "media_id long, chunk_idx int, start_ms long, end_ms long")
    assert rows(recognition.retry_spans(c, s))[3:] == [(1, 1, 0, 0, 30_000), (1, 1, 1, 24_000, 60_000)]


def test_payload_spans_equal_the_recursion(spark):
    def cut(a, b, size, most):
        if size <= most or b - a <= 1000:
            return [(a, b)]
        at = a + max(1000, min(b - a - 1, int((b - a) * most / size * 0.95)))
        return [(a, at), *cut(at, b, size * (b - at) / (b - a), most)]

    rows = [(1, 0, 0, 60_000, 900_000), (1, 1, 5_000, 65_000, 2_000_000), (2, 0, 0, 800, 10**9), (2, 1, 0, 30_000, 100), (2, 2, 0, 4_000, 10**8), (2, 3, 7, 7, 5)]
    got = recognition.payload_spans(spark.createDataFrame(rows, "media_id long, chunk_idx int, start_ms long, end_ms long, bytes long"), 250_000).collect()
    for m, k, a, b, size in rows:
        want = cut(a, b, size, 250_000) if b > a else []
        mine = sorted((r["start_ms"], r["end_ms"]) for r in got if (r["media_id"], r["chunk_idx"]) == (m, k))
        assert len(mine) == len(want) and all(abs(x - y) <= 2 * len(want) for p, q in zip(mine, want, strict=True) for x, y in zip(p, q, strict=True)), (m, k)


@pytest.mark.parametrize("name,code,told", [("English", "en", "en"), ("zh_CN", "zh", "zh"), ("Cantonese", "yue", "zh"), ("pt-BR", "pt", "auto"), (None, "", "auto"), ("xx", "xx", "auto")])
def test_language_codes(spark, name, code, told):
    r = spark.createDataFrame([(name,)], "n string").select(text.language_code("n").alias("c"), text.speech_language("n").alias("s")).first()
    assert (r["c"], r["s"]) == (code, told)


def test_keys_markup_and_clock(spark):
    df = spark.createDataFrame([("a", "b", None), ("ab", "", None), ("a", "b", ""), ("a", "b", None)], "x string, y string, z string")
    keys = [r[0] for r in df.select(text.content_key("x", "y", "z")).collect()]
    assert len(set(keys)) == 3 and keys[0] == keys[3]
    df = spark.createDataFrame([("<Transcript>Hi there.Now</transcript> think>  go", 61_230)], "t string, ms long")
    r = df.select(text.strip_markup("t").alias("t"), text.lrc_time(F.col("ms")).alias("c")).first()
    assert (r["t"], r["c"]) == ("Hi there. Now go", "01:1.23")


def test_stage_summaries_and_grades(spark):
    rows = [(1, "translate", "cues", 12, False, 2), (1, "translate", "failed", 3, True, 2), (1, "split", "cues", 4, False, 0), (1, "split", "fallback", 0, True, 0)]
    got = {r["stage"]: (r["line"], r["status"]) for r in metrics.stage_summaries(spark.createDataFrame(rows, "media_id long, stage string, label string, value long, failed boolean, warnings int")).collect()}
    assert got == {"translate": ("translate · 12 cues · 3 failed · ⚠ 2 [degraded]", "degraded"), "split": ("split · 4 cues", None)}
    g = spark.createDataFrame([(1, "LOW"), (1, "HIGH"), (1, "HIGH"), (2, "MEDIUM")], "media_id long, grade string")
    assert [tuple(r) for r in metrics.grade_counts(g).collect()] == [(1, "HIGH", 2), (1, "LOW", 1), (2, "MEDIUM", 1)]


def test_reports(spark):
    seg = spark.createDataFrame([(1, 1, "a", 0, 900, "hello", None, "v", 1000, 900, 1.11119, None), (1, 0, "b", 0, 9, "x", "y", "w", 1, 1, 1.0, "late")], "media_id long, idx int, speaker string, start_ms long, end_ms long, text string, rewritten_text string, voice string, synthesized_ms long, fitted_ms long, speed_factor double, warning string")
    r = json.loads(writers.dubbing_report(seg, spark.createDataFrame([(1, "w")], "media_id long, warning string")).first()["content"])
    assert r["warnings"] == ["w"] and [s["index"] for s in r["segments"]] == [0, 1] and r["segments"][1]["speed_factor"] == 1.1112 and r["segments"][1]["warning"] is None
    e = spark.createDataFrame([(1, 1, "LOW", 0.5), (1, 0, "HIGH", 1.0)], "media_id long, window_no int, grade string, coverage double")
    prints = spark.createDataFrame([(1, "s", None), (2, "t", "m")], "media_id long, subtitle_fingerprint string, media_fingerprint string")
    a = writers.timing_archive(e, prints).first()
    told = json.loads(a["content"])
    assert [told[k] for k in ("schema_version", "media_id", "subtitle_fingerprint", "media_fingerprint")] == [1, 1, "s", None] and list(told) == sorted(told)
    assert [{k: v for k, v in w.items() if k != "window_fingerprint"} for w in told["windows"]] == [{"coverage": 1.0, "grade": "HIGH", "window_no": 0}, {"coverage": 0.5, "grade": "LOW", "window_no": 1}]
    assert a["content"] == writers.timing_archive(e.orderBy("grade"), prints).first()["content"]
    c = cues(spark, [(0, 300, "much too long a text for that"), (2000, 9000, "short one")])
    done = pipelines.postprocess(c, PostprocessConfig(fix_gaps=True, speed_optimize=True, tail_compensation=True))
    q = {r["measure"]: (r["before"], r["after"]) for r in writers.quality_report(done.metrics_before, done.metrics_after, done.changes, done.issues).collect()}
    assert q["unresolved_hard"][0] == 1.0 and q["changed_end_ms"][1] >= 1


def test_tails_follow_the_speed_pass(spark):
    c = cues(spark, [(0, 400, "much too long a text for that time"), (5000, 6000, "ok then"), (9000, 9900, "the last one")])
    plain = pipelines.postprocess(c, PostprocessConfig(speed_optimize=True)).cues
    both = pipelines.postprocess(c, PostprocessConfig(speed_optimize=True, tail_compensation=True)).cues
    a, b = ({r["cue_idx"]: r["end_ms"] for r in d.collect()} for d in (plain, both))
    want = {r["cue_idx"]: r["end_ms"] for r in windows.compensate_tails(plain, PostprocessConfig(speed_optimize=True, tail_compensation=True)).collect()}
    assert b == want and b != a


def test_rewrites_enter_the_speed_pass_if_they_help(spark):
    rows = [(0, 600, "A very long line that nobody could ever read in time here"), (600, 1800, "next"), (1800, 3000, "and on")]
    c = cues(spark, rows)
    short, idx = "A very long line that nobody could read in time", [0, 1, 2]
    repairs = lambda t: spark.createDataFrame([(1, 1, idx, [t, "next", "and on"])], "media_id long, window_no int, cue_ids array<int>, texts array<string>")
    out, log = structure.accept_repairs(c, repairs(short))
    assert [r["status"] for r in log.collect()] == ["accepted"] and {r["text"] for r in out.collect()} == {short, "next", "and on"}
    out, log = structure.accept_repairs(c, repairs(rows[0][2] + " and even more of it"))
    assert [r["status"] for r in log.collect()] == ["rolled_back"] and {r["text"] for r in out.collect()} == {t for _, _, t in rows}
    candidates = spark.createDataFrame([(1, 1, 1, i, t) for i, t in zip(idx, [short, "next", "and on"], strict=True)], "media_id long, window_no int, attempt int, cue_idx int, text string")
    done = pipelines.postprocess(c, PostprocessConfig(speed_optimize=True), rewrites=candidates)
    assert short in {r["text"] for r in done.cues.collect()}


def full_search(texts, sentences, least=0.5, reach=30, wide=100, misses=5):
    """Runs by comparing every sentence with every run of words."""
    clean = lambda t: "".join(c for c in t.lower() if c.isalnum() or c.isspace()).strip()
    n, at, done, far, missed, runs, taken = len(texts), 0, 0, reach, 0, [], []
    for s, size in sentences:
        if at >= n:
            break
        best = (0.0, 0, 0)
        for k in sorted(range(max(1, size // 2), min(2 * size, n - at) + 1), key=lambda k: (abs(k - size), k)):
            for a in range(at, min(at + far + 1, n - k + 1)):
                q = SequenceMatcher(None, clean(s), clean("".join(texts[a : a + k]))).ratio()
                if q > best[0]:
                    best = (q, a, k)
            if best[0] == 1.0:
                break
        taken.append(best)
        if best[0] < least:
            missed += 1
            if missed > misses:
                break
            far, at = wide, min(at + 1, n)
            continue
        a, b = max(best[1], done), best[1] + best[2]
        runs += [(done, a, False)] * (a > done) + [(a, b, True)]
        at, done, far, missed = b, b, reach, 0
    return runs + [(done, n, False)] * (done < n), taken


@pytest.mark.parametrize("lost", ["none", "third", "swapped", "foreign", "long"])
def test_sentences_take_the_runs_that_a_full_search_takes(lost):
    rng = random.Random(sum(map(ord, lost)))
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [rng.choice(vocabulary) + rng.choice([" ", " ", "  ", ", "]) for _ in range(160)]
    sentences, at = [], 0
    while at < 150:
        n = rng.randint(4, 9) if lost != "long" else rng.randint(30, 50)
        words = [t.strip(" ,") for t in texts[at : at + n]]
        if lost == "third":
            words = [w for i, w in enumerate(words) if i % 3 != 1]
        elif lost == "swapped":
            rng.shuffle(words)
        elif lost == "foreign" and rng.random() < 0.4:
            words = ["".join(rng.choice("qrstuvwxyzab") for _ in range(5)) for _ in words]
        elif lost == "long":
            words[3] = "something else"
        sentences.append((" ".join(words), len(words)))
        at += n
    runs, _ = full_search(texts, sentences)
    assert structure.matched_runs(texts, sentences, 0.5, 30, 100, 5) == runs and (lost in ("swapped", "foreign") or any(m for *_, m in runs))


def test_after_too_many_misses_the_rest_is_left():
    texts = [f"word{i} " for i in range(40)]
    sentences = [("qqq zzz", 2)] * 6 + [("word20 word21", 2)]
    assert structure.matched_runs(texts, sentences, 0.5, 30, 100, 5) == [(0, 40, False)] == full_search(texts, sentences)[0]
    assert structure.matched_runs(texts, sentences[1:], 0.5, 30, 100, 5) == full_search(texts, sentences[1:])[0] == [(0, 20, False), (20, 22, True), (22, 40, False)]
    assert structure.matched_runs(texts, [("", 0), (" ", 1)], 0.5, 30, 100, 5) == [(0, 40, False)] and structure.matched_runs([], [("a", 1)], 0.5, 30, 100, 5) == []


def test_taken_runs_are_cut_at_gaps_and_halved_and_the_rest_by_rules(spark):
    said = [f"w{i} " for i in range(50)]
    start = [i * 100 + (2000 if i >= 3 else 0) + (700 if i >= 45 else 0) for i in range(50)]
    words = spark.createDataFrame([(m, i, start[i], start[i] + 90, t) for m in (1, 2) for i, t in enumerate(said)], "media_id long, cue_idx int, start_ms long, end_ms long, text string")
    sentences = [(1, 0, " ".join(t.strip() for t in said[1:42])), (1, 1, None), (3, 0, "no such media")]
    got = structure.sentences_to_cues(words, spark.createDataFrame(sentences, "media_id long, pos int, text string")).collect()
    assert {r["media_id"] for r in got} == {1, 2}
    one = sorted((r for r in got if r["media_id"] == 1), key=lambda r: r["cue_idx"])
    lines = [r["text"].split() for r in one]
    assert [w for t in lines for w in t] == [t.strip() for t in said]
    assert [len(t) for t in lines][:2] == [1, 2] and not one[0]["matched"] and one[1]["matched"]  # w0; w1 w2 up to the gap
    assert max(map(len, lines)) <= 18 and sum(len(t) for t, r in zip(lines, one) if r["matched"]) == 41
    assert [t for t, r in zip(lines, one) if not r["matched"]][1:] == [["w42", "w43", "w44"], ["w45", "w46", "w47", "w48", "w49"]]  # a gap over 500 ms
    plain = edit.segment(words.where("media_id = 2")).orderBy("cue_idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in sorted((r for r in got if r["media_id"] == 2), key=lambda r: r["cue_idx"])] == [(r["start_ms"], r["end_ms"], r["text"]) for r in plain]


def test_issues_keep_their_order(spark):
    schema = "media_id long, cue_idx int, issue_no int, categories array<string>, message string"
    model = spark.createDataFrame([(1, 0, 2, ["b", "z"], "second"), (1, 0, 1, ["z", "a"], "first")], schema)
    local = spark.createDataFrame([(1, 0, 1, ["token", "a"], "first"), (1, 1, 1, ["empty"], "none")], schema)
    got = {r["cue_idx"]: (r["categories"], r["message"]) for r in joins.merge_issues(model, local).collect()}
    assert got == {0: (["z", "a", "b", "token"], "first; second"), 1: (["empty"], "none")}


def test_terms_in_any_script(spark):
    rows = [(1, 0, 0, 1, "The Old Mill of Kent", ""), (1, 1, 0, 1, "windmills", ""), (2, 0, 0, 1, "我喜欢北京烤鸭", ""), (2, 1, 0, 1, "北 京", ""), (3, 0, 0, 1, "C++ and mill", "")]
    c = spark.createDataFrame(rows, CUES)
    g = spark.createDataFrame([("m", "mill", ["old mill"], [0], 1), ("b", "北京", None, [9], 1), ("p", "++", None, [], 1), ("k", "mill of", None, [1], 2), ("j", "京", None, [], 1)], "entry_id string, source_term string, aliases array<string>, occurrence_ids array<int>, media_id long")
    got = sorted(tuple(r) for r in joins.term_hits(c, g).collect())
    assert got == [(1, 0, "k"), (1, 0, "m"), (2, 0, "b"), (2, 0, "j"), (2, 1, "j"), (3, 0, "m"), (3, 0, "p")]
    plain = {(r["entry_id"], r["media_id"]): r["cue_ids"] for r in joins.occurrences(c, g).collect()}
    assert plain[("m", 1)] == [0, 1] and plain[("b", 2)] == [0]
    assert sorted(tuple(r) for r in joins.relevant_entries(g, c).collect()) == [(1, "k"), (1, "m"), (2, "b"), (2, "j"), (2, "k"), (3, "m"), (3, "p")]
    d = spark.createDataFrame([(1, "Ａbc  d", None, ["x"], [3]), (2, "abc D", "", ["y", "x"], [1, 3])], "candidate_id int, term string, sense string, aliases array<string>, occurrences array<int>")
    assert [(r["term"], r["aliases"], r["occurrences"]) for r in validate.dedup_terms(d).collect()] == [("Ａbc  d", ["x", "y"], [1, 3])]


def test_substrings_equal_plain_search(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None]
    forms = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 5))) for _ in range(20)] + [""]
    got = joins.substring_hits(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), spark.createDataFrame(list(enumerate(forms)), "form_id int, form string"), ["k"])
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, t in enumerate(texts) for j, f in enumerate(forms) if f and t and f in t}
    c = cues(spark, [(0, 1, "buy our soap"), (1, 2, "hello"), (2, 3, "[noise]")])
    kept = filters.drop_made_up(c, spark.createDataFrame([("our soap",)], "phrase string")).collect()
    assert [r["text"] for r in kept] == ["hello"]


def test_sides_and_short_lines(spark):
    c = spark.createDataFrame([(1, 0, 0, 1, "hi", "你好"), (1, 1, 0, 1, "", "再见"), (1, 2, 0, 1, "only", ""), (1, 3, 0, 1, " ", "")], CUES)
    got = [(r["p"], r["k"]) for r in c.select(filters.primary_side(F.lit("original_on_top")).alias("p"), filters.cjk_side().alias("k")).collect()]
    assert got == [("translated_text", "translated_text"), ("translated_text", "translated_text"), ("text", None), (None, None)]
    u = spark.createDataFrame([(1, 0, "long one"), (1, 1, "other")], "media_id long, idx int, text string")
    out, n = joins.attach_short_lines(u, spark.createDataFrame([(1, 0, " one "), (1, 5, "gone"), (1, 1, " ")], "media_id long, idx int, text string"))
    assert sorted((r["idx"], r["rewritten_text"]) for r in out.collect()) == [(0, "one"), (1, None)] and tuple(n.first()) == (1, 3, 1)


def test_targets_of_a_segment_equal_those_of_the_tables(spark, tiny):
    """Timing finds its targets by itself; the operator over tables must give the same."""
    import numpy as np

    from cuelake.cues import read_cue_view
    from cuelake.functions.text import reading_load
    from cuelake.policy import SpeedPolicy

    policy = SpeedPolicy()
    c = read_cue_view(spark, tiny).unionByName(cues(spark, [(0, 0, "no time"), (0, 900, "a b c"), (900, 1500, "twin twin"), (1500, 2100, "twin twin"), (2100, 2700, "twin twin"), (9000, 9100, "far too much for so short a time")]).withColumn("media_id", F.lit(-1).cast("long")))
    want = {(r["media_id"], r["cue_idx"]): r["target_load"] for r in metrics.local_targets(c).collect()}
    m = windows.with_protection(windows.with_rhythm(c, policy.rhythm.pause_ms), policy).withColumn("l", reading_load("text", F.lit(None).cast("long"), policy))
    rows = m.select("media_id", "cue_idx", "start_ms", "end_ms", "rhythm_id", F.col("protected_by").isNotNull().alias("shielded"), "l.hard_s", "l.comfort_s").orderBy("media_id", "start_ms", "cue_idx").toPandas()
    got = {}
    for media, g in rows.groupby("media_id"):
        for i, t in zip(g["cue_idx"], edit._targets({n: v.to_numpy() for n, v in g.items()}, policy), strict=True):
            got[(media, i)] = t
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=0, atol=0)


def test_segments_are_cut_where_the_item_changes(spark):
    rows = spark.range(1000).selectExpr("id * id div 5000 media_id", "int(id) cue_idx").repartition(3, "media_id").sortWithinPartitions("media_id", "cue_idx")
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    f = lambda g: [g["media_id"][:1], g["cue_idx"][:1], [str(len(g["cue_idx"]))]]
    want = sorted((r["media_id"], r["a"], str(r["n"])) for r in rows.groupBy("media_id").agg(F.min("cue_idx").alias("a"), F.count("*").alias("n")).collect())
    try:
        for size in ("7", "100", "100000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, edit.per_segment(rows, f, "media_id long, cue_idx int, n string").collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    assert edit.per_segment(rows.limit(0), f, "media_id long, cue_idx int, n string").collect() == []


def test_likeness_equals_plain_blocks():
    from cuelake.functions.matching import Spots, bound, matching_letters, ratio

    rng = random.Random(11)
    for _ in range(1500):
        letters = "abcdefghijklmnopqrstuvwxyz é"[: rng.choice([2, 5, 28])]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 150, 260])))
        b = list(a)
        for _ in range(rng.randint(0, 10)):
            if b:
                p = rng.randrange(len(b))
                q = min(len(b), p + rng.randint(0, 20))
                b[p:q] = rng.choice([[], b[p:q] * 2, [rng.choice(letters)], b[p:q][::-1]])
        b = "".join(b) if rng.random() < 0.9 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio() <= bound(a, b) + 1e-12
        plain = SequenceMatcher(None, a, b, autojunk=False)
        assert ratio(a, b, frequent=False) == plain.ratio() and matching_letters(Spots(a), b, False) == sum(m.size for m in plain.get_matching_blocks())


def test_archives_give_back_what_was_written_and_name_what_was_changed(spark):
    schema = "media_id long, window_no int, grade string, coverage double, monotonic boolean, anchors array<struct<cue_idx:int,text:string,start_ms:bigint>>"
    window = schema.split(", ", 1)[1]
    rows = [(1, 0, "HIGH", 0.1 + 0.2, True, [(3, 'quote " and \\ and \n', 2**40)]), (1, 1, None, None, None, None), (1, 2, "LOW", 1e-7, False, []), (2, 0, "é😀", 1.0, True, [(1, None, 5)])]
    e = spark.createDataFrame(rows, schema)
    c = spark.createDataFrame([(m, i, i * 10, i * 10 + 5, f"t{i}", None) for m in (1, 2) for i in range(3)], CUES)
    prints = writers.subtitle_fingerprints(c).withColumn("media_fingerprint", F.lit("sound"))
    assert prints.count() == 2 and prints.select("subtitle_fingerprint").distinct().count() == 1  # alike but for the item
    files = writers.timing_archive(e, prints).select(F.concat(F.lit("p"), F.col("media_id").cast("string")).alias("path"), "content")
    good, bad = readers.timing_archive(files, prints, window)
    assert sorted(map(str, good.collect())) == sorted(map(str, e.collect())) and bad.count() == 0
    swap = lambda a, b: files.withColumn("content", F.replace("content", F.lit(a), F.lit(b)))

    def reasons(files, want=prints):
        good, bad = readers.timing_archive(files, want, window)
        return sorted((r["path"], r["window_no"], r["reason"]) for r in bad.collect()), good.count()

    assert reasons(swap('"grade":"HIGH"', '"grade":"LOWW"')) == ([("p1", 0, "window_fingerprint")], 3)
    assert reasons(swap('"media_fingerprint":"sound"', '"media_fingerprint":"other"')) == ([("p1", None, "media_fingerprint"), ("p2", None, "media_fingerprint")], 0)
    assert reasons(swap('"schema_version":1', '"schema_version":2')) == ([("p1", None, "unsupported_version"), ("p2", None, "unsupported_version")], 0)
    assert reasons(swap('"windows":[', '"wind":[')) == ([("p1", None, "no_windows"), ("p2", None, "no_windows")], 0)
    assert reasons(swap("{", "<")) == ([("p1", None, "not_json"), ("p2", None, "not_json")], 0)
    changed = writers.subtitle_fingerprints(c.withColumn("text", F.when(F.col("media_id") == 2, "new").otherwise(F.col("text")))).withColumn("media_fingerprint", F.lit(None).cast("string"))
    assert reasons(files, changed) == ([("p2", None, "subtitle_fingerprint")], 3)
    assert reasons(files, prints.where("media_id = 1")) == ([("p2", None, "unknown_media")], 3)


def test_a_rewrite_may_hold_a_line_break(spark):
    rows = [(0, 300, "A very long line that nobody could read in so short a time"), (300, 1300, "next"), (1300, 2300, "and on")]
    c = cues(spark, rows)
    candidates = spark.createDataFrame([(1, 1, 1, i, t) for i, t in enumerate(["A very long line\nthat nobody could read in time", "next", "and on"])], "media_id long, window_no int, attempt int, cue_idx int, text string")
    got = pipelines.repairs_of(c, candidates, SpeedPolicy()).collect()
    assert [(r["cue_ids"], r["texts"]) for r in got] == [([0, 1, 2], ["A very long line\nthat nobody could read in time", "next", "and on"])]


def test_lines_are_paired_by_what_stands_once(spark):
    from cuelake.functions.matching import paired_lines, same_lines

    assert same_lines(list("abcd"), list("acd")) == [(0, 0), (2, 1), (3, 2)] and paired_lines(list("abcd"), list("acd")) == ["a", "a", "c", "d"]
    assert paired_lines(["a", "x", "y", "b"], ["a", "1", "2", "3", "b"]) == ["a", "1", "2", "b"] and paired_lines(["x"], []) == [None] and paired_lines([], ["x"]) == []
    assert same_lines(["r", "r", "s", "r"], ["s", "r", "r"]) == [(2, 0), (3, 2)]  # ends first
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))]
        y = [t for t in x if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            y.insert(rng.randint(0, len(y)), rng.choice("abcxyz"))
        pairs = same_lines(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        assert len(pairs) >= 0.6 * sum(b.size for b in blocks)
    t0 = time.time()
    x = [f"line {i}" if i % 3 else "repeated" for i in range(100_000)]
    y = [t for i, t in enumerate(x) if i % 17]
    pairs = same_lines(x, y)
    assert len(pairs) >= len(y) - 6000 and time.time() - t0 < 20


def test_ranges_meet_as_in_all_pairs(spark):
    rng = random.Random(9)
    draw = lambda n, most: [(rng.randint(1, 2), k, a, a + rng.randint(0, most)) for k, a in ((k, rng.randint(-100_000, 500_000)) for k in range(n))]
    left, right = draw(80, 200_000) + [(3, 80, 0, 1), (1, 81, None, 5)], draw(80, 90_000) + [(1, 80, 60_000, 60_000), (2, 81, None, None)]
    schema = "media_id long, search_id int, start_ms long, end_ms long"
    got = windows.ranges_that_meet(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    want = [(*x, a, b) for x in left for m, _, a, b in right if m == x[0] and None not in (*x, a, b) and a < x[3] and b > x[2]]
    assert len(want) > 500 and sorted(map(tuple, got.select("media_id", "search_id", "start_ms", "end_ms", "a", "b").collect())) == sorted(want)


def test_offsets_never_fall_under_zero(spark):
    rng = random.Random(10)
    lengths = [rng.choice([2000, 9000, 30_000, 60_000]) for _ in range(40)]
    want, at = [], 0
    for n in lengths:
        want.append(at)
        at = max(0, at + n - 10_000)
    c = spark.createDataFrame([(1, i, n) for i, n in enumerate(lengths)], "media_id long, chunk_idx int, length_ms long")
    assert [r["offset_ms"] for r in windows.infer_offsets(c).orderBy("chunk_idx").collect()] == want
