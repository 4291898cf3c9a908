"""Rounds of rewrites, held against hand-made windows and a plain loop."""

from __future__ import annotations

import random

from cuelake.plans import rewrites

T, A = "window_id string, cue_id string, before string, most_graphemes int", "window_id string, attempt int, cue_id string, text string"


def rows(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_every_reason_is_told(spark):
    t = spark.createDataFrame([("w", "a", "pay 7 euros to the man now", 20), ("w", "a", "pay 7 euros to the man now", 20), ("w", "b", "do not go there today", None)], T)
    good = [("a", "pay 7 euros to him"), ("b", "do not go there")]
    cases = [
        (good, "accepted", []), (good[:1], "unresolved", ["b: missing"]), ([*good, ("c", "x")], "unresolved", ["c: extra"]), ([*good, good[0]], "unresolved", ["a: repeated"]), ([good[0], ("b", " ")], "unresolved", ["b: blank"]), ([good[0], ("b", None)], "unresolved", ["b: blank"]),
        ([good[0], ("b", " do not go there today")], "unresolved", ["b: unchanged"]), ([("a", "pay 7 euros to that man"), good[1]], "unresolved", ["a: 23 graphemes, at most 20"]), ([("a", "pay 8 euros to him"), ("b", "go there")], "rolled_back", ["a: critical_token_added", "a: critical_token_missing", "b: negation_changed"]),
        ([good[0], ("b", "not x")], "review", ["b: low_literal_coverage"]),
    ]
    a = spark.createDataFrame([("w", n, c, x) for n, (answer, _, _) in enumerate(cases) for c, x in answer] + [("unknown", 1, "a", "x")], A)
    assert rows(rewrites.judge(t, a)) == sorted(("w", n, v, tuple(f)) for n, (_, v, f) in enumerate(cases))
    settled = rewrites.judge(t, a, spark.createDataFrame([("w", 9, "accept"), ("w", 8, "accept"), ("w", 0, "reject")], "window_id string, attempt int, decision string"))
    assert {r["attempt"]: r["verdict"] for r in settled.collect()} | {9: "accepted", 8: "rolled_back", 0: "accepted"} == {r["attempt"]: r["verdict"] for r in settled.collect()}
    # Facts are told apart cue by cue: a number that moves from one cue to another is a loss.
    moved = rewrites.judge(t, spark.createDataFrame([("w", 1, "a", "pay euros to him"), ("w", 1, "b", "do not go there 7")], A)).first()
    assert moved["verdict"] == "rolled_back"


def test_rounds_equal_a_loop(spark):
    r = random.Random(3)
    names = [f"w{i}" for i in range(60)]
    kinds = {"good": ("take 5 of them home", "accepted"), "same": ("take 5 of them home now", "unresolved"), "lost": ("take of them home", "rolled_back"), "short": ("5", "review")}
    given = {w: [(n, r.choice(list(kinds))) for n in (1, 2, 3, 4)[: r.randrange(5)]] for w in names}
    t = spark.createDataFrame([(w, "a", "take 5 of them home now", 40) for w in names], T)
    a = spark.createDataFrame([(w, n, "a", kinds[k][0]) for w in names for n, k in given[w]], A)
    got = rewrites.settle(t, a)
    want = {"accepted": set(), "reviews": set(), "requests": set(), "given_up": set()}
    for w in names:
        n, end = 0, "requests"
        for n, k in given[w][:3]:
            if kinds[k][1] in ("accepted", "review"):
                end = {"accepted": "accepted", "review": "reviews"}[kinds[k][1]]
                break
        else:
            end = "given_up" if n == 3 else "requests"
        want[end].add((w, n + 1 if end == "requests" else n))
    assert {(x["window_id"], x["attempt"]) for x in got.accepted.collect()} == want["accepted"]
    assert {(x["window_id"], x["attempt"]) for x in got.reviews.collect()} == want["reviews"]
    assert {(x["window_id"], x["attempt"]) for x in got.requests.collect()} == want["requests"]
    assert {(x["window_id"], x["attempts"]) for x in got.given_up.collect()} == want["given_up"]
    told = {x["window_id"]: list(x["feedback"]) for x in got.requests.collect()}
    reason = {"same": "a: unchanged", "lost": "a: critical_token_missing"}
    assert all(told[w] == [reason[k] for _, k in given[w][:3]] for w in told)
    empty = rewrites.settle(t.limit(0), a)
    assert [d.count() for d in (empty.accepted, empty.reviews, empty.requests, empty.given_up)] == [0, 0, 0, 0]
