"""Operators that carry a state through cues, held against plain folds."""

from __future__ import annotations

import random

from cuelake.operators import edit

#: Opening (True), closing (False) and straight (None) quotes by kind.
QUOTES = {"“": (0, True), "”": (0, False), "「": (0, True), "」": (0, False), '"': (0, None), "‘": (1, True), "’": (1, False), "『": (1, True), "』": (1, False), "'": (1, None)}


def cues(spark, rows, media=1):
    return spark.createDataFrame([(media, i, 1000 * i, 1000 * i + 900, a, b) for i, (a, b) in enumerate(rows)], "media_id long, cue_idx int, start_ms long, end_ms long, text string, translated_text string")


def fold_quotes(texts):
    opens, out = [True, True], []
    for t in texts:
        line = ""
        for i, c in enumerate(t or ""):
            kind, opening = QUOTES.get(c, (None, None))
            around = t[max(0, i - 1) : i] + t[i + 1 : i + 2]
            if kind is None or (c == "'" and len(around) == 2 and around.isascii() and around.isalpha()):
                line += c
                continue
            opening = opens[kind] if opening is None else opening
            line += ("「」", "『』")[kind][0 if opening else 1]
            opens[kind] = not opening
        out.append(line)
    return out


def test_quotes_equal_a_fold(spark):
    r = random.Random(5)
    some = lambda: None if r.random() < 0.05 else "".join(r.choice("ab 好\n$\\1" + "\"\"\"'''" + "“”‘’「」『』") for _ in range(r.randrange(14)))
    media = {m: [(some(), some()) for _ in range(60)] for m in range(1, 5)}
    media[5] = [('"' * 5001, "'" * 4000), ('x"', "y'"), ("", ""), ('"', "'")]
    df = cues(spark, media[1], 1)
    for m in range(2, 6):
        df = df.unionByName(cues(spark, media[m], m))
    got = {(x["media_id"], x["cue_idx"]): (x["text"], x["translated_text"]) for x in edit.normalize_quotes(df).collect()}
    for m, rows in media.items():
        want = list(zip(fold_quotes([a for a, _ in rows]), fold_quotes([b for _, b in rows]), strict=True))
        assert [got[m, i] for i in range(len(rows))] == want
    plan = edit.normalize_quotes(df)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_summaries_fill_packs_and_never_stand_still(spark):
    pack = lambda sizes, room: [x["pack"] for x in edit.pack_summaries(spark.createDataFrame([(1, i, "a" * (3 * n)) for i, n in enumerate(sizes)], "media_id long, pos int, text string"), room).orderBy("pos").collect()]
    assert pack([4, 4, 4, 9, 1, 30, 2], 10) == [0, 0, 1, 2, 2, 3, 4]
    assert pack([40, 40, 40], 10) == [0, 0, 1] and pack([3], 10) == [0]
