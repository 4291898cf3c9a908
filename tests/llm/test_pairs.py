"""Near-duplicates, benchmark leaks and neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from cuelake.llm import ann, common, decontaminate, simhash
from cuelake.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_fingerprint(text):
    w = SPACE.findall(lower(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if find(j) == find(i) and e is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "  \n\t"), (903, "One Two"), (904, "one two"), (905, "Ä ä É"), (905, "Ä ä É"), (None, "lonely words here now"), (907, "x y z " * 30_000)]
    return rows


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("hot", [64, 1, 0])
def test_simhash_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ENTRY", hot)
    rows = documents()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key)
    assert got == sorted(plain_components(rows), key=key)


def test_simhash_links_planted_bits(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << 3, f ^ 1 << 3 ^ 1 << 60, f ^ 7, f ^ 1 << 31 ^ 1 << 32}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(max(a, b), min(a, b)) for a in fps for b in fps if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    got = {(max(a, b), min(a, b)) for a, b in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == want


def test_one_per_group_keeps_columns_and_one_row(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    groups = {c for _, _, c in plain_components(rows)}
    got = simhash.one_per_group(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(ids, key=lambda x: (x is None, x)) == sorted(groups, key=lambda x: (x is None, x))
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, None)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("heavy", [1, 3, 10_000])
def test_heavy_keys_join_like_others(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY_KEYS", heavy)
    left = [(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (9, 2)) for i in range(n)]
    right = [(1, "a", 50), (2, "b", 3), (3, "c", 1), (4, "d", 0)]
    got = common.join_heavy(spark.createDataFrame(left, "k long, i int"), spark.createDataFrame(right, "k long, v string, n long"), "k", "n", len(left))
    want = sorted((k, i, v) for k, i in left for r, v, _ in right if r == k)
    assert sorted(map(tuple, got.select("k", "i", "v").collect())) == want
    hub = [(0, i) for i in range(1, 80)] + [(i, 1000 + i) for i in range(1, 80, 7)] + [(5000, 5001)]
    roots = dict(components(spark.createDataFrame(hub, "u long, v long")).collect())
    assert all(r == (5000 if n >= 5000 else 0) for n, r in roots.items()) and len(roots) == 80 + 12 + 2


def test_simhash_takes_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("7", "a b c d e"), ("x1", "a b c d e"), ("9", "q r s t u v w")], "doc_id string, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 7), (7, 7), (9, 9)]
    assert simhash.one_per_group(docs).count() == 2


def plain_leaks(docs, items):
    wins = []
    for i, t in items:
        w = WORD.findall(lower(t))
        if i is not None:
            wins += [(str(i), tuple(w[p : p + 10])) for p in range(max(1, len(w) - 9)) if w]
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("sent", [20_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", sent)
    monkeypatch.setattr(common, "HEAVY_KEYS", 10 if not sent else 10_000)
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "é1", "x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 14, 25])))) for i in range(14)]
    items += [(20, None), (21, ""), (None, "alpha beta gamma delta x alpha beta gamma delta x x"), (3, items[3][1])]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0 and w:
            src = WORD.findall(rng.choice(items[:14])[1])
            at = rng.randrange(len(w))
            w[at:at] = src[: rng.choice([len(src), 9, 10, 12])]
        docs.append((d, " , ".join(w).upper() if d % 5 == 0 else "-".join(w)))
    docs += [(7, docs[7][1]), (99, None), (None, docs[3][1]), (100, "!?"), (101, "alpha " * 30_000)]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, anchors string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.decontaminate(df, bench).collect()), key=key)
    assert got == sorted(plain_leaks(docs, items), key=key)
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == sorted((r[0] for r in plain_leaks(docs, items) if not r[5]), key=lambda x: (x is None, x))


def test_decontamination_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).first()["n_hit"] == 0
    assert decontaminate.decontaminate(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def recall(vectors, got, k=5):
    """Share of the true k nearest that were found; every query must have all its ranks, in order, with exact scores."""
    ids = np.array([i for i, _ in vectors])
    u = np.array([v for _, v in vectors], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    asked = [j for j, i in enumerate(ids) if i % 50 == 0]
    assert set(found) == {ids[j] for j in asked}
    right = 0
    for j in asked:
        s = u @ u[j]
        s[j] = -2
        mine = sorted(found[ids[j]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, min(k, len(ids) - 1) + 1))
        right += sum(r["score"] >= np.sort(s)[-k] - 1e-12 for r in mine)
    return right / (k * len(asked))


@pytest.mark.parametrize("driver_lists", [1024, 4])
def test_neighbours_of_the_registered_table(spark, monkeypatch, driver_lists):
    """Lists fitted by the driver, and in parts on executors."""
    monkeypatch.setattr(ann, "DRIVER_LISTS", driver_lists)
    monkeypatch.setattr(ann, "LIST_LEAST", 256 if driver_lists > 4 else 128)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    lists = ann.fit(df.select("vec_id", df["embedding"].alias("vec")), len(rows), 64)
    assert lists.k > 5 and len(lists.first(np.eye(64)[:3], 5)[0]) == 5
    assert recall(rows, ann.nearest(df, df.where("vec_id % 50 = 0")).collect()) >= 0.9


def test_no_query_is_left_short(spark, monkeypatch):
    """Two dense groups, and few vectors in a list of their own between them, which alone is near enough to one another."""
    rng = np.random.default_rng(3)
    deg = np.concatenate([rng.normal(0, 0.5, 383), rng.normal(60, 0.5, 382), [30.0, 30.0, 30.0]])
    ids = [i for i in range(1000) if i % 50][: 383 + 382] + [50, 9001, 9002]
    rows = [(i, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]) for i, d in zip(ids, deg, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(rows, ann.nearest(df, df.where("vec_id = 50")).collect()) == 1.0
    monkeypatch.setattr(ann, "LIST_LEAST", 2)
    monkeypatch.setattr(ann, "PRUNE", 0.0)
    monkeypatch.setattr(ann, "COPIES", 1)
    monkeypatch.setattr(ann, "WIDER", 2)
    assert recall(rows, ann.nearest(df, df.where("vec_id = 50")).collect()) >= 0.4


def test_neighbours_among_copies_and_repeated_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(7, [2.0, 1.0]), (7, [1.0, 2.0]), (600, [2.0, 1.1]), (601, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id in (0, 50, 600)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5] and [r["vec_id"] for r in got if r["query_id"] == 50] == [0, 1, 2, 3, 4]
    assert [r["vec_id"] for r in got if r["query_id"] == 600] == [7, 0, 1, 2, 3]


def test_neighbours_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    rows = [(i, [float(v) for v in row], "q") for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    right = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        best = np.argsort(-s)[:5]
        mine = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        right += len(set(best) & {r["vec_id"] for r in mine})
    assert right / (60 * 5) >= 0.9


def test_neighbour_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [2.0, 0.0]), (3, [4.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0), (100, 4, 3, 0.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
