"""Hard negatives, tokenizer alignment and shards against brute-force versions, with odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import align, negatives, sharding

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


# hard negatives


def mined(rows, every=3, k=5, n=3):
    """Straight from the contract, with Python integers."""
    kept = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        kept.setdefault(i, (label, [int(np.floor(256 * x)) for x in v]))
    sizes = Counter(len(v) for _, v in kept.values())
    dim = max(sizes, key=lambda d: (sizes[d], d)) if sizes else 0
    kept = {i: r for i, r in kept.items() if len(r[1]) == dim}
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        by_score = sorted(((sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a), key=lambda t: (-t[0], t[1]))
        for p, pid, _ in [t for t in by_score if t[2] == label][:k]:
            near = [t for t in by_score if t[2] != label and 50 * p <= 100 * t[0] <= 95 * p][:n]
            out += [(a, pid, r + 1, i, p, s) for r, (s, i, _) in enumerate(near)]
    return sorted(out)


def mine(spark, rows, every=3, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumn("rank", F.lit("x")).withColumn("part", F.lit(1))
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def f32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_mining_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), f32(rng.normal(size=12))) for i in range(150)]
    same = f32(rng.normal(size=12))
    rows += [(1000 + i, i % 2, same) for i in range(80)]  # copies: every score ties
    rows += [(2000, 1, None), (2001, None, same), (2002, 1, [*same[:-1], float("nan")]), (2003, 1, [*same[:-1], float("inf")]), (2004, 1, [*same[:-1], None]), (None, 1, same), (2005, 1, same[:5]), (2006, 7, same), (2007, 1, [0.0] * 12)]
    rows += [rows[0], rows[0], (3, 2, f32(rng.normal(size=12)))]
    want = mined(rows)
    assert len(want) > 200 and mine(spark, rows) == want
    monkeypatch.setattr(negatives, "STRIPE_ROWS", 10)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 64)
    monkeypatch.setattr(negatives, "TILE_BYTES", 4 * 12 * 8)
    monkeypatch.setattr(negatives, "STEP_ROWS", 7)
    monkeypatch.setattr(negatives, "STEP_ANCHORS", 5)
    assert mine(spark, rows) == want


def test_mining_wide_and_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, (rng.normal(size=1500) * 300).tolist()) for i in range(40)]
    assert mine(spark, rows, 4, "double") == mined(rows, 4)
    # One row's own score is over the bound: it takes no part. Others keep theirs.
    rows += [(100, 0, [1e300] * 1500)]
    assert mine(spark, rows, 4, "double") == mined(rows[:-1], 4)


def test_mining_without_rows(spark):
    assert mine(spark, []) == [] and mine(spark, [(0, 1, [1.0])]) == [] and mine(spark, [(0, 1, []), (3, 1, []), (4, 2, [])]) == mined([(0, 1, []), (3, 1, []), (4, 2, [])])
    assert mine(spark, [(0, 1, [1.0]), (3, 1, [-1.0]), (4, 2, [-0.7])]) == []  # a positive below zero has no window


def test_residues_are_exact():
    rng = np.random.default_rng(7)
    for dim, top in ((1, 2**27), (3, 9), (64, 140), (64, 2**24), (1024, 2**22), (3000, 300)):
        a, b = (rng.integers(-top, top + 1, (6, dim)) for _ in range(2))
        a[0], b[0], b[1] = top, top, -top
        rns = negatives.Residues(dim)
        primes = rns.needed(float(np.sqrt((a.astype(float) ** 2).sum(1).max() * (b.astype(float) ** 2).sum(1).max())))
        assert np.prod([float(p) for p in primes]) > 2.0 * dim * top * top
        got = rns.product([rns.centred(a.astype(float), p) for p in primes], [rns.centred(b.astype(float), p) for p in primes], primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


# alignment


@pytest.fixture(scope="module")
def pair():
    return align.Pair(open(A, "rb").read(), open(B, "rb").read())


def plain(pair, text):
    """``(a, b, groups, links)`` of one text by walking all byte offsets."""
    from tokenizers import Tokenizer

    a = pair.a.encode(" " + text, add_special_tokens=False).ids if isinstance(pair.a, Tokenizer) else None
    b = pair.b.encode(text)
    whole = b" " + text.encode()
    own, other = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if b"".join(own) != whole or b"".join(other) != whole:
        return [], [], "", []
    ends = [{}, {}]
    for side, (ids, spelled) in enumerate(((a, own), (b, other))):
        at = 0
        for k, x in enumerate(spelled):
            at += len(x)
            ends[side][at] = k
    said, links, i, j = [], [], 0, 0
    for cut in sorted(ends[0].keys() & ends[1].keys()):
        x, y = ends[0][cut] + 1, ends[1][cut] + 1
        said.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return a, b, ";".join(said), links


ODD = ["", None, " ", "  ", "a", "a ", " a", "tab\there \n\n next", "x▁y", "naïve café 日本語 テスト", "é\xa0\t \t<|endoftext|> ", "<s> </s> <unk>", "’s it's don't", "\x00\x1c", "😀😀 ok", "word " * 300, "ab" * 2000]


def expected(pair, texts):
    each = [plain(pair, t) if t else ([], [], "", []) for t in texts]
    count, docs = Counter(x for e in each for x in e[3]), Counter(x for e in each for x in set(e[3]))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(len(a), len(b), len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sum(docs[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if a else "") for a, b, g, links in each]


def test_alignment_equals_brute_force(spark, tiny, pair, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").limit(60).collect()] + ODD + ODD
    rows = [(None if k % 9 == 0 else k % 50, t) for k, t in enumerate(texts)]
    want = sorted(zip([str(r[0]) for r in rows], map(str, expected(pair, texts)), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).repartition(3)

    def got():
        return sorted((str(r[0]), str(tuple(r)[1:])) for r in align.align(df, A, B).collect())

    assert got() == want
    monkeypatch.setattr(align, "CHUNK_DOCS", 1 << 16)
    monkeypatch.setattr(align, "CHUNK_BYTES", 3000)  # many chunks
    assert got() == want


def test_alignment_of_parts_of_long_texts(pair, monkeypatch):
    monkeypatch.setattr(align, "STRETCH", 40)
    pieces = align.Pieces(pair)
    for text in (*ODD, "a long text of many words and  spaces\n \n and so on " * 20):
        a, b, said, links = plain(pair, text) if text else ([], [], "", [])
        (read,) = pieces.read([text])
        assert (read[1] if read else "") == (hashlib.sha256(said.encode()).hexdigest() if a else "")
        if read:
            ends = np.array(pieces.ends)
            assert sum(ends[k + 1] - ends[k] for k in read[0]) == len(links)


def test_planes_hold_all_links():
    rng = np.random.default_rng(8)
    doc, pair = rng.integers(0, 90, 5000), rng.choice([3, 9, 1 << 40], 5000, p=[0.9, 0.09, 0.01])
    rows = align.postings_of(doc, pair, 90, 7)
    at, n = align.members(rows.column("packed").to_pylist(), rows.column("members").to_pylist())
    assert n.tolist() == rows.column("bits").to_pylist() and any(rows.column("packed").to_pylist()) and not all(rows.column("packed").to_pylist())
    again = Counter()
    for d, p, k in zip(at, np.repeat(rows.column("pair").to_numpy(), n), np.repeat(rows.column("plane").to_numpy(), n)):
        again[(d, p)] += 1 << int(k)
    assert again == Counter(zip(doc.tolist(), pair.tolist()))
    docs = Counter()
    for p, n in zip(rows.column("pair").to_pylist(), rows.column("docs").to_pylist()):
        docs[p] += n
    assert docs == Counter(p for _, p in again)


def test_alignment_of_nothing(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert [tuple(r) for r in align.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, 0, "")]


# shards


def drawn(key, tree):
    """The leaf of a key by a walk through the tree."""

    def weight(x):
        return sum(map(weight, x.values())) if isinstance(x, dict) else x

    path, node = "", tree
    while isinstance(node, dict):
        points = {n: (np.log((int(hashlib.md5(f"{key}/{path}{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight(c)) for n, c in node.items() if weight(c) > 0}
        n = max(points, key=points.get)
        path, node = f"{path}{n}/", node[n]
    return n


def sharded(df, tree, grown=None):
    return [r.asDict() for r in sharding.shard(df, tree, grown).collect()]


def test_shards_equal_a_walk(spark, monkeypatch):
    rows = [(k, "text " * (k % 50) + "é") for k in range(3000)] + [(7, "again"), (None, None), (None, "x")] + [(None, "same")] * 2500 + [(5000, "copy")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    tree, grown = sharding.tree_of(16), sharding.tree_of(17)
    monkeypatch.setattr(sharding, "GROUP_ROWS", 64)
    out = sharded(df, tree, grown)
    assert len(out) == len(rows)
    for r in out:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == drawn(key, tree) and r["grown_shard"] == drawn(key, grown) and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and slots


def test_weights_move_rows_of_their_subtree_only(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = {"a": {"r": {0: 1.0, 1: 1.0}, "s": {2: 2.0}}, "b": {"r": {3: 4.0, 4: 0.0}}}
    heavier = {"a": {"r": {0: 1.0, 1: 1.0}, "s": {2: 2.0}}, "b": {"r": {3: 4.0, 4: 4.0}}}
    out = sharded(df, tree, heavier)
    shares = Counter(r["shard"] for r in out)
    assert shares[4] == 0 and abs(shares[3] - 2000) < 200 and abs(shares[2] - 1000) < 150 and abs(shares[0] - 500) < 100
    moved = [(r["shard"], r["grown_shard"]) for r in out if r["shard"] != r["grown_shard"]]
    assert moved and all(to in (3, 4) for _, to in moved)
    assert sharded(df.limit(0), tree) == []
