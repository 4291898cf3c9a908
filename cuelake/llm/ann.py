"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as Wn

from .common import materialize

#: A list holds about this many vectors at least; larger tables have lists of about the square root of their size, and as many of them.
LIST_LEAST = 256
#: Vectors of one list that the fit looks at, lists that the driver fits by itself (more are fitted in parts, on executors), and bytes of all centres at most.
PER_LIST, DRIVER_LISTS, CENTRE_BYTES = 32, 1024, 256 << 20
#: A vector is kept in every list whose centre is at most this much farther than its nearest (CLOSURE), in COPIES lists at most.
CLOSURE, COPIES = 0.05, 2
#: A query reads every list whose centre is at most this much farther than its nearest.
PRUNE = 0.25
#: Neighbours of a centre in the graph, entry centres, nodes opened in one step, and the width of the search for rows and for queries.
DEGREE, ENTRIES, OPENED, BEAM_ROWS, BEAM_QUERIES = 24, 8, 8, 24, 512
#: Queries that found fewer rows than asked read so many times as many lists in the next round.
WIDER = 8
#: Vectors and queries that one scoring task takes at once, at most about.
BLOCK, QUERY_BLOCK = 4096, 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _halved(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Means of k equal parts: halve along the line between two centres, at the rank that keeps parts equal, until k are left."""
    if k <= 1 or len(x) <= 1:
        return [x.mean(axis=0)]
    a, b = x[0], x[int((x @ x[0]).argmin())]
    for _ in range(6):
        side = x @ (a - b)
        left = side > np.median(side)
        if left.all() or not left.any():
            break
        a, b = x[left].mean(axis=0), x[~left].mean(axis=0)
    order = np.argsort(-(x @ (a - b)), kind="stable")
    k1 = k // 2
    at = len(x) * k1 // k
    if at == 0 or at == len(x):
        return [x.mean(axis=0)]
    return _halved(x[order[:at]], k1) + _halved(x[order[at:]], k - k1)


def centres_of(x: np.ndarray, k: int) -> np.ndarray:
    """About k unit centres with lists of like size: parts that are nearest to twice their share of ``x`` are halved on."""
    c = _unit(np.array(_halved(x, k)))
    for _ in range(3):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        size, share = np.bincount(near, minlength=len(c)), len(x) / k
        big = np.flatnonzero(size > 2 * share)
        if not len(big):
            break
        c = _unit(np.vstack([c[(size > 0) & (size <= 2 * share)], *[np.array(_halved(x[near == j], int(np.ceil(size[j] / share)))) for j in big]]))
    return c


class Lists:
    """Unit centres, and a neighbour graph to search them. ``part``: the top-level part of each centre, where there are several."""

    def __init__(self, centres: np.ndarray, part: np.ndarray | None = None):
        self.k = k = len(centres)
        # One more row stands for no centre.
        self.centres = np.vstack([centres, np.zeros((1, centres.shape[1]))]).astype(np.float32)
        degree = min(DEGREE, k - 1) if k else 0
        self.graph = np.full((k + 1, degree), k, np.int64)
        if degree:
            self._link(np.zeros(k, int) if part is None else part, degree)
        self.entries = np.unique(np.linspace(0, k - 1, min(ENTRIES, k)).astype(int)) if k else np.zeros(0, int)

    def _link(self, part: np.ndarray, degree: int) -> None:
        """Nearest centres among those of the nearest parts; some far links keep the graph in one piece."""
        k, c = self.k, self.centres[:-1]
        names, at = np.unique(part, return_inverse=True)
        means = np.array([c[at == j].mean(axis=0) for j in range(len(names))])
        for j in range(len(names)):
            around = np.argsort(-(means @ means[j]), kind="stable")[: max(8, degree)]
            others = np.flatnonzero(np.isin(at, around))
            mine = np.flatnonzero(at == j)
            for i in range(0, len(mine), 1024):
                own = mine[i : i + 1024]
                sim = c[own] @ c[others].T
                sim[own[:, None] == others[None, :]] = -9
                best = np.argsort(-sim, axis=1)[:, : min(degree, len(others) - 1)]
                self.graph[own, : best.shape[1]] = others[best]
        if degree > 4:
            self.graph[:k, -4:] = np.random.default_rng(2).integers(0, k, (k, 4))
            self.graph[:k, -1] = (np.arange(k) + 1) % k

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: the ``beam`` nearest centres found for each (k: none), and their cosines, nearest first."""
        n, k, q = len(q), self.k, q.astype(np.float32)
        beam = min(beam, k)
        rows = np.arange(n)[:, None]
        sims, ids, done = np.full((n, beam), -9.0, np.float32), np.full((n, beam), k), np.ones((n, beam), bool)
        seen = np.zeros((n, k + 1), bool)
        seen[:, k] = True
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        while True:
            fresh = np.sort(fresh, axis=1)
            old = seen[rows, fresh]
            old[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
            seen[rows, fresh] = True
            new = np.where(old, np.float32(-9), np.matmul(self.centres[fresh], q[:, :, None])[:, :, 0])
            sims, ids, done = np.hstack([sims, new]), np.hstack([ids, np.where(old, k, fresh)]), np.hstack([done, old])
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            sims, ids, done = (np.take_along_axis(a, top, axis=1) for a in (sims, ids, done))
            pick = np.argsort(done, axis=1, kind="stable")[:, : max(OPENED, beam // 16)]
            live = ~np.take_along_axis(done, pick, axis=1)
            if not live.any():
                return ids, sims
            at = np.where(live, np.take_along_axis(ids, pick, axis=1), k)
            np.put_along_axis(done, pick, True, axis=1)
            fresh = self.graph[at].reshape(n, -1)

    def near(self, q: np.ndarray, beam: int, ratio: float, most: int | None = None) -> list[np.ndarray]:
        """Centres of each query within ``ratio`` of the nearest one's distance."""
        ids, sims = self.search(q, beam)
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
        keep = (dist <= (1 + ratio) * dist[:, :1] + 1e-6) & (ids < self.k)
        if most is not None:
            keep[:, most:] = False
        return [ids[i][keep[i]] for i in range(len(q))]

    def first(self, q: np.ndarray, width: int) -> list[np.ndarray]:
        """The ``width`` nearest centres of each query, by all products."""
        sim = q.astype(np.float32) @ self.centres[:-1].T
        return list(np.argsort(-sim, axis=1, kind="stable")[:, :width])


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    plain = vec.cast("array<double>")
    bad = F.exists(plain, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(plain, lambda v: v != 0)


def _sampled(vectors: DataFrame, rate: float, seed: int) -> DataFrame:
    """Vectors by a hash of the id, each text of components once, so that copies don't make up the sample."""
    point = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_003))
    return vectors.where(point < F.lit(min(1.0, rate) * 1_000_003)).select("vec").dropDuplicates(["vec"])


def _array(rows: DataFrame) -> np.ndarray:
    x = np.array(rows.toPandas()["vec"].tolist(), np.float64)
    return _unit(x[np.lexsort(x.T)]) if len(x) else np.zeros((0, 1))


def fit(vectors: DataFrame, n: int, dim: int) -> Lists:
    """Lists for ``n`` vectors of ``dim`` components, from samples of PER_LIST vectors a list.

    Up to DRIVER_LISTS lists are fitted on the driver. Beyond, the driver fits about the square root of their number as
    parts; executors split the sample's vectors of each part on, and only centres come back, CENTRE_BYTES of them at most.
    """
    k = max(1, min(-(-n // max(LIST_LEAST, int(n**0.5))), CENTRE_BYTES // (4 * dim)))
    top_k = k if k <= DRIVER_LISTS else int(k**0.5)
    x = _array(_sampled(vectors, PER_LIST * max(top_k, 64) / max(1, n), 23))
    if not len(x):
        return Lists(np.zeros((0, dim)))
    top = centres_of(x, top_k)
    if top_k == k:
        return Lists(top)
    send = vectors.sparkSession.sparkContext.broadcast(top.astype(np.float32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = (_unit(_vectors(b.column(0))).astype(np.float32) @ send.value.T).argmax(axis=1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0)], names=["part", "vec"])

    def split(t: pa.Table) -> pa.Table:
        u = _unit(_vectors(t.column("vec").combine_chunks()))
        u = u[np.lexsort(u.T)]
        c = centres_of(u, max(1, round(len(u) / PER_LIST)))
        return pa.table({"part": pa.array(np.full(len(c), t.column("part")[0].as_py()), pa.int32()), "vec": pa.array(list(c), pa.list_(pa.float64()))})

    kind = vectors.schema["vec"].dataType.simpleString()
    dealt = _sampled(vectors, PER_LIST * k / n, 29).mapInArrow(deal, f"part int, vec {kind}")
    found = dealt.groupBy("part").applyInArrow(split, "part int, vec array<double>").toPandas().sort_values("part", kind="stable")
    return Lists(np.array(found["vec"].tolist()), found["part"].to_numpy())


def _score_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The top of one block: exact cosines of its queries against its vectors."""
    topk = left.column("k")[0].as_py() if left.num_rows else 0
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    q, x = _vectors(left.column("vec").combine_chunks()), _vectors(right.column("vec").combine_chunks())
    qid, xid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    sim = _unit(q) @ _unit(x).T
    sim[qid[:, None] == xid[None, :]] = -9
    out_q, out_x, out_s = [], [], []
    # Rows that repeat an id may fill places twice; so many more are looked at.
    k = min(topk + len(xid) - len(np.unique(xid)), sim.shape[1])
    least = np.partition(sim, -k, axis=1)[:, -k]
    for i in range(len(q)):
        at = np.flatnonzero((sim[i] >= least[i] - 1e-9) & (sim[i] > -9))
        s = exact(q[i], x[at])
        best = np.lexsort((xid[at], -s))
        best = best[np.sort(np.unique(xid[at][best], return_index=True)[1])][:topk]
        out_q += [qid[i]] * len(best)
        out_x += xid[at][best].tolist()
        out_s += s[best].tolist()
    return pa.table([pa.array(out_q, pa.int64()), pa.array(out_x, pa.int64()), pa.array(out_s, pa.float64())], schema=schema)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each summed alike whatever the other rows, so that copies tie."""
    dots = (x * q).sum(axis=1)
    s = dots / np.sqrt((x * x).sum(axis=1)) / np.sqrt((q * q).sum())
    return np.clip(s, -1.0, 1.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows found nearest by cosine to each query, other than the row itself.

    Lists have about equal shares of a sample, and their number grows with the table. Each vector goes to its nearest list
    and, near a boundary, to up to COPIES lists; each query reads the lists within PRUNE of its nearest. Nearest centres
    come from a best-first walk over a neighbour graph. A query that has found fewer than k rows reads WIDER times as many
    lists, again and again up to all of them, so no query has fewer than k rows unless there are fewer candidates. Lists
    larger than BLOCK vectors and their queries are dealt to several tasks in blocks. Scores are exact, ties go to the
    smaller id.

    Of rows with one and the same vector, only the k + 1 of smallest id can be among the nearest of anything; they are
    picked before any list is made, so a vector that a third of all rows share costs k + 1 entries.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids or vectors of another
    length than the most common one. Rows that repeat an id and vector count once; a query skips every row with its id.
    Fewer candidates than k give fewer rows; empty tables give none. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def taking_part(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias(name), F.col(vec_col).alias("vec"))
        df = df.where(F.col(name).isNotNull() & usable(F.col("vec")))
        # Single precision stays as it is: each such number is a double too.
        return df if df.schema["vec"].dataType.simpleString() == "array<float>" else df.withColumn("vec", F.col("vec").cast("array<double>"))

    base, asked = taking_part(vectors, "vec_id"), taking_part(queries, "query_id")
    common = base.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, asked = base.where(F.size("vec") == common["dim"]), asked.where(F.size("vec") == common["dim"]).distinct()
    lists = spark.sparkContext.broadcast(fit(base, common["n"], common["dim"]))
    n_lists = lists.value.k
    kinds = base.schema["vec"].dataType.simpleString(), asked.schema["vec"].dataType.simpleString()
    alike = Wn.Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id")
    first = base.withColumn("place", F.dense_rank().over(alike)).where(F.col("place") <= k + 1).drop("place")

    step = max(16, min(256, 32_768 // max(1, common["dim"])))

    def deal(choose, name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    near = choose(lists.value, _unit(_vectors(part.column(1))))
                    at = np.repeat(np.arange(part.num_rows), [len(x) for x in near])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.concatenate(near), pa.int32()), part.column(1).take(pa.array(at))], names=[name, "list", "vec"])

        return run

    posting = materialize(first.mapInArrow(deal(lambda ls, q: ls.near(q, BEAM_ROWS, CLOSURE, COPIES), "vec_id"), f"vec_id long, list int, vec {kinds[0]}"), "posting-lists")
    blocks = materialize(posting.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "list-sizes")

    def read(some: DataFrame, choose) -> DataFrame:
        """The best k rows of each query in the lists that it chooses."""
        reads = materialize(some.mapInArrow(deal(choose, "query_id"), f"query_id long, list int, vec {kinds[1]}"), "list-reads")
        qblocks = reads.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qblocks"))
        plan = F.broadcast(blocks.join(qblocks, "list"))  # one row a list; centres bound their number
        own, other = F.col("blocks"), F.col("qblocks")
        left = reads.join(plan, "list").select("query_id", "list", "vec", F.lit(k).alias("k"), F.pmod(F.xxhash64("query_id"), other).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), own - 1)).alias("vb"))
        right = posting.join(plan, "list").select("vec_id", "list", "vec", F.pmod(F.xxhash64("vec_id"), own).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), other - 1)).alias("qb"))
        found = left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInArrow(_score_block, "query_id long, vec_id long, score double")
        best = Wn.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        # A row found in two lists, or with two vectors under its id, counts once: with its best score.
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return materialize(found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k), "nearest")

    out = read(asked, lambda ls, q: ls.near(q, BEAM_QUERIES, PRUNE))
    width = WIDER
    while n_lists > 1:
        full = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = materialize(asked.join(full, "query_id", "left_anti"), "short-queries")
        if short.isEmpty():
            break
        wide = min(width, n_lists)
        again = read(short, lambda ls, q, wide=wide: ls.first(q, wide))
        out = materialize(out.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again), "nearest")
        if wide == n_lists:
            break
        width *= WIDER
    return out.select("query_id", "rank", "vec_id", "score")
