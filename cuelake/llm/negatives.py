"""Hard-negative mining: exact integer scores from products modulo small primes, then a window under each positive's score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_heavy, materialize

#: Dimensions of one float32 product, and the largest sum of products there that is reduced modulo a prime without rounding.
SLICE, EXACT = 1024, 1 << 22
#: A row whose own score is larger takes no part: hundredfold scores of any two others fit in a long.
LARGEST = 1 << 55
#: Anchors and bytes of anchors of one tile at most, and anchors and rows that are multiplied at once.
TILE_ANCHORS, TILE_BYTES, STEP_ANCHORS, STEP_ROWS = 16_384, 16 << 20, 512, 2048
#: Rows of a stripe at least; larger tables have about the fourth root of their row number as stripes.
STRIPE_ROWS = 1024
NONE = -(1 << 62)


def primes_under(most: int) -> list[int]:
    """Odd primes up to ``most``, largest first."""
    sieve = np.ones(most + 1, bool)
    for i in range(2, int(most**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return np.flatnonzero(sieve)[::-1][:-3].tolist() if most >= 3 else []


class Residues:
    """Products of integer rows by Chinese remainders.

    Centred residues modulo p lie within (p - 1) / 2, so a product over a slice of dimensions stays under EXACT and is exact
    in float32. As many primes are taken as make their product larger than twice the largest score possible, and balanced
    mixed-radix digits give the signed score without ever being larger than it.
    """

    def __init__(self, dim: int):
        half = int((EXACT / max(1, min(dim, SLICE))) ** 0.5)
        self.primes = primes_under(min(1021, 2 * half + 1))

    def needed(self, bound: float) -> list[int]:
        product, out = 1, []
        for p in self.primes:
            if product > 2.1 * bound + 2:
                break
            product *= p
            out.append(p)
        return out

    @staticmethod
    def centred(x: np.ndarray, p: int) -> np.ndarray:
        """Residues of whole numbers in double precision; the quotient's rounding is put right afterwards."""
        r = np.fmod(x, p)
        return np.where(r > p // 2, r - p, np.where(r < -(p // 2), r + p, r)).astype(np.float32)

    @staticmethod
    def _mod(s: np.ndarray, p: int) -> np.ndarray:
        return s - np.rint(s / np.float32(p)) * np.float32(p)

    def product(self, a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
        """Scores of all rows of ``a`` with all of ``b``, given as residues for each prime."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(primes):
            r = np.zeros((len(a[k]), len(b[k])), np.float32)
            for i in range(0, a[k].shape[1], SLICE):
                r += self._mod(a[k][:, i : i + SLICE] @ b[k][:, i : i + SLICE].T, p)
            r = self._mod(r, p)
            for q, d in zip(primes, digits, strict=False):
                r = self._mod((r - d) * np.float32(pow(q, -1, p)), p)
            digits.append(r)
        out = np.zeros((len(a[0]), len(b[0])), np.int64)
        for d, p in zip(digits[::-1], primes[: len(digits)][::-1], strict=True):
            out = out * p + d.astype(np.int64)
        return out


def _whole(col: pa.Array, dim: int, scale: float) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(col), dim)


def best_under(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``scores`` the k largest between ``low`` and ``high`` where ``ok``, ties to the smaller id, as ``(scores, ids)``; NONE fills up."""
    n = len(scores)
    mask = ok & (scores >= low[:, None]) & (scores <= high[:, None])
    if np.count_nonzero(mask) > 8 * k * n:
        least = np.partition(np.where(mask, scores, NONE), -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(n, NONE)
        mask &= scores >= least[:, None]
    row, at = np.nonzero(mask)
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    out_s, out_i = np.full((n, k), NONE), np.full((n, k), NONE)
    out_s[row[keep], place[keep]] = scores[row[keep], at[keep]]
    out_i[row[keep], place[keep]] = ids[at[keep]]
    return out_s, out_i


def _merged(s: np.ndarray, i: np.ndarray, s2: np.ndarray, i2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = s.shape[1]
    s, i = np.hstack([s, s2]), np.hstack([i, i2])
    order = np.lexsort((i, -s), axis=1)[:, :k] if len(s) else np.zeros((0, k), int)
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def _tile(dim: int, scale: float, k: int, same: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over rows sorted by tile, anchors first: holds a tile's anchors and what is best for each so far; rows stream past.

    Columns: part, block, stripe, anchor, id, label, vec, and for ``same=False`` the anchor's positives, their scores and windows.
    """
    rns = Residues(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, state = None, [], None

        def begin() -> dict:
            t = pa.Table.from_batches(held).combine_chunks()
            x = _whole(t.column("vec").combine_chunks(), dim, scale)
            ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
            if same:
                own = [np.zeros(len(ids), np.int64)]
                low, high = [np.full(len(ids), NONE + 1)], [np.full(len(ids), np.iinfo(np.int64).max)]
                positives = own
            else:
                lists = t.column("positives").to_pylist()
                most = max(map(len, lists))
                # Places without a positive have an empty window.
                grid = lambda f, none: [np.array([f(p[j]) if j < len(p) else none for p in lists], np.int64) for j in range(most)]
                positives, own = grid(lambda p: p["id"], 0), grid(lambda p: p["score"], 0)
                low, high = grid(lambda p: p["low"], 1), grid(lambda p: p["high"], 0)
            return {"x": x, "norm": float(np.sqrt((x * x).sum(axis=1).max(initial=0))), "ids": ids, "label": label, "positives": positives, "own": own, "low": low, "high": high, "residues": {}, "best": [(np.full((len(ids), k), NONE), np.full((len(ids), k), NONE)) for _ in own]}

        def meet(rows: pa.RecordBatch) -> None:
            x = _whole(rows.column("vec"), dim, scale)
            ids, label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            primes = rns.needed(state["norm"] * float(np.sqrt((x * x).sum(axis=1).max(initial=0))))
            for p in primes:
                if p not in state["residues"]:
                    state["residues"][p] = rns.centred(state["x"], p)
            theirs = [rns.centred(x, p) for p in primes]
            for a in range(0, len(state["ids"]), STEP_ANCHORS):
                to = slice(a, a + STEP_ANCHORS)
                mine = [state["residues"][p][to] for p in primes]
                scores = rns.product(mine, theirs, primes) if primes else np.zeros((len(state["ids"][to]), len(ids)), np.int64)
                alike = state["label"][to][:, None] == label[None, :]
                ok = alike & (state["ids"][to][:, None] != ids[None, :]) if same else ~alike
                for j, (s, i) in enumerate(state["best"]):
                    # What is no better than the k-th so far can't come in.
                    low = np.maximum(state["low"][j][to], s[to, -1])
                    s[to], i[to] = _merged(s[to], i[to], *best_under(scores, ids, ok, low, state["high"][j][to], k))

        def end() -> Iterator[pa.RecordBatch]:
            if state is None:
                return
            for j, (s, i) in enumerate(state["best"]):
                row, place = np.nonzero(s != NONE)
                cols = [state["ids"][row], i[row, place], s[row, place]] if same else [state["ids"][row], state["positives"][j][row], i[row, place], state["own"][j][row], s[row, place]]
                for at in range(0, len(row), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], pa.int64()) for c in cols], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "stripe")] + [batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                key = tuple(keys[:3, a].tolist())
                if key != tile:
                    yield from end()
                    tile, held, state = key, [], None
                if keys[3, a]:
                    held.append(batch.slice(a, b - a))
                elif held or state is not None:
                    if state is None:
                        state, held = begin(), []
                    for at in range(a, b, STEP_ROWS):
                        meet(batch.slice(at, min(STEP_ROWS, b - at)))
        yield from end()

    return run


def stripes_of(rows: Column) -> Column:
    return F.ceil(rows / F.greatest(F.lit(STRIPE_ROWS), F.pow(rows, F.lit(0.75)))).cast("int")


def _tiles(rows: DataFrame, anchors: DataFrame, tiles: int) -> DataFrame:
    """Both sides sorted by tile, anchors first. ``block`` and ``stripe`` arrays say where each goes; the other side's columns are null."""
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("stripe", F.pmod(F.xxhash64(F.lit(31), "id"), F.col("stripes")).cast("int")).withColumn("anchor", F.lit(False))
    anchors = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).withColumn("block", F.pmod(F.xxhash64(F.lit(37), "id"), F.col("blocks")).cast("int")).withColumn("anchor", F.lit(True))
    both = anchors.unionByName(rows, allowMissingColumns=True).drop("blocks", "stripes")
    return both.repartition(max(1, tiles), "part", "block", "stripe").sortWithinPartitions("part", "block", "stripe", F.col("anchor").desc())


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows of another label that score just under an anchor's positives.

    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``. Components count as
    ``floor(scale * x)``, a score is the integer inner product. An anchor (where ``is_anchor`` of the input's columns holds)
    has its ``positives`` first other rows of its label as positives; of the rows of other labels whose score is between
    ``least`` and ``most`` per cent of a positive's, the ``negatives`` first are returned. Higher scores come first, ties by
    smaller id.

    Anchors and rows meet in tiles: blocks of anchors against stripes of rows, positives within the label only. A task holds
    one block's anchors and their best rows so far, while the stripe's rows, sorted behind them by Spark, stream past; so
    hot labels and copies only make more stripes. Scores are products modulo primes (see ``Residues``) and exact.

    Null ids, labels or vectors, vectors with a null or non-finite component, and those of another length than the most
    common one (the longest on a tie) take no part; nor do rows whose own score is over 2**55. Of rows that repeat an id,
    the one with the least label, then least vector, counts. Anchors without positives, and positives without rows in their
    window (all of negative score), give no rows. Empty tables give an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    # Components beyond this bound make the row's own score too large; that also leaves out infinite ones.
    usable = lambda c: c.isNotNull() & F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= LARGEST**0.5 / scale)), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(vec))
    own = F.aggregate(F.transform("vec", lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))), F.lit(0.0), lambda s, v: s + v * v)
    rows = rows.where(F.when(usable(F.col("vec")), own) <= float(LARGEST)).groupBy("id").agg(F.min(F.struct("label", "vec", "is_anchor")).alias("r")).select("id", "r.*")
    rows = materialize(rows.withColumn("dim", F.size("vec")), "mining-rows")
    common = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if common is None or not common["a"]:
        return empty
    dim, n = common["dim"], common["n"]
    rows = rows.where(F.col("dim") == dim).select("id", "label", "vec", "is_anchor")
    held = max(64, min(TILE_ANCHORS, TILE_BYTES // (4 * max(1, dim))))

    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).where((F.col("n") > 1) & (F.col("a") > 0))
    sizes = materialize(sizes.select("label", "n", F.ceil(F.col("a") / held).cast("int").alias("blocks"), stripes_of(F.col("n")).alias("stripes")), "label-sizes")
    tiles = sizes.agg(F.sum(F.col("blocks") * F.col("stripes"))).first()[0] or 0
    dealt = join_heavy(rows, sizes, "label", "n", n).withColumn("part", F.col("label"))
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    found = _tiles(dealt.drop("is_anchor"), dealt.where("is_anchor").drop("is_anchor"), _tasks(spark, tiles)).mapInArrow(_tile(dim, scale, positives, True, schema), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # Only scores of zero and more have rows in their window; for these, the first whole number in it and the last.
    low, high = F.expr(f"({least} * positive_score + 99) div 100"), F.expr(f"({most} * positive_score) div 100")
    window = F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"), low.alias("low"), high.alias("high"))
    wanted = found.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(window).alias("positives"))  # as many as positives asks for
    anchors = materialize(rows.where("is_anchor").join(wanted, "id").select("id", "label", "vec", "positives"), "anchors")

    blocks = max(1, -(-anchors.count() // held))
    stripes = int(spark.range(1).select(stripes_of(F.lit(n))).first()[0])
    placed = lambda df: df.select(F.lit(0).cast("long").alias("part"), F.lit(blocks).alias("blocks"), F.lit(stripes).alias("stripes"), *df.columns)
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])
    found = _tiles(placed(rows.drop("is_anchor")), placed(anchors), _tasks(spark, blocks * stripes)).mapInArrow(_tile(dim, scale, negatives, False, schema), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _tasks(spark, tiles: int) -> int:
    """Tasks for so many tiles: one each, within a range that the session's partitions set."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(max(tiles, own), 20_000))
