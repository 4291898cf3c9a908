"""Sharding by a hierarchical weighted hash tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .mixing import _running, _sent

#: Shards of a rack and racks of a region, in the first layout of a tree.
RACK_SHARDS, REGION_RACKS = 4, 2
#: Rows of a rank group: slots are numbered within groups of about this size.
GROUP_ROWS = 4096

#: ``{region: {rack: {shard: weight}}}``
Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int, laid_out: int = 16) -> Tree:
    """The first ``laid_out`` shards by racks and regions, weight 1 each; every further one is a region of its own.

    A shard that is added so changes no weight but that of the root, so rows move into the new region only.
    """
    tree: Tree = {}
    for s in range(shards):
        rack = s // RACK_SHARDS if s < laid_out else s
        region = f"g{rack // REGION_RACKS}" if s < laid_out else f"own{s}"
        tree.setdefault(region, {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """A weighted hash draw: log of a hash point in (0, 1) over the weight. Of several nodes the largest wins, each with odds by its weight."""
    point = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), node).cast("binary")), 1, 12), 16, 10).cast("double")
    return F.log((point + 0.5) / F.lit(float(1 << 48))) / weight


def _pick(key: Column, parent: Column | None, nodes: dict[str | None, dict[str, float]]) -> Column:
    """The name of the child of ``parent`` that wins the draw. ``nodes``: names and weights of children by parent."""
    if parent is None:
        ((_, own),) = nodes.items()
        drawn = [F.struct(_draw(key, F.lit(n), F.lit(w)).alias("d"), F.lit(n).alias("n")) for n, w in own.items() if w > 0]
        return (F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["n"]
    width = max(map(len, nodes.values()))
    drawn = []
    for k in range(width):
        names, weights = ({p: f(list(c.items())[k]) for p, c in nodes.items() if k < len(c)} for f in (lambda x: x[0], lambda x: x[1]))
        name, weight = (F.element_at(F.create_map(*[F.lit(x) for pair in each.items() for x in pair]), parent) for each in (names, weights))
        # No such child, or one without weight, never wins.
        drawn.append(F.struct(F.when(weight > 0, _draw(key, name, weight)).alias("d"), name.alias("n")))
    return (F.greatest(*drawn) if width > 1 else drawn[0])["n"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: a draw among regions by the sum of their weights, among the region's racks, among the rack's shards."""
    weigh = lambda x: sum(map(weigh, x.values())) if isinstance(x, dict) else float(x)
    regions = {None: {g: weigh(racks) for g, racks in tree.items()}}
    racks = {g: {f"{g}/{k}": weigh(shards) for k, shards in own.items()} for g, own in tree.items()}
    shards = {f"{g}/{k}": {f"{g}/{k}/{s}": float(w) for s, w in own.items()} for g, r in tree.items() for k, own in r.items()}
    region = _pick(key, None, regions)
    rack = _pick(key, region, racks)
    return F.substring_index(_pick(key, rack, shards), "/", -1).cast("int")


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard and a place in it for each row of ``docs``; the law is ``key``: the id and the tree decide.

    ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``. A row descends the tree from region to rack to shard; at
    each level the children draw hash points for its id, scaled by their weights, and the best wins. Draws of one child
    don't depend on others, so where a weight changes, rows move only into or out of that subtree. ``grown_shard`` is the
    shard in ``grown`` (null without one). ``size`` is the text's number of UTF-8 bytes plus 1; ``slot`` numbers a shard's
    rows from 0 without gaps, by md5 of id and text.

    Null texts have no bytes: size 1, crc 0. Null ids count as the text "null" in draws. Rows that repeat an id share its shard; equal
    rows are counted before any shuffle and dealt out again, with slots of their own. An empty table gives an empty result.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"))
    rows = rows.select("doc_id", "key", (F.col("bytes") + 1).alias("size"), "text_crc32", F.md5(F.concat("key", F.lit(" "), "text_md5").cast("binary")).alias("at"))
    rows = materialize(rows.groupBy("doc_id", "key", "size", "text_crc32", "at").agg(F.count(F.lit(1)).alias("copies")), "sharded-rows")
    distinct, digits = rows.count(), 1
    while distinct > GROUP_ROWS * 16**digits and digits < 12:
        digits += 1
    placed = rows.select("doc_id", "size", "text_crc32", "at", "copies", place(F.col("key"), tree).alias("shard"), (place(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.substring("at", 1, digits).alias("grp"))
    placed = materialize(placed, "placed-rows")
    sums = placed.groupBy("shard", "grp").agg(F.sum("copies").alias("n"))
    sums = materialize(_running(sums, [F.col("shard"), F.col("grp")], {"before": F.col("n")}, "shard-groups"), "shard-sums")
    starts = sums.groupBy("shard").agg(F.min("before").alias("start"))  # one row a shard: the tree bounds them
    sums = sums.join(F.broadcast(starts), "shard").select("shard", "grp", (F.col("before") - F.col("start")).alias("before"))
    inside = Window.partitionBy("shard", "grp").orderBy("at", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    numbered = numbered.join(_sent(sums, 16**digits * sum(len(s) for r in tree.values() for s in r.values())), ["shard", "grp"])
    # Equal rows take slots one after the other. Two steps deal them out, so no row makes a long array.
    dealt = numbered.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 1000"))))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("thousand") * 1000 + 999, F.col("copies") - 1))))
    slot = (F.col("before") + F.col("within") + F.col("copy")).alias("slot")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
