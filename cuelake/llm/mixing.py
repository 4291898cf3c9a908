"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialize

#: Words of a block, and times that a document may be taken.
BLOCK_WORDS, EPOCHS = 2048, 3
#: Rows of a rank group: documents and slots are ranked within groups of about this size, then groups by their sums.
GROUP_ROWS = 4096
WEIGHTS = (1, 2, 3)
#: Tables of at most this many rows are sent to every executor; larger ones are joined by a shuffle.
SENT_ROWS = 100_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with the sums over all rows before each in ``order``. Rows are ranked in ranges, and ranges by their totals, so no task sees all rows."""
    placed = materialize(df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()), name)
    own = Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range__").agg(*[F.sum(c).alias(f"{k}_range") for k, c in sums.items()])
    upto = Window.partitionBy(F.lit(0)).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # one row a range: as many as shuffle partitions
    ranges = ranges.select("range__", *[F.coalesce(F.sum(f"{k}_range").over(upto), F.lit(0)).alias(f"{k}_range") for k in sums])
    within = placed.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{k}_own") for k, c in sums.items()])
    j = within.join(F.broadcast(ranges), "range__")
    return j.select(*df.columns, *[(F.col(f"{k}_range") + F.col(f"{k}_own")).alias(k) for k in sums])


def targets_of(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``: weights by code point order, filled up to EPOCHS times the size.

    Works on one row a source. Sorted by size over weight, the sources before some point stop at their limit and the rest
    share what is left by weight; the first source whose limit is above its share is that point.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = _running(s, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")}, "source-order")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("weight"))
    fill = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    s = _running(s, fill, {"size_before": F.col("source_size"), "weight_before": F.col("weight"), "place": F.lit(1).cast("long")}, "source-filling")
    whole = s.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, weights = float(whole["total"] or 0), float(whole["weights"] or 0)
    cap = F.lit(float(EPOCHS)) * F.col("source_size")
    share = (F.lit(total) - F.lit(float(EPOCHS)) * F.col("size_before")) / (F.lit(weights) - F.col("weight_before"))
    level = s.where(cap > F.col("weight") * share).agg(F.min_by(share, "place")).first()[0]
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _mirrored(point: Column, bits: int) -> Column:
    """The number whose ``bits`` binary digits are those of ``point`` in reverse: the van der Corput sequence, and its own inverse."""
    return F.conv(F.reverse(F.lpad(F.bin(point), max(1, bits), "0")), 2, 10).cast("long")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """``(source, slot, nth)``: the slots at which the mix reads each source, and the rank of each among the source's.

    Slot i looks at point v(i) of [0, n), v the van der Corput sequence of as many bits as n needs; slots whose point falls
    outside are passed over. Sources own stretches of [0, n) as long as their block counts, so each gets exactly as many
    slots as its target needs, and every run of slots is spread over the sources nearly by weight. Ranks come from counts of
    slot groups plus the rank within the group, so no task sees all slots of a large source.
    """
    spark = targets.sparkSession
    need = F.ceil(F.round("target") / F.lit(block)).cast("long")
    owned = targets.select("source", need.alias("blocks")).where(F.col("blocks") > 0)
    owned = _running(owned, [F.col("source").asc_nulls_last()], {"from": F.col("blocks")}, "stretches").withColumn("upto", F.col("from") + F.col("blocks"))
    n, sources = owned.agg(F.coalesce(F.max("upto"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(0, n - 1).bit_length()
    # The stretches cut at multiples of a width make an equi join of "which stretch holds this point".
    width = max(1, n // 1024)
    cells = owned.select("source", "from", "upto", F.explode(F.sequence(F.expr(f"`from` div {width}"), F.expr(f"(upto - 1) div {width}"))).alias("cell"))
    slots = spark.range(n).select(_mirrored(F.col("id"), bits).alias("slot"), F.col("id").alias("point"))
    slots = slots.withColumn("cell", F.expr(f"point div {width}")).join(_sent(cells, sources + 1025), "cell").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto")))
    slots = slots.select("source", "slot", F.floor(F.col("slot") / F.lit(GROUP_ROWS)).alias("grp"))
    sums = slots.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), F.col("grp").alias("g2"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    slots = slots.withColumn("within", F.row_number().over(Window.partitionBy("source", "grp").orderBy("slot")) - 1)
    slots = slots.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("grp") == F.col("g2")))
    return slots.select("source", "slot", (F.col("before") + F.col("within")).alias("nth"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that a mix of all sources takes from each document; one row for each row of ``docs``.

    ``(doc_id, size, source_size, target, taken, epochs, first_slot)``. Sources by code point, null last, weigh 1, 2, 3,
    repeating; a target stops at three times its source's size and the excess goes to the others by weight. A source's
    documents, shuffled by md5 of id and text, are one stream of words, repeated up to three times and cut into blocks of
    equal size; the n-th slot of a source reads its n-th block, the last one just up to the target. ``taken`` counts a
    document's words in the blocks that were read, ``epochs`` how often the mix begins it, ``first_slot`` the slot where it
    first meets it (null: not at all).

    Null texts have size 0, take nothing and still get a row; so do all rows of a source without words (target 0). A null
    source is a source of its own. Repeated ids and rows are documents of their own: equal rows are counted before any
    shuffle and dealt out again at the end. Null ids shuffle as the text "null" with their own text. An empty table gives an
    empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(" "), F.md5(text.cast("binary"))).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("mix_key"),
        F.regexp_count(text, F.lit(SPACE_WORD)).cast("long").alias("size"),
    )
    sized = materialize(sized.groupBy("source", "mix_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    distinct = sized.count()
    digits = 1
    while distinct > GROUP_ROWS * 16**digits and digits < 12:
        digits += 1
    targets = materialize(targets_of(sized.select("source", (F.col("size") * F.col("copies")).alias("size"))), "targets")

    sized = sized.withColumn("grp", F.substring("mix_key", 1, digits)).withColumn("words", F.col("size") * F.col("copies"))
    sums = sized.groupBy("source", "grp").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    goals = sums.join(_sent(targets.withColumnRenamed("source", "s1"), targets.count()), F.col("source").eqNullSafe(F.col("s1")))
    goals = goals.select(F.col("source").alias("s2"), F.col("grp").alias("g2"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "grp").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    placed = placed.join(goals, F.col("source").eqNullSafe(F.col("s2")) & (F.col("grp") == F.col("g2")))
    # Equal rows stand one after the other in the stream. Two steps deal them out, so no row makes a long array.
    dealt = placed.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 1000"))))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("thousand") * 1000 + 999, F.col("copies") - 1))))
    row = ["source", "mix_key", "doc_id", "size", "copy", "source_size", "target"]
    placed = materialize(dealt.select(*row, (F.col("before") + F.col("within") + F.col("copy") * F.col("size")).alias("at")), "placed")

    goal = F.round("target").cast("long")
    read_at_all = (F.col("at") < goal) & (F.col("size") > 0)
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda e: F.col("at") + e * F.col("source_size")), lambda a: a < goal)
    runs = placed.where(read_at_all).select(*row, goal.alias("goal"), F.explode(starts).alias("a"))
    runs = runs.withColumn("b", F.least(F.col("a") + F.col("size"), "goal"))
    pieces = runs.select(*row, "a", "b", F.explode(F.sequence(F.expr(f"a div {BLOCK_WORDS}"), F.expr(f"(b - 1) div {BLOCK_WORDS}"))).alias("nth"))
    pieces = pieces.select(*row, "nth", (F.least("b", (F.col("nth") + 1) * BLOCK_WORDS) - F.greatest("a", F.col("nth") * BLOCK_WORDS)).alias("words"), (F.col("a") >= F.col("nth") * BLOCK_WORDS).cast("int").alias("starts"))
    slots = schedule(targets, BLOCK_WORDS).select(F.col("source").alias("s2"), F.col("nth").alias("n2"), "slot")
    read = pieces.join(slots, F.col("source").eqNullSafe(F.col("s2")) & (F.col("nth") == F.col("n2")))
    read = read.groupBy(*row).agg(F.sum("words").alias("taken"), F.sum("starts").alias("epochs"), F.min("slot").alias("first_slot"))
    zero = F.lit(0).cast("long")
    rest = placed.where(~read_at_all).select(*row, zero.alias("taken"), zero.alias("epochs"), F.lit(None).cast("long").alias("first_slot"))
    return read.unionByName(rest).select("doc_id", "size", "source_size", "target", "taken", "epochs", "first_slot")
