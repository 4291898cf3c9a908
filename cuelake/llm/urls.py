"""URL filters: host and path rules, then a character language-model ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Verdict, and host suffix with path start.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Symbols of the models: start, letters, one for digits, marks, one for all else.
SYMBOLS = "^abcdefghijklmnopqrstuvwxyz0/.:-_?=&#%+~"
SIZE = len(SYMBOLS)
#: A context counts fully once seen this often.
STRENGTH = 2.0
#: Bins of the scores that the threshold is chosen from, and their span.
BINS, SPAN = 400, 4.0
#: One ruled URL in so many, by a hash of the URL, is kept from the models; the threshold is chosen on these.
KEPT_BACK = 5


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for texts without ``://``."""
    rest = F.coalesce(_after(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null for none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | F.endswith(host, F.lit(f".{rule[:cut]}"))) & F.startswith(path, F.lit(rule[cut:]))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """Two start symbols, then a symbol for each character."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.concat(F.lit("^^"), F.regexp_replace(plain, r"(?s)[^a-z0/.:\-_?=&#%+]", "~"))


#: Stand-ins of the symbols with neighbouring code points, so that a symbol's number is a subtraction.
_FIRST = 0x4000
_STAND_INS = "".join(chr(_FIRST + i) for i in range(SIZE))


def codes(text: Column) -> Column:
    """Symbol numbers, from 0, of a text of symbols."""
    return F.transform(F.split(F.translate(text, SYMBOLS, _STAND_INS), ""), lambda c: F.ascii(c) - _FIRST)


def _grams(codes: Column) -> Column:
    """Numbers of all three-symbol windows. ``codes`` must be a column: each window looks at it three times."""
    i = F.sequence(F.lit(0), F.size(codes) - 3)
    return F.transform(i, lambda k: F.get(codes, k) * SIZE * SIZE + F.get(codes, k + 1) * SIZE + F.get(codes, k + 2))


def _log_ratios(grams: DataFrame) -> DataFrame:
    """``(gram, ratio)`` for all SIZE**3 windows: log of accepted over rejected probability of the last symbol after the two before.

    ``grams``: ``(gram, yes, no)`` counts. Orders 2, 1 and 0 are interpolated by how often a context was seen.
    """
    spark = grams.sparkSession
    cells = spark.range(SIZE**3, numPartitions=1).select(F.col("id").cast("int").alias("gram"))
    t = cells.join(F.broadcast(grams), "gram", "left").select("gram", F.coalesce("yes", F.lit(0)).cast("double").alias("yes"), F.coalesce("no", F.lit(0)).cast("double").alias("no"))
    t = t.select("*", F.expr(f"gram div {SIZE}").alias("c2"), F.expr(f"(gram div {SIZE}) % {SIZE}").alias("c1"), (F.col("gram") % SIZE).alias("c0"))
    t = t.withColumn("g1", F.col("c1") * SIZE + F.col("c0"))
    ratio = []
    for k in ("yes", "no"):
        total = lambda *by: F.sum(k).over(Window.partitionBy(*by)) if by else F.sum(k).over(Window.partitionBy(F.lit(1)))  # noqa: E731, B023
        p0 = (total("c0") + 1.0) / (total() + SIZE)
        p1 = (total("g1") + STRENGTH * p0) / (total("c1") + STRENGTH)
        ratio.append(F.log((F.col(k) + STRENGTH * p1) / (total("c2") + STRENGTH)))
    return t.select("gram", (ratio[0] - ratio[1]).alias("ratio"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row for each row of ``pages``.

    The longest fitting rule decides. Where none fits, two smoothed variable-order Markov models do, one of the URLs that
    rules allow and one of those they block: the log-likelihood difference per character against a threshold. One ruled URL
    in KEPT_BACK is kept from the models; the threshold is the middle of the stretch of scores that separates these best,
    both verdicts weighing alike. Tables of all SIZE**3 three-symbol windows make the models, so their size is fixed and a
    look-up is one array access; counting and scoring run inside expressions, with one small aggregation between.

    Null urls and those without ``://`` have empty host and path and fit no rule; they are scored like any other (null as
    the empty text, score 0). With no allowed or no blocked URL kept back, the threshold is 0. Null ids and repeated rows
    stay as they are; an empty table gives an empty result. URLs of any length are taken whole. Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"), codes(symbols(F.col("url"))).alias("codes"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    back = F.pmod(F.xxhash64(F.lit(31), "url"), F.lit(KEPT_BACK)) == 0
    base = materialize(base.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"), back.alias("back"), _grams(F.col("codes")).alias("grams")), "urls")
    allowed, blocked = F.count_if(F.col("ruled") == "allow").alias("yes"), F.count_if(F.col("ruled") == "block").alias("no")
    learn = base.where(F.col("ruled").isNotNull() & ~F.col("back")).select("ruled", F.explode("grams").alias("gram"))
    table = _log_ratios(learn.groupBy("gram").agg(allowed, blocked)).agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "ratio"))), lambda x: x["ratio"]).alias("ratios"))
    table = materialize(table, "url-model")
    per_char = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get("ratios", g)) / F.greatest(F.lit(1), F.size("grams"))
    score = F.when(F.coalesce(F.length("url"), F.lit(0)) == 0, 0.0).otherwise(per_char)
    scored = materialize(base.withColumn("ratios", table.scalar()).select("page_id", "host", "path", "rule", "ruled", "back", score.alias("score")), "url-scores")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= _threshold(scored.where("ruled is not null and back")), "allow").otherwise("block")).alias("verdict"), "score")


def _threshold(known: DataFrame) -> float:
    """The score that separates ``known(ruled, score)`` best; of a stretch of scores that do so alike its middle; 0 without both verdicts."""
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    bins = known.groupBy(at.alias("bin")).agg(F.count_if(F.col("ruled") == "allow").alias("yes"), F.count_if(F.col("ruled") == "block").alias("no")).orderBy("bin").collect()  # BINS rows at most
    yes, no = sum(r["yes"] for r in bins), sum(r["no"] for r in bins)
    if not yes or not no:
        return 0.0
    best, cut, below_yes, below_no, last = -1.0, 0.0, 0, 0, None
    for r in bins:
        # Any cut after the bin before and up to this one leaves the same URLs below.
        gain = below_no / no - below_yes / yes
        if last is not None and gain > best:
            best, cut = gain, (last + 1 + r["bin"]) / 2
        below_yes, below_no, last = below_yes + r["yes"], below_no + r["no"], r["bin"]
    return 0.0 if best < 0 else cut / BINS * 2 * SPAN - SPAN
