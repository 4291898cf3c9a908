"""License scans: base phrases and ordered signature rules. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower
from .license_rules import BASE_PHRASES, rules

#: Confidence of a kept detection by priority 1 to 4; a base phrase has that of the highest.
CONFIDENCE = (0.4, 0.7, 0.9, 1.0)
_NOT_WORD = ALNUM_WORD.replace("[^", "[")


def normalised(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each followed by one space, with a space in front; one space for no words."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD, " ")
    return F.concat(F.lit(" "), F.ltrim(F.rtrim(spaced)), F.when(F.ltrim(spaced) == "", F.lit("")).otherwise(F.lit(" ")))


def _words(part: Column) -> Column:
    """Words of a piece of normalised text: its single spaces count them."""
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _base(phrase: str, norm: Column) -> tuple[Column, Column, Column]:
    """Places of a phrase, and its smallest and largest start counted in words."""
    size = phrase.count(" ") + 1
    parts = F.split(norm, f" {phrase}(?= )")
    n = F.size(parts) - 1
    none = F.lit(None).cast("long")
    met = F.contains(norm, F.lit(f" {phrase} "))
    first = F.when(met, _words(F.element_at(parts, 1)).cast("long")).otherwise(none)
    # What follows the last place opens with the space that ends the phrase's last word, so its spaces are its words plus one.
    last = F.when(met, (_words(norm) - 1 - (_words(F.element_at(parts, -1)) - 1) - size).cast("long")).otherwise(none)
    return F.when(met, n).otherwise(0).cast("long"), first, last


def _detections(norm: Column) -> Column:
    """All matches of the rules of which a keyword occurs, as structs in order of start, longer first."""
    words: dict[tuple[str, int, str], list[str]] = {}
    for label, priority, keyword, pattern in rules():
        words.setdefault((label, priority, pattern), []).append(keyword)
    # One rule array a set of keywords: a text without any keyword never looks at a pattern.
    by_words: dict[tuple[str, ...], list[Column]] = {}
    for (label, priority, pattern), ks in words.items():
        by_words.setdefault(tuple(ks), []).append(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern")))
    kind = "array<struct<label:string,priority:int,pattern:string>>"
    met = lambda ks: reduce(or_, [F.contains(norm, F.lit(k)) for k in ks])
    gated = [F.when(met(ks), F.array(*rs)).otherwise(F.array().cast(kind)) for ks, rs in sorted(by_words.items())]

    def places(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        gaps = F.split(norm, rule["pattern"], -1)
        fold = F.aggregate(
            F.sequence(F.lit(1), F.size(found)),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,e:int,label:string,priority:int>>").alias("out")),
            lambda s, i: F.struct(
                (s["at"] + F.length(F.get(gaps, i - 1)) + F.length(F.get(found, i - 1))).alias("at"),
                F.concat(
                    s["out"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(F.get(gaps, i - 1))).alias("a"),
                            (-(s["at"] + F.length(F.get(gaps, i - 1)) + F.length(F.get(found, i - 1)))).alias("e"),
                            rule["label"].alias("label"),
                            rule["priority"].alias("priority"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda s: s["out"],
        )
        return F.when(F.size(found) > 0, fold).otherwise(F.array().cast("array<struct<a:int,e:int,label:string,priority:int>>"))

    return F.array_sort(F.flatten(F.transform(F.concat(*gated), places)))


def _kept(found: Column) -> Column:
    """Labels and priorities of detections that none of higher priority, and no longer one of the same, contains.

    One pass in order of start, longer first: whatever can contain a detection has come before it, or starts and ends with it.
    ``reach`` holds the farthest end so far of each priority or higher.
    """
    level = lambda x, p: F.when(x["priority"] >= p, -x["e"]).otherwise(-1)

    def step(s: Column, x: Column) -> Column:
        above = F.element_at(s["reach"], x["priority"] + 1)
        same = F.element_at(s["own"], x["priority"])
        keep = (above < -x["e"]) & (same < -x["e"])
        return F.struct(
            F.array(*[F.greatest(F.element_at(s["reach"], p), level(x, p)) for p in range(1, 6)]).alias("reach"),
            F.array(*[F.greatest(F.element_at(s["own"], p), F.when(x["priority"] == p, -x["e"]).otherwise(-1)) for p in range(1, 5)]).alias("own"),
            F.when(keep, F.array_union(s["kept"], F.array(F.struct(x["label"].alias("label"), x["priority"].alias("priority"))))).otherwise(s["kept"]).alias("kept"),
        )

    # Of equal stretches the highest priority comes first.
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda x: F.struct(x["a"].alias("a"), x["e"].alias("e"), (-x["priority"]).alias("p"), x["label"].alias("label")))),
        lambda x: F.struct(x["a"].alias("a"), x["e"].alias("e"), (-x["p"]).alias("priority"), x["label"].alias("label")),
    )
    start = F.struct(F.array(*[F.lit(-1)] * 5).alias("reach"), F.array(*[F.lit(-1)] * 4).alias("own"), F.array().cast("array<struct<label:string,priority:int>>").alias("kept"))
    return F.aggregate(ordered, start, step, lambda s: s["kept"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row for each row of ``docs``.

    ``n_base`` counts all places of the base phrases; ``labels`` adds the labels of the signature rules that survive
    suppression. ``score`` is the confidence of the strongest finding, 0 without one. One pass, no shuffle: rules are
    gated by a plain search for their keyword, and most texts never meet a pattern.

    Null and wordless texts have no findings: counts 0, starts null, labels empty, score 0. Null ids and repeated rows
    stay as they are; an empty table gives an empty result. Texts are scanned whole. Other columns are ignored.
    """
    n = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    bases = [(label, *_base(phrase, F.col("norm"))) for phrase, label in BASE_PHRASES]
    counts = [F.col(f"n{i}") for i in range(len(bases))]
    n = n.select("doc_id", "norm", *[c.alias(f"{k}{i}") for i, (_, *cols) in enumerate(bases) for k, c in zip("nfl", cols, strict=True)])
    n = n.select(
        "doc_id", (_words(F.col("norm")) - 1).cast("long").alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*[F.col(f"f{i}") for i in range(len(bases))]).alias("first_word"), F.greatest(*[F.col(f"l{i}") for i in range(len(bases))]).alias("last_word"),
        F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (label, *_) in zip(counts, bases, strict=True)])).alias("base"),
        _kept(_detections(F.col("norm"))).alias("kept"),
    )
    strongest = F.array_max(F.transform("kept", lambda x: F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), x["priority"])))
    return n.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort(F.array_distinct("base"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.transform("kept", lambda x: x["label"])))).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[-1])).otherwise(0.0), F.coalesce(strongest, F.lit(0.0))).alias("score"),
    )
