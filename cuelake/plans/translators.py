"""Translators picked by name: what each is asked for, and its answers put in place. Answers are tables; nothing is called."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cues import in_order
from ..functions.languages import DEFAULT, target_code
from ..functions.text import strip
from ..operators import joins


@dataclass(frozen=True)
class Translator:
    """A service, the cues it takes at once (``None``: as many as the caller wants), and whether it takes language codes or names."""

    name: str
    most: int | None
    coded: bool = True


#: Services and how many cues they take at once.
TRANSLATORS = {t.name: t for t in (Translator("openai", None, False), Translator("google", 5), Translator("bing", 10), Translator("deeplx", 5))}


def translator(name: str) -> Translator:
    """The translator of a name in any case; an error names those that there are."""
    found = TRANSLATORS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"no translator {name!r}; there are {sorted(TRANSLATORS)}")
    return found


def requests(cues: DataFrame, name: str, language: str | None = None, size: int = 10) -> DataFrame:
    """``(media_id, batch_no, service, target, cue_ids, texts)``: cues that aren't blank, in order, as many at once as the service takes.

    ``target`` is the service's code of the language (simplified Chinese where none is given), or its name for a service that
    takes names. ``size`` counts for services that leave it open.
    """
    t = translator(name)
    most, wanted = t.most or size, language or DEFAULT
    target = target_code(F.lit(wanted), F.lit(t.name)) if t.coded else F.lit(wanted)
    c = cues.where(F.length(strip(F.coalesce("text", F.lit("")))) > 0).withColumn("n__", F.row_number().over(in_order()) - 1)
    g = c.groupBy("media_id", F.floor(F.col("n__") / most).cast("int").alias("batch_no")).agg(F.array_sort(F.collect_list(F.struct("n__", "cue_idx", "text"))).alias("x"))
    return g.select("media_id", "batch_no", F.lit(t.name).alias("service"), target.alias("target"), F.transform("x", lambda x: x["cue_idx"]).alias("cue_ids"), F.transform("x", lambda x: x["text"]).alias("texts"))


def translate(cues: DataFrame, name: str, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Cues with the translations of one service, and ``(media_id, cue_idx)`` without one. ``tables`` holds each service's ``(media_id, cue_idx, translation)``; blank ones count as none, and of one that is repeated the smallest."""
    t = translator(name)
    if t.name not in tables:
        raise ValueError(f"no table of {t.name!r}; there are {sorted(tables)}")
    given = tables[t.name].where(F.length(strip("translation")) > 0).groupBy("media_id", "cue_idx").agg(F.min("translation").alias("translation"))
    return joins.attach_translations(cues, given)
