"""Folders of caption files and recogniser responses to cue tables. Every reader takes rows, so folders of any size stay distributed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cues import GLOSSARY, REQUEST_LOG, not_blank
from ..functions.text import clock_ms, guess_language, pick_track, speaker_of, strip
from ..operators.joins import pair_bilingual
from .writers import window_fingerprint

_TIME = r"(\d{1,3}:\d{1,2}:\d{1,2}[.,]\d{1,3})\s*-->\s*(\d{1,3}:\d{1,2}:\d{1,2}[.,]\d{1,3})"
_VTT_TIME = r"((?:\d{1,3}:)?\d{1,2}:\d{1,2}[.,]\d{1,3})\s*-->\s*((?:\d{1,3}:)?\d{1,2}:\d{1,2}[.,]\d{1,3})"


def read_files(spark: SparkSession, folder: str, forms: tuple[str, ...] = ("srt", "vtt", "ass", "json")) -> DataFrame:
    """``(path, form, content)`` of the files in a folder whose suffix is known, as text: UTF-8, else GBK."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    form = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            for enc in ("utf-8-sig", "gbk"):
                try:
                    return b.decode(enc)
                except UnicodeDecodeError:
                    continue
            return None

        return raw.map(one)

    return f.withColumn("form", form).where(F.col("form").isin(*forms)).select("path", "form", decode("content").alias("content"))


def _numbered(files: DataFrame) -> DataFrame:
    """Files with ``media_id``: the one they have, or a hash of the path."""
    f = files if "media_id" in files.columns else files.withColumn("media_id", F.xxhash64("path"))
    return f.withColumn("content", F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", ""))


def _finish(rows: DataFrame) -> DataFrame:
    """Cues from ``(media_id, pos, start_ms, end_ms, text, translated_text)``: blank texts dropped, numbered from 0 by start."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "pos")
    return rows.where(not_blank(F.col("text"))).select("media_id", (F.row_number().over(w) - 1).alias("cue_idx"), "start_ms", "end_ms", "text", F.coalesce("translated_text", F.lit("")).alias("translated_text"))


def _by_layout(first: Column, rest: Column, layout: str) -> tuple[Column, Column]:
    return (first, rest) if layout != "translate_on_top" else (rest, first)


def srt(files: DataFrame, layout: str | None = None) -> DataFrame:
    """Cues of SRT texts ``(media_id or path, content)``.

    Blocks without a time on their second line or with under three lines are skipped. A file is bilingual if a layout is
    given, or if every block has four lines and the two differ in language in 70% of the first 50 (by ``guess_language``);
    then the layout says which line is the original (the first, by default). Otherwise further lines are joined.
    """
    b = _numbered(files).select("media_id", F.posexplode(F.split(F.regexp_replace("content", r"^\n+|\n+$", ""), r"\n[ \t]*\n+")).alias("pos", "block"))
    b = b.withColumn("lines", F.split("block", "\n")).where((F.size("lines") >= 3) & F.get("lines", F.lit(1)).rlike(_TIME))
    one, two = F.get("lines", F.lit(2)), F.get("lines", F.lit(3))
    w = Window.partitionBy("media_id")
    b = b.withColumn("n", F.row_number().over(w.orderBy("pos")))
    differs = (F.size("lines") == 4) & ~guess_language(one).eqNullSafe(guess_language(two)) & (strip(one) != strip(two))
    known = F.lit(True) if layout else F.sum(F.when(F.col("n") <= 50, differs.cast("int"))).over(w) >= 0.7 * F.sum(F.when(F.col("n") <= 50, 1)).over(w)
    b = b.withColumn("bilingual", F.min((F.size("lines") == 4).cast("int")).over(w).cast("boolean") & known)
    a, t = _by_layout(one, two, layout or "original_on_top")
    joined = F.array_join(F.slice("lines", 3, 1_000_000), "\n")
    time = F.get("lines", F.lit(1))
    return _finish(
        b.select("media_id", "pos", clock_ms(F.regexp_extract(time, _TIME, 1)).alias("start_ms"), clock_ms(F.regexp_extract(time, _TIME, 2)).alias("end_ms"), F.when(F.col("bilingual"), a).otherwise(joined).alias("text"), F.when(F.col("bilingual"), t).otherwise("").alias("translated_text"))
    )


def vtt(files: DataFrame, layout: str | None = None) -> DataFrame:
    """Cues of WebVTT texts: hours are optional, inline tags go, NOTE and STYLE blocks too; with a layout, two lines are two sides."""
    b = _numbered(files).select("media_id", F.posexplode(F.split("content", r"\n[ \t]*\n+")).alias("pos", "block")).where(F.col("block").rlike(_VTT_TIME) & ~F.col("block").rlike("^(?:NOTE|STYLE|REGION)"))
    body = F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]+>", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: strip(x)), lambda x: x != "")
    b = b.withColumn("lines", lines)
    two = F.lit(layout is not None) & (F.size("lines") == 2)
    a, t = _by_layout(F.get("lines", F.lit(0)), F.get("lines", F.lit(1)), layout or "original_on_top")
    return _finish(b.select("media_id", "pos", clock_ms(F.regexp_extract("block", _VTT_TIME, 1)).alias("start_ms"), clock_ms(F.regexp_extract("block", _VTT_TIME, 2)).alias("end_ms"), F.when(two, a).otherwise(F.array_join("lines", "\n")).alias("text"), F.when(two, t).otherwise("").alias("translated_text")))


def word_vtt(files: DataFrame) -> DataFrame:
    """A cue for each word of WebVTT texts with ``<time><c>`` tags: each lasts until the next tag, the last one until its block ends."""
    b = _numbered(files).select("media_id", F.posexplode(F.split("content", r"\n[ \t]*\n+")).alias("pos", "block")).where(F.col("block").rlike(_VTT_TIME) & F.contains("block", F.lit("<c>")))
    b = b.select("media_id", "pos", clock_ms(F.regexp_extract("block", _VTT_TIME, 1)).alias("a"), clock_ms(F.regexp_extract("block", _VTT_TIME, 2)).alias("b"), F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "").alias("body"))
    line = F.element_at(F.filter(F.split("body", "\n"), lambda x: F.contains(x, F.lit("<c>"))), 1)
    head = strip(F.regexp_extract(line, r"^([^<]*)<", 1))
    tag = r"<(\d{1,3}:\d{1,2}:\d{1,2}\.\d{1,3})><c>(.*?)</c>"
    words = F.concat(F.array(F.struct(F.col("a").alias("t"), head.alias("w"))), F.transform(F.arrays_zip(F.regexp_extract_all(line, F.lit(tag), F.lit(1)).alias("t"), F.regexp_extract_all(line, F.lit(tag), F.lit(2)).alias("w")), lambda x: F.struct(clock_ms(x["t"]).alias("t"), strip(x["w"]).alias("w"))))
    x = b.select("media_id", "pos", "b", F.posexplode(words).alias("k", "x"))
    end = F.coalesce(F.lead("x.t").over(Window.partitionBy("media_id", "pos").orderBy("k")), F.col("b"))
    x = x.select("media_id", (F.col("pos") * 10_000 + F.col("k")).alias("pos"), F.col("x.t").alias("start_ms"), end.alias("end_ms"), F.col("x.w").alias("text"), F.lit("").alias("translated_text"))
    return _finish(x)


def ass(files: DataFrame) -> DataFrame:
    """Cues of event files. Where Default and Secondary styles both occur, two events with equal times are the sides of one cue."""
    event = r"^Dialogue:\s*\d+,(\d+:\d{2}:\d{2}\.\d{2}),(\d+:\d{2}:\d{2}\.\d{2}),([^,]*),[^,]*,[^,]*,[^,]*,[^,]*,[^,]*,(.*)$"
    e = _numbered(files).select("media_id", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where(F.col("line").rlike(event))
    text = strip(F.regexp_replace(F.regexp_replace(F.regexp_extract("line", event, 4), r"\{[^}]*\}", ""), r"\\[Nn]", "\n"))
    e = e.select("media_id", "pos", clock_ms(F.regexp_extract("line", event, 1)).alias("start_ms"), clock_ms(F.regexp_extract("line", event, 2)).alias("end_ms"), F.regexp_extract("line", event, 3).alias("style"), text.alias("text"))
    w = Window.partitionBy("media_id")
    e = e.withColumn("two", F.max((F.col("style") == "Default").cast("int")).over(w) + F.max((F.col("style") == "Secondary").cast("int")).over(w) == 2)
    single = e.where(~F.col("two")).select("media_id", "pos", "start_ms", "end_ms", "text", F.lit("").alias("translated_text"))
    return _finish(single.unionByName(pair_bilingual(e.where("two"))))


_CUE_JSON = "map<string,struct<start_time:double,end_time:double,original_subtitle:string,translated_subtitle:string>>"


def cue_json(files: DataFrame) -> DataFrame:
    """Cues of ``{"1": {start_time, end_time, ...}}`` objects, in order of the numbers."""
    j = _numbered(files).select("media_id", F.explode(F.from_json("content", _CUE_JSON)).alias("k", "v"))
    return _finish(j.select("media_id", F.col("k").try_cast("int").alias("pos"), F.col("v.start_time").cast("long").alias("start_ms"), F.col("v.end_time").cast("long").alias("end_ms"), F.col("v.original_subtitle").alias("text"), F.col("v.translated_subtitle").alias("translated_text")))


def cues(files: DataFrame, layout: str | None = None) -> DataFrame:
    """Cues of files of all known forms, each read by its suffix."""
    f = _numbered(files)
    only = lambda k: f.where(F.col("form") == k)
    return srt(only("srt"), layout).unionByName(vtt(only("vtt"), layout)).unionByName(ass(only("ass"))).unionByName(cue_json(only("json")))


_SPEECH = "struct<text:string,duration:double,words:array<struct<word:string,start:double,end:double>>,segments:array<struct<text:string,start:double,end:double>>>"


def speech_words(responses: DataFrame) -> DataFrame:
    """Cues of ``(media_id, response)`` with words or segments in seconds: words if there are any, else segments, else one cue over all."""
    r = responses.select("media_id", F.from_json("response", _SPEECH).alias("r"))
    ms = lambda x: (x * 1000).cast("long")
    words = F.transform("r.words", lambda w: F.struct(w["word"].alias("text"), ms(w["start"]).alias("a"), ms(w["end"]).alias("b")))
    segments = F.transform("r.segments", lambda s: F.struct(s["text"].alias("text"), ms(s["start"]).alias("a"), ms(s["end"]).alias("b")))
    whole = F.array(F.struct(F.col("r.text").alias("text"), F.lit(0).cast("long").alias("a"), ms(F.coalesce("r.duration", F.lit(0.0))).alias("b")))
    rows = F.when(F.size("r.words") > 0, words).when(F.size("r.segments") > 0, segments).otherwise(whole)
    x = r.select("media_id", F.posexplode(rows).alias("pos", "x"))
    return _finish(x.select("media_id", "pos", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"), strip("x.text").alias("text"), F.lit("").alias("translated_text")))


_UTTERANCES = "struct<utterances:array<struct<text:string,transcript:string,start_time:bigint,end_time:bigint,words:array<struct<text:string,label:string,start_time:bigint,end_time:bigint>>>>>"


def utterances(responses: DataFrame, word_level: bool = False) -> DataFrame:
    """Cues of ``(media_id, response)`` with utterances in milliseconds, by utterance or by word; both vendors' field names."""
    r = responses.select("media_id", F.posexplode(F.from_json("response", _UTTERANCES)["utterances"]).alias("u_pos", "u"))
    if word_level:
        r = r.select("media_id", "u_pos", F.posexplode("u.words").alias("w_pos", "x")).withColumn("text", F.coalesce("x.label", "x.text"))
    else:
        r = r.select("media_id", "u_pos", F.lit(0).alias("w_pos"), F.col("u").alias("x")).withColumn("text", F.coalesce("x.transcript", "x.text"))
    return _finish(r.select("media_id", (F.col("u_pos") * 10_000 + F.col("w_pos")).alias("pos"), F.col("x.start_time").alias("start_ms"), F.col("x.end_time").alias("end_ms"), strip("text").alias("text"), F.lit("").alias("translated_text")))


_ALIGNED = "array<struct<text:string,word:string,start_time:double,start:double,end_time:double,end:double>>"


def aligned_items(responses: DataFrame) -> DataFrame:
    """Cues of aligner items in seconds, either field names; blank texts and empty spans go, times are rounded half to even."""
    r = responses.select("media_id", F.posexplode(F.from_json("response", _ALIGNED)).alias("pos", "i"))
    ms = lambda *c: F.bround(F.coalesce(*c) * 1000).cast("long")
    x = r.select("media_id", "pos", ms("i.start_time", "i.start").alias("start_ms"), ms("i.end_time", "i.end").alias("end_ms"), strip(F.coalesce("i.text", "i.word")).alias("text"), F.lit("").alias("translated_text"))
    return _finish(x.where(F.col("end_ms") > F.col("start_ms")))


_DUB = "struct<start_time:bigint,end_time:bigint,start:bigint,end:bigint,text:string,original_subtitle:string,translated_subtitle:string,speaker:string>"


def dubbing_script(files: DataFrame, track: str = "target") -> DataFrame:
    """Utterances ``(media_id, idx, start_ms, end_ms, text, speaker)`` of a JSON array or an object with numbers as keys; a speaker field beats a label."""
    f = _numbered(files)
    listed = F.from_json("content", f"array<{_DUB}>")
    keyed = F.transform(F.array_sort(F.transform(F.map_entries(F.from_json("content", f"map<string,{_DUB}>")), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v")))), lambda e: e["v"])
    rows = F.when(F.ltrim("content").startswith("["), listed).otherwise(keyed)
    x = f.select("media_id", F.posexplode(rows).alias("idx", "x"))
    text = F.coalesce("x.text", pick_track(F.col("x.original_subtitle"), F.coalesce("x.translated_subtitle", F.lit("")), track))
    x = x.select("media_id", "idx", F.coalesce("x.start_time", "x.start").alias("start_ms"), F.coalesce("x.end_time", "x.end").alias("end_ms"), speaker_of(text).alias("s"), F.nullif(strip("x.speaker"), F.lit("")).alias("given"))
    return x.select("media_id", "idx", "start_ms", "end_ms", F.col("s.line").alias("text"), F.coalesce("given", "s.speaker").alias("speaker")).where(F.length("text") > 0)


def glossaries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of glossary files, and the entries that lack an id, a term or a translation."""
    schema = f"struct<glossary_id:string,source_language:string,target_language:string,fingerprint:string,entries:array<struct<{', '.join(p.replace(' ', ':', 1) for p in GLOSSARY.split(', ')[1:9])}>>>"
    g = files.select("path", F.from_json("content", schema).alias("g")).select("path", "g.glossary_id", "g.source_language", "g.target_language", "g.fingerprint", F.explode_outer("g.entries").alias("e"))
    g = g.select("path", "glossary_id", "e.*", "source_language", "target_language", "fingerprint")
    ok = F.col("glossary_id").isNotNull()
    for c in ("entry_id", "source_term", "translation"):
        ok = ok & F.coalesce(F.length(strip(c)) > 0, F.lit(False))
    return g.where(ok), g.where(~ok)


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows, newest first; bad lines are dropped. Both layouts of token counts are read."""
    other = REQUEST_LOG.replace("cache_write_tokens:BIGINT>", "cache_write_tokens:BIGINT,prompt_tokens:BIGINT,completion_tokens:BIGINT>")
    log = spark.read.schema(other).option("mode", "DROPMALFORMED").json(folder)
    u = F.struct(
        F.coalesce("usage.input_tokens", "usage.prompt_tokens").alias("input_tokens"), F.coalesce("usage.output_tokens", "usage.completion_tokens").alias("output_tokens"),
        F.col("usage.cache_read_tokens").alias("cache_read_tokens"), F.col("usage.cache_write_tokens").alias("cache_write_tokens"),
    )
    return log.withColumn("usage", u).orderBy(F.col("time").desc_nulls_last(), "request_id")


def log_page(log: DataFrame, page: int, size: int = 50) -> DataFrame:
    return log.orderBy(F.col("time").desc_nulls_last(), "request_id").offset(page * size).limit(size)


def model_responses(rows: DataFrame, wanted: DataFrame, schema: str, text: str = "translation") -> tuple[DataFrame, DataFrame]:
    """Items of ``(batch_id, response)``: arrays of objects with ``id`` and the fields of ``schema``; and the rejects with a reason.

    An item counts if its id is among ``wanted(batch_id, id)``, is given once, and ``text`` isn't blank.
    """
    r = rows.select("batch_id", F.from_json("response", f"array<struct<id:string,{schema}>>").alias("items"))
    broken = r.where(F.col("items").isNull()).select("batch_id", F.lit(None).cast("string").alias("id"), F.lit("not_json").alias("reason"))
    x = r.select("batch_id", F.explode("items").alias("x")).select("batch_id", "x.*")
    n = x.groupBy("batch_id", "id").agg(F.count(F.lit(1)).alias("n__"))
    x = x.join(n, ["batch_id", "id"], "left").join(wanted.select("batch_id", "id").withColumn("w__", F.lit(True)), ["batch_id", "id"], "left")
    why = F.when(F.col("id").isNull() | F.col("w__").isNull(), "unknown_id").when(F.col("n__") > 1, "repeated_id").when(F.coalesce(F.length(strip(text)), F.lit(0)) == 0, "blank")
    x = x.withColumn("reason", why).drop("n__", "w__")
    return x.where(F.col("reason").isNull()).drop("reason"), x.where(F.col("reason").isNotNull()).select("batch_id", "id", "reason").unionByName(broken)


def timing_archive(files: DataFrame, expected: DataFrame, window: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Windows of archives ``(path, content)`` and what is wrong with the rest, ``(path, media_id, window_no, reason)``.

    ``window`` is the schema of a window, ``window_no int`` among its fields; ``expected(media_id, subtitle_fingerprint,
    media_fingerprint)`` what the archives must have been taken from (a null fingerprint expects nothing). Reasons of a whole
    archive, the first that holds: ``not_json``, ``unsupported_version``, ``unknown_media``, ``subtitle_fingerprint``,
    ``media_fingerprint``, ``no_windows``; of a window: ``window_fingerprint``, where its fields aren't those that were written.
    """
    head = "schema_version:int,media_id:bigint,subtitle_fingerprint:string,media_fingerprint:string"
    fields = [f.name for f in T.StructType.fromDDL(window)]
    ddl = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(window))
    a = files.select("path", F.from_json("content", f"struct<{head},windows:array<struct<{ddl},window_fingerprint:string>>>", {"mode": "PERMISSIVE"}).alias("a")).select("path", "a.*")
    e = expected.select("media_id", F.col("subtitle_fingerprint").alias("s__"), F.col("media_fingerprint").alias("m__"), F.lit(True).alias("known__"))
    differs = lambda got, want: F.col(want).isNotNull() & ~F.col(got).eqNullSafe(F.col(want))
    none = F.coalesce(*[F.col(c).cast("string") for c in ("schema_version", "media_id", "subtitle_fingerprint", "media_fingerprint")], F.col("windows").cast("string")).isNull()
    why = (
        F.when(none, "not_json").when(~F.col("schema_version").eqNullSafe(F.lit(version)), "unsupported_version").when(F.col("known__").isNull(), "unknown_media")
        .when(differs("subtitle_fingerprint", "s__"), "subtitle_fingerprint").when(differs("media_fingerprint", "m__"), "media_fingerprint").when(F.col("windows").isNull(), "no_windows")
    )
    a = a.join(e, "media_id", "left").withColumn("reason", why)
    w = a.where(F.col("reason").isNull()).select("path", "media_id", F.explode("windows").alias("w")).select("path", "media_id", "w.*")
    same = window_fingerprint(fields).eqNullSafe(F.col("window_fingerprint"))
    bad = a.where(F.col("reason").isNotNull()).select("path", "media_id", F.lit(None).cast("int").alias("window_no"), "reason")
    changed = w.where(~same).select("path", "media_id", "window_no", F.lit("window_fingerprint").alias("reason"))
    return w.where(same).select("media_id", *fields), bad.unionByName(changed)
