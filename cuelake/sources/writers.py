"""Cue tables to caption files and report tables: one content row for each media item, written with Spark's own committers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cues import in_order
from ..functions.text import ass_time, md_escape, srt_time, vtt_time

LAYOUTS = ("original_on_top", "translate_on_top", "only_original", "only_translate")
#: The head of an event file.
ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,48\nStyle: Secondary,Arial,36\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def lines_of(layout: str) -> Column:
    """A cue's text for a layout; where one side is blank, the other alone."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    a, b = F.col("text"), F.coalesce(F.col("translated_text"), F.lit(""))
    if layout == "only_original":
        return a
    if layout == "only_translate":
        return F.when(F.length(F.trim(b)) > 0, b).otherwise(a)
    top, below = (a, b) if layout == "original_on_top" else (b, a)
    return F.when(F.length(F.trim(b)) == 0, a).when(F.length(F.trim(a)) == 0, b).otherwise(F.concat(top, F.lit("\n"), below))


def _blocks(cues: DataFrame, block: Column, between: str, head: str = "", tail: str = "") -> DataFrame:
    """``(media_id, content)``: the blocks of a media item in order."""
    c = cues.withColumn("no", F.row_number().over(in_order())).withColumn("line", block)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])
    return c.groupBy("media_id").agg(rows.alias("rows")).select("media_id", F.concat(F.lit(head), F.array_join("rows", between), F.lit(tail)).alias("content"))


def srt(cues: DataFrame, layout: str = "original_on_top") -> DataFrame:
    return _blocks(cues, F.concat_ws("\n", F.col("no").cast("string"), F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms"))), lines_of(layout)), "\n\n", tail="\n")


def vtt(cues: DataFrame, layout: str = "original_on_top") -> DataFrame:
    return _blocks(cues, F.concat_ws("\n", F.col("no").cast("string"), F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms"))), lines_of(layout)), "\n\n", head="WEBVTT\n\n", tail="\n")


def txt(cues: DataFrame, layout: str = "original_on_top") -> DataFrame:
    return _blocks(cues, lines_of(layout), "\n")


def ass(cues: DataFrame, layout: str = "original_on_top") -> DataFrame:
    """Events; a bilingual cue becomes two, the Secondary one first."""
    a, b = F.col("text"), F.coalesce(F.col("translated_text"), F.lit(""))
    event = lambda style, text: F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), F.replace(text, F.lit("\n"), F.lit(r"\N")))
    both = (F.length(F.trim(b)) > 0) & (F.length(F.trim(a)) > 0)
    if layout in ("only_original", "only_translate"):
        rows = event("Default", lines_of(layout))
    else:
        main, other = (a, b) if layout == "original_on_top" else (b, a)
        rows = F.when(both, F.concat_ws("\n", event("Secondary", other), event("Default", main))).otherwise(event("Default", lines_of(layout)))
    return _blocks(cues, rows, "\n", head=ASS_HEAD, tail="\n")


def cue_json(cues: DataFrame) -> DataFrame:
    """``{"1": {start_time, end_time, original_subtitle, translated_subtitle}, ...}`` of each media item."""
    c = cues.withColumn("no", F.row_number().over(in_order()))
    one = F.struct(F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), F.col("text").alias("original_subtitle"), F.col("translated_text").alias("translated_subtitle"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("no", one.alias("v")))), lambda x: F.struct(x["no"].cast("string").alias("k"), x["v"].alias("v")))
    return c.groupBy("media_id").agg(F.map_from_entries(rows).alias("m")).select("media_id", F.to_json("m").alias("content"))


FORMATS = {"srt": srt, "vtt": vtt, "txt": txt, "ass": ass, "json": lambda cues, layout="": cue_json(cues)}


def save(cues: DataFrame, folder: str, form: str, layout: str = "original_on_top") -> None:
    """Write one folder of text for each media item, ``folder/media_id=...``, in the given form."""
    if form not in FORMATS:
        raise ValueError(f"no writer for {form!r}; there are {sorted(FORMATS)}")
    content = FORMATS[form](cues, layout)
    content.repartition("media_id").write.partitionBy("media_id").mode("overwrite").option("lineSep", "\n").text(folder)


#: What earlier stages put before a file's name.
STAGE_PREFIX = "^(?:【转录字幕】|【初版字幕】|【后处理字幕】|【字幕】|【样式字幕】)+"


def stage_path(path: Column | str, stage: str) -> Column:
    """Where a stage writes what it made of a file: beside it, as SRT, under the stage's name in place of those of earlier stages."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_replace(F.substring_index(p, "/", -1), r"(?<=.)\.[^./]*$", "")
    folder = F.regexp_replace(p, r"[^/]*$", "")
    return F.concat(folder, F.lit(f"【{stage}】"), F.regexp_replace(name, STAGE_PREFIX, ""), F.lit(".srt"))


def checkpoint_stage(cues: DataFrame, folder: str, stage: str) -> DataFrame:
    """Write the cues of a stage under its name, replacing an earlier run, and read them back; Spark's commit makes it whole or absent."""
    path = f"{folder}/stage={stage}"
    cues.write.mode("overwrite").parquet(path)
    return cues.sparkSession.read.schema(cues.schema).parquet(path)


def change_log(before: DataFrame, after: DataFrame, stage: str) -> DataFrame:
    """``(stage, media_id, cue_idx, field, before, after)``: what a stage did to times and texts, cues dropped or added included."""
    cols = ("start_ms", "end_ms", "text", "translated_text")
    side = lambda d, s: d.select("media_id", "cue_idx", F.struct(*[F.col(c).cast("string").alias(c) for c in cols]).alias(s))
    j = side(before, "b").join(side(after, "a"), ["media_id", "cue_idx"], "full")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b.{c}").alias("before"), F.col(f"a.{c}").alias("after")) for c in cols])
    e = j.select("media_id", "cue_idx", F.explode(fields).alias("f")).where(~F.col("f.before").eqNullSafe(F.col("f.after")))
    return e.select(F.lit(stage).alias("stage"), "media_id", "cue_idx", "f.field", "f.before", "f.after")


def markdown_table(rows: DataFrame, by: str, cols: list[str], order: list[str], most: int = 40) -> DataFrame:
    """``(by, table)``: Markdown of the first ``most`` rows of each group, and how many are left out."""
    w = Window.partitionBy(by)
    r = rows.withColumn("n__", F.row_number().over(w.orderBy(*order))).withColumn("all__", F.count(F.lit(1)).over(w)).where(F.col("n__") <= most)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[md_escape(F.col(c).cast("string")) for c in cols]), F.lit(" |"))
    g = r.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n__", line.alias("line")))), lambda x: x["line"]).alias("lines"), F.max("all__").alias("n"))
    head = "| " + " | ".join(cols) + " |\n|" + "---|" * len(cols) + "\n"
    more = F.when(F.col("n") > most, F.concat(F.lit("\n... and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return g.select(by, F.concat(F.lit(head), F.array_join("lines", "\n"), more).alias("table"))


def glossary_json(glossary: DataFrame, version: int = 1) -> DataFrame:
    """``(glossary_id, content)``: entries of a glossary as canonical JSON, fields and entries in order of name."""
    fields = sorted(set(glossary.columns) - {"glossary_id"})
    entry = F.struct(*fields)
    g = glossary.groupBy("glossary_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", F.to_json(entry).alias("j")))).alias("e"))
    return g.select("glossary_id", F.concat(F.lit('{"entries":['), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit(f'],"schema_version":{version}}}')).alias("content"))


def dubbing_report(segments: DataFrame, warnings: DataFrame) -> DataFrame:
    """``(media_id, content)``: a dub's segments in order and its ``warnings(media_id, warning)`` as JSON."""
    cols = ("speaker", "start_ms", "end_ms", "text", "rewritten_text", "voice")
    one = F.struct(F.col("idx").alias("index"), *cols, F.col("synthesized_ms").alias("synthesized_duration_ms"), F.col("fitted_ms").alias("fitted_duration_ms"), F.round("speed_factor", 4).alias("speed_factor"), "warning")
    s = segments.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.to_json(one, {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"]).alias("rows"))
    w = warnings.groupBy("media_id").agg(F.array_sort(F.collect_list("warning")).alias("w"))
    return s.join(w, "media_id", "left").select("media_id", F.concat(F.lit('{"segments":['), F.array_join("rows", ","), F.lit('],"warnings":'), F.to_json(F.coalesce("w", F.array().cast("array<string>"))), F.lit("}")).alias("content"))


def subtitle_fingerprints(cues: DataFrame) -> DataFrame:
    """``(media_id, subtitle_fingerprint)``: sha256 of all cues of a media item in order, times and both sides."""
    one = F.struct("start_ms", "end_ms", "text", "translated_text")
    in_turn = F.array_sort(F.collect_list(F.struct("start_ms", "cue_idx", F.sha2(F.to_json(one, {"ignoreNullFields": "false"}), 256).alias("h"))))
    return cues.groupBy("media_id").agg(F.sha2(F.array_join(F.transform(in_turn, lambda x: x["h"]), ""), 256).alias("subtitle_fingerprint"))


def window_fingerprint(fields: list[str]) -> Column:
    """sha256 of a window's canonical JSON: fields by name, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def timing_archive(evidence: DataFrame, fingerprints: DataFrame, version: int = 1) -> DataFrame:
    """``(media_id, schema_version, content)``: windows of evidence as canonical JSON, fields by name and windows by number; ``readers.timing_archive`` gives them back.

    ``fingerprints(media_id, subtitle_fingerprint, media_fingerprint)`` says what the evidence was taken from; media items
    without a row there aren't written. Each window carries a fingerprint of its own fields.
    """
    fields = sorted(c for c in evidence.columns if c != "media_id")
    window = F.struct(*fields, window_fingerprint(fields).alias("window_fingerprint"))
    g = evidence.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("window_no", F.to_json(window).alias("j")))).alias("e")).join(fingerprints, "media_id")
    head = F.to_json(F.struct("media_fingerprint", "media_id", F.lit(version).alias("schema_version"), "subtitle_fingerprint"), {"ignoreNullFields": "false"})
    head = F.regexp_replace(head, r"\}$", "")
    return g.select("media_id", F.lit(version).alias("schema_version"), F.concat(head, F.lit(',"windows":['), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit("]}")).alias("content"))


def quality_report(before: DataFrame, after: DataFrame, changes: DataFrame, issues: DataFrame) -> DataFrame:
    """``(media_id, measure, before, after)``: metrics, fields changed and issues by kind of each media item, as one long table."""
    names = [c for c in before.columns if c != "media_id"]
    long = lambda d, name: d.select("media_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("measure", name))
    m = long(before, "before").join(long(after, "after"), ["media_id", "measure"], "full")
    none = F.lit(None).cast("double").alias("before")
    c = changes.groupBy("media_id", F.concat(F.lit("changed_"), F.col("field")).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("after")).select("media_id", "measure", none, "after")
    i = issues.groupBy("media_id", F.concat(F.lit("issues_"), F.col("kind")).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("after")).select("media_id", "measure", none, "after")
    return m.unionByName(c).unionByName(i)
