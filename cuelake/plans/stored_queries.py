"""Registered queries over what services, models and stores hold of cues: answers, rewrites, evidence, caches, terms.

No given table holds such things, so Spark derives them from the cues; whatever is odd about them follows from ids alone, so that
SQL can say what must come of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cues import CUES_SQL, read_cue_view
from ..functions import text as T
from ..functions.languages import service_codes, target_code
from ..operators import edit, filters, joins, structure, validate, windows
from ..sources import answers, writers
from . import rewrites, translators
from .queries import _add, _table

_BATCHED = ", bt AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_idx) - 1) // 10 AS b FROM cues), bk AS (SELECT *, media_id || '/' || b AS batch_id, (media_id + b) % 7 AS odd, row_number() OVER (PARTITION BY media_id, b ORDER BY start_ms, cue_idx) AS n FROM bt)"


def _name(*cols: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in cols])


# Quotes: a cue begins, ends or is surrounded with one, by its number; the state goes through each media item.
_QUOTED = r"""
, v AS (SELECT media_id, cue_idx, start_ms, CASE cue_idx % 5 WHEN 0 THEN '"' || text WHEN 1 THEN text || '"' WHEN 2 THEN '“' || text || '" ''x''' WHEN 3 THEN '‘it''s ' || text ELSE text END AS t FROM cues),
ch AS (SELECT media_id, cue_idx, start_ms, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM v),
nb AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS q FROM ch WINDOW w AS (PARTITION BY media_id, cue_idx ORDER BY i)),
kd AS (SELECT *, CASE WHEN c IN ('“', '”', '「', '」', '"') THEN 0 WHEN c IN ('‘', '’', '『', '』') THEN 1 WHEN c = '''' AND NOT (regexp_matches(coalesce(p, ''), '^[A-Za-z]$') AND regexp_matches(coalesce(q, ''), '^[A-Za-z]$')) THEN 1 END AS kind,
  CASE WHEN c IN ('“', '「', '‘', '『') THEN 1 WHEN c IN ('”', '」', '’', '』') THEN 0 END AS dir FROM nb),
sg AS (SELECT *, count(dir) OVER w AS seg FROM kd WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY media_id, kind ORDER BY start_ms, cue_idx, i ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, max(dir) OVER (PARTITION BY media_id, kind, seg) AS base, sum(CASE WHEN dir IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, kind, seg ORDER BY start_ms, cue_idx, i ROWS UNBOUNDED PRECEDING) AS k FROM sg),
fm AS (SELECT media_id, cue_idx, i, kind, CASE WHEN dir IS NOT NULL THEN dir = 1 ELSE (coalesce(base, 0) + k) % 2 = 1 END AS opens FROM st)
SELECT media_id, cue_idx, string_agg(CASE WHEN fm.kind = 0 THEN CASE WHEN opens THEN '「' ELSE '」' END WHEN fm.kind = 1 THEN CASE WHEN opens THEN '『' ELSE '』' END ELSE c END, '' ORDER BY i) AS text FROM ch LEFT JOIN fm USING (media_id, cue_idx, i) GROUP BY media_id, cue_idx"""


@_add("quoted_cues", _QUOTED)
def _quoted_cues(c: DataFrame) -> DataFrame:
    k, t = F.col("cue_idx") % 5, F.col("text")
    odd = F.when(k == 0, F.concat(F.lit('"'), t)).when(k == 1, F.concat(t, F.lit('"'))).when(k == 2, F.concat(F.lit("“"), t, F.lit("\" 'x'"))).when(k == 3, F.concat(F.lit("‘it's "), t)).otherwise(t)
    return edit.normalize_quotes(c.withColumn("text", odd)).select("media_id", "cue_idx", "text")


def _batched(c: DataFrame) -> DataFrame:
    b = windows.with_batches(c, 10)
    return b.withColumn("batch_id", _name("media_id", "batch_no")).withColumn("odd", (F.col("media_id") + F.col("batch_no")) % 7)


def _translation_answers(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers for batches of ten cues, with a mark at their ends: of seven one is broken, one lacks its last cue, one gives one twice, one a blank text, one an id as text."""
    b = _batched(c)
    item = F.to_json(F.struct(F.col("cue_idx").alias("id"), F.concat("text", F.lit(" !")).alias("text")))
    g = b.groupBy("batch_id", "odd").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "cue_idx", item.alias("j")))), lambda x: x["j"]).alias("items"), F.max(F.struct("start_ms", "cue_idx")).alias("end"))
    last = F.size("items")
    items = (
        F.when(F.col("odd") == 2, F.slice("items", 1, last - 1)).when(F.col("odd") == 3, F.concat("items", F.slice("items", 1, 1)))
        .when(F.col("odd") == 4, F.concat(F.slice("items", 1, last - 1), F.array(F.concat(F.lit('{"id":'), F.col("end.cue_idx").cast("string"), F.lit(',"text":" "}')))))
        .when(F.col("odd") == 5, F.concat(F.slice("items", 1, last - 1), F.array(F.concat(F.lit('{"id":"'), F.col("end.cue_idx").cast("string"), F.lit('","text":"x"}')))))
        .otherwise(F.col("items"))
    )
    text = F.concat(F.lit('{"translations":['), F.array_join(items, ","), F.when(F.col("odd") == 1, F.lit("]")).otherwise(F.lit("]}")))
    return answers.translations(g.select("batch_id", text.alias("response")), b.select("batch_id", F.col("cue_idx").alias("id")))


_add("answered_cues", f"{_BATCHED} SELECT batch_id, cue_idx::BIGINT AS id, ltrim(text || ' !', chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM bk WHERE odd IN (0, 6)")(lambda c: _translation_answers(c)[0])
_add("rejected_answers", f"{_BATCHED} SELECT DISTINCT batch_id, CASE odd WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'missing_id' WHEN 3 THEN 'repeated_id' WHEN 4 THEN 'blank_text' ELSE 'bad_item' END AS reason FROM bk WHERE odd BETWEEN 1 AND 5")(
    lambda c: _translation_answers(c)[1]
)


def _rewrite_rounds(c: DataFrame) -> rewrites.Round:
    """Windows of ten cues, three attempts each: of seven two are right at once, one at the second, one at the third, the others lack a cue, name one too many or change nothing."""
    b = _batched(c).withColumnRenamed("batch_id", "window_id").withColumn("cue_id", F.col("cue_idx").cast("string"))
    first = F.col("cue_idx") == F.min("cue_idx").over(windows.Window.partitionBy("window_id"))
    a = b.withColumn("first", first).withColumn("attempt", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    odd, good = F.col("odd"), F.col("odd") < F.col("attempt") + 1
    text = F.when(~good & ~odd.isin(4, 5), F.col("text")).otherwise(F.concat(T.strip("text"), F.lit(" ok")))
    given = a.where(good | (odd != 4) | ~F.col("first")).select("window_id", "attempt", "cue_id", text.alias("text"))
    extra = a.where(~good & (odd == 5) & F.col("first")).select("window_id", "attempt", F.lit("x").alias("cue_id"), F.lit("y").alias("text"))
    return rewrites.settle(b.select("window_id", "cue_id", F.col("text").alias("before"), F.lit(None).cast("int").alias("most_graphemes")), given.unionByName(extra))


def _rounds(c: DataFrame) -> DataFrame:
    r = _rewrite_rounds(c)
    held = r.accepted.groupBy("window_id", "attempt").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.lit("accepted"))
    gone = r.given_up.select("window_id", F.col("attempts").alias("attempt"), F.size("feedback").cast("long").alias("n"), "verdict")
    return held.unionByName(gone)


_add(
    "rewrite_rounds",
    f"""{_BATCHED}, w AS (SELECT batch_id AS window_id, odd, count(*) AS size FROM bk GROUP BY ALL)
SELECT window_id, CASE WHEN odd <= 1 THEN 1 WHEN odd <= 3 THEN odd ELSE 3 END::INT AS attempt, CASE WHEN odd <= 3 THEN size WHEN odd = 4 AND size = 1 THEN 0 WHEN odd = 6 THEN 3 * size ELSE 3 END AS n, CASE WHEN odd <= 3 THEN 'accepted' ELSE 'unresolved' END AS verdict FROM w WHERE NOT (odd = 4 AND size = 1)""",
)(_rounds)

_NAMES = {"en": "english_uk", "de": "german", "fr": "french", "es": "spanish_latam"}
_SERVICES = ("google", "bing", "deeplx", "other")


def _codes_sql() -> str:
    rows = [f"('{lang}', '{s}', '{service_codes(s).get(name, service_codes(s).get('simplified_chinese', 'zh-CN'))}')" for lang, name in _NAMES.items() for s in _SERVICES]
    return f"WITH k(lang, service, code) AS (VALUES {', '.join(rows)}), s(service, z) AS (VALUES ('google', 'zh-CN'), ('bing', 'zh-Hans'), ('deeplx', 'zh-Hans'), ('other', 'zh-CN')) SELECT doc_id, service, coalesce(code, z) AS code FROM documents CROSS JOIN s LEFT JOIN k USING (lang, service)"


@_add("target_codes", _codes_sql(), cues=False)
def _target_codes(spark, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("service", F.explode(F.array(*map(F.lit, _SERVICES))))
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return d.select("doc_id", "service", target_code(F.try_element_at(names, F.coalesce("lang", F.lit(""))), F.col("service")).alias("code"))


_add("service_requests", """, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_idx) - 1 AS n FROM cues WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0)
SELECT media_id, (n // 5)::INT AS batch_no, 'deeplx' AS service, 'pt-BR' AS target, string_agg(cue_idx, ',' ORDER BY n) AS cue_ids, sha256(string_agg(text, chr(10) ORDER BY n)) AS texts FROM n GROUP BY media_id, n // 5""")(
    lambda c: translators.requests(c, "DeepLX", "Portuguese-BR").withColumn("cue_ids", F.concat_ws(",", F.col("cue_ids").cast("array<string>"))).withColumn("texts", F.sha2(F.array_join("texts", "\n"), 256))
)

# Evidence: windows of five cues whose grade follows from their number; each anchor is a third of its cue.
_FIVES = ", f AS (SELECT *, cue_idx // 5 AS wn, ['LOW', 'MEDIUM', 'HIGH'][((media_id + cue_idx // 5) % 3 + 1)::INT] AS grade FROM cues)"


def _fives(c: DataFrame) -> DataFrame:
    wn = F.floor(F.col("cue_idx") / 5)
    f = c.withColumn("wn", wn).withColumn("grade", F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), ((F.col("media_id") + F.col("wn")) % 3 + 1).cast("int")))
    third = F.floor((F.col("end_ms") - F.col("start_ms")) / 3)
    anchor = F.struct(F.col("cue_idx").alias("cue_id"), (F.col("start_ms") + third).alias("start_ms"), (F.col("end_ms") - third).alias("end_ms"))
    g = f.groupBy("media_id", F.col("wn").alias("pos"), "grade").agg(F.array_sort(F.collect_list("cue_idx")).alias("cue_ids"), F.array_sort(F.collect_list(anchor)).alias("anchors"))
    # A second, later window of HIGH evidence holds the first two cues of every other one.
    again = g.where("pos % 2 = 0").select("media_id", (F.col("pos") + 1_000_000).alias("pos"), F.lit("HIGH").alias("grade"), F.slice("cue_ids", 1, 2).alias("cue_ids"), F.slice("anchors", 1, 1).alias("anchors"))
    return g.unionByName(again)


_add(
    "cue_evidence",
    f"""{_FIVES}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id, wn ORDER BY cue_idx) AS k FROM f)
SELECT media_id, cue_idx, CASE WHEN wn % 2 = 0 AND k <= 2 THEN 'HIGH' ELSE grade END AS grade, CASE WHEN wn % 2 = 0 AND k = 2 THEN NULL ELSE start_ms + (end_ms - start_ms) // 3 END AS speech_start_ms, CASE WHEN wn % 2 = 0 AND k = 2 THEN NULL ELSE end_ms - (end_ms - start_ms) // 3 END AS speech_end_ms,
  CASE WHEN wn % 2 = 0 AND k <= 2 THEN 1000 ELSE CASE grade WHEN 'HIGH' THEN 1000 WHEN 'MEDIUM' THEN 500 ELSE 250 END END AS boundary_budget_ms FROM r""",
)(lambda c: joins.evidence_of_cues(c.withColumn("cue_id", F.col("cue_idx")), _fives(c)).select("media_id", "cue_idx", "grade", "speech_start_ms", "speech_end_ms", "boundary_budget_ms"))
_add("eligible_windows", f"{_FIVES} SELECT media_id, wn AS window_id, grade FROM f GROUP BY ALL HAVING grade <> 'LOW' AND count_if(cue_idx % 17 = 4) = 0")(
    lambda c: filters.eligible_windows(_fives(c).where("pos < 1000000").withColumn("window_id", F.col("pos").cast("int")), c.where("cue_idx % 17 <> 4").select("media_id", F.col("cue_idx").alias("cue_id"))).select("media_id", "window_id", "grade")
)
_add(
    "fallback_evidence",
    """SELECT media_id, cue_idx // 5 AS window_no, 'LOW' AS grade, 1.0::DOUBLE AS coverage, 'subtitle_input' AS provenance, CASE WHEN cue_idx // 5 % 2 = 0 THEN 'unaligned' ELSE 'no_words' END AS failure, string_agg(cue_idx || ':' || start_ms || '-' || end_ms, ' ' ORDER BY start_ms, cue_idx) AS anchors FROM cues GROUP BY media_id, cue_idx // 5""",
)(lambda c: _fallback(c))


def _fallback(c: DataFrame) -> DataFrame:
    """No window has words; half of them went through the grading nevertheless."""
    plans = c.groupBy("media_id", F.floor(F.col("cue_idx") / 5).cast("int").alias("window_no")).agg(
        F.min("cue_idx").alias("first_idx"), F.max("cue_idx").alias("last_idx"), F.min("start_ms").alias("cue_start_ms"), F.max("end_ms").alias("cue_end_ms"), F.min("start_ms").alias("clip_start_ms"), F.max("end_ms").alias("clip_end_ms"),
    )
    words = c.select("media_id", F.floor(F.col("cue_idx") / 5).cast("int").alias("window_no"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"), "text").limit(0)
    e = structure.with_fallback(structure.word_evidence(plans.where("window_no % 2 = 0"), c, words), plans, c)
    shown = F.transform("anchors", lambda a: F.concat(a["cue_idx"].cast("string"), F.lit(":"), a["start_ms"].cast("string"), F.lit("-"), a["end_ms"].cast("string")))
    return e.select("media_id", "window_no", "grade", "coverage", "provenance", "failure", F.array_join(shown, " ").alias("anchors"))


_SPANS = ", cs AS (SELECT media_id, cue_idx, sum(length(text)) OVER (PARTITION BY media_id ORDER BY cue_idx ROWS UNBOUNDED PRECEDING) AS b, length(text) AS len FROM cues), an AS (SELECT media_id, max(b) AS n FROM cs GROUP BY media_id), aa AS (SELECT media_id, unnest(range(0, (n // 40 + 2)::BIGINT)) AS k FROM an)"


@_add("anchor_owners", f"{_SPANS}, lo AS (SELECT media_id, max(cue_idx) AS last_id FROM cs GROUP BY media_id) SELECT aa.media_id AS window_id, k AS anchor_no, coalesce(cs.cue_idx, last_id) AS cue_id FROM aa JOIN lo USING (media_id) LEFT JOIN cs ON cs.media_id = aa.media_id AND 40 * k + 4.5 >= b - len AND 40 * k + 4.5 < b")
def _anchor_owners(c: DataFrame) -> DataFrame:
    """Anchors of nine letters, one every forty letters of a media item's texts, up to past its end."""
    upto = F.sum(F.length("text")).over(windows.Window.partitionBy("media_id").orderBy("cue_idx").rowsBetween(windows.Window.unboundedPreceding, 0))
    s = c.select(F.col("media_id").alias("window_id"), F.col("cue_idx").alias("cue_id"), F.col("cue_idx").alias("ord"), upto.alias("b"), F.length("text").alias("len")).withColumn("a", F.col("b") - F.col("len"))
    k = edit.spread(s.groupBy("window_id").agg(F.max("b").alias("n")), "window_id").select("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 40) + 1)).alias("anchor_no"))
    anchors = k.select("window_id", "anchor_no", (F.col("anchor_no") * 40).alias("from_char"), (F.col("anchor_no") * 40 + 9).alias("to_char"))
    return joins.anchor_owner(anchors, s).select("window_id", "anchor_no", "cue_id")


def _preflight(c: DataFrame, d: DataFrame) -> DataFrame:
    """Every document as a media file: one in five without a length, one in three without a track."""
    m = d.select(F.col("doc_id").alias("media_id"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("n_chars") * 100).alias("duration_ms"), (F.col("doc_id") % 3).alias("audio_tracks"))
    return filters.preflight(m, c).select("media_id", F.array_join("failed", ",").alias("failed"))


_add(
    "preflight",
    f"""{CUES_SQL}, m AS (SELECT doc_id AS media_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars * 100 END AS d, doc_id % 3 AS tracks FROM documents), k AS (SELECT media_id, max(end_ms) AS last, count(*) AS n FROM cues GROUP BY media_id)
SELECT media_id, array_to_string(list_filter([CASE WHEN coalesce(n, 0) = 0 THEN 'no_cues' END, CASE WHEN tracks = 0 THEN 'no_audio' END, CASE WHEN coalesce(d, 0) <= 0 THEN 'no_duration' END, CASE WHEN d > 21600000 THEN 'too_long' END, CASE WHEN last > d + 1000 THEN 'cues_past_end' END], lambda x: x IS NOT NULL), ',') AS failed FROM m LEFT JOIN k USING (media_id)""",
    cues=False,
)(lambda s, d: _preflight(read_cue_view(s, d), _table(s, d, "documents")))

# Stores: caches by content, evidence kept in two places, glossaries.
_add(
    "cached_texts",
    """, w AS (SELECT media_id, cue_idx, sha256(text) AS key FROM cues), live AS (SELECT DISTINCT sha256(text) AS key, text || '!' AS value FROM cues WHERE length(text) % 3 = 1)
SELECT media_id, cue_idx, value FROM w LEFT JOIN live USING (key)""",
)(lambda c: _cached(c))


def _cached(c: DataFrame) -> DataFrame:
    """A third of all texts isn't cached, a third has run out; of two live values the one that lives longer holds; blank ones are none."""
    k = c.select(F.sha2("text", 256).alias("key"), F.length("text").alias("n"), F.concat("text", F.lit("!")).alias("value")).distinct()
    ends = k.where("n % 3 <> 0").withColumn("expires_at", F.when(F.col("n") % 3 == 1, 200).otherwise(50))
    cache = ends.unionByName(ends.withColumn("value", F.lit("old")).withColumn("expires_at", F.col("expires_at") - 20)).unionByName(k.where("n % 3 = 0").withColumn("value", F.lit(" ")).withColumn("expires_at", F.lit(900)))
    hit, miss = joins.cache_lookup(c.select("media_id", "cue_idx", F.sha2("text", 256).alias("key")), cache.select("key", "value", "expires_at"), F.lit(100))
    return hit.select("media_id", "cue_idx", "value").unionByName(miss.select("media_id", "cue_idx", F.lit(None).cast("string").alias("value")))


_add("reused_evidence", "SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id WHEN doc_id % 3 = 0 THEN 'c' || doc_id END AS bundle, CASE WHEN doc_id % 2 = 0 THEN 'sidecar' WHEN doc_id % 3 = 0 THEN 'cache' END AS origin FROM documents", cues=False)(lambda s, d: _reused(_table(s, d, "documents").select(F.col("doc_id").alias("key"))))


def _reused(work: DataFrame) -> DataFrame:
    kept = lambda p, n: work.where(F.col("key") % n == 0).select("key", F.concat(F.lit(p), F.col("key").cast("string")).alias("bundle"))
    found, rest = joins.reuse_evidence(work, kept("s", 2), kept("c", 3))
    return found.unionByName(rest, allowMissingColumns=True)


_add(
    "import_verdicts",
    """SELECT item_id AS glossary_id, CASE WHEN k % 4 = 0 THEN 'incompatible' WHEN k % 5 = 0 THEN 'incompatible' WHEN k % 3 = 0 THEN 'exact' ELSE 'seed' END AS verdict FROM (SELECT item_id, length(text) AS k FROM benchmark)""",
    cues=False,
)(lambda s, d: _imports(_table(s, d, "benchmark")))


def _imports(b: DataFrame) -> DataFrame:
    k = F.length("text")
    given = b.select(F.col("item_id").alias("glossary_id"), F.when(k % 4 == 0, 2).otherwise(1).alias("schema_version"), F.lit("en").alias("source_language"), F.when(k % 5 == 0, "xx").otherwise("de").alias("target_language"), F.when(k % 3 == 0, "now").otherwise("then").alias("fingerprint"))
    return joins.classify_import(given, b.select(F.lit("en").alias("source_language"), F.lit("de").alias("target_language"), F.lit("now").alias("fingerprint")).distinct())


_add(
    "resolved_voices",
    """WITH u AS (SELECT page_id, ['gemini', 'siliconflow', 'edge', 'other'][(page_id % 4 + 1)::INT] AS p, CASE page_id % 5 WHEN 0 THEN 'AnNa' WHEN 1 THEN '' WHEN 2 THEN 'de-DE-XNeural' WHEN 3 THEN 'a/b' ELSE 'q' END AS v FROM pages)
SELECT page_id, CASE WHEN v = 'AnNa' AND p <> 'other' THEN p || '-anna' WHEN v <> '' AND p = 'siliconflow' AND NOT contains(v, '/') THEN 'm:' || v ELSE v END AS voice_id,
CASE WHEN v IN ('', 'AnNa') THEN NULL WHEN p = 'gemini' THEN 'unknown_voice' WHEN p = 'siliconflow' AND v = 'a/b' THEN 'no_voice_id' WHEN p = 'edge' AND v <> 'de-DE-XNeural' THEN 'no_voice_id' END AS problem FROM u""",
    cues=False,
)(lambda s, d: _voices(_table(s, d, "pages")))


def _voices(pages: DataFrame) -> DataFrame:
    k = F.col("page_id") % 5
    provider = F.element_at(F.array(*map(F.lit, ("gemini", "siliconflow", "edge", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    u = pages.select("page_id", provider.alias("provider"), F.lit("m").alias("model"), F.when(k == 0, "AnNa").when(k == 1, "").when(k == 2, "de-DE-XNeural").when(k == 3, "a/b").otherwise("q").alias("voice"))
    known = u.where("provider <> 'other'").select("provider", F.lit("ANNA").alias("alias"), F.concat("provider", F.lit("-anna")).alias("voice_id")).distinct()
    return joins.resolve_voices(u, known).select("page_id", "voice_id", "problem")


_TERMS = ", tw AS (SELECT media_id, cue_idx, regexp_extract_all(lower(text), '[a-z]+') AS w FROM cues), tc AS (SELECT *, media_id || '/' || cue_idx AS candidate_id, (media_id + cue_idx) % 4 AS odd FROM tw WHERE len(w) >= 3)"


def _candidates(c: DataFrame) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    k = c.select("media_id", "cue_idx", w.alias("w"), ((F.col("media_id") + F.col("cue_idx")) % 4).alias("odd")).where(F.size("w") >= 3)
    return k.select("media_id", "cue_idx", _name("media_id", "cue_idx").alias("candidate_id"), "odd", F.get("w", F.lit(0)).alias("term"), F.get("w", F.lit(1)).alias("alias"))


_add("term_decisions", f"{_TERMS} SELECT candidate_id, ['accepted', 'corrected', 'source_fallback', 'not_a_term'][(odd + 1)::INT] AS decision, [w[2], w[3], w[1], NULL][(odd + 1)::INT] AS translation FROM tc")(lambda c: _decided(_candidates(c), c))


def _decided(k: DataFrame, c: DataFrame) -> DataFrame:
    """By the candidate's number: its proposal accepted, corrected, left open (the proposal is blank), or no term at all."""
    third = c.select(_name("media_id", "cue_idx").alias("candidate_id"), F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), F.lit(2)).alias("third"))
    verdict = F.element_at(F.array(*map(F.lit, ("accept", "correct", "accept", "not_a_term"))), (F.col("odd") + 1).cast("int"))
    proposed = k.select("candidate_id", F.when(F.col("odd") == 2, " ").otherwise(F.col("alias")).alias("proposed"))
    reviewed = k.join(third, "candidate_id").select("candidate_id", verdict.alias("verdict"), F.when(F.col("odd") == 1, F.col("third")).alias("corrected"))
    return validate.term_decisions(k, proposed, reviewed)


_add(
    "merged_terms",
    f"""{_TERMS}, e AS (SELECT media_id, w[1] AS term, lpad(media_id::VARCHAR, 12, '0') || lpad(cue_idx::VARCHAR, 9, '0') AS id, cue_idx, w[2] AS alias FROM tc), al AS (SELECT term, alias, min(id) AS since FROM e GROUP BY ALL), la AS (SELECT term, string_agg(alias, ',' ORDER BY since) AS aliases FROM al GROUP BY term)
SELECT min(id) AS candidate_id, term, aliases, count(DISTINCT cue_idx) AS n FROM e JOIN la USING (term) GROUP BY term, aliases""",
)(lambda c: _merged_terms(_candidates(c)))


def _merged_terms(k: DataFrame) -> DataFrame:
    """The first words of all cues as candidates, every other one in capitals; the second words are their aliases."""
    one = k.select(
        F.concat(F.lpad(F.col("media_id").cast("string"), 12, "0"), F.lpad(F.col("cue_idx").cast("string"), 9, "0")).alias("candidate_id"), F.when(F.col("odd") % 2 == 0, F.upper("term")).otherwise(F.col("term")).alias("term"), F.lit("").alias("sense"), F.array("alias").alias("aliases"), F.array("cue_idx").alias("occurrences"),
    )
    return validate.dedup_terms(one).select("candidate_id", F.lower("term").alias("term"), F.concat_ws(",", "aliases").alias("aliases"), F.size("occurrences").cast("long").alias("n"))


# Chains, by recursion in SQL.
_add(
    "inferred_offsets",
    """, l AS (SELECT media_id, cue_idx // 8 AS k, max(end_ms) - min(start_ms) AS len FROM cues GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY k) AS r FROM l),
o AS (SELECT media_id, r, k, len, 0::BIGINT AS off FROM n WHERE r = 1 UNION ALL SELECT n.media_id, n.r, n.k, n.len, greatest(0, o.off + o.len - 10000) FROM o JOIN n ON n.media_id = o.media_id AND n.r = o.r + 1) SELECT media_id, k AS chunk_idx, off AS offset_ms FROM o""",
)(lambda c: windows.infer_offsets(c.groupBy("media_id", F.floor(F.col("cue_idx") / 8).cast("int").alias("chunk_idx")).agg((F.max("end_ms") - F.min("start_ms")).alias("length_ms"))).select("media_id", "chunk_idx", "offset_ms"))
_add(
    "packed_summaries",
    """, l AS (SELECT media_id, cue_idx, row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) AS r, count(*) OVER (PARTITION BY media_id) AS c, greatest(1, ceil(len(regexp_extract_all(text, '[\\x00-\\x7F]')) / 3) + length(text) - len(regexp_extract_all(text, '[\\x00-\\x7F]'))) AS t FROM cues),
o AS (SELECT media_id, r, cue_idx, c, t AS used, 0 AS pack FROM l WHERE r = 1 UNION ALL SELECT l.media_id, l.r, l.cue_idx, l.c, CASE WHEN used + t > 60 THEN t ELSE used + t END, CASE WHEN used + t > 60 THEN pack + 1 ELSE pack END FROM o JOIN l ON l.media_id = o.media_id AND l.r = o.r + 1)
SELECT media_id, cue_idx AS pos, (CASE WHEN max(pack) OVER (PARTITION BY media_id) = c - 1 THEN (r - 1) // 2 ELSE pack END)::INT AS pack FROM o""",
)(lambda c: edit.pack_summaries(c.select("media_id", F.col("cue_idx").alias("pos"), "text"), 60))
_add("picked_tracks", """SELECT media_id, cue_idx, CASE WHEN length(trim(translated_text)) > 0 THEN trim(translated_text, chr(32) || chr(9)) ELSE trim(text, chr(32) || chr(9)) END AS target, CASE WHEN cue_idx % 4 = 0 THEN trim(translated_text, chr(32) || chr(9)) ELSE trim(text, chr(32) || chr(9)) END AS source FROM cues""")(
    lambda c: c.select("media_id", "cue_idx", T.pick_track(F.col("text"), F.col("translated_text"), "target").alias("target"), T.pick_track(F.when(F.col("cue_idx") % 4 != 0, F.col("text")), F.col("translated_text"), "source").alias("source"))
)
_add("stage_files", """SELECT page_id, 'a/b.c/【字幕】' || regexp_extract(url, '([^/.]+)', 1) || '.srt' AS path FROM pages WHERE url IS NOT NULL""", cues=False)(
    lambda s, d: _table(s, d, "pages").where("url is not null").select("page_id", writers.stage_path(F.concat(F.lit("a/b.c/"), F.when(F.col("page_id") % 2 == 0, "【转录字幕】【样式字幕】").otherwise(""), F.regexp_extract("url", "([^/.]+)", 1), F.lit(".ass")), "字幕").alias("path"))
)
