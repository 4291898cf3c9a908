"""Text measures and clock forms as Column functions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import SpeedPolicy

#: Scripts written without spaces.
NO_SPACE = r"[一-鿿぀-ゟ゠-ヿ가-힯฀-໿က-႟ក-៿ऀ-෿]"
#: A wider stretch, of one or two ranges, that holds all of these: a text without any of it is looked at once.
_NO_SPACE_AREA = "[\u0900-\u17ff\u3040-\ud7af]"
#: White space, as ``(?U)\\s`` has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: One word of a script written with spaces.
SPACED_WORD = r"^[a-zA-Z0-9'Ѐ-ӿͰ-Ͽ؀-ۿ֐-׿฀-๿]+$"
#: Sentence-final marks of full weight, and scripts read by the character.
STRONG = r"[!?！？…‼⁉]"
CHARACTER_SCRIPT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: Negation markers, English and Chinese.
NEGATION = r"(?i)(?=[nwcdia][oeiasr])(?<![\p{L}\p{N}_])(?:not|no|never|without|cannot|can't|won't|don't|doesn't|didn't|isn't|aren't|wasn't|weren't)(?![\p{L}\p{N}_])|(?=[并不没从无未别莫])(?:并非|不是|不能|不会|没有|从未|不再|无需|未曾|别|莫|无|不)"
#: Pieces of a line that a fix must keep, in the order in which they are listed.
PROTECTED_URL = r"(?i)(?:https?://|www\.)[^\s<>()]+"
PROTECTED_REST = (
    r"\{[^{}\n]+\}|\$\{[^{}\n]+\}|%\([^)]+\)[a-zA-Z]",
    r"</?[A-Za-z][^>\n]*>|\\[Nnh]",
    r"`[^`\n]+`",
    r"(?<![\dA-Za-z_.])[+-]?(?:\d{1,3}(?:,\d{3})+|\d+(?:_\d+)*)(?:\.\d+(?:_\d+)*)?[%％‰]?(?![\dA-Za-z_])",
)
#: Code points that are a grapheme each, whatever stands beside them: the short way to count.
_PLAIN = r"^[\x20-\x7E¡-¬®-˿ぁ-ゖァ-ヿ、-〠一-鿿！-｠‐-‧]*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze(text: Column | str) -> Column:
    """A text without any white space."""
    return F.regexp_replace(_c(text), r"(?U)\s+", "")


def strip(text: Column | str) -> Column:
    """A text without white space at its ends, of any kind (``trim`` takes spaces only)."""
    return F.btrim(_c(text), F.lit(WHITE))


def count_of(text: Column, kind: str) -> Column:
    """How many characters of a text are of a class: it is shorter by so many without them, and no list of them is made."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def mainly_cjk(text: Column | str, threshold: float = 0.5) -> Column:
    """More than ``threshold`` of the visible characters belong to scripts without spaces; false for blank and null texts."""
    share = once(F.length(squeeze(text)), lambda n: (n > 0) & (count_of(_c(text), NO_SPACE) / F.when(n > 0, n) > threshold))
    return F.coalesce(F.when(_c(text).rlike(_NO_SPACE_AREA), share), F.lit(False))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda x: x != "")


def count_words(text: Column | str) -> Column:
    """Characters of scripts without spaces plus words of the rest; 0 for null."""
    t = F.coalesce(_c(text), F.lit(""))
    return count_of(t, NO_SPACE) + F.size(tokens(F.regexp_replace(t, NO_SPACE, " ")))


def spaced_script(text: Column | str) -> Column:
    return F.coalesce(strip(text).rlike(SPACED_WORD), F.lit(False))


def only_punctuation(text: Column | str) -> Column:
    return ~_c(text).rlike(r"(?U)\w")


def match_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), r"(?U)[\W_]+", "")


def collapse_transcript(text: Column | str) -> Column:
    """One space between words, and one after a sentence end that runs into a capital."""
    flat = strip(F.regexp_replace(_c(text), r"(?U)\s+", " "))
    return F.regexp_replace(flat, r"([.!?])(?=[A-Z])", "$1 ")


def strip_markup(text: Column | str) -> Column:
    """A transcript without the tags that gateways leave in it, its white space collapsed."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?i)<\s*/?\s*(?:chinese|english|transcript|text|think|thinking)\s*>", " ")
    return collapse_transcript(F.regexp_replace(bare, r"(?i)\b(?:think|thinking)\s*>\s*", " "))


#: Language names and their short codes, and codes that stand for another.
LANGUAGE_ALIASES = {"chinese": "zh", "cantonese": "yue", "english": "en", "japanese": "ja", "korean": "ko", "french": "fr", "german": "de", "spanish": "es", "russian": "ru", "portuguese": "pt", "italian": "it"}


def language_code(name: Column | str) -> Column:
    """The main part of a language code in lower case; English names count as their codes. Null becomes empty."""
    plain = F.replace(F.lower(strip(F.coalesce(_c(name), F.lit("")))), F.lit("_"), F.lit("-"))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    return F.substring_index(F.coalesce(F.get(F.array(F.try_element_at(known, plain)), F.lit(0)), plain), "-", 1)


def speech_language(name: Column | str) -> Column:
    """What a Chinese and English recogniser is told: zh, en or auto."""
    code = language_code(name)
    return F.when(code.isin("zh", "yue", "cmn"), "zh").when(code == "en", "en").otherwise("auto")


def content_key(*parts: Column | str) -> Column:
    """A key of all that changes a result: nulls and parts of other order or borders give other keys."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(_c(p).cast("string"), F.lit("\x00")) for p in parts])), 256)


def graphemes(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"\X"), F.lit(0))


def grapheme_kind(g: Column) -> Column:
    """whitespace, weak_punctuation, strong_punctuation, cjk or non_cjk."""
    bare = F.regexp_replace(g, r"\p{M}", "")
    return (
        F.when((g == "") | g.rlike(r"(?U)^\s+$"), "whitespace")
        .when(bare.rlike(r"^\p{P}+$"), F.when(g.rlike(STRONG), "strong_punctuation").otherwise("weak_punctuation"))
        .when(g.rlike(CHARACTER_SCRIPT), "cjk")
        .otherwise("non_cjk")
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it: inside a lambda it is a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reading_units(text: Column | str, policy: SpeedPolicy) -> Column:
    """``struct(cjk, non_cjk, graphemes)``: weighted units; marks and spaces count on the non-CJK side."""
    t = F.coalesce(_c(text), F.lit(""))
    # Marks, and letters from the first script read by the character on, are taken out first: what is asked of them is dear.
    marks, wide = F.regexp_replace(t, r"\P{P}+", ""), F.regexp_replace(t, r"[\x{0}-\x{10FF}]+", "")
    counts = F.struct(F.length(t).alias("n"), count_of(t, r"(?U)\s").alias("space"), once(marks, lambda m: F.struct(F.length(m).alias("all"), count_of(m, STRONG).alias("strong"))).alias("marks"), count_of(wide, CHARACTER_SCRIPT).alias("cjk"))

    def of_counts(c: Column) -> Column:
        marks, strong = c["marks"]["all"], c["marks"]["strong"]
        rest = (c["n"] - c["space"] - marks - c["cjk"]).cast("double") + (marks - strong) * policy.marks.weak + strong * policy.marks.strong + c["space"] * policy.marks.space
        return F.struct(c["cjk"].cast("double").alias("cjk"), rest.alias("non_cjk"), c["n"].alias("graphemes"))

    plain = once(counts, of_counts)
    weight = {"whitespace": policy.marks.space, "weak_punctuation": policy.marks.weak, "strong_punctuation": policy.marks.strong, "non_cjk": 1.0}

    def add(s: Column, kind: Column) -> Column:
        side = F.lit(0.0)
        for k, v in weight.items():
            side = F.when(kind == k, F.lit(v)).otherwise(side)
        return F.struct((s["cjk"] + F.when(kind == "cjk", 1.0).otherwise(0.0)).alias("cjk"), (s["non_cjk"] + side).alias("non_cjk"), (s["graphemes"] + 1).alias("graphemes"))

    kinds = F.transform(graphemes(t), grapheme_kind)
    whole = F.aggregate(kinds, F.struct(F.lit(0.0).alias("cjk"), F.lit(0.0).alias("non_cjk"), F.lit(0).alias("graphemes")), add)
    return F.when(t.rlike(_PLAIN), plain).otherwise(whole)


def reading_load(text: Column | str, duration_ms: Column, policy: SpeedPolicy) -> Column:
    """``struct(units, graphemes, comfort_s, hard_s, comfort_load, hard_load)``; loads are null where the duration isn't above zero."""
    seconds = F.when(duration_ms > 0, duration_ms / 1000)

    def loads(u: Column) -> Column:
        comfort = u["cjk"] / policy.comfort.cjk + u["non_cjk"] / policy.comfort.latin
        hard = u["cjk"] / policy.hard.cjk + u["non_cjk"] / policy.hard.latin
        return F.struct(
            (u["cjk"] + u["non_cjk"]).alias("units"), u["graphemes"].alias("graphemes"), comfort.alias("comfort_s"), hard.alias("hard_s"), (comfort / seconds).alias("comfort_load"), (hard / seconds).alias("hard_load")
        )

    return once(reading_units(text, policy), loads)


def visible_units(text: Column | str, policy: SpeedPolicy) -> Column:
    return once(reading_units(text, policy), lambda u: u["cjk"] + u["non_cjk"])


def line_measure(text: Column) -> Column:
    """``struct(is_cjk, chars, stripped)`` of a text: whether it is ``mainly_cjk``, its ``audit_chars``, its length without white space at the ends."""
    return once(
        F.struct(mainly_cjk(text).alias("is_cjk"), F.length(strip(text)).alias("stripped")),
        lambda m: F.struct(m["is_cjk"].alias("is_cjk"), F.when(m["is_cjk"], F.length(squeeze(text))).otherwise(m["stripped"]).alias("chars"), m["stripped"].alias("stripped")),
    )


def audit_chars(text: Column | str, cjk: Column) -> Column:
    return F.when(cjk, F.length(squeeze(text))).otherwise(F.length(strip(text)))


def trim_weak_tail(text: Column | str) -> Column:
    """A text without the comma or full stop (full width) at its end."""
    t = _c(text)
    return F.when(F.contains(t, F.lit("，")) | F.contains(t, F.lit("。")), F.regexp_replace(t, "[，。]+$", "")).otherwise(t)


def trim_weak_line(text: Column | str) -> Column:
    """Each line without weak marks before its end or before closing quotes there; strong marks stop the trim."""
    return F.array_join(F.transform(F.split(_c(text), "\n"), lambda x: F.regexp_replace(x, "[，。、；：,;:]+([」』”’）)】》]*)(?U)\\s*$", "$1")), "\n")


def estimate_tokens(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return once(count_of(t, r"[^\x00-\x7F]"), lambda other: F.greatest(F.lit(1), F.ceil((F.length(t) - other) / 3) + other).cast("int"))


def contains_term(text: Column, term: Column) -> Column:
    """A term occurs: between non-alphanumerics where its ends are ASCII letters or digits, else anywhere; case is ignored."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.lower(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    edge = r"[a-z0-9]"
    pattern = F.concat(F.when(F.lower(term).rlike(f"^{edge}"), F.lit(r"(?<![A-Za-z0-9])")).otherwise(""), quoted, F.when(F.lower(term).rlike(f"{edge}$"), F.lit(r"(?![A-Za-z0-9])")).otherwise(""))
    return F.contains(F.lower(text), F.lower(term)) & F.regexp_like(F.lower(text), pattern)


def protected_tokens(text: Column | str) -> Column:
    """URLs without closing punctuation, placeholders, tags, code and numbers; distinct, in that order."""
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(PROTECTED_URL), F.lit(0)), lambda x: F.regexp_replace(x, "[.,;:!?，。；：！？]+$", ""))
    rest = [F.regexp_extract_all(_c(text), F.lit(p), F.lit(0)) for p in PROTECTED_REST]
    return F.array_distinct(F.filter(F.concat(found, *rest), lambda x: x != ""))


def number_key(token: Column) -> Column:
    """Numbers that differ by grouping, trailing zeros or the width of the percent sign get one key; other tokens are their own."""
    percent = token.rlike("[%％]$")
    digits = F.regexp_replace(token, "[,%％]", "")
    value = digits.try_cast("decimal(38,10)")
    return F.when(token.rlike(r"^[0-9]") & value.isNotNull(), F.concat(F.regexp_replace(value.cast("string"), r"\.?0+$", ""), F.when(percent, "%").otherwise(""))).otherwise(token)


def negations(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit(NEGATION), F.lit(0)), lambda x: F.lower(x))


def speaker_of(text: Column | str, default: str = "default") -> Column:
    """``struct(speaker, line)``: a label in brackets or before a colon, else the default."""
    t = strip(text)
    bracket, colon = r"^[\[(【（]\s*([^\])】）]{1,40})\s*[\])】）]\s*(.+)$", r"^([^:：\s][^:：]{0,30})[:：]\s*(.+)$"
    who = F.when(F.regexp_extract(t, bracket, 1) != "", F.regexp_extract(t, bracket, 1)).when(F.regexp_extract(t, colon, 1) != "", F.regexp_extract(t, colon, 1)).otherwise(F.lit(default))
    line = F.when(F.regexp_extract(t, bracket, 2) != "", F.regexp_extract(t, bracket, 2)).when(F.regexp_extract(t, colon, 2) != "", F.regexp_extract(t, colon, 2)).otherwise(t)
    return F.struct(F.trim(who).alias("speaker"), F.trim(line).alias("line"))


def pick_track(source: Column, target: Column, track: str) -> Column:
    """The chosen side of a cue, or the other where it is blank."""
    first, second = (source, target) if track == "source" else (target, source)
    return F.coalesce(F.nullif(strip(first), F.lit("")), F.nullif(strip(second), F.lit("")), F.lit(""))


def boundary_word(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"(?U)^\W+|\W+$", ""))


def alignment_text(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"(?U)[\W_]+", ""))


def smart_join(left: Column, right: Column) -> Column:
    """Two pieces, with a space between if a letter or digit of a spaced script ends one (closing marks aside) and another begins the next."""
    a, b = F.regexp_replace(left, r"(?U)\s+$", ""), F.regexp_replace(right, r"(?U)^\s+", "")
    last = F.regexp_extract(F.regexp_replace(a, r"[\p{P}\s]+$", ""), r"(\X)$", 1)
    first = F.regexp_extract(b, r"^(\X)", 1)
    spaced = last.rlike(r"^[\p{L}\p{N}]") & ~last.rlike(CHARACTER_SCRIPT) & first.rlike(r"^[\p{L}\p{N}]") & ~first.rlike(CHARACTER_SCRIPT)
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.when(spaced, " ").otherwise(""), b))


def md_escape(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.greatest(F.lit(0).cast("long"), ms)
    s = F.floor(ms / 1000)
    return F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000


def srt_time(ms: Column) -> Column:
    h, m, s, f = _parts(ms)
    return F.concat(F.when(h < 10, _two(h)).otherwise(h.cast("string")), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(","), F.lpad(f.cast("string"), 3, "0"))


def vtt_time(ms: Column) -> Column:
    return F.replace(srt_time(ms), F.lit(","), F.lit("."))


def ass_time(ms: Column) -> Column:
    h, m, s, f = _parts(ms)
    return F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit("."), _two(F.floor(f / 10)))


def lrc_time(ms: Column) -> Column:
    """Minutes, seconds (not padded) and hundredths."""
    ms = F.greatest(F.lit(0).cast("long"), ms)
    return F.concat(_two(F.floor(ms / 60_000)), F.lit(":"), F.format_string("%.2f", (ms % 60_000) / 1000))


def clock_ms(text: Column | str) -> Column:
    """Milliseconds of ``[H:]MM:SS[.,]fff``; fractions of one to three digits are tenths, hundredths or thousandths. Null for other texts."""
    form = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?\s*$"
    t = _c(text)
    g = [F.regexp_extract(t, form, i) for i in range(1, 5)]
    whole = (F.coalesce(F.nullif(g[0], F.lit("")).cast("long"), F.lit(0)) * 3600 + g[1].try_cast("long") * 60 + g[2].try_cast("long")) * 1000
    return F.when(t.rlike(form), whole + F.rpad(F.coalesce(g[3], F.lit("")), 3, "0").try_cast("long"))


#: Letters and whole words that hint at a language, in the order in which they are tried.
LATIN_HINTS = (
    ("Portuguese", "[ãõ]|ção", ("não", "uma")),
    ("Spanish", "[ñ¿¡]", ("qué", "está", "usted")),
    ("French", "[çœàâêîôûùè]", ("bonjour", "avec", "les", "des")),
    ("German", "[äöüß]", ("und", "der", "die", "das", "nicht")),
    ("Italian", None, ("ciao", "gli", "delle", "perché", "non")),
)
SCRIPT_HINTS = (("Japanese", "[\u3040-\u30ff]"), ("Korean", "[\uac00-\ud7af]"), ("Chinese", "[\u4e00-\u9fff]"), ("Russian", "[\u0400-\u04ff]"))


def latin_pattern(letters: str | None, words: tuple[str, ...]) -> str:
    whole = "|".join(rf"(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)" for w in words)
    return f"{letters}|{whole}" if letters else whole


def guess_language(text: Column | str) -> Column:
    """A language hint from scripts first, then letters and words in a fixed order; a hint, not a classifier."""
    t = F.coalesce(_c(text), F.lit(""))
    out = F.when(strip(t) == "", F.lit(None).cast("string"))
    for lang, script in SCRIPT_HINTS:
        out = out.when(t.rlike(script), lang)
    for lang, letters, words in LATIN_HINTS:
        out = out.when(F.lower(t).rlike(latin_pattern(letters, words)), lang)
    return F.coalesce(out, F.when(mainly_cjk(t), "Chinese").otherwise("English"))
