"""Language codes that translation services are told, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Target languages and the code that most services know them by.
CODES = {
    "simplified_chinese": "zh-CN", "traditional_chinese": "zh-TW", "english": "en", "english_us": "en", "english_uk": "en", "japanese": "ja", "korean": "ko", "cantonese": "yue", "thai": "th", "vietnamese": "vi",
    "indonesian": "id", "malay": "ms", "tagalog": "tl", "french": "fr", "german": "de", "spanish": "es", "spanish_latam": "es", "russian": "ru", "portuguese": "pt", "portuguese_br": "pt", "portuguese_pt": "pt", "italian": "it",
    "dutch": "nl", "polish": "pl", "turkish": "tr", "greek": "el", "czech": "cs", "swedish": "sv", "danish": "da", "finnish": "fi", "norwegian": "no", "hungarian": "hu", "romanian": "ro", "bulgarian": "bg", "ukrainian": "uk",
    "arabic": "ar", "hebrew": "he", "persian": "fa",
}
#: Where a service uses other codes, and languages that it doesn't know.
_SCRIPTS = {"simplified_chinese": "zh-Hans", "traditional_chinese": "zh-Hant", "portuguese_pt": "pt-PT", "norwegian": "nb"}
OWN_CODES = {"google": {}, "bing": _SCRIPTS | {"tagalog": "fil"}, "deeplx": _SCRIPTS | {"english_us": "en-US", "english_uk": "en-GB", "portuguese_br": "pt-BR"}}
UNKNOWN = {"deeplx": ("cantonese", "thai", "vietnamese", "malay", "tagalog", "spanish_latam", "hebrew", "persian")}
DEFAULT = "simplified_chinese"


def service_codes(service: str) -> dict[str, str]:
    """Codes of the languages that a service knows; none of a service that isn't known."""
    return {k: v for k, v in (CODES | OWN_CODES[service]).items() if k not in UNKNOWN.get(service, ())} if service in OWN_CODES else {}


def target_code(language: Column | str, service: Column | str) -> Column:
    """The code of a target language with a service.

    Names count in any case, with spaces or hyphens for the underscore. A language that the service doesn't know, blank and
    null ones included, gives the service's simplified Chinese, and so does a service that isn't known (``zh-CN``).
    """
    of = lambda c: F.lower(strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    name, out = F.regexp_replace(of(language), "[ -]", "_"), F.lit(CODES[DEFAULT])
    for s in OWN_CODES:
        codes = service_codes(s)
        known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
        out = F.when(of(service) == s, F.coalesce(F.try_element_at(known, name), F.lit(codes[DEFAULT]))).otherwise(out)
    return out
