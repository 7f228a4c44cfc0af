"""Column expressions on text; null counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, numbers, underscore, apostrophes and hyphen.
WORDS = r"[\p{L}\p{N}_'’\-]+"
#: Marks that a word may have around it.
PUNCTUATION = "\"'“”‘’()[]{}.,!?;:।॥…—–-"

# Function words by language, and the bounds of scripts.
FINGERPRINTS = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "for", "with"],
    "es": ["el", "la", "de", "que", "los", "en", "y", "las", "por", "una"],
    "fr": ["le", "les", "des", "et", "est", "dans", "une", "pour", "pas", "qui"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "den", "mit", "zu"],
}
SCRIPTS = {"latin": r"\p{Latin}", "devanagari": r"\p{Devanagari}", "cyrillic": r"\p{Cyrillic}", "arabic": r"\p{Arabic}", "han": r"\p{Han}"}


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(filled(c)), F.lit(WORDS), F.lit(0))


def sentences(c: Column) -> Column:
    """Pieces after a final mark and white space, without those that have no word."""
    cut = F.split(F.regexp_replace(filled(c), r"([.!?…।॥])\s+", "$1\u0001"), "\u0001", -1)
    return F.filter(cut, lambda x: x.rlike(r"[\p{L}\p{N}_'’\-]"))


def normalize_word(c: Column) -> Column:
    return F.trim(F.lower(c), F.lit(PUNCTUATION))


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def ellipsize(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space before the mark."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), r"\s\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def slug(c: Column, fallback: str = "untitled") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", fallback).otherwise(s)


def clock(cs: Column) -> Column:
    """HH:MM:SS,mmm of hundredths of a second."""
    h, m, s = F.floor(cs / 360_000), F.floor(cs / 6_000) % 60, F.floor(cs / 100) % 60
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, cs % 100 * 10)


def clock_to_ms(c: Column) -> Column:
    """Milliseconds of [h:]m:ss[,.]mmm; 0 where it is no clock."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{2})(?:[,.](\d{1,3}))?$"
    part = lambda i: F.regexp_extract(F.trim(c), pattern, i)
    number = lambda x: F.when(x == "", 0).otherwise(x.cast("long"))
    milli = F.when(part(4) == "", 0).otherwise(F.rpad(part(4), 3, "0").cast("long"))
    return F.coalesce(((number(part(1)) * 60 + number(part(2))) * 60 + number(part(3))) * 1000 + milli, F.lit(0))


def clean_markup(c: Column) -> Column:
    """Without tags, byte-order marks and the common entities, white space collapsed."""
    s = F.regexp_replace(filled(c), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.replace(s, F.lit("\ufeff"), F.lit("")), r"[ \t\n\r\f]+", " "))


def url_kind(c: Column) -> Column:
    """video (known hosts), direct (a media suffix), web, or invalid."""
    host = F.lower(F.regexp_extract(c, r"^https?://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1))
    return (
        F.when(host == "", "invalid")
        .when(host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "video")
        .when(path.rlike(r"\.(mp4|mkv|mov|webm|mp3|wav|m4a)$"), "direct")
        .otherwise("web")
    )


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.floor(n / 1024**2).cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.floor(n / 1024**3).cast("string"), F.lit(" GB")))
    )


def caption_colour(c: Column) -> Column:
    """&H00BBGGRR of #RRGGBB or #RGB; white where it is neither."""
    digits = F.ltrim(filled(c), F.lit("#"))
    digits = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    digits = F.when(digits.rlike("^[0-9a-fA-F]{6}$"), F.upper(digits)).otherwise("FFFFFF")
    return F.concat(F.lit("&H00"), *[F.substring(digits, at, 2) for at in (5, 3, 1)])


def hits(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(lexicon))).cast("long")


def per_myriad(x: Column) -> Column:
    """A ratio as an exact whole number of ten-thousandths."""
    return F.floor(x * 10_000 + 0.5).cast("long")
