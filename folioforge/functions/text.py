"""Scripts, escapes, CSS values and code languages of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts that runs are told apart by; others count as one, Other.
SCRIPTS = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Thai", "Georgian", "Hangul", "Hiragana",
    "Katakana", "Han",
)
_SHARED = r"\p{IsCommon}\p{IsInherited}"


def script_pattern(prefix: str = "Is") -> str:
    """A run: signs that all scripts share, then letters of one script with the shared signs among them."""
    shared = _SHARED.replace("Is", prefix)
    kinds = [rf"\p{{{prefix}{s}}}[\p{{{prefix}{s}}}{shared}]*" for s in SCRIPTS]
    other = "[^" + "".join(rf"\p{{{prefix}{s}}}" for s in SCRIPTS) + shared + "]"
    return rf"[{shared}]*(?:{'|'.join(kinds)}|(?:{other}[{shared}]*)+)|[{shared}]+"


def script_runs(text: Column) -> Column:
    """An array of (start, end, script), byte offsets: shared signs join the run before them, at the start of a
    text the run after; a text of shared signs alone is one Common run, an empty one has none."""
    found = F.regexp_extract_all(text, F.lit(f"({script_pattern()})"), F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.octet_length(x)
        kind = F.lit("Other")
        for s in reversed(SCRIPTS):
            kind = F.when(x.rlike(rf"\p{{Is{s}}}"), s).otherwise(kind)
        kind = F.when(x.rlike(rf"^[{_SHARED}]+$"), "Common").otherwise(kind)
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.cast("bigint").alias("end"), kind.alias("script")))).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,script:string>>").alias("out"))
    return F.aggregate(found, first, step, lambda a: a["out"])


def json_escape(text: Column) -> Column:
    """Backslashes, quotes, line ends and tabs."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def hex_colour(value: Column) -> Column:
    """(r, g, b) from 0 to 1 of six hexadecimal digits after any number of #, else null."""
    digits = F.regexp_replace(value, "^#+", "")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def css_border(value: Column) -> Column:
    """(width, r, g, b) of a border such as ``1px solid #000000``; what can't be read is half a point, or black."""
    words = F.filter(F.split(value, r"\s+", -1), lambda x: x != "")
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    number = F.regexp_replace(F.regexp_replace(first, "(?:px)+$", ""), "(?:pt)+$", "")
    width = F.when(number.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("double"))
    rgb = hex_colour(last)
    zero = lambda c: F.coalesce(rgb[c], F.lit(0.0))
    return F.struct(F.coalesce(width, F.lit(0.5)).alias("width"), zero("r").alias("r"), zero("g").alias("g"), zero("b").alias("b"))


def code_languages(text: Column) -> Column:
    """Languages that code fences name, each once, sorted. A fence that closes names none."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    named = F.transform(lines, lambda x: F.regexp_extract(x, r"^ {0,3}```+[ ]*([^\s`]+)[^`]*$", 1))
    return F.array_sort(F.array_distinct(F.array_remove(named, "")))
