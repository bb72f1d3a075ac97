"""What kind of document some bytes or a text are, and facts about formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions with the format each names.
EXTENSIONS = {
    "docx": "docx", "odt": "odt", "pdf": "pdf", "txt": "txt", "text": "txt", "doc": "doc", "md": "md", "markdown": "md",
    "md-raw": "md-raw", "mdraw": "md-raw", "raw-md": "md-raw", "csv": "csv", "xlsx": "xlsx", "pptx": "pptx", "ods": "ods", "odp": "odp",
}
#: Media types of formats.
MEDIA_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "odt": "application/vnd.oasis.opendocument.text",
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
}
DELIMITERS = (",", "\t", ";", "|")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_of_bytes(content: Column) -> Column:
    """By signature: an old compound file, a ZIP package by the names of its entries, PDF, else text. Only in a
    package without a directory, one cut off, are the folders looked for anywhere: a few bytes of packed data may spell them too."""
    head = F.hex(F.substring(content, 1, 8))
    names = F.decode(content, "ISO-8859-1")
    has = lambda s: F.contains(names, F.lit(s))
    entry = lambda s: F.rlike(names, F.lit(rf"(?s)PK\x03\x04.{{26}}{s}"))
    broken = ~has("PK\x01\x02")
    package = (
        F.when(entry("word/"), "docx").when(entry("xl/"), "xlsx").when(entry("ppt/"), "pptx")
        .when(has("opendocument.text"), "odt").when(has("opendocument.spreadsheet"), "ods").when(has("opendocument.presentation"), "odp")
        .when(broken & has("word/"), "docx").when(broken & has("xl/"), "xlsx").when(broken & has("ppt/"), "pptx")
        .when(has("content.xml"), "odt").otherwise("docx")
    )
    return (
        F.when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "doc")
        .when(F.startswith(head, F.lit("504B0304")), package)
        .when(F.startswith(head, F.lit("25504446")), "pdf")
        .otherwise("txt")
    )


def format_of_path(path: Column) -> Column:
    """By extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(literal_map(EXTENSIONS), ext)


def markdown_score(text: Column) -> Column:
    """Points for Markdown signs in the first 30 lines."""
    lines = F.transform(F.slice(F.split(F.substring_index(text, "\n", 30), "\n", -1), 1, 30), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))

    def points(x: Column) -> Column:
        one = lambda c, n: F.when(c, n).otherwise(0)
        return (
            one(F.startswith(x, F.lit("#")), 2)
            + one(F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("* ")) | F.startswith(x, F.lit("1. ")), 1)
            + one(F.contains(x, F.lit("](")), 2)
            + one(F.startswith(x, F.lit("```")), 2)
            + one(F.contains(x, F.lit("**")) | F.contains(x, F.lit("__")), 1)
        )

    return F.aggregate(lines, F.lit(0), lambda a, x: a + points(x)).cast("long")


def is_comma_table(text: Column) -> Column:
    """At least two of the first ten lines, a comma in the first, and as many in 70 % of them."""
    lines = F.slice(F.split(F.substring_index(F.regexp_replace(text, r"\r?\n\z", ""), "\n", 11), r"\r?\n", -1), 1, 10)
    counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    even = lambda n: (F.size(n) >= 2) & (n[0] >= 1) & (F.floor(F.size(F.filter(n, lambda x: x == n[0])) * 100 / F.size(n)) >= 70)
    return F.get(F.transform(F.array(counts), even), 0)  # an array of one binds the counts, so they are made once


def kind_of_text(text: Column) -> Column:
    return F.when(text == "", "txt").when(is_comma_table(text), "csv").when(markdown_score(text) >= 3, "md").otherwise("txt")


def delimiter(text: Column) -> Column:
    """Of comma, tab, semicolon and bar the one that occurs most evenly and often in the lines with
    content among the first ten; ties keep the earlier."""
    lines = F.filter(F.slice(F.split(text, r"\r?\n", -1), 1, 10), lambda x: F.trim(x) != "")
    n = F.size(lines)

    def score(d: str) -> Column:
        counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        first = F.element_at(counts, 1)
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        same = F.size(F.filter(counts, lambda x: x == first))
        return F.when(n == 0, 0.0).when(n < 2, total.cast("double")).when(first == 0, 0.0).otherwise((same / n) * (total / n))

    best = F.greatest(*[score(d) for d in DELIMITERS])
    out = F.lit(",")
    for d in reversed(DELIMITERS):
        out = F.when((score(d) == best) & (best > 0), d).otherwise(out)
    return out


def _pairs_up(content: Column, unit: str) -> Column:
    """Whether UTF-16 bytes are whole units without a lone surrogate; ``unit`` says where the high byte stands."""
    high = lambda x: f"{x}.." if unit == "be" else f"..{x}"
    whole = f"\\G(?:{high('D[89AB]')}{high('D[CDEF]')}|{high('(?!D[89A-F])..')})"
    return F.regexp_replace(F.hex(content), whole, "") == ""


def decode_text(content: Column) -> Column:
    """A struct of text and encoding: by byte order mark, else UTF-8 if valid, else Latin-1. Bytes that are
    malformed after a byte order mark give a null text."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda k: F.substring(content, k, 1 << 30)
    pair = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
    sound = lambda ok, k, code: F.when(ok, F.decode(rest(k), code))
    return (
        F.when(head == "EFBBBF", pair(F.when(F.is_valid_utf8(rest(4).cast("string")), rest(4).cast("string")), "utf-8-bom"))
        .when(F.startswith(head, F.lit("FFFE")), pair(sound(_pairs_up(rest(3), "le"), 3, "UTF-16LE"), "utf-16le"))
        .when(F.startswith(head, F.lit("FEFF")), pair(sound(_pairs_up(rest(3), "be"), 3, "UTF-16BE"), "utf-16be"))
        .when(F.is_valid_utf8(content.cast("string")), pair(content.cast("string"), "utf-8"))
        .otherwise(pair(F.decode(content, "ISO-8859-1"), "latin-1"))
    )


#: What windows-1252 puts on the bytes 80 to 9F; five of them have no character and stay.
WINDOWS_1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
    0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


def windows_1252(content: Column) -> Column:
    """Text of windows-1252 bytes."""
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, WINDOWS_1252)), "".join(map(chr, WINDOWS_1252.values())))


#: File types with their media type, label and kind; whether this engine reads them.
FILE_TYPES = (
    ("docx", MEDIA_TYPES["docx"], "Word Document", "document", True),
    ("xlsx", MEDIA_TYPES["xlsx"], "Excel Spreadsheet", "spreadsheet", False),
    ("pptx", MEDIA_TYPES["pptx"], "PowerPoint Presentation", "presentation", False),
    ("odt", MEDIA_TYPES["odt"], "OpenDocument Text", "document", True),
    ("ods", MEDIA_TYPES["ods"], "OpenDocument Spreadsheet", "spreadsheet", False),
    ("odp", MEDIA_TYPES["odp"], "OpenDocument Presentation", "presentation", False),
    ("pdf", MEDIA_TYPES["pdf"], "PDF Document", "other", True),
    ("doc", MEDIA_TYPES["doc"], "Word Document (Legacy)", "document", True),
    ("txt", MEDIA_TYPES["txt"], "Plain Text", "document", True),
    ("md", MEDIA_TYPES["md"], "Markdown", "document", True),
    ("csv", MEDIA_TYPES["csv"], "CSV Spreadsheet", "spreadsheet", True),
    ("bin", "application/octet-stream", "Unknown", "other", False),
)


def type_fact(file_type: Column, fact: str) -> Column:
    """media_type, label, kind or supported of a file type, null if unknown."""
    at = ("media_type", "label", "kind", "supported").index(fact) + 1
    return F.try_element_at(F.create_map(*[F.lit(x) for r in FILE_TYPES for x in (r[0], r[at])]), file_type)


def is_supported(source: Column, target: Column) -> Column:
    """The conversions between word-processing formats; none from a format to itself."""
    return F.coalesce((source.isin("doc", "docx") & (target == "odt")) | (source.isin("doc", "odt") & (target == "docx")), F.lit(False))


def validate_conversion(source: Column, target: Column) -> Column:
    """Null, or why a conversion is not supported."""
    return F.when(~is_supported(source, target), F.concat(F.lit("unsupported conversion: "), F.coalesce(source, F.lit("?")), F.lit(" to "), F.coalesce(target, F.lit("?"))))


def conversion_warnings(source: Column) -> Column:
    """What a conversion from a format loses, as an array."""
    return F.when(source == "doc", F.array(F.lit("formatting lost: legacy documents give their text alone"))).otherwise(F.array().cast("array<string>"))
