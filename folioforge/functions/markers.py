"""Line markers of plain text, list numbers and Markdown pieces, as column expressions.

All run row by row inside the JVM; none needs a Python worker or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"(?s)^\s*(#{1,6}) (.*)$"
BULLET = r"(?s)^( *)- (.*)$"
NUMBER = r"(?s)^( *)([0-9]+)\. (.*)$"
MAX_U32 = 4294967295


def normal_lines(text: Column) -> Column:
    """Lines of a text after all line ends became ``\\n``; a last empty line stays."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)


def _number(line: Column) -> Column:
    """The number of a numbered item if it fits 32 bits, else null."""
    n = F.regexp_extract(line, NUMBER, 2).try_cast("decimal(38,0)")
    return F.when(n <= MAX_U32, n.cast("long"))


def line_kind(line: Column) -> Column:
    """break, heading, bullet, number or text."""
    return (
        F.when(line == "---", "break")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(BULLET), "bullet")
        .when(_number(line).isNotNull(), "number")
        .otherwise("text")
    )


def line_level(line: Column) -> Column:
    """Heading level, or nesting level of an item (two spaces each, modulo 256)."""
    kind = line_kind(line)
    indent = lambda p: F.length(F.regexp_extract(line, p, 1))
    return (
        F.when(kind == "heading", indent(HEADING))
        .when(kind == "bullet", (F.floor(indent(BULLET) / 2) % 256))
        .when(kind == "number", (F.floor(indent(NUMBER) / 2) % 256))
        .cast("long")
    )


def line_start(line: Column) -> Column:
    kind = line_kind(line)
    return F.when(kind == "bullet", 1).when(kind == "number", _number(line)).cast("long")


def line_content(line: Column) -> Column:
    """What is left without the marker."""
    kind = line_kind(line)
    return (
        F.when(kind == "break", "")
        .when(kind == "heading", F.regexp_extract(line, HEADING, 2))
        .when(kind == "bullet", F.regexp_extract(line, BULLET, 2))
        .when(kind == "number", F.regexp_extract(line, NUMBER, 3))
        .otherwise(line)
    )


def plain_text(text: Column) -> Column:
    """Text of a plain-text document without markers: blank paragraphs vanish, and the last one leaves a
    single line end."""
    contents = F.transform(normal_lines(text), line_content)
    full = F.filter(contents, lambda x: x != "")
    ends = F.when((F.size(full) > 0) & (F.element_at(contents, -1) == ""), "\n").otherwise("")
    return F.concat(F.array_join(full, "\n"), ends)


_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def roman(n: Column, upper: bool = False) -> Column:
    """Subtractive roman numerals; 0 is empty."""
    left, out = n.cast("long"), F.lit("")
    for value, sign in _ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.upper(out) if upper else out


def alpha(n: Column, upper: bool = False) -> Column:
    """a to z, again from a after 26."""
    return F.chr(F.pmod(n - 1, F.lit(26)) + (65 if upper else 97))


def item_label(fmt: Column, n: Column) -> Column:
    return (
        F.when(fmt == "decimal", n.cast("string"))
        .when(fmt == "lower_alpha", alpha(n))
        .when(fmt == "upper_alpha", alpha(n, True))
        .when(fmt == "lower_roman", roman(n))
        .when(fmt == "upper_roman", roman(n, True))
        .otherwise("-")
    )


def inline_code(text: Column) -> Column:
    """A Markdown code span: a fence longer than any run of backticks, padded at backtick edges."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")), " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def emphasised(text: Column, bold: Column, italic: Column, strike: Column) -> Column:
    """Emphasis marks stand inside strike marks."""
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    line = F.when(strike, "~~").otherwise("")
    return F.concat(line, mark, text, mark, line)


def table_cell(text: Column) -> Column:
    """Text of a Markdown table cell: trimmed, bars escaped, line ends as spaces."""
    one = F.regexp_replace(F.trim(text), "[\r\n]", " ")
    return F.replace(one, F.lit("|"), F.lit("\\|"))


def alignment_mark(alignment: Column) -> Column:
    return F.when(alignment == "left", ":---|").when(alignment == "center", ":---:|").when(alignment == "right", "---:|").otherwise("---|")


def language_style(lang: Column) -> Column:
    """Style name part of a code language: letters and digits, ``+`` as p, first letter in upper case."""
    plain = F.regexp_replace(F.replace(lang, F.lit("+"), F.lit("p")), "[^A-Za-z0-9]", "")
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))
