"""Units, colours, fields and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.formats import literal_map

#: Highlight names of word-processing packages with their colours.
HIGHLIGHTS = {
    "yellow": "FFFF00", "green": "00FF00", "cyan": "00FFFF", "magenta": "FF00FF", "blue": "0000FF", "red": "FF0000", "darkBlue": "00008B",
    "darkCyan": "008B8B", "darkGreen": "006400", "darkMagenta": "8B008B", "darkRed": "8B0000", "darkYellow": "808000", "darkGray": "A9A9A9",
    "lightGray": "D3D3D3", "black": "000000", "white": "FFFFFF",
}
#: Media types of pictures with their extensions.
PICTURES = {
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tif", "image/svg+xml": "svg",
    "image/x-emf": "emf", "image/x-wmf": "wmf",
}
#: The order in which the start of a field instruction decides its type.
FIELDS = (
    ("PAGE", "page_number"), ("NUMPAGES", "page_count"), ("SECTIONPAGES", "page_count"), ("DATE", "date"), ("CREATEDATE", "date"),
    ("SAVEDATE", "date"), ("TIME", "time"), ("FILENAME", "file_name"), ("AUTHOR", "author"), ("TOC", "table_of_contents"),
)


def twips_to_points(v: Column) -> Column:
    return v.try_cast("double") / 20


def half_points_to_points(v: Column) -> Column:
    return v.try_cast("double") / 2


def emu_to_points(v: Column) -> Column:
    return v.try_cast("double") / 12700


def points_to_twips(v: Column) -> Column:
    return F.round(v * 20).cast("long")


def length_to_points(v: Column) -> Column:
    """A length with a unit (in, cm, mm, pt, px, pc); a bare number means inches, anything else null."""
    t = F.trim(v)
    n = F.regexp_extract(t, r"^([-+]?[0-9]*\.?[0-9]+)(in|cm|mm|pt|px|pc|)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([-+]?[0-9]*\.?[0-9]+)(in|cm|mm|pt|px|pc|)$", 2)
    factor = (
        F.when(unit == "cm", 72 / 2.54).when(unit == "mm", 72 / 25.4).when(unit == "pt", 1.0).when(unit == "px", 0.75).when(unit == "pc", 12.0).otherwise(72.0)
    )
    return n * factor


def colour(hexa: Column) -> Column:
    """A colour of six hexadecimal digits, ``#`` or not, as upper-case digits; else null."""
    return F.when(hexa.rlike("^#?[0-9A-Fa-f]{6}$"), F.upper(F.substring(hexa, -6, 6)))


def highlight_colour(name: Column) -> Column:
    return F.try_element_at(literal_map(HIGHLIGHTS), name)


def highlight_name(colour: Column) -> Column:
    """The name of a highlight colour, null if none has it."""
    return F.try_element_at(literal_map({v: k for k, v in HIGHLIGHTS.items()}), F.upper(colour))


def picture_media_type(extension: Column) -> Column:
    more = {"jpeg": "image/jpeg", "tiff": "image/tiff"}
    return F.coalesce(F.try_element_at(literal_map({v: k for k, v in PICTURES.items()} | more), F.lower(extension)), F.lit("application/octet-stream"))


def field_instruction(kind: Column) -> Column:
    """The instruction that names a field type, null for custom fields."""
    names: dict[str, str] = {}
    for start, name in FIELDS:
        names.setdefault(name, start)
    return F.try_element_at(literal_map(names), kind)


def picture_extension(media_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(PICTURES), media_type), F.lit("bin"))


def field_type(instruction: Column) -> Column:
    """By the start of the instruction; PAGEREF starts as PAGE does and counts as page_number."""
    text = F.upper(F.trim(instruction))
    out = F.lit("custom")
    for start, kind in reversed(FIELDS):
        out = F.when(F.startswith(text, F.lit(start)), kind).otherwise(out)
    return out


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_field(text: Column, delimiter: str = ",") -> Column:
    """Quoted if it holds the delimiter, a quote or a line end."""
    special = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def insert_text(text: Column, offset: Column, more: Column) -> Column:
    """Null if the offset (in code points) lies outside the text."""
    return F.when((offset >= 0) & (offset <= F.length(text)), F.overlay(text, more, offset + 1, F.lit(0)))


def delete_text(text: Column, offset: Column, count: Column) -> Column:
    return F.when((offset >= 0) & (count >= 0) & (offset + count <= F.length(text)), F.overlay(text, F.lit(""), offset + 1, count))


def base_direction(text: Column) -> Column:
    """rtl if the first strong character is Hebrew or Arabic, else ltr."""
    return F.when(text.rlike(r"^[^\p{L}]*[\p{IsHebrew}\p{IsArabic}]"), "rtl").otherwise("ltr")
