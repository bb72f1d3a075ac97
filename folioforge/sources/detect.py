"""What type of file some bytes are. Packages are opened, since what they are stands inside them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import formats

#: What marks a type, by where it stands, in the order of the search.
CONTENT_TYPES = (("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx"))
MIME_TYPES = (("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods"), ("opendocument.presentation", "odp"))
FOLDERS = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))
_MOST = 1 << 20  # of an entry that says what a package is


def package_type(data: bytes) -> str:
    """By content types, then the mimetype entry, the manifest, and names; a broken package by its bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            for entry, marks in (("[Content_Types].xml", CONTENT_TYPES), ("mimetype", MIME_TYPES), ("META-INF/manifest.xml", MIME_TYPES)):
                if entry in names:
                    with z.open(entry) as f:
                        said = f.read(_MOST).decode("utf-8", "replace")
                    for mark, kind in marks:
                        if mark in said:
                            return kind
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError):
        for mark, kind in (*((m, k) for (f, k), (c, _) in zip(FOLDERS, CONTENT_TYPES, strict=True) for m in (f, c)), ("content.xml", "odt"), *MIME_TYPES):
            if mark.encode() in data:
                return kind
        return "bin"
    for folder, kind in FOLDERS:
        if any(n.startswith(folder) for n in names):
            return kind
    return "odt" if "content.xml" in names else "bin"


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for b in batches:
        at = b.schema.names.index("__package")
        kinds = [None if x.as_py() is None else package_type(x.as_py()) for x in b.column("__package")]
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(kinds, pa.string())], names=[*(n for n in b.schema.names if n != "__package"), "file_type"])


def detect_file_type(docs: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``file_type``: doc, a package's type, pdf, csv, md, txt, or bin where it isn't known; null for null bytes.

    Only packages reach Python; all else is told by expressions."""
    data = F.col(content)
    head = F.hex(F.substring(data, 1, 8))
    package = F.startswith(head, F.lit("504B0304"))
    text = data.cast("string")
    told = (
        F.when(data.isNull() | package, None).when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "doc").when(F.startswith(head, F.lit("25504446")), "pdf")
        .when(~F.is_valid_utf8(text), "bin").otherwise(formats.kind_of_text(text))
    )
    rows = docs.withColumns({"__told": told, "__package": F.when(package, data)})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__package"]
    out = rows.mapInArrow(_packages, ", ".join([*fields, "file_type string"]))
    return out.select(*docs.columns, F.coalesce("__told", "file_type").alias("file_type"))
