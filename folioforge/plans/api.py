"""Reading, exporting and converting tables of documents, and the same as SQL functions.

A table of documents has doc_id and content (bytes). Every function works row by row: parsing is
sequential within a document and independent between documents, so nothing is shuffled, a lost task is
simply run again, and a document that can't be parsed gets an error instead of failing its task."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions import formats
from folioforge.operators import write_text
from folioforge.operators.tables import parse_csv
from folioforge.sources import model
from folioforge.sources.markdown import read_markdown
from folioforge.sources.packages import read_docx, read_odt, write_docx, write_odt, write_package

NODE_SCHEMA = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in model.NODE.split(', '))}>>"


def decode(data: bytes) -> str:
    """By byte order mark, else UTF-8 if valid, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name)
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def read_text(text: str) -> model.Document:
    import re

    doc = model.new_document()
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line == "---":
            doc.body.add("Paragraph", page_break_before="true")
        elif m := re.match(r"(?s)\s*(#{1,6}) (.*)$", line):
            doc.body.add("Paragraph", style_id=f"Heading{len(m[1])}").run(m[2])
        elif (m := re.match(r"(?s)( *)(?:(- )|([0-9]+)\. )(.*)$", line)) and int(m[3] or 0) < 1 << 32:
            own = {"list_level": len(m[1]) // 2 % 256, "list_format": "bullet" if m[2] else "decimal", "list_num_id": 1, "list_start": 1 if m[2] else int(m[3])}
            doc.body.add("Paragraph", **own).run(m[4])
        else:
            doc.body.add("Paragraph").run(line)
    return doc


def read_raw(text: str) -> model.Document:
    doc = model.new_document()
    doc.body.add("Paragraph").run(text)
    return doc


def read_csv(text: str) -> model.Document:
    doc = model.new_document()
    table = doc.body.add("Table")
    for row in parse_csv(text):
        tr = table.add("TableRow")
        for value in row:
            tr.add("TableCell").add("Paragraph").add("Run").add("Text", value)
    return doc


READERS: dict[str, Callable[[bytes], model.Document]] = {
    "txt": lambda b: read_text(decode(b)),
    "md": lambda b: read_markdown(decode(b)),
    "md-raw": lambda b: read_raw(b.decode(errors="replace")),
    "csv": lambda b: read_csv(decode(b)),
    "docx": read_docx,
    "odt": read_odt,
    "json": lambda b: write_text.from_json(b.decode()),
}
WRITERS: dict[str, Callable[[model.Document], bytes]] = {
    "txt": lambda d: write_text.to_text(d).encode(),
    "md": lambda d: write_text.to_markdown(d).encode(),
    "md-raw": lambda d: "".join(n.text or "" for n in d.root.walk() if n.kind == "Text").encode(),
    "csv": lambda d: write_text.to_csv(d).encode(),
    "docx": write_docx,
    "odt": write_odt,
    "json": lambda d: write_text.to_json(d).encode(),
    "plain": lambda d: model.plain_text(d).encode(),
}


def attempt(f: Callable[[], object]) -> tuple[object, str | None]:
    """A result, or what went wrong: bad documents are data here."""
    try:
        return f(), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"[:500]


def _read(data: bytes | None, fmt: str | None) -> model.Document:
    if fmt not in READERS:
        raise ValueError(f"the format {fmt} can't be read")
    return READERS[fmt](data or b"")


def _write(doc: model.Document, fmt: str) -> bytes:
    if fmt not in WRITERS:
        raise ValueError(f"the format {fmt} can't be written")
    return WRITERS[fmt](doc)


def _with_format(docs: DataFrame, fmt: str | None) -> DataFrame:
    found = F.lit(fmt) if fmt else formats.format_of_bytes(F.col("content"))
    return docs.select("doc_id", "content", found.alias("format"))


def open_documents(docs: DataFrame, fmt: str | None = None) -> DataFrame:
    """(doc_id, format, nodes, meta, error) of documents; the format is found by content if not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, meta, errors = model.NodeLists(), [], []
            for c, f in zip(b.column("content"), b.column("format"), strict=True):
                doc, error = attempt(lambda c=c, f=f: _read(c.as_py(), f.as_py()))
                nodes.add(doc)
                meta.append(json.dumps(doc.meta, sort_keys=True) if doc else None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("format"), nodes.column(), pa.array(meta, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "format", "nodes", "meta", "error"])

    own = _with_format(docs, fmt)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, format string, nodes {NODE_SCHEMA}, meta string, error string")


def nodes_of(opened: DataFrame) -> DataFrame:
    """The node table of opened documents."""
    return opened.select("doc_id", F.inline("nodes"))


def convert(docs: DataFrame, to: str, fmt: str | None = None) -> DataFrame:
    """(doc_id, format, content, error): documents in another format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [attempt(lambda c=c, f=f: _write(_read(c.as_py(), f.as_py()), to)) for c, f in zip(b.column("content"), b.column("format"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([to] * b.num_rows), pa.array([x for x, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], names=["doc_id", "format", "content", "error"])

    own = _with_format(docs, fmt)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, format string, content binary, error string")


def export(opened: DataFrame, to: str) -> DataFrame:
    """(doc_id, content, error) of opened documents, perhaps with changed nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def one(nodes, meta):
                doc = model.from_rows(nodes or [])
                doc.meta = json.loads(meta or "{}")
                return _write(doc, to)

            got = [attempt(lambda n=n, m=m: one(n.as_py(), m.as_py())) for n, m in zip(b.column("nodes"), b.column("meta"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], names=["doc_id", "content", "error"])

    own = opened.select("doc_id", "nodes", "meta")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, content binary, error string")


def _facts(docs: DataFrame, facts: Callable[[model.Document], list[dict]], kind: pa.StructType, ddl: str) -> DataFrame:
    """doc_id and one row for each struct that ``facts`` finds in a document; those that can't be read have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [attempt(lambda c=c, f=f: facts(_read(c.as_py(), f.as_py())))[0] or [] for c, f in zip(b.column("content"), b.column("format"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(kind))], names=["doc_id", "facts"])

    own = _with_format(docs, None)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, facts array<struct<{ddl}>>").select("doc_id", F.inline("facts"))


_ATTRS = pa.map_(pa.string(), pa.string())


def styles_of(docs: DataFrame) -> DataFrame:
    """(doc_id, ix, style_id, name, kind, parent_id, next_id, is_default, attrs) of the styles of DOCX and ODT
    documents, in their order; of styles with equal ids the last. The document's defaults are a row of kind defaults without an id."""

    def facts(doc: model.Document) -> list[dict]:
        base = [{"ix": -1, "kind": "defaults", "is_default": True, "attrs": list(doc.defaults.items())}] if doc.defaults else []
        return base + [s | {"ix": i, "attrs": list(s["attrs"].items())} for i, s in enumerate(doc.styles)]

    names = ["style_id", "name", "kind", "parent_id", "next_id"]
    kind = pa.struct([("ix", pa.int64()), *((n, pa.string()) for n in names), ("is_default", pa.bool_()), ("attrs", _ATTRS)])
    return _facts(docs, facts, kind, f"ix:bigint,{','.join(f'{n}:string' for n in names)},is_default:boolean,attrs:map<string,string>")


def sections_of(docs: DataFrame) -> DataFrame:
    """(doc_id, ix, attrs) of the sections of DOCX and ODT documents: page, margins, columns, break and references."""
    kind = pa.struct([("ix", pa.int64()), ("attrs", _ATTRS)])
    return _facts(docs, lambda d: [{"ix": i, "attrs": list(s.items())} for i, s in enumerate(d.sections)], kind, "ix:bigint,attrs:map<string,string>")


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, path, data) of the pictures and other media of DOCX and ODT documents."""
    kind = pa.struct([("path", pa.string()), ("data", pa.binary())])
    return _facts(docs, lambda d: [{"path": p, "data": x} for p, x in d.media.items()], kind, "path:string,data:binary")


def pack(parts: DataFrame) -> DataFrame:
    """(doc_id, content): packages of rows (doc_id, entries array<struct<path, data binary>>), entries deflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [write_package([(e["path"], zipfile.ZIP_DEFLATED, e["data"] or b"") for e in es.as_py() or []]) for es in b.column("entries")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "content"])

    own = parts.select("doc_id", "entries")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, content binary")


def package_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, path, is_xml, compression, data) of every entry of packages; others have none."""
    from folioforge.sources.packages import package_parts as parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("path", pa.string()), ("is_xml", pa.bool_()), ("compression", pa.int64()), ("data", pa.binary())])
        for b in batches:
            got = [attempt(lambda c=c: parts(c.as_py() or b""))[0] or [] for c in b.column("content")]
            rows = [[dict(zip(("path", "is_xml", "compression", "data"), p, strict=True)) for p in ps] for ps in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(part))], names=["doc_id", "parts"])

    own = docs.select("doc_id", "content")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, parts array<struct<path:string,is_xml:boolean,compression:bigint,data:binary>>").select("doc_id", F.inline("parts"))


def register(spark: SparkSession) -> None:
    """SQL functions: ff_extract_text(bytes, format), ff_convert(bytes, from, to), ff_nodes(bytes, format).

    The first two are Arrow-optimised; a bad document gives null, or no node."""
    spark.udf.register("ff_extract_text", F.udf(lambda b, f: attempt(lambda: _write(_read(b, f), "plain").decode())[0], T.StringType(), useArrow=True))
    spark.udf.register("ff_convert", F.udf(lambda b, f, t: attempt(lambda: _write(_read(b, f), t))[0], T.BinaryType(), useArrow=True))

    @F.udtf(returnType=model.NODE)
    class Nodes:
        def eval(self, data: bytes, fmt: str):
            for r in attempt(lambda: model.to_rows(_read(data, fmt)))[0] or ():
                yield r["node_id"], r["parent_id"], r["child_ix"], r["depth"], r["node_type"], r["text"], dict(r["attrs"])

    spark.udtf.register("ff_nodes", Nodes)
