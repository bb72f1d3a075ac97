"""Word-processing packages (DOCX and ODT) to trees and back, with zipfile and ElementTree.

Guards: an entry larger than 256 MB, or a package that isn't one, is an error that the caller turns into
an error column; a task never fails for one bad document."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from folioforge.sources import formatting, odf_formatting
from folioforge.sources.model import Document, Node, new_document

MOST_BYTES = 256 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MATHS = tuple(f"{{http://schemas.openxmlformats.org/officeDocument/2006/math}}{t}" for t in ("oMath", "oMathPara"))
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
PICTURE = "http://schemas.openxmlformats.org/drawingml/2006/picture"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
#: Media types that aren't "image/" and the extension.
_PICTURES = {"jpg": "image/jpeg", "svg": "image/svg+xml", "tif": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf"}
#: Number formats of OOXML and of the model.
_NUMBERS = {"bullet": "bullet", "decimal": "decimal", "lowerLetter": "lower_alpha", "upperLetter": "upper_alpha", "lowerRoman": "lower_roman", "upperRoman": "upper_roman"}


#: Parts up to this size may be remembered: many packages hold the same styles, types and relationships.
_SHARED = 1 << 14
_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


class _Package:
    """A package's entries, as zipfile has them. Plain packages are read here, in a fifth of its time; zipfile
    reads all others, and every entry in which anything is odd, so that errors are its own."""

    def __init__(self, data: bytes):
        self.data, self.zip = data, None
        self.names, self.entries = self._plain() or ([], {})
        if not self.names:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = self.zip.namelist()
        sizes = [i.file_size for i in self.zip.infolist()] if self.zip else [e[4] for e in self.entries.values()]
        if any(n > MOST_BYTES for n in sizes):
            raise ValueError("an entry of the package is too large")

    def _plain(self) -> tuple[list[str], dict[str, tuple]] | None:
        """Names and (start, method, CRC, packed size, size) by name, or None if the directory isn't plain."""
        data, end = self.data, len(self.data) - _END.size
        if end < 0:
            return None
        mark, disk, first, here, count, size, start, comment = _END.unpack_from(data, end)
        if mark != b"PK\5\6" or disk or first or here != count or comment or start + size != end or not 0 < count < 0xFFFF:
            return None
        names, entries, at, before = [], {}, start, 0
        for _ in range(count):
            if at + _ENTRY.size > end:
                return None
            mark, _, needs, flags, method, _, _, crc, packed, full, n, extra, note, disk, _, _, local = _ENTRY.unpack_from(data, at)
            raw = data[at + _ENTRY.size : at + _ENTRY.size + n]
            if mark != b"PK\1\2" or needs > 20 or flags & ~0x806 or method not in (0, 8) or extra or note or disk or not raw.isascii() or not raw or min(raw) < 32 or local < before or local + _LOCAL.size > start:
                return None
            same = _LOCAL.unpack_from(data, local)
            begin = local + _LOCAL.size + same[9] + same[10]
            if same[0] != b"PK\3\4" or same[2] != flags or same[3] != method or data[local + _LOCAL.size : local + _LOCAL.size + same[9]] != raw or begin + packed > start:
                return None
            name = raw.decode("ascii")
            if name in entries:
                return None
            names.append(name)
            entries[name] = begin, method, crc, packed, full
            at, before = at + _ENTRY.size + n, begin + packed
        return (names, entries) if at == end else None

    def read(self, name: str) -> bytes:
        if self.zip is None and name in self.entries:
            begin, method, crc, packed, full = self.entries[name]
            out = self.data[begin : begin + packed]
            if method:
                inflate = zlib.decompressobj(-15)
                try:
                    out = inflate.decompress(out, full + 1)
                except zlib.error:
                    out = None
                if not inflate.eof:
                    out = None
            if out is not None and len(out) == full and zlib.crc32(out) == crc:
                return out
        if self.zip is None:
            self.zip = zipfile.ZipFile(io.BytesIO(self.data))
        return self.zip.read(name)

    def namelist(self) -> list[str]:
        return self.names

    def __enter__(self) -> "_Package":
        return self

    def __exit__(self, *_) -> None:
        if self.zip is not None:
            self.zip.close()


def _open(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if any(i.file_size > MOST_BYTES for i in z.infolist()):
        raise ValueError("an entry of the package is too large")
    return z


def _xml(z: _Package, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


@lru_cache(maxsize=64)
def _known_styles(xml: bytes) -> tuple[list[dict], dict[str, str]]:
    return formatting.styles_of(ET.fromstring(xml))


def _styles(z: _Package) -> tuple[list[dict], dict[str, str]]:
    """Styles and defaults of a DOCX package; those of a small part, which others may have too, are copies."""
    if "word/styles.xml" not in z.namelist():
        return [], {}
    xml = z.read("word/styles.xml")
    if len(xml) > _SHARED:
        return formatting.styles_of(ET.fromstring(xml))
    styles, defaults = _known_styles(xml)
    return [s | {"attrs": dict(s["attrs"])} for s in styles], dict(defaults)


@lru_cache(maxsize=64)
def _known_targets(xml: bytes) -> dict[str, str]:
    return {r.get("Id"): r.get("Target") for r in ET.fromstring(xml)}


def _targets(z: _Package, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    xml = z.read(path)
    return dict((_known_targets if len(xml) <= _SHARED else _known_targets.__wrapped__)(xml))


def package_parts(data: bytes) -> list[tuple[str, bool, int, bytes]]:
    """(path, is XML, compression, bytes) of each entry in the order of the package."""
    with _open(data) as z:
        return [(i.filename, i.filename.endswith((".xml", ".rels")), i.compress_type, z.read(i)) for i in z.infolist() if not i.is_dir()]


def _deflate(data: bytes) -> tuple[int, bytes]:
    return zlib.crc32(data), zlib.compress(data, wbits=-15)


_known_deflate = lru_cache(maxsize=64)(_deflate)


def write_package(parts: list[tuple[str, int, bytes]], shared: bool = False) -> bytes:
    """A package of entries in the order given, always with the same bytes, which are those of zipfile. With
    ``shared``, small entries but the main document are expected to stand in many packages."""
    if not parts or len(parts) >= 0xFFFF or any(how not in (0, 8) or not path.isascii() or not path or min(path) < " " or path.endswith("/") or "\\" in path for path, how, _ in parts) or sum(len(d) for _, _, d in parts) > 1 << 30:
        return _zipped(parts)
    out, directory, at = [], [], 0
    for path, how, data in parts:
        again = shared and len(data) <= _SHARED and path != "word/document.xml"
        crc, packed = (_known_deflate if again else _deflate)(data) if how else (zlib.crc32(data), data)
        name = path.encode()
        told = 20, 0, how, 0, 33, crc, len(packed), len(data), len(name), 0
        out += (_LOCAL.pack(b"PK\3\4", *told), name, packed)
        directory += (_ENTRY.pack(b"PK\1\2", 20 | 3 << 8, *told, 0, 0, 0, 0o600 << 16, at), name)
        at += _LOCAL.size + len(name) + len(packed)
    size = sum(map(len, directory))
    return b"".join((*out, *directory, _END.pack(b"PK\5\6", 0, 0, len(parts), len(parts), size, at, 0)))


def _zipped(parts: list[tuple[str, int, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, how, data in parts:
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.compress_type = how
            z.writestr(info, data)
    return out.getvalue()


# DOCX


class _Docx:
    def __init__(self, data: bytes):
        self.doc = new_document()
        with _Package(data) as z:
            body = _xml(z, "word/document.xml")
            if body is None:
                raise ValueError("the package has no word/document.xml")
            self.rels = main = _targets(z, "word/document.xml")
            self.doc.styles, self.doc.defaults = _styles(z)
            self.doc.media = {n.removeprefix("word/"): z.read(n) for n in z.namelist() if n.startswith("word/media/") and re.match("word/media/.", n)}
            self.formats = self.numbering(_xml(z, "word/numbering.xml"))
            for kid in body.find(f"{W}body") if body.find(f"{W}body") is not None else ():
                self.block(kid, self.doc.body, {})
            last = body.find(f"{W}body/{W}sectPr")
            if last is not None:
                self.doc.sections.append(formatting.section_of(last, self.rels))
            for part, kind, tag in (("comments", "CommentBody", "comment"), ("footnotes", "FootnoteBody", "footnote"), ("endnotes", "EndnoteBody", "endnote")):
                tree = _xml(z, f"word/{part}.xml")
                self.rels = _targets(z, f"word/{part}.xml")
                for note in tree.iter(f"{W}{tag}") if tree is not None else ():
                    if note.get(f"{W}type") in ("separator", "continuationSeparator"):
                        continue
                    own = self.doc.root.add(kind, note_id=note.get(f"{W}id", ""), **({"author": note.get(f"{W}author")} if note.get(f"{W}author") else {}))
                    for kid in note:
                        self.block(kid, own, {})
            for name in z.namelist():
                if name.startswith(("word/header", "word/footer")) and (m := re.fullmatch(r"word/(header|footer)\d*\.xml", name)):
                    own = self.doc.root.add(m[1].capitalize(), part=name)
                    self.rels = _targets(z, name)
                    for kid in _xml(z, name):
                        self.block(kid, own, {})
            self.rels = main
            core = _xml(z, "docProps/core.xml")
            if core is not None:
                self.doc.meta = {e.tag.split("}")[1]: e.text or "" for e in core if e.text}
            if "word/vbaProject.bin" in z.namelist():
                self.doc.meta["hasMacros"] = "true"

    @staticmethod
    def numbering(tree) -> dict[tuple[str, str], tuple[str, str]]:
        """Format and start by number and level: overrides come before abstract definitions."""
        if tree is None:
            return {}

        def levels(parent):
            for lvl in parent.findall(f"{W}lvl"):
                fmt, start = lvl.find(f"{W}numFmt"), lvl.find(f"{W}start")
                yield lvl.get(f"{W}ilvl"), fmt.get(f"{W}val") if fmt is not None else "decimal", start.get(f"{W}val") if start is not None else "1"

        abstract = {a.get(f"{W}abstractNumId"): {i: (f, s) for i, f, s in levels(a)} for a in tree.findall(f"{W}abstractNum")}
        out = {}
        for num in tree.findall(f"{W}num"):
            own = num.get(f"{W}numId")
            link = num.find(f"{W}abstractNumId")
            for i, pair in abstract.get(link.get(f"{W}val") if link is not None else None, {}).items():
                out[own, i] = pair
            for over in num.findall(f"{W}lvlOverride"):
                i, start = over.get(f"{W}ilvl"), over.find(f"{W}startOverride")
                for _, f, s in levels(over):
                    out[own, i] = (f, s)
                if start is not None:
                    out[own, i] = (out.get((own, i), ("decimal", "1"))[0], start.get(f"{W}val"))
        return out

    def block(self, el, parent: Node, revision: dict[str, str]) -> None:
        tag = el.tag.removeprefix(W)
        if tag == "p":
            self.paragraph(el, parent, revision)
        elif tag == "tbl":
            table = parent.add("Table", **formatting.table_attrs(el))
            for tr in el.findall(f"{W}tr"):
                row = table.add("TableRow", **formatting.row_attrs(tr))
                for tc in tr.findall(f"{W}tc"):
                    cell, pr = row.add("TableCell"), tc.find(f"{W}tcPr")
                    if pr is not None:
                        cell.attrs |= formatting.cell_attrs(pr)
                        if (span := pr.find(f"{W}gridSpan")) is not None:
                            cell.attrs["col_span"] = span.get(f"{W}val", "1")
                        if (merge := pr.find(f"{W}vMerge")) is not None:
                            cell.attrs["row_span"] = merge.get(f"{W}val", "continue")
                    for kid in tc:
                        if kid is not pr:
                            self.block(kid, cell, revision)
        elif tag == "sdt":
            content, pr = el.find(f"{W}sdtContent"), el.find(f"{W}sdtPr")
            gallery = pr.find(f".//{W}docPartGallery") if pr is not None else None
            own = parent.add("TableOfContents") if gallery is not None and gallery.get(f"{W}val") == "Table of Contents" else parent
            before = len(own.kids)
            for kid in content if content is not None else ():
                self.block(kid, own, revision)
            if own is parent and pr is not None and (form := formatting.form_attrs(pr)):
                made = next((k for k in own.kids[before:] if k.kind == "Paragraph"), None)
                (made or own.add("Paragraph")).attrs |= form
        elif tag in ("ins", "del", "moveTo", "moveFrom"):
            for kid in el:
                self.block(kid, parent, self.revision(el))
        elif tag in MATHS:
            parent.add("Paragraph").add("Equation", source=ET.tostring(el, "unicode"))

    @staticmethod
    def revision(el) -> dict[str, str]:
        kind = {"ins": "Insert", "del": "Delete", "moveTo": "MoveTo", "moveFrom": "MoveFrom"}[el.tag.removeprefix(W)]
        return {"revision_type": kind} | {k: el.get(f"{W}{w}") for k, w in (("revision_author", "author"), ("revision_date", "date")) if el.get(f"{W}{w}")}

    def paragraph(self, el, parent: Node, revision: dict[str, str]) -> None:
        para = parent.add("Paragraph")
        if not len(el):
            return
        pr = el.find(f"{W}pPr")
        if pr is not None:
            get = lambda path: (x.get(f"{W}val") if (x := pr.find(path)) is not None else None)
            if style := get(f"{W}pStyle"):
                para.attrs["style_id"] = style
            para.attrs |= formatting.paragraph_attrs(pr)
            if (section := pr.find(f"{W}sectPr")) is not None:
                para.attrs["section_index"] = str(len(self.doc.sections))
                self.doc.sections.append(formatting.section_of(section, self.rels))
            number, level = get(f"{W}numPr/{W}numId"), get(f"{W}numPr/{W}ilvl") or "0"
            if number and number != "0":
                fmt, start = self.formats.get((number, level), ("decimal", "1"))
                para.attrs |= {"list_level": level, "list_num_id": number, "list_format": _NUMBERS.get(fmt, "decimal"), "list_start": start}
        self.state: list | None = None
        self.inlines(el, para, {}, revision)

    def inlines(self, el, para: Node, more: dict[str, str], revision: dict[str, str]) -> None:
        for kid in el:
            tag = kid.tag.removeprefix(W)
            if tag == "r":
                self.run(kid, para, more | revision)
            elif tag == "hyperlink":
                url = self.rels.get(kid.get(f"{R}id")) or (f"#{kid.get(f'{W}anchor')}" if kid.get(f"{W}anchor") else "")
                self.inlines(kid, para, more | ({"url": url} if url else {}), revision)
            elif tag in ("ins", "del", "moveTo", "moveFrom"):
                self.inlines(kid, para, more, self.revision(kid))
            elif tag == "fldSimple":
                para.add("Field", code=kid.get(f"{W}instr", "").strip(), field_type=_field(kid.get(f"{W}instr", "")))
            elif tag in ("bookmarkStart", "bookmarkEnd", "commentRangeStart", "commentRangeEnd"):
                kind = {"bookmarkStart": "BookmarkStart", "bookmarkEnd": "BookmarkEnd", "commentRangeStart": "CommentStart", "commentRangeEnd": "CommentEnd"}[tag]
                para.add(kind, ref=kid.get(f"{W}id", ""), **({"name": kid.get(f"{W}name")} if kid.get(f"{W}name") else {}))
            elif tag in MATHS:
                para.add("Equation", source=ET.tostring(kid, "unicode").strip())
            elif tag in ("smartTag", "sdt", "sdtContent"):
                self.inlines(kid, para, more, revision)

    def run(self, el, para: Node, attrs: dict[str, str]) -> None:
        attrs, pr = dict(attrs), el.find(f"{W}rPr")
        if pr is not None:
            attrs |= formatting.run_attrs(pr)
            if (x := pr.find(f"{W}rPrChange")) is not None and "revision_type" not in attrs:
                attrs["revision_type"] = "FormatChange"
        for kid in el:
            tag = kid.tag.removeprefix(W)
            if tag == "fldChar":
                kind = kid.get(f"{W}fldCharType")
                if kind == "begin":
                    self.state = ["", False]
                elif kind == "separate" and self.state:
                    self.state[1] = True
                elif kind == "end" and self.state:
                    para.add("Field", code=self.state[0].strip(), field_type=_field(self.state[0]))
                    self.state = None
            elif tag == "instrText" and self.state:
                self.state[0] = kid.text or ""
            elif self.state:
                continue  # the value a field shows is not content
            elif tag in ("t", "delText"):
                para.run(kid.text or "", **attrs)
            elif tag == "tab":
                para.add("Tab")
            elif tag in ("br", "cr"):
                para.add({"page": "PageBreak", "column": "ColumnBreak"}.get(kid.get(f"{W}type"), "LineBreak"))
            elif tag in ("footnoteReference", "endnoteReference"):
                para.add("FootnoteRef" if tag[0] == "f" else "EndnoteRef", ref=kid.get(f"{W}id", ""))
            elif tag == "drawing":
                blip = next((b for b in kid.iter() if b.tag.endswith("}blip")), None)
                own = para.add("Image" if blip is not None else "Drawing", **({"src": self.rels.get(blip.get(f"{R}embed")) or ""} if blip is not None else {}))
                for x in kid.iter():
                    if x.tag == f"{WP}docPr" and x.get("descr"):
                        own.attrs["alt"] = x.get("descr")
                    elif x.tag == f"{WP}extent":
                        own.attrs |= {k: x.get(n) for k, n in (("width_emu", "cx"), ("height_emu", "cy")) if (x.get(n) or "").isdigit()}


def _field(instruction: str) -> str:
    text = instruction.strip().upper()
    kinds = (("PAGE", "page_number"), ("NUMPAGES", "page_count"), ("SECTIONPAGES", "page_count"), ("DATE", "date"), ("CREATEDATE", "date"), ("SAVEDATE", "date"), ("TIME", "time"), ("FILENAME", "file_name"), ("AUTHOR", "author"), ("TOC", "table_of_contents"))
    return next((k for s, k in kinds if text.startswith(s)), "custom")


def read_docx(data: bytes) -> Document:
    return _Docx(data).doc


def _t(text: str, tag: str = "w:t") -> str:
    return f'<{tag} xml:space="preserve">{escape(text)}</{tag}>'


def write_docx(doc: Document) -> bytes:
    links: dict[str, str] = {}
    pictures: dict[str, str] = {}
    aside = [(f"word/{n.kind.lower()}{i}.xml", n) for i, n in enumerate((n for n in doc.root.kids if n.kind in ("Header", "Footer")), 1)]
    ids_of = [f"rIdH{i}" for i in range(1, len(aside) + 1)]
    ids = {n.attrs.get("part", "").removeprefix("word/"): i for i, (_, n) in zip(ids_of, aside, strict=True)}
    lists: dict[str, dict[str, tuple[str, str]]] = {}
    placed: dict[tuple[str, str, str], str] = {}  # numbers in use since the last paragraph that is no item
    every = list(doc.root.walk())
    taken = {n.attrs["list_num_id"] for n in every if "list_num_id" in n.attrs}

    def number_of(a: dict[str, str]) -> str:
        """A list's number. A definition has one format and start per level, so an item that needs another,
        in a list begun anew, gets a list of its own."""
        own, level, fmt, start = a.get("list_num_id", "1"), a.get("list_level", "0"), a["list_format"], a.get("list_start") or "1"
        key = own, level, fmt
        if key not in placed:
            found = next((n for n in (own, *(n for n in lists if n.startswith("9") and n not in taken)) if lists.get(n, {}).get(level, (fmt, start)) == (fmt, start)), None)
            if found is None:
                found = next(str(n) for n in range(90_000, 1 << 30) if str(n) not in lists and str(n) not in taken)
            lists.setdefault(found, {}).setdefault(level, (fmt, start))
            placed[key] = found
        return placed[key]

    def run(node: Node) -> str:
        a = node.attrs
        pr = formatting.run_xml(a | {"character_style": "CodeChar"} if a.get("code") == "true" else a)
        gone = a.get("revision_type") == "Delete"
        out = f"<w:r>{f'<w:rPr>{pr}</w:rPr>' if pr else ''}{_t(node.plain(), 'w:delText' if gone else 'w:t')}</w:r>"
        mark = {"Insert": "ins", "Delete": "del", "MoveTo": "moveTo", "MoveFrom": "moveFrom"}.get(a.get("revision_type", ""))
        if mark:
            who = f" w:author={quoteattr(a.get('revision_author', ''))}" + (f" w:date={quoteattr(a['revision_date'])}" if "revision_date" in a else "")
            out = f'<w:{mark} w:id="1"{who}>{out}</w:{mark}>'
        if url := a.get("url"):
            if url.startswith("#"):
                return f"<w:hyperlink w:anchor={quoteattr(url[1:])}>{out}</w:hyperlink>"
            return f'<w:hyperlink r:id="{links.setdefault(url, f"rIdL{len(links) + 1}")}">{out}</w:hyperlink>'
        return out

    def inline(node: Node) -> str:
        k, a = node.kind, node.attrs
        if k == "Run":
            return run(node)
        simple = {"Tab": "<w:tab/>", "LineBreak": "<w:br/>", "PageBreak": '<w:br w:type="page"/>', "ColumnBreak": '<w:br w:type="column"/>'}
        if k in simple:
            return f"<w:r>{simple[k]}</w:r>"
        if k == "Field":
            return f"<w:fldSimple w:instr={quoteattr(a.get('code', ''))}/>"
        if k in ("FootnoteRef", "EndnoteRef"):
            return f"<w:r><w:{'footnote' if k[0] == 'F' else 'endnote'}Reference w:id={quoteattr(a.get('ref', ''))}/></w:r>"
        marks = {"BookmarkStart": "bookmarkStart", "BookmarkEnd": "bookmarkEnd", "CommentStart": "commentRangeStart", "CommentEnd": "commentRangeEnd"}
        if k in marks:
            return f"<w:{marks[k]} w:id={quoteattr(a.get('ref', ''))}" + (f" w:name={quoteattr(a['name'])}" if "name" in a else "") + "/>"
        if k == "Equation":
            return _fragment(a.get("source", ""))
        if k == "Image" and a.get("src") in doc.media:
            size = f'cx="{a.get("width_emu", "914400")}" cy="{a.get("height_emu", "914400")}"'
            own = pictures.setdefault(a["src"], f"rIdM{len(pictures) + 1}")
            return (
                f'<w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="1" name="Picture" descr={quoteattr(a.get("alt", ""))}/><a:graphic><a:graphicData uri="{PICTURE}">'
                f'<pic:pic><pic:nvPicPr><pic:cNvPr id="1" name="Picture"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{own}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
                f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
            )
        if k == "Image":
            return f"<w:r>{_t('[' + a.get('alt', '') + ']')}</w:r>" if a.get("alt") else ""
        return ""

    def paragraph(node: Node) -> str:
        a, pr = node.attrs, ""
        if not a:
            placed.clear()
            return f"<w:p>{''.join(map(inline, node.kids))}</w:p>"
        if style := a.get("style_id"):
            pr += f"<w:pStyle w:val={quoteattr(style)}/>"
        before, after = formatting.paragraph_xml(a)
        pr += before
        if "list_format" in a:
            pr += f'<w:numPr><w:ilvl w:val="{a.get("list_level", "0")}"/><w:numId w:val="{number_of(a)}"/></w:numPr>'
        else:
            placed.clear()
        pr += after
        if (at := a.get("section_index", "")).isdigit() and int(at) < len(doc.sections):
            pr += formatting.section_xml(doc.sections[int(at)], ids)
        out = f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{''.join(map(inline, node.kids))}</w:p>"
        form = formatting.form_xml(a)
        return f"<w:sdt><w:sdtPr>{form}</w:sdtPr><w:sdtContent>{out}</w:sdtContent></w:sdt>" if form else out

    def block(node: Node) -> str:
        if node.kind == "Paragraph":
            return paragraph(node)
        if node.kind == "Table":
            def cell(c: Node) -> str:
                early, late = formatting.cell_xml(c.attrs)
                pr = "".join((early, f'<w:gridSpan w:val="{c.attrs["col_span"]}"/>' if "col_span" in c.attrs else "", f'<w:vMerge w:val="{c.attrs["row_span"]}"/>' if "row_span" in c.attrs else "", late))
                return f"<w:tc>{f'<w:tcPr>{pr}</w:tcPr>' if pr else ''}{''.join(map(block, c.kids)) or '<w:p/>'}</w:tc>"

            rows = "".join(f"<w:tr>{formatting.row_xml(r.attrs)}{''.join(map(cell, r.kids))}</w:tr>" for r in node.kids)
            return f"<w:tbl>{formatting.table_xml(node.attrs)}{rows}</w:tbl>"
        inner = "".join(map(block, node.kids))
        if node.kind == "TableOfContents":
            return f'<w:sdt><w:sdtPr><w:docPartObj><w:docPartGallery w:val="Table of Contents"/></w:docPartObj></w:sdtPr><w:sdtContent>{inner}</w:sdtContent></w:sdt>'
        return inner

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    space += f' xmlns:wp="{WP[1:-1]}" xmlns:a="{DRAWING}" xmlns:pic="{PICTURE}" xmlns:w14="{formatting.W14[1:-1]}"'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    inner = "".join(map(block, doc.body.kids))
    inline_sections = {n.attrs["section_index"] for n in doc.body.walk() if "section_index" in n.attrs}
    if doc.sections and str(len(doc.sections) - 1) not in inline_sections:
        last = doc.sections[-1]
    else:  # without sections, the first header and footer are everyone's
        last = {f"{n.kind.lower()}_default": n.attrs.get("part", "").removeprefix("word/") for _, n in reversed(aside)}
    body = f"{head}<w:document {space}><w:body>{inner}{formatting.section_xml(last, ids) if last else '<w:sectPr/>'}</w:body></w:document>"
    asides = [(name, n.kind, f"<w:{'hdr' if n.kind == 'Header' else 'ftr'} {space}>{''.join(map(block, n.kids)) or '<w:p/>'}</w:{'hdr' if n.kind == 'Header' else 'ftr'}>") for name, n in aside]
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    parts: list[tuple[str, str, str, str]] = []  # name, content type, relationship, xml
    if lists:
        back = {v: k for k, v in _NUMBERS.items()}
        xml = "".join(
            f'<w:abstractNum w:abstractNumId="{k}">' + "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{s}"/><w:numFmt w:val="{back.get(f, "decimal")}"/></w:lvl>' for i, (f, s) in sorted(v.items())) + "</w:abstractNum>"
            for k, v in lists.items()
        ) + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in lists)
        parts.append(("word/numbering.xml", f"{main}numbering+xml", f"{rel}numbering", f"{head}<w:numbering {space}>{xml}</w:numbering>"))
    for kind, name, tag in (("CommentBody", "comments", "comment"), ("FootnoteBody", "footnotes", "footnote"), ("EndnoteBody", "endnotes", "endnote")):
        notes = [k for k in doc.root.kids if k.kind == kind]
        if notes:
            xml = "".join(f"<w:{tag} w:id={quoteattr(k.attrs.get('note_id', ''))}" + (f" w:author={quoteattr(k.attrs['author'])}" if "author" in k.attrs else "") + f">{''.join(map(block, k.kids))}</w:{tag}>" for k in notes)
            parts.append((f"word/{name}.xml", f"{main}{name}+xml", rel + name, f"{head}<w:{name} {space}>{xml}</w:{name}>"))
    used = sorted({n.attrs["style_id"] for n in every if n.kind == "Paragraph" and n.attrs.get("style_id")})
    known = {x["style_id"] for x in doc.styles}
    styles = formatting.styles_xml(doc.styles, doc.defaults) + "".join(f'<w:style w:type="paragraph" w:styleId={quoteattr(x)}><w:name w:val={quoteattr(x)}/></w:style>' for x in used if x not in known)
    if "CodeChar" not in known:
        styles += '<w:style w:type="character" w:styleId="CodeChar"><w:name w:val="Code Char"/></w:style>'
    parts.append(("word/styles.xml", f"{main}styles+xml", f"{rel}styles", f"{head}<w:styles {space}>{styles}</w:styles>"))
    parts += [(n, f"{main}{k.lower()}+xml", f"{rel}{k.lower()}", f"{head}{x}") for n, k, x in asides]
    named = {n: i for i, (n, _) in zip(ids_of, aside, strict=True)}
    rels = "".join(f'<Relationship Id="{named.get(n, f"rId{i}")}" Type="{t}" Target="{n.removeprefix("word/")}"/>' for i, (n, _, t, _) in enumerate(parts, 1))
    shared = "".join(f'<Relationship Id="{i}" Type="{rel}hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for u, i in links.items())
    shared += "".join(f'<Relationship Id="{i}" Type="{rel}image" Target={quoteattr(n)}/>' for n, i in pictures.items())
    r_space = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    types = "".join(f'<Default Extension={quoteattr(e)} ContentType={quoteattr(_PICTURES.get(e, f"image/{e}"))}/>' for e in sorted({n.rpartition(".")[2].lower() for n in pictures}))
    types += f'<Override PartName="/word/document.xml" ContentType="{main}document.main+xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t, _, _ in parts)
    files = [
        ("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'),
        ("_rels/.rels", f'{head}<Relationships {r_space}><Relationship Id="rId1" Type="{rel}officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", body),
        ("word/_rels/document.xml.rels", f"{head}<Relationships {r_space}>{rels}{shared}</Relationships>"),
        *((n, x) for n, _, _, x in parts),
    ]
    if shared:
        own = [n for n, _, _, _ in parts if re.fullmatch(r"word/(comments|footnotes|endnotes|(header|footer)\d+)\.xml", n)]
        files += [(f"word/_rels/{n.removeprefix('word/')}.rels", f"{head}<Relationships {r_space}>{shared}</Relationships>") for n in own]
    if doc.meta:
        dc = "".join(f"<{'cp' if k in ('keywords', 'lastModifiedBy') else 'dc'}:{k}>{escape(v)}</{'cp' if k in ('keywords', 'lastModifiedBy') else 'dc'}:{k}>" for k, v in sorted(doc.meta.items()) if re.fullmatch(r"[A-Za-z]+", k) and k not in ("hasMacros", "created", "modified"))
        files.append(("docProps/core.xml", f'{head}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{dc}</cp:coreProperties>'))
    stored = [(f"word/{n}", zipfile.ZIP_STORED, doc.media[n]) for n in pictures]
    return write_package([(n, zipfile.ZIP_DEFLATED, _clean(x).encode()) for n, x in files] + stored, shared=True)


def _fragment(xml: str) -> str:
    """An equation's XML, or nothing if it isn't one."""
    try:
        el = ET.fromstring(xml)
    except ET.ParseError:
        return ""
    return ET.tostring(el, "unicode") if el.tag in MATHS else ""


def _clean(xml: str) -> str:
    """Without characters that XML 1.0 can't hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", "", xml)


# ODT

_O = "urn:oasis:names:tc:opendocument:xmlns:"
OFFICE, TEXT, TABLE, STYLE, FO = (f"{{{_O}{x}:1.0}}" for x in ("office", "text", "table", "style", "xsl-fo-compatible"))
DRAW = f"{{{_O}drawing:1.0}}"
SVG = f"{{{_O}svg-compatible:1.0}}"
DC = "{http://purl.org/dc/elements/1.1/}"
XLINK = "{http://www.w3.org/1999/xlink}"


class _Odt:
    def __init__(self, data: bytes):
        self.doc = new_document()
        with _Package(data) as z:
            tree = _xml(z, "content.xml")
            if tree is None:
                raise ValueError("the package has no content.xml")
            self.styles = {s.get(f"{STYLE}name"): s for s in tree.iter(f"{STYLE}style")}
            body = tree.find(f"{OFFICE}body/{OFFICE}text")
            for kid in body if body is not None else ():
                self.block(kid, self.doc.body, {})
            if body is not None and (changes := [c for r in body.iterfind(f"{TEXT}tracked-changes/{TEXT}changed-region") for c in self.change(r)]):
                self.doc.body.attrs["tracked_changes"] = json.dumps(changes, sort_keys=True)
            sheet = _xml(z, "styles.xml")
            self.doc.styles, self.doc.defaults = odf_formatting.styles_of(sheet)
            self.doc.media = {f"media/{n.removeprefix('Pictures/')}": z.read(n) for n in z.namelist() if re.match("Pictures/.", n)}
            if page := odf_formatting.section_of(sheet):
                section, asides = page
                self.doc.sections.append(section)
                self.styles |= {x.get(f"{STYLE}name"): x for a in sheet.iter(f"{OFFICE}automatic-styles") for x in a.iter(f"{STYLE}style")}
                for i, (side, kind, el) in enumerate(asides, 1):
                    own = self.doc.root.add(side.capitalize(), part=f"word/{side}{i}.xml")
                    section[f"{side}_{kind}"] = f"{side}{i}.xml"
                    for kid in el:
                        self.block(kid, own, {})
            meta = _xml(z, "meta.xml")
            if meta is not None:
                self.doc.meta = {e.tag.split("}")[1]: e.text for e in meta.iter() if e.text and e.text.strip() and not list(e)}

    def block(self, el, parent: Node, more: dict[str, str]) -> None:
        if el.tag in (f"{TEXT}p", f"{TEXT}h"):
            para = parent.add("Paragraph", **more)
            style = self.styles.get(el.get(f"{TEXT}style-name"))
            pr = style.find(f"{STYLE}paragraph-properties") if style is not None else None
            if el.tag == f"{TEXT}h":
                para.attrs["style_id"] = f"Heading{el.get(f'{TEXT}outline-level', '1')}"
            elif name := (style.get(f"{STYLE}parent-style-name") if style is not None else el.get(f"{TEXT}style-name")):
                if name != "Standard":
                    para.attrs["style_id"] = name
            if pr is not None:
                para.attrs |= odf_formatting.paragraph_attrs(pr)
            self.inline(el, para, {})
        elif el.tag == f"{TEXT}list":
            level = int(more.get("list_level", -1)) + 1
            for item in el:
                for kid in item:
                    # every list is a bullet list here: its style is not looked up
                    self.block(kid, parent, {"list_level": str(level), "list_format": "bullet", "list_num_id": "0"})
        elif el.tag == f"{TABLE}table":
            table = parent.add("Table")
            for tr in el.iter(f"{TABLE}table-row"):
                row = table.add("TableRow")
                for tc in tr:
                    if tc.tag == f"{TABLE}table-cell":
                        cell = row.add("TableCell", **({"col_span": n} if (n := tc.get(f"{TABLE}number-columns-spanned", "1")) != "1" else {}))
                        for kid in tc:
                            self.block(kid, cell, {})
        elif el.tag == f"{TEXT}table-of-content":
            own = parent.add("TableOfContents")
            for kid in el.iter(f"{TEXT}p"):
                self.block(kid, own, {})
        elif el.tag == f"{TEXT}section":
            for kid in el:
                self.block(kid, parent, more)

    def inline(self, el, para: Node, attrs: dict[str, str]) -> None:
        para.run(self.space(el.text), **attrs)
        for kid in el:
            if kid.tag == f"{TEXT}span":
                self.inline(kid, para, attrs | self.run_attrs(kid.get(f"{TEXT}style-name")))
            elif kid.tag == f"{TEXT}a":
                self.inline(kid, para, attrs | {"url": kid.get(f"{XLINK}href", "")})
            elif kid.tag == f"{TEXT}tab":
                para.add("Tab")
            elif kid.tag == f"{TEXT}line-break":
                para.add("LineBreak")
            elif kid.tag == f"{TEXT}s":
                para.run(" " * int(kid.get(f"{TEXT}c", "1")), **attrs)
            elif kid.tag == f"{TEXT}page-number":
                para.add("Field", code="PAGE", field_type="page_number")
            elif kid.tag == f"{DRAW}frame" and (image := kid.find(f"{DRAW}image")) is not None:
                own = para.add("Image", src=image.get(f"{XLINK}href", "").replace("Pictures/", "media/", 1))
                alt = next((x.text for n in ("desc", "title") for x in kid.findall(f"{SVG}{n}") if x.text), None)
                own.attrs |= {"alt": alt} if alt else {}
                own.attrs |= {k: str(round(float(v) * 12700)) for k, n in (("width_emu", "width"), ("height_emu", "height")) if (v := odf_formatting.points(kid.get(f"{SVG}{n}")))}
            elif kid.tag in (f"{OFFICE}annotation", f"{OFFICE}annotation-end"):
                name = kid.get(f"{OFFICE}name", "")
                if kid.tag.endswith("-end"):
                    para.add("CommentEnd", ref=name)
                else:
                    para.add("CommentStart", ref=name)
                    said = {k: kid.findtext(f"{DC}{t}") for k, t in (("author", "creator"), ("date", "date"))}
                    own = self.doc.root.add("CommentBody", note_id=name, **{k: v for k, v in said.items() if v})
                    for x in kid:
                        self.block(x, own, {})
            elif kid.tag == f"{TEXT}note":
                kind = "Endnote" if kid.get(f"{TEXT}note-class") == "endnote" else "Footnote"
                para.add(f"{kind}Ref", ref=kid.get(f"{TEXT}id", ""))
                body = kid.find(f"{TEXT}note-body")
                own = self.doc.root.add(f"{kind}Body", note_id=kid.get(f"{TEXT}id", ""))
                for x in body if body is not None else ():
                    self.block(x, own, {})
            para.run(self.space(kid.tail), **attrs)

    @staticmethod
    def change(region) -> list[dict[str, str]]:
        """Id, type, author and date of a changed region; a region without a type says nothing."""
        own = region.get(f"{TEXT}id") or region.get("{http://www.w3.org/XML/1998/namespace}id") or ""
        kinds = [x for x in region if x.tag in {f"{TEXT}{t}" for t in ("insertion", "deletion", "format-change")}]
        return [{"id": own, "type": x.tag.split("}")[1], "author": next((e.text or "" for e in x.iter(f"{DC}creator")), ""), "date": next((e.text or "" for e in x.iter(f"{DC}date")), "")} for x in kinds]

    @staticmethod
    def space(text: str | None) -> str:
        return re.sub(r"[ \t\r\n]+", " ", text or "")

    def run_attrs(self, name: str | None) -> dict[str, str]:
        style = self.styles.get(name)
        pr = style.find(f"{STYLE}text-properties") if style is not None else None
        if pr is None:
            return {"code": "true"} if name == "Code" else {}
        return odf_formatting.run_attrs(pr)


def read_odt(data: bytes) -> Document:
    return _Odt(data).doc


def write_odt(doc: Document) -> bytes:
    spans: dict[str, str] = {}
    paras: dict[tuple[str, str], str] = {}
    pictures: dict[str, str] = {}

    def text(s: str) -> str:
        out = escape(s)
        out = re.sub(r"  +", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', out)
        out = re.sub(r"^ ", "<text:s/>", out)
        return out.replace("\t", "<text:tab/>").replace("\n", "<text:line-break/>")

    def inline(node: Node) -> str:
        if node.kind == "Run":
            key = odf_formatting.run_xml(node.attrs)
            out = text(node.plain())
            if node.attrs.get("code") == "true":
                out = f'<text:span text:style-name="Code">{out}</text:span>'
            elif key:
                out = f'<text:span text:style-name="{spans.setdefault(key, f"T{len(spans) + 1}")}">{out}</text:span>'
            return f"<text:a xlink:href={quoteattr(node.attrs['url'])}>{out}</text:a>" if node.attrs.get("url") else out
        if node.kind == "Image" and node.attrs.get("src") in doc.media:
            path = pictures.setdefault(node.attrs["src"], "Pictures/" + node.attrs["src"].removeprefix("media/"))
            size = "".join(f' svg:{n}="{int(node.attrs[k]) / 12700}pt"' for k, n in (("width_emu", "width"), ("height_emu", "height")) if node.attrs.get(k, "").isdigit())
            alt = f"<svg:desc>{escape(node.attrs['alt'])}</svg:desc>" if node.attrs.get("alt") else ""
            return f"<draw:frame text:anchor-type=\"as-char\"{size}><draw:image xlink:href={quoteattr(path)}/>{alt}</draw:frame>"
        return {"Tab": "<text:tab/>", "LineBreak": "<text:line-break/>"}.get(node.kind, "") or ("<text:page-number/>" if node.attrs.get("field_type") == "page_number" else "")

    def block(node: Node) -> str:
        if node.kind == "Paragraph":
            a = node.attrs
            key = a.get("style_id", "Standard"), odf_formatting.paragraph_xml(a)
            name = paras.setdefault(key, f"P{len(paras) + 1}")
            inner = "".join(map(inline, node.kids))
            if m := re.fullmatch(r"Heading(\d+)", a.get("style_id", "")):
                return f'<text:h text:style-name="{name}" text:outline-level="{m[1]}">{inner}</text:h>'
            out = f'<text:p text:style-name="{name}">{inner}</text:p>'
            if "list_format" in a:
                depth = int(a.get("list_level", 0)) + 1
                out = "<text:list><text:list-item>" * depth + out + "</text:list-item></text:list>" * depth
            return out
        if node.kind == "Table":
            cell = lambda c: f"<table:table-cell{f' table:number-columns-spanned={quoteattr(c.attrs["col_span"])}' if 'col_span' in c.attrs else ''}>{''.join(map(block, c.kids))}</table:table-cell>"
            return "<table:table>" + "".join(f"<table:table-row>{''.join(map(cell, r.kids))}</table:table-row>" for r in node.kids) + "</table:table>"
        inner = "".join(map(block, node.kids))
        return f"<text:table-of-content><text:index-body>{inner}</text:index-body></text:table-of-content>" if node.kind == "TableOfContents" else inner

    def automatic() -> str:
        out = "".join(f'<style:style style:name="{n}" style:family="text"><style:text-properties{key}/></style:style>' for key, n in spans.items())
        return out + "".join(f'<style:style style:name="{n}" style:family="paragraph" style:parent-style-name={quoteattr(style)}>{own}</style:style>' for (style, own), n in paras.items())

    body = "".join(map(block, doc.body.kids))
    auto = automatic()
    page = doc.sections[0] if doc.sections else {}
    sides = {n.attrs.get("part", "").removeprefix("word/"): n for n in doc.root.kids if n.kind in ("Header", "Footer")}
    kinds = [(tag, sides.get(page.get(f"{tag.partition('-')[0]}_{kind}"))) for tag, kind in odf_formatting.ASIDES.items()]
    asides = "".join(f"<style:{tag}>{''.join(map(block, n.kids))}</style:{tag}>" for tag, n in kinds if n is not None)
    layout, master = odf_formatting.section_xml(page, asides) if page else ("", "")
    space = " ".join(f'xmlns:{p}="{_O}{x}:1.0"' for p, x in (("office", "office"), ("text", "text"), ("table", "table"), ("style", "style"), ("fo", "xsl-fo-compatible"), ("meta", "meta"), ("draw", "drawing"), ("svg", "svg-compatible"))) + ' xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    kind = "application/vnd.oasis.opendocument.text"
    content = f'{head}<office:document-content {space} office:version="1.2"><office:automatic-styles>{auto}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>'
    dc = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in sorted(doc.meta.items()) if k in ("title", "creator", "subject", "description", "language"))
    meta = f'{head}<office:document-meta {space} office:version="1.2"><office:meta>{dc}</office:meta></office:document-meta>'
    entry = lambda p, t: f'<manifest:file-entry manifest:full-path="{p}" manifest:media-type="{t}"/>'
    files = [("content.xml", content), ("meta.xml", meta)]
    if doc.styles or doc.defaults or page:
        named = odf_formatting.styles_xml(doc.styles, doc.defaults)
        files.append(("styles.xml", f'{head}<office:document-styles {space} office:version="1.2"><office:styles>{named}</office:styles><office:automatic-styles>{layout}{automatic() if asides else ""}</office:automatic-styles><office:master-styles>{master}</office:master-styles></office:document-styles>'))
    entries = "".join(entry(n, "text/xml") for n, _ in files) + "".join(entry(escape(n, {'"': "&quot;"}), _PICTURES.get(e, f"image/{e}")) for n in pictures.values() for e in [n.rpartition(".")[2].lower()])
    files.append(("META-INF/manifest.xml", f'{head}<manifest:manifest xmlns:manifest="{_O}manifest:1.0">{entry("/", kind)}{entries}</manifest:manifest>'))
    stored = [(path, zipfile.ZIP_STORED, doc.media[src]) for src, path in pictures.items()]
    return write_package([("mimetype", zipfile.ZIP_STORED, kind.encode()), *((n, zipfile.ZIP_DEFLATED, _clean(x).encode()) for n, x in files), *stored])
