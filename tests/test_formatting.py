"""Styles, sections, direct formatting, headers and pictures of DOCX packages, read and written again."""

from __future__ import annotations

import json
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
import pytest

from folioforge.operators import edits, write_text
from folioforge.plans import api
from folioforge.sources import formatting, model, odf_formatting
from folioforge.sources.markdown import read_markdown
from folioforge.sources.packages import package_parts, read_docx, read_odt, write_docx, write_odt, write_package

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
PARTS = {
    "word/document.xml": f"""<w:document {W} {R} xmlns:a="urn:a" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><w:body>
<w:p><w:pPr><w:pStyle w:val="H"/><w:keepNext/><w:spacing w:before="240" w:line="360" w:lineRule="auto"/><w:ind w:left="720" w:hanging="360"/><w:jc w:val="both"/>
<w:sectPr><w:headerReference w:type="first" r:id="r1"/><w:type w:val="continuous"/><w:pgSz w:w="15840" w:h="12240" w:orient="landscape"/><w:cols w:num="2" w:space="360"/><w:titlePg/></w:sectPr></w:pPr>
<w:r><w:rPr><w:rFonts w:ascii="Georgia"/><w:b w:val="0"/><w:i/><w:sz w:val="25"/><w:shd w:fill="FFEE00"/><w:lang w:val="de-DE"/></w:rPr><w:t>one</w:t></w:r>
<w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="457200"/><wp:docPr id="1" descr="a dot"/><a:blip r:embed="r2"/></wp:inline></w:drawing></w:r></w:p>
<w:p><w:r><w:t>two</w:t></w:r></w:p><w:sectPr><w:pgMar w:top="720"/></w:sectPr></w:body></w:document>""",
    "word/_rels/document.xml.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="r1" Type="h" Target="header1.xml"/><Relationship Id="r2" Type="i" Target="media/dot.png"/></Relationships>',
    "word/header1.xml": f'<w:hdr {W} {R}><w:p><w:hyperlink r:id="r1"><w:r><w:t>head</w:t></w:r></w:hyperlink></w:p></w:hdr>',
    "word/_rels/header1.xml.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="r1" Type="l" Target="http://x.test/"/></Relationships>',
    "word/styles.xml": f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:styleId="N" w:default="1"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H"><w:name w:val="old"/></w:style>
<w:style w:type="paragraph" w:styleId="H"><w:name w:val="Head &amp; line"/><w:basedOn w:val="N"/><w:next w:val="N"/><w:pPr><w:spacing w:after="100"/></w:pPr><w:rPr><w:b/><w:color w:val="112233"/></w:rPr></w:style>
<w:style w:type="numbering" w:styleId="L"><w:name w:val="L"/></w:style></w:styles>""",
}


@pytest.fixture(scope="module")
def content():
    return write_package([(n, zipfile.ZIP_DEFLATED, x.encode()) for n, x in PARTS.items()] + [("word/media/dot.png", zipfile.ZIP_STORED, b"\x89PNG dot")])


def test_docx_formatting_is_read_and_survives_writing(content):
    for doc in (read_docx(content), read_docx(write_docx(read_docx(content)))):
        assert doc.defaults == {"font_size": "11.0"}
        head = next(s for s in doc.styles if s["style_id"] == "H")
        assert head == {"style_id": "H", "name": "Head & line", "kind": "paragraph", "parent_id": "N", "next_id": "N", "is_default": False, "attrs": {"spacing_after": "5.0", "bold": "true", "color": "112233"}}
        assert [(s["style_id"], s["kind"], s["is_default"]) for s in doc.styles if s["style_id"] != "CodeChar"] == [("N", "paragraph", True), ("H", "paragraph", False), ("L", "list", False)]
        para, last = doc.body.kids
        assert para.attrs == {"style_id": "H", "keep_next": "true", "spacing_before": "12.0", "line_spacing": "1.5", "indent_left": "36.0", "indent_first_line": "-18.0", "alignment": "justify", "section_index": "0"}
        assert para.kids[0].attrs == {"font_family": "Georgia", "bold": "false", "italic": "true", "font_size": "12.5", "background": "FFEE00", "language": "de-DE"}
        assert para.kids[1].attrs == {"src": "media/dot.png", "alt": "a dot", "width_emu": "914400", "height_emu": "457200"} and doc.media == {"media/dot.png": b"\x89PNG dot"}
        first, final = doc.sections
        assert first == formatting.SECTION | {"page_width": "792.0", "page_height": "612.0", "orientation": "landscape", "columns": "2", "column_spacing": "18.0", "break_type": "continuous", "title_page": "true", "header_first": "header1.xml"}
        assert final == formatting.SECTION | {"margin_top": "36.0"} and "section_index" not in last.attrs
        header = next(k for k in doc.root.kids if k.kind == "Header")
        assert header.plain() == "head" and next(n for n in header.walk() if n.kind == "Run").attrs == {"url": "http://x.test/"}


def test_written_parts_are_declared(content):
    parts = {p: d for p, _, _, d in package_parts(write_docx(read_docx(content)))}
    types = parts["[Content_Types].xml"].decode()
    assert 'Extension="png"' in types and "/word/header1.xml" in types
    for name, data in parts.items():
        if name.endswith((".xml", ".rels")):
            ET.fromstring(data)
    ids = [r.get("Id") for r in ET.fromstring(parts["word/_rels/document.xml.rels"])]
    assert len(ids) == len(set(ids))


def test_json_holds_styles_and_sections(content):
    doc = read_docx(content)
    text = write_text.to_json(doc)
    back = write_text.from_json(text)
    assert back.styles == doc.styles and back.sections == doc.sections and write_text.to_json(back) == text


def test_odd_values_say_nothing():
    el = ET.fromstring(f'<w:sectPr {W}><w:pgSz w:w="x" w:h=""/><w:cols w:num="-1"/><w:type w:val="odd"/></w:sectPr>')
    assert formatting.section_of(el, {}) == formatting.SECTION
    assert formatting.run_attrs(ET.fromstring(f'<w:rPr {W}><w:sz w:val="x"/><w:shd w:fill="auto"/><w:u w:val="none"/></w:rPr>')) == {"underline": "false"}
    pr = f'<w:pPr {W}><w:tabs><w:tab w:pos="1440" w:val="right" w:leader="dot"/><w:tab w:val="left"/></w:tabs><w:pBdr><w:top w:val="single" w:sz="4" w:color="FF0000"/></w:pBdr><w:spacing w:line="400" w:lineRule="exact"/></w:pPr>'
    got = formatting.paragraph_attrs(ET.fromstring(pr))
    assert got == {"tabs": "72.0:right:dot", "borders": "top:single:0.5:FF0000", "line_spacing": "20.0", "line_rule": "exact"}
    assert formatting.paragraph_attrs(ET.fromstring(f"<w:pPr {W}>{''.join(formatting.paragraph_xml(got))}</w:pPr>")) == got


def test_fact_tables(spark, content):
    docs = spark.createDataFrame([(1, bytearray(content)), (2, bytearray(b"no package")), (3, None)], "doc_id bigint, content binary")
    styles = {(r.doc_id, r.style_id): r for r in api.styles_of(docs).collect()}
    assert set(styles) == {(1, None), (1, "N"), (1, "H"), (1, "L")} and styles[1, None].kind == "defaults"
    assert [(r.ix, r.attrs["margin_top"]) for r in api.sections_of(docs).orderBy("ix").collect()] == [(0, "72.0"), (1, "36.0")]
    assert [(r.doc_id, r.path, bytes(r.data)) for r in api.media_of(docs).collect()] == [(1, "media/dot.png", b"\x89PNG dot")]


def test_odt_formatting_survives_writing(content):
    """What both formats can say is the same after DOCX, ODT, ODT and DOCX again; ODT has one page layout."""
    doc = read_docx(content)
    for again in (read_odt(write_odt(doc)), read_odt(write_odt(read_odt(write_odt(doc)))), read_docx(write_docx(read_odt(write_odt(doc))))):
        assert again.defaults == {"font_size": "11.0"} and again.media == doc.media
        head = next(s for s in again.styles if s["style_id"] == "H")
        assert head["name"] == "Head & line" and head["parent_id"] == "N" and head["attrs"] == {"spacing_after": "5.0", "bold": "true", "color": "112233"}
        para = again.body.kids[0]
        assert para.attrs == {k: v for k, v in doc.body.kids[0].attrs.items() if k != "section_index"}
        assert para.kids[0].attrs == doc.body.kids[0].kids[0].attrs and para.kids[1].attrs == doc.body.kids[0].kids[1].attrs
        kept = ("page_width", "page_height", "orientation", "columns", "margin_top", "margin_left")
        assert [{k: x[k] for k in kept} for x in again.sections] == [{k: doc.sections[0][k] for k in kept}]
        header = next(k for k in again.root.kids if k.kind == "Header")
        assert header.plain() == "head" and again.sections[0]["header_first"] == header.attrs["part"].removeprefix("word/")


def test_odf_values():
    assert [odf_formatting.points(x) for x in ("0.5in", "2.54cm", "25.4mm", "12pt", "96px", "1pc", "abc", "", None)] == ["36.0", "72.0", "72.0", "12.0", "72.0", "12.0", None, None, None]
    space = 'xmlns:s="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:f="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"'
    text = ET.fromstring(f'<s:text-properties {space} s:text-position="-33% 58%" f:language="en" f:country="US" f:font-weight="700" f:letter-spacing="normal" f:color="red"/>')
    assert odf_formatting.run_attrs(text) == {"bold": "true", "vertical_align": "subscript", "language": "en-US"}
    para = ET.fromstring(f'<s:paragraph-properties {space} f:line-height="150%" f:text-align="end" f:keep-together="always" f:margin-left="-1cm"/>')
    assert odf_formatting.paragraph_attrs(para) == {"alignment": "right", "keep_lines": "true", "line_spacing": "1.5", "indent_left": "-28.3465"}


def _docx(body: str) -> bytes:
    spaces = f'{W} xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
    return write_package([("word/document.xml", zipfile.ZIP_DEFLATED, f"<w:document {spaces}><w:body>{body}</w:body></w:document>".encode())])


def test_tables_forms_and_equations():
    table = """<w:tbl><w:tblPr><w:tblStyle w:val="Grid"/><w:tblW w:w="2500" w:type="pct"/><w:jc w:val="center"/><w:tblBorders><w:top w:val="single" w:sz="8" w:color="000000"/></w:tblBorders></w:tblPr>
<w:tblGrid><w:gridCol w:w="1440"/><w:gridCol w:w="720"/></w:tblGrid><w:tr><w:trPr><w:cantSplit/><w:trHeight w:val="400" w:hRule="exact"/><w:tblHeader/></w:trPr>
<w:tc><w:tcPr><w:tcW w:w="1440" w:type="dxa"/><w:shd w:fill="AABBCC"/><w:vAlign w:val="center"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"""
    forms = "".join(f"<w:sdt><w:sdtPr>{pr}</w:sdtPr><w:sdtContent>{c}</w:sdtContent></w:sdt>" for pr, c in (
        ('<w14:checkbox><w14:checked w14:val="1"/></w14:checkbox>', "<w:p><w:r><w:t>yes</w:t></w:r></w:p>"),
        ('<w:dropDownList><w:listItem w:displayText="a"/><w:listItem w:value="b"/></w:dropDownList>', ""), ("<w:text/>", "<w:p/>"),
    ))
    maths = "<w:p><m:oMath><m:r><m:t>e=1</m:t></m:r></m:oMath><w:r><w:t> holds</w:t></w:r></w:p>"
    doc = read_docx(_docx(table + forms + maths))
    for again in (doc, read_docx(write_docx(doc))):
        grid, check, choice, field, equation = again.body.kids
        assert grid.attrs == {"style_id": "Grid", "width": "50.0%", "alignment": "center", "borders": "top:single:1.0:000000", "column_widths": "72.0,36.0"}
        assert grid.kids[0].attrs == {"header_row": "true", "keep_lines": "true", "height": "20.0", "height_rule": "exact"}
        assert [c.attrs for c in grid.kids[0].kids] == [{"width": "72.0pt", "vertical_align": "center", "background": "AABBCC"}, {}]
        assert (check.attrs, check.plain()) == ({"form_type": "checkbox", "form_checked": "true"}, "yes")
        assert choice.attrs == {"form_type": "dropdown", "form_options": "a,b"} and field.attrs == {"form_type": "text"}
        assert [k.kind for k in equation.kids] == ["Equation", "Run"] and equation.plain() == " holds"
        assert "".join(ET.fromstring(equation.kids[0].attrs["source"]).itertext()) == "e=1"
    equation.kids[0].attrs["source"] = "<broken"
    assert read_docx(write_docx(again)).body.kids[-1].plain() == " holds"


def test_odt_annotations_and_changes():
    names = {"office": "office", "text": "text"}
    space = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{x}:1.0"' for p, x in names.items()) + ' xmlns:dc="http://purl.org/dc/elements/1.1/"'
    body = """<text:tracked-changes><text:changed-region text:id="c1"><text:deletion><office:change-info><dc:creator>me</dc:creator><dc:date>2024-01-01</dc:date></office:change-info><text:p>gone</text:p></text:deletion></text:changed-region>
<text:changed-region text:id="c2"/></text:tracked-changes><text:p>a<office:annotation office:name="n1"><dc:creator>you</dc:creator><dc:date>2024-02-02</dc:date><text:p>why</text:p></office:annotation>b<office:annotation-end office:name="n1"/></text:p>"""
    xml = f"<office:document-content {space}><office:body><office:text>{body}</office:text></office:body></office:document-content>"
    doc = read_odt(write_package([("content.xml", zipfile.ZIP_DEFLATED, xml.encode())]))
    assert json.loads(doc.body.attrs["tracked_changes"]) == [{"id": "c1", "type": "deletion", "author": "me", "date": "2024-01-01"}]
    assert [k.kind for k in doc.body.kids[0].kids] == ["Run", "CommentStart", "Run", "CommentEnd"] and doc.body.kids[0].plain() == "ab"
    note = doc.root.kids[1]
    assert (note.kind, note.attrs, note.plain()) == ("CommentBody", {"note_id": "n1", "author": "you", "date": "2024-02-02"}, "why")


def test_brackets_take_linear_time():
    assert read_markdown("[" * 20_000).body.kids[0].plain() == "[" * 20_000
    runs = {r.plain(): r.attrs.get("url") for r in read_markdown("[[a] b](u) \\[c](v) [d\\]e](w) `[`x](y)").body.kids[0].kids}
    assert runs["[a] b"] == "u" and runs["d]e"] == "w" and all(u in (None, "u", "w") for u in runs.values())


def test_a_failing_undo_keeps_its_place():
    t = edits.Tree({0: {"parent": None, "kind": "Document", "text": None, "attrs": {}, "kids": []}})
    t.insert(0, 0, 1, "Body")
    h = edits.History(t)
    h.edit([("insert", 2, {"parent": 1, "ix": 0, "kind": "Paragraph"})])
    del t.nodes[2]
    t.nodes[1]["kids"].clear()
    with pytest.raises(edits.EditError):
        h.undo()
    assert len(h.undo_stack) == 1 and not h.redo_stack
    h.clear()
    assert not h.undo() and not h.redo()


def test_plain_packages_are_read_and_written_without_zipfile(monkeypatch):
    import io

    from folioforge.sources import packages

    def zipped(parts, **more):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", **more) as z:
            for path, how, data in parts:
                info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
                info.compress_type = how
                z.writestr(info, data)
        return out.getvalue()

    parts = [("word/document.xml", 8, b"<a/>" * 3000), ("word/empty", 8, b""), ("x/y.bin", 0, b"\x00PK\x01\x02" * 9)]
    plain = zipped(parts)
    assert write_package(parts) == write_package(parts, shared=True) == plain
    odd = [("m\u00fc.xml", 8, b"<b/>"), ("folder/", 0, b"")]
    assert write_package(parts + odd) == zipped(parts + odd) and write_package([]) == zipped([])
    for data in (zipped(parts + odd), b"junk" + plain, zipped(parts) + b"\x00"):  # what zipfile alone can read
        with packages._Package(data) as z, zipfile.ZipFile(io.BytesIO(data)) as want:
            assert z.namelist() == want.namelist() and all(z.read(n) == want.read(n) for n in want.namelist())
    broken = bytearray(plain)
    broken[broken.index(b"word/document.xml") + 20] ^= 0xFF
    for name, kind in (("word/document.xml", (zipfile.BadZipFile, packages.zlib.error)), ("nothing", KeyError)):
        with packages._Package(bytes(broken)) as z, pytest.raises(kind):
            z.read(name)
    for data in (b"", b"no package", plain[:-9]):
        with pytest.raises(zipfile.BadZipFile):
            packages._Package(data)

    def never(*_, **__):
        raise AssertionError("zipfile was used")

    monkeypatch.setattr(zipfile, "ZipFile", never)
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>'
    doc = read_docx(write_docx(read_docx(write_package([("word/document.xml", 8, body.encode())]))))
    doc.styles[0]["attrs"]["changed"] = "yes"  # one document's styles are its own, though the part is remembered
    again = read_docx(write_docx(read_docx(write_package([("word/document.xml", 8, body.encode())]))))
    assert "changed" not in again.styles[0]["attrs"] and [n.text for n in again.root.walk() if n.kind == "Text"] == ["x"]


def test_nodes_in_columns_are_the_rows():
    doc = read_docx(write_package([(n, zipfile.ZIP_DEFLATED, x.encode()) for n, x in PARTS.items()]))
    kind = pa.list_(pa.struct([*((n, pa.int64()) for n in ("node_id", "parent_id", "child_ix", "depth")), ("node_type", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))
    for docs in ([], [None], [doc, None, model.new_document(), doc]):
        got = model.NodeLists()
        for d in docs:
            got.add(d)
        assert got.column().equals(pa.array([None if d is None else model.to_rows(d) for d in docs], kind))
