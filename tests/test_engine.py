"""Document engine: readers, writers, round trips, edits and the SQL twins of its queries."""

import json

import pytest

from folioforge.operators import edits, write_text
from folioforge.operators.tables import parse_csv
from folioforge.plans import api
from folioforge.sources import model
from folioforge.sources.markdown import read_markdown
from folioforge.sources.packages import read_docx, read_odt, write_docx, write_odt

MARKDOWN = """# Title *one* ##

Some **bold _both_ text** and `co``de` with [a **link**](http://x.y "t") and <http://auto.z>.
Soft line  
hard break \\* &amp; ~~gone~~ 2 * 3 * 4 snake_case_word

Second
======

- item one
- [x] done
  1. inner
  2. more
- last

> quote one
> > deeper

```python
def f():
    return "*raw*"
```

***

| a | b \\| c | d |
|:--|:-:|--:|
| 1 | **2** | 3 |
| x | | |

![alt](img.png) and [ref][R]

[r]: http://ref.example
"""


def blocks(doc):
    return [(n.attrs.get("style_id"), n.plain()) for n in doc.body.kids if n.kind == "Paragraph"]


def runs(node):
    return [(r.plain(), {k: v for k, v in r.attrs.items()}) for r in node.kids if r.kind == "Run"]


def test_markdown_blocks():
    doc = read_markdown(MARKDOWN)
    assert blocks(doc)[:3] == [
        ("Heading1", "Title one"),
        (None, "Some bold both text and co``de with a link and http://auto.z. Soft line\nhard break * & gone 2 * 3 * 4 snake_case_word"),
        ("Heading1", "Second"),
    ]
    items = [(n.attrs["list_format"], n.attrs["list_level"], n.plain()) for n in doc.body.kids if "list_format" in n.attrs]
    assert items == [("bullet", "0", "item one"), ("bullet", "0", "☑ done"), ("decimal", "1", "inner"), ("decimal", "1", "more"), ("bullet", "0", "last")]
    assert [(n.attrs["quote_depth"], n.plain()) for n in doc.body.kids if "quote_depth" in n.attrs] == [("1", "quote one"), ("2", "deeper")]
    assert ("CodePython", 'def f():\n    return "*raw*"') in blocks(doc) and ("HorizontalRule", "") in blocks(doc)
    table = next(n for n in doc.body.kids if n.kind == "Table")
    assert [[c.plain() for c in r.kids] for r in table.kids] == [["a", "b | c", "d"], ["1", "2", "3"], ["x", "", ""]]
    assert [c.kids[0].attrs.get("alignment") for c in table.kids[0].kids] == ["left", "center", "right"]


def test_markdown_inlines():
    para = read_markdown(MARKDOWN).body.kids[1]
    got = runs(para)
    assert ("bold ", {"bold": "true"}) in got and ("both", {"bold": "true", "italic": "true"}) in got
    assert ("link", {"url": "http://x.y", "bold": "true"}) in got and ("gone", {"strikethrough": "true"}) in got
    last = read_markdown(MARKDOWN).body.kids[-1]
    assert ("ref", {"url": "http://ref.example"}) in runs(last) and last.kids[0].attrs == {"src": "img.png", "alt": "alt"}
    emphasis = lambda s: runs(read_markdown(s).body.kids[0])
    assert emphasis("***x*** y") == [("x", {"italic": "true", "bold": "true"}), (" y", {})]
    assert emphasis("**a*b*c**") == [("a", {"bold": "true"}), ("b", {"italic": "true", "bold": "true"}), ("c", {"bold": "true"})]
    assert emphasis("a * b *c") == [("a * b *c", {})]


def test_markdown_round_trip_is_stable():
    once = write_text.to_markdown(read_markdown(MARKDOWN))
    assert write_text.to_markdown(read_markdown(once)) == once
    assert "| a | b \\| c | d |\n|:---|:---:|---:|\n| 1 | **2** | 3 |" in once and "- item one\n- ☑ done\n  1. inner\n  2. more\n- last" in once
    assert once.startswith("# Title *one*\n\nSome **bold *both* text** and ```co``de``` with [a **link**](http://x.y)")


@pytest.mark.parametrize("kind", ["docx", "odt"])
def test_packages_round_trip(kind):
    read, write = {"docx": (read_docx, write_docx), "odt": (read_odt, write_odt)}[kind]
    doc = read_markdown(MARKDOWN)
    doc.meta = {"title": "A & B", "creator": "me"}
    again = read(write(doc))
    keep = lambda d: [(n.kind, n.plain()) for n in d.body.kids]
    # A picture whose bytes aren't there is written to DOCX as its description.
    shown = {" and ref": "[alt] and ref"} if kind == "docx" else {}
    assert keep(again) == [(k, shown.get(t, t)) for k, t in keep(doc)]
    assert [t for k, t in keep(again) if k == "Table"] == [t for k, t in keep(doc) if k == "Table"]
    assert [s for s, _ in blocks(again)][:3] == ["Heading1", None, "Heading1"]
    assert ("both", {"bold": "true", "italic": "true"}) in runs(again.body.kids[1])
    assert again.meta["title"] == "A & B" and write(doc) == write(doc)
    assert write(read(write(again))) == write(again)


def test_docx_revisions_numbering_and_fields():
    doc = model.new_document()
    p = doc.body.add("Paragraph", list_format="upper_roman", list_level="1", list_num_id="7", list_start="4")
    p.run("kept ")
    p.run("new", revision_type="Insert", revision_author="ann", revision_date="2024-01-01T00:00:00Z")
    p.run("old", revision_type="Delete", revision_author="bob")
    p.add("Field", code="PAGEREF x", field_type="page_number")
    p.add("FootnoteRef", ref="2")
    doc.root.add("FootnoteBody", note_id="2").add("Paragraph").run("note")
    again = read_docx(write_docx(doc))
    q = again.body.kids[0]
    assert q.attrs == {"list_level": "1", "list_num_id": "7", "list_format": "upper_roman", "list_start": "4"}
    assert runs(q)[1:] == [("new", {"revision_type": "Insert", "revision_author": "ann", "revision_date": "2024-01-01T00:00:00Z"}), ("old", {"revision_type": "Delete", "revision_author": "bob"})]
    assert [k.attrs.get("field_type") for k in q.kids if k.kind == "Field"] == ["page_number"]
    assert [n.plain() for n in again.root.kids if n.kind == "FootnoteBody"] == ["note"]


def test_text_quirks():
    back = lambda s: write_text.to_text(api.read_text(s))
    assert back("a\n---\nb") == "a\n---\n\nb"
    assert back("5. x\n6. y\n\n3. z\n  - n") == "5. x\n6. y\n\n3. z\n  - n"
    assert model.plain_text(api.read_text("A\n\nB\n\n")) == "A\nB\n" and model.plain_text(api.read_text("\n\nA")) == "A"
    assert api.read_text("####### no").body.kids[0].plain() == "####### no"


def test_csv_is_lenient():
    assert parse_csv('a,"b\n""q""",c\r\n\r\nx') == [["a", 'b\n"q"', "c"], [""], ["x"]]
    assert parse_csv('"a"b,c') == [["a"], ["b", "c"]] and parse_csv('"open') == [["open"]] and parse_csv("") == [] and parse_csv("a\n") == [["a"]]
    assert parse_csv("a,b,") == [["a", "b", ""]]
    assert write_text.to_csv(api.read_csv('a,"x,y"\n1,"q""r"')) == 'a,"x,y"\r\n1,"q""r"\r\n'


def test_json_round_trip():
    doc = read_markdown(MARKDOWN)
    text = write_text.to_json(doc)
    assert write_text.to_json(write_text.from_json(text)) == text
    assert json.loads(text)["nodes"]["0:1"]["nodeType"] == "Body"


def test_rows_round_trip():
    doc = read_markdown(MARKDOWN)
    rows = model.to_rows(doc)
    assert write_text.to_json(model.from_rows(rows[::-1])) == write_text.to_json(doc)


def test_convert_and_errors(spark):
    rows = [(1, MARKDOWN.encode()), (2, b""), (3, None), (4, b"\xff\xfeh\x00i\x00")]
    docs = spark.createDataFrame(rows, "doc_id bigint, content binary")
    docx = api.convert(docs, "docx", "md")
    assert docx.filter("error IS NOT NULL").count() == 0
    text = {r.doc_id: bytes(r.content).decode() for r in api.convert(docx.select("doc_id", "content"), "plain").collect()}
    assert text[1].startswith("Title one\nSome bold") and text[2] == "" and text[4] == "hi"
    bad = api.convert(spark.createDataFrame([(9, b"PK\x03\x04 broken word/")], "doc_id bigint, content binary"), "txt").first()
    assert bad.content is None and "BadZipFile" in bad.error
    parts = api.package_parts(docx.select("doc_id", "content")).filter("doc_id = 1").collect()
    assert {p.path for p in parts} >= {"[Content_Types].xml", "word/document.xml", "word/styles.xml"}
    opened = api.open_documents(docs, "md")
    assert api.nodes_of(opened).filter("node_type = 'Table'").count() == 1
    assert {r.doc_id for r in api.export(opened, "json").collect() if r.error is None} == {1, 2, 3, 4}
    api.register(spark)
    docs.createOrReplaceTempView("raw_documents")
    assert spark.sql("SELECT ff_extract_text(content, 'md') AS t FROM raw_documents WHERE doc_id = 1").first().t.startswith("Title one")
    assert spark.sql("SELECT count(*) AS n FROM raw_documents d, LATERAL ff_nodes(d.content, 'md') WHERE doc_id = 1 AND node_type = 'TableCell'").first().n == 9


def small_tree():
    t = edits.Tree({0: {"parent": None, "kind": "Document", "text": None, "attrs": {}, "kids": []}})
    t.insert(0, 0, 1, "Body")
    t.insert(1, 0, 2, "Paragraph")
    t.insert(2, 0, 3, "Run")
    t.insert(3, 0, 4, "Text", "hello")
    return t


def test_edits_invert():
    import copy

    t = small_tree()
    before = copy.deepcopy(t.nodes)
    ops = [("insert", 5, {"parent": 1, "ix": 1, "kind": "Paragraph"}), ("insert_text", 4, {"at": 5, "text": " é"}), ("delete_text", 4, {"at": 0, "count": 2}), ("set_attrs", 2, {"attrs": {"style_id": "Heading1"}}), ("move", 2, {"parent": 1, "ix": 9}), ("delete", 2, {}), ("set_meta", None, {"key": "title", "value": "T"})]
    h = edits.History(t)
    h.edit(ops)
    assert 2 not in t.nodes and t.meta == {"title": "T"}
    assert h.undo() and t.nodes == before and t.meta == {}
    assert h.redo() and 4 not in t.nodes and h.undo() and t.nodes == before
    for bad in [("insert", 9, {"parent": 2, "ix": 0, "kind": "Table"}), ("delete", 0, {}), ("insert_text", 4, {"at": 99, "text": "x"}), ("move", 1, {"parent": 2, "ix": 0}), ("nope", 1, {})]:
        with pytest.raises(edits.EditError):
            t.transact([("insert_text", 4, {"at": 0, "text": "!"}), bad])
        assert t.nodes == before


def test_edit_log(spark):
    rows = [(d, 0, None, 0, "Document", None, "{}") for d in (1, 2)] + [(d, 1, 0, 0, "Body", None, "{}") for d in (1, 2)]
    nodes = spark.createDataFrame(rows, edits.NODES)
    log = [(1, 1, 0, "insert", 2, json.dumps({"parent": 1, "ix": 0, "kind": "Paragraph"})), (1, 2, 0, "insert", 3, json.dumps({"parent": 1, "ix": 5, "kind": "Paragraph"})), (1, 3, 0, "insert", 4, json.dumps({"parent": 1, "ix": 0, "kind": "Paragraph"})), (1, 4, 0, "undo", None, None)]
    got = edits.apply_log(nodes, spark.createDataFrame(log, edits.OPS)).collect()
    assert sorted((r.doc_id, r.node_id) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from folioforge.plans import catalogue, node_queries  # noqa: F401  (registers more)

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")

    def rows(names, data):
        order = sorted(range(len(names)), key=lambda i: names[i])
        clean = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
        return sorted(tuple(clean(r[i]) for i in order) for r in data)

    for name, f in catalogue.QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        if name in catalogue.SQL:
            cur = con.execute(catalogue.SQL[name])
            names = [c[0] for c in cur.description]
            assert sorted(df.columns) == sorted(names), name
            assert rows(df.columns, df.collect()) == rows(names, cur.fetchall()), name
        else:
            df.count()
    assert entry.entry(spark).count() == 200
