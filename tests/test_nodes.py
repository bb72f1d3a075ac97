"""Node tables, styles and detection on small tables with nulls, empty ones, ties and deep trees."""

import io
import random
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.functions import formats, text
from folioforge.operators import edits, nodes, revisions, styles, tree
from folioforge.plans import api
from folioforge.sources import detect

TREE = "doc_id bigint, node_id bigint, parent_id bigint, child_ix bigint, depth bigint, node_type string, text string, revision_type string, author string"


def small(spark):
    rows = [
        (1, 0, None, 0, 0, "Document", None, None, None), (1, 1, 0, 0, 1, "Body", None, None, None), (1, 2, 1, 0, 2, "Table", None, None, None),
        (1, 3, 2, 0, 3, "TableRow", None, None, None), (1, 4, 3, 0, 4, "TableCell", None, None, None), (1, 5, 4, 0, 5, "Paragraph", None, None, None),
        (1, 6, 5, 0, 6, "Run", None, "Delete", "a"), (1, 7, 6, 0, 7, "Text", "h", None, None), (1, 8, 3, 1, 4, "TableCell", None, None, None),
        (1, 9, 8, 0, 5, "Paragraph", None, None, None), (1, 10, 9, 0, 6, "Run", None, "Insert", "b"), (1, 11, 10, 0, 7, "Text", "i", None, None),
        (2, 0, None, 0, 0, "Document", None, None, None),
    ]
    return spark.createDataFrame(rows, TREE)


def test_text_of_cells_and_decided_changes(spark):
    own = small(spark)
    assert {r.doc_id: r.text for r in tree.plain_text(own).collect()} == {1: "h\ni"}
    ids = lambda df: sorted(r.node_id for r in df.filter("doc_id = 1").collect())
    assert ids(revisions.decide(own, True)) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11] and ids(revisions.decide(own, False)) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    one = revisions.decide_one(own, spark.createDataFrame([(1, 6, True), (1, 5, True), (9, 9, True)], "doc_id bigint, node_id bigint, accept boolean"))
    assert ids(one) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11] and [(r.revision_type, r.author) for r in one.filter("node_id = 10").collect()] == [("Insert", "b")]
    assert revisions.decide(own.limit(0), True).count() == 0 and tree.plain_text(own.limit(0)).count() == 0
    assert {r.node_id: r.top_id for r in nodes.top_blocks(own).collect()} == {k: 2 for k in range(2, 12)}


def test_long_chains_and_cycles(spark):
    rows = [(1, f"s{k}", f"s{k - 1}" if k else None) for k in range(60)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "none"), (None, "x", None)]
    got = {(r.doc_id, r.style_id): r.chain for r in tree.style_chains(spark.createDataFrame(rows, "doc_id bigint, style_id string, parent_id string")).collect()}
    assert got[1, "s59"] == [f"s{k}" for k in range(59, -1, -1)] and got[2, "a"] == ["a", "b"] and got[2, "c"] == ["c"] and got[None, "x"] == ["x"]


def test_malformed_bytes_give_null_text(spark):
    good = "aé😀".encode("utf-16-le")
    rows = [(1, b"\xef\xbb\xbf\xff"), (2, b"\xff\xfe" + good), (3, b"\xff\xfe" + good[:-2]), (4, b"\xff\xfe\x00"), (5, b"\xfe\xff\xd8\x00\x00a"), (6, b"\xe9"), (7, b""), (8, b"\xff\xfe")]
    got = {r.id: (r.d.text, r.d.encoding) for r in spark.createDataFrame(rows, "id int, c binary").select("id", formats.decode_text(F.col("c")).alias("d")).collect()}
    assert got == {
        1: (None, "utf-8-bom"), 2: ("aé😀", "utf-16le"), 3: (None, "utf-16le"), 4: (None, "utf-16le"), 5: (None, "utf-16be"), 6: ("é", "latin-1"), 7: ("", "utf-8"), 8: ("", "utf-16le"),
    }


def test_file_types(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
    docs = spark.createDataFrame([(1, out.getvalue()), (2, None), (3, out.getvalue()[:90]), (4, b"PK\x03\x04")], "doc_id bigint, content binary")
    assert {r.doc_id: r.file_type for r in detect.detect_file_type(docs).collect()} == {1: "ods", 2: None, 3: "ods", 4: "bin"}
    made = api.convert(spark.createDataFrame([(1, b"# a\n\n- b\n")], "doc_id bigint, content binary"), "docx", "md")
    assert [r.file_type for r in detect.detect_file_type(made).collect()] == ["docx"]
    api.register(spark)
    assert spark.sql("SELECT * FROM ff_nodes(X'00ff', 'docx')").count() == 0


def test_small_values(spark):
    rows = spark.createDataFrame([(1, "", None), (2, "ab", "2px solid #ff0000"), (3, "1 я", "wide"), (4, None, "  ")], "id int, t string, css string")
    got = {r.id: r for r in rows.select("id", text.script_runs(F.col("t")).alias("runs"), text.css_border(F.col("css")).alias("c")).collect()}
    assert got[1].runs == [] and [tuple(x) for x in got[3].runs] == [(0, 4, "Cyrillic")] and got[4].runs is None
    assert tuple(got[2].c) == (2.0, 1.0, 0.0, 0.0) and tuple(got[3].c) == tuple(got[4].c) == (0.5, 0.0, 0.0, 0.0)
    log = spark.createDataFrame([(1, 1, "remove", "x", None), (1, 2, "set", "x", "v"), (1, 3, "remove", "x", None), (1, 4, "remove", "x", None)], "doc_id int, seq int, kind string, style_id string, attrs string")
    now, errors = styles.apply_style_log(log.select("doc_id", F.lit("y").alias("style_id"), "attrs").limit(0), log)
    assert now.count() == 0 and sorted(r.seq for r in errors.collect()) == [1, 4]


def test_bytes_that_spell_a_folder_are_no_entry(spark):
    def package(*entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in entries:
                z.writestr(name, body)
        return out.getvalue()

    odt = package(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", "xl/ word/ ppt/"))
    bare = package(("content.xml", "xl/"))
    rows = [(1, odt), (2, bare), (3, package(("xl/workbook.xml", "word/"))), (4, package(("word/document.xml", "xl/"))), (5, b"PK\x03\x04 cut off xl/")]
    docs = spark.createDataFrame(rows, "doc_id bigint, content binary")
    got = {r.doc_id: r.f for r in docs.select("doc_id", formats.format_of_bytes(F.col("content")).alias("f")).collect()}
    assert got == {1: "odt", 2: "odt", 3: "xlsx", 4: "docx", 5: "xlsx"}


def test_chains_of_a_large_document_take_few_rounds(spark, monkeypatch):
    """2000 styles of one document, none more than eight steps from its root or from going round."""
    rounds, write = [], tree.Scratch.write
    monkeypatch.setattr(tree.Scratch, "write", lambda self, df, label: rounds.append(label) or write(self, df, label))
    rows = [(0, f"{k}", {3: "9", 1: None, 2: "none"}.get(k, f"{k // 3}"), {f"k{k % 3}": f"{k}"}) for k in range(1, 2001)]
    own = spark.createDataFrame(rows, "doc_id bigint, style_id string, parent_id string, attrs map<string,string>")
    parents = {i: p for _, i, p, _ in rows}

    def walk(i):
        out = []
        while i in parents and i not in out:
            out.append(i)
            i = parents[i]
        return out

    assert {r.style_id: r.chain for r in tree.style_chains(own).collect()} == {i: walk(i) for i in parents}
    assert len(rounds) <= 7
    want = {i: {} for i in parents}
    for i in parents:
        for x in walk(i):
            want[i].setdefault(f"k{int(x) % 3}", x)
    assert {r.style_id: r.attrs for r in tree.resolved_attributes(own).collect()} == want


def test_cycles_of_any_length_behind_a_tail(spark):
    """The tail's styles are smaller than all of the cycle's; attributes of null maps and null values count as they are."""
    rows = []
    for c in range(1, 10):
        rows += [(c, f"a{k}", f"a{k + 1}" if k < 4 else "c0", None if k % 2 else {"t": None, f"a{k}": "x"}) for k in range(5)]
        rows += [(c, f"c{k}", f"c{(k + 1) % c}", {f"c{k}": f"{k}", "t": "cycle"}) for k in range(c)]
    got = {(r.doc_id, r.style_id): r for r in tree.style_chains(spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, style_id string, parent_id string")).collect()}
    attrs = {(r.doc_id, r.style_id): r.attrs for r in tree.resolved_attributes(spark.createDataFrame(rows, "doc_id bigint, style_id string, parent_id string, attrs map<string,string>")).collect()}
    for c in range(1, 10):
        assert got[c, "a0"].chain == [f"a{k}" for k in range(5)] + [f"c{k}" for k in range(c)]
        assert got[c, f"c{c - 1}"].chain == [f"c{c - 1}"] + [f"c{k}" for k in range(c - 1)]
        assert attrs[c, "a0"] == {"t": None} | {f"a{k}": "x" for k in (0, 2, 4)} | {f"c{k}": f"{k}" for k in range(c)}
        assert attrs[c, f"c{c - 1}"] == {"t": "cycle"} | {f"c{k}": f"{k}" for k in range(c)}


def test_long_chains_are_only_written_as_results(spark, monkeypatch):
    """Chains of 3000 styles: what is written on the way stays near the size of the table of styles."""
    sizes, write = [], tree.Scratch.write

    def measured(self, df, label):
        out = write(self, df, label)
        if "value" in out.columns:
            sizes.append(out.agg(F.sum(F.size("value"))).first()[0] or 0)
        return out

    monkeypatch.setattr(tree.Scratch, "write", measured)
    own = spark.range(6000).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("style_id"), F.when(F.col("id") > 1, F.col("id") - 2).alias("parent_id"))
    got = tree.style_chains(own).agg(F.count("*"), F.sum(F.size("chain")), F.max(F.when(F.col("style_id") == 5999, F.col("chain")))).first()
    assert got[:2] == (6000, 3000 * 3001) and got[2] == list(range(5999, 0, -2))
    assert max(sizes) <= 32 * 6000


@pytest.mark.parametrize("sep", [None, "", ", "])
def test_long_chains_of_any_shape(spark, sep):
    """Trees, lone chains, cycles with tails and branches, ids that are null, empty, not there or twice, beside short chains."""
    at, rows = random.Random(7), [(None, "x", None), (None, "y", "x"), (0, "", None), (0, "a", "")]
    for doc in range(1, 7):
        n = 300
        ids = [f"é{k}" if k else "" for k in range(n)]
        near = [1, 2, 40, 5, 1, 300][doc - 1]
        rows += [(doc, ids[k], ids[at.randrange(max(0, k - near), k)] if k else [None, ids[70], "none", ids[299], ids[0], None][doc - 1]) for k in range(n)]
        rows += [(doc, None, ids[200]), (doc, None, None), (doc, "alone", None), (doc, "lost", "none"), (doc, "self", "self"), (doc, "two", "self")]
    rows += [(7, f"{k}", f"{k - 1}" if k else None) for k in range(50)] + [(7, "twice", "48"), (7, "twice", "3"), (7, "end", "twice")]
    at.shuffle(rows)
    parents = {}
    for doc, i, p in rows:
        parents.setdefault((doc, i), []).append(p)

    def walks(doc, i, p, seen):
        seen = [*seen, i]
        if doc is None or p is None or (doc, p) not in parents or p in seen:
            return [seen]
        return [w for q in parents[doc, p] for w in walks(doc, p, q, seen)]

    said = lambda chain: tuple(chain) if sep is None else sep.join(x for x in chain if x is not None)
    want = Counter((doc, i, said(w)) for doc, i, p in rows for w in walks(doc, i, p, []))
    own = spark.createDataFrame(rows, "doc_id bigint, style_id string, parent_id string")
    assert Counter((r.doc_id, r.style_id, tuple(r.chain) if sep is None else r.chain) for r in tree.style_chains(own, sep).collect()) == want


def test_parts_of_a_document_have_like_shares_of_links(monkeypatch):
    monkeypatch.setattr(tree, "COPY", 10)
    n = 500
    ids = pa.array(range(n))
    for up, links in (([None, *range(n - 1)], [k + 1 for k in range(n)]), ([n - 1, *range(n - 1)], [n] * n), ([None, *[0] * (n - 1)], [1] + [2] * (n - 1))):
        row = tree._paths(pa.table({"doc_id": pa.array([1] * n), "style_id": ids, "parent_id": pa.array(up, "int64"), "label": ids})).to_pylist()[0]
        of = [sum(links[i] for i in row["ids"][p["lo"] : p["hi"]]) for p in row["parts"]]
        assert sum(of) == sum(links) and len(of) == -(-sum(links) // (10 * n)) and max(of) <= sum(links) / len(of) + 2 * n


def test_outcomes_come_without_a_call_for_each_document(spark):
    own = spark.createDataFrame([(d, 0, None, 0, "Document", None, "{}") for d in (1, 2, None)] + [(1, 1, 0, 0, "Body", None, None)], edits.NODES)
    log = [
        (1, 1, 1, "set_meta", None, '{"key": "b", "value": "2"}'), (1, 1, 0, "set_meta", None, '{"key": "a", "value": "1"}'), (1, 3, 0, "delete", 0, None), (1, 2, 0, "undo", None, None),
        (1, 4, 0, "redo", None, None), (1, 5, 0, "undo", None, None), (1, 6, 0, "undo", None, None), (None, 1, 0, "set_meta", None, '{"key": "c", "value": "3"}'), (3, 8, 0, "undo", None, None), (1, None, 0, "undo", None, None),
    ]
    got = edits.log_outcomes(own, spark.createDataFrame(log, edits.OPS))
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    rows = {(r.doc_id, r.txn): (r.done, r.meta) for r in got.collect()}
    assert rows == {(1, 1): (True, None), (1, 2): (True, None), (1, 3): (False, None), (1, 4): (True, None), (1, 5): (True, None), (1, 6): (False, {}), (None, 1): (True, {"c": "3"}), (3, 8): (False, {})}
