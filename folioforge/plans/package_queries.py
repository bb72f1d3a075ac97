"""Registered queries over packages made from the tables, and over logs of edits, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators import edits, tree
from folioforge.plans import api
from folioforge.plans.catalogue import query, table

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _entry(path: str | Column, xml: Column) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), xml.cast("binary").alias("data"))


def _joined(rows: DataFrame, doc: Column, order: str, xml: Column) -> DataFrame:
    """(doc_id, xml): the pieces of each document, of which there are as few as its rows, in their order."""
    pieces = F.array_sort(F.collect_list(F.struct(order, xml.alias("piece"))))
    return rows.groupBy(doc.alias("doc_id")).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("xml"))


_EMPTY = f"<w:document {_W}><w:body/></w:document>"


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each nation with a style for each supplier, each based on the one before in the nation."""
    key = F.col("s_suppkey").cast("string")
    before = F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    own = table(spark, sf_dir, "supplier").withColumn("__before", before)
    colour = F.when(F.col("s_suppkey") % 3 == 0, F.format_string('<w:color w:val="%06d"/>', F.col("s_suppkey"))).otherwise("")
    size = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('<w:sz w:val="'), (F.col("s_suppkey") % 90 + 10).cast("string"), F.lit('"/>'))).otherwise("")
    base = F.when(F.col("__before").isNotNull(), F.concat(F.lit('<w:basedOn w:val="S'), F.col("__before").cast("string"), F.lit('"/>'))).otherwise("")
    space = F.concat(F.lit('<w:pPr><w:spacing w:before="'), (F.col("s_suppkey") % 100 * 20).cast("string"), F.lit('"/></w:pPr>'))
    xml = F.concat(F.lit('<w:style w:type="paragraph" w:styleId="S'), key, F.lit('"><w:name w:val="'), F.col("s_name"), F.lit('"/>'), base, space, F.lit("<w:rPr>"), colour, size, F.lit("</w:rPr></w:style>"))
    docs = _joined(own, F.col("s_nationkey"), "s_suppkey", xml)
    sheet = F.concat(F.lit(f"<w:styles {_W}>"), F.col("xml"), F.lit("</w:styles>"))
    return api.pack(docs.select("doc_id", F.array(_entry("word/document.xml", F.lit(_EMPTY)), _entry("word/styles.xml", sheet)).alias("entries")))


def _at(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key))


def _style_facts(docs: DataFrame) -> DataFrame:
    got = api.styles_of(docs)
    return got.select("doc_id", "ix", "style_id", "name", "parent_id", _at("color").alias("colour"), _at("font_size").cast("double").alias("size"), _at("spacing_before").cast("double").alias("before"))


@query(
    "docx_styles",
    """SELECT s_nationkey AS doc_id, row_number() OVER w - 1 AS ix, 'S' || s_suppkey AS style_id, s_name AS name, 'S' || lag(s_suppkey) OVER w AS parent_id,
  CASE WHEN s_suppkey % 3 = 0 THEN printf('%06d', s_suppkey) END AS colour, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 90 + 10) / 2.0::DOUBLE END AS size, (s_suppkey % 100)::DOUBLE AS before
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""",
)
def docx_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style_facts(_styled(spark, sf_dir))


@query(
    "odt_styles",
    """SELECT s_nationkey AS doc_id, row_number() OVER w - 1 AS ix, 'S' || s_suppkey AS style_id, s_name AS name, 'S' || lag(s_suppkey) OVER w AS parent_id,
  CASE WHEN s_suppkey % 3 = 0 THEN printf('%06d', s_suppkey) END AS colour, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 90 + 10) / 2.0::DOUBLE END AS size, (s_suppkey % 100)::DOUBLE AS before
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""",
)
def odt_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The styles of DOCX packages after they were converted to ODT."""
    return _style_facts(api.convert(_styled(spark, sf_dir), "odt", "docx"))


@query(
    "docx_style_chains",
    """SELECT s_nationkey AS doc_id, 'S' || s_suppkey AS style_id, last_value(CASE WHEN s_suppkey % 3 = 0 THEN printf('%06d', s_suppkey) END IGNORE NULLS) OVER w AS colour,
  last_value(CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 90 + 10) / 2.0::DOUBLE END IGNORE NULLS) OVER w AS size, (s_suppkey % 100)::DOUBLE AS before
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING)""",
)
def docx_style_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each style of a package comes to with all that it is based on."""
    got = tree.resolved_attributes(api.styles_of(_styled(spark, sf_dir)).select("doc_id", "style_id", "parent_id", "attrs"))
    return got.select("doc_id", "style_id", _at("color").alias("colour"), _at("font_size").cast("double").alias("size"), _at("spacing_before").cast("double").alias("before"))


@query(
    "docx_sections",
    """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ix, (8000 + o_orderkey % 9000) / 20.0::DOUBLE AS width, 792.0::DOUBLE AS height,
  CASE o_orderstatus WHEN 'F' THEN 'landscape' ELSE 'portrait' END AS orientation, 1 + o_orderkey % 3 AS n_columns, CASE o_orderstatus WHEN 'O' THEN 'continuous' END AS break_type, 72.0::DOUBLE AS margin_top FROM orders""",
)
def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page layouts of packages with a section for each order of a customer, each ended by a paragraph."""
    turned = F.when(F.col("o_orderstatus") == "F", ' w:orient="landscape"').otherwise("")
    broken = F.when(F.col("o_orderstatus") == "O", '<w:type w:val="continuous"/>').otherwise("")
    xml = F.concat(
        F.lit("<w:p><w:pPr><w:sectPr>"), broken, F.lit('<w:pgSz w:w="'), (F.col("o_orderkey") % 9000 + 8000).cast("string"), F.lit('"'), turned,
        F.lit('/><w:cols w:num="'), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit('"/></w:sectPr></w:pPr></w:p>'),
    )
    docs = _joined(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_orderkey", xml)
    body = F.concat(F.lit(f"<w:document {_W}><w:body>"), F.col("xml"), F.lit("</w:body></w:document>"))
    got = api.sections_of(api.pack(docs.select("doc_id", F.array(_entry("word/document.xml", body)).alias("entries"))))
    number = lambda k: _at(k).cast("double")
    return got.select("doc_id", "ix", number("page_width").alias("width"), number("page_height").alias("height"), _at("orientation").alias("orientation"), _at("columns").cast("bigint").alias("n_columns"), _at("break_type").alias("break_type"), number("margin_top").alias("margin_top"))


@query("media_parts", "SELECT p_size AS doc_id, 'media/p' || p_partkey || '.png' AS path, md5(p_name) AS digest, CAST(length(p_name) AS BIGINT) AS n_bytes FROM part")
def media_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = _entry(F.concat(F.lit("word/media/p"), F.col("p_partkey").cast("string"), F.lit(".png")), F.col("p_name"))
    docs = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("doc_id")).agg(F.collect_list(entry).alias("media"))
    packed = api.pack(docs.select("doc_id", F.concat(F.array(_entry("word/document.xml", F.lit(_EMPTY))), "media").alias("entries")))
    return api.media_of(packed).select("doc_id", "path", F.md5("data").alias("digest"), F.octet_length("data").cast("bigint").alias("n_bytes"))


@query(
    "docx_formatting",
    """SELECT o_orderkey AS doc_id, o_orderpriority AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS bold, (10 + o_custkey % 60) / 2.0::DOUBLE AS size, 'Face ' || o_custkey AS font,
  (o_custkey % 1000)::DOUBLE AS indent, CASE WHEN o_orderstatus = 'F' THEN 'exact' END AS line_rule, (1 + o_orderkey % 40) / CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 12.0::DOUBLE END AS line FROM orders""",
)
def docx_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run and paragraph properties of packages that were read, written and read again."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    body = say(
        f'<w:document {_W}><w:body><w:p><w:pPr><w:spacing w:line="', (F.col("o_orderkey") % 40 + 1) * 20, F.when(F.col("o_orderstatus") == "F", '" w:lineRule="exact"/>').otherwise('"/>'),
        '<w:ind w:left="', F.col("o_custkey") % 1000 * 20, '"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="Face ', F.col("o_custkey"), '"/><w:b w:val="', F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("0"),
        '"/><w:sz w:val="', F.col("o_custkey") % 60 + 10, '"/></w:rPr><w:t>', F.col("o_orderpriority"), "</w:t></w:r></w:p></w:body></w:document>",
    )
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(_entry("word/document.xml", body)).alias("entries"))
    again = api.convert(api.pack(docs), "docx", "docx").select("doc_id", "content")
    # One paragraph, run and text a document: its rows are picked out of the nodes without a shuffle.
    nodes = api.open_documents(again, "docx")
    of = lambda kind: F.get(F.filter("nodes", lambda n: n["node_type"] == kind), F.lit(0))
    rows = nodes.select("doc_id", of("Paragraph")["attrs"].alias("para"), of("Run")["attrs"].alias("run"), of("Text")["text"].alias("text"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return rows.select(
        "doc_id", "text", get("run", "bold").alias("bold"), get("run", "font_size").cast("double").alias("size"), get("run", "font_family").alias("font"),
        get("para", "indent_left").cast("double").alias("indent"), get("para", "line_rule").alias("line_rule"), get("para", "line_spacing").cast("double").alias("line"),
    )


@query(
    "docx_tables",
    """SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n_headers, sum(l_partkey % 500)::DOUBLE AS cell_widths,
  any_value(l_orderkey % 100 + 1)::DOUBLE || '%' AS width, string_agg(CAST(l_linenumber AS DOUBLE), ',' ORDER BY l_linenumber) AS column_widths FROM lineitem GROUP BY 1""",
)
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of an order's lines, their properties read, written and read again."""
    number = lambda c, by: (F.col(c) * by).cast("string")
    head = F.when(F.col("l_returnflag") == "N", "<w:trPr><w:tblHeader/></w:trPr>").otherwise("")
    row = F.concat(F.lit("<w:tr>"), head, F.lit('<w:tc><w:tcPr><w:tcW w:type="dxa" w:w="'), (F.col("l_partkey") % 500 * 20).cast("string"), F.lit('"/></w:tcPr><w:p/></w:tc></w:tr>'))
    grid = F.concat(F.lit('<w:gridCol w:w="'), number("l_linenumber", 20), F.lit('"/>'))
    pieces = F.array_sort(F.collect_list(F.struct("l_linenumber", grid.alias("grid"), row.alias("row"))))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(pieces.alias("pieces"))
    joined = lambda k: F.array_join(F.transform("pieces", lambda p: p[k]), "")
    xml = F.concat(
        F.lit(f'<w:document {_W}><w:body><w:tbl><w:tblPr><w:tblW w:type="pct" w:w="'), ((F.col("doc_id") % 100 + 1) * 50).cast("string"),
        F.lit('"/></w:tblPr><w:tblGrid>'), joined("grid"), F.lit("</w:tblGrid>"), joined("row"), F.lit("</w:tbl></w:body></w:document>"),
    )
    packed = api.pack(docs.select("doc_id", F.array(_entry("word/document.xml", xml)).alias("entries")))
    opened = api.open_documents(api.convert(packed, "docx", "docx").select("doc_id", "content"), "docx")
    of = lambda kind: F.filter("nodes", lambda n: n["node_type"] == kind)
    get = lambda n, k: F.try_element_at(n["attrs"], F.lit(k))
    first = F.get(of("Table"), F.lit(0))
    points = F.transform(of("TableCell"), lambda c: F.regexp_replace(get(c, "width"), "pt$", "").cast("double"))
    headers = F.filter(of("TableRow"), lambda r: get(r, "header_row") == "true")
    return opened.select("doc_id", F.size(of("TableRow")).cast("bigint").alias("n_rows"), F.size(headers).cast("bigint").alias("n_headers"), F.aggregate(points, F.lit(0.0), lambda a, x: a + x).alias("cell_widths"), get(first, "width").alias("width"), get(first, "column_widths").alias("column_widths"))


@query(
    "docx_forms",
    """SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'checkbox' WHEN 'O' THEN 'dropdown' ELSE 'text' END AS form_type, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END END AS checked,
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority || ',' || o_custkey END AS options, o_orderpriority AS text FROM orders""",
)
def docx_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form controls of packages that were read, written and read again."""
    box = F.concat(F.lit('<w14:checkbox><w14:checked w14:val="'), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("0"), F.lit('"/></w14:checkbox>'))
    choices = F.concat(F.lit('<w:dropDownList><w:listItem w:displayText="'), F.col("o_orderpriority"), F.lit('"/><w:listItem w:value="'), F.col("o_custkey").cast("string"), F.lit('"/></w:dropDownList>'))
    kind = F.when(F.col("o_orderstatus") == "F", box).when(F.col("o_orderstatus") == "O", choices).otherwise("<w:text/>")
    xml = F.concat(
        F.lit(f'<w:document {_W} xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"><w:body><w:sdt><w:sdtPr>'), kind,
        F.lit("</w:sdtPr><w:sdtContent><w:p><w:r><w:t>"), F.col("o_orderpriority"), F.lit("</w:t></w:r></w:p></w:sdtContent></w:sdt></w:body></w:document>"),
    )
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(_entry("word/document.xml", xml)).alias("entries"))
    opened = api.open_documents(api.convert(api.pack(docs), "docx", "docx").select("doc_id", "content"), "docx")
    of = lambda k: F.get(F.filter("nodes", lambda n: n["node_type"] == k), F.lit(0))
    get = lambda k: F.try_element_at(of("Paragraph")["attrs"], F.lit(k))
    return opened.select("doc_id", get("form_type").alias("form_type"), get("form_checked").alias("checked"), get("form_options").alias("options"), of("Text")["text"].alias("text"))


@query(
    "edit_outcomes",
    """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS txn, o_orderkey % 3 <> 1 AS done, o_orderstatus AS k, o_orderkey % 3 = 0 AS says FROM orders)
SELECT doc_id, txn, done, CASE WHEN txn = max(txn) OVER (PARTITION BY doc_id) THEN
  coalesce(CAST(max(txn) FILTER (WHERE says AND k = 'F') OVER (PARTITION BY doc_id) AS VARCHAR), '') || '/' || coalesce(CAST(max(txn) FILTER (WHERE says AND k = 'O') OVER (PARTITION BY doc_id) AS VARCHAR), '') END AS said FROM o""",
)
def edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that sets metadata, deletes the root, which can't be, or sets attributes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("txn"), "o_orderstatus")
    rest = F.col("txn") % 3
    kind = F.when(rest == 0, "set_meta").when(rest == 1, "delete").otherwise("set_attrs")
    said = F.to_json(F.struct(F.col("o_orderstatus").alias("key"), F.col("txn").cast("string").alias("value")))
    args = F.when(rest == 0, said).when(rest == 2, '{"attrs": {"alignment": "left"}}')
    node = F.when(rest == 1, F.lit(0)).when(rest == 2, F.lit(2)).cast("bigint")
    ops = orders.select("doc_id", "txn", F.lit(0).cast("bigint").alias("seq"), kind.alias("kind"), node.alias("node_id"), args.alias("args"))
    shape = F.array(*[F.struct(F.lit(i).cast("bigint").alias("node_id"), F.lit(p).cast("bigint").alias("parent_id"), F.lit(0).cast("bigint").alias("child_ix"), F.lit(k).alias("node_type")) for i, p, k in ((0, None, "Document"), (1, 0, "Body"), (2, 1, "Paragraph"))])
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(shape)).withColumns({"text": F.lit(None).cast("string"), "attrs": F.lit("{}")})
    got = edits.log_outcomes(own, ops)
    at = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    return got.select("doc_id", "txn", "done", F.when(F.col("meta").isNotNull(), F.concat(at("F"), F.lit("/"), at("O"))).alias("said"))
