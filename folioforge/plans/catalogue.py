"""Registered queries of the document engine, each with its SQL twin where SQL can express it.

Test tables hold prose without markup, so both sides splice the same markers into each text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import formats, markers, values
from folioforge.operators import edits, outline, revisions, tables, tree
from folioforge.plans import api
from folioforge.sources import plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_HEAD = ["# H ", "{lang}", "\n## ", "{source}", "\r\n3. first\n4. second\n  - nested\n  7. deep\n"]
_TAIL = ["\n---\n1. again\n#### low\n- item ", "{source}", "\n`a``b`\n0. zero\nlast\r"]


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with markers spliced into the texts."""
    piece = lambda s: F.col(s[1:-1]) if s[0] == "{" else F.lit(s)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.concat(*map(piece, _HEAD), F.col("text"), *map(piece, _TAIL)).alias("text"))


def _sql_piece(s: str) -> str:
    if s[0] == "{":
        return s[1:-1]
    out = s.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    return f"'{out}'"


_MARKED = "marked AS (SELECT doc_id, lang, source, " + " || ".join([*map(_sql_piece, _HEAD), "text", *map(_sql_piece, _TAIL)]) + " AS text FROM documents)"
_NUM = "TRY_CAST(regexp_extract(line, '(?s)^( *)([0-9]+)\\. (.*)$', 2) AS DECIMAL(38,0)) <= 4294967295"
_LINES = f"""{_MARKED},
raw AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM marked),
each AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM raw),
kinds AS (SELECT doc_id, line_no, line,
  CASE WHEN line = '---' THEN 'break' WHEN regexp_matches(line, '(?s)^\\s*(#{{1,6}}) (.*)$') THEN 'heading'
       WHEN regexp_matches(line, '(?s)^( *)- (.*)$') THEN 'bullet'
       WHEN regexp_matches(line, '(?s)^( *)([0-9]+)\\. (.*)$') AND {_NUM} THEN 'number' ELSE 'text' END AS kind FROM each),
lines AS (SELECT doc_id, line_no, kind,
  CASE kind WHEN 'heading' THEN length(regexp_extract(line, '(?s)^\\s*(#{{1,6}}) (.*)$', 1))
            WHEN 'bullet' THEN (length(regexp_extract(line, '(?s)^( *)- (.*)$', 1)) // 2) % 256
            WHEN 'number' THEN (length(regexp_extract(line, '(?s)^( *)([0-9]+)\\. (.*)$', 1)) // 2) % 256 END AS level,
  CASE kind WHEN 'bullet' THEN 1 WHEN 'number' THEN CAST(regexp_extract(line, '(?s)^( *)([0-9]+)\\. (.*)$', 2) AS BIGINT) END AS start,
  CASE kind WHEN 'break' THEN '' WHEN 'heading' THEN regexp_extract(line, '(?s)^\\s*(#{{1,6}}) (.*)$', 2)
            WHEN 'bullet' THEN regexp_extract(line, '(?s)^( *)- (.*)$', 2)
            WHEN 'number' THEN regexp_extract(line, '(?s)^( *)([0-9]+)\\. (.*)$', 3) ELSE line END AS content FROM kinds)"""


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.lines(marked(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of each document: paragraphs and characters."""
    return plain_text_stats(spark, sf_dir)


@query(
    "plain_text_stats",
    f"""WITH {_LINES},
t AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY line_no) FILTER (WHERE content <> '') AS body, count(*) AS n,
             arg_max(content, line_no) AS last FROM lines GROUP BY doc_id)
SELECT d.doc_id, d.lang, coalesce(t.n, 0) AS n_paragraphs,
       coalesce(length(t.body) + CASE WHEN t.last = '' THEN 1 ELSE 0 END, CASE WHEN d.text IS NULL THEN NULL ELSE 0 END) AS n_chars_plain
FROM marked d LEFT JOIN t USING (doc_id)""",
)
def plain_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    return docs.select("doc_id", "lang", F.coalesce(F.size(markers.normal_lines(F.col("text"))).cast("long"), F.lit(0)).alias("n_paragraphs"), F.length(markers.plain_text(F.col("text"))).cast("long").alias("n_chars_plain"))


@query(
    "plain_text",
    f"""WITH {_LINES}
SELECT doc_id, coalesce(string_agg(content, chr(10) ORDER BY line_no) FILTER (WHERE content <> ''), '')
       || CASE WHEN arg_max(content, line_no) = '' AND count(*) FILTER (WHERE content <> '') > 0 THEN chr(10) ELSE '' END AS text
FROM lines GROUP BY doc_id""",
)
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", markers.plain_text(F.col("text")).alias("text"))


@query("text_lines", f"WITH {_LINES} SELECT * FROM lines")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lined(spark, sf_dir)


_NODES = f"""{_LINES},
para AS (SELECT *, 2 + coalesce(CAST(sum(CASE WHEN content = '' THEN 1 ELSE 3 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS p FROM lines),
nodes AS (
  SELECT doc_id, 0 AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS child_ix, 0 AS depth, 'Document' AS node_type, CAST(NULL AS VARCHAR) AS text FROM para WHERE line_no = 0
  UNION ALL SELECT doc_id, 1, 0, 0, 1, 'Body', NULL FROM para WHERE line_no = 0
  UNION ALL SELECT doc_id, p, 1, line_no, 2, 'Paragraph', NULL FROM para
  UNION ALL SELECT doc_id, p + 1, p, 0, 3, 'Run', NULL FROM para WHERE content <> ''
  UNION ALL SELECT doc_id, p + 2, p + 1, 0, 4, 'Text', content FROM para WHERE content <> '')"""


@query(
    "txt_nodes",
    f"WITH {_NODES} SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(child_ix AS BIGINT) AS child_ix, CAST(depth AS BIGINT) AS depth, node_type, text FROM nodes",
)
def txt_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.nodes(lined(spark, sf_dir)).select("doc_id", "node_id", "parent_id", "child_ix", "depth", "node_type", "text")


@query("node_counts", f"WITH {_NODES} SELECT doc_id, count(*) AS n_nodes, CAST(sum(length(text)) AS BIGINT) AS text_len FROM nodes GROUP BY doc_id")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.node_counts(plain.nodes(lined(spark, sf_dir)))


@query("child_counts", f"WITH {_NODES} SELECT doc_id, CAST(parent_id AS BIGINT) AS node_id, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(plain.nodes(lined(spark, sf_dir))).select("doc_id", "node_id", "n_children")


@query(
    "descendants",
    f"""WITH RECURSIVE {_NODES},
up AS (SELECT doc_id, CAST(parent_id AS BIGINT) AS anc, CAST(node_id AS BIGINT) AS node_id FROM nodes WHERE parent_id IS NOT NULL
       UNION ALL SELECT u.doc_id, CAST(n.parent_id AS BIGINT), u.node_id FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node_id = u.anc WHERE n.parent_id IS NOT NULL)
SELECT doc_id, anc AS node_id, count(*) AS n_descendants FROM up GROUP BY ALL""",
)
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendants(plain.nodes(lined(spark, sf_dir)), 4)


_GRAMMAR = ", ".join(f"('{p}', '{c}')" for p, cs in tree.GRAMMAR.items() for c in cs.split())


@query(
    "grammar_violations",
    f"""WITH {_NODES}, g(parent_type, node_type) AS (VALUES {_GRAMMAR}),
o AS MATERIALIZED (SELECT doc_id, node_id, parent_id, CASE WHEN node_type = 'Run' AND node_id % 7 = 0 THEN 'TableCell' ELSE node_type END AS node_type FROM nodes)
SELECT a.doc_id, CAST(a.node_id AS BIGINT) AS node_id, b.node_type AS parent_type, a.node_type
FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.parent_id = b.node_id
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.parent_type = b.node_type AND g.node_type = a.node_type)""",
)
def grammar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when((F.col("node_type") == "Run") & (F.col("node_id") % 7 == 0), "TableCell").otherwise(F.col("node_type"))
    return tree.grammar_violations(plain.nodes(lined(spark, sf_dir)).withColumn("node_type", odd))


@query(
    "nodes_plain_text",
    f"""WITH {_LINES}
SELECT doc_id, coalesce(string_agg(content, chr(10) ORDER BY line_no) FILTER (WHERE content <> ''), '')
       || CASE WHEN arg_max(content, line_no) = '' AND count(*) FILTER (WHERE content <> '') > 0 THEN chr(10) ELSE '' END AS text
FROM lines GROUP BY doc_id""",
)
def nodes_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.plain_text(plain.nodes(lined(spark, sf_dir)), 4)


@query("headings", f"WITH {_LINES} SELECT doc_id, line_no, level, content AS title FROM lines WHERE kind = 'heading'")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.headings(lined(spark, sf_dir))


@query(
    "toc_entries",
    f"WITH {_LINES} SELECT doc_id, line_no, 'TOC' || level AS style_id, repeat('  ', CAST(level - 1 AS INT)) || content AS entry FROM lines WHERE kind = 'heading' AND level <= 3",
)
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.toc_entries(lined(spark, sf_dir))


@query(
    "section_outline",
    f"""WITH {_LINES}
SELECT doc_id, line_no, CAST(sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section_ix,
       last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS) OVER w AS under
FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.sections(lined(spark, sf_dir))


def _numbers_sql(reset: bool) -> str:
    group = "sum(CASE WHEN kind IN ('bullet', 'number') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no)" if reset else "0"
    return f"""grouped AS (SELECT *, {group} AS grp FROM lines),
numbers AS (SELECT doc_id, line_no, level, CAST(row_number() OVER k + greatest(first_value(start) OVER k - 1, 0) AS BIGINT) AS number
  FROM grouped WHERE kind = 'number' WINDOW k AS (PARTITION BY doc_id, grp, level ORDER BY line_no))"""


@query("list_numbers_text", f"WITH {_LINES}, {_numbers_sql(True)} SELECT doc_id, line_no, level, number, CAST(number AS VARCHAR) AS label FROM numbers")
def list_numbers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.numbered(lined(spark, sf_dir)).select("doc_id", "line_no", "level", "number", "label")


@query(
    "list_numbers_markdown",
    f"WITH {_LINES}, {_numbers_sql(False)} SELECT doc_id, line_no, level, number, chr(CAST(97 + (number - 1) % 26 AS INT)) AS label FROM numbers WHERE number > 0",
)
def list_numbers_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline.numbered(lined(spark, sf_dir), fmt=F.lit("lower_alpha"), reset=False)
    return rows.filter("number > 0").select("doc_id", "line_no", "level", "number", "label")


@query(
    "txt_export",
    f"""WITH {_LINES}, {_numbers_sql(True)}
SELECT doc_id, string_agg(CASE kind WHEN 'break' THEN '---' || chr(10)
    WHEN 'heading' THEN repeat('#', CAST(l.level AS INT)) || ' ' || content WHEN 'bullet' THEN repeat('  ', CAST(l.level AS INT)) || '- ' || content
    WHEN 'number' THEN repeat('  ', CAST(l.level AS INT)) || n.number || '. ' || content ELSE content END, chr(10) ORDER BY line_no) AS text
FROM lines l LEFT JOIN numbers n USING (doc_id, line_no) GROUP BY doc_id""",
)
def txt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.text_export(lined(spark, sf_dir))


@query(
    "markdown_blocks",
    f"""WITH {_LINES}, {_numbers_sql(False)},
b AS (SELECT doc_id, line_no, kind IN ('bullet', 'number') AS listed, CASE kind WHEN 'break' THEN '---'
    WHEN 'heading' THEN repeat('#', CAST(l.level AS INT)) || ' ' || content WHEN 'bullet' THEN repeat('  ', CAST(l.level AS INT)) || '- ' || content
    WHEN 'number' THEN repeat('  ', CAST(l.level AS INT)) || n.number || '. ' || content ELSE content END AS block
  FROM lines l LEFT JOIN numbers n USING (doc_id, line_no) WHERE content <> '' OR kind = 'break'),
g AS (SELECT doc_id, line_no, block, lag(listed) OVER w AS was, listed FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, string_agg(CASE WHEN was IS NULL THEN '' WHEN was AND listed THEN chr(10) ELSE chr(10) || chr(10) END || block, '' ORDER BY line_no) AS markdown
FROM g GROUP BY doc_id""",
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.markdown_blocks(lined(spark, sf_dir))


@query("raw_round_trip", "SELECT page_id AS doc_id, sha256(html) AS digest, length(html) AS n FROM pages WHERE html IS NOT NULL")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").filter(F.col("html").isNotNull()).select("page_id", F.col("html").cast("binary").alias("content"))
    text = F.decode("content", "UTF-8")
    return raw.select(F.col("page_id").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("n"))


@query(
    "detect_format",
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'odt' ELSE 'txt' END AS format FROM documents",
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    zip_head = F.unhex(F.lit("504B0304")).cast("string")
    k = F.col("doc_id") % 5
    head = F.when(k == 0, "%PDF-1.7 ").when(k == 1, F.concat(zip_head, F.lit("xx word/document.xml"))).when(k == 2, F.concat(zip_head, F.lit("mimetypeapplication/vnd.oasis.opendocument.text"))).otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return docs.select("doc_id", formats.format_of_bytes(F.col("content")).alias("format"))


@query(
    "format_facts",
    "SELECT doc_id, CASE source WHEN 'src0' THEN 'docx' WHEN 'src1' THEN 'md' WHEN 'src2' THEN 'md-raw' WHEN 'src3' THEN 'txt' END AS format FROM documents",
)
def format_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    path = F.when(s == "src0", "/a.b/x.DOCX").when(s == "src1", "y.markdown").when(s == "src2", "z.raw-md").when(s == "src3", "q.text").otherwise("noext/file")
    return table(spark, sf_dir, "documents").select("doc_id", formats.format_of_path(path).alias("format"))


@query(
    "markdown_score",
    f"""WITH {_MARKED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:30]) AS x FROM marked),
t AS (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM l)
SELECT doc_id, CAST(sum(CASE WHEN starts_with(x, '#') THEN 2 ELSE 0 END + CASE WHEN starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '1. ') THEN 1 ELSE 0 END
  + CASE WHEN contains(x, '](') THEN 2 ELSE 0 END + CASE WHEN starts_with(x, '```') THEN 2 ELSE 0 END
  + CASE WHEN contains(x, '**') OR contains(x, '__') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM t GROUP BY doc_id""",
)
def markdown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", formats.markdown_score(F.col("text")).alias("score"))


@query(
    "kind_of_text",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', ', ') ELSE text END AS text FROM documents),
l AS (SELECT doc_id, text, string_split(replace(regexp_replace(text, '\\r?\\n\\z', ''), chr(13) || chr(10), chr(10)), chr(10))[1:10] AS ls FROM d),
c AS (SELECT doc_id, text, list_transform(ls, lambda x: length(x) - length(replace(x, ',', ''))) AS n FROM l),
m AS (SELECT doc_id, coalesce(sum(CASE WHEN starts_with(x, '#') THEN 2 ELSE 0 END + CASE WHEN starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '1. ') THEN 1 ELSE 0 END
  + CASE WHEN contains(x, '](') THEN 2 ELSE 0 END + CASE WHEN starts_with(x, '```') THEN 2 ELSE 0 END
  + CASE WHEN contains(x, '**') OR contains(x, '__') THEN 1 ELSE 0 END), 0) AS score
  FROM (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))[1:30]) AS x FROM d)) GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN text = '' THEN 'txt' WHEN len(n) >= 2 AND n[1] >= 1 AND len(list_filter(n, lambda x: x = n[1])) * 100 // len(n) >= 70 THEN 'csv'
  WHEN score >= 3 THEN 'md' ELSE 'txt' END AS kind FROM c JOIN m USING (doc_id)""",
)
def kind_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit(". "), F.lit(", "))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", text.alias("text"))
    return docs.select("doc_id", formats.kind_of_text(F.col("text")).alias("kind"))


def _delimiter_sql() -> str:
    part = lambda d: f"CASE WHEN n = 0 THEN 0.0 WHEN n < 2 THEN CAST(list_sum(list_transform(ls, lambda x: length(x) - length(replace(x, {d}, '')))) AS DOUBLE) WHEN length(ls[1]) - length(replace(ls[1], {d}, '')) = 0 THEN 0.0 ELSE (len(list_filter(ls, lambda x: length(x) - length(replace(x, {d}, '')) = length(ls[1]) - length(replace(ls[1], {d}, '')))) / n) * (CAST(list_sum(list_transform(ls, lambda x: length(x) - length(replace(x, {d}, '')))) AS DOUBLE) / n) END"
    names = {"c": "','", "t": "chr(9)", "s": "';'", "b": "'|'"}
    return (
        "WITH l AS (SELECT doc_id, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[1:10], lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL), "
        "k AS (SELECT doc_id, ls, len(ls) AS n FROM l), s AS (SELECT doc_id, " + ", ".join(f"{part(d)} AS {a}" for a, d in names.items()) + " FROM k) "
        "SELECT doc_id, CASE WHEN greatest(c, t, s, b) = 0 OR c = greatest(c, t, s, b) THEN ',' WHEN t = greatest(c, t, s, b) THEN chr(9) WHEN s = greatest(c, t, s, b) THEN ';' ELSE '|' END AS delimiter FROM s"
    )


@query("delimiter", _delimiter_sql())
def delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", formats.delimiter(F.col("text")).alias("delimiter"))


@query("decode_text", "SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'utf-8-bom' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' ELSE 'utf-8' END AS encoding FROM documents WHERE text IS NOT NULL")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, bom = F.col("doc_id") % 4, lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode("text", c))
    content = F.when(k == 0, bom("EFBBBF", "UTF-8")).when(k == 1, bom("FFFE", "UTF-16LE")).when(k == 2, bom("FEFF", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", content.alias("content"))
    return docs.select("doc_id", formats.decode_text(F.col("content")).alias("d")).select("doc_id", "d.text", "d.encoding")


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@query(
    "csv_write",
    "SELECT n_regionkey AS doc_id, string_agg(n_nationkey || ',' || CASE WHEN n_name LIKE '%A%' THEN '\"' || n_name || ',\"\"x\"\"' || '\"' ELSE n_name END || chr(13) || chr(10), '' ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1",
)
def csv_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("n_name").contains("A"), F.concat("n_name", F.lit(',"x"'))).otherwise(F.col("n_name"))
    return tables.csv_documents(table(spark, sf_dir, "nation").withColumn("n_name", odd), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query(
    "csv_cells",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_ix FROM orders)
SELECT o_custkey AS doc_id, CAST(row_ix AS BIGINT) AS row_ix, c.col_ix, c.value
FROM o, LATERAL (VALUES (CAST(0 AS BIGINT), CAST(o_orderkey AS VARCHAR)), (CAST(1 AS BIGINT), o_orderstatus || ',"q' || chr(10) || '"'), (CAST(2 AS BIGINT), o_orderpriority)) c(col_ix, value)""",
)
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit(',"q\n"')))
    return tables.csv_cells(tables.csv_documents(orders, "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"]), "csv")


@query(
    "markdown_table",
    """SELECT n_regionkey AS doc_id, '| n_nationkey | n_name |' || chr(10) || '|---:|:---|' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, 'A', '\\|') || ' |' || chr(10), '' ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1""",
)
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("n_name", F.replace(F.col("n_name"), F.lit("A"), F.lit("|")))
    return tables.markdown_tables(nation, "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"], ["right", "left"])


@query(
    "column_widths",
    "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", greatest(max(length(CAST({c} AS VARCHAR))), {len(c)}) AS longest FROM part" for c in _PART) + """)
SELECT "column", longest, printf('%.1f', 40.0 + longest / (SELECT sum(longest) FROM m) * 268.0) || 'pt' AS width FROM m""",
)
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_widths(table(spark, sf_dir, "part"), _PART)


_REV = "CASE event_id % 4 WHEN 0 THEN 'Insert' WHEN 1 THEN 'Delete' WHEN 2 THEN 'FormatChange' END"


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "Insert").when(k == 1, "Delete").when(k == 2, "FormatChange")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), kind.alias("revision_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
    )


@query("tracked_changes", f"SELECT user_id AS doc_id, event_id AS pos, {_REV} AS revision_type, 'u' || user_id AS author, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE event_id % 4 < 3")
def tracked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.tracked_changes(_revised(spark, sf_dir))


@query("accept_all", "SELECT user_id AS doc_id, count(*) AS n_left, CAST(sum(event_id) AS BIGINT) AS places, CAST(0 AS BIGINT) AS n_tracked FROM events WHERE event_id % 4 <> 1 GROUP BY 1")
def accept_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.decide(_revised(spark, sf_dir), True).groupBy("doc_id").agg(F.count("*").alias("n_left"), F.sum("pos").alias("places"), F.count("revision_type").alias("n_tracked"))


@query("reject_all", "SELECT user_id AS doc_id, count(*) AS n_left, CAST(sum(event_id) AS BIGINT) AS places, CAST(0 AS BIGINT) AS n_tracked FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def reject_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.decide(_revised(spark, sf_dir), False).groupBy("doc_id").agg(F.count("*").alias("n_left"), F.sum("pos").alias("places"), F.count("revision_type").alias("n_tracked"))


@query(
    "comment_threads",
    "SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS answers, count(*) OVER (PARTITION BY conv_id) AS n_in_thread FROM conversations",
)
def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.comment_threads(table(spark, sf_dir, "conversations"))


@query("reference_lookup", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    targets = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return revisions.resolve_references(uses, targets, ["o_custkey"])


@query("dangling_references", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    targets = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return revisions.dangling(uses, targets, ["o_custkey"])


@query("media_dedupe", "SELECT doc_id AS media_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS stored_id FROM documents WHERE text IS NOT NULL")
def media_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("media_id"), F.col("text").cast("binary").alias("data"))
    return revisions.dedupe_media(media)


@query(
    "units",
    "SELECT p_partkey, p_size / 20.0 AS from_twips, p_size / 2.0 AS from_half_points, p_size * 127.0 / 12700 AS from_emu, CASE p_partkey % 4 WHEN 0 THEN p_size * (72 / 2.54) WHEN 1 THEN p_size * 0.75 WHEN 2 THEN p_size * 72.0 END AS from_length FROM part",
)
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    length = F.concat(size, F.when(k == 0, "cm").when(k == 1, "px").when(k == 2, "").otherwise("xx"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", values.twips_to_points(size).alias("from_twips"), values.half_points_to_points(size).alias("from_half_points"),
        values.emu_to_points(F.col("p_size") * 127).alias("from_emu"), values.length_to_points(length).alias("from_length"),
    )


@query("colours", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE printf('%06X', p_partkey) END AS colour FROM part")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("p_partkey"), 6, "0"))
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", values.colour(F.when(k == 0, F.concat(digits, F.lit("0"))).when(k == 1, F.concat(F.lit("#"), digits)).otherwise(digits)).alias("colour"))


@query(
    "field_types",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'page_number' WHEN 1 THEN 'page_count' WHEN 2 THEN 'date' WHEN 3 THEN 'table_of_contents' ELSE 'custom' END AS field_type FROM part",
)
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, " pageref x").when(k == 1, "NumPages \\* MERGEFORMAT").when(k == 2, "SAVEDATE").when(k == 3, " TOC \\o").otherwise("XE y")
    return table(spark, sf_dir, "part").select("p_partkey", values.field_type(text).alias("field_type"))


@query(
    "escapes",
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml,
  sha256(CASE WHEN contains(html, ',') OR contains(html, '"') OR contains(html, chr(10)) OR contains(html, chr(13)) THEN '"' || replace(html, '"', '""') || '"' ELSE html END) AS field FROM pages WHERE html IS NOT NULL""",
)
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter(F.col("html").isNotNull())
    return pages.select("page_id", F.sha2(values.xml_escape(F.col("html")), 256).alias("xml"), F.sha2(values.csv_field(F.col("html")), 256).alias("field"))


@query(
    "inline_code",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '` plain `' WHEN 1 THEN '``a`b``' ELSE '``` ``x`` ```' END AS code FROM documents""".replace("'` plain `'", "'` plain `'"),
)
def inline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    text = F.when(k == 0, " plain ").when(k == 1, "a`b").otherwise("``x``")
    return table(spark, sf_dir, "documents").select("doc_id", markers.inline_code(text).alias("code"))


@query(
    "roman_numbers",
    """SELECT p_partkey, p_size, ['', 'x', 'xx', 'xxx', 'xl', 'l'][p_size // 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] AS roman FROM part WHERE p_size <= 50""",
)
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size <= 50").select("p_partkey", "p_size", markers.roman(F.col("p_size")).alias("roman"))


@query("text_edits", "SELECT doc_id, CASE WHEN length(text) >= 5 THEN substr(text, 1, 5) || '[+]' || substr(text, 6) END AS inserted, CASE WHEN length(text) >= 7 THEN substr(text, 1, 3) || substr(text, 8) END AS deleted FROM documents")
def text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", values.insert_text(text, F.lit(5), F.lit("[+]")).alias("inserted"), values.delete_text(text, F.lit(3), F.lit(4)).alias("deleted"))


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer rows as styles: each points to a third of its number; every tenth root closes a cycle."""
    key = F.col("c_custkey")
    parent = F.when(key > 3, F.floor(key / 3)).when(key == 3, 9)
    return table(spark, sf_dir, "customer").select(
        F.lit(0).cast("long").alias("doc_id"), key.cast("string").alias("style_id"), parent.cast("string").alias("parent_id"),
        F.create_map(F.concat(F.lit("k"), (key % 3).cast("string")), key.cast("string")).alias("attrs"),
    )


_CHAIN = """RECURSIVE s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(CASE WHEN c_custkey > 3 THEN c_custkey // 3 WHEN c_custkey = 3 THEN 9 END AS VARCHAR) AS parent, 'k' || (c_custkey % 3) AS k FROM customer),
c AS (SELECT id, id AS link, parent, 0 AS far, [id] AS seen FROM s
  UNION ALL SELECT c.id, s.id, s.parent, far + 1, list_append(seen, s.id) FROM c JOIN s ON s.id = c.parent WHERE NOT list_contains(seen, s.id))"""


@query("style_chains", f"WITH {_CHAIN} SELECT id AS style_id, string_agg(link, '>' ORDER BY far) AS chain FROM c GROUP BY 1")
def style_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.style_chains(_styles(spark, sf_dir), ">").select("style_id", "chain")


@query(
    "resolved_attributes",
    f"WITH {_CHAIN}, n AS (SELECT c.id, s.k, arg_min(c.link, c.far) AS v FROM c JOIN s ON s.id = c.link GROUP BY ALL) SELECT id AS style_id, string_agg(k || '=' || v, ',' ORDER BY k) AS attrs FROM n GROUP BY 1",
)
def resolved_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.resolved_attributes(_styles(spark, sf_dir))
    return out.select("style_id", F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attrs"))


@query(
    "numbering_resolve",
    """WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS num_id, l_linenumber % 2 AS level, l_linenumber FROM lineitem)
SELECT doc_id, CAST(num_id AS BIGINT) AS num_id, CAST(level AS BIGINT) AS level, l_linenumber,
  CASE WHEN num_id = 2 THEN NULL WHEN num_id = 1 AND level = 1 THEN 'upper_roman' WHEN level = 0 THEN 'decimal' ELSE 'bullet' END AS num_format,
  CAST(CASE WHEN num_id = 2 THEN NULL WHEN num_id = 0 AND level = 0 THEN 7 WHEN num_id = 1 AND level = 1 THEN 3 ELSE 1 END AS BIGINT) AS start FROM u""",
)
def numbering_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    uses = items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).cast("long").alias("num_id"), (F.col("l_linenumber") % 2).cast("long").alias("level"), "l_linenumber")
    docs = items.select(F.col("l_orderkey").alias("doc_id")).distinct()
    cross = lambda rows, schema: docs.select("doc_id", F.inline(F.expr(f"from_json('{rows}', 'array<struct<{schema}>>')")))
    instances = cross('[{"num_id":0,"abstract_num_id":5},{"num_id":1,"abstract_num_id":5}]', "num_id:bigint,abstract_num_id:bigint")
    levels = cross('[{"abstract_num_id":5,"level":0,"num_format":"decimal","start":1},{"abstract_num_id":5,"level":1,"num_format":"bullet","start":1}]', "abstract_num_id:bigint,level:bigint,num_format:string,start:bigint")
    overrides = cross('[{"num_id":0,"level":0,"start_override":7},{"num_id":1,"level":1,"num_format":"upper_roman","start":3}]', "num_id:bigint,level:bigint,start_override:bigint,num_format:string,start:bigint")
    return tree.numbering(uses, instances, levels, overrides)


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("content"))


@query(
    "txt_model_plain_text",
    SQL["plain_text"],
)
def txt_model_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text by way of the tree model, which every format shares."""
    return api.convert(_contents(spark, sf_dir), "plain", "txt").select("doc_id", F.col("content").cast("string").alias("text"))


@query("txt_model_export", SQL["txt_export"])
def txt_model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.convert(_contents(spark, sf_dir), "txt", "txt").select("doc_id", F.col("content").cast("string").alias("text"))


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    packed = api.convert(_contents(spark, sf_dir), kind, "txt")
    return api.convert(packed.select("doc_id", "content"), "txt").select("doc_id", F.col("content").cast("string").alias("text"), "error")


@query("docx_round_trip", "SELECT doc_id, text, CAST(NULL AS VARCHAR) AS error FROM (" + SQL["txt_export"] + ")")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to DOCX and back, found by its signature: nothing is lost."""
    return _round_trip(spark, sf_dir, "docx")


@query(
    "odt_round_trip",
    r"SELECT doc_id, regexp_replace(text, '(^|\n)( *)[0-9]+\. ', '\1\2- ', 'g') AS text, CAST(NULL AS VARCHAR) AS error FROM (" + SQL["txt_export"] + ")",
)
def odt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to ODT and back: list kinds are bullets afterwards."""
    return _round_trip(spark, sf_dir, "odt")


@query("markdown_parse")
def markdown_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = api.open_documents(_contents(spark, sf_dir), "md")
    return api.nodes_of(opened).groupBy("doc_id", "node_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("json_round_trip", "SELECT doc_id, text FROM (" + SQL["plain_text"] + ")")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = api.convert(_contents(spark, sf_dir), "json", "txt")
    return api.convert(model.select("doc_id", "content"), "plain", "json").select("doc_id", F.col("content").cast("string").alias("text"))


@query(
    "package_parts",
    "SELECT doc_id, p.path, true AS is_xml FROM documents, (VALUES ('[Content_Types].xml'), ('_rels/.rels'), ('word/document.xml'), ('word/_rels/document.xml.rels'), ('word/numbering.xml'), ('word/styles.xml')) p(path) WHERE text IS NOT NULL",
)
def package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = api.convert(_contents(spark, sf_dir), "docx", "txt")
    return api.package_parts(packed.select("doc_id", "content")).select("doc_id", "path", "is_xml")


@query(
    "edit_log",
    """SELECT conv_id AS doc_id, count(*) AS n_paragraphs FROM conversations WHERE turn % 5 <> 4 GROUP BY 1""",
)
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn inserts a paragraph at the end of its conversation's body; every fifth is undone at once."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    null = F.lit(None)
    root = F.struct(F.lit(0).cast("long").alias("node_id"), null.cast("long").alias("parent_id"), F.lit(0).cast("long").alias("child_ix"), F.lit("Document").alias("node_type"), null.cast("string").alias("text"), F.lit("{}").alias("attrs"))
    body = F.struct(F.lit(1).cast("long").alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("child_ix"), F.lit("Body").alias("node_type"), null.cast("string").alias("text"), F.lit("{}").alias("attrs"))
    nodes = ids.select("doc_id", F.inline(F.array(root, body)))
    args = F.to_json(F.struct(F.lit(1).alias("parent"), F.lit(0).alias("ix"), F.lit("Paragraph").alias("kind"), F.create_map(F.lit("role"), F.col("role")).alias("attrs")))
    edit = turns.select(F.col("conv_id").alias("doc_id"), (2 * F.col("turn")).alias("txn"), F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("kind"), (F.col("turn") + 2).alias("node_id"), args.alias("args"))
    undo = turns.filter("turn % 5 = 4").select(F.col("conv_id").alias("doc_id"), (2 * F.col("turn") + 1).alias("txn"), F.lit(0).cast("long").alias("seq"), F.lit("undo").alias("kind"), null.cast("long").alias("node_id"), null.cast("string").alias("args"))
    folded = edits.apply_log(nodes, edit.union(undo))
    return folded.filter("node_type = 'Paragraph'").groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))
