"""Registered queries over node tables, styles, operations and values, each with its SQL twin."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import formats, text, values
from folioforge.operators import nodes, outline, revisions, styles, tree
from folioforge.plans.catalogue import _GRAMMAR, _LINES, _NODES, lined, query, table
from folioforge.sources import detect, plain

DEPTH = 4  # of trees made from plain text


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.nodes(lined(spark, sf_dir)).select("doc_id", "node_id", "parent_id", "child_ix", "depth", "node_type", "text")


_TREE = f"""{_NODES},
n AS MATERIALIZED (SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(child_ix AS BIGINT) AS child_ix,
  CAST(depth AS BIGINT) AS depth, node_type, text FROM nodes)"""


@query("tree_roots", f"WITH {_TREE} SELECT doc_id, min(CASE WHEN parent_id IS NULL THEN node_id END) AS root_id, min(CASE WHEN node_type = 'Body' THEN node_id END) AS body_id FROM n GROUP BY 1")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roots(_tree(spark, sf_dir))


@query(
    "is_descendant",
    f"""WITH {_TREE} SELECT a.doc_id, a.node_id, a.node_id % 9 AS ancestor_id,
  coalesce(a.parent_id = a.node_id % 9 OR b.parent_id = a.node_id % 9 OR c.parent_id = a.node_id % 9 OR d.parent_id = a.node_id % 9, false) AS below
FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.node_id = a.parent_id LEFT JOIN n c ON c.doc_id = a.doc_id AND c.node_id = b.parent_id
LEFT JOIN n d ON d.doc_id = a.doc_id AND d.node_id = c.parent_id""",
)
def is_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tree(spark, sf_dir)
    return tree.is_descendant(own.select("doc_id", "node_id", (F.col("node_id") % 9).alias("ancestor_id")), own, DEPTH)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each customer: twelve tables, each in a cell of the one before, a paragraph beside each."""
    rows = [(0, None, "Document", 0), (1, 0, "Body", 1)]
    up, i, depth = 1, 2, 2
    for _ in range(12):
        rows += [(i, up, "Table", depth), (i + 1, i, "TableRow", depth + 1), (i + 2, i + 1, "TableCell", depth + 2), (i + 3, i + 2, "Paragraph", depth + 3), (i + 4, i + 3, "Run", depth + 4), (i + 5, i + 4, "Text", depth + 5)]
        up, i, depth = i + 2, i + 6, depth + 3
    shape = F.array(*[F.struct(F.lit(a).cast("bigint").alias("node_id"), F.lit(b).cast("bigint").alias("parent_id"), F.lit(c).alias("node_type"), F.lit(d).cast("bigint").alias("depth")) for a, b, c, d in rows])
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.inline(shape))
    return own.select("doc_id", "node_id", "parent_id", F.lit(0).cast("bigint").alias("child_ix"), "depth", "node_type", F.when(F.col("node_type") == "Text", F.concat("c_name", F.lit(" "), F.col("depth").cast("string"))).alias("text"))


@query("nested_plain_text", "SELECT c_custkey AS doc_id, string_agg(c_name || ' ' || (7 + 3 * k), chr(10) ORDER BY k) AS text FROM customer, range(12) t(k) GROUP BY 1")
def nested_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.plain_text(_nested(spark, sf_dir))


@query(
    "nested_descendants",
    """SELECT c_custkey AS doc_id, CAST(node_id AS BIGINT) AS node_id, CAST(n AS BIGINT) AS n_descendants FROM customer,
  (SELECT 0 AS node_id, 73 AS n UNION ALL SELECT 1, 72 UNION ALL
   SELECT 2 + 6 * k + j, CASE j WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 72 - 6 * k - 1 - j END FROM range(12) a(k), range(5) b(j)) t""",
)
def nested_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendants(_nested(spark, sf_dir))


@query(
    "long_style_chains",
    """SELECT p_size AS doc_id, p_partkey AS style_id, array_to_string(list_reverse(list(p_partkey) OVER w), ',') AS chain
FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def long_style_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("p_partkey").over(W.partitionBy("p_size").orderBy("p_partkey"))
    own = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("style_id"), before.alias("parent_id"))
    return tree.style_chains(own, ",")


_MARKED_RUNS = f"{_TREE}, m AS (SELECT *, CASE WHEN node_type = 'Run' AND node_id % 3 = 0 THEN 'Delete' WHEN node_type = 'Run' AND node_id % 3 = 1 THEN 'Insert' WHEN node_type = 'Paragraph' AND child_ix % 11 = 5 THEN 'Insert' END AS revision_type FROM n)"


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, k = F.col("node_type") == "Run", F.col("node_id") % 3
    mark = F.when(run & (k == 0), "Delete").when(run & (k == 1), "Insert").when((F.col("node_type") == "Paragraph") & (F.col("child_ix") % 11 == 5), "Insert")
    return _tree(spark, sf_dir).withColumn("revision_type", mark)


def _decided(gone: str, chosen: str, keep: str) -> str:
    return f"""WITH {_MARKED_RUNS}, g AS MATERIALIZED (SELECT doc_id, node_id FROM m WHERE {gone}),
g2 AS MATERIALIZED (SELECT * FROM g UNION SELECT m.doc_id, m.node_id FROM m JOIN g ON g.doc_id = m.doc_id AND g.node_id = m.parent_id),
g3 AS MATERIALIZED (SELECT * FROM g2 UNION SELECT m.doc_id, m.node_id FROM m JOIN g2 ON g2.doc_id = m.doc_id AND g2.node_id = m.parent_id)
SELECT m.doc_id, m.node_id, m.node_type, m.text, {keep} AS revision_type FROM m WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.doc_id = m.doc_id AND g3.node_id = m.node_id)"""


@query("accept_in_trees", _decided("revision_type = 'Delete'", "", "CAST(NULL AS VARCHAR)"))
def accept_in_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.decide(_revised(spark, sf_dir), True, DEPTH).select("doc_id", "node_id", "node_type", "text", "revision_type")


@query("reject_in_trees", _decided("revision_type = 'Insert'", "", "CAST(NULL AS VARCHAR)"))
def reject_in_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.decide(_revised(spark, sf_dir), False, DEPTH).select("doc_id", "node_id", "node_type", "text", "revision_type")


@query(
    "decide_one_change",
    _decided("node_id % 5 = 0 AND revision_type = CASE WHEN node_id % 2 = 0 THEN 'Delete' ELSE 'Insert' END", "", "CASE WHEN m.node_id % 5 <> 0 THEN m.revision_type END"),
)
def decide_one_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _revised(spark, sf_dir)
    choices = own.filter(F.col("node_id") % 5 == 0).select("doc_id", "node_id", (F.col("node_id") % 2 == 0).alias("accept"))
    return revisions.decide_one(own, choices, DEPTH).select("doc_id", "node_id", "node_type", "text", "revision_type")


@query(
    "selection_range",
    f"""WITH {_TREE}, t AS (SELECT doc_id, node_id FROM n WHERE node_type = 'Text'), s AS (SELECT doc_id, max(node_id) AS a, min(node_id) AS f FROM t GROUP BY 1)
SELECT t.doc_id, 'back' AS selection_id, t.node_id FROM t JOIN s ON s.doc_id = t.doc_id WHERE t.node_id <= s.a AND t.node_id >= s.f
UNION ALL SELECT doc_id, 'one', a FROM s UNION ALL SELECT doc_id, 'odd', f FROM s UNION ALL SELECT doc_id, 'odd', 1 FROM s""",
)
def selection_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tree(spark, sf_dir)
    ends = own.filter("node_type = 'Text'").groupBy("doc_id").agg(F.max("node_id").alias("a"), F.min("node_id").alias("f"))
    said = lambda name, a, f: F.struct(F.lit(name).alias("selection_id"), a.alias("anchor_id"), f.alias("focus_id"))
    a, f = F.col("a"), F.col("f")
    return nodes.nodes_in_range(ends.select("doc_id", F.inline(F.array(said("back", a, f), said("one", a, a), said("odd", f, F.lit(1).cast("bigint"))))), own)


@query(
    "check_positions",
    f"""WITH {_TREE}, p AS (SELECT doc_id, CASE WHEN node_id % 13 = 0 THEN node_id + 1000000 ELSE node_id END AS node_id, node_id % 40 AS "offset" FROM n)
SELECT p.doc_id, p.node_id, p."offset", CASE WHEN n.node_type IS NULL THEN 'NodeNotFound' WHEN n.node_type <> 'Text' THEN 'NotATextNode'
  WHEN p."offset" > coalesce(length(n.text), 0) THEN 'OffsetOutOfBounds' END AS error FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.node_id = p.node_id""",
)
def check_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tree(spark, sf_dir)
    at = F.when(F.col("node_id") % 13 == 0, F.col("node_id") + 1_000_000).otherwise(F.col("node_id"))
    return nodes.check_positions(own.select("doc_id", at.alias("node_id"), (F.col("node_id") % 40).alias("offset")), own)


_KINDS = ("InsertNode", "DeleteNode", "MoveNode", "InsertText", "DeleteText", "SetAttributes", "RemoveAttributes", "SetMetadata", "SetStyle", "RemoveStyle", "Later")
_OPS = f"""ops AS MATERIALIZED (SELECT event_id % 200 AS doc_id, event_id AS op_id, ([{', '.join(f"'{k}'" for k in _KINDS)}])[CAST(event_id % 11 + 1 AS INT)] AS kind,
  (event_id * 7) % 61 AS node_id, (event_id * 5) % 23 AS parent_id, event_id % 4 AS ix, CASE event_id % 3 WHEN 0 THEN 'Paragraph' WHEN 1 THEN 'Run' ELSE 'Text' END AS node_type,
  event_id % 30 AS "offset", event_id % 50 AS length, 's' || (event_id % 6) AS style_id FROM events)"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (e % 11).cast("int"))
    return table(spark, sf_dir, "events").select(
        (e % 200).alias("doc_id"), e.alias("op_id"), kind.alias("kind"), ((e * 7) % 61).alias("node_id"), ((e * 5) % 23).alias("parent_id"), (e % 4).alias("ix"),
        F.when(e % 3 == 0, "Paragraph").when(e % 3 == 1, "Run").otherwise("Text").alias("node_type"), (e % 30).alias("offset"), (e % 50).alias("length"),
        F.concat(F.lit("s"), (e % 6).cast("string")).alias("style_id"),
    )


@query(
    "check_ops",
    f"""WITH {_TREE}, {_OPS}, g(pt, ct) AS (VALUES {_GRAMMAR}), k AS MATERIALIZED (SELECT doc_id, parent_id, count(*) AS kids FROM n WHERE parent_id IS NOT NULL GROUP BY ALL),
j AS (SELECT o.*, a.node_type AS at_type, a.parent_id AS at_parent, length(a.text) AS len, u.node_type AS up_type, coalesce(k.kids, 0) AS kids, g.pt IS NOT NULL AS fits
  FROM ops o LEFT JOIN n a ON a.doc_id = o.doc_id AND a.node_id = o.node_id LEFT JOIN n u ON u.doc_id = o.doc_id AND u.node_id = o.parent_id
  LEFT JOIN k ON k.doc_id = o.doc_id AND k.parent_id = o.parent_id LEFT JOIN g ON g.pt = u.node_type AND g.ct = CASE WHEN o.kind = 'InsertNode' THEN o.node_type ELSE a.node_type END)
SELECT doc_id, op_id, kind, CASE WHEN kind IN ('SetMetadata', 'SetStyle') THEN NULL
  WHEN kind = 'RemoveStyle' THEN CASE WHEN op_id % 6 >= 3 THEN 'StyleNotFound' END
  WHEN kind <> 'InsertNode' AND at_type IS NULL THEN 'NodeNotFound' WHEN kind IN ('InsertNode', 'MoveNode') AND up_type IS NULL THEN 'NodeNotFound'
  WHEN kind IN ('InsertNode', 'MoveNode') AND NOT fits THEN 'InvalidHierarchy' WHEN kind = 'InsertNode' AND ix > kids THEN 'IndexOutOfBounds'
  WHEN kind = 'DeleteNode' AND at_parent IS NULL THEN 'CannotDeleteRoot' WHEN kind IN ('InsertText', 'DeleteText') AND at_type <> 'Text' THEN 'NotATextNode'
  WHEN kind IN ('InsertText', 'DeleteText') AND "offset" + CASE WHEN kind = 'DeleteText' THEN length ELSE 0 END > coalesce(len, 0) THEN 'TextOffsetOutOfBounds' END AS error FROM j""",
)
def check_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(f"s{k}") for k in range(3)])).alias("style_id"))
    ops = _ops(spark, sf_dir)
    here = ops.select("doc_id").distinct().join(F.broadcast(spark.createDataFrame([(f"s{k}",) for k in range(3)], "style_id string")))
    return nodes.check_ops(ops, _tree(spark, sf_dir), own.unionByName(here)).select("doc_id", "op_id", "kind", "error")


@query(
    "dirty_blocks",
    f"""WITH {_TREE}, {_OPS}, up AS MATERIALIZED (SELECT a.doc_id, a.node_id, a.parent_id, CASE WHEN a.depth = 2 THEN a.node_id WHEN a.depth = 3 THEN a.parent_id WHEN a.depth = 4 THEN b.parent_id END AS top
  FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.node_id = a.parent_id),
j AS (SELECT o.doc_id, o.op_id, o.kind, o.parent_id, a.parent_id AS ap, a.top AS own, u.top AS ut, u.node_id IS NOT NULL AS has_up FROM ops o
  LEFT JOIN up a ON a.doc_id = o.doc_id AND a.node_id = o.node_id LEFT JOIN up u ON u.doc_id = o.doc_id AND u.node_id = o.parent_id),
s AS (SELECT *, CASE kind WHEN 'InsertNode' THEN parent_id = 1 AND has_up WHEN 'DeleteNode' THEN coalesce(ap = 1, false)
  WHEN 'MoveNode' THEN coalesce(ap = 1, false) OR (parent_id = 1 AND has_up) ELSE kind = 'Later' END AS structural FROM j)
SELECT doc_id, op_id, structural, CASE WHEN structural OR kind IN ('SetMetadata', 'SetStyle', 'RemoveStyle') THEN '' WHEN kind = 'InsertNode' THEN coalesce(CAST(ut AS VARCHAR), '')
  WHEN kind = 'MoveNode' THEN concat_ws(',', least(own, ut), CASE WHEN own <> ut THEN greatest(own, ut) END) ELSE coalesce(CAST(own AS VARCHAR), '') END AS dirty FROM s""",
)
def dirty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.dirty_blocks(_ops(spark, sf_dir), _tree(spark, sf_dir), DEPTH)
    return found.select("doc_id", "op_id", "structural", F.array_join("dirty", ",").alias("dirty"))


@query(
    "subtree_digests",
    f"""WITH {_TREE}, t AS (SELECT p.doc_id, p.node_id, p.node_id AS pos, 0 AS d, p.node_type, p.text FROM n p WHERE p.node_type = 'Paragraph'
  UNION ALL SELECT r.doc_id, r.parent_id, r.node_id, 1, r.node_type, r.text FROM n r WHERE r.node_type = 'Run'
  UNION ALL SELECT x.doc_id, r.parent_id, x.node_id, 2, x.node_type, x.text FROM n x JOIN n r ON r.doc_id = x.doc_id AND r.node_id = x.parent_id WHERE x.node_type = 'Text')
SELECT doc_id, node_id, sha256(string_agg(d || ':' || node_type || ':' || coalesce(text, ''), chr(10) ORDER BY pos)) AS digest FROM t GROUP BY ALL""",
)
def subtree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.subtree_digests(_tree(spark, sf_dir), deepest=DEPTH)


@query("node_census", f"WITH {_TREE} SELECT node_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM n GROUP BY 1")
def node_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.census(_tree(spark, sf_dir))


@query(
    "child_order",
    f"WITH {_TREE} SELECT doc_id, parent_id AS node_id, string_agg(node_id, ',' ORDER BY child_ix, node_id) AS kids FROM n WHERE parent_id IS NOT NULL GROUP BY ALL",
)
def child_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(_tree(spark, sf_dir)).select("doc_id", "node_id", F.array_join("kids", ",").alias("kids"))


@query(
    "style_log",
    """WITH l AS (SELECT user_id AS doc_id, event_id AS seq, 's' || (event_id % 7) AS style_id, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'set' END AS kind, props FROM events),
b AS (SELECT DISTINCT user_id AS doc_id, CAST(-1 AS BIGINT) AS seq, 's1' AS style_id, 'set' AS kind, 'base' AS props FROM events),
a AS (SELECT * FROM l UNION ALL SELECT * FROM b), w AS (SELECT *, lag(kind) OVER k AS before, lead(kind) OVER k AS after FROM a WINDOW k AS (PARTITION BY doc_id, style_id ORDER BY seq))
SELECT doc_id, style_id, props AS attrs, CAST(NULL AS BIGINT) AS failed FROM w WHERE after IS NULL AND kind = 'set'
UNION ALL SELECT doc_id, style_id, NULL, seq FROM w WHERE kind = 'remove' AND coalesce(before, 'remove') = 'remove'""",
)
def style_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("set").alias("kind"),
        F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")).alias("style_id"), F.col("props").alias("attrs"),
    )
    base = log.select("doc_id").distinct().select("doc_id", F.lit("s1").alias("style_id"), F.lit("base").alias("attrs"))
    now, errors = styles.apply_style_log(base, log)
    return now.withColumn("failed", F.lit(None).cast("bigint")).unionByName(errors.select("doc_id", "style_id", F.lit(None).cast("string").alias("attrs"), F.col("seq").alias("failed")))


@query(
    "style_by_id",
    "SELECT p_size AS doc_id, p_brand AS style_id, min(p_partkey) AS first_key FROM part GROUP BY ALL",
)
def style_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("style_id"), F.col("p_partkey").alias("first_key"))
    return styles.style_by_id(own, "first_key")


@query(
    "typed_attributes",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS as_int,
  CASE WHEN event_id % 4 = 1 THEN value END AS as_float, CASE WHEN event_id % 4 = 2 THEN event_type END AS as_string, CASE WHEN event_id % 4 = 3 THEN user_id % 2 = 0 END AS as_bool FROM events""",
)
def typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.when(F.col("event_id") % 4 == 0, c[0]).when(F.col("event_id") % 4 == 1, c[1]).when(F.col("event_id") % 4 == 2, c[2]).otherwise(c[3])
    kind = pick([F.lit(x) for x in ("int", "float", "string", "bool")])
    value = pick([F.get_json_object("props", "$.k"), F.col("value").cast("string"), F.col("event_type"), (F.col("user_id") % 2 == 0).cast("string")])
    attrs = F.create_map(F.lit("a"), F.struct(kind.alias("type"), value.alias("value")))
    rows = table(spark, sf_dir, "events").select("event_id", attrs.alias("m"))
    return rows.select("event_id", *[styles.typed(F.col("m"), "a", k).alias(f"as_{k}") for k in ("int", "float", "string", "bool")])


@query(
    "node_attributes",
    """WITH s AS (SELECT n_nationkey AS i, n_regionkey AS r, n_name AS x FROM nation), c AS (SELECT s_suppkey, s_name, s_nationkey AS p, s_suppkey % 25 AS o, s_suppkey % 3 = 0 AS direct FROM supplier)
SELECT c.s_suppkey AS node_id, ps.x AS only_para, CASE WHEN c.direct THEN c.s_name ELSE os.x END AS both, CASE WHEN o % 2 = 0 THEN os.i ELSE 1000 END AS even
FROM c JOIN s ps ON ps.i = c.p JOIN s os ON os.i = c.o""",
)
def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("bigint").alias("doc_id")
    nation = table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    mapped = lambda *kv: F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull())
    even = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string"))
    kinds = [(p, mapped(F.lit("para" if p == "p" else "own"), F.col("n_name"), F.lit("both"), F.col("n_name"), F.lit("even"), even)) for p in "po"]
    own = [nation.select(one, name(p, "n_nationkey").alias("style_id"), F.lit("base").alias("parent_id"), m.alias("attrs")) for p, m in kinds]
    base = spark.range(1).select(one, F.lit("base").alias("style_id"), F.lit(None).cast("string").alias("parent_id"), F.create_map(F.lit("even"), F.lit("1000")).alias("attrs"))
    rows = table(spark, sf_dir, "supplier").select(
        one, F.col("s_suppkey").alias("node_id"), name("p", "s_nationkey").alias("para_style"), F.concat(F.lit("o"), (F.col("s_suppkey") % 25).cast("string")).alias("style_id"),
        F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("both"), F.col("s_name"))).alias("attrs"),
    )
    got = styles.node_attributes(rows, own[0].unionByName(own[1]).unionByName(base))
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    return got.select("node_id", at("para").alias("only_para"), at("both").alias("both"), at("even").cast("bigint").alias("even"))


@query(
    "section_headers",
    """SELECT l_orderkey AS doc_id, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) FILTER (WHERE l_returnflag = 'A') AS first_a, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) FILTER (WHERE l_returnflag = 'N') AS first_n
FROM lineitem GROUP BY 1""",
)
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("node"))))
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(refs.alias("refs"))
    return own.select("doc_id", styles.first_of_type(F.col("refs"), "A").alias("first_a"), styles.first_of_type(F.col("refs"), "N").alias("first_n"))


@query("fonts_used", "SELECT p_size AS doc_id, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS fonts FROM part GROUP BY 1")
def fonts_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.used(table(spark, sf_dir, "part").withColumnRenamed("p_size", "doc_id"), "p_type").select("doc_id", F.array_join("values", ",").alias("fonts"))


@query("automatic_styles", "SELECT p_size AS doc_id, p_partkey, 'T' || dense_rank() OVER (PARTITION BY p_size ORDER BY p_brand, p_type) AS auto_style FROM part")
def automatic_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").withColumnRenamed("p_size", "doc_id")
    return styles.automatic_names(own, ["p_brand", "p_type"]).select("doc_id", "p_partkey", "auto_style")


_PATHS = ("_xmlsignatures/sig1.xml", "_xmlsignatures/sig2.xml", "_xmlsignatures/origin.sigs", "word/vbaProject.bin", "word/document.xml")


@query(
    "package_marks",
    f"""WITH p AS (SELECT o_custkey AS doc_id, ([{', '.join(f"'{x}'" for x in _PATHS)}])[CAST(o_orderkey % 5 + 1 AS INT)] AS path FROM orders)
SELECT doc_id, count(*) FILTER (WHERE path LIKE '%/sig_.xml') AS n_signatures, coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (WHERE path LIKE '%/sig_.xml')), ','), '') AS signatures,
  bool_or(path LIKE '%vbaProject.bin') AS has_macros FROM p GROUP BY 1""",
)
def package_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % 5).cast("int"))
    return styles.package_marks(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), path.alias("path")))


@query(
    "table_groups",
    """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS ix, o_orderstatus = 'F' AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS g FROM o WHERE m)
SELECT doc_id, min(ix) AS first, max(ix) AS last, count(*) AS n FROM i GROUP BY doc_id, g""",
)
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ix"), "o_orderstatus")
    return nodes.runs_of(own, F.col("o_orderstatus") == "F")


@query(
    "body_origin",
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS "left", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ix, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem),
r AS (SELECT o_orderkey AS doc_id, 100 + j AS "right", row_number() OVER (PARTITION BY o_orderkey ORDER BY j) - 1 AS ix, count(*) OVER (PARTITION BY o_orderkey) AS k FROM orders, range(4) t(j))
SELECT l.doc_id, l.ix, l."left", r."right" FROM l JOIN r ON r.doc_id = l.doc_id AND r.ix = l.ix AND r.k = l.k""",
)
def body_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("a"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(100).cast("bigint"), F.lit(103).cast("bigint"))).alias("b"))
    return nodes.zipped(left, right, "a", "b")


@query(
    "toc_levels",
    f"""WITH {_LINES}, t AS (SELECT doc_id, doc_id % 3 AS toc_id, 1 + doc_id % 4 AS max_level FROM documents)
SELECT l.doc_id, t.toc_id, l.line_no, 'TOC' || l.level AS style_id, l.content AS title FROM lines l JOIN t ON t.doc_id = l.doc_id AND l.level <= t.max_level WHERE l.kind = 'heading'""",
)
def toc_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tocs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("toc_id"), (1 + F.col("doc_id") % 4).alias("max_level"))
    return nodes.toc_of(outline.headings(lined(spark, sf_dir)), tocs)


@query(
    "comment_ranges",
    """WITH m AS (SELECT conv_id AS doc_id, turn // 2 AS comment_id, CASE WHEN turn % 2 = 0 THEN 'start' ELSE 'end' END AS kind, turn AS pos FROM conversations),
r AS (SELECT doc_id, comment_id, min(pos) FILTER (WHERE kind = 'start') AS starts, min(pos) FILTER (WHERE kind = 'end') AS ends FROM m GROUP BY ALL),
b AS (SELECT conv_id AS doc_id, turn AS comment_id, text AS body FROM conversations WHERE role = 'assistant')
SELECT coalesce(r.doc_id, b.doc_id) AS doc_id, coalesce(r.comment_id, b.comment_id) AS comment_id, starts, ends, body FROM r FULL JOIN b ON b.doc_id = r.doc_id AND b.comment_id = r.comment_id""",
)
def comment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    marks = turns.select("doc_id", F.floor(F.col("turn") / 2).cast("bigint").alias("comment_id"), F.when(F.col("turn") % 2 == 0, "start").otherwise("end").alias("kind"), F.col("turn").alias("pos"))
    return nodes.comment_ranges(marks, turns.filter("role = 'assistant'").select("doc_id", F.col("turn").alias("comment_id"), F.col("text").alias("body")))


# Values.


@query(
    "windows_1252",
    "SELECT doc_id, text || chr(8364) || chr(8217) || chr(8230) AS text FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')",
)
def windows_1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\x00-\x7F]"))
    return own.select("doc_id", formats.windows_1252(F.concat(F.col("text").cast("binary"), F.unhex(F.lit("809285")))).alias("text"))


@query("json_escape", "SELECT doc_id, replace(replace(replace(replace(replace(text || chr(9) || '\"\\', '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS escaped FROM documents WHERE text IS NOT NULL")
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return own.select("doc_id", text.json_escape(F.concat("text", F.lit('\t"\\'))).alias("escaped"))


@query(
    "css_borders",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 0.5 ELSE CAST(p_size AS DOUBLE) END AS width,
  CASE p_partkey % 4 WHEN 0 THEN (p_size % 256) / 255.0::DOUBLE WHEN 1 THEN 171 / 255.0::DOUBLE ELSE 0.0::DOUBLE END AS r, CASE p_partkey % 4 WHEN 0 THEN 16 / 255.0::DOUBLE WHEN 1 THEN 205 / 255.0::DOUBLE ELSE 0.0::DOUBLE END AS g,
  CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 239 / 255.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM part""",
)
def css_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    css = (
        F.when(k == 0, F.concat(size, F.lit("px solid #"), F.lpad(F.hex(F.col("p_size").cast("bigint")), 2, "0"), F.lit("10FF"))).when(k == 1, F.concat(F.lit("  "), size, F.lit(".5pt dashed abCDef")))
        .when(k == 2, "").otherwise(F.concat(size, F.lit(" dotted red")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.css_border(css).alias("c")).select("p_partkey", "c.width", "c.r", "c.g", "c.b")


_MIXED = "text || ' ' || chr(1080) || chr(1084) || chr(1103) || '! ' || chr(945) || chr(946) || ' 1 ' || chr(8594) || chr(20013) || chr(25991)"
_RUN_SQL = text.script_pattern("").replace("'", "''")


@query(
    "script_runs",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all({_MIXED}, '{_RUN_SQL}') AS runs FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(len(runs))) AS ix, unnest(runs) AS run FROM d)
SELECT doc_id, ix, CAST(coalesce(sum(strlen(run)) OVER (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CASE WHEN regexp_full_match(run, '[\\p{{Common}}\\p{{Inherited}}]+') THEN 'Common' {' '.join(f"WHEN regexp_matches(run, '\\p{{{s}}}') THEN '{s}'" for s in text.SCRIPTS)} ELSE 'Other' END AS script FROM e""",
)
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat("text", F.lit(" имя! αβ 1 →中文"))
    rows = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(text.script_runs(mixed)).alias("ix", "run"))
    return rows.select("doc_id", F.col("ix").cast("bigint").alias("ix"), "run.start", "run.script")


@query(
    "code_languages",
    "SELECT doc_id, array_to_string(list_sort(list_distinct([lang, 'x' || source])), ',') AS languages FROM documents WHERE text IS NOT NULL",
)
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat("text", F.lit("\n```"), "lang", F.lit("\ncode\n```\n````x"), "source", F.lit(" more\n````\r\n   ``` "), "lang", F.lit("\n```"))
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.array_join(text.code_languages(fenced), ",").alias("languages"))


@query(
    "inverse_facts",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'darkGray' END AS highlight, CASE p_partkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS media_type,
  CASE p_partkey % 3 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'NUMPAGES' END AS instruction FROM part""",
)
def inverse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    return table(spark, sf_dir, "part").select(
        "p_partkey", values.highlight_name(pick("ffff00", "A9A9A9", "123456")).alias("highlight"),
        values.picture_media_type(pick("JPEG", "png", "exe")).alias("media_type"), values.field_instruction(pick("page_number", "page_count", "custom")).alias("instruction"),
    )


_FROM = ("doc", "docx", "odt", "txt", "md")
_TO = ("docx", "odt", "txt")


@query(
    "conversion_checks",
    f"""WITH d AS (SELECT doc_id, ([{', '.join(f"'{x}'" for x in _FROM)}])[CAST(doc_id % 5 + 1 AS INT)] AS source, ([{', '.join(f"'{x}'" for x in _TO)}])[CAST(doc_id % 3 + 1 AS INT)] AS target FROM documents),
s AS (SELECT *, (source || '-' || target) IN ('doc-docx', 'doc-odt', 'docx-odt', 'odt-docx') AS supported FROM d)
SELECT doc_id, supported, CASE WHEN NOT supported THEN 'unsupported conversion: ' || source || ' to ' || target END AS error, CAST(source = 'doc' AS BIGINT) AS n_warnings FROM s""",
)
def conversion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs)).cast("int"))
    source, target = pick(_FROM), pick(_TO)
    return table(spark, sf_dir, "documents").select(
        "doc_id", formats.is_supported(source, target).alias("supported"), formats.validate_conversion(source, target).alias("error"),
        F.size(formats.conversion_warnings(source)).cast("bigint").alias("n_warnings"),
    )


def _zip(*entries: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


_FILES = (
    ("xlsx", _zip(("xl/x", ""), ("[Content_Types].xml", "a spreadsheetml b"))), ("odt", _zip(("mimetype", "application/vnd.oasis.opendocument.text"))), ("odp", _zip(("META-INF/manifest.xml", "opendocument.presentation"))),
    ("docx", _zip(("word/document.xml", "<w/>"))), ("pptx", _zip(("ppt/slides", ""))), ("bin", _zip(("other", "word/"))), ("docx", b"PK\x03\x04 broken wordprocessingml"), ("bin", b"PK\x03\x04 broken"),
    ("doc", bytes.fromhex("D0CF11E0A1B11AE1") + b"x"), ("pdf", b"%PDF-1.7"), ("bin", b"\xff\xfe\xfa"), ("txt", b""), ("csv", b"a,b\n1,2\n"), ("md", b"# a\n- b\n"),
)


@query(
    "detect_file_type",
    f"""WITH t(file_type, media, label, kind, supported) AS (VALUES {', '.join(str(r).replace('True', 'true').replace('False', 'false') for r in formats.FILE_TYPES)}),
d AS (SELECT o_orderkey AS doc_id, ([{', '.join(f"'{x}'" for x, _ in _FILES)}])[CAST(o_orderkey % {len(_FILES)} + 1 AS INT)] AS file_type FROM orders)
SELECT doc_id, file_type, media, label, kind, supported FROM d JOIN t USING (file_type)""",
)
def detect_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.get(F.array(*[F.unhex(F.lit(b.hex())) for _, b in _FILES]), (F.col("o_orderkey") % len(_FILES)).cast("int"))
    got = detect.detect_file_type(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), content.alias("content")))
    fact = lambda k: formats.type_fact(F.col("file_type"), k)
    return got.select("doc_id", "file_type", fact("media_type").alias("media"), fact("label").alias("label"), fact("kind").alias("kind"), fact("supported").alias("supported"))
