"""Plain-text documents as rows, natively.

``lines`` gives one row for each line with what its marker says; ``nodes`` the node table with the
ids that a reader hands out in document order. Both keep to DataFrame operations; ``nodes`` needs one
shuffle by doc_id for running sums, over rows that the exporters group by doc_id anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import markers

#: Node table columns.
NODE_COLUMNS = (
    "doc_id", "node_id", "parent_id", "child_ix", "depth", "node_type", "text", "style_id", "list_level", "list_format", "list_num_id",
    "list_start", "page_break_before",
)


def lines(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """(doc_id, line_no, kind, level, start, content) for each line of each text; null texts have none."""
    source = F.col(text) if isinstance(text, str) else text
    each = docs.select("doc_id", F.posexplode(markers.normal_lines(source)).alias("line_no", "line"))
    return each.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        markers.line_kind(F.col("line")).alias("kind"),
        markers.line_level(F.col("line")).alias("level"),
        markers.line_start(F.col("line")).alias("start"),
        markers.line_content(F.col("line")).alias("content"),
    )


def nodes(lined: DataFrame) -> DataFrame:
    """The node table of lines: root 0, body 1, then for each line a paragraph and, if it has content,
    a run with a text."""
    order = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.when(F.col("content") == "", 1).otherwise(3)
    para = lined.withColumn("p", F.sum(own).over(order) - own + 2)
    null = lambda t: F.lit(None).cast(t)

    def node(node_id, parent, ix, depth, kind, text=None, **more) -> Column:
        base = {"style_id": null("string"), "list_level": null("long"), "list_format": null("string"), "list_num_id": null("long"), "list_start": null("long"), "page_break_before": null("boolean")} | more
        parts = {"node_id": node_id, "parent_id": parent, "child_ix": ix, "depth": F.lit(depth), "node_type": F.lit(kind), "text": null("string") if text is None else text} | base
        kinds = {"node_id": "long", "parent_id": "long", "child_ix": "long", "depth": "long", "list_level": "long", "list_num_id": "long", "list_start": "long"}
        return F.struct(*[c.cast(kinds[k]).alias(k) if k in kinds else c.alias(k) for k, c in parts.items()])

    listed = F.col("kind").isin("bullet", "number")
    p = node(
        F.col("p"), F.lit(1), F.col("line_no"), 2, "Paragraph",
        style_id=F.when(F.col("kind") == "heading", F.concat(F.lit("Heading"), F.col("level").cast("string"))),
        list_level=F.when(listed, F.col("level")), list_format=F.when(F.col("kind") == "bullet", "bullet").when(F.col("kind") == "number", "decimal"),
        list_num_id=F.when(listed, 1), list_start=F.when(listed, F.col("start")), page_break_before=F.when(F.col("kind") == "break", True),
    )
    run = node(F.col("p") + 1, F.col("p"), F.lit(0), 3, "Run")
    text = node(F.col("p") + 2, F.col("p") + 1, F.lit(0), 4, "Text", F.col("content"))
    head = F.array(node(F.lit(0), null("long"), F.lit(0), 0, "Document"), node(F.lit(1), F.lit(0), F.lit(0), 1, "Body"))
    body = F.when(F.col("content") == "", F.array(p)).otherwise(F.array(p, run, text))
    every = F.when(F.col("line_no") == 0, F.concat(head, body)).otherwise(body)
    return para.select("doc_id", F.inline(every)).select(*NODE_COLUMNS)
