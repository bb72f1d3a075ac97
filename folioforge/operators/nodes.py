"""Node tables: positions and selections, checks and effects of edits, digests of subtrees, alignment.

Everything is an equi-join by (doc_id, node_id) or a window by doc_id, so a document's rows meet once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.operators.tree import grammar, intervals


def _facts(nodes: DataFrame, prefix: str) -> DataFrame:
    """What checks ask of a node, under columns that start with ``prefix``."""
    return nodes.select("doc_id", F.col("node_id").alias(f"{prefix}_id"), F.col("node_type").alias(f"{prefix}_type"), F.col("parent_id").alias(f"{prefix}_parent"), F.length("text").alias(f"{prefix}_len"))


def check_positions(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``error`` to positions (doc_id, node_id, offset): null, NodeNotFound, NotATextNode or OffsetOutOfBounds."""
    own = _facts(nodes, "at").withColumnRenamed("at_id", "node_id")
    both = positions.join(own, ["doc_id", "node_id"], "left")
    error = (
        F.when(F.col("at_type").isNull(), "NodeNotFound").when(F.col("at_type") != "Text", "NotATextNode")
        .when((F.col("offset") < 0) | (F.col("offset") > F.coalesce("at_len", F.lit(0))), "OffsetOutOfBounds")
    )
    return both.select(*positions.columns, error.alias("error"))


def nodes_in_range(selections: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, selection_id, node_id): Text nodes from anchor_id to focus_id in document order, whichever comes
    first. Where an end is no Text node, the two ends alone; where they are one node, that node."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("node_id"))
    texts = nodes.filter(F.col("node_type") == "Text").select("doc_id", "node_id", rank.alias("rank"))
    end = lambda c: texts.select("doc_id", F.col("node_id").alias(f"{c}_id"), F.col("rank").alias(f"{c}_rank"))
    both = selections.join(end("anchor"), ["doc_id", "anchor_id"], "left").join(end("focus"), ["doc_id", "focus_id"], "left")
    ranged = F.col("anchor_rank").isNotNull() & F.col("focus_rank").isNotNull() & (F.col("anchor_id") != F.col("focus_id"))
    some = both.filter(ranged).select("doc_id", "selection_id", F.explode(F.sequence(F.least("anchor_rank", "focus_rank"), F.greatest("anchor_rank", "focus_rank"))).alias("rank"))
    found = some.join(texts, ["doc_id", "rank"]).select("doc_id", "selection_id", "node_id")
    ends = both.filter(~ranged).select("doc_id", "selection_id", F.explode(F.array_distinct(F.array("anchor_id", "focus_id"))).alias("node_id"))
    return found.unionByName(ends)


def check_ops(ops: DataFrame, nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Adds ``error`` to single operations, tried against the nodes as they are; null where one can be done.

    ``ops``: doc_id, op_id, kind (InsertNode, DeleteNode, MoveNode, InsertText, DeleteText, SetAttributes,
    RemoveAttributes, SetMetadata, SetStyle, RemoveStyle), node_id (the target), parent_id (where to insert or
    move), ix, node_type (of what is inserted), offset, length, style_id. A move into the node's own subtree
    is not looked for here; doing it fails."""
    kids = nodes.filter(F.col("parent_id").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("up_id")).agg(F.count("*").alias("up_kids"))
    rows = ops.join(_facts(nodes, "at").withColumnRenamed("at_id", "node_id"), ["doc_id", "node_id"], "left")
    rows = rows.join(_facts(nodes, "up").withColumnRenamed("up_id", "parent_id"), ["doc_id", "parent_id"], "left")
    rows = rows.join(kids.withColumnRenamed("up_id", "parent_id"), ["doc_id", "parent_id"], "left")
    rows = rows.join(styles.select("doc_id", "style_id", F.lit(True).alias("has_style")).distinct(), ["doc_id", "style_id"], "left")
    kind, missing = F.col("kind"), F.col("at_type").isNull()
    child = F.when(kind == "InsertNode", F.col("node_type")).otherwise(F.col("at_type"))
    allowed = F.broadcast(grammar(nodes.sparkSession)).toDF("up_type", "__child")
    rows = rows.withColumn("__child", child).join(allowed.withColumn("fits", F.lit(True)), ["up_type", "__child"], "left")
    last = F.col("offset") + F.when(kind == "DeleteText", F.col("length")).otherwise(0)
    error = (
        F.when(kind.isin("SetMetadata", "SetStyle"), None)
        .when(kind == "RemoveStyle", F.when(F.col("has_style").isNull(), "StyleNotFound"))
        .when((kind != "InsertNode") & missing, "NodeNotFound")
        .when(kind.isin("InsertNode", "MoveNode") & F.col("up_type").isNull(), "NodeNotFound")
        .when(kind.isin("InsertNode", "MoveNode") & F.col("fits").isNull(), "InvalidHierarchy")
        .when((kind == "InsertNode") & (F.col("ix") > F.coalesce("up_kids", F.lit(0))), "IndexOutOfBounds")
        .when((kind == "DeleteNode") & F.col("at_parent").isNull(), "CannotDeleteRoot")
        .when(kind.isin("InsertText", "DeleteText") & (F.col("at_type") != "Text"), "NotATextNode")
        .when(kind.isin("InsertText", "DeleteText") & (last > F.coalesce("at_len", F.lit(0))), "TextOffsetOutOfBounds")
    )
    return rows.select(*ops.columns, error.alias("error"))


def top_blocks(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, node_id, body_id, top_id): for nodes below a Body, that body's child they are or stand under."""
    rows = intervals(nodes, deepest)
    path = F.concat("above", F.array(F.struct("pos", "node_id", "node_type", *(["revision_type"] if "revision_type" in nodes.columns else []))))
    body = F.array_position(F.transform(path, lambda x: x["node_type"]), "Body").cast("int")
    return rows.select("doc_id", "node_id", F.get(path, body - 1)["node_id"].alias("body_id"), F.get(path, body)["node_id"].alias("top_id")).filter((F.col("top_id").isNotNull()) & (F.col("body_id").isNotNull()))


def dirty_blocks(ops: DataFrame, nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, op_id, structural, dirty): whether an operation changes a body's list of blocks, and else the
    blocks that it touches, sorted. Metadata and styles touch none, kinds that aren't known count as structural."""
    tops = top_blocks(nodes, deepest)
    parents = nodes.select("doc_id", "node_id", F.col("parent_id").alias("own_parent"), F.col("node_type").alias("own_type"))
    end = lambda c: tops.select("doc_id", F.col("node_id").alias(c), F.col("top_id").alias(f"{c}_top"))
    types = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("new_type"))
    ups = nodes.select("doc_id", F.col("node_id").alias("own_parent"), F.col("node_type").alias("under"))
    rows = ops.join(end("node_id"), ["doc_id", "node_id"], "left").join(end("parent_id"), ["doc_id", "parent_id"], "left")
    rows = rows.join(parents, ["doc_id", "node_id"], "left").join(types, ["doc_id", "parent_id"], "left").join(ups, ["doc_id", "own_parent"], "left")
    kind, truth = F.col("kind"), lambda c: F.coalesce(c, F.lit(False))
    none = F.array().cast("array<bigint>")
    from_body, to_body = truth(F.col("under") == "Body"), truth(F.col("new_type") == "Body")
    known = kind.isin("InsertNode", "DeleteNode", "MoveNode", "InsertText", "DeleteText", "SetAttributes", "RemoveAttributes", "SetMetadata", "SetStyle", "RemoveStyle")
    structural = F.when(kind == "InsertNode", to_body).when(kind == "DeleteNode", from_body).when(kind == "MoveNode", from_body | to_body).otherwise(~known)
    touched = (
        F.when(kind == "InsertNode", F.array("parent_id_top")).when(kind == "MoveNode", F.array("node_id_top", "parent_id_top"))
        .when(kind.isin("SetMetadata", "SetStyle", "RemoveStyle"), none).otherwise(F.array("node_id_top"))
    )
    return rows.select("doc_id", "op_id", structural.alias("structural"), F.when(structural, none).otherwise(F.array_sort(F.array_distinct(F.array_compact(touched)))).alias("dirty"))


def subtree_digests(nodes: DataFrame, node_type: str = "Paragraph", deepest: int | None = None) -> DataFrame:
    """(doc_id, node_id, digest): SHA-256 over a subtree's rows in document order, each its depth below the
    subtree's root, type and text. Equal subtrees have equal digests wherever they stand."""
    rows = intervals(nodes, deepest)
    inside = F.concat(F.transform("above", lambda x: F.struct(x["node_id"].alias("id"), x["node_type"].alias("kind"))), F.array(F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("kind"))))
    each = rows.select("doc_id", "pos", "depth", "node_type", "text", F.posexplode(inside).alias("level", "root")).filter(F.col("root.kind") == node_type)
    line = F.concat_ws(":", F.col("depth") - F.col("level"), "node_type", F.coalesce("text", F.lit("")))
    own = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return each.groupBy("doc_id", F.col("root.id").alias("node_id")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), 256).alias("digest"))


def census(nodes: DataFrame) -> DataFrame:
    """(node_type, n, n_docs): how often each kind of node occurs."""
    per_doc = nodes.groupBy("doc_id", "node_type").agg(F.count("*").alias("k"))
    return per_doc.groupBy("node_type").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


def runs_of(rows: DataFrame, marked: Column, doc: str = "doc_id", order: str = "ix") -> DataFrame:
    """(doc, first, last, n): maximal runs of neighbouring marked rows."""
    w = W.partitionBy(doc).orderBy(order)
    placed = rows.select(doc, order, marked.alias("m"), F.row_number().over(w).alias("at")).filter("m")
    island = placed.withColumn("island", F.col("at") - F.row_number().over(w))
    return island.groupBy(doc, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str, doc: str = "doc_id") -> DataFrame:
    """(doc, ix, left, right): items of two lists of a document by their places, only where both lists are as long."""
    place = lambda df, order, name: df.select(
        doc, (F.row_number().over(W.partitionBy(doc).orderBy(order)) - 1).cast("long").alias("ix"), F.count("*").over(W.partitionBy(doc)).alias("size"), F.col(order).alias(name)
    )
    return place(left, left_order, "left").join(place(right, right_order, "right"), [doc, "size", "ix"]).select(doc, "ix", "left", "right")


def toc_of(headings: DataFrame, tocs: DataFrame) -> DataFrame:
    """Entries of each table of contents (doc_id, toc_id, max_level): the document's headings (line_no, level,
    title) up to its level."""
    rows = tocs.join(headings, "doc_id").filter(F.col("level") <= F.col("max_level"))
    return rows.select("doc_id", "toc_id", "line_no", F.concat(F.lit("TOC"), F.col("level").cast("string")).alias("style_id"), "title")


def comment_ranges(marks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Comments by id: where each starts and ends (rows of doc_id, comment_id, kind start or end, pos) and its
    body; a range without body or a body without range keeps nulls."""
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("pos")))
    ranges = marks.groupBy("doc_id", "comment_id").agg(at("start").alias("starts"), at("end").alias("ends"))
    return ranges.join(bodies, ["doc_id", "comment_id"], "full").select("doc_id", "comment_id", "starts", "ends", "body")
