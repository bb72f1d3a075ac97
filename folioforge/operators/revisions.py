"""Tracked changes, comments, references and media over relational rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.operators.tree import intervals

KNOWN = ("Insert", "Delete", "FormatChange")


def tracked_changes(nodes: DataFrame) -> DataFrame:
    """Rows with a revision, in document order by ``pos``."""
    return nodes.filter(F.col("revision_type").isNotNull()).select("doc_id", "pos", "revision_type", "author", "date")


def decide(nodes: DataFrame, accept: bool, deepest: int | None = None) -> DataFrame:
    """All changes accepted or rejected: deletions go when accepted, insertions when rejected, each with all
    that stands under it; other rows lose their revision columns. Formatting is not restored. Rows without
    a ``depth`` are a flat list."""
    gone = "Delete" if accept else "Insert"
    null = {c: F.lit(None).cast("string") for c in ("revision_type", "author", "date") if c in nodes.columns}
    kept = F.coalesce(F.col("revision_type") != gone, F.lit(True))
    if "depth" not in nodes.columns:
        return nodes.filter(kept).withColumns(null)
    under = F.exists("above", lambda x: F.coalesce(x["revision_type"] == gone, F.lit(False)))
    return intervals(nodes, deepest).filter(kept & ~under).select(*nodes.columns).withColumns(null)


def decide_one(nodes: DataFrame, choices: DataFrame, deepest: int | None = None) -> DataFrame:
    """Single changes: ``choices`` (doc_id, node_id, accept) names the nodes whose change is decided. Others keep
    their marks; a chosen node without a change stays as it is."""
    said = choices.select("doc_id", F.col("node_id").alias("__node"), "accept")
    marked = nodes.join(said, (nodes["doc_id"] == said["doc_id"]) & (nodes["node_id"] == said["__node"]), "left").select(nodes["*"], "accept")
    goes = F.col("accept").isNotNull() & (F.col("revision_type") == F.when(F.col("accept"), "Delete").otherwise("Insert"))
    own = {c: F.when(F.col("accept").isNull(), F.col(c)) for c in ("author", "date") if c in nodes.columns}
    fate = F.when(F.coalesce(goes, F.lit(False)), "gone").when(F.col("accept").isNull(), F.col("revision_type"))
    rows = intervals(marked.withColumn("revision_type", fate).withColumns(own), deepest)
    under = F.exists("above", lambda x: F.coalesce(x["revision_type"] == "gone", F.lit(False)))
    return rows.filter(F.coalesce(F.col("revision_type") != "gone", F.lit(True)) & ~under).select(*nodes.columns)


def comment_threads(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each comment with the one it answers: the last of another role before it."""
    before = W.partitionBy(conv).orderBy(order)
    return turns.select(conv, order, "role", F.lag(order).over(before).alias("answers"), F.count("*").over(W.partitionBy(conv)).alias("n_in_thread"))


def resolve_references(uses: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Uses with their targets; those that dangle keep nulls."""
    return uses.join(targets, key, "left")


def dangling(uses: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    return uses.join(targets, key, "left_anti")


def dedupe_media(media: DataFrame, data: str = "data") -> DataFrame:
    """(media_id, stored_id): each item with the first of equal content. Content is told apart by its
    SHA-256, not by a short hash; copies pre-aggregate before the shuffle."""
    keyed = media.select("media_id", F.sha2(F.col(data), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("media_id").alias("stored_id"))
    return keyed.join(first, "key").select("media_id", "stored_id")
