"""Headings, tables of contents, sections, list numbers and text export over line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import markers


def headings(lined: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title) in document order."""
    return lined.filter(F.col("kind") == "heading").select("doc_id", "line_no", "level", F.col("content").alias("title"))


def toc_entries(lined: DataFrame, max_level: int = 3) -> DataFrame:
    """Entries of a generated table of contents: style, indent and title of headings up to a level."""
    own = headings(lined).filter(F.col("level") <= max_level)
    return own.select("doc_id", "line_no", F.concat(F.lit("TOC"), F.col("level").cast("string")).alias("style_id"), F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.col("title")).alias("entry"))


def sections(lined: DataFrame) -> DataFrame:
    """Each line with the number of page breaks before it and the last heading above it."""
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    title = F.when(F.col("kind") == "heading", F.col("content"))
    return lined.select(
        "doc_id", "line_no", F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(before).cast("long").alias("section_ix"),
        F.last(title, ignorenulls=True).over(before).alias("under"),
    )


def _with_numbers(lined: DataFrame, doc: str, order: str, reset: bool) -> DataFrame:
    """Adds ``number`` to all rows, null but for ordered items. Rows move once: every window starts from ``doc``."""
    run = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    listed = F.col("kind").isin("bullet", "number")
    rows = lined.withColumn("__group", F.sum(F.when(listed, 0).otherwise(1)).over(run)) if reset else lined.repartition(doc).withColumn("__group", F.lit(0))
    key = W.partitionBy(doc, "__group", "level", "kind").orderBy(order)
    first = F.first("start").over(key.rowsBetween(W.unboundedPreceding, W.currentRow))
    number = (F.row_number().over(key) + F.greatest(first - 1, F.lit(0))).cast("long")
    return rows.withColumn("number", F.when(F.col("kind") == "number", number)).drop("__group")


def numbered(items: DataFrame, doc: str = "doc_id", order: str = "line_no", fmt: Column | None = None, reset: bool = True) -> DataFrame:
    """Adds ``number`` and ``label`` to ordered items of rows with kind, level and start.

    Counters run per level and start from the first item's start. With ``reset`` (plain text) any line
    that is no item clears all counters; without it (Markdown) they run through the document."""
    rows = _with_numbers(items, doc, order, reset).filter(F.col("kind") == "number")
    return rows.withColumn("label", markers.item_label(F.lit("decimal") if fmt is None else fmt, F.col("number")))


def text_export(lined: DataFrame) -> DataFrame:
    """(doc_id, text): plain text written from lines. A page break writes its mark and its empty paragraph."""
    rows = _with_numbers(lined, "doc_id", "line_no", reset=True)
    indent = F.repeat(F.lit("  "), F.col("level").cast("int"))
    block = (
        F.when(F.col("kind") == "break", "---\n")
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), "content"))
        .when(F.col("kind") == "bullet", F.concat(indent, F.lit("- "), "content"))
        .when(F.col("kind") == "number", F.concat(indent, F.col("number").cast("string"), F.lit(". "), "content"))
        .otherwise(F.col("content"))
    )
    return joined(rows.select("doc_id", "line_no", block.alias("block")), "line_no", "block", "\n", "text")


def markdown_blocks(lined: DataFrame) -> DataFrame:
    """(doc_id, markdown): block level Markdown. Blocks are set apart by a blank line, but for two list
    items in a row; every ordered item prints a decimal number; numbering never resets."""
    rows = _with_numbers(lined, "doc_id", "line_no", reset=False).filter((F.col("content") != "") | (F.col("kind") == "break"))
    listed = F.col("kind").isin("bullet", "number")
    indent = F.repeat(F.lit("  "), F.col("level").cast("int"))
    block = (
        F.when(F.col("kind") == "break", "---")
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), "content"))
        .when(F.col("kind") == "bullet", F.concat(indent, F.lit("- "), "content"))
        .when(F.col("kind") == "number", F.concat(indent, F.col("number").cast("string"), F.lit(". "), "content"))
        .otherwise(F.col("content"))
    )
    order = W.partitionBy("doc_id").orderBy("line_no")
    gap = F.when(F.lag(listed).over(order).isNull(), "").when(F.lag(listed).over(order) & listed, "\n").otherwise("\n\n")
    return joined(rows.select("doc_id", "line_no", F.concat(gap, block).alias("block")), "line_no", "block", "", "markdown")


def joined(rows: DataFrame, order: str, value: str, separator: str, name: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts of a group, in order, as one."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x[value]), separator).alias(name))
