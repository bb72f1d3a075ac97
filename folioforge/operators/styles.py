"""Styles as rows: lookup, upserts and removals, typed attributes and their precedence, names of automatic styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.operators.tree import resolved_attributes


def style_by_id(styles: DataFrame, order: str) -> DataFrame:
    """The first style of each (doc_id, style_id)."""
    first = W.partitionBy("doc_id", "style_id").orderBy(order)
    return styles.withColumn("__at", F.row_number().over(first)).filter("__at = 1").drop("__at")


def apply_style_log(styles: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Styles (doc_id, style_id, attrs) after a log of doc_id, seq, kind (set or remove), style_id, attrs, and its
    errors (doc_id, seq, style_id): removals of a style that isn't there, which change nothing."""
    base = styles.select("doc_id", F.lit(None).cast("bigint").alias("seq"), F.lit("set").alias("kind"), "style_id", "attrs")
    rows = base.unionByName(log.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "kind", "style_id", "attrs"))
    order = W.partitionBy("doc_id", "style_id").orderBy(F.asc_nulls_first("seq"))
    rows = rows.withColumns({"before": F.lag("kind").over(order), "after": F.lead("kind").over(order)})
    now = rows.filter(F.col("after").isNull() & (F.col("kind") == "set")).select("doc_id", "style_id", "attrs")
    errors = rows.filter((F.col("kind") == "remove") & (F.coalesce("before", F.lit("remove")) == "remove")).select("doc_id", "seq", "style_id")
    return now, errors


def typed(attrs: Column, key: str, kind: str) -> Column:
    """A value of a map of (type, value) structs if it has that type (bool, int, float, string), else null."""
    got = F.try_element_at(attrs, F.lit(key))
    cast = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string"}[kind]
    return F.when(got["type"] == kind, got["value"].try_cast(cast))


def _without(base: Column, over: Column) -> Column:
    return F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))


def merged(*ladder: Column) -> Column:
    """Attribute maps as one; a later map wins over those before it, a null map says nothing."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = none
    for m in ladder:
        said = F.coalesce(m, none)
        out = F.map_concat(_without(out, said), said)
    return out


def node_attributes(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, node_id, attrs): the paragraph's style chain, then the node's own, then its direct attributes.

    ``nodes``: doc_id, node_id, para_style, style_id, attrs; ``styles``: doc_id, style_id, parent_id, attrs."""
    resolved = resolved_attributes(styles)
    side = lambda c, name: resolved.select("doc_id", F.col("style_id").alias(c), F.col("attrs").alias(name))
    both = nodes.join(side("para_style", "__para"), ["doc_id", "para_style"], "left").join(side("style_id", "__own"), ["doc_id", "style_id"], "left")
    return both.select("doc_id", "node_id", merged(F.col("__para"), F.col("__own"), F.col("attrs")).alias("attrs"))


def automatic_names(rows: DataFrame, columns: list[str], prefix: str = "T") -> DataFrame:
    """Adds ``auto_style``: equal formatting of a document shares a name, numbered in the order of its values."""
    distinct = rows.select("doc_id", *columns).dropDuplicates()
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(*columns))
    named = distinct.withColumn("auto_style", F.concat(F.lit(prefix), rank.cast("string")))
    on = rows["doc_id"].eqNullSafe(named["doc_id"])
    for c in columns:
        on = on & rows[c].eqNullSafe(named[c])
    return rows.join(named, on).select(rows["*"], "auto_style")


def first_of_type(refs: Column, kind: Column | str) -> Column:
    """The node of the first header or footer reference (an array of type and node) of a type, null if none."""
    return F.get(F.filter(refs, lambda x: x["type"] == kind), F.lit(0))["node"]


def used(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, values): what a document uses (fonts, pictures), each once, sorted."""
    return rows.filter(F.col(column).isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set(column)).alias("values"))


def package_marks(parts: DataFrame) -> DataFrame:
    """(doc_id, n_signatures, signatures, has_macros) of package parts (doc_id, path)."""
    sign = F.col("path").rlike(r"^_xmlsignatures/sig[^/]*\.xml$")
    names = F.array_join(F.array_sort(F.collect_set(F.when(sign, F.col("path")))), ",")
    return parts.groupBy("doc_id").agg(F.count(F.when(sign, 1)).alias("n_signatures"), names.alias("signatures"), F.max(F.col("path") == "word/vbaProject.bin").alias("has_macros"))
