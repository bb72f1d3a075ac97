"""Queries on node tables: children, ancestors, descendants, counts, grammar, styles, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.scratch import Scratch

#: Which node types may stand under which.
GRAMMAR = {
    "Document": "Body Header Footer CommentBody FootnoteBody EndnoteBody",
    "Body": "Section Paragraph Table Image TableOfContents PageBreak ColumnBreak",
    "Section": "Paragraph Table Image TableOfContents",
    "TableOfContents": "Paragraph",
    "Paragraph": "Run LineBreak PageBreak ColumnBreak Tab Image Drawing Field Equation BookmarkStart BookmarkEnd CommentStart CommentEnd FootnoteRef EndnoteRef",
    "Run": "Text",
    "Table": "TableRow",
    "TableRow": "TableCell",
    "TableCell": "Paragraph Table",
    "Header": "Paragraph Table",
    "Footer": "Paragraph Table",
    "CommentBody": "Paragraph",
    "FootnoteBody": "Paragraph",
    "EndnoteBody": "Paragraph",
}


def grammar(spark: SparkSession) -> DataFrame:
    """(parent_type, node_type): a table of fixed size."""
    return spark.createDataFrame([(p, c) for p, cs in GRAMMAR.items() for c in cs.split()], "parent_type string, node_type string")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum(F.length("text")).alias("text_len"))


def children(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, n_children, kids): ids of children in order, for nodes that have some."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("child_ix", "node_id"))), lambda x: x["node_id"])
    own = nodes.filter(F.col("parent_id").isNotNull()).groupBy("doc_id", "parent_id").agg(kids.alias("kids"))
    return own.select("doc_id", F.col("parent_id").alias("node_id"), F.size("kids").cast("long").alias("n_children"), "kids")


def intervals(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """Adds ``pos``, a node's place in document order, ``above``, its ancestors from the root down to its
    parent (pos, node_id, node_type and, where there is one, revision_type), and ``ancestors``, their ids.
    Readers hand out ids in document order, so the place is the rank of the id, and the ancestor of a depth
    is the last node of that depth before. ``deepest`` is the largest depth, counted if it isn't given."""
    if deepest is None:
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
    order = W.partitionBy("doc_id").orderBy("node_id")
    placed = nodes.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    path = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.struct("pos", "node_id", "node_type", *(["revision_type"] if "revision_type" in nodes.columns else []))
    levels = [F.last(F.when(F.col("depth") == d, own), ignorenulls=True).over(path) for d in range(max(int(deepest), 1))]
    placed = placed.withColumn("above", F.array(*levels))
    placed = placed.withColumn("above", F.slice("above", F.lit(1), F.col("depth").cast("int")))
    return placed.withColumn("ancestors", F.transform("above", lambda x: x["node_id"]))


def descendants(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, node_id, n_descendants): an equi-join-free count by exploding each node's ancestors."""
    up = intervals(nodes, deepest).select("doc_id", F.explode("ancestors").alias("node_id"))
    return up.groupBy("doc_id", "node_id").agg(F.count("*").alias("n_descendants"))


def is_descendant(pairs: DataFrame, nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """Adds ``below`` to pairs (doc_id, node_id, ancestor_id): whether the ancestor stands above the node."""
    paths = intervals(nodes, deepest).select("doc_id", "node_id", "ancestors")
    both = pairs.join(paths, ["doc_id", "node_id"], "left")
    return both.select(*pairs.columns, F.coalesce(F.array_contains("ancestors", F.col("ancestor_id")), F.lit(False)).alias("below"))


def roots(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_id, body_id): the node without parent and the first Body."""
    return nodes.groupBy("doc_id").agg(F.min(F.when(F.col("parent_id").isNull(), F.col("node_id"))).alias("root_id"), F.min(F.when(F.col("node_type") == "Body", F.col("node_id"))).alias("body_id"))


def grammar_violations(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_type, node_type) of nodes that may not stand where they stand."""
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"))
    pairs = nodes.select("doc_id", "node_id", "parent_id", "node_type").join(parents, ["doc_id", "parent_id"])
    return pairs.join(F.broadcast(grammar(nodes.sparkSession)), ["parent_type", "node_type"], "left_anti").select("doc_id", "node_id", "parent_type", "node_type")


def plain_text(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, text): texts of paragraphs, those of table cells too, in document order; empty paragraphs
    leave at most a last line end."""
    near = F.filter("above", lambda x: x["node_type"] == "Paragraph")
    para = F.when(F.col("node_type") == "Paragraph", F.col("node_id")).otherwise(F.get(near, F.size(near) - 1)["node_id"])
    rows = intervals(nodes, deepest).select("doc_id", "pos", para.alias("para"), "text").filter("para IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    paras = rows.groupBy("doc_id", "para").agg(joined.alias("t"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("para", "t"))), lambda x: x["t"])
    texts = paras.groupBy("doc_id").agg(each.alias("ts"))
    full = F.filter("ts", lambda x: x != "")
    return texts.select("doc_id", F.concat(F.array_join(full, "\n"), F.when((F.size(full) > 0) & (F.element_at("ts", -1) == ""), "\n").otherwise("")).alias("text"))


def _first(styles: DataFrame, own: Column) -> DataFrame:
    return styles.select("doc_id", "style_id", own.alias("value"), F.col("style_id").alias("low"), F.col("parent_id").alias("next"))


def _climbed(scratch: Scratch, first: DataFrame, merged: Callable[[Column, Column], Column], most: int | None = None) -> DataFrame:
    """(doc_id, style_id, value, low, next): the value of a style merged with that of its parents, nearest first, each
    once or oftener; ``merged`` must not change by what is merged again. ``first`` is written and stays.

    Each round doubles the reach of the pointers that haven't come to an end: a style without parent, one that isn't
    there, or a cycle. A walk has gone round when its first and its second half have the same least style, which then
    stands in it twice. So there are about as many rounds as the logarithm of the longest chain or cycle, whatever the
    number of styles, and each is written, since a plan of all rounds would double with each. After ``most`` rounds
    ``next`` remains of the chains that are longer."""
    now, n = first, 0
    while n != most and not now.filter("next IS NOT NULL").isEmpty():
        step = now.select("doc_id", F.col("style_id").alias("next"), F.col("value").alias("more"), F.col("low").alias("then"), F.col("next").alias("beyond"))
        # Written chains are packed so well that their size in files would have them broadcast.
        both = now.filter("next IS NOT NULL").join(step.hint("merge"), ["doc_id", "next"], "left")
        value = F.when(F.col("then").isNull(), F.col("value")).otherwise(merged(F.col("value"), F.col("more")))
        moved = both.select("doc_id", "style_id", value.alias("value"), F.least("low", "then").alias("low"), F.when(~F.col("low").eqNullSafe(F.col("then")), F.col("beyond")).alias("next"))
        before, now, n = now, scratch.write(now.filter("next IS NULL").union(moved), "chains"), n + 1
        if before is not first:
            scratch.drop(before)
    return now


#: After so many rounds, chains of 32 styles, the chains of a document that has a longer one are no longer written.
ROUNDS = 5
#: A copy of a document's paths for so many links of its chains as it has styles.
COPY = 1000
#: Bytes or rows of an Arrow batch of chains.
BATCH, BATCH_ROWS = 4 << 20, 10_000


def _depths(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Styles on the way up, itself included, and where the way ends: beyond the last style, or on a cycle."""
    n = len(up)
    at, depth = np.append(np.where(up < 0, n, up), n), np.append(np.ones(n, "int64"), 0)
    for _ in range(n.bit_length()):
        depth, at = depth + depth[at], at[at]
    return depth[:n], at[:n]


def _paths(group: pa.Table) -> pa.Table:
    """The styles of a document dealt over paths from a leaf upward, each style on one, cycles as paths of their own:
    ids in this order, where paths start, what stands above their tops (-1: nothing) and which are cycles. ``parts`` are
    ranges of styles whose chains have about equally many links."""
    group = group.combine_chunks()
    n, found = group.num_rows, pc.index_in(group["parent_id"], value_set=group["style_id"].combine_chunks(), skip_nulls=True)
    up = pc.fill_null(found, -1).to_numpy().astype("int64")
    depth, ends = _depths(up)
    ring = np.zeros(n, bool)
    ring[ends[ends < n]] = True
    if ring.any():
        depth, _ = _depths(np.where(ring, -1, up))
    child, height, parent, round_ = [-1] * n, [0] * n, up.tolist(), ring.tolist()
    for i in np.argsort(-depth, kind="stable").tolist():
        p = parent[i]
        if p >= 0 and not round_[i] and (child[p] < 0 or height[i] >= height[p]):
            child[p], height[p] = i, height[i] + 1
    order, starts, above, rings = [], [], [], []
    size = np.zeros(n, "int64")  # of the cycle a style is on
    seen = set()
    for i in np.flatnonzero(ring).tolist():
        if i not in seen:
            own = [i]
            while (i := parent[i]) != own[0]:
                own.append(i)
            seen.update(own)
            size[own] = len(own)
            starts.append(len(order)), above.append(-1), rings.append(True)
            order += own
    for i in range(n):
        if child[i] < 0 and not round_[i]:
            starts.append(len(order)), rings.append(False)
            order.append(i)
            while (p := parent[i]) >= 0 and not round_[p] and child[p] == i:
                order.append(i := p)
            above.append(p)
    place = np.empty(n + 1, "int64")
    place[order], place[n] = np.arange(n), -1
    # A chain that comes to a cycle has its styles before that and the cycle's, whose first one is in both.
    links = np.cumsum((depth + np.append(size, 1)[ends] - 1)[order])
    parts = min(n, max(1, -(-int(links[-1]) // (COPY * n))))
    cuts = [0, *np.unique(np.searchsorted(links, links[-1] * np.arange(1, parts) // parts, "right")).tolist(), n]
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], "int32"), x)
    mine = pa.array(order, "int64")
    made = {
        "doc_id": group["doc_id"].combine_chunks()[:1], "ids": lists(group["style_id"].combine_chunks().take(mine)), "labels": lists(group["label"].combine_chunks().take(mine)),
        "starts": lists(pa.array(starts, "int32")), "above": lists(pa.array(place[above], "int32")), "rings": lists(pa.array(rings, "bool")),
        "parts": pa.array([[{"lo": a, "hi": b} for a, b in zip(cuts, cuts[1:]) if a < b]], pa.list_(pa.struct([("lo", "int32"), ("hi", "int32")]))),
    }
    return pa.table(made)


def _ways(starts: np.ndarray, above: list[int], rings: list[bool], n: int, lo: int, hi: int) -> Iterator[tuple[range, np.ndarray, int | None]]:
    """(styles, way, length) of the paths that have styles in lo to hi: the chain of the k-th of these styles is ``way``
    from its k-th place on, to the end or, on a cycle, for ``length`` styles."""
    ends = np.append(starts[1:], n)
    for k in range(int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi))):
        a, b = max(lo, int(starts[k])), int(ends[k])
        way, u = [np.arange(a, b)], above[k]
        if rings[k]:
            way.append(np.arange(starts[k], b))
        while u >= 0:
            j = int(np.searchsorted(starts, u, "right")) - 1
            way.append(np.arange(u, ends[j]))
            if rings[j]:
                way.append(np.arange(starts[j], u))
            u = above[j]
        yield range(a, min(b, hi)), np.concatenate(way), b - int(starts[k]) if rings[k] else None


def _unrolled(sep: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chains of parts of documents, as texts joined by ``sep`` or as arrays. A path and what is above it are joined
    once, and the chains of its styles cut from that."""
    between = (sep or "").encode()

    def part(doc: pa.Array, ids: pa.Array, labels: pa.Array, ways: Iterator[tuple[range, np.ndarray, int | None]]) -> Iterator[pa.RecordBatch]:
        styles, cut, ends = [], [], [0]
        said = [] if sep is None else [x if x is None else x.encode() for x in labels.to_pylist()]
        wide = np.array([0 if x is None else len(x) + len(between) for x in said], "int64")  # nulls are left out, as by array_join

        def made() -> pa.RecordBatch:
            if sep is None:
                chains = pa.ListArray.from_arrays(pa.array(ends, "int32"), labels.take(pa.array(np.concatenate(cut))))
            else:
                chains = pa.StringArray.from_buffers(len(styles), pa.py_buffer(np.array(ends, "int32")), pa.py_buffer(b"".join(cut)))
            docs = doc.take(pa.array(np.zeros(len(styles), "int32")))
            return pa.RecordBatch.from_arrays([docs, ids.take(pa.array(styles, "int64")), chains], ["doc_id", "style_id", "chain"])

        for own, way, length in ways:
            if sep is None:
                whole, at = way, range(len(way) + 1)
            else:
                whole = memoryview(between.join([x for i in way.tolist() if (x := said[i]) is not None]))
                at = np.append(0, np.cumsum(wide[way])).tolist()
            for k, i in enumerate(own):
                styles.append(i)
                cut.append(whole[at[k] :] if length is None else whole[at[k] : at[k + length] - len(between)])
                ends.append(ends[-1] + len(cut[-1]))
                if ends[-1] * (8 if sep is None else 1) >= BATCH or len(styles) >= BATCH_ROWS:
                    yield made()
                    styles, cut, ends = [], [], [0]
        if styles:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                ids, labels, starts, above, rings = (rows[c][r].values for c in ("ids", "labels", "starts", "above", "rings"))
                ways = _ways(starts.to_numpy(), above.to_pylist(), rings.to_pylist(), len(ids), rows["lo"][r].as_py(), rows["hi"][r].as_py())
                yield from part(rows["doc_id"][r : r + 1], ids, labels, ways)

    return run


def style_chains(styles: DataFrame, sep: str | None = None) -> DataFrame:
    """(doc_id, style_id, chain): a style and its parents, nearest first; a cycle ends the chain, and so does a parent
    that does not exist. ``styles`` has doc_id, style_id, parent_id. With ``sep`` chains are texts joined by it.

    The lengths of chains add up to the square of a long one, so the chains of documents that have a long one are only
    made as rows of the result, from paths, whose size is that of the document's table of styles. A document with a
    style id that comes twice has a chain for each choice and stays with the rounds."""
    scratch = Scratch(styles.sparkSession)
    first = scratch.write(_first(styles, F.array("style_id")), "chains")
    merged = lambda near, far: F.array_distinct(F.concat(near, far))
    said = F.col("value") if sep is None else F.array_join("value", sep)
    out = lambda df: df.select("doc_id", "style_id", said.alias("chain"))
    near = _climbed(scratch, first, merged, ROUNDS)
    beyond = near.filter("next IS NOT NULL").select("doc_id").distinct()
    if beyond.isEmpty():
        return out(near)
    twice = first.join(beyond, "doc_id", "left_semi").filter("style_id IS NOT NULL").groupBy("doc_id", "style_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id").distinct()
    far = scratch.write(beyond.join(twice, "doc_id", "left_anti"), "far")
    rest = scratch.write(near.join(far, "doc_id", "left_anti"), "chains")
    scratch.drop(near)
    kind, doc = (styles.schema[c].dataType.simpleString() for c in ("style_id", "doc_id"))
    label, kind_of_label = (F.col("style_id"), kind) if sep is None else (F.col("style_id").cast("string"), "string")
    own = first.join(far, "doc_id", "left_semi").select("doc_id", "style_id", F.col("next").try_cast(kind).alias("parent_id"), label.alias("label"))
    paths = own.groupBy("doc_id").applyInArrow(_paths, f"doc_id {doc}, ids array<{kind}>, labels array<{kind_of_label}>, starts array<int>, above array<int>, rings array<boolean>, parts array<struct<lo:int,hi:int>>")
    parts = paths.select("doc_id", "ids", "labels", "starts", "above", "rings", F.inline("parts")).repartition("doc_id", "lo")
    chain = f"array<{kind}>" if sep is None else "string"
    return out(_climbed(scratch, rest, merged)).union(parts.mapInArrow(_unrolled(sep), f"doc_id {doc}, style_id {kind}, chain {chain}"))


def resolved_attributes(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, attrs): attributes (a map) merged along the chain, the nearer style wins. Chains themselves,
    whose lengths add up to the square of a long one, are not made."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    over = lambda near, far: F.map_concat(near, F.map_filter(far, lambda k, _: ~F.map_contains_key(near, k)))
    scratch = Scratch(styles.sparkSession)
    first = scratch.write(_first(styles, F.coalesce("attrs", none)), "chains")
    rows = _climbed(scratch, first, over).groupBy("doc_id", "style_id").agg(F.collect_list("value").alias("values"))
    attrs = F.aggregate("values", none, over)  # of one map, if style ids are distinct
    return rows.select("doc_id", "style_id", F.map_from_entries(F.array_sort(F.map_entries(attrs))).alias("attrs")).filter(F.size("attrs") > 0)


def numbering(uses: DataFrame, instances: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds num_format and start to uses (doc_id, num_id, level): an override comes before the abstract
    definition, a start override before either definition's start."""
    over = overrides.select("doc_id", "num_id", "level", F.col("start_override").alias("o_start"), F.col("num_format").alias("o_format"), F.col("start").alias("o_def"))
    base = instances.join(levels, ["doc_id", "abstract_num_id"]).select("doc_id", "num_id", "level", F.col("num_format").alias("a_format"), F.col("start").alias("a_start"))
    out = uses.join(over, ["doc_id", "num_id", "level"], "left").join(base, ["doc_id", "num_id", "level"], "left")
    return out.select(*uses.columns, F.coalesce("o_format", "a_format").alias("num_format"), F.coalesce("o_start", "o_def", "a_start").alias("start"))
