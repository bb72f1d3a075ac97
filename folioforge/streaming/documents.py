"""Documents and edit logs as streams.

Reading, exporting and converting are row-local, so they run unchanged in append mode and need no state.
Edits need each document's tree and history: they are kept as state by doc_id, updated by every batch of
operations, which must arrive in order of transactions."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import edits
from folioforge.plans import api


def documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files that arrive in a folder as (doc_id, path, content, format); the format is that of the extension,
    else of the content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(path)
    from folioforge.functions import formats

    found = F.coalesce(formats.format_of_path(F.col("path")), formats.format_of_bytes(F.col("content")))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content", found.alias("format"))


def converted(stream: DataFrame, to: str, fmt: str | None = None) -> DataFrame:
    return api.convert(stream, to, fmt)


def edited(ops: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, n_applied, n_failed) after each batch of operations (columns of ``edits.OPS``) on
    documents that start empty; an update stream."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        history, applied, failed = pickle.loads(state.get[0]) if state.exists else (edits.History(_empty()), 0, 0)
        log = pd.concat(list(batches))
        for _, txn in log.sort_values(["txn", "seq"]).groupby("txn", sort=True):
            kinds = list(txn["kind"])
            if kinds[0] in ("undo", "redo"):
                done = getattr(history, kinds[0])()
                applied, failed = applied + done, failed + (not done)
                continue
            try:
                history.edit([(r.kind, None if pd.isna(r.node_id) else int(r.node_id), json.loads(r.args) if isinstance(r.args, str) else {}) for r in txn.itertuples()])
                applied += 1
            except edits.EditError:
                failed += 1
        state.update((pickle.dumps((history, applied, failed)),))
        yield pd.DataFrame({"doc_id": [key[0]], "n_nodes": [len(history.tree.nodes)], "n_applied": [applied], "n_failed": [failed]})

    return ops.groupBy("doc_id").applyInPandasWithState(fold, "doc_id bigint, n_nodes bigint, n_applied bigint, n_failed bigint", "history binary", "update", "NoTimeout")


def _empty() -> edits.Tree:
    tree = edits.Tree({0: {"parent": None, "kind": "Document", "text": None, "attrs": {}, "kids": []}})
    tree.insert(0, 0, 1, "Body")
    return tree
