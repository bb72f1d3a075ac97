"""Edits of documents: a log of operations folded over each document's nodes, with undo and redo.

Order matters within a document, documents are independent: operations and nodes meet in one shuffle by
doc_id, and each document is folded on its own. A transaction is applied whole or not at all."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Node rows as an edit sees them; attrs is a JSON object.
NODES = "doc_id bigint, node_id bigint, parent_id bigint, child_ix bigint, node_type string, text string, attrs string"
OPS = "doc_id bigint, txn bigint, seq bigint, kind string, node_id bigint, args string"

_ALLOWED: dict[str, set[str]] = {}


def _grammar() -> dict[str, set[str]]:
    if not _ALLOWED:
        from folioforge.operators.tree import GRAMMAR

        _ALLOWED.update({p: set(c.split()) for p, c in GRAMMAR.items()})
    return _ALLOWED


class EditError(ValueError):
    pass


@dataclass
class Tree:
    """Nodes by id: parent, kind, text, attrs and ordered children."""

    nodes: dict[int, dict] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def need(self, i: int) -> dict:
        if i not in self.nodes:
            raise EditError(f"no node {i}")
        return self.nodes[i]

    def insert(self, parent: int, ix: int, i: int, kind: str, text: str | None = None, attrs: dict | None = None) -> list:
        up = self.need(parent)
        if i in self.nodes:
            raise EditError(f"node {i} is there already")
        if kind not in _grammar().get(up["kind"], ()):
            raise EditError(f"{kind} may not stand in {up['kind']}")
        if not 0 <= ix <= len(up["kids"]):
            raise EditError("index out of bounds")
        up["kids"].insert(ix, i)
        self.nodes[i] = {"parent": parent, "kind": kind, "text": text, "attrs": dict(attrs or {}), "kids": []}
        return ["delete", i, {}]

    def subtree(self, i: int) -> list[int]:
        out = [i]
        for k in self.nodes[i]["kids"]:
            out += self.subtree(k)
        return out

    def delete(self, i: int) -> list:
        own = self.need(i)
        if own["parent"] is None:
            raise EditError("the root can't go")
        kids = self.nodes[own["parent"]]["kids"]
        ix = kids.index(i)
        snapshot = {k: copy.deepcopy(self.nodes[k]) for k in self.subtree(i)}
        kids.pop(ix)
        for k in snapshot:
            del self.nodes[k]
        return ["restore", i, {"parent": own["parent"], "ix": ix, "nodes": snapshot}]

    def restore(self, i: int, parent: int, ix: int, nodes: dict) -> list:
        self.need(parent)["kids"].insert(ix, i)
        self.nodes.update(copy.deepcopy(nodes))
        return ["delete", i, {}]

    def move(self, i: int, parent: int, ix: int) -> list:
        own, up = self.need(i), self.need(parent)
        if own["parent"] is None or parent in self.subtree(i):
            raise EditError("a node can't move into itself")
        if own["kind"] not in _grammar().get(up["kind"], ()):
            raise EditError(f"{own['kind']} may not stand in {up['kind']}")
        old = self.nodes[own["parent"]]["kids"]
        was = [own["parent"], old.index(i)]
        old.remove(i)
        up["kids"].insert(min(max(ix, 0), len(up["kids"])), i)
        own["parent"] = parent
        return ["move", i, {"parent": was[0], "ix": was[1]}]

    def insert_text(self, i: int, at: int, text: str) -> list:
        own = self.need(i)
        if own["kind"] != "Text" or not 0 <= at <= len(own["text"] or ""):
            raise EditError("text offset out of bounds")
        own["text"] = (own["text"] or "")[:at] + text + (own["text"] or "")[at:]
        return ["delete_text", i, {"at": at, "count": len(text)}]

    def delete_text(self, i: int, at: int, count: int) -> list:
        own = self.need(i)
        text = own["text"] or ""
        if own["kind"] != "Text" or at < 0 or count < 0 or at + count > len(text):
            raise EditError("text range out of bounds")
        own["text"] = text[:at] + text[at + count :]
        return ["insert_text", i, {"at": at, "text": text[at : at + count]}]

    def set_attrs(self, i: int, attrs: dict) -> list:
        """A value of null removes a key."""
        own = self.need(i)["attrs"]
        before = {k: own.get(k) for k in attrs}
        for k, v in attrs.items():
            if v is None:
                own.pop(k, None)
            else:
                own[k] = v
        return ["set_attrs", i, {"attrs": before}]

    def set_meta(self, _i: int | None, key: str, value: str | None) -> list:
        before = self.meta.get(key)
        if value is None:
            self.meta.pop(key, None)
        else:
            self.meta[key] = value
        return ["set_meta", None, {"key": key, "value": before}]

    KINDS = ("insert", "delete", "restore", "move", "insert_text", "delete_text", "set_attrs", "set_meta")

    def apply(self, kind: str, i: int | None, args: dict) -> list:
        """Applies one operation and returns its inverse."""
        if kind not in self.KINDS:
            raise EditError(f"no operation {kind}")
        if kind == "insert":
            return self.insert(args["parent"], args["ix"], i, args["kind"], args.get("text"), args.get("attrs"))
        if kind == "delete":
            return self.delete(i)
        return getattr(self, kind)(i, **args)

    def transact(self, ops: list[tuple[str, int | None, dict]]) -> list:
        """Applies all or none; returns the inverse operations, the last first."""
        back: list = []
        try:
            for op in ops:
                back.insert(0, self.apply(*op))
        except (EditError, KeyError, TypeError) as e:
            for op in back:
                self.apply(*op)
            raise EditError(str(e)) from e
        return back


@dataclass
class History:
    """Two stacks of inverse transactions; a new edit clears what could be redone."""

    tree: Tree
    most: int = 100
    undo_stack: list = field(default_factory=list)
    redo_stack: list = field(default_factory=list)

    def edit(self, ops: list) -> None:
        self.undo_stack.append(self.tree.transact(ops))
        self.undo_stack = self.undo_stack[-self.most :]
        self.redo_stack.clear()

    def undo(self) -> bool:
        return self._step(self.undo_stack, self.redo_stack)

    def redo(self) -> bool:
        return self._step(self.redo_stack, self.undo_stack)

    def _step(self, taken: list, given: list) -> bool:
        """A transaction that fails keeps its place on its stack."""
        if not taken:
            return False
        given.append(self.tree.transact(taken[-1]))
        taken.pop()
        return True

    def clear(self) -> None:
        self.undo_stack.clear()
        self.redo_stack.clear()


def _built(rows: list[dict]) -> Tree:
    """A tree of node rows, whose missing values are None."""
    tree, last = Tree(), float("inf")
    rows = sorted(rows, key=lambda r: tuple(last if r[c] is None else r[c] for c in ("child_ix", "node_id")))
    for r in rows:
        tree.nodes[r["node_id"]] = {"parent": r["parent_id"], "kind": r["node_type"], "text": r["text"], "attrs": json.loads(r["attrs"]) if r["attrs"] is not None else {}, "kids": []}
    for r in rows:
        if r["parent_id"] in tree.nodes and r["parent_id"] is not None:
            tree.nodes[r["parent_id"]]["kids"].append(r["node_id"])
    return tree


def _dicts(rows: pd.DataFrame, numbers: tuple[str, ...], texts: tuple[str, ...]) -> list[dict]:
    columns = [[None if pd.isna(x) else int(x) for x in rows[c]] for c in numbers] + [[x if isinstance(x, str) else None for x in rows[c]] for c in texts]
    return [dict(zip((*numbers, *texts), r, strict=True)) for r in zip(*columns, strict=True)]


def tree_of(rows: pd.DataFrame) -> Tree:
    return _built(_dicts(rows, ("node_id", "parent_id", "child_ix"), ("node_type", "text", "attrs")))


def rows_of(doc_id: int, tree: Tree) -> pd.DataFrame:
    out = []
    place = {kid: ix for n in tree.nodes.values() for ix, kid in enumerate(n["kids"])}
    for i, n in tree.nodes.items():
        out.append((doc_id, i, n["parent"], place.get(i, 0), n["kind"], n["text"], json.dumps(n["attrs"], sort_keys=True)))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])
    frame["parent_id"] = frame["parent_id"].astype("Int64")
    return frame


def _replayed(tree: Tree, log: list[dict]) -> list[tuple[int, bool, str | None]]:
    """Changes the tree by a log; of each transaction whether it took effect, else why not. Rows without a
    transaction's number belong to none."""
    history, outcomes, last = History(tree), [], float("inf")
    rows = sorted((r for r in log if r["txn"] is not None), key=lambda r: (r["txn"], last if r["seq"] is None else r["seq"]))
    for number, group in groupby(rows, key=lambda r: r["txn"]):
        txn = list(group)
        kind = txn[0]["kind"]
        try:
            if kind in ("undo", "redo"):
                done, error = getattr(history, kind)(), f"nothing to {kind}"
            else:
                history.edit([(r["kind"], r["node_id"], json.loads(r["args"]) if r["args"] is not None else {}) for r in txn])
                done, error = True, None
        except EditError as e:  # a transaction that fails leaves no trace
            done, error = False, str(e)
        outcomes.append((number, done, None if done else error))
    return outcomes


def apply_log(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Node rows after the log: transactions in order, each whole or not at all; ``undo`` and ``redo`` are
    transactions of their own. A document without nodes has none afterwards."""

    def fold(key, own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        tree = tree_of(own) if len(own) else Tree()
        if len(own):
            _replayed(tree, _dicts(log, ("txn", "seq", "node_id"), ("kind", "args")))
        return rows_of(key[0], tree)

    return nodes.groupBy("doc_id").cogroup(ops.groupBy("doc_id")).applyInPandas(fold, NODES)


OUTCOMES = "doc_id bigint, txn bigint, done boolean, error string, meta map<string,string>"


def log_outcomes(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, txn, done, error, meta): what became of each transaction of the log, and on each document's last
    one its metadata afterwards. Transactions of a document without nodes are not done.

    Nodes and log come to Python as two lists a document, many documents a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, txns, dones, errors, metas = [], [], [], [], []
            for doc_id, own, log in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist(), b.column("log").to_pylist(), strict=True):
                if own:
                    outcomes = _replayed(tree := _built(own), log)
                else:
                    tree, outcomes = Tree(), [(t, False, "the document has no nodes") for t in sorted({r["txn"] for r in log if r["txn"] is not None})]
                for t, done, error in outcomes:
                    ids.append(doc_id)
                    txns.append(t)
                    dones.append(done)
                    errors.append(error)
                    metas.append(None)
                if outcomes:
                    metas[-1] = [(k, str(v)) for k, v in tree.meta.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(txns, pa.int64()), pa.array(dones, pa.bool_()), pa.array(errors, pa.string()), pa.array(metas, pa.map_(pa.string(), pa.string()))],
                names=["doc_id", "txn", "done", "error", "meta"],
            )

    def listed(rows: DataFrame, kinds: str, name: str) -> DataFrame:
        of = [F.col(c).cast(t).alias(c) for c, t in (k.split() for k in kinds.split(", ")[1:])]
        return rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_list(F.struct(*of)).alias(name))

    logs, own = listed(ops, OPS, "log"), listed(nodes, NODES, "own").withColumnRenamed("doc_id", "__id")
    both = logs.join(own, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return both.select("doc_id", "own", "log").mapInArrow(run, OUTCOMES)
