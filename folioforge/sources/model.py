"""A document as a tree in memory, and as rows: what per-document Arrow functions work on.

Readers build one tree per document, exporters walk one; a document never leaves its task. Rows carry
ids in document order from 0 (the root), so that trees and node tables turn into each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa

NODE = "node_id bigint, parent_id bigint, child_ix bigint, depth bigint, node_type string, text string, attrs map<string,string>"


@dataclass(slots=True)
class Node:
    kind: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list["Node"] = field(default_factory=list)
    text: str | None = None

    def add(self, kind: str, text: str | None = None, **attrs: str) -> "Node":
        kid = Node(kind, {k: str(v) for k, v in attrs.items()} if attrs else {}, [], text)
        self.kids.append(kid)
        return kid

    def run(self, text: str, **attrs: str) -> None:
        """A run with its text; runs of equal attributes grow together."""
        if not text:
            return
        own = {k: str(v) for k, v in attrs.items()}
        if self.kids and self.kids[-1].kind == "Run" and self.kids[-1].attrs == own:
            self.kids[-1].kids[-1].text += text
        else:
            self.add("Run", **own).add("Text", text)

    def walk(self) -> Iterator["Node"]:
        ahead = [self]
        while ahead:
            node = ahead.pop()
            yield node
            if node.kids:
                ahead.extend(reversed(node.kids))

    def plain(self) -> str:
        """Text of inline content; breaks and tabs count as such."""
        if self.kind == "Text":
            return self.text or ""
        if self.kind == "Tab":
            return "\t"
        if self.kind == "LineBreak":
            return "\n"
        return "".join(k.plain() for k in self.kids)


@dataclass
class Document:
    root: Node
    meta: dict[str, str] = field(default_factory=dict)
    #: Styles, the document's defaults and sections as the formatting module has them; pictures by path.
    styles: list[dict] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    sections: list[dict[str, str]] = field(default_factory=list)
    media: dict[str, bytes] = field(default_factory=dict)

    @property
    def body(self) -> Node:
        return next(k for k in self.root.kids if k.kind == "Body")


def new_document() -> Document:
    return Document(Node("Document", {}, [Node("Body")]))


def to_rows(doc: Document) -> list[dict]:
    rows: list[dict] = []

    def visit(node: Node, parent: int | None, ix: int, depth: int) -> None:
        own = len(rows)
        rows.append({"node_id": own, "parent_id": parent, "child_ix": ix, "depth": depth, "node_type": node.kind, "text": node.text, "attrs": list(node.attrs.items())})
        for k, kid in enumerate(node.kids):
            visit(kid, own, k, depth + 1)

    visit(doc.root, None, 0, 0)
    return rows


class NodeLists:
    """The nodes of documents as one Arrow column of lists of structs, gathered value by value: no dictionary
    stands for a node, and a tree can go as soon as it is added."""

    def __init__(self):
        self.lists, self.none, self.pairs = [0], [], [0]
        self.parent, self.ix, self.depth, self.kind, self.text, self.keys, self.values = [], [], [], [], [], [], []
        self.ids: list[int] = []

    def add(self, doc: Document | None) -> None:
        first = len(self.kind)
        self.none.append(doc is None)
        ahead = [] if doc is None else [(doc.root, None, 0, 0)]
        while ahead:
            node, parent, ix, depth = ahead.pop()
            own = len(self.kind) - first
            self.ids.append(own)
            self.parent.append(parent)
            self.ix.append(ix)
            self.depth.append(depth)
            self.kind.append(node.kind)
            self.text.append(node.text)
            if node.attrs:
                self.keys.extend(node.attrs)
                self.values.extend(node.attrs.values())
            self.pairs.append(len(self.keys))
            for k in range(len(node.kids) - 1, -1, -1):
                ahead.append((node.kids[k], own, k, depth + 1))
        self.lists.append(len(self.kind))

    def column(self) -> pa.Array:
        text, whole = pa.string(), pa.int64()
        attrs = pa.MapArray.from_arrays(pa.array(self.pairs, pa.int32()), pa.array(self.keys, text), pa.array(self.values, text))
        columns = [pa.array(self.ids, whole), pa.array(self.parent, whole), pa.array(self.ix, whole), pa.array(self.depth, whole), pa.array(self.kind, text), pa.array(self.text, text), attrs]
        nodes = pa.StructArray.from_arrays(columns, names=["node_id", "parent_id", "child_ix", "depth", "node_type", "text", "attrs"])
        return pa.ListArray.from_arrays(pa.array(self.lists, pa.int32()), nodes, mask=pa.array(self.none, pa.bool_()))


def from_rows(rows: list[dict]) -> Document:
    """A tree from rows in any order; rows whose parent is missing are left out."""
    nodes = {r["node_id"]: Node(r["node_type"], dict(r["attrs"] or ()), [], r["text"]) for r in rows}
    root = Node("Document", {}, [])
    for r in sorted(rows, key=lambda r: (r["depth"], r["child_ix"], r["node_id"])):
        if r["parent_id"] is None:
            root = nodes[r["node_id"]]
        elif r["parent_id"] in nodes:
            nodes[r["parent_id"]].kids.append(nodes[r["node_id"]])
    doc = Document(root)
    if not any(k.kind == "Body" for k in root.kids):
        root.kids.insert(0, Node("Body"))
    return doc


def plain_text(doc: Document) -> str:
    """Paragraph texts by lines: one starts a new line unless the text is empty or at a line's start."""
    out: list[str] = []
    ends = True

    def visit(node: Node) -> None:
        nonlocal ends
        if node.kind == "Paragraph":
            if not ends:
                out.append("\n")
                ends = True
            if text := node.plain():
                out.append(text)
                ends = text.endswith("\n")
        elif node.kind in ("Header", "Footer"):
            return
        else:
            for kid in node.kids:
                visit(kid)

    visit(doc.body)
    return "".join(out)
