"""Review of single trees: headings, tables of contents, tracked changes."""

from __future__ import annotations

import re

from folioforge.sources.model import Document, Node


def headings(doc: Document) -> list[tuple[int, str]]:
    """(level, text) of headings in the body, its sections and tables of contents, not in tables."""
    out: list[tuple[int, str]] = []

    def visit(node: Node) -> None:
        for kid in node.kids:
            if kid.kind == "Paragraph" and (m := re.fullmatch(r"Heading(\d+)", kid.attrs.get("style_id", ""))) and int(m[1]) < 256:
                out.append((int(m[1]), "".join(t.text or "" for t in kid.walk() if t.kind == "Text")))
            elif kid.kind in ("Section", "TableOfContents"):
                visit(kid)

    visit(doc.body)
    return out


def update_toc(doc: Document) -> int:
    """Fills each table of contents of the body anew; returns how many there are."""
    entries = headings(doc)
    tables = [k for k in doc.body.kids if k.kind == "TableOfContents"]
    for toc in tables:
        most = int(toc.attrs.get("toc_max_level", 3))
        toc.kids = []
        for level, text in entries:
            if level <= most:
                toc.add("Paragraph", style_id=f"TOC{level}").run(text)
    return len(tables)


_MARKS = ("revision_type", "revision_author", "revision_date", "revision_id", "revision_before")


def tracked_changes(doc: Document) -> list[tuple[str, str, str]]:
    """(type, author, text) in document order."""
    return [(n.attrs["revision_type"], n.attrs.get("revision_author", ""), n.plain()) for n in doc.root.walk() if "revision_type" in n.attrs]


def decide_changes(doc: Document, accept: bool) -> int:
    """Accepts or rejects all changes; returns their number. What was deleted goes on acceptance, what was
    inserted goes on rejection; moves and format changes only lose their marks."""
    gone, count = "Delete" if accept else "Insert", 0

    def visit(node: Node) -> None:
        nonlocal count
        kept = []
        for kid in node.kids:
            kind = kid.attrs.get("revision_type")
            if kind:
                count += 1
                if kind == gone:
                    continue
                for k in _MARKS:
                    kid.attrs.pop(k, None)
            visit(kid)
            kept.append(kid)
        node.kids = kept

    visit(doc.root)
    return count
