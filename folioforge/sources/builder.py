"""Fluent construction of documents: fixtures, reports, tests."""

from __future__ import annotations

from collections.abc import Callable

from folioforge.sources.model import Document, Node, new_document


class ParagraphBuilder:
    def __init__(self, node: Node):
        self.node = node

    def text(self, text: str, **attrs: str) -> "ParagraphBuilder":
        self.node.run(text, **attrs)
        return self

    def bold(self, text: str) -> "ParagraphBuilder":
        return self.text(text, bold="true")

    def italic(self, text: str) -> "ParagraphBuilder":
        return self.text(text, italic="true")

    def code(self, text: str) -> "ParagraphBuilder":
        return self.text(text, code="true")

    def link(self, text: str, url: str) -> "ParagraphBuilder":
        return self.text(text, url=url)

    def superscript(self, text: str) -> "ParagraphBuilder":
        return self.text(text, vertical_align="superscript")

    def line_break(self) -> "ParagraphBuilder":
        self.node.add("LineBreak")
        return self

    def tab(self) -> "ParagraphBuilder":
        self.node.add("Tab")
        return self

    def bookmark(self, name: str, text: str) -> "ParagraphBuilder":
        self.node.add("BookmarkStart", name=name, ref=name)
        self.node.run(text)
        self.node.add("BookmarkEnd", ref=name)
        return self


class DocumentBuilder:
    """Lists get a number of their own when a paragraph that is no item stands between them."""

    def __init__(self):
        self.doc, self.lists, self.listed = new_document(), 0, None

    def _paragraph(self, text: str | Callable[[ParagraphBuilder], object], **attrs) -> "DocumentBuilder":
        if "list_format" not in attrs:
            self.listed = None
        para = self.doc.body.add("Paragraph", **attrs)
        if callable(text):
            text(ParagraphBuilder(para))
        else:
            para.run(text)
        return self

    def title(self, text: str) -> "DocumentBuilder":
        self.doc.meta["title"] = text
        return self

    def author(self, text: str) -> "DocumentBuilder":
        self.doc.meta["creator"] = text
        return self

    def heading(self, level: int, text: str) -> "DocumentBuilder":
        return self._paragraph(text, style_id=f"Heading{level}")

    def paragraph(self, text: str | Callable[[ParagraphBuilder], object], **attrs) -> "DocumentBuilder":
        return self._paragraph(text, **attrs)

    def item(self, text: str | Callable[[ParagraphBuilder], object], fmt: str = "bullet", level: int = 0, start: int = 1) -> "DocumentBuilder":
        if self.listed != fmt:
            self.lists, self.listed = self.lists + 1, fmt
        return self._paragraph(text, list_format=fmt, list_level=level, list_num_id=self.lists, list_start=start)

    def bullet(self, text: str, level: int = 0) -> "DocumentBuilder":
        return self.item(text, "bullet", level)

    def numbered(self, text: str, level: int = 0, start: int = 1) -> "DocumentBuilder":
        return self.item(text, "decimal", level, start)

    def page_break(self) -> "DocumentBuilder":
        return self._paragraph("", page_break_before="true")

    def table(self, rows: list[list[str]], header: bool = False) -> "DocumentBuilder":
        self.listed = None
        table = self.doc.body.add("Table")
        for k, row in enumerate(rows):
            tr = table.add("TableRow", **({"header": "true"} if header and k == 0 else {}))
            for value in row:
                tr.add("TableCell").add("Paragraph").run(value)
        return self

    def toc(self, max_level: int = 3) -> "DocumentBuilder":
        self.listed = None
        self.doc.body.add("TableOfContents", toc_max_level=max_level)
        return self

    def build(self) -> Document:
        return self.doc
