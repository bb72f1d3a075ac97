"""Markdown to trees: CommonMark blocks and inlines with tables, strikethrough and task items.

Written from the public CommonMark and GFM specifications. HTML stays as literal text."""

from __future__ import annotations

import html
import re

from folioforge.sources.model import Document, Node, new_document

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TASK = re.compile(r"\[([ xX])\] ")
_REF = re.compile(r" {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+[\"'(](.*?)[\"')])?\s*$")
_INLINE = re.compile(r"\\([!-/:-@\[-`{-~])|(`+)|(!?\[)|(\*+|_+|~~)|<([a-zA-Z][a-zA-Z0-9+.-]*:[^\s<>]*)>|<([^\s<>@]+@[^\s<>]+)>|( {2,}|\\)\n|(\n)|(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);)")


def language_style(lang: str) -> str:
    plain = "".join(c for c in lang.replace("+", "p") if c.isascii() and c.isalnum())
    return f"Code{plain[:1].upper()}{plain[1:]}"


class _Reader:
    def __init__(self, text: str):
        self.doc = new_document()
        self.refs: dict[str, str] = {}
        self.lists = 0
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        kept, fence = [], False
        for line in lines:
            fence ^= bool(_FENCE.match(line))
            if not fence and (m := _REF.match(line)):
                self.refs.setdefault(" ".join(m[1].lower().split()), m[2])
            else:
                kept.append(line.expandtabs(4) if line[:1] in " \t" else line)
        self.blocks(kept, self.doc.body, 0, None)

    def paragraph(self, parent: Node, text: str, quote: int, **attrs) -> Node:
        if quote and "list_level" not in attrs and "Heading" not in attrs.get("style_id", ""):
            attrs |= {"quote_depth": quote, "style_id": attrs.get("style_id", "Quote")}
        para = parent.add("Paragraph", **attrs)
        self.inline(para, text.strip(), {})
        return para

    def blocks(self, lines: list[str], parent: Node, quote: int, item: dict | None) -> None:
        i, n, first = 0, len(lines), True
        open_text: list[str] = []

        def close() -> None:
            nonlocal first
            if open_text:
                text = "\n".join(x.lstrip() for x in open_text)
                if item and first:
                    if m := _TASK.match(text):
                        text = ("☐ " if m[1] == " " else "☑ ") + text[m.end() :]
                    self.paragraph(parent, text, quote, **item)
                else:
                    self.paragraph(parent, text, quote)
                first = False
                open_text.clear()

        while i < n:
            line = lines[i]
            if not line.strip():
                close()
                i += 1
            elif m := _FENCE.match(line):
                close()
                indent, mark, info = len(m[1]), m[2], m[3].strip()
                code, i = [], i + 1
                while i < n and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                    code.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                    i += 1
                i += 1
                lang = info.split()[0] if info else ""
                para = parent.add("Paragraph", style_id=language_style(lang), code_language=lang)
                for k, x in enumerate(code):
                    if k:
                        para.add("LineBreak")
                    para.run(x)
            elif line.startswith("    ") and not open_text:
                code = []
                while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                    code.append(lines[i][4:])
                    i += 1
                while code and not code[-1].strip():
                    code.pop()
                para = parent.add("Paragraph", style_id="Code", code_language="")
                for k, x in enumerate(code):
                    if k:
                        para.add("LineBreak")
                    para.run(x)
            elif (m := _SETEXT.match(line)) and open_text:
                text = " ".join(x.strip() for x in open_text)
                open_text.clear()
                self.paragraph(parent, text, 0, style_id=f"Heading{1 if m[1][0] == '=' else 2}")
                first = False
                i += 1
            elif m := _ATX.match(line):
                close()
                self.paragraph(parent, m[2] or "", 0, style_id=f"Heading{len(m[1])}")
                i += 1
            elif _RULE.match(line):
                close()
                parent.add("Paragraph", style_id="HorizontalRule")
                i += 1
            elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
                close()
                inner = []
                while i < n and lines[i].strip() and (lines[i].lstrip().startswith(">") or (inner and inner[-1].strip() and not self.starts_block(lines[i]))):
                    inner.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                    i += 1
                self.blocks(inner, parent, quote + 1, None)
            elif (m := _ITEM.match(line)) and not (open_text and m[2][0].isdigit() and int(m[2][:-1]) != 1):
                close()
                i = self.list(lines, i, parent, quote, item)
                first = False
            elif "|" in line and i + 1 < n and _DELIMS.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])) and not open_text:
                i = self.table(lines, i, parent)
                first = False
            else:
                open_text.append(line)
                i += 1
        close()

    @staticmethod
    def starts_block(line: str) -> bool:
        return bool(_FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _ITEM.match(line))

    def list(self, lines: list[str], i: int, parent: Node, quote: int, outer: dict | None) -> int:
        m = _ITEM.match(lines[i])
        kind = m[2][-1]
        level = outer["list_level"] + 1 if outer else 0
        if outer:
            number = outer["list_num_id"]
        else:
            self.lists += 1
            number = self.lists
        own = {"list_level": level, "list_format": "decimal" if m[2][0].isdigit() else "bullet", "list_num_id": number}
        while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and not _RULE.match(lines[i]):
            space = len(m[3] or " ")
            width = len(m[1]) + len(m[2]) + (space if space <= 4 and m[4] else 1)
            inner, i = [(m[4] or "") if space <= 4 else " " * (space - 1) + m[4]], i + 1
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    ahead = next((x for x in lines[i:] if x.strip()), "")
                    if len(ahead) - len(ahead.lstrip()) < width:
                        break
                    inner.append("")
                elif len(line) - len(line.lstrip()) >= width:
                    inner.append(line[width:])
                elif inner[-1].strip() and not self.starts_block(line) and not line.lstrip().startswith(">"):
                    inner.append(line.lstrip())
                else:
                    break
                i += 1
            if any(x.strip() for x in inner):
                self.blocks(inner, parent, quote, own)
            else:
                parent.add("Paragraph", **own)
            after = i
            while i < len(lines) and not lines[i].strip():
                i += 1
            if not (i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind):
                return after
        return i

    def table(self, lines: list[str], i: int, parent: Node) -> int:
        sides = [("center" if x[0] == x[-1] == ":" and len(x) > 1 else "left" if x[0] == ":" else "right" if x[-1] == ":" else "") for x in (c.strip() for c in _cells(lines[i + 1]))]
        node = parent.add("Table")
        rows = [lines[i]]
        i += 2
        while i < len(lines) and lines[i].strip() and not self.starts_block(lines[i]):
            rows.append(lines[i])
            i += 1
        for r, line in enumerate(rows):
            row = node.add("TableRow")
            if r == 0:
                row.attrs["header"] = "true"
            cells = _cells(line)[: len(sides)]
            for text, side in zip([*cells, *[""] * (len(sides) - len(cells))], sides, strict=True):
                para = row.add("TableCell").add("Paragraph", **({"alignment": side} if side else {}))
                self.inline(para, text.strip(), {"bold": "true"} if r == 0 else {})
        return i

    def inline(self, para: Node, text: str, base: dict[str, str]) -> None:
        for piece, attrs in self.spans(text, base):
            if piece == "\n" and attrs.get("__break"):
                para.add("LineBreak")
            elif "image" in attrs:
                para.add("Image", src=attrs["image"], alt=piece)
            else:
                para.run(piece, **attrs)

    def spans(self, text: str, base: dict[str, str]) -> list[tuple[str, dict]]:
        """Pieces of text with their attributes, by the delimiter-run rules of CommonMark."""
        out: list = []  # [text, attrs] or a delimiter [mark, attrs, count, can open, can close]
        at = 0

        def put(s: str, **more) -> None:
            out.append([s, base | more])

        while m := _INLINE.search(text, at):
            if m.start() > at:
                put(text[at : m.start()])
            at = m.end()
            if m[1]:
                put(m[1])
            elif m[2]:
                end = re.compile(rf"(?<!`){m[2]}(?!`)").search(text, at)
                if end:
                    code = text[at : end.start()].replace("\n", " ")
                    put(code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip() else code, code="true")
                    at = end.end()
                else:
                    put(m[2])
            elif m[3]:
                got = self.link(text, at)
                if got is None:
                    put(m[3])
                    continue
                label, url, at = got
                if m[3] == "![":
                    put("".join(x for x, _ in self.spans(label, {})), image=url)
                else:
                    out += [[x, a] for x, a in self.spans(label, base | {"url": url})]
            elif m[4]:
                before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
                punct = lambda c: not c.isalnum() and not c.isspace()
                left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
                right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
                if m[4][0] == "_":
                    left, right = left and (not right or punct(before)), right and (not left or punct(after))
                out.append([m[4][0], dict(base), len(m[4]), left, right])
            elif m[5] or m[6]:
                put(m[5] or m[6], url=m[5] or f"mailto:{m[6]}")
            elif m[7]:
                put("\n", __break="1")
            elif m[8]:
                put(" ")
            else:
                put(html.unescape(m[9]))
        if at < len(text):
            put(text[at:])
        self.emphasise(out)
        return [(x[0] if len(x) == 2 else x[0] * x[2], x[1]) for x in out if len(x) == 2 or x[2]]

    @staticmethod
    def emphasise(out: list) -> None:
        k = 0
        while k < len(out):
            c = out[k]
            if len(c) == 2 or not c[4] or not c[2]:
                k += 1
                continue
            for j in range(k - 1, -1, -1):
                o = out[j]
                if len(o) == 2 or o[0] != c[0] or not o[3] or not o[2]:
                    continue
                if c[0] != "~" and (o[4] or c[3]) and (o[2] + c[2]) % 3 == 0 and (o[2] % 3 or c[2] % 3):
                    continue
                use = 2 if min(o[2], c[2]) >= 2 else 1
                name = "strikethrough" if c[0] == "~" else "bold" if use == 2 else "italic"
                for x in out[j + 1 : k]:
                    x[1] = x[1] | {name: "true"}
                    if len(x) == 5:
                        x[3] = x[4] = False
                o[2] -= use
                c[2] -= use
                break
            else:
                k += 1

    closes: tuple[str | None, dict[int, int]] = (None, {})  # of the text at hand

    def link(self, text: str, at: int) -> tuple[str, str, int] | None:
        if self.closes[0] is not text:
            self.closes = text, _closes(text)
        end = self.closes[1].get(at)
        if end is None:
            return None
        label = text[at : end - 1]
        if m := re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)").match(text, end):
            return label, m[1] if m[1] is not None else re.sub(r"\\(.)", r"\1", m[2]), m.end()
        m = re.compile(r"\[([^\]]*)\]").match(text, end)
        key = " ".join(((m[1] if m and m[1] else label)).lower().split())
        return (label, self.refs[key], m.end() if m else end) if key in self.refs else None


def _closes(text: str) -> dict[int, int]:
    """Where each bracket's content begins, and the place behind its closing bracket."""
    out: dict[int, int] = {}
    open_at: list[int] = []
    for m in re.finditer(r"(?s)\\.|[\[\]]", text):
        if m[0] == "[":
            open_at.append(m.end())
        elif m[0] == "]" and open_at:
            out[open_at.pop()] = m.end()
    return out


def _cells(line: str) -> list[str]:
    text = line.strip().removeprefix("|")
    if text.endswith("|") and not text.endswith("\\|"):
        text = text[:-1]
    return [c.replace("\\|", "|") for c in re.split(r"(?<!\\)\|", text)]


def read_markdown(text: str) -> Document:
    return _Reader(text.removeprefix("﻿")).doc
