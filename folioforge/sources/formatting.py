"""Formatting of OOXML packages: properties, styles and sections as maps of strings, and as XML again.

Lengths are points. What isn't said has no key; a switch that is said to be off is "false", so that it can
win over a style."""

from __future__ import annotations

import re
from xml.sax.saxutils import quoteattr

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Elements that are switches, by attribute.
_RUN_SWITCHES = {"bold": "b", "italic": "i", "strikethrough": "strike", "caps": "caps", "small_caps": "smallCaps", "shadow": "shadow", "outline": "outline"}
_PARAGRAPH_SWITCHES = {"keep_next": "keepNext", "keep_lines": "keepLines", "page_break_before": "pageBreakBefore", "suppress_hyphens": "suppressAutoHyphens", "word_wrap": "wordWrap", "bidi": "bidi", "contextual_spacing": "contextualSpacing"}
#: What a section has if nothing is said, in points.
SECTION = {"page_width": "612.0", "page_height": "792.0", "orientation": "portrait", "margin_top": "72.0", "margin_bottom": "72.0", "margin_left": "72.0", "margin_right": "72.0", "header_distance": "36.0", "footer_distance": "36.0", "columns": "1", "column_spacing": "36.0", "equal_width": "true", "title_page": "false", "even_and_odd_headers": "false"}
#: Section lengths by element and attribute.
_SECTION_LENGTHS = {"page_width": ("pgSz", "w"), "page_height": ("pgSz", "h"), "margin_top": ("pgMar", "top"), "margin_bottom": ("pgMar", "bottom"), "margin_left": ("pgMar", "left"), "margin_right": ("pgMar", "right"), "header_distance": ("pgMar", "header"), "footer_distance": ("pgMar", "footer"), "column_spacing": ("cols", "space")}
#: Section breaks.
_BREAKS = {"nextPage": "next_page", "continuous": "continuous", "evenPage": "even_page", "oddPage": "odd_page"}
_SPACING = {"spacing_before": "before", "spacing_after": "after"}
_INDENT = {"indent_left": "left", "indent_right": "right", "indent_first_line": "firstLine"}


def _said(el, tag: str, name: str = "val") -> str | None:
    got = el.find(f"{W}{tag}")
    return got.get(f"{W}{name}") if got is not None else None


def _number(text: str | None, per: float) -> str | None:
    try:
        return str(float(text) / per) if text else None
    except ValueError:
        return None


def _kept(**attrs: str | None) -> dict[str, str]:
    return {k: v for k, v in attrs.items() if v}


def _switches(el, names: dict[str, str]) -> dict[str, str]:
    found = {name: el.find(f"{W}{tag}") for name, tag in names.items()}
    return {k: "false" if x.get(f"{W}val") in ("0", "false", "none", "off") else "true" for k, x in found.items() if x is not None}


def _fill(el) -> str | None:
    fill = _said(el, "shd", "fill")
    return None if fill == "auto" else fill


def run_attrs(el) -> dict[str, str]:
    """Attributes of a w:rPr."""
    under, fonts, size = _said(el, "u"), el.find(f"{W}rFonts"), _said(el, "sz") or ""
    font = next((f for k in ("ascii", "hAnsi", "cs") if (f := fonts.get(f"{W}{k}"))), None) if fonts is not None else None
    if el.find(f"{W}u") is not None:
        under = "false" if under in ("0", "false", "none") else "true"
    return _switches(el, _RUN_SWITCHES) | _kept(
        underline=under, color=_said(el, "color"), highlight=_said(el, "highlight"), character_style=_said(el, "rStyle"), vertical_align=_said(el, "vertAlign"),
        font_size=_number(size, 2) if size.isdigit() else None, font_family=font, font_spacing=_number(_said(el, "spacing"), 20), language=_said(el, "lang"), background=_fill(el),
    )


def run_xml(a: dict[str, str]) -> str:
    """The content of a w:rPr."""
    val = lambda tag, key: f"<w:{tag} w:val={quoteattr(a[key])}/>" if key in a else ""
    out = val("rStyle", "character_style")
    if "font_family" in a:
        out += f"<w:rFonts w:ascii={quoteattr(a['font_family'])} w:hAnsi={quoteattr(a['font_family'])}/>"
    out += _switches_xml(a, _RUN_SWITCHES) + val("color", "color")
    out += _length("spacing", {"val": a.get("font_spacing")})
    if "font_size" in a:
        out += f'<w:sz w:val="{round(float(a["font_size"]) * 2)}"/>'
    out += val("highlight", "highlight")
    if "underline" in a:
        out += f'<w:u w:val="{"single" if a["underline"] == "true" else "none"}"/>'
    return out + _fill_xml(a) + val("vertAlign", "vertical_align") + val("lang", "language")


def _switches_xml(a: dict[str, str], names: dict[str, str]) -> str:
    return "".join(f"<w:{t}/>" if a[n] == "true" else f'<w:{t} w:val="false"/>' for n, t in names.items() if n in a)


def _fill_xml(a: dict[str, str]) -> str:
    return f'<w:shd w:val="clear" w:fill={quoteattr(a["background"])}/>' if "background" in a else ""


def _length(tag: str, points: dict[str, str | None], more: str = "") -> str:
    said = "".join(f' w:{k}="{round(float(v) * 20)}"' for k, v in points.items() if v)
    return f"<w:{tag}{said}{more}/>" if said or more else ""


def paragraph_attrs(el) -> dict[str, str]:
    """Attributes of a w:pPr, but its style, list and section."""
    side, line, rule = _said(el, "jc"), _said(el, "spacing", "line"), _said(el, "spacing", "lineRule")
    lengths = {k: _number(_said(el, "spacing", t), 20) for k, t in _SPACING.items()} | {k: _number(_said(el, "ind", t), 20) for k, t in _INDENT.items()}
    if hanging := _number(_said(el, "ind", "hanging"), -20):
        lengths["indent_first_line"] = hanging
    lengths["indent_left"] = lengths["indent_left"] or _number(_said(el, "ind", "start"), 20)
    lengths["indent_right"] = lengths["indent_right"] or _number(_said(el, "ind", "end"), 20)
    exact = rule in ("exact", "atLeast")
    spaced = _number(line, 20 if exact else 240)
    tabs = ",".join(f"{_number(t.get(f'{W}pos'), 20)}:{t.get(f'{W}val') or 'left'}:{t.get(f'{W}leader') or 'none'}" for t in el.iterfind(f"{W}tabs/{W}tab") if _number(t.get(f"{W}pos"), 20))
    borders = _borders(el, "pBdr")
    return _switches(el, _PARAGRAPH_SWITCHES) | _kept(
        alignment={"both": "justify", "start": "left", "end": "right"}.get(side, side), line_spacing=spaced, line_rule={"exact": "exact", "atLeast": "at_least"}[rule] if exact and spaced else None,
        tabs=tabs, borders=borders, background=_fill(el), **lengths,
    )


def paragraph_xml(a: dict[str, str]) -> tuple[str, str]:
    """The content of a w:pPr before and after w:numPr."""
    early = {k: v for k, v in _PARAGRAPH_SWITCHES.items() if k in ("keep_next", "keep_lines", "page_break_before")}
    out = _borders_xml("pBdr", a.get("borders")) + _fill_xml(a)
    if tabs := a.get("tabs"):
        out += "<w:tabs>" + "".join(f'<w:tab w:val={quoteattr(v)} w:leader={quoteattr(e)} w:pos="{round(float(p) * 20)}"/>' for p, v, e in (t.split(":") for t in tabs.split(","))) + "</w:tabs>"
    out += _switches_xml(a, {k: v for k, v in _PARAGRAPH_SWITCHES.items() if k not in early and k != "contextual_spacing"})
    line = ""
    if "line_spacing" in a:
        rule = {"exact": "exact", "at_least": "atLeast"}.get(a.get("line_rule", ""), "auto")
        line = f' w:line="{round(float(a["line_spacing"]) * (240 if rule == "auto" else 20))}" w:lineRule="{rule}"'
    out += _length("spacing", {t: a.get(k) for k, t in _SPACING.items()}, line)
    first = a.get("indent_first_line") or ""
    own = {"left": a.get("indent_left"), "right": a.get("indent_right")} | ({"hanging": first[1:]} if first.startswith("-") else {"firstLine": first})
    out += _length("ind", own) + _switches_xml(a, {"contextual_spacing": "contextualSpacing"})
    if side := a.get("alignment"):
        out += f"<w:jc w:val={quoteattr('both' if side == 'justify' else side)}/>"
    return _switches_xml(a, early), out


# Tables and forms. A width is "auto", points as "72.0pt" or a share as "50.0%".


def _width(el) -> str | None:
    if el is None:
        return None
    size, kind = el.get(f"{W}w"), el.get(f"{W}type") or ""
    if kind in ("auto", "nil", ""):
        return "auto"
    if kind not in ("dxa", "pct"):
        return None
    got = _number(size, 20 if kind == "dxa" else 50)
    return f"{got}{'pt' if kind == 'dxa' else '%'}" if got else None


_WIDTH = re.compile(r"(-?[0-9.]+)(pt|%)")


def _width_xml(tag: str, width: str | None) -> str:
    if m := _WIDTH.fullmatch(width or ""):
        return f'<w:{tag} w:w="{round(float(m[1]) * (20 if m[2] == "pt" else 50))}" w:type="{"dxa" if m[2] == "pt" else "pct"}"/>'
    return f'<w:{tag} w:w="0" w:type="auto"/>' if width == "auto" else ""


def _borders(el, tag: str) -> str:
    return ",".join(f"{b.tag.removeprefix(W)}:{b.get(f'{W}val') or 'none'}:{_number(b.get(f'{W}sz'), 8) or '0.0'}:{b.get(f'{W}color') or 'auto'}" for x in el.findall(f"{W}{tag}") for b in x)


def _borders_xml(tag: str, borders: str | None) -> str:
    sides = [b.split(":") for b in borders.split(",")] if borders else []
    inner = "".join(f'<w:{s} w:val={quoteattr(v)} w:sz="{round(float(z) * 8)}" w:color={quoteattr(c)}/>' for s, v, z, c in sides)
    return f"<w:{tag}>{inner}</w:{tag}>" if inner else ""


def table_attrs(el) -> dict[str, str]:
    """Attributes of a w:tbl: style, width, alignment, borders and the grid's widths."""
    grid = [_number(c.get(f"{W}w"), 20) or "0.0" for c in el.iterfind(f"{W}tblGrid/{W}gridCol")]
    pr = el.find(f"{W}tblPr")
    own = {} if pr is None else {"style_id": _said(pr, "tblStyle"), "width": _width(pr.find(f"{W}tblW")), "alignment": _said(pr, "jc"), "borders": _borders(pr, "tblBorders")}
    return _kept(column_widths=",".join(grid), **own)


def table_xml(a: dict[str, str]) -> str:
    val = lambda tag, key: f"<w:{tag} w:val={quoteattr(a[key])}/>" if key in a else ""
    pr = val("tblStyle", "style_id") + _width_xml("tblW", a.get("width")) + val("jc", "alignment") + _borders_xml("tblBorders", a.get("borders"))
    grid = "".join(f'<w:gridCol w:w="{round(float(c) * 20)}"/>' for c in a["column_widths"].split(",")) if a.get("column_widths") else ""
    return (f"<w:tblPr>{pr}</w:tblPr>" if pr else "") + (f"<w:tblGrid>{grid}</w:tblGrid>" if grid else "")


def row_attrs(el) -> dict[str, str]:
    pr = el.find(f"{W}trPr")
    if pr is None:
        return {}
    height = _number(_said(pr, "trHeight"), 20)
    return _switches(pr, {"header_row": "tblHeader", "keep_lines": "cantSplit"}) | _kept(height=height, height_rule=(_said(pr, "trHeight", "hRule") or "atLeast") if height else None)


def row_xml(a: dict[str, str]) -> str:
    if not a:
        return ""
    high = f'<w:trHeight w:val="{round(float(a["height"]) * 20)}" w:hRule={quoteattr(a.get("height_rule", "atLeast"))}/>' if "height" in a else ""
    pr = _switches_xml(a, {"keep_lines": "cantSplit"}) + high + _switches_xml(a, {"header_row": "tblHeader"})
    return f"<w:trPr>{pr}</w:trPr>" if pr else ""


def cell_attrs(el) -> dict[str, str]:
    """Attributes of a w:tcPr, but its spans."""
    if len(el) == 1 and el[0].tag == f"{W}tcW":  # most cells say no more
        width = _width(el[0])
        return {"width": width} if width else {}
    return _kept(width=_width(el.find(f"{W}tcW")), vertical_align=_said(el, "vAlign"), background=_fill(el), borders=_borders(el, "tcBorders"))


def cell_xml(a: dict[str, str]) -> tuple[str, str]:
    """The content of a w:tcPr before and after the spans."""
    if len(a) == 1 and "width" in a:
        return _width_xml("tcW", a["width"]), ""
    side = f"<w:vAlign w:val={quoteattr(a['vertical_align'])}/>" if "vertical_align" in a else ""
    return _width_xml("tcW", a.get("width")), _borders_xml("tcBorders", a.get("borders")) + _fill_xml(a) + side


def form_attrs(el) -> dict[str, str]:
    """What a w:sdtPr says of a form control: a checkbox, a list of choices or a text field."""
    box, choices = el.find(f"{W14}checkbox"), el.find(f"{W}dropDownList")
    if box is not None:
        state = next((x.get(f"{W14}val") for x in box.iter(f"{W14}checked")), None)
        return {"form_type": "checkbox", "form_checked": "true" if state in ("1", "true") else "false"}
    if choices is not None:
        options = [x.get(f"{W}displayText") or x.get(f"{W}value") or "" for x in choices.iter(f"{W}listItem")]
        return {"form_type": "dropdown"} | _kept(form_options=",".join(options))
    return {"form_type": "text"} if el.find(f"{W}text") is not None else {}


def form_xml(a: dict[str, str]) -> str:
    """The content of a w:sdtPr, or nothing for a paragraph that is no form control."""
    if a.get("form_type") == "checkbox":
        return f'<w14:checkbox><w14:checked w14:val="{int(a.get("form_checked") == "true")}"/></w14:checkbox>'
    if a.get("form_type") == "dropdown":
        options = a["form_options"].split(",") if a.get("form_options") else []
        return "<w:dropDownList>" + "".join(f"<w:listItem w:displayText={quoteattr(o)} w:value={quoteattr(o)}/>" for o in options) + "</w:dropDownList>"
    return "<w:text/>" if a.get("form_type") == "text" else ""


# Styles: style_id, name, kind, parent_id, next_id, is_default and a map of attributes.


def styles_of(tree) -> tuple[list[dict], dict[str, str]]:
    """Styles in the order of their first definition, of which the last holds, and the document's defaults."""
    if tree is None:
        return [], {}

    def attrs(el, run: str, paragraph: str) -> dict[str, str]:
        p, r = el.find(paragraph), el.find(run)
        return (paragraph_attrs(p) if p is not None else {}) | (run_attrs(r) if r is not None else {})

    found: dict[str, dict] = {}
    for s in tree.findall(f"{W}style"):
        own = s.get(f"{W}styleId") or ""
        kind = s.get(f"{W}type") or "paragraph"
        kind = {"character": "character", "table": "table", "numbering": "list", "list": "list"}.get(kind, "paragraph")
        found[own] = {"style_id": own, "name": _said(s, "name") or "", "kind": kind, "parent_id": _said(s, "basedOn"), "next_id": _said(s, "next"), "is_default": s.get(f"{W}default") in ("1", "true"), "attrs": attrs(s, f"{W}rPr", f"{W}pPr")}
    base = tree.find(f"{W}docDefaults")
    return list(found.values()), attrs(base, f"{W}rPrDefault/{W}rPr", f"{W}pPrDefault/{W}pPr") if base is not None else {}


def styles_xml(styles: list[dict], defaults: dict[str, str]) -> str:
    """The content of w:styles."""

    def props(a: dict[str, str]) -> tuple[str, str]:
        # A fill stands with the paragraph's properties, where a table of attributes has one for both.
        p, r = "".join(paragraph_xml(a)), run_xml({k: v for k, v in a.items() if k != "background"})
        return f"<w:pPr>{p}</w:pPr>" if p else "", f"<w:rPr>{r}</w:rPr>" if r else ""

    out = ""
    if defaults:
        p, r = props(defaults)
        out += f"<w:docDefaults><w:rPrDefault>{r}</w:rPrDefault><w:pPrDefault>{p}</w:pPrDefault></w:docDefaults>"
    for s in styles:
        links = "".join(f"<w:{t} w:val={quoteattr(s[k])}/>" for k, t in (("parent_id", "basedOn"), ("next_id", "next")) if s.get(k))
        kind = "numbering" if s["kind"] == "list" else s["kind"]
        out += f'<w:style w:type="{kind}" w:styleId={quoteattr(s["style_id"])}{" w:default=\"1\"" if s.get("is_default") else ""}><w:name w:val={quoteattr(s["name"])}/>{links}{"".join(props(s["attrs"]))}</w:style>'
    return out


def section_of(el, targets: dict[str, str]) -> dict[str, str]:
    """A w:sectPr as a map; header_first and the like hold the part that the first reference of a type names."""
    out = dict(SECTION)
    for key, (tag, name) in _SECTION_LENGTHS.items():
        out[key] = _number(_said(el, tag, name), 20) or out[key]
    if _said(el, "pgSz", "orient") == "landscape":
        out["orientation"] = "landscape"
    if re.fullmatch("[0-9]+", _said(el, "cols", "num") or ""):
        out["columns"] = str(int(_said(el, "cols", "num")))
    if equal := _said(el, "cols", "equalWidth"):
        out["equal_width"] = "true" if equal in ("1", "true") else "false"
    if _said(el, "type") in _BREAKS:
        out["break_type"] = _BREAKS[_said(el, "type")]
    out |= {k: "true" for k, t in (("title_page", "titlePg"), ("even_and_odd_headers", "evenAndOddHeaders")) if el.find(f"{W}{t}") is not None}
    for side in ("header", "footer"):
        for ref in el.findall(f"{W}{side}Reference"):
            kind = ref.get(f"{W}type")
            if part := targets.get(ref.get(f"{R}id")):
                out.setdefault(f"{side}_{kind if kind in ('first', 'even') else 'default'}", part)
    return out


def section_xml(s: dict[str, str], ids: dict[str, str]) -> str:
    """A w:sectPr; references whose part has no id in ``ids`` are left out."""
    refs = "".join(f'<w:{side}Reference w:type="{k}" r:id="{ids[s[f"{side}_{k}"]]}"/>' for side in ("header", "footer") for k in ("default", "first", "even") if s.get(f"{side}_{k}") in ids)
    kind = next((f'<w:type w:val="{k}"/>' for k, v in _BREAKS.items() if v == s.get("break_type")), "")
    at = lambda tag: {n: s[k] for k, (t, n) in _SECTION_LENGTHS.items() if t == tag and k in s}
    size = _length("pgSz", at("pgSz"), ' w:orient="landscape"' if s.get("orientation") == "landscape" else "")
    cols = _length("cols", at("cols"), f' w:num="{s.get("columns", "1")}"' + (' w:equalWidth="0"' if s.get("equal_width") == "false" else ""))
    more = "".join(f"<w:{t}/>" for k, t in (("title_page", "titlePg"), ("even_and_odd_headers", "evenAndOddHeaders")) if s.get(k) == "true")
    return f"<w:sectPr>{refs}{kind}{size}{_length('pgMar', at('pgMar'))}{cols}{more}</w:sectPr>"
