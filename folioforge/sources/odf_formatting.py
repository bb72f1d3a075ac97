"""Formatting of ODF packages as the same maps of strings that OOXML's has, and as XML again.

Lengths of any unit become points. One page layout is kept, as one section."""

from __future__ import annotations

import re
from xml.sax.saxutils import quoteattr

from folioforge.sources.formatting import SECTION

_O = "urn:oasis:names:tc:opendocument:xmlns:"
STYLE, FO = (f"{{{_O}{x}:1.0}}" for x in ("style", "xsl-fo-compatible"))
#: Points in a unit.
_UNITS = {"in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "pt": 1.0, "px": 0.75, "pc": 12.0}
_LENGTHS = {"spacing_before": "margin-top", "spacing_after": "margin-bottom", "indent_left": "margin-left", "indent_right": "margin-right", "indent_first_line": "text-indent"}
_LAYOUT = {"page_width": "page-width", "page_height": "page-height", "margin_top": "margin-top", "margin_bottom": "margin-bottom", "margin_left": "margin-left", "margin_right": "margin-right"}
_KINDS = {"paragraph": "paragraph", "text": "character", "table": "table", "list": "list"}
#: Headers and footers of a master page, by kind.
ASIDES = {"header": "default", "header-first": "first", "header-left": "even", "footer": "default", "footer-first": "first", "footer-left": "even"}


def points(text: str | None) -> str | None:
    m = re.fullmatch(r"\s*(-?[0-9]*\.?[0-9]+)(in|cm|mm|pt|px|pc)\s*", text or "")
    return str(round(float(m[1]) * _UNITS[m[2]], 4)) if m else None


def _percent(text: str | None) -> float | None:
    m = re.fullmatch(r"\s*(-?[0-9]*\.?[0-9]+)%\s*", text or "")
    return float(m[1]) / 100 if m else None


def _colour(text: str | None) -> str | None:
    return text[1:] if text and re.fullmatch("#[0-9A-Fa-f]{6}", text) else None


def _kept(attrs: dict[str, str | None]) -> dict[str, str]:
    return {k: v for k, v in attrs.items() if v}


def run_attrs(el) -> dict[str, str]:
    """Attributes of a style:text-properties."""
    fo, own = (lambda n: el.get(f"{FO}{n}")), (lambda n: el.get(f"{STYLE}{n}"))
    on = lambda value, off: None if value is None else "false" if value == off else "true"
    raised, first = (own("text-position") or "").lower(), (own("text-position") or "").split(" ")[0]
    lift = 1.0 if raised.startswith("super") else -1.0 if raised.startswith("sub") else _percent(first) or 0.0
    language, country = fo("language"), fo("country")
    if language in ("zxx", "none"):
        language = None
    weight, slant = fo("font-weight"), fo("font-style")
    return _kept({
        "bold": "true" if weight == "bold" or (weight or "").isdigit() and int(weight) >= 700 else on(weight, weight), "italic": "true" if slant in ("italic", "oblique") else on(slant, slant),
        "strikethrough": on(own("text-line-through-style"), "none"), "underline": on(own("text-underline-style"), "none"),
        "color": _colour(fo("color")), "background": _colour(fo("background-color")), "font_size": points(fo("font-size")), "font_family": own("font-name") or (fo("font-family") or "").strip("'\""),
        "vertical_align": "superscript" if lift > 0 else "subscript" if lift < 0 else None, "font_spacing": points(fo("letter-spacing")),
        "language": f"{language}-{country}" if language and country and country != "none" else language,
    })


def paragraph_attrs(el) -> dict[str, str]:
    """Attributes of a style:paragraph-properties."""
    fo = lambda n: el.get(f"{FO}{n}")
    side, times = fo("text-align"), _percent(fo("line-height"))
    exact = points(fo("line-height"))
    true = lambda yes: "true" if yes else None
    tabs = ",".join(f"{p}:{t.get(f'{STYLE}type') or 'left'}:{t.get(f'{STYLE}leader-style') or 'none'}" for t in el.iter(f"{STYLE}tab-stop") if (p := points(t.get(f"{STYLE}position"))))
    return _kept({
        "alignment": {"start": "left", "end": "right"}.get(side, side), "page_break_before": true(fo("break-before") == "page"), "keep_next": true(fo("keep-with-next") == "always"),
        "keep_lines": true(fo("keep-together") == "always"), "background": _colour(fo("background-color")), "tabs": tabs,
        "line_spacing": str(times) if times else exact, "line_rule": "exact" if exact else None, **{k: points(fo(n)) for k, n in _LENGTHS.items()},
    })


def _attributes(pairs: dict[str, str | None]) -> str:
    return "".join(f" {k}={quoteattr(v)}" for k, v in pairs.items() if v)


def run_xml(a: dict[str, str]) -> str:
    """The attributes of a style:text-properties."""
    said = lambda key, yes, no: {"true": yes, "false": no}.get(a.get(key, ""))
    language, _, country = a.get("language", "").partition("-")
    length = lambda key: f"{a[key]}pt" if key in a else None
    colour = lambda key: f"#{a[key]}" if re.fullmatch("[0-9A-Fa-f]{6}", a.get(key, "")) else None
    return _attributes({
        "fo:font-weight": said("bold", "bold", "normal"), "fo:font-style": said("italic", "italic", "normal"), "style:text-line-through-style": said("strikethrough", "solid", "none"),
        "style:text-underline-style": said("underline", "solid", "none"), "fo:color": colour("color"), "fo:background-color": colour("background"), "fo:font-size": length("font_size"),
        "fo:font-family": a.get("font_family"), "style:text-position": {"superscript": "super 58%", "subscript": "sub 58%"}.get(a.get("vertical_align", "")), "fo:letter-spacing": length("font_spacing"),
        "fo:language": language, "fo:country": country,
    })


def paragraph_xml(a: dict[str, str]) -> str:
    """A style:paragraph-properties, or nothing."""
    true = lambda key, value: value if a.get(key) == "true" else None
    line = a.get("line_spacing")
    if line:
        line = f"{line}pt" if a.get("line_rule") else f"{round(float(line) * 100, 4)}%"
    said = _attributes({
        "fo:text-align": a.get("alignment"), "fo:break-before": true("page_break_before", "page"), "fo:keep-with-next": true("keep_next", "always"), "fo:keep-together": true("keep_lines", "always"),
        "fo:background-color": f"#{a['background']}" if re.fullmatch("[0-9A-Fa-f]{6}", a.get("background", "")) else None, "fo:line-height": line, **{f"fo:{n}": f"{a[k]}pt" if k in a else None for k, n in _LENGTHS.items()},
    })
    stops = [t.split(":") for t in a["tabs"].split(",")] if a.get("tabs") else []
    inner = "".join(f'<style:tab-stop style:position="{p}pt" style:type={quoteattr(k)} style:leader-style={quoteattr(e)}/>' for p, k, e in stops)
    if not said and not inner:
        return ""
    return f"<style:paragraph-properties{said}>{f'<style:tab-stops>{inner}</style:tab-stops>' if inner else ''}</style:paragraph-properties>"


def _style_attrs(el) -> dict[str, str]:
    p, r = el.find(f"{STYLE}paragraph-properties"), el.find(f"{STYLE}text-properties")
    return (paragraph_attrs(p) if p is not None else {}) | (run_attrs(r) if r is not None else {})


def styles_of(tree) -> tuple[list[dict], dict[str, str]]:
    """Styles of styles.xml in the order of their first definition, of which the last holds, and paragraph defaults."""
    found: dict[str, dict] = {}
    for s in tree.iter(f"{STYLE}style") if tree is not None else ():
        if own := s.get(f"{STYLE}name"):
            found[own] = {"style_id": own, "name": s.get(f"{STYLE}display-name") or own, "kind": _KINDS.get(s.get(f"{STYLE}family"), "paragraph"), "parent_id": s.get(f"{STYLE}parent-style-name"), "next_id": s.get(f"{STYLE}next-style-name"), "is_default": False, "attrs": _style_attrs(s)}
    base = next((d for d in tree.iter(f"{STYLE}default-style") if d.get(f"{STYLE}family") == "paragraph"), None) if tree is not None else None
    return list(found.values()), _style_attrs(base) if base is not None else {}


def styles_xml(styles: list[dict], defaults: dict[str, str]) -> str:
    """The content of office:styles."""

    def props(a: dict[str, str]) -> str:
        # A fill stands with the paragraph's properties, where a table of attributes has one for both.
        run = run_xml({k: v for k, v in a.items() if k != "background"})
        return paragraph_xml(a) + (f"<style:text-properties{run}/>" if run else "")

    out = f'<style:default-style style:family="paragraph">{props(defaults)}</style:default-style>' if defaults else ""
    families = {v: k for k, v in _KINDS.items() if k != "list"}
    for s in styles:
        if s["kind"] in families:
            head = {"style:name": s["style_id"], "style:display-name": s["name"], "style:family": families[s["kind"]], "style:parent-style-name": s.get("parent_id"), "style:next-style-name": s.get("next_id")}
            out += f"<style:style{_attributes(head)}>{props(s['attrs'])}</style:style>"
    return out


def section_of(tree) -> tuple[dict[str, str], list] | None:
    """The last master page's layout as a section, and its headers and footers (side, kind, element)."""
    pages = list(tree.iter(f"{STYLE}master-page")) if tree is not None else []
    if not pages:
        return None
    layouts = {x.get(f"{STYLE}name"): x.find(f"{STYLE}page-layout-properties") for x in tree.iter(f"{STYLE}page-layout")}
    pr, out = layouts.get(pages[-1].get(f"{STYLE}page-layout-name")), dict(SECTION)
    if pr is not None:
        out |= _kept({k: points(pr.get(f"{FO}{n}")) for k, n in _LAYOUT.items()})
        if pr.get(f"{STYLE}print-orientation") == "landscape":
            out["orientation"] = "landscape"
        columns = pr.find(f"{STYLE}columns")
        if columns is not None and re.fullmatch("[0-9]+", columns.get(f"{FO}column-count") or ""):
            out["columns"] = str(int(columns.get(f"{FO}column-count")))
    return out, [(tag.partition("-")[0], kind, x) for tag, kind in ASIDES.items() for x in pages[-1].findall(f"{STYLE}{tag}")]


def section_xml(s: dict[str, str], asides: str) -> tuple[str, str]:
    """An office:automatic-styles' page layout and an office:master-styles' page with headers and footers."""
    said = _attributes({f"fo:{n}": f"{s[k]}pt" for k, n in _LAYOUT.items() if k in s} | {"style:print-orientation": s.get("orientation")})
    columns = f'<style:columns fo:column-count="{s["columns"]}"/>' if s.get("columns", "1") != "1" else ""
    layout = f'<style:page-layout style:name="PL1"><style:page-layout-properties{said}>{columns}</style:page-layout-properties></style:page-layout>'
    return layout, f'<style:master-page style:name="Standard" style:page-layout-name="PL1">{asides}</style:master-page>'
