"""Main text of web pages: page structure and a host's suffix array.

Each page is parsed where it lies, and repeated runs of ``RUN`` tokens or more decide on every page. The token
streams of each host's pages are joined, up to ``STREAM`` tokens at a time; a suffix array with common prefixes
finds the runs and how many of these pages hold each. The numbers of all streams are added up by host, so neither
partitions nor the size of a host changes a result, and runs that repeat go back to the pages. A text block
that lies mostly in such runs is boilerplate and goes; unique runs stay.

Where a page has an article (or main) element, the streams are its articles' texts, and a run repeats if
``LEAST_PAGES`` of the host's articles or more and more than half of them hold it: a notice that the site puts
into its articles. A run that more than half of all articles hold is held by more than half of those of some
stream, so only such runs are counted over the whole host, and all of them are. Where a page has none, its streams
are whole pages and ``LEAST_PAGES`` are enough. ``extract`` does the same for the pages of one host in memory.

An exact check by structure follows: of a page with an article only blocks inside stay, and an article that
lies for the most part in repeated runs is a mirrored or syndicated one and stays whole. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments go though they don't repeat.

Defined cases: null or empty html gives an empty text of 0 characters; cut-off tags and unclosed
elements end where the page ends; repeated rows are extracted each for itself; a null or odd url has
the empty host; other columns are ignored; an empty table gives an empty result. ``<br>`` is white
space inside its block; cells and list items are blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Scratch, table

RUN, LEAST_PAGES = 8, 3
FEW = 8  # pages of a host in a task, of which its other pages are looked for
STREAM = 1 << 20  # tokens of one suffix array, a long page excepted

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
#: Elements whose content is not text, or not the reader's text.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in _RAW}
_DROP = _RAW | {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same kind, or another of the group, closes.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES |= {t: {"p"} for t in _BLOCK - _CLOSES.keys() - {"html", "body"}}
_FENCE = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "aside", "nav", "footer", "header", "form", "blockquote", "td", "th", "li", "dd"}
#: Words in class, id and role that mark what is not the article.
_MARKS = (
    "nav navbar navigation menu menubar topbar header masthead banner footer sidebar aside cookie cookies consent gdpr notice notices "
    "alert ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion newsletter subscribe "
    "signup login social share sharing related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments "
    "commentlist disqus respond replies popup modal overlay search widget copyright contentinfo complementary dialog alertdialog skip"
).split()
_MARK = re.compile(rf"(?:^|\s)(?!(?:no|has|with|without)[-_])(?:[a-z0-9]+[-_]+)*(?:{'|'.join(_MARKS)})(?:[-_]*(?:\d+|[a-z0-9_-]*(?:bar|box|list|wrap|wrapper|container|section|area|block|slot|unit|form|links|inner|thread|item|body|top|bottom|left|right|main|site|page)))?(?=\s|$)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _kind(tag: str, attrs: str, inside: bool) -> str | None:
    """"main" for an article, "drop" for what is not text of one, else None."""
    if tag in _DROP or (tag == "header" and not inside):
        return "drop"
    marks, plain = "", attrs.strip()
    if plain:
        own = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(plain)}
        if "hidden" in own or "display:none" in own.get("style", "").replace(" ", ""):
            return "drop"
        marks = f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}"
        if own.get("role") == "main" and tag not in ("html", "body"):
            return "main"
    if tag in ("html", "body", "main"):
        return "main" if tag == "main" else None
    if marks.strip() and _MARK.search(marks) and not (tag == "article" and "comment" not in marks):
        return None if inside and tag in ("h1", "header") else "drop"
    return "article" if tag == "article" else None


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(text, place) of the page's blocks in order; place is "article", "main", "drop" or "body"."""
    page, out, parts = page or "", [], []
    stack: list[tuple[str, str]] = []  # open elements with the place of their content
    place, at = "body", 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, place))
            parts.clear()

    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if place != (before := stack[k - 1][1] if k else "body"):
                        flush()
                    del stack[k:]
                    place = before
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK | _DROP:
            if tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
            closes = _CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    place = stack[-1][1] if stack else "body"
                    break
                if stack[k][0] in _FENCE:
                    break
        if place == "drop":
            new = "drop"
        else:
            kind = _kind(tag, attrs, place in ("article", "main"))
            new = "article" if place == "article" and kind == "main" else kind or place
            if new != place:
                flush()
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        stack.append((tag, new))
        place = new
    parts.append(page[at:])
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes in order, and for each but the first how many tokens it shares with the
    one before it. Prefix doubling keeps the ranks by the first 1, 2, 4 ... tokens; equal ranks from the
    longest down add up to the common prefix."""
    n, ranks = len(tokens), [np.unique(tokens, return_inverse=True)[1].astype(np.int32)]
    while n and ranks[-1].max() < n - 1:
        h = 1 << (len(ranks) - 1)
        ahead = np.zeros(n, np.int64)
        ahead[:-h] = ranks[-1][h:] + 1
        ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1].astype(np.int32))
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = order[:-1] + common, order[1:] + common
        inside = np.flatnonzero((a < n) & (b < n))
        common[inside[ranks[k][a[inside]] == ranks[k][b[inside]]]] += 1 << k
    return order, common


def _groups(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, the group of each of its entries (neighbours that share ``run`` tokens or more)
    and the number of distinct pages of each group."""
    order, common = suffix_array(tokens)
    group = np.concatenate(([0], (common < run).cumsum()))
    width = int(page.max()) + 1
    return order, group, np.bincount(np.unique(group * width + page[order]) // width)


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, least: int = LEAST_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens or more that ``least`` distinct pages hold. ``tokens`` are
    numbers; one that occurs once must stand between pages."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    order, group, pages_of = _groups(tokens, page, run)
    start = order[pages_of[group] >= least]
    start = start[start + run <= n]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + run, -1)
    return edge[:-1].cumsum() > 0


def _hash(words: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def counted_runs(pages: list[list[str]], least: int = 1) -> tuple[list[int], list[int]]:
    """Hashes of the runs of RUN tokens that ``least`` pages or more of one host hold, each once, and how many
    of the pages hold it."""
    number: dict[str, int] = {}
    words, tokens, page = [], [], []
    for k, own in enumerate(pages):
        words += [*own, ""]
        tokens += [*(number.setdefault(w, len(number)) for w in own), -k - 1]
        page += [k] * (len(own) + 1)
    n = len(tokens)
    if n < RUN:
        return [], []
    of = np.array(tokens, np.int64)
    order, group, pages_of = _groups(of, np.array(page, np.int64), RUN)
    first = order[np.flatnonzero(np.diff(group, prepend=-1))]  # of each group
    ends = np.concatenate(([0], (of < 0).cumsum()))
    whole = np.flatnonzero((first + RUN <= n) & (ends[np.minimum(first + RUN, n)] == ends[first]) & (pages_of >= least))
    return [_hash(words[i : i + RUN]) for i in first[whole].tolist()], pages_of[whole].tolist()


def _covered(streams: list[list[str]], least: int) -> list[np.ndarray]:
    """For each page, how many of its first tokens lie in runs that ``least`` pages hold."""
    number: dict[str, int] = {}
    tokens, page_of = [], []
    for k, words in enumerate(streams):
        tokens += [*(number.setdefault(w, len(number)) for w in words), -k - 1]
        page_of += [k] * (len(words) + 1)
    marks = repeated(np.array(tokens, np.int64), np.array(page_of, np.int64), least=least)
    out, at = [], 0
    for words in streams:
        out.append(np.concatenate(([0], marks[at : at + len(words)].cumsum())))
        at += len(words) + 1
    return out


def _words(texts: list[str]) -> list[str]:
    return [w for text in texts for w in text.split(" ")]


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    parsed = [blocks(p) for p in pages]
    whole = _covered([_words([t for t, _ in bs]) for bs in parsed], LEAST_PAGES)
    articles = [[t for t, p in bs if p == best] if (best := _best(bs)) else [] for bs in parsed]
    inside = _covered([_words(a) for a in articles], _most(sum(map(bool, articles))))
    return [_own(a, c) if a else _unique(bs, w) for bs, a, w, c in zip(parsed, articles, whole, inside, strict=True)]


def _best(parsed: list[tuple[str, str]]) -> str | None:
    """The place that alone is the page's text, if it has one."""
    places = {p for _, p in parsed}
    return next((p for p in ("article", "main") if p in places), None)


def _most(articles: int) -> int:
    """How many of a host's articles hold what is no article's own."""
    return max(LEAST_PAGES, articles // 2 + 1)


def runs(words: list[str]) -> list[int]:
    """Hashes of all runs of RUN tokens of a page, by their starts."""
    return [_hash(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]


def _marked(words: list[str], repeats: set[int]) -> np.ndarray:
    """How many of the first tokens lie in repeated runs."""
    cover = np.zeros(len(words) + 1, np.int64)
    for i, h in enumerate(runs(words)):
        if h in repeats:
            cover[i] += 1
            cover[i + RUN] -= 1
    return np.concatenate(([0], (cover[:-1].cumsum() > 0).cumsum()))


def _boilerplate(texts: list[str], covered: np.ndarray) -> list[bool]:
    """Which blocks lie mostly in repeated runs."""
    ends = np.array([0, *(t.count(" ") + 1 for t in texts)]).cumsum()
    return (2 * (covered[ends[1:]] - covered[ends[:-1]]) >= np.diff(ends)).tolist()


def _unique(parsed: list[tuple[str, str]], covered: np.ndarray) -> str:
    """The text of a page without article or main, less blocks that lie mostly in repeated runs."""
    marks = _boilerplate([t for t, _ in parsed], covered)
    return "\n".join(t for (t, place), boiler in zip(parsed, marks, strict=True) if place != "drop" and not boiler)


def _own(article: list[str], covered: np.ndarray) -> str:
    """An article less blocks that lie mostly in repeated runs, unless most of the article does."""
    if 2 * covered[-1] >= len(covered) - 1:
        return "\n".join(article)
    return "\n".join(t for t, boiler in zip(article, _boilerplate(article, covered), strict=True) if not boiler)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks inside the article, one a line; for pages without one the html stays."""
    for b in batches:
        texts, open_ = [], []
        for page in b.column("html"):
            page = page.as_py()
            parsed = blocks(page)
            best = _best(parsed)
            texts.append("\n".join(t for t, p in parsed if p == best) if best else "" if not parsed else None)
            open_.append(page if texts[-1] is None else None)
        names = ["page_id", "url", "__host"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(open_, pa.string())], names=[*names, "text", "open"])


def _streams(batches: Iterator[pa.RecordBatch], column: str, words: Callable[[str], list[str]]) -> Iterator[dict[str, list]]:
    """The task's pages by host as (tokens, value), about STREAM tokens at a time; a page is never cut."""
    held, size = defaultdict(list), 0
    for b in batches:
        for host, value in zip(b.column("__host"), b.column(column), strict=True):
            value = value.as_py()
            own = words(value)
            held[host.as_py()].append((own, value))
            size += len(own) + 1
            if size >= STREAM:
                yield held
                held, size = defaultdict(list), 0
    yield held


def _page_words(page: str | None) -> list[str]:
    return _words([text for text, _ in blocks(page)])


def _article_words(text: str) -> list[str]:
    return _words(text.split("\n"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the task's pages with their numbers of pages, from a suffix array for each host and stream;
    numbers of one run add up."""
    for held in _streams(batches, "html", _page_words):
        for host, pages in held.items():
            found, pages_of = counted_runs([w for w, _ in pages])
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(pages_of, pa.int64())], names=["__host", "run", "pages"])


def _frequent(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs that more than half of a host's articles in a stream hold; of hosts with fewer than ``least``
    articles there the texts, to be looked at together with others of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _streams(batches, "text", _article_words):
            hosts, found, texts = [], [], []
            for host, pages in held.items():
                few = len(pages) < least
                new = [t for _, t in pages] if few else counted_runs([w for w, _ in pages], len(pages) // 2 + 1)[0]
                hosts += [host] * len(new)
                found += [None] * len(new) if few else new
                texts += new if few else [None] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(texts, pa.string())], names=["__host", "run", "text"])

    return run


def _runs(column: str, words: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted(set(runs(words(page.as_py())))) for page in b.column(column)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("__host"), pa.array(lists, pa.list_(pa.int64()))], names=["row", "__host", "runs"])

    return run


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def text(page: str | None, article: str | None, repeats: set[int]) -> str:
        if article is not None:
            return _own(article.split("\n"), _marked(_article_words(article), repeats))
        parsed = blocks(page)
        return _unique(parsed, _marked(_words([t for t, _ in parsed]), repeats))

    for b in batches:
        columns = (b.column(c) for c in ("open", "text", "runs"))
        texts = [text(page.as_py(), article.as_py(), set(r.as_py() or ())) for page, article, r in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _chosen(pages: DataFrame, held: DataFrame, often: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages without the blocks of runs that repeat on their hosts."""
    found = held.join(often, ["__host", "run"]).groupBy("row").agg(F.collect_list("run").alias("runs"))
    return pages.join(found, "row", "left").select("page_id", "url", "open", "text", "runs").mapInArrow(_choose, "page_id bigint, url string, text string")


def _exploded(pages: DataFrame, column: str, words: Callable[[str], list[str]]) -> DataFrame:
    """(row, __host, run): every run of every page, once a page."""
    lists = pages.select("row", "__host", column).mapInArrow(_runs(column, words), "row bigint, __host string, runs array<bigint>")
    return lists.select("row", "__host", F.explode("runs").alias("run"))


def _common(articles: DataFrame, scratch: Scratch) -> DataFrame:
    """(__host, run): the runs that repeat in a host's articles."""
    schema = "__host string, run bigint, text string"
    sizes = articles.groupBy("__host").agg(F.count("*").alias("articles")).filter(F.col("articles") >= LEAST_PAGES)
    first = scratch.write(articles.select("__host", "text").mapInArrow(_frequent(FEW), schema), "frequent")
    few = first.filter("text IS NOT NULL").select("__host", "text").join(sizes, "__host").select("__host", "text")
    together = few.repartition("__host").mapInArrow(_frequent(1), schema)
    likely = first.filter("run IS NOT NULL").select("__host", "run").union(together.select("__host", "run")).distinct()
    likely = scratch.write(likely, "likely")
    if likely.isEmpty():
        return likely
    here = articles.join(likely.select("__host").distinct(), "__host", "left_semi")
    held = _exploded(here, "text", _article_words).join(likely, ["__host", "run"]).groupBy("__host", "run").agg(F.count("*").alias("pages"))
    most = (F.col("pages") >= LEAST_PAGES) & (2 * F.col("pages") > F.col("articles"))
    return scratch.write(held.join(sizes, "__host").filter(most).select("__host", "run"), "common")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of rows of page_id, url, html."""
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("__host"))
    parsed = rows.mapInArrow(_parse, "page_id bigint, url string, __host string, text string, open string")
    parsed = scratch.write(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    done = parsed.filter("text IS NOT NULL")
    articles = done.filter("text != ''")
    common = _common(articles, scratch)
    if common.isEmpty():
        done = done.select("page_id", "url", "text")
    else:
        hosts = common.select("__host").distinct()
        with_common = articles.join(hosts, "__host", "left_semi")
        others = done.join(hosts, "__host", "left_anti").unionByName(done.filter("text = ''").join(hosts, "__host", "left_semi"))
        done = others.select("page_id", "url", "text").unionByName(_chosen(with_common, _exploded(with_common, "text", _article_words), common))
    rest = parsed.filter("text IS NULL")
    if not rest.isEmpty():
        hosts = rest.select("__host").distinct()
        own = rows.join(hosts, "__host", "left_semi").select("__host", "html").mapInArrow(_counts, "__host string, run bigint, pages bigint")
        often = own.groupBy("__host", "run").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= LEAST_PAGES).select("__host", "run")
        done = done.unionByName(_chosen(rest, _exploded(rest, "open", _page_words), often))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
