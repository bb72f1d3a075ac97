"""Corpus operators against brute force on small tables, with nulls, empty, long, tied and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from folioforge.llm import html_text, language_model, packing, toxicity
from folioforge.llm.decontaminate import decontaminate, find_contamination
from folioforge.llm.common import Scratch
from folioforge.llm.line_dedup import drop_repeated_lines, removed_lines
from folioforge.llm.near_duplicates import near_duplicates, one_of_each, signatures
from folioforge.llm.personal_data import find, mask
from folioforge.llm.quality_classifier import fit, score, train
from folioforge.llm.quality_rules import judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"


def frame(spark, rows):
    """documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 90))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(words) // 14))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((100 + k, " ".join(words)))
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25))) for _ in range(30)]
    rows += [(200 + k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for k in range(30)]
    rows += [(300, ""), (301, None), (302, " \t\n"), (303, "one two"), (304, "one two"), (304, "one two"), (305, "One TWO"), (None, base[0]), (None, None)]
    rows += [(306, " ".join(rng.choice(vocab) for _ in range(30_000)))]
    return rows


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_match_all_pairs(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    kept = one_of_each(frame(spark, corpus))
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == sorted(i for i in ids if root(i) == i) and left.count(None) == 2
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_texts_with_a_long_passage_in_common(spark, monkeypatch):
    """Few of the pairs of a group that shares a passage, yet not enough of it, are read in full; links are all found."""
    from folioforge.llm import near_duplicates as near

    rng, sizes = random.Random(8), {}
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(100)]
    rows = [(i, " ".join(passage + [word() for _ in range(30)])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " " + " ".join(word() for _ in range(i % 50))) for i in range(40, 100)]
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert parent[b] == b, "chains are not meant here"
                parent[b] = a
    write = near.Scratch.write

    def counted(self, df, label):
        out = write(self, df, label)
        sizes.setdefault(label, out.count())
        return out

    monkeypatch.setattr(near.Scratch, "write", counted)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == parent and sum(i != c for i, c in got.items()) > 30
    assert sizes["cross"] < 500


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[250:1250])
    sig = signatures([a, b, np.zeros(0, np.uint64), a[:3]])
    assert abs((sig[0] == sig[1]).mean() - 750 / 1250) < 0.1
    assert np.isinf(sig[2]).all() and np.isfinite(sig[3]).all()
    whole, parts = signatures([a]), signatures([np.concatenate([a[500:], a[:500]])])
    assert (whole == parts).all()


def test_line_dedup_matches_all_pairs(spark, corpus):
    rows = [(i, t) for i, t in corpus if i is not None and t is not None]
    lines = sorted({(i, k, line) for i, t in rows for k, line in enumerate(t.split("\n"))})
    sets = [(i, k, frozenset(WORD.findall(line))) for i, k, line in lines]
    want = set()
    for x, (i, k, s) in enumerate(sets):
        if len(s) >= 5 and any(len(t) >= 5 and 190 * len(s & t) >= 90 * (len(s) + len(t)) for *_, t in sets[:x]):
            want.add((i, k))
    got = {(r.doc_id, r.line_no) for r in removed_lines(frame(spark, corpus)).collect()}
    assert got == want and want
    out = drop_repeated_lines(frame(spark, corpus))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[300] == "" and texts[301] is None and texts[303] == "one two"
    for i, t in rows:
        rest = "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in want)
        if any(j == i for j, _ in want):
            assert texts.get(i) == (rest if rest.strip() else None)
        else:
            assert texts[i] == t
    assert removed_lines(frame(spark, [])).count() == 0


def test_line_dedup_joins_only_words_of_three_lines_or_more(spark, monkeypatch):
    met, write = [], Scratch.write

    def noted(self, df, label):
        out = write(self, df, label)
        if label == "met":
            met.extend((r.word, r.alone) for r in out.collect())
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    rng = random.Random(6)
    lines = [" ".join(f"w{k}" for k in rng.sample(range(250), 10)) for _ in range(80)]
    assert removed_lines(frame(spark, list(enumerate(lines)))).count() == 0
    rows = collections.Counter(w for w, _ in met)  # the earliest line of a word is not among them
    assert {alone for _, alone in met} == {True, False} and all(alone == (rows[w] == 1) for w, alone in met)


def test_line_dedup_joins_again_only_rows_of_large_buckets(spark, monkeypatch):
    carried, write = [], Scratch.write

    def noted(self, df, label):
        out = write(self, df, label)
        if label == "met":
            carried.extend(r.b_doc for r in out.collect())
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    rng = random.Random(6)
    lines = [" ".join(f"w{k}" for k in rng.sample(range(250), 10)) for _ in range(80)]
    assert removed_lines(frame(spark, list(enumerate(lines)))).count() == 0
    assert carried and set(carried) == {None}  # nothing of them goes on: none is similar, no bucket is large


def test_line_dedup_matches_all_pairs_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr("folioforge.llm.line_dedup.SMALL", 2)
    rng = random.Random(7)
    pool = [[f"w{k}" for k in rng.sample(range(40), 12)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(rng.choice(pool))
        if rng.random() < 0.7:
            words[rng.randrange(12)] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(words[: rng.randrange(10, 13)])))
    sets = [set(t.split()) for _, t in rows]
    want = {(i, 0) for i, s in enumerate(sets) if any(190 * len(s & t) >= 90 * (len(s) + len(t)) for t in sets[:i])}
    assert {(r.doc_id, r.line_no) for r in removed_lines(frame(spark, rows)).collect()} == want and 10 < len(want) < 80


def test_line_dedup_compares_with_each_of_two_texts_of_one_id(spark):
    often = [f"c{k}" for k in range(16)]
    one, two = " ".join(["r1", "r2", *often[:8]]), " ".join(["r1", "r2", *often[8:]])
    rows = [(1, one), (1, two), (2, one + " c15"), (3, two + " c0"), *[(10 + k, "\n".join(often)) for k in range(40)]]
    assert {(r.doc_id, r.line_no) for r in removed_lines(frame(spark, rows)).collect()} == {(2, 0), (3, 0)}


def test_line_dedup_finds_one_word_more_than_nine(spark):
    short = [f"{k}a {k}b {k}c {k}d {k}e {k}f {k}g {k}h newsletter" for k in "xy"]
    rows = [(1, short[0]), (2, short[0] + " today"), (3, short[1] + " today"), (4, short[1]), (5, "p q r s t u v w"), (6, "p q r s t u v w today")]
    assert {(r.doc_id, r.line_no) for r in removed_lines(frame(spark, rows)).collect()} == {(2, 0), (4, 0)}


def test_quality_rules_measures(spark, corpus):
    rows = [*corpus, (400, "a b c a b c a b c\nx\nx\n\n \n# $%"), (401, "BUY!! NOW!! " * 60)]
    got = {(r.doc_id, r.n_words): r for r in judge(frame(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert judge(frame(spark, [])).count() == 0


def words10(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("chunk", [1 << 20, 120])
def test_decontamination_matches_direct_search(spark, corpus, chunk):
    items = [(1, corpus[3][1]), (2, "One, two!"), (3, None), (4, "..."), (5, " ".join(corpus[5][1].split()[:12])), (5, " ".join(corpus[5][1].split()[:12])), (6, "zzz")]
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, doc_id int")
    got = find_contamination(frame(spark, corpus), bench, chunk_bytes=chunk).collect()
    assert len(got) == len(corpus)
    by_id = {(r.doc_id, r["__n"]): r for r in got}
    for i, t in corpus:
        w = words10(t)
        hit, ids = set(), set()
        for item, text in items:
            v = words10(text)
            m = min(10, len(v))
            for p in {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else ():
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) == p:
                        hit |= set(range(k, k + m))
                        ids.add(str(item))
        r = by_id[i, len(w)]
        assert sum(r["__spans"][1::2]) - sum(r["__spans"][::2]) == len(hit) and r["__items"] == sorted(ids)
    clean = decontaminate(frame(spark, corpus), bench)
    assert clean.columns[:2] == ["doc_id", "text"] and clean.count() < len(corpus)
    assert find_contamination(frame(spark, []), bench).count() == 0
    assert decontaminate(frame(spark, corpus), bench.limit(0)).count() == len(corpus)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, d[::-1]))) % 10 == 0 if d else False
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_personal_data_base_spans(spark):
    texts = [
        "a@b.co+c@d.org é x@y", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.01", "4111 1111 1111 1111 5 6-7 4111111111111112", "+1 (415) 555-2671 +12 +49-30-1234567890123",
        "", None, "7 " * 5000 + "4111-1111-1111-1111", "x" * 3000 + "@a.b " + "9" * 2000, "é😀 mail me: jo.e@x-y.example.com, tel 415 555 2671", 'password=b7db7aa4a5fcc78305 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
        "@@ a@ @b.c a@b a.b@c.d.", "+1234567890. +(1)", "1.1.1.1 1.1.1",
    ]
    rng = random.Random(5)
    texts += ["".join(rng.choice("0123456789 -.+()a@b.") for _ in range(60)) for _ in range(150)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in find(frame(spark, rows)).collect()}
    for i, t in rows:
        for kind, pattern in PATTERNS:
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t or "") if passes(kind, m[0])]
            assert [(x["start"], x["end"]) for x in got[i][kind]] == want, (kind, t)
    assert [x["kind"] for x in got[9]["added"]] == ["secret", "secret"]
    masked = {r.doc_id: r.text for r in mask(frame(spark, rows)).collect()}
    assert "jo.e@" not in masked[8] and masked[8].startswith("é😀 mail me: <email>,") and masked[4] == "" and masked[5] == ""
    assert find(frame(spark, [])).count() == 0


def test_personal_data_candidates_are_whole(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefABCDEF0123456789_-.") for _ in range(300))
    key = "q7Rt5mZx81LkPw"
    values = [f"token={long}", f"Password: {key}", f"API_KEY={key}==", f'"token": "{key}"', f"'Secret':'{key}'"]
    accounts = [
        "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "FR14 2004 1010 0505 0001 3M02 606", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32",
        "NL91ABNA0417164300", "IT60X0542811101000000123456", "NO93 8601 1117 947", "BE68 5390 0754 7034", "SC18 SSCB 1101 0000 0000 0000 1497 USD",
    ]
    texts = [f"see {v} here" for v in values] + [f"IBAN: {a} EUR, thanks" for a in accounts]
    got = {r.doc_id: [(x["kind"], texts[r.doc_id][x["start"] : x["end"]]) for x in r.added] for r in find(frame(spark, list(enumerate(texts)))).collect()}
    ends = [v.rstrip("\"'").lstrip("\"'") for v in values]
    assert [got[i] for i in range(len(values))] == [[("secret", v)] for v in ends]
    assert [got[len(values) + i] for i in range(len(accounts))] == [[("account", a)] for a in accounts]
    masked = {r.doc_id: r.text for r in mask(frame(spark, list(enumerate(texts)))).collect()}
    assert masked[0] == "see <secret> here" and masked[6] == "IBAN: <account> EUR, thanks"


def test_html_text():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x='</p>';</script></head><body class=has-sidebar><header>Site</header>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><div class='ad top'>Buy</div><main><article class='post no-sidebar'><h1>A&nbsp;B &lt;c&gt;</h1>"
        "<p>one\n two<b>three</b> <i>four</i><p>five<br>six &eacute;&#233;&#xe9; &am &amp</p><aside>side</aside><ul><li>x<li>y</ul><div class=cookie-notice>Cookies</div>"
        "<table><tr><td>1</td><td>2</td></tr></table><form><p>mail</p></form><section id=comments><p>first!</p></section></article></main><div class='related'>more</div><footer>&copy;</footer>"
    )
    assert html_text.extract([page]) == ["A B <c>\none twothree four\nfive six ééé &am &\nx\ny\n1\n2"]
    assert html_text.extract([None, "", "<p", "plain < text"]) == ["", "", "", "plain < text"]
    shared = "<div><span>all pages of this host carry the very same long line here</span></div>"
    pages = [f"<body>{shared}<p>unique words of page number {k} are its own text {k * 7} and stay</p></body>" for k in range(5)]
    assert html_text.extract(pages) == [f"unique words of page number {k} are its own text {k * 7} and stay" for k in range(5)]


def test_html_query_columns(spark):
    rows = [(1, "http://a.b/x", "<article><p>x  y</p></article>", 1), (2, None, None, 2), (None, "odd", "", 3), (1, "http://a.b/x", "<article><p>x  y</p></article>", 1)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "x y", 3), (1, "x y", 3), (2, "", 0)]


def test_html_boilerplate_of_a_whole_host(spark):
    rng = random.Random(10)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(700)]
    line = "the same notice stands on three pages of this host far apart"
    pages = [f"<body><div>{line}</div><p>{t}</p></body>" if k in (0, 300, 699) else f"<body><p>{t}</p></body>" for k, t in enumerate(own)]
    rows = [(k, "http://big.example/p", h) for k, h in enumerate(pages)] + [(1000 + k, f"http://h{k}.example/", pages[0]) for k in range(2)]
    rows += [(2000, "http://big.example/a", f"<article><p>{line}</p></article>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[k] == t for k, t in enumerate(own))
    assert got[1000] == got[1001] == f"{line}\n{own[0]}" and got[2000] == line
    host = pages[0], pages[300], pages[699], "<body><p>a <b>b</b></p><nav>n</nav>", pages[5]
    few = spark.createDataFrame([(k, "http://few.example/", h) for k, h in enumerate(host)], "page_id bigint, url string, html string")
    assert [r.text for r in html_text.main_text(few).orderBy("page_id").collect()] == html_text.extract(list(host))


def test_suffix_array_runs_match_brute_force():
    rng = np.random.default_rng(2)
    tokens, page = rng.integers(0, 3, 300), np.repeat(np.arange(6), 50)
    tokens[49::50] = np.arange(10, 16)  # separators
    got = html_text.repeated(tokens, page, 5, 3)
    where = collections.defaultdict(set)
    for i in range(296):
        where[tuple(tokens[i : i + 5])].add(page[i])
    want = np.zeros(300, bool)
    for i in range(296):
        if len(where[tuple(tokens[i : i + 5])]) >= 3:
            want[i : i + 5] = True
    assert (got == want).all()


def test_suffix_array_has_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (300, 2), (300, 50)):
        tokens = rng.integers(0, kinds, n)
        order, common = html_text.suffix_array(tokens)
        ends = [tokens[i:].tolist() for i in order]
        assert ends == sorted(tokens[i:].tolist() for i in range(n))
        shared = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(ends, ends[1:])]
        assert common.tolist() == shared


def test_counted_runs_match_brute_force():
    rng = random.Random(4)
    pages = [[rng.choice("ab") for _ in range(rng.choice((0, 3, 8, 60)))] for _ in range(30)]
    pages += [pages[0], pages[-1]]
    want = collections.Counter(h for p in pages for h in {html_text._hash(p[i : i + html_text.RUN]) for i in range(len(p) - html_text.RUN + 1)})
    found, pages_of = html_text.counted_runs(pages)
    assert len(set(found)) == len(found) and dict(zip(found, pages_of)) == dict(want)
    assert html_text.counted_runs([]) == html_text.counted_runs([["a"], []]) == ([], [])


def test_html_notices_inside_articles(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, quote = "this site puts the same notice into most of its articles", "three of the articles quote this sentence of somebody at length"
    own = [f"{words(9)}\n{words(30)}" + (f"\n{quote}" if k < 3 else "") for k in range(24)]
    mirror = [f"{words(2)}\n{(same := words(60)) if k == 0 else same}" for k in range(5)]
    page = lambda text: f"<nav>menu</nav><article>{''.join(f'<p>{x}</p>' for x in text.splitlines())}</article><footer>foot</footer>"
    rows = [(k, "http://own.example/", page(f"{t}\n{notice}" if k > 9 else t)) for k, t in enumerate(own)]  # 14 of 24 hold it
    rows += [(100 + k, "http://half.example/", page(f"{t}\n{notice}" if k % 2 else t)) for k, t in enumerate(own)]  # half of them do
    rows += [(200 + k, "http://mirror.example/", page(t)) for k, t in enumerate(mirror)]
    rows += [(300 + k, "http://two.example/", page(f"{own[k]}\n{notice}")) for k in range(2)] + [(400, "http://own.example/", "<main><p> </p></main>")]
    want = dict(enumerate(own)) | {100 + k: f"{t}\n{notice}" if k % 2 else t for k, t in enumerate(own)}
    want |= {200 + k: t for k, t in enumerate(mirror)} | {300 + k: f"{own[k]}\n{notice}" for k in range(2)} | {400: ""}
    frame_ = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 40):
        got = html_text.main_text(frame_.repartition(parts)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    for lo, hi in ((0, 100), (100, 200), (200, 300), (300, 400)):
        here = [r for r in rows if lo <= r[0] < hi]
        assert html_text.extract([h for _, _, h in here]) == [want[k] for k, _, _ in here]


def test_html_runs_at_any_partitioning(spark):
    line = "the same notice stands on all pages of this host"
    own = [" ".join(f"{w}{k}" for w in ("own", "words", "of", "page")) for k in range(40)]
    rows = [(k, "http://one.example/", f"<div>{line}</div><p>{own[k]}</p>") for k in range(40)]
    frame_ = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = list(enumerate(own))
    for parts in (1, 40):
        got = html_text.main_text(frame_.repartition(parts)).collect()
        assert sorted((r.page_id, r.text) for r in got) == want
    streams = [html_text.counted_runs([r.split() for r in [line] * k])[1] for k in (1, 2)]
    assert [set(s) for s in streams] == [{1}, {2}]


def test_packing(spark, corpus):
    rows = [r for r in corpus]
    got = packing.pack_documents(frame(spark, rows), shard=30).collect()
    want = collections.Counter((i, len(WORD.findall(t or "")) + 1) for i, t in rows)
    sizes = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in got:
        sizes[r.doc_id].append((r.piece, r.start, r.n_tokens))
        bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_length, r.bin_tokens))
    assert sum(n for s in sizes.values() for *_, n in s) == sum(n * k for (_, n), k in want.items())
    assert [n for _, _, n in sorted(sizes[306])] == [4096] * 7 + [30_001 - 7 * 4096] and [s for _, s, _ in sorted(sizes[306])] == [4096 * k for k in range(8)]
    for own in bins.values():
        at = 0
        for offset, n, length, filled in sorted(own):
            assert offset == at and length == own[0][2]
            at += n
        assert at == own[0][3] and own[0][2] == min(c for c in packing.LENGTHS if c >= at)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_is_best_fit_and_picks_the_cheapest_opening():
    bins, offsets, fill = packing.best_fit([6, 5, 4, 3, 2], 10, (10, 20))
    assert bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 8] and fill == [10, 10]
    *_, final = packing.pack([12, 3, 2, 1], (4, 8, 16), 1)
    assert sum(final) == 20 and sorted(final) == [4, 16]


def test_quality_classifier_learns_and_is_total(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(__import__("folioforge.llm.quality_classifier", fromlist=["FEATURES"]).FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit(x[:400], y[:400])
    assert ((model.score(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    rows = [(i, ("some plain words of prose here. " * (3 + i % 5)) if i % 2 else "BUY!! " * (20 + i)) for i in range(80)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(3, None, 1), (None, 1, 1)], "doc_id bigint, quality int, text int")
    docs = frame(spark, rows)
    got = {r.doc_id: r.score for r in score(docs, train(docs, labels, lambda c: c >= 0)).collect()}
    assert len(got) == len({i for i, _ in rows}) and all(0 <= v <= 1 for v in got.values())
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60, 80))
    none = train(docs, labels.limit(0), lambda c: c >= 0)
    assert {r.score for r in score(docs, none).collect()} == {0.5}


def test_toxicity_finds_sentences(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(300):
        parts = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            parts[2] += f" you {rng.choice(['zzidiot', 'zzloser'])} there"
        rows.append((i, ". ".join(parts) + "."))
        marks.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "İİ " + rows[0][1])]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train(frame(spark, rows), labels, lambda c: c % 3 != 1)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, y in marks)
    text = dict(rows)
    for i, y in marks:
        assert [("zz" in text[i][x["start"] : x["end"]]) for x in got[i].offending] == [True] * y
    assert 0 <= got[900].score < 0.5 and got[900].score == got[901].score and "zz" in text[902][got[902].offending[0]["start"] : got[902].offending[0]["end"]]


def held(spark, rows):
    return spark.createDataFrame([(*r, False) for r in rows], "doc_id bigint, text string, held_out boolean")


def test_language_model_base(spark, corpus):
    from pyspark.sql import functions as F

    from folioforge.llm.common import Scratch, crc_mod

    docs = frame(spark, corpus).select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    scratch = Scratch(spark)
    model = language_model.train(docs.filter(~F.col("held_out")), scratch)
    got = language_model.score(docs, model, scratch).collect()
    counts, tokens = collections.Counter(), collections.Counter()
    for i, t in corpus:
        w = tuple((t or "").encode().lower().split()) + (b"\n",)
        tokens[i, w] += 1
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or -1, len(w), sum(1 for x in w if counts[x]), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tokens.elements())
    assert model["n"] == n and model["v"] == v
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert language_model.score(docs.limit(0), model, scratch).count() == 0
    none = language_model.train(docs.limit(0), scratch)
    assert none["n"] == 0 and {(r.n_known, r.score) for r in language_model.score(docs, none, scratch).collect()} == {(0, 0.0)}


def test_language_model_scores_match_a_dictionary_of_cells(spark, monkeypatch):
    """All cells of the written tables, as one dictionary, give every score; contexts and parent sum to 1; few tokens
    to a chunk and a bucket, other numbers of partitions and other common words leave the sums what they are."""
    from folioforge.llm.common import Scratch

    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocab[: 5 + k % 55]) for _ in range(30))) for k in range(60)]
    rows += [(100 + k, f"ra{k} rb{k} ra{k} rb{k}") for k in range(10)]
    docs = [(200, "ra1 rb1"), (201, "ra1 rb2"), (202, "ra1 never"), (203, "never ra1 rb1 never"), (204, None), (None, "w1 w2"), *rows[:20]]
    got, partitions = {}, spark.conf.get("spark.sql.shuffle.partitions")
    for size, tokens, parts in ((1 << 18, 2_000_000, "4"), (40, 2_000_000, "2"), (40, 300, "7")):
        monkeypatch.setattr(language_model, "COMMON", size)
        monkeypatch.setattr(language_model, "TOKENS", tokens)
        monkeypatch.setattr(language_model, "BUCKET", 500)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        scratch = Scratch(spark)
        m = language_model.train(held(spark, rows).repartition(int(parts)), scratch)
        out = language_model.score(held(spark, docs).repartition(int(parts)), m, scratch).collect()
        got[size, tokens] = {r.doc_id: (r.score, r.n_known) for r in out}
        assert len(out) == len(docs)

        k, cells, parent, states = m["k"], {}, {}, {r.bucket: language_model.unpack(r.state) for r in m["state"].collect()}
        for r in m["cells"].collect():
            one, state = language_model.unpack(r.cells), states[r.bucket]
            c = one[-1].astype(int)
            num = c - m["d"]
            num[c > 1] = c[c > 1] - m["d"] * state[-1] / m["kept"]
            keys = language_model._sorted(one[0])
            if r.bucket % 2:
                pairs = list(zip(one[1].tolist(), keys.tolist(), strict=True))
                many = dict(zip(language_model._sorted(state[0]).tolist(), (state[4] + language_model.share(state[2], state[3], *m["totals"], m["base"], language_model.DISCOUNT)) / m["kept"], strict=True))
                parent |= {w: many.get(w, m["single"]) for w in keys.tolist()}
            else:
                pairs = [(x >> 20, x & (1 << 20) - 1) for x in keys.tolist()]
            assert not cells.keys() & set(pairs)
            cells |= dict(zip(pairs, num, strict=True))
        parent |= dict(enumerate(m["root"]))
        assert abs(sum(parent.values()) + m["unseen"] - 1) < 1e-6
        mass = collections.Counter()
        for (u, _), x in cells.items():
            mass[u] += x
        assert all(abs(x * m["seats"][u] + m["back"][u] - 1) < 1e-6 for u, x in mass.items())
        codes = language_model.Codes(m["common"])
        for i, t in docs:
            w = codes.of(t)
            u = language_model._contexts(w, k)
            want = sum(math.log10(m["back"][a] * parent.get(b, m["unseen"]) + cells.get((a, b), 0) * m["seats"][a]) for a, b in zip(u.tolist(), w.tolist(), strict=True))
            assert abs(got[size, tokens][i][0] - want) < 1e-6
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    for one in got.values():
        assert one[200][0] > one[201][0] + 0.5 > one[202][0] and one[203][1] == 3
    few, again, all_ = got[40, 2_000_000], got[40, 300], got[1 << 18, 2_000_000]
    assert all(few[i][1] == again[i][1] and abs(few[i][0] - again[i][0]) < 1e-9 for i in few)
    assert all(few[i][1] == all_[i][1] and abs(few[i][0] - all_[i][0]) < 0.05 * abs(all_[i][0]) for i in few)


def test_seating_follows_its_full_conditional():
    """Against all seatings of a cell's customers, enumerated; large cells against seating one by one."""
    d, theta, r, others = 0.6, 2.0, 0.3, 3
    weights = language_model.stirling(d)
    exact = collections.Counter()

    def seat(n, sizes, p):
        if n == 0:
            exact[len(sizes)] += p
            return
        seat(n - 1, [*sizes, 1], p * (theta + d * (others + len(sizes))) * r)
        for i, x in enumerate(sizes):
            seat(n - 1, [*sizes[:i], x + 1, *sizes[i + 1 :]], p * (x - d))

    seat(5, [], 1.0)
    many = 40_000
    keys = np.arange(many, dtype=np.uint64)
    t = language_model.draw(np.full(many, 5), np.full(many, r), np.full(many, others), keys, 1, weights, d, theta)
    total = sum(exact.values())
    for n, p in exact.items():
        assert abs((t == n).mean() - p / total) < 0.01
    c = np.array([0, 1, 2, 40, 50_000])
    t = language_model.draw(c, np.full(5, 0.2), np.zeros(5, np.int64), keys[:5], 0, weights, d)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all()
    few = language_model._binomial(np.full(many, 20), np.full(many, 0.1), language_model._chance(keys, 1), language_model._chance(keys, 2))
    big = language_model._binomial(np.full(many, 900), np.full(many, 0.1), language_model._chance(keys, 3), language_model._chance(keys, 4))
    assert abs(few.mean() - 2) < 0.05 and abs(few.var() - 1.8) < 0.1 and abs(big.mean() - 90) < 0.3 and abs(big.var() - 81) < 3


def test_blobs_round_trip():
    a = [np.array([], np.uint64), np.array([3, 3, 2**63], np.uint64), np.array([1.5, -2.0]), np.array([7], np.uint8)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, language_model.unpack(language_model.pack(*a)), strict=True))


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_equal_slots(spark):
    from pyspark.sql import functions as F

    from folioforge.llm.near_duplicates import SLOTS, equal_slots, small_bytes

    rng = np.random.default_rng(3)
    a, b = rng.random((4, SLOTS)), rng.random((4, SLOTS))
    b[:, :170] = a[:, :170]
    b[3] = a[3]
    p, q = small_bytes(a), small_bytes(b)
    unpack = lambda m: (m.view(np.uint64)[:, :, None] >> (np.arange(7, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)).reshape(4, -1)[:, :SLOTS]
    want = (unpack(p) == unpack(q)).sum(1).tolist()
    rows = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(p, q, strict=True))], "i int, a array<bigint>, b array<bigint>")
    assert [r[0] for r in rows.orderBy("i").select(equal_slots(F.col("a"), F.col("b"))).collect()] == want and want[3] == SLOTS
