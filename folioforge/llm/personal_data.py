"""Personal data: weak-supervision aggregation over candidate spans, in DataFrame operations alone.

Four base kinds have fixed patterns and checks. Beyond them, wider patterns propose candidates:
secrets, telephone numbers without a plus sign, account numbers, written-out mail addresses. Three
families of labelers vote on each candidate (1 yes, -1 no, 0 abstain): strict patterns (regex),
lists of cue words and domains (gazetteer) and the text around it (context). Candidates are counted
by kind, votes and shape, a bounded table, on which expectation-maximisation estimates the
labelers' reliabilities; its posteriors then train the final span classifier, a logistic model of
kind, shape and context whose weights become literals of the scoring expression. Accepted
candidates that overlap no base span are added; base spans always stay.

Starts of matches follow from the lengths of matches and of what lies between them. Patterns use
possessive repeats and ``\\G``, which match the same text as the plain forms but never back up over
long runs.

Defined cases: null and empty texts have no spans; repeated rows are scanned each for itself; other
columns are ignored; without candidates the classifier accepts none; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Scratch, table

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in the order of the listing.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "(?:[0-9][ -]?){13}", "phone": "\\+[0-9]"}
#: Cue words of secrets and of contact data in four languages.
SECRET_CUES = "password|passwd|pwd|passwort|passe|clave|token|secret|api_key|apikey|auth|bearer"
CONTACT_CUES = "tel|phone|call|fax|mobile|contact|kontakt|telefon|appel|llame|mail|iban|account|konto|compte|cuenta|ssn"
#: What leads to a secret: a cue word in any case, perhaps quoted, and a sign.
_SAID = rf"(?i:{SECRET_CUES})[\"']? ?[=:] ?[\"']?"
#: The last one to three characters of an account number; after a space a digit tells them from a word.
_REST = r"(?:[A-Z0-9]{1,3}| (?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})"
_CANDIDATE = {
    "secret": rf"{_SAID}[A-Za-z0-9/_+.-]{{8,}}+={{0,2}}+",
    "account": rf"\b(?:(?:MU|SC)[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{6}} ?[A-Z]{{2,3}}|[A-Z]{{2}}[0-9]{{2}}(?:(?: ?[A-Z0-9]{{4}}){{3,7}}(?:{_REST})?|(?: ?[A-Z0-9]{{4}}){{2}}{_REST}))\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local_phone": r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3}[ .-][0-9]{3,5}(?![0-9])",
    "written_mail": r"[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,64}){1,4}",
}
CANDIDATE = "|".join(f"(?:{p})" for p in _CANDIDATE.values())
KINDS = [*BASE, *_CANDIDATE]


def _digits(m: Column) -> Column:
    return F.translate(m, " ().+-", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts doubled."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 4) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:bigint,end:bigint,text:string,kind:string,before:string,after:string>>"


def _spans(text: Column, pattern: str, hint: Column, keep, context: int = 0) -> Column:
    """Matches that ``keep`` accepts, as structs of start, end, text and what stands around them."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    around = lambda end, x, w: (F.substring(text, F.greatest(end - F.length(x) - w + 1, F.lit(1)), F.least(end - F.length(x), F.lit(w))), F.substring(text, end + 1, F.lit(w)))

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(x["hit"], F.lit(""))
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(hit)
        before, after = around(end.cast("int"), hit, context) if context else (F.lit(""), F.lit(""))
        one = F.struct(start.alias("start"), end.alias("end"), hit.alias("text"), F.lit("").alias("kind"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.when((hit != "") & keep(hit), F.concat(acc["out"], F.array(one).cast(_SPAN))).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(hint, F.aggregate(pairs, first, step, lambda a: a["out"])).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, email, ip, card, phone): the whole text and the base spans of each kind."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return df.select("doc_id", "t", *[_spans(F.col("t"), p, F.col("t").rlike(HINT[k]), lambda m, k=k: _valid(k, m)).alias(k) for k, p in BASE.items()])


def candidates(spans: DataFrame) -> DataFrame:
    """Adds ``c``: candidate spans that overlap no base span, with their kind, votes and shape."""
    df = spans.withColumn("c", _spans(F.col("t"), CANDIDATE, F.col("t").rlike(CANDIDATE), lambda m: F.lit(True), context=24))
    taken = F.concat(*[F.col(k) for k in BASE])
    kind = lambda x: F.coalesce(*[F.when(x["text"].rlike(f"^(?:{p})$"), k) for k, p in _CANDIDATE.items()], F.lit("secret"))
    value = lambda x: F.regexp_replace(x["text"], f"^{_SAID}", "")
    near = lambda x, cues: F.lower(x["before"]).rlike(f"(?:{cues})[^A-Za-z]{{0,3}}$")

    def seen(x: Column) -> Column:
        v = value(x)
        mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        strict = F.when(v.rlike("^[0-9a-f]{16,}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|\\[at|\\(at"), 1).otherwise(0)
        listed = F.when(F.lower(x["text"]).rlike(f"^(?:{SECRET_CUES})|(?:com|org|net|edu|example)$"), 1).otherwise(0)
        around = F.when(near(x, f"{SECRET_CUES}|{CONTACT_CUES}"), 1).when(x["before"].rlike("[$€#=*/]$") | x["after"].rlike("^[%€$]"), -1).otherwise(0)
        shape = F.when(mixed, 1).when(F.length(v) < 9, -1).otherwise(0)
        return F.struct(x["start"], x["end"], kind(x).alias("kind"), strict.alias("a"), listed.alias("b"), around.alias("d"), shape.alias("e"), F.least(F.length(v) / 8, F.lit(6)).cast("int").alias("size"))

    free = F.filter("c", lambda x: ~F.exists(taken, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.withColumn("c", F.transform(free, seen))


def estimate(counted: list[tuple[tuple[int, ...], int]], steps: int = 50) -> list[float]:
    """Posterior chance that each counted vote pattern is personal data, by expectation-maximisation."""
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in counted]
    total = sum(k for _, k in counted)
    for _ in range(steps):
        yes = sum(p * k for p, (_, k) in zip(post, counted, strict=True))
        odds = [math.log((yes + 1) / (total - yes + 1))] * len(counted)
        for j in range(len(counted[0][0]) if counted else 0):
            for vote in (-1, 0, 1):
                lean = {-1: (0.5, 2.0), 0: (1.0, 1.0), 1: (2.0, 0.5)}[vote]
                rows = [i for i, (v, _) in enumerate(counted) if v[j] == vote]
                g = sum(post[i] * counted[i][1] for i in rows) + lean[0]
                b = sum((1 - post[i]) * counted[i][1] for i in rows) + lean[1]
                w = math.log(g / (yes + 3.5)) - math.log(b / (total - yes + 3.5))
                for i in rows:
                    odds[i] += w
        post = [1 / (1 + math.exp(-max(-50.0, min(50.0, o)))) for o in odds]
    return post


def fit(rows: list[tuple[tuple[str, int, int, int], float, int]], steps: int = 300, rate: float = 0.3, l2: float = 0.01) -> tuple[float, dict[tuple[str, object], float]]:
    """The span classifier: a logistic model of (kind, size, context, shape) on counted posteriors."""
    w: dict[tuple[str, object], float] = defaultdict(float)
    bias, total = 0.0, sum(k for *_, k in rows) or 1
    names = ("kind", "size", "d", "e")
    for _ in range(steps):
        g, gb = defaultdict(float), 0.0
        for x, p, k in rows:
            z = bias + sum(w[f] for f in zip(names, x, strict=True))
            r = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) * k / total
            gb += r
            for f in zip(names, x, strict=True):
                g[f] += r
        bias -= rate * 4 * gb
        for f, v in g.items():
            w[f] -= rate * 4 * (v + l2 * w[f] / 100)
    return bias, dict(w)


def find(docs: DataFrame, least: float = 0.5, texts: bool = True) -> DataFrame:
    """(doc_id, t, email, ip, card, phone, added): base spans, and accepted candidates with kinds. Patterns run
    once: what they find is written, with the texts ``t`` only if they are asked for."""
    spans = candidates(base_spans(docs))
    spans = Scratch(docs.sparkSession).write(spans if texts else spans.drop("t"), "spans")
    one = F.explode("c").alias("x")
    votes = spans.select(one).groupBy(*[F.col(f"x.{c}").alias(c) for c in ("kind", "size", "a", "b", "d", "e")]).count().collect()  # by pattern: a few thousand rows at most
    by_vote: dict[tuple[int, ...], int] = defaultdict(int)
    for r in votes:
        by_vote[(r.a, r.b, r.d, r.e)] += r["count"]
    counted = sorted(by_vote.items())
    post = dict(zip((v for v, _ in counted), estimate(counted), strict=True))
    bias, weight = fit(sorted(((r.kind, r.size, r.d, r.e), post[r.a, r.b, r.d, r.e], r["count"]) for r in votes))

    def odds(x: Column) -> Column:
        z = F.lit(bias)
        for name in ("kind", "size", "d", "e"):
            own = [(v, w) for (f, v), w in weight.items() if f == name]
            pick = F.lit(0.0)
            for v, w in own:
                pick = F.when(x[name] == F.lit(v), F.lit(w)).otherwise(pick)
            z = z + pick
        return z

    cut = math.log(least / (1 - least))
    return spans.withColumn("added", F.filter("c", lambda x: odds(x) >= cut) if votes else F.filter("c", lambda x: F.lit(False))).drop("c")


def _with_kind(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _said(kind: str):
    """A span as kind:start:end."""
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def mask(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): the texts with every found span replaced by its kind in angle brackets.

    A base span that overlaps one of an earlier kind is left to that one."""
    found = find(docs) if spans is None else spans
    every = F.array_sort(F.concat(
        *[F.transform(k, _with_kind(k)) for k in BASE],
        F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))),
    ))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring("t", (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, x: F.when(
        x["start"] >= acc["at"],
        F.struct(x["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], x["start"]), F.lit("<"), x["kind"], F.lit(">")).alias("out")),
    ).otherwise(acc)
    text = F.aggregate("e", first, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length("t").cast("bigint"))))
    return found.withColumn("e", every).select("doc_id", text.alias("text"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), texts=False)
    found = found.withColumn("base", F.concat(*[F.transform(k, _said(k)) for k in BASE]))
    more = F.concat("base", *[F.transform(F.filter("added", _of_kind(k)), _said(k)) for k in _CANDIDATE])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(more, ",").alias("spans"),
    )
