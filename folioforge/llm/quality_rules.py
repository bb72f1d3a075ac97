"""Quality rules as weak supervision, in DataFrame operations alone.

Nine rules look at a text and vote: good (1), bad (-1) or abstain (0). Nobody says how far a rule
can be trusted. Rows are counted by their pattern of votes (3^9 patterns at most, however large the
corpus), and expectation-maximisation on these counts estimates for both classes how often each
rule votes what. The weights that follow are literals of the expression that gives each row its
posterior chance of being good, which replaces all-must-pass filtering.

Defined cases: a null text has no words, so it fails the base rule; an empty one likewise; repeated
rows count and are judged each for itself; other columns are ignored; an empty table gives an empty
result. A line is what stands between two ``\\n``; one without a word is never a repeated line.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, Scratch, table

RULES = ("word_length", "symbols", "repeats", "dup_lines", "capitals", "shouting", "sentences", "function_words", "bars")
_SPLIT = r"[\x20\x09-\x0D]+"
#: Common short words of English, French, German and Spanish.
COMMON = (
    "the of and to in is that it for was on are be with as at by this from or "
    "de la le et les des en un une du que est pour dans par sur qui au avec pas "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "el los las del se por con para su al lo como una y a o no"
).split()


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` match the character class ``chars``."""
    return F.size(F.regexp_extract_all(text, F.lit(f"[{chars}]"), F.lit(0))).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, counts): the contract's base measures and those that the rules need besides.

    Windows of three words become 64-bit hashes. Only texts in which a hash occurs twice sort their
    (hash, place) pairs, so that equal windows meet; what is covered follows from the places."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    df = docs.select("doc_id", text.alias("t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT)).alias("w"))
    n = F.size("w")
    grams = F.when(
        n > 2,
        F.transform(F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    common = F.array(*map(F.lit, COMMON))
    # one pass over the text leaves a short string of the characters that are counted
    df = df.withColumn("marks", F.array_join(F.regexp_extract_all("t", F.lit("[A-Z!.?#*$%&|<>]"), F.lit(0)), ""))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count_of(F.col("marks"), "#*$%&|<>").alias("n_symbols"),
        _count_of(F.col("marks"), "A-Z").alias("n_upper"),
        _count_of(F.col("marks"), "!").alias("n_exclaim"),
        _count_of(F.col("marks"), "|").alias("n_bars"),
        _count_of(F.col("marks"), ".?").alias("n_stops"),
        F.size(F.array_intersect("w", common)).cast("long").alias("n_common"),
        lines.alias("lines"),
        grams.alias("g"),
    )
    df = df.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "s": F.when(
            F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    }).drop("lines", "g")
    same = lambda a, x: F.coalesce(a["h"] == x["h"], F.lit(False))
    again = F.filter("s", lambda x, k: same(F.get("s", k + 1), x) | same(F.get("s", k - 1), x))
    df = df.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.coalesce(F.least(F.get("p", k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(m: DataFrame) -> DataFrame:
    """Adds a column ``v`` with one of -1, 0, 1 per rule."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    c = F.col
    some = c("n_words") >= 20
    mean = c("word_chars") / n
    rules = {
        "word_length": _vote(mean.between(3.0, 10.0), ~mean.between(2.0, 14.0)),
        "symbols": _vote(c("n_symbols") <= 0.05 * n, c("n_symbols") > 0.25 * n),
        "repeats": F.when(some, _vote(c("n_repeat_words") <= 0.15 * n, c("n_repeat_words") > 0.4 * n)).otherwise(0),
        "dup_lines": F.when(c("n_lines") >= 2, _vote(c("n_dup_lines") == 0, c("n_dup_lines") >= 0.3 * lines)).otherwise(0),
        "capitals": F.when(c("word_chars") > 0, _vote(c("n_upper") <= 0.12 * c("word_chars"), c("n_upper") > 0.3 * c("word_chars"))).otherwise(0),
        "shouting": _vote(c("n_exclaim") <= 0.05 * n, c("n_exclaim") > 0.25 * n),
        "sentences": F.when(some, _vote(c("n_stops").between(0.02 * n, 0.5 * n), c("n_stops") < 0.005 * n)).otherwise(0),
        "function_words": F.when(some, _vote(c("n_common") >= 4, c("n_common") == 0)).otherwise(0),
        "bars": _vote(c("n_bars") <= 0.02 * n, c("n_bars") > 0.2 * n),
    }
    return m.withColumn("v", F.array(*[rules[r].cast("tinyint") for r in RULES]))


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 60) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation on counted vote patterns: the prior log odds of good, and per rule the
    log odds that each vote adds; abstaining adds nothing. It starts from the count of bad votes, which
    fixes which class is good: rules praise nearly every text in most respects, so praise says little."""
    total = sum(k for _, k in patterns) or 1
    post = [0.95 * 0.2 ** v.count(-1) for v, _ in patterns]
    prior, weight = 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in RULES]
    for _ in range(steps):
        good = sum(p * k for p, (_, k) in zip(post, patterns, strict=True))
        prior = math.log((good + 1) / (total - good + 1))
        for j in range(len(RULES)):
            g, b = {}, {}
            for vote, (lean_good, lean_bad) in {-1: (0.5, 2.0), 1: (2.0, 0.5)}.items():  # a rule is taken to do better than chance
                g[vote] = sum(p * k for p, (v, k) in zip(post, patterns, strict=True) if v[j] == vote) + lean_good
                b[vote] = sum((1 - p) * k for p, (v, k) in zip(post, patterns, strict=True) if v[j] == vote) + lean_bad
            for vote in (-1, 1):
                weight[j][vote] = math.log(g[vote] / sum(g.values())) - math.log(b[vote] / sum(b.values()))
        post = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(weight[j][x] for j, x in enumerate(v)))))) for v, _ in patterns]
    return prior, weight


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Measures, ``votes``, ``p_good`` and ``kept`` for each document."""
    scratch = Scratch(docs.sparkSession)
    m = scratch.write(votes(base_measures(docs)), "measures")  # some numbers a row; texts are read once
    counted = m.groupBy("v").count().collect()  # 3^9 rows at most
    prior, weight = estimate(sorted((tuple(r[0]), r[1]) for r in counted))
    odds = reduce(
        lambda a, b: a + b,
        [F.when(F.col("v")[j] == -1, w[-1]).when(F.col("v")[j] == 1, w[1]).otherwise(w[0]) for j, w in enumerate(weight)],
        F.lit(prior),
    )
    m = m.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
