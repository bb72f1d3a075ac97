"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its words, each a number: the class of its rarity above 57 bits
of its hash. Rarity is the number of occurrences in the whole corpus, counted in 2^BUCKETS buckets of
hashes, a table of fixed size that a scalar subquery brings to the tasks; any two words are thereby
ordered alike everywhere, which is all that exactness needs. Lines with equal sets are one class and
keep only their first occurrence, so copies never meet each other in the join.

Two sets with a Jaccard similarity of ``percent`` / 100 share a word among their rarest
n - ceil(n * percent / 100) + 1 (prefix filter), differ little in size (length filter), and after a
shared word at given places enough words are left (positional filter), and 64 parity bits differ in no more
places than the sets may differ in words. Words that occur once in the
corpus are not joined. In the bucket of a word in few classes (SMALL) all pairs are compared, in that of a word
in more all classes first meet the earliest class alone, a star; only those left without an earlier match
then meet the bucket's other classes. Full sets decide.

A line is removed if an earlier line of the corpus (by doc_id, then line number) is similar enough,
whether or not that one is itself removed. Lines of fewer than ``least`` distinct words stay: headings
and closing words recur by right.

Defined cases: null and empty texts have no line to remove; rows with a null doc_id have no place in
the order and stay whole; repeated rows are one document and fare alike; rows of one doc_id with
differing texts are told apart by a hash of the text; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, Scratch, table

PERCENT, LEAST, BUCKETS, SHIFT = 90, 5, 22, 7
SMALL = 64  # buckets of no more classes compare all pairs where they lie
_BITS = 22  # of the bitmap that says which lines may stand in a pair: 512 KB


def _words(line: Column) -> Column:
    """Words of a line, and empty ones where white space stands at an end or twice."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    return F.when(other, F.split(line, r"[\x20\x09-\x0D]+", -1)).otherwise(F.split(line, " ", -1))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, dk, line_no, line) of rows with a doc_id; dk tells texts of one doc_id apart."""
    own = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("dk"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKETS)


def rarity(docs: DataFrame) -> DataFrame:
    """One row with an array of 2^BUCKETS numbers: the whole part of log2 of a bucket's occurrences."""
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))  # lines don't matter here
    words = docs.filter(F.col("text").isNotNull()).select(F.explode(_words(flat)).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("id")).count()
    cell = (F.col("id") % 4096 * 64 + F.floor(F.log2("count"))).cast("int")  # place in its run and number, sorted as one
    found = counts.groupBy(F.shiftright("id", 12).alias("run")).agg(F.collect_list(cell).alias("a"))
    every = docs.sparkSession.range(1 << (BUCKETS - 12)).withColumnRenamed("id", "run").join(found, "run", "left").withColumn("a", F.coalesce("a", F.array().cast("array<int>")))
    without = F.array_except(F.sequence(F.lit(0), F.lit(4095)), F.transform("a", lambda x: F.shiftright(x, 6)))
    full = F.sort_array(F.concat("a", F.transform(without, lambda x: x * 64)))
    return _joined(every.select("run", F.transform(full, lambda x: (x % 64).cast("tinyint")).alias("a")), "k")


def _array_of(cells: DataFrame, name: str) -> DataFrame:
    """One row with the array of a column in the order of ``id``, gathered by way of runs of 4096."""
    runs = cells.groupBy(F.shiftright("id", 12).alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", name))), lambda x: x[name]).alias("a"))
    return _joined(runs, name)


def _joined(runs: DataFrame, name: str) -> DataFrame:
    return runs.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "a"))), lambda x: x["a"])).alias(name))


def _numbers(line: Column, rare: Column) -> Column:
    """A line's word numbers, rarest first."""
    words = F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # One reference to the table: two would make Spark copy it into each row. Numbers that can't be null are sorted unboxed.
    # Functions of an array's elements are interpreted, so each step counts.
    number = lambda h: F.shiftleft(rare[_bucket(h)].cast("bigint"), 64 - SHIFT).bitwiseOR(F.shiftrightunsigned(h, SHIFT))
    return F.sort_array(F.transform(words, lambda h: F.coalesce(number(h), F.lit(0).cast("bigint"))))


def _parity(numbers: Column) -> Column:
    """64 bits: for each, whether an odd number of the words fall on it. Two sets that differ in k words
    differ in k bits at most."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.hash(x))))  # shifts count modulo 64


def _need(n: Column, percent: int) -> Column:
    """The least size of a similar set's intersection with one of n words: ceil(n * percent / 100)."""
    return F.floor((n * percent + 99) / 100).cast("int")


_ROW = ("doc", "line", "h", "n", "pos", "bits")


def _similar(a: str, b: str, percent: int) -> Column:
    """Length, positional and bitmap filters for two prefix rows, told apart by a letter before their columns."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    most = 1 + F.least(na - F.col(f"{a}_pos") - 1, nb - F.col(f"{b}_pos") - 1)
    apart = F.bit_count(F.col(f"{a}_bits").bitwiseXOR(F.col(f"{b}_bits")))  # similar sets differ in few words
    return (
        (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & ((100 + percent) * most >= percent * (na + nb))
        & ((100 + percent) * apart <= (100 - percent) * (na + nb))
    )


def _named(rows: DataFrame, letter: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{letter}_{c}") if c in _ROW else F.col(c) for c in rows.columns])


def _earlier(a: str, b: str) -> Column:
    doc, line = F.col(f"{a}_doc"), F.col(f"{a}_line")
    return (doc < F.col(f"{b}_doc")) | ((doc == F.col(f"{b}_doc")) & (line < F.col(f"{b}_line")))


_PAIR = ["a_doc", "a_line", "a_h", "b_doc", "b_line", "b_h"]


def _verified(pairs: DataFrame, docs: DataFrame, rare: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs of lines whose full sets are similar enough. Sets are made anew from the texts, and only
    of documents and lines that a bitmap of fixed size says may stand in a pair; they are told apart by their hash."""
    spot = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << _BITS))
    ends = pairs.select(F.explode(F.array(spot("a_doc", "a_line"), spot("b_doc", "b_line"), spot("a_doc"), spot("b_doc"))).alias("s"))
    words = ends.groupBy(F.shiftright("s", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("bits"))
    every = docs.sparkSession.range(1 << (_BITS - 6)).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    bitmap = _array_of(every, "bits").scalar()
    bit = lambda s: F.call_function("shiftright", F.get(bitmap, F.shiftright(s, 6).cast("int")), (s % 64).cast("int")).bitwiseAND(F.lit(1))
    likely = docs.filter(F.col("doc_id").isNotNull()).filter(bit(spot(F.col("doc_id").cast("bigint"))) == 1)
    sets = _lines(likely).filter(bit(spot("doc_id", "line_no")) == 1).withColumn("__rare", rare.scalar()).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("line"), _numbers(F.col("line"), F.col("__rare")).alias("e"))
    sets = scratch.write(sets.withColumn("h", F.xxhash64("e")), "sets")  # else both ends might read the texts
    one = lambda k: sets.select(*[F.col(c).alias(f"{k}_{c}") for c in ("doc", "line", "h", "e")])
    both = pairs.join(one("b"), ["b_doc", "b_line", "b_h"]).join(one("a"), ["a_doc", "a_line", "a_h"])
    inter = F.size(F.array_intersect("a_e", "b_e"))
    return both.filter((100 + percent) * inter >= percent * (F.size("a_e") + F.size("b_e"))).select(*_PAIR)


def removed_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """(doc_id, dk, line_no, class_doc, class_line, similar) of the lines that go: the class's first
    occurrence, and whether that one itself has an earlier similar line."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rare = scratch.write(rarity(docs), "rarity")
    lines = _lines(docs).withColumn("__rare", rare.scalar()).select("doc_id", "dk", "line_no", _numbers(F.col("line"), F.col("__rare")).alias("e"))
    n, once = F.size("e"), 1 << (64 - SHIFT)  # numbers below are words that occur once
    places = F.slice("e", F.lit(1), n - _need(n, percent) + 1)
    other = (_need(n, percent) < n) | (F.floor(100 * n / percent) > n)  # a smaller or a larger set may be similar enough
    prefix = F.when(other & (n >= least) & (F.get(places, n - _need(n, percent)) >= once), places)  # the last is the most frequent
    # all lines are written: a filter on n would be pushed below and make the numbers twice
    lines = scratch.write(lines.select("doc_id", "dk", "line_no", n.alias("n"), F.xxhash64("e").alias("h"), prefix.alias("prefix"), F.when(prefix.isNotNull(), _parity(F.col("e"))).alias("bits")), "lines").filter(F.col("n") >= least)
    first = F.min(F.struct("doc_id", "line_no"))
    # equal sets have equal prefixes and bits: any line's are the class's
    classes = lines.groupBy("h", "n").agg(first.alias("l"), F.count(F.lit(1)).alias("lines"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = scratch.write(classes, "classes")
    own = classes.filter(F.col("prefix").isNotNull()).select(F.col("l.doc_id").alias("doc"), F.col("l.line_no").alias("line"), "h", "n", "bits", F.posexplode("prefix").alias("pos", "word"))
    bucket = W.partitionBy("word").orderBy("doc", "line", "h")
    whole = bucket.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the filter leaves no null words: else the join would add one to one of its sides, and rows be dealt out twice
    rows = own.filter(F.col("word") >= once).withColumns({"place": F.row_number().over(bucket), "many": F.count(F.lit(1)).over(whole)})
    # All classes of a small bucket are here, of a large one the earliest, its star.
    here = _named(rows.filter((F.col("many") <= SMALL) | (F.col("place") == 1)).drop("place", "many"), "a")
    there = _named(rows.filter(F.col("place") > 1).drop("place"), "b")
    met = there.withColumnRenamed("word", "b_word").join(here, (F.col("b_word") == F.col("word")) & _earlier("a", "b") & _similar("a", "b", percent), "left")
    large, pair = F.col("many") > SMALL, F.col("a_doc").isNotNull()
    seen = [F.when(large | pair, F.col(c)).alias(c) for c in (f"b_{c}" for c in _ROW)]  # the rest is read no more
    met = scratch.write(met.select(F.col("b_word").alias("word"), *seen, "a_doc", "a_line", "a_h", large.alias("large"), (F.col("many") == 2).alias("alone")), "met")
    star = scratch.write(met.filter(F.col("a_doc").isNotNull()).select(*_PAIR).distinct(), "star")
    hits = scratch.write(_verified(star, docs, rare, percent, scratch).select("b_doc", "b_line", "b_h").distinct(), "hits")
    scratch.drop(star)

    others = met.filter("large").select("word", *[F.col(f"b_{c}") for c in _ROW])
    left = others.join(hits, ["b_doc", "b_line", "b_h"], "left_anti")
    before = others.select("word", *[F.col(f"b_{c}").alias(f"a_{c}") for c in _ROW])
    pairs = before.join(left, "word").filter(_earlier("a", "b") & _similar("a", "b", percent)).select(*_PAIR).distinct()
    pairs = scratch.write(pairs, "others")
    scratch.drop(met)
    more = _verified(pairs, docs, rare, percent, scratch).select("b_doc", "b_line", "b_h")
    similar = hits.union(more).distinct().select(F.struct(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no")).alias("l"), F.col("b_h").alias("h"), F.lit(True).alias("similar"))

    marked = classes.drop("prefix", "bits").join(similar, ["h", "l"], "left")
    marked = marked.filter((F.col("lines") > 1) | F.col("similar").isNotNull()).drop("lines")  # of the rest no line goes
    every = lines.drop("prefix", "bits").join(marked, ["h", "n"])
    goes = F.coalesce("similar", F.lit(False)) | (F.struct("doc_id", "line_no") > F.col("l"))
    return every.filter(goes).select("doc_id", "dk", "line_no", F.col("l.doc_id").alias("class_doc"), F.col("l.line_no").alias("class_line"), F.coalesce("similar", F.lit(False)).alias("similar"))


def _listed(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc_id", "dk").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """The documents without the lines that go, n_chars anew; those of which nothing is left go."""
    gone = _listed(removed_lines(docs, percent, least)).toDF("__id", "__dk", "__gone")
    both = docs.withColumn("__key", F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__dk")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    both = both.filter(F.col("__gone").isNull() | (F.btrim(kept, F.lit(SPACE)) != ""))
    own = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.withColumns(own).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = _listed(removed_lines(docs)).withColumnRenamed("doc_id", "__id").withColumnRenamed("dk", "__dk")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64("text").alias("__key"), F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    both = own.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__dk")), "left")
    count = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return both.select("doc_id", "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(count).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
