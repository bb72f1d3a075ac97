"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

Documents become sets of hashed shingles of five words. Equal sets are one class from the start, so
thousands of copies cost one signature's buckets. A SuperMinHash signature gives each element a random
permutation of the slots: at level j the element bids ``j + r`` for the slot its permutation names, and
elements stop bidding once all slots of the document hold less than the level. Signatures are cut into
``BANDS`` bands of ``ROWS`` values; at a similarity of 0.75 a pair misses all bands once in 750,000.

In every bucket all classes are compared with the bucket's smallest doc_id, a star and not all pairs;
full sets confirm each link. Union-find within tasks and alternating star contraction across them turn
links into components. Only classes of one bucket that are still in different components are then
compared with each other, so that no link that could join two components is lost. There a pair is read
if it shares one of its rarest shingles at places that leave enough others (prefix, length and positional
filters, as every linked pair does), so that texts with a long passage in common don't all meet.

A row's links are those of its class: ``component_id`` is the smallest doc_id reachable.

Defined cases: null, empty or blank texts have the empty set and link with nothing; rows with a null
doc_id stay alone with a null component and are kept; repeated rows get equal results; other columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Scratch, byte_words, table
from folioforge.llm.language_model import Hashes

WORDS, BANDS, ROWS = 5, 50, 5
SLOTS = BANDS * ROWS
CHUNK = 1 << 15
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = byte_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.int64, n).view(np.uint64)
    width = min(n, WORDS)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _GOLD + h[k : n - width + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of several sets; rows of empty sets stay infinite."""
    best = np.full((len(sets), slots), np.inf)
    flat = best.reshape(-1)
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for lo in range(0, len(every), CHUNK):
        h, doc = every[lo : lo + CHUNK], which[lo : lo + CHUNK]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1)).reshape(-1)
        live = np.arange(len(h))
        first, last = doc[0], doc[-1] + 1
        for j in range(slots):
            worst = best[first:last].max(1)
            live = live[worst[doc[live] - first] > j]
            if not len(live):
                break
            x = mix(h[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            row = live * slots
            slot = order[row + k].astype(np.int64)
            order[row + k] = order[row + j]
            np.minimum.at(flat, doc[live] * slots + slot, j + (x >> np.uint64(32)).astype(np.float64) * 2.0**-32)
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2])
    for k in range(bits.shape[2]):
        out = mix(out * _GOLD + bits[:, :, k])
    return out.view(np.int64)


def small_bytes(sig: np.ndarray) -> np.ndarray:
    """A byte of each slot, seven to a number so that sums of two never overflow."""
    low = (mix(sig.view(np.uint64)) & np.uint64(0xFF)).reshape(len(sig), -1)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 7))).reshape(len(sig), -1, 7)
    return (low << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64).view(np.int64)


def equal_slots(a: Column, b: Column) -> Column:
    """How many slots of two packed signatures have equal bytes; padding is not counted."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)

    def differing(p: Column, q: Column) -> Column:
        x = p.bitwiseXOR(q)
        return F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high))

    return F.lit(SLOTS) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            sets = [shingles(t.as_py(), hashes) for t in part.column("text")]
            sig = signatures(sets)
            keys = band_keys(sig)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            bands = [list(row) if len(s) else [] for row, s in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n", "k1", "k2", "bands"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, last = Hashes(), (None, None)
    for b in batches:
        good = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            x = x.as_py()
            if last[0] != x:
                last = x, shingles(x, hashes)
            p, q = last[1], shingles(y.as_py(), hashes)
            if 4 * min(len(p), len(q)) < 3 * max(len(p), len(q)):
                good.append(False)
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("lo"), b.column("hi"), pa.array(good, pa.bool_())], names=["lo", "hi", "linked"])


#: A bitmap of 2^26 bits says which doc_ids may stand in a pair: 8 MB whatever the corpus.
_BITS = 26


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id may be in ``ids`` (id); never fewer. It spares the others the shuffle."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << _BITS))
    words = ids.select((spot / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, CAST(pmod(pmod(xxhash64(id), {1 << _BITS}), 64) AS INT))").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^20 rows at most
    bitmap = np.zeros(1 << (_BITS - 6), np.int64)
    bitmap[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("spot").to_numpy()
            keep = (shared.value[at >> 6] >> (at & 63)) & 1
            yield b.filter(pa.array(keep.astype(bool))).select(["doc_id", "text"])

    own = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << _BITS)).alias("spot"))
    return own.mapInArrow(run, "doc_id bigint, text string")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (lo, hi) whose full sets are similar enough, and those that are not, as ``linked``."""
    texts = _likely(docs, pairs.select(F.explode(F.array("lo", "hi")).alias("id")))
    hi = pairs.join(texts.select(F.col("doc_id").alias("hi"), F.col("text").alias("y")), "hi")
    both = hi.join(texts.select(F.col("doc_id").alias("lo"), F.col("text").alias("x")), "lo")
    tried = both.mapInArrow(_verify, "lo bigint, hi bigint, linked boolean")
    return tried.groupBy("lo", "hi").agg(F.max("linked").alias("linked"))


#: Shingles are put in order of rarity by their occurrences, counted in 2^20 buckets of hashes.
_COUNTS = 20


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - _COUNTS)).astype(np.int64)


def _prefixes(texts: DataFrame) -> DataFrame:
    """(rep, c, n, pos, token, short) of texts (rep, c, text): the rarest shingles of each, of which a similar
    set of whatever size shares one, and whether they are among those that one of at least its size shares."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), np.zeros(1 << _COUNTS, np.int64)
        for b in batches:
            for t in b.column("text"):
                np.add.at(counts, _bucket(shingles(t.as_py(), hashes)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    rows = texts.select("text").mapInArrow(tally, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2^20 rows at most
    counts = np.zeros(1 << _COUNTS, np.int64)
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for rep, c, t in zip(b.column("rep").to_pylist(), b.column("c").to_pylist(), b.column("text"), strict=True):
                s = shingles(t.as_py(), hashes)
                n = len(s)
                some, short = n - -(-3 * n // 4) + 1, n - -(-6 * n // 7) + 1
                if not n:
                    continue
                tokens = s[np.lexsort((s, shared.value[_bucket(s)]))[:some]]
                pos = np.arange(some)
                same = lambda x, k=some: pa.array(np.full(k, x, np.int64))
                yield pa.RecordBatch.from_arrays([same(rep), same(c), same(n), pa.array(pos), pa.array(tokens.view(np.int64)), pa.array(pos < short)], names=["rep", "c", "n", "pos", "token", "short"])

    return texts.select("rep", "c", "text").mapInArrow(run, "rep bigint, c bigint, n bigint, pos bigint, token bigint, short boolean")


def _across(prefixes: DataFrame) -> DataFrame:
    """The (lo, hi) of different components that may be similar: every linked pair is among them."""
    one = lambda k, rows: rows.select("token", *[F.col(x).alias(f"{k}_{x}") for x in ("rep", "c", "n", "pos")])
    both = one("a", prefixes.filter("short")).join(one("b", prefixes), "token")
    most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    able = both.filter("a_c != b_c AND a_n <= b_n AND 4 * a_n >= 3 * b_n").filter(7 * most >= 3 * (F.col("a_n") + F.col("b_n")))
    return able.select(F.least("a_rep", "b_rep").alias("lo"), F.greatest("a_rep", "b_rep").alias("hi")).distinct()


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges: each node with the smallest node it is joined to here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (two bigint columns) that aren't their component's
    smallest. Tasks first shrink their edges to stars by union-find; then large-star and small-star
    steps alternate, each written, until the edges stay the same."""
    first = edges.toDF("a", "b").mapInArrow(_union, "a bigint, b bigint")
    now = scratch.write(first.distinct(), "edges")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        """e: pairs with a > b."""
        if large:
            both = e.union(e.select(F.col("b"), F.col("a")).toDF("a", "b"))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            return out.filter("a > b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        out = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b"))
        return out.filter("a > b").distinct()

    mark = lambda e: tuple(e.agg(F.count("a"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    before = mark(now)
    while before[0]:
        then = scratch.write(stars(stars(now, True), False), "edges")
        scratch.drop(now)
        now, after = then, mark(then)
        if after == before:
            break
        before = after
    return now.toDF("node", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sig = scratch.write(docs.mapInArrow(_describe, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"), "signatures")
    own = sig.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.write(own.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = own.join(classes.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"], "left_semi")
    cells = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    shared = cells.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("top")).filter("lo < top").select("key", "lo")
    buckets = scratch.write(cells.join(shared, "key"), "buckets")
    stars = buckets.filter("rep > lo").select("lo", F.col("rep").alias("hi")).distinct()
    tried = scratch.write(_linked(scratch.write(stars, "stars"), docs), "tried")
    links = tried.filter("linked").select("lo", "hi")
    found = components(links, scratch)

    # Classes of one bucket in different components: compared with each other, not again with the smallest.
    placed = buckets.join(found.toDF("rep", "c"), "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("key")
    mixed = scratch.write(placed.join(split, "key").select("rep", "c").distinct(), "mixed")
    texts = _likely(docs, mixed.select(F.col("rep").alias("id"))).withColumnRenamed("doc_id", "rep")
    cross = _across(scratch.write(_prefixes(scratch.write(mixed.join(texts, "rep").select("rep", "c", "text"), "texts")), "prefixes"))
    cross = scratch.write(cross.join(tried.select("lo", "hi"), ["lo", "hi"], "left_anti"), "cross")
    more = _linked(cross, docs).filter("linked").select("lo", "hi")
    found = components(links.union(more), scratch)

    rows = sig.drop("bands").join(classes, ["k1", "k2"], "left")
    rows = rows.join(found.toDF("rep", "c"), "rep", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("c", "rep"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are kept, one row of each; rows without doc_id stay. Only rows whose doc_id occurs
    again are compared with each other in all columns, so texts move once."""
    rows = near_duplicates(docs).filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.count("*") > 1).alias("__again"))
    kept = docs.join(rows, "doc_id").select(*docs.columns, "__again")
    once, again = kept.filter(~F.col("__again")).drop("__again"), kept.filter("__again").drop("__again").dropDuplicates()
    return once.unionByName(again).unionByName(docs.filter(F.col("doc_id").isNull()))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
