"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item; an item with
fewer words is one pattern. Patterns of one length share three tables: a block shift table, by hash, tells
how far the search may jump when the last two words of its window end no pattern, a suffix table
holds the patterns by their last block, keyed again by their first block, and a direct comparison
confirms each occurrence.

The benchmark is cut into chunks of at most ``chunk_bytes`` of text. Each chunk becomes one broadcast
of bounded size, flat arrays and one dictionary of its words, and one pass over the documents, so a larger
benchmark costs more passes, not more memory. No document row is shuffled.

Defined cases: null or empty text has no words, is not contaminated and hits no item; an item
without words is no pattern; the windows of an item without item_id hit words, but it is neither counted nor
listed among the items; repeated rows are scored each for itself; an item whose text occurs
twice under two ids counts twice; other columns are ignored; empty tables give empty results or rows
without hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Scratch, table

#: Bytes outside 0-9, a-z, A-Z and 0x80-0xFF separate words; A-Z become a-z.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
CHUNK_BYTES, HASH_BITS = 8 << 20, 20


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)


class LengthGroup:
    """Wu-Manber tables for patterns of one length, over word numbers (0: in no pattern), in flat arrays.

    A pattern is a place in ``words``, the numbers of all items one after another. ``shift`` says by the hash
    of a block how far the search may jump, the least of what its blocks allow; ``keys`` are the suffix blocks
    of all patterns in order, each with the pattern's first block, place and item."""

    def __init__(self, m: int, words: np.ndarray, places: np.ndarray, items: np.ndarray):
        self.m, self.block, self.words = m, min(2, m), words
        self.shift = np.full(1 << HASH_BITS, m - self.block + 1, np.uint8 if m < 256 else np.uint32)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, _block_hash(*self._blocks(words, places + end - 1)), m - end)
        suffix, first = (self._key(*self._blocks(words, places + k)) for k in (m - 1, self.block - 1))
        order = np.lexsort((items, places, first, suffix))
        self.keys, self.first, self.places, self.items = suffix[order], first[order], places[order], items[order]

    def _blocks(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (ids[at - 1] if self.block == 2 else np.zeros(len(at), ids.dtype)), ids[at]

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Places where a pattern may end: the search jumps by the shift of the block at its place."""
        m, n = self.m, len(ids)
        if n < m:
            return np.zeros(0, np.int64)
        last = np.arange(m - 1, n)
        steps = np.where(ids[last] == 0, m, self.shift[_block_hash(*self._blocks(ids, last))]).tolist()
        i, n, out = 0, n - m + 1, []
        while i < n:
            step = steps[i]
            if step:
                i += step
            else:
                out.append(i + m - 1)
                i += 1
        return np.array(out, np.int64)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Starts of occurrences, each with an item whose pattern stands there."""
        ends = self.ends(ids)
        if not len(ends):
            return
        keys, firsts = self._key(*self._blocks(ids, ends)), self._key(*self._blocks(ids, ends - self.m + self.block))
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(lo < hi).tolist():
            start = int(ends[k]) - self.m + 1
            a, z = int(lo[k]), int(hi[k])
            own = self.first[a:z]
            a, z = a + int(np.searchsorted(own, firsts[k])), a + int(np.searchsorted(own, firsts[k], "right"))
            text, last, same = ids[start : start + self.m].tobytes(), -1, False
            for p in range(a, z):
                place = int(self.places[p])
                if place != last:
                    last, same = place, self.words[place : place + self.m].tobytes() == text
                if same:
                    yield start, int(self.items[p])


class Index:
    """Search tables of one benchmark chunk."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int):
        self.names: list[str | None] = []
        self.vocabulary: dict[bytes, int] = {}
        number, texts, of, lengths = self.vocabulary.setdefault, [], [], []
        for name, text in items:
            ws = words(text)
            if ws:
                of.append(len(self.names))
                self.names.append(None if name is None else str(name))
                texts.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in ws), np.uint32, len(ws)))
                lengths.append(min(window, len(ws)))
        every = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        starts = np.cumsum([0, *(len(t) for t in texts)])
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, m in enumerate(lengths):
            by_length[m].append(k)
        self.groups = []
        for m, own in sorted(by_length.items()):
            places = [np.arange(starts[k], starts[k + 1] - m + 1) for k in own]
            self.groups.append(LengthGroup(m, every, np.concatenate(places), np.repeat(np.array([of[k] for k in own], np.int64), [len(p) for p in places])))

    def find(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word intervals (end exclusive, not merged) and item numbers."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in doc), np.uint32, len(doc))
        spans, found = set(), set()
        if ids.any():
            for g in self.groups:
                for start, item in g.search(ids):
                    spans.add((start, start + g.m))
                    found.add(item)
        return list(spans), found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(broadcast, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for batch in batches:
            n, spans, items = [], [], []
            before = batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
            for text, old, had in zip(batch.column("text"), *before, strict=True):
                ws = words(text.as_py())
                new, found = index.find(ws)
                n.append(len(ws))
                spans.append([x for s in merged([*zip(old[::2], old[1::2], strict=True), *new]) for x in s] if new else old)
                items.append(sorted({*had, *(index.names[k] for k in found if index.names[k] is not None)}) if found else had)
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "__n", "__spans", "__items"],
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with ``__n`` words, ``__spans`` (merged hit word intervals,
    flattened, end exclusive) and ``__items`` (ids of items with an occurring window, sorted as text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keep = list(keep)
    carried = list(dict.fromkeys([*keep, "text"]))
    bench = benchmark.select("item_id", "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    empty = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    out = docs.select(*carried, empty[0].alias("__spans"), empty[1].alias("__items"))
    typed = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    for k in range(chunks):
        part = bench if chunks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k)
        index = spark.sparkContext.broadcast(Index(((r[0], r[1]) for r in part.collect()), window))
        own = keep if k == chunks - 1 else carried
        schema = ", ".join([*(f"`{c}` {typed[c]}" for c in own), "__n bigint, __spans array<bigint>, __items array<string>"])
        if k:
            out = scratch.write(out.drop("__n"), "decontaminate")
        out = out.mapInArrow(_pass(index, own), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with their own columns."""
    found = find_contamination(docs, benchmark, window, keep=tuple(dict.fromkeys([*docs.columns, "text"])))
    return found.filter(F.size("__spans") == 0).select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(__spans, 0L, (s, x) -> s + x) - 2 * aggregate(filter(__spans, (x, i) -> i % 2 = 0), 0L, (s, x) -> s + x)")
    return found.select(
        "doc_id",
        F.col("__n").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
    )
