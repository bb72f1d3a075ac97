"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are decided jointly per shard. Pieces go in order of falling length into the open bin with
the least room that suffices. Where none does, a bin is opened, of the permitted length that costs least:
each length that holds the piece is tried against the pieces still to come, the largest that fit first,
and the one whose cost per token it would then hold is least is opened. A bin costs its final length plus
``OPEN_COST``. Finally every bin shrinks to the least permitted length that holds its contents. Packings
that open one length throughout are kept as candidates to beat, so mixing never costs more.

Only (doc_id, length) rows move: they are dealt by hash into shards of about ``SHARD`` pieces, as many
shards as the corpus needs, so each shard fits a task and wastes at most a few bins. Equal rows are counted
and numbered, so bins hang on the rows alone and not on the files they lie in. A document longer
than the longest length is cut into pieces of that length and a rest; nothing is dropped.

A length is the number of words ``[^\\x20\\x09-\\x0D]+`` and one end token.

Defined cases: null and empty texts have length 1, their end; repeated rows are packed each for
itself; rows of one doc_id share no shard by force; ties in length go by doc_id and piece; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, table

LENGTHS, SHARD, OPEN_COST = (512, 1024, 2048, 4096), 20_000, 16


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


class _Left:
    """Sizes still to come: how many of each, and a number whose bits say which there are."""

    def __init__(self, sizes: Sequence[int]):
        self.count = Counter(sizes)
        self.bits = sum(1 << s for s in self.count)

    def drop(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def fill(self, size: int, room: int) -> int:
        """Tokens of a bin of ``size`` that takes the largest pieces that fit while there is room."""
        full, bits = size, self.bits
        while full < room and (fitting := bits & ((1 << (room - full + 1)) - 1)):
            most = fitting.bit_length() - 1
            full += most * max(1, min(self.count[most], (room - full) // most))
            bits &= (1 << most) - 1
        return full


def opened(size: int, left: _Left, lengths: Sequence[int], open_cost: int) -> int:
    """The permitted length that costs least per token for a bin that begins with ``size``; ties the smaller."""
    best = None
    for room in lengths:
        if room >= size:
            full = left.fill(size, room)
            rate = (min(c for c in lengths if c >= full) + open_cost) / full
            if best is None or rate < best[0]:
                best = rate, room
    return best[1]


def best_fit(sizes: Sequence[int], opening: int | None, lengths: Sequence[int], open_cost: int = OPEN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (given in falling order), and each bin's fill. Bins are opened at length
    ``opening`` or the least longer one that holds the piece; at the least cost if that is None."""
    left = _Left(sizes) if opening is None else None
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has exactly r left
    bins, offsets, fill, capacity = [], [], [], []
    for size in sizes:
        if left:
            left.drop(size)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = free[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            b = len(fill)
            fill.append(0)
            room = opened(size, left, lengths, open_cost) if left else min(c for c in lengths if c >= max(size, opening))
            capacity.append(room)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += size
        rest = room - size
        if rest:
            free.setdefault(rest, []).append(b)
            rooms |= 1 << rest
    return bins, offsets, fill


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, open_cost: int = OPEN_COST) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each size (in falling order), each bin's fill and final length."""
    best = None
    for opening in (None, *lengths):
        bins, offsets, fill = best_fit(sizes, opening, lengths, open_cost)
        final = [min(c for c in lengths if c >= f) for f in fill]
        cost = sum(final) + open_cost * len(final)
        if best is None or cost < best[0]:
            best = cost, (bins, offsets, fill, final)
    return best[1]


def pieces_of(docs: DataFrame, length: Column, longest: int) -> DataFrame:
    """(doc_id, copy, piece, start, n_tokens): documents, the long ones cut; ``copy`` numbers equal rows."""
    df = docs.select("doc_id", length.alias("n")).groupBy("doc_id", "n").count()
    df = df.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    df = df.select("doc_id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("n", F.lit(1)) - 1) / longest).cast("long"))).alias("piece"))
    return df.select("doc_id", "copy", "piece", (F.col("piece") * longest).alias("start"), F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame, length: Column | None = None, lengths: Sequence[int] = LENGTHS, shard: int = SHARD, open_cost: int = OPEN_COST) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_length, bin_tokens, bin_offset)."""
    lengths = sorted(lengths)
    pieces = pieces_of(docs, word_count(F.col("text")) + 1 if length is None else length, lengths[-1])
    # Words take two bytes at least with what ends them, so this bounds the number of pieces without reading words.
    most = F.octet_length(F.coalesce("text", F.lit(""))) / 2 if length is None else length
    shards = max(1, -(-int(docs.agg(F.sum(1 + F.floor(most / lengths[-1]))).first()[0] or 0) // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy"), F.lit(shards)))

    def run(rows):  # an Arrow table: null and large ids stay what they are
        rows = rows.take(pc.sort_indices(rows, [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")]))
        bins, offsets, fill, final = pack(rows.column("n_tokens").to_pylist(), lengths, open_cost)
        at = np.array(bins, np.int64)
        more = (rows.column("shard").to_numpy() << 32) + at, np.array(final, np.int64)[at], np.array(fill, np.int64)[at], np.array(offsets, np.int64)
        out = rows.drop_columns(["shard", "copy"])
        for name, values in zip(("bin_id", "bin_length", "bin_tokens", "bin_offset"), more, strict=True):
            out = out.append_column(name, pa.array(values))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_length bigint, bin_tokens bigint, bin_offset bigint"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
