"""Language-model scoring with a hierarchical Pitman-Yor model.

Two levels of restaurants. A context is a restaurant whose customers are the words that follow it: each
of the ``COMMON`` most frequent words has one of its own, so has the start of a text, and rarer words
share ``SHARED`` restaurants by hash. All contexts share one parent, the restaurant of single words, to
which every table of a context sends one customer. The parent's own base is uniform over the whole
vocabulary and one unseen word. Every (context, word) cell of the training documents is kept, whatever
its word, so the tables grow with the corpus; only numbers by context and by common word, arrays of
bounded size, are broadcast.

Seating is Gibbs sampling by cells: a cell's customers get up and sit down again given all others, so its
number of tables is drawn from its full conditional, generalised Stirling numbers times the chance of that
many new tables. Beyond ``EXACT`` customers a cell's further ones sit down by the Chinese restaurant
process in rounds of an eighth of their number. A cell of one customer has one table. Cells of one sweep
are drawn side by side, given contexts and parent as the sweep before left them, and the parent's
restaurant is then seated anew. Draws hash (sweep, cell), so results hang on the data alone and not on
how they are dealt out. Predictive probabilities are averaged over the sweeps after burn-in by way of
tables and parent's probabilities. The contexts' discount follows from the counts of cells seen once and twice.

What moves are not rows but blobs: each task sorts the pairs of some two million tokens, deals them to
buckets by hash and sends a bucket's part as one compressed row. Pairs with a common word go by the hash
of the pair, others by the word, so a bucket holds all cells of its rarer words, and no key can fill one.
A bucket's size is set by ``BUCKET``, their number grows with the corpus. Documents are scored likewise:
their pairs meet the cells by bucket, and each bucket sends sums by document back to the documents' chunk.

Defined cases: null text counts as empty: its only token is the end; a null doc_id's row trains and
is not held out; repeated rows train as often as they occur and are scored each for itself; other
columns are ignored; an empty table gives an empty result, and with no training rows N and c are 0.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Scratch, byte_words, crc_mod, table

COMMON, SHARED = 1 << 18, 1 << 16
DISCOUNT, STRENGTH = 0.75, 10.0
SWEEPS, BURN_IN, EXACT = 5, 2, 32
#: The end of a text, a token that no word equals: words hold no white space.
END = b"\n"
FLUSH, TOKENS, BUCKET = 400_000, 2_000_000, 2_000_000
_WORD_BITS, _ROW_BITS = np.uint64(20), np.uint64(24)
_RARE = 1 << 63
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def word_hash(w: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(w)
    return h - (1 << 64) if h >> 63 else h


class Hashes(dict):
    """Words to hashes, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[w] = word_hash(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _chance(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) that hang on the key and the salt alone."""
    for s in salt:
        key = _mix(key * _GOLD + np.uint64(s + 1))
    return ((key >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


# Blobs: some arrays by byte planes, compressed.


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _gaps(a: np.ndarray) -> np.ndarray:
    """A sorted array by its differences."""
    return _narrow(np.diff(a, prepend=np.zeros(1, a.dtype)))


def pack(*arrays: np.ndarray) -> bytes:
    codec, out = pa.Codec("zstd", compression_level=1), []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        body = codec.compress(planes, asbytes=True)
        out += [struct.pack("<4sQQ", a.dtype.str.encode(), len(a), len(body)), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(blob):
        kind, n, size = struct.unpack_from("<4sQQ", blob, at)
        at += 20
        kind = np.dtype(kind.rstrip(b"\0").decode())
        planes = np.frombuffer(codec.decompress(blob[at : at + size], n * kind.itemsize, asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def _sorted(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


# Words and pairs.


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()

    for b in batches:
        for t in b.column("text"):
            counts.update(byte_words(t.as_py()))
            counts[END] += 1
            if len(counts) > FLUSH:
                yield from out()
    yield from out()


class Codes(dict):
    """Words to codes, remembered up to a bound: a common word's rank, else its hash with the top bit set."""

    def __init__(self, common: np.ndarray):
        super().__init__()
        self.ranks = {h: i for i, h in enumerate(common.tolist())}

    def __missing__(self, w: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = word_hash(w)
        c = self[w] = self.ranks[h] if h in self.ranks else h & (_RARE - 1) | _RARE
        return c

    def of(self, text: str | None) -> np.ndarray:
        """Codes of a text's tokens."""
        words = [*byte_words(text), END]
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _contexts(codes: np.ndarray, k: int) -> np.ndarray:
    """The restaurant of each token of a text: below k a common word's, k the start's, then shared ones."""
    before = codes[:-1]
    shared = np.uint64(k + 1) + (before & np.uint64(SHARED - 1))
    return np.concatenate((np.full(1, k, np.uint64), np.where(before >> np.uint64(63) == 1, shared, before)))


def _first(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted arrays."""
    new = np.ones(len(sorted_by[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.flatnonzero(new)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by bucket, in the order they are in."""
    order = np.argsort(_narrow(bucket), kind="stable")
    bucket = bucket[order]
    starts = _first(bucket)
    for a, z in zip(starts, np.append(starts, len(bucket))[1:], strict=True):
        yield int(bucket[a]), [c[order[a:z]] for c in columns]


def _summed_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _count_pairs(shared):
    """Blobs of the distinct pairs of about TOKENS tokens, by bucket: 2 b with a common word, else 2 b + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, parts = shared.value["k"], np.uint64(shared.value["parts"])
        codes, ws, us, size = Codes(shared.value["common"]), [], [], 0

        def out():
            w, u = np.concatenate(ws), np.concatenate(us)
            ws.clear()
            us.clear()
            own = w < k
            keys, counts = np.unique(u[own] << _WORD_BITS | w[own], return_counts=True)
            rows = [(2 * b, pack(_gaps(x), _narrow(c))) for b, (x, c) in _dealt(_mix(keys) % parts, keys, counts)]
            w, u = w[~own], u[~own]
            order = np.lexsort((u, w))
            w, u = w[order], u[order]
            first = _first(w, u)
            counts = np.diff(np.append(first, len(w)))
            w, u = w[first], u[first]
            rows += [(2 * b + 1, pack(_gaps(x), _narrow(y), _narrow(c))) for b, (x, y, c) in _dealt(w % parts, w, u, counts)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for t in b.column("text"):
                w = codes.of(t.as_py())
                ws.append(w)
                us.append(_contexts(w, k))
                size += len(w)
                if size > TOKENS:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def _merge(shared):
    """One bucket's cells, its first state and its numbers by context and common word."""

    def run(key, rows):
        m, bucket = shared.value, key[0].as_py()
        k, nc = m["k"], m["contexts"]
        blobs = [unpack(x.as_py()) for x in rows.column("blob")]
        c = np.concatenate([b[-1].astype(np.int64) for b in blobs])
        extra = np.zeros(8)
        if bucket % 2 == 0:
            keys = np.concatenate([_sorted(b[0]) for b in blobs])
            order = np.argsort(keys, kind="stable")
            keys, c = keys[order], c[order]
            first = _first(keys)
            keys, c = keys[first], _summed_runs(c, first)
            u, w = (keys >> _WORD_BITS).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
            cells = pack(_gaps(keys), _narrow(c))
            many = c > 1
            state = pack(_gaps(keys[many]), _narrow(c[many]), np.ones(many.sum(), np.uint8), np.zeros(many.sum(), np.uint8))
            words = [np.bincount(w, x, k) for x in (c, c == 1, np.ones(len(c)))]
        else:
            w, u = np.concatenate([_sorted(b[0]) for b in blobs]), np.concatenate([b[1].astype(np.int64) for b in blobs])
            order = np.lexsort((u, w))
            w, u, c = w[order], u[order], c[order]
            first = _first(w, u)
            w, u, c = w[first], u[first], _summed_runs(c, first)
            cells = pack(_gaps(w), _narrow(u), _narrow(c))
            own = _first(w)
            n_cells = np.diff(np.append(own, len(w)))
            singles = _summed_runs((c == 1).astype(np.int64), own)
            seated = (n_cells > 1) | (singles == 0)  # a word of a single cell of one customer has one table everywhere
            place = np.repeat(np.cumsum(seated) - 1, n_cells)
            many, n = c > 1, seated.sum()
            state = pack(_gaps(w[own][seated]), _narrow(singles[seated]), _narrow(n_cells[seated]), np.ones(n, np.uint8), np.zeros(n), _gaps(place[many].astype(np.uint64)), _narrow(u[many]), _narrow(c[many]), np.ones(many.sum(), np.uint8), np.zeros(many.sum(), np.uint8))
            words = [np.zeros(k)] * 3
            extra[2:5] = len(own), len(own) - n, len(w)
        extra[:2] = (c == 1).sum(), (c == 2).sum()
        stats = np.concatenate([*(np.bincount(u, x, nc) for x in (c, c == 1, np.ones(len(c)))), *words, extra]).astype(np.int64)
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "cells": pa.array([cells], pa.binary()), "state": pa.array([state], pa.binary()), "stats": pa.array([pack(_narrow(stats))], pa.binary())})

    return run


# Seating.


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: weights of seatings of n customers at k tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, most):
        for k in range(1, n + 2):
            stay = out[n, k] + math.log(n - d * k) if k <= n else -math.inf
            out[n + 1, k] = np.logaddexp(out[n, k - 1], stay)
    return out


def _binomial(n: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Binomial draws from two even numbers each: by inversion, by the normal curve for means from 12."""
    mean = n * p
    out = np.clip(np.rint(mean + np.sqrt(mean * (1 - p)) * np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)), 0, n)
    low = np.flatnonzero(mean < 12)
    m, q, x = n[low], p[low], a[low]
    pmf = np.exp(m * np.log1p(-np.minimum(q, 1 - 1e-12)))
    total, got = pmf.copy(), np.zeros(len(low))
    for j in range(60):
        above = (x > total) & (got < m)
        if not above.any():
            break
        got += above
        pmf = pmf * np.maximum(m - j, 0) / (j + 1) * q / np.maximum(1 - q, 1e-12)
        total = total + pmf
    out[low] = got
    return out


def draw(c: np.ndarray, parent: np.ndarray, tables: np.ndarray, key: np.ndarray, sweep: int, weights: np.ndarray, d: float = DISCOUNT, theta: float = STRENGTH) -> np.ndarray:
    """Tables of cells with c customers, given the dish's chance at the parent and the restaurant's other tables."""
    t, most = np.minimum(c, 1).astype(np.int64), len(weights) - 1
    open_ = theta + d * tables
    for n in range(2, most + 1):
        own = np.flatnonzero(c == n) if n < most else np.flatnonzero(c >= n)
        if len(own):
            x = np.log(np.maximum(parent[own], 1e-300))[:, None] + np.log(open_[own][:, None] + d * np.arange(n))
            x = np.cumsum(x, 1) + weights[n, 1 : n + 1]
            x = np.cumsum(np.exp(x - x.max(1, keepdims=True)), 1)
            t[own] = 1 + (x[:, :-1] < (_chance(key[own], sweep) * x[:, -1])[:, None]).sum(1)
    left, seated, turn = np.flatnonzero(c > most), most, 0
    while len(left):
        step = np.minimum(c[left] - seated, max(1, seated // 8))
        fresh = parent[left] * (open_[left] + d * t[left])
        p = fresh / (fresh + seated - d * t[left])
        t[left] += _binomial(step, p, _chance(key[left], sweep, turn, 0), _chance(key[left], sweep, turn, 1)).astype(np.int64)
        seated, turn = seated + max(1, seated // 8), turn + 1
        left = left[c[left] > seated]
    return t


def share(n, t, customers: float, tables: float, base: float, d: float, theta: float = STRENGTH):
    """A dish's predictive chance in a restaurant."""
    return (n - d * t + (theta + d * tables) * base) / (theta + customers)


def _sweep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, nc, d, sweep, keep = m["k"], m["contexts"], m["d"], m["sweep"], m["keep"]
        weights, own_weights = stirling(d), stirling(DISCOUNT)

        def seat(bucket: int, blob: bytes) -> tuple[bytes, bytes]:
            extra = np.zeros(2)
            if bucket % 2 == 0:
                gaps, c, t, tsum = unpack(blob)
                keys = _sorted(gaps)
                u, w = (keys >> _WORD_BITS).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
                t = draw(c.astype(np.int64), m["root"][w], m["tables"][u] - t, keys, sweep, weights, d)
                state = gaps, c, _narrow(t), _narrow(tsum.astype(np.int64) + keep * t)
                by_word = np.bincount(w, t, k)
            else:
                words, singles, n, tw, rsum, place, u, c, t, tsum = unpack(blob)
                at, w = _sorted(place).astype(np.int64), _sorted(words)
                r = share(n, tw, *m["totals"], m["base"], DISCOUNT)
                t = draw(c.astype(np.int64), r[at], m["tables"][u] - t, _mix(w[at]) + u.astype(np.uint64), sweep, weights, d)
                n = singles.astype(np.int64) + np.bincount(at, t, len(w)).astype(np.int64)
                tw = draw(n, np.full(len(n), m["base"]), np.full(len(n), m["totals"][1]) - tw, w, sweep, own_weights)
                state = words, singles, _narrow(n), _narrow(tw), rsum + r * m["kept_before"], place, u, c, _narrow(t), _narrow(tsum.astype(np.int64) + keep * t)
                by_word = np.zeros(k)
                extra[:] = n.sum(), tw.sum()
            stats = np.concatenate([np.bincount(u, t, nc), by_word, extra]).astype(np.int64)
            return pack(*state), pack(_narrow(stats))

        for b in batches:
            for bucket, blob in zip(b.column("bucket"), b.column("state"), strict=True):
                state, stats = seat(bucket.as_py(), blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int64()), pa.array([state], pa.binary()), pa.array([stats], pa.binary())], names=["bucket", "state", "stats"])

    return run


_SLICES = 8


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("stats"):
            own = unpack(x.as_py())[0].astype(np.int64)
            total = own if total is None else total + own
    if total is not None:
        parts = [pack(_narrow(x)) for x in np.array_split(total, _SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "stats"])


def _add_slice(key, rows):
    total = sum(unpack(x.as_py())[0].astype(np.int64) for x in rows.column("stats"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "stats": pa.array([pack(_narrow(total))], pa.binary())})


def _totals(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The buckets' numbers added up: arrays by context and by common word, of bounded size."""
    added = rows.select("stats").mapInArrow(_add_up, "slice int, stats binary").groupBy("slice").applyInArrow(_add_slice, "slice int, stats binary")
    got = [unpack(r.stats)[0].astype(np.int64) for r in sorted(added.collect(), key=lambda r: r.slice)]
    return np.split(np.concatenate(got) if got else np.zeros(sum(sizes), np.int64), np.cumsum(sizes)[:-1])


def _most_frequent(counts: DataFrame) -> np.ndarray:
    """Hashes of the words from some count upward, as many as fit into COMMON, most frequent first. The count is
    found from a histogram by eighths of powers of two, so nothing larger than COMMON rows comes to the driver."""
    eighth = F.floor(F.log2("c") * 8)
    least, total = None, 0
    for bucket, n in sorted(((r[0], r[1]) for r in counts.groupBy(eighth.alias("b")).count().collect()), reverse=True):
        total += n
        if total > COMMON:
            break
        least = bucket
    if least is None:
        return np.zeros(0, np.int64)
    got = counts.filter(eighth >= least).toArrow()
    word, c = got.column("word").to_numpy(), got.column("c").to_numpy()
    return word[np.lexsort((word, -c))]


def train(docs: DataFrame, scratch: Scratch) -> dict:
    """The model over ``docs`` (text): tables of cells and of their seating, by bucket, and arrays by context and
    common word."""
    spark = docs.sparkSession
    counts = scratch.write(docs.select("text").mapInArrow(_count_words, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n, v = counts.agg(F.sum("c"), F.count("c")).first()
    n, v = n or 0, v or 0
    common = _most_frequent(counts)
    scratch.drop(counts)
    k = len(common)
    nc, parts = k + 1 + SHARED, max(1, -(-n // BUCKET))
    sizes = {"k": k, "contexts": nc, "parts": parts, "common": common}
    shared = spark.sparkContext.broadcast(sizes)
    pairs = docs.select("text").mapInArrow(_count_pairs(shared), "bucket bigint, blob binary")
    cells = scratch.write(pairs.groupBy("bucket").applyInArrow(_merge(shared), "bucket bigint, cells binary, state binary, stats binary"), "cells")
    c_u, s_u, tables, c_w, s_w, customers, extra = _totals(cells, [nc, nc, nc, k, k, k, 8])
    once, twice, rare_words, hapaxes, rare_cells = (int(x) for x in extra[:5])
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else DISCOUNT

    # All cells begin with one table, and so do all words at the parent.
    base, all_t, all_c = 1 / (v + 1), float(v), float(customers.sum() + rare_cells)
    t_w, keys, weights = np.minimum(customers, 1), common.view(np.uint64), stirling(DISCOUNT)
    root = share(customers, t_w, all_c, all_t, base, DISCOUNT)
    root_sum, t_sum, single, unseen, kept, keep = np.zeros(k), np.zeros(nc), 0.0, 0.0, 0, 0
    state = cells.select("bucket", "state")
    for sweep in range(SWEEPS if n else 0):
        before, keep = keep, int(sweep >= BURN_IN)
        known = spark.sparkContext.broadcast({"k": k, "contexts": nc, "d": d, "sweep": sweep, "keep": keep, "kept_before": before, "root": root, "tables": tables, "totals": (all_c, all_t), "base": base})
        old, state = state, scratch.write(state.mapInArrow(_sweep(known), "bucket bigint, state binary, stats binary"), "state")
        if sweep:
            scratch.drop(old)
        t_u, more, rare = _totals(state, [nc, k, 2])
        state, kind = state.select("bucket", "state"), state
        state._scratch_path = kind._scratch_path
        tables, customers = s_u + t_u, s_w + more
        t_w = draw(customers, np.full(k, base), all_t - t_w, keys, sweep, weights)
        all_c, all_t = float(customers.sum() + rare[0] + hapaxes), float(t_w.sum() + rare[1] + hapaxes)
        root = share(customers, t_w, all_c, all_t, base, DISCOUNT)
        if keep:
            kept, root_sum, t_sum = kept + 1, root_sum + root, t_sum + tables
            single, unseen = single + share(1, 1, all_c, all_t, base, DISCOUNT), unseen + share(0, 0, all_c, all_t, base, DISCOUNT)
    some = max(kept, 1)
    return {
        **sizes, "n": n, "v": v, "d": d, "base": base, "totals": (all_c, all_t), "kept": some, "cells": cells.select("bucket", "cells"), "state": state,
        "root": root_sum / some if kept else root, "single": single / some if kept else base, "unseen": unseen / some if kept else base,
        "back": (STRENGTH + d * t_sum / some) / (STRENGTH + c_u), "seats": 1 / (STRENGTH + c_u), "c_w": c_w,
    }


# Scoring.


def _post(shared):
    """Pairs of some documents, a chunk, by bucket with the rows that hold them; and the chunk's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, parts = m["k"], np.uint64(m["parts"])
        codes, low = Codes(m["common"]), math.log10(m["n"] + 0.1 * (m["v"] + 1))
        base_of, seen = np.log10(m["c_w"] + 0.1) - low, (m["c_w"] > 0).astype(float)
        task, number = TaskContext.get().partitionId(), 0
        ws, us, ids, held, size = [], [], [], [], 0

        def out(kind: pa.DataType):
            nonlocal number
            chunk, number = task << 24 | number, number + 1
            lengths = np.array([len(w) for w in ws], np.int64)
            w, u, row = np.concatenate(ws), np.concatenate(us), np.repeat(np.arange(len(ws), dtype=np.uint64), lengths)
            own = w < k
            at, place = w[own].astype(np.int64), row[own].astype(np.int64)
            meta = pack(lengths, *(np.bincount(place, x[at], len(ws)).astype(float) for x in (seen, base_of)))
            rows = []
            key, times = np.unique((u[own] << _WORD_BITS | w[own]) << _ROW_BITS | row[own], return_counts=True)
            for b, (x, y) in _dealt(_mix(key >> _ROW_BITS) % parts, key, times):
                pair, who = x >> _ROW_BITS, x & np.uint64((1 << 24) - 1)
                first = _first(pair)
                rows.append((2 * b, pack(_gaps(pair[first]), _narrow(np.diff(np.append(first, len(pair)))), _narrow(who), _narrow(y))))
            w, key = w[~own], u[~own] << _ROW_BITS | row[~own]
            order = np.lexsort((key, w))
            w, key = w[order], key[order]
            first = _first(w, key)
            times = np.diff(np.append(first, len(w)))
            w, key = w[first], key[first]
            for b, (x, y, z) in _dealt(w % parts, w, key, times):
                rows.append((2 * b + 1, pack(_gaps(x), _narrow(y >> _ROW_BITS), _narrow(y & np.uint64((1 << 24) - 1)), _narrow(z))))
            rows.append((-1 - chunk, meta))
            none = [None] * (len(rows) - 1)
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
            cols += [pa.array([*none, [i for part in ids for i in part.to_pylist()]], pa.list_(kind)), pa.array([*none, [i for part in held for i in part.to_pylist()]], pa.list_(pa.bool_()))]
            for x in (ws, us, ids, held):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=["bucket", "kind", "chunk", "blob", "ids", "held"])

        kind = None
        for b in batches:
            kind, start = b.column("doc_id").type, 0
            for i, t in enumerate(b.column("text")):
                w = codes.of(t.as_py())
                ws.append(w)
                us.append(_contexts(w, k))
                size += len(w)
                if size > TOKENS or i == b.num_rows - 1:
                    ids.append(b.column("doc_id").slice(start, i + 1 - start))
                    held.append(b.column("held_out").slice(start, i + 1 - start))
                    start = i + 1
                    if size > TOKENS:
                        yield out(kind)
                        size = 0
        if size:
            yield out(kind)

    return run


def _met(shared, kind: pa.DataType):
    """A bucket's cells and the documents' pairs: sums by chunk and row."""

    def run(key, rows):
        m, bucket = shared.value, key[0].as_py()
        names = ["chunk", "blob", "ids", "held"]
        if bucket < 0:
            return rows.select(names)
        d, kept, low = m["d"], m["kept"], math.log10(m["n"] + 0.1 * (m["v"] + 1))
        kinds = rows.column("kind").to_pylist()
        blob = lambda i: unpack(rows.column("blob")[i].as_py())
        cells, state = (next((blob(i) for i, x in enumerate(kinds) if x == y), None) for y in (1, 2))
        num = np.zeros(0)
        if cells is not None:
            c, tsum = cells[-1].astype(np.int64), state[-1]
            num = np.where(c > 1, c, 1 - d)
            num[c > 1] -= d * tsum / kept
        if bucket % 2 == 0:
            keys = _sorted(cells[0]) if cells is not None else np.zeros(0, np.uint64)
        else:
            keys, words, r, c_of = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1), np.zeros(1)
            if cells is not None:
                w = _sorted(cells[0])
                own = _first(w)
                words, place = w[own], np.repeat(np.arange(len(own)), np.diff(np.append(own, len(w))))
                keys = place.astype(np.uint64) << _ROW_BITS | cells[1].astype(np.uint64)
                c_of = np.append(_summed_runs(c, own), 0)
                seated, _, n, tw, rsum, *_ = state
                r = np.append(np.full(len(words), m["single"]), m["unseen"])
                r[np.searchsorted(words, _sorted(seated))] = (rsum + share(n, tw, *m["totals"], m["base"], DISCOUNT)) / kept
            else:
                r = np.full(1, m["unseen"])
        out = []
        for i, x in enumerate(kinds):
            if x:
                continue
            if bucket % 2 == 0:
                gaps, posts, who, times = blob(i)
                pair = _sorted(gaps)
                u, w = (pair >> _WORD_BITS).astype(np.int64), (pair & np.uint64((1 << 20) - 1)).astype(np.int64)
                parent = m["root"][w]
            else:
                gaps, u, who, times = blob(i)
                w = _sorted(gaps)
                at = np.searchsorted(words, w)
                at = np.where((at < len(words)) & (np.append(words, 0)[at] == w), at, len(words))
                pair, parent, u = at.astype(np.uint64) << _ROW_BITS | u.astype(np.uint64), r[at], u.astype(np.int64)
            here = np.searchsorted(keys, pair)
            there = (here < len(keys)) & (np.append(keys, np.uint64(0))[here] == pair)
            p = m["back"][u] * parent + np.where(there, np.append(num, 0)[here], 0) * m["seats"][u]
            score, times = np.log10(p), times.astype(float)
            if bucket % 2 == 0:
                score = np.repeat(score, posts)
            who, place = np.unique(who, return_inverse=True)
            sums = [np.bincount(place, score * times)]
            if bucket % 2:
                sums += [np.bincount(place, (c_of[at] > 0) * times), np.bincount(place, (np.log10(c_of[at] + 0.1) - low) * times)]
            out.append((rows.column("chunk")[i].as_py(), pack(_narrow(who), *sums)))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.nulls(len(out), pa.list_(kind)), pa.nulls(len(out), pa.list_(pa.bool_()))], names=names)

    return run


def _finish(rows):
    """A chunk's documents with the buckets' sums."""
    own = next(i for i, x in enumerate(rows.column("ids")) if x.is_valid)
    lengths, known, base = unpack(rows.column("blob")[own].as_py())
    score = np.zeros(len(lengths))
    for i, blob in enumerate(rows.column("blob")):
        if i != own:
            who, part, *more = unpack(blob.as_py())
            score[who] += part
            if more:
                known[who] += more[0]
                base[who] += more[1]
    ids, held = (rows.column(c).combine_chunks()[own].values for c in ("ids", "held"))
    cols = [ids, held, pa.array(lengths, pa.int64()), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)]
    return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: dict, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) for rows of doc_id, text, held_out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({x: y for x, y in model.items() if x not in ("cells", "state")})
    field = docs.schema["doc_id"].dataType
    name, kind = field.simpleString(), pa.schema(docs.select("doc_id").limit(0).toArrow().schema).field(0).type
    columns = f"blob binary, ids array<{name}>, held array<boolean>"
    none = F.lit(0).cast("bigint").alias("chunk"), F.lit(None).cast(f"array<{name}>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held")
    rows = docs.select("doc_id", "text", "held_out").mapInArrow(_post(shared), f"bucket bigint, kind int, chunk bigint, {columns}")
    for number, x in ((1, "cells"), (2, "state")):
        rows = rows.union(model[x].select("bucket", F.lit(number).alias("kind"), none[0], F.col(x).alias("blob"), *none[1:]))
    sums = rows.groupBy("bucket").applyInArrow(_met(shared, kind), f"chunk bigint, {columns}")
    return sums.groupBy("chunk").applyInArrow(_finish, f"doc_id {name}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds each document's perplexity by token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")), scratch)
    return perplexity(score(docs, model, scratch)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )
