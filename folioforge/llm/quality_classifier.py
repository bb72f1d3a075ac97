"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Training takes at most about ``max_rows`` labelled rows (a documented bound: labelled rows are
thinned by a hash of doc_id and text to that expectation), bins each statistic into at most 64
quantile bins and grows depth-limited trees on histograms of gradients. The fitted trees are
flattened into level arrays (feature, bin, leaf value), which scoring walks for a whole Arrow
batch at a time in numpy. Every whole text of the input is scored; nothing is shuffled for it.

Defined cases: null text counts as empty; empty and very long texts are scored like all others;
repeated rows are scored each for itself; labels that are null, or whose doc_id is null, teach
nothing; a doc_id with differing labels teaches each of them; without labels of both classes every
score is the share of label 1 (0.5 without labels); other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import crc_mod, table

MAX_ROWS = 20_000
FEATURES = (
    "log_words", "log_chars", "mean_word", "word_spread", "long_words", "one_char_words", "distinct_words", "top_word",
    "pairs_again", "dup_lines", "log_lines", "line_words", "upper", "digit", "punct", "symbol", "exclaim", "pipe", "stop_end",
    "comma", "non_ascii", "title_words", "space", "squeeze",
)
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SYMBOL = b"#*$%&<>{}[]=~^_@\\"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws, size = raw.split(), len(raw)
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    left = lambda drop: size - len(raw.translate(None, drop))
    lengths = np.fromiter(map(len, ws), np.float64, n)
    counts = Counter(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(ws, ws[1:], strict=False)))
    spaces = max(1, left(b" \t\n\x0b\x0c\r"))
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths == 1).mean(),
        len(counts) / n, max(counts.values()) / n, 1 - pairs / max(1, n - 1), 1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)), n / len(lines), left(_UPPER) / size, left(_DIGIT) / size, left(_PUNCT) / size, left(_SYMBOL) / n,
        raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b".") / n, raw.count(b",") / n, 1 - len(raw.decode("utf-8", "replace")) / size,
        sum(map(bytes.istitle, counts)) / len(counts), spaces / size, len(zlib.compress(raw, 1)) / size,
    ]


@dataclass
class Boosted:
    """Trees in flat arrays: node k of a tree has the children 2k+1 and 2k+2; leaves hold log odds."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, 0), int)
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, f[node]] > c[node])
            total += leaf[node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, max_bins: int = 64, l2: float = 1.0, least: int = 5) -> Boosted:
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        return Boosted([np.zeros(0)] * width, np.zeros((0, 1), int), np.zeros((0, 1), int), np.zeros((0, 2)), float(np.log(p / (1 - p))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
    flat = bins + np.arange(width) * max_bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, c = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, max_bins, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * max_bins) + flat).ravel()
            shape = (many, width, max_bins)
            sums = [np.bincount(key, np.repeat(v, width), many * width * max_bins).reshape(shape).cumsum(2) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = sums
            gt, ht, nt = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            f[first : first + many] = np.where(good, best // max_bins, 0)
            c[first : first + many] = np.where(good, best % max_bins, max_bins)
            node = 2 * node + 1 + (bins[np.arange(len(y)), f[node]] > c[node])
        at = node - (1 << depth) + 1
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + l2)
        total += leaf[at]
        features.append(f), cuts.append(c), leaves.append(leaf)
    return Boosted(edges, np.array(features), np.array(cuts), np.array(leaves), base, depth)


def _matrix(column) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in column], np.float64).reshape(-1, len(FEATURES))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int) -> DataFrame:
    """(text, y) of rows that may teach, thinned by hash to about ``max_rows``."""
    marks = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id")))
    n = marks.count()
    if n > max_rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    return docs.select("doc_id", "text").join(marks, "doc_id").select("text", F.col("y").cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_ROWS) -> Boosted:
    """``learn``: from a doc_id column to a condition that says which rows may teach."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = labelled_sample(docs, labels, "quality", learn, max_rows).mapInArrow(features, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # the fit doesn't depend on the order of tasks
    return fit(np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], np.float64))


def score(docs: DataFrame, model: Boosted, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(name)
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(_matrix(b.column("text"))), pa.float64())], names=[*names, name])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    model = train(docs, labels, lambda c: crc_mod(c, 4) != 2)
    return score(docs, model, "__score").filter(F.col("__score") >= least).select(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), lambda c: crc_mod(c, 4) != 2)
    scored = score(docs, model).drop("text")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
