"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Labels belong to documents, scores to sentences. A sentence's chance is a logistic function of its
words and word beginnings; a document's chance is the noisy-or of its sentences, and the gradient
of the document's likelihood reaches the sentence weights through it. Fitting uses at most about
``max_rows`` labelled rows (a documented bound, thinned by hash). Scoring reads every whole text
and also says which sentences offend, as code point intervals.

Defined cases: null and empty texts have no sentence and get the score of the model's empty text;
repeated rows are scored each for itself; null labels or null doc_ids teach nothing; without labels
of both classes every score is the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Scratch, crc_mod, table
from folioforge.llm.quality_classifier import labelled_sample

MAX_ROWS = 20_000
MAX_FEATURES = 8192
STEMS = (5, 7)
_WORD = re.compile(r"\w+")
#: Ends of sentences.
_CUT = re.compile(r"[.!?\n]+")


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"^{word[:n]}" for n in STEMS if len(word) > n))


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """Code point intervals of the pieces with a word, in order."""
    text, start = text or "", 0
    for m in (*_CUT.finditer(text), None):
        end = m.start() if m else len(text)
        if _WORD.search(text, start, end):
            yield start, end
        start = m.end() if m else end


def instances(text: str | None) -> list[list[str]]:
    """Features of each sentence's distinct words; a beginning counts once for each word that has it."""
    low = (text or "").lower()
    return [[f for w in set(_WORD.findall(low[a:b])) for f in features_of(w)] for a, b in sentences(low)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    floor: float  # the chance of a document without sentences

    def __post_init__(self):
        self.by_word: dict[str, float] = {}

    def word(self, w: str) -> tuple[tuple[str, float], ...]:
        """Weighted features of a word; words without any are kept as empty."""
        if (got := self.by_word.get(w)) is None:
            if len(self.by_word) > 500_000:
                self.by_word.clear()
            got = self.by_word[w] = tuple((f, self.weights[f]) for f in features_of(w) if f in self.weights)
        return got

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's chance and its sentences with a chance of a half or more."""
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # a few letters change length when lowered; intervals are those of the text
            low = "".join(c.lower()[:1] or c for c in text)
        none = np.log1p(-1 / (1 + np.exp(-self.bias)))
        rest, marked, n = 0.0, [], 0
        for a, b in sentences(low):
            n += 1
            seen = [v for w in set(_WORD.findall(low, a, b)) for _, v in self.word(w)]
            if not seen:
                rest += none
                continue
            z = self.bias + sum(seen)
            p = min(1 / (1 + np.exp(-max(z, -500.0))), 1 - 1e-12)
            rest += np.log1p(-p)
            if p >= 0.5:
                marked.append((a, b, float(p)))
        return (float(-np.expm1(rest)) if n else self.floor), marked


def fit(y: np.ndarray, names: list[str], bags: list[tuple[int, list[int], list[int]]], steps: int = 300, rate: float = 0.1, l2: float = 2e-4) -> Model:
    """bags: for each document its number of sentences, and sentence and feature numbers that go together."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        p = n1 / max(1.0, n1 + n0)
        return Model({}, -30.0 if p < 1 else 30.0, p)
    sizes = np.array([n for n, _, _ in bags])
    starts = np.concatenate(([0], sizes.cumsum()))
    s = int(starts[-1])
    doc_of = np.repeat(np.arange(len(y)), sizes)
    sent = np.concatenate([np.array(x, int) + a for (_, x, _), a in zip(bags, starts, strict=False)])
    feat = np.concatenate([np.array(f, int) for _, _, f in bags])
    w, bias = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    has = sizes > 0
    for step in range(1, steps + 1):
        z = bias + np.bincount(sent, w[feat], s)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        doc = np.clip(-np.expm1(np.bincount(doc_of, np.log1p(-p), len(y))), 1e-9, 1 - 1e-9)
        # d(-log L)/dz: p where the label is 0, else -p (1 - P) / P
        push = np.where(y == 1, -(1 - doc) / doc, 1.0)[doc_of] * p / max(1, has.sum())
        g = np.append(np.bincount(feat, push[sent], len(names)) + l2 * w / max(1, len(names)) ** 0.5, push.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    empty = y[~has]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias), float(empty.sum() / (len(empty) + 10)))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of either label a feature occurs."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, names=["f", "c0", "c1"])

    for b in batches:
        for t, y in zip(b.column("text"), b.column("y"), strict=True):
            counts[y.as_py() == 1].update({f for inst in instances(t.as_py()) for f in inst})
            if len(counts[0]) > 200_000:
                yield out()
    yield out()


def train(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_ROWS) -> Model:
    """Counts and bags are made on the executors; the driver gets at most MAX_FEATURES names and, for each
    sampled row, the numbers of the features that its sentences have among them."""
    rows = Scratch(docs.sparkSession).write(labelled_sample(docs, labels, "toxic", learn, max_rows).repartition(16), "labelled")
    n1, n0 = rows.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") != 1, 1))).first()
    p, q = (F.col("c1") + 0.1) / (n1 + 0.2), (F.col("c0") + 0.1) / (n0 + 0.2)
    m = (F.col("c1") + F.col("c0") + 0.2) / (n1 + n0 + 0.4)
    z = (p - q) / F.sqrt(m * (1 - m) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    counts = rows.mapInArrow(_document_counts, "f string, c0 bigint, c1 bigint").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    best = counts.filter(F.col("c0") + F.col("c1") >= 3).filter((F.col("c0") + F.col("c1") < n0 + n1) & (z > 4)).select("f", z.alias("z"))
    names = [r.f for r in best.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).collect()]
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for b in batches:
            own = [instances(t.as_py()) for t in b.column("text")]
            pairs = [sorted((k, ids[f]) for k, inst in enumerate(bag) for f in inst if f in ids) for bag in own]
            cols = [pa.array(map(len, own), pa.int32()), pa.array([[k for k, _ in x] for x in pairs], pa.list_(pa.int32())), pa.array([[f for _, f in x] for x in pairs], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("y"), *cols], names=["y", "n", "s", "f"])

    got = rows.mapInArrow(bags, "y int, n int, s array<int>, f array<int>").collect()
    got.sort(key=lambda r: (r.y, r.n, r.s, r.f))  # the fit doesn't depend on the order of tasks
    return fit(np.array([int(r.y == 1) for r in got]), names, [(r.n, r.s, r.f) for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offending): the noisy-or and the offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(t.as_py()) for t in b.column("text")]
            marked = [[{"start": a, "end": e, "score": p} for a, e, p in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.float64()), pa.array(marked, kind)], names=["doc_id", "score", "offending"])

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double, offending array<struct<start:bigint,end:bigint,score:double>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), lambda c: crc_mod(c, 3) != 1)
    return score(docs, model).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("offending"),
    )
