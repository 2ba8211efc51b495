"""Toxicity: expected severity by cumulative-link ordinal regression.

Grades 0..K come from the labels (by default 0 for clean, 1 for toxic, 2 for toxic of low
quality).  The model is P(grade <= k) = sigmoid(threshold_k - w.x) with ordered thresholds
and one weight vector for all of them.  The result is the expected grade; documents from
REJECT on are toxic.

Features are sparse: the square roots of the shares that a lower-cased word, or a word
beginning of PREFIXES letters, has among a document's words.  The MAX_FEATURES features that
differ most between toxic and clean samples (by Welch's t) get a weight; others have none, so
that unseen words never add up and a long document is not toxic for its length.

Training: SAMPLE_DOCS labelled documents of smallest hash are a documented bound.  Scoring reads
every document and its whole text; the model is at most MAX_FEATURES weights.

Defined results: null or empty text has no words and the severity of the thresholds alone;
null labels and labels of no document are ignored, the highest grade wins among several of a
document; without any labelled document of both kinds, nothing is toxic (severity 0);
repeated rows are scored each; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.llm.common import chunks, cut, map_batches, table, unwrap, whole_row

SAMPLE_DOCS = 8_000
MIN_DOCS = 5
MAX_FEATURES = 1_000
REJECT = 0.4
STEPS = 120
RIDGE = 1e-5

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
MAX_STRINGS = 600_000
LONG_STRING = 100


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def shares(text: str) -> dict[str, float]:
    """Feature -> value of a text."""
    words = WORD.findall(text.lower())
    counts = Counter(f for w in words for f in features_of(w))
    return {f: math.sqrt(n / len(words)) for f, n in counts.items()}


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, score: float) -> float:
        """Expected grade: the sum over k of P(grade > k)."""
        return float(sum(1 / (1 + np.exp(np.clip(t - score, -60, 60))) for t in self.thresholds))


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent of f (value, gradient) from x."""
    value, gradient = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, scale = gradient.copy(), []
        for s, y in reversed(past):
            scale.append((s @ d) / (s @ y))
            d -= scale[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(d))
        for (s, y), a in zip(past, reversed(scale), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        t, slope = 1.0, gradient @ d
        while True:
            to = x - t * d
            new_value, new_gradient = f(to)
            if new_value <= value - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = to - x, new_gradient - gradient
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(value - new_value) < 1e-8
        x, value, gradient = to, new_value, new_gradient
        if done:
            break
    return x


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int,
        steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised negative log-likelihood; (rows, cols, values)
    is the sparse feature matrix."""
    n, top = len(grades), int(grades.max())
    share = np.clip([np.mean(grades <= k) for k in range(top)], 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    split = lambda p: (p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1:]))]))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, thresholds = split(p)
        score = np.bincount(rows, w[cols] * values, n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper = np.where(grades == top, 1.0, sigmoid(edges[grades + 1] - score))
        lower = np.where(grades == 0, 0.0, sigmoid(edges[grades] - score))
        likely = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = (up - down) / n
        by_threshold = np.array([(down * (grades == k + 1) - up * (grades == k)).sum() / n for k in range(top)])
        by_gap = np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(p[features + 1:])
        by_weight = np.bincount(cols, by_score[rows] * values, features) + ridge * w
        return (-np.log(likely).mean() + ridge / 2 * (w @ w),
                np.concatenate([by_weight, [by_threshold.sum()], by_gap]))

    # weights, the first threshold, logarithms of the gaps between the thresholds
    start = np.concatenate([np.zeros(features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    return split(minimise(loss, start, steps))


def default_grade() -> Column:
    """0 clean, 1 toxic, 2 toxic and of low quality."""
    toxic = F.col("toxic") == 1
    return F.when(F.col("toxic").isNull(), F.lit(None)).when(toxic & (F.col("quality") == 0), 2).when(toxic, 1).otherwise(0)


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", sample_docs: int = SAMPLE_DOCS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """`labels` has `id_col` and what `grade` needs."""
    marks = (labels.select(F.col(f"`{id_col}`").alias("__id"), (default_grade() if grade is None else grade).alias("__grade"))
             .filter("__id IS NOT NULL AND __grade IS NOT NULL").groupBy("__id").agg(F.max("__grade").alias("__grade"))
             .orderBy(F.xxhash64("__id"), "__id").limit(sample_docs))        # <= sample_docs rows
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    # equal texts with different grades count once, with the highest
    sample = cut(slim.join(F.broadcast(marks), "__id").groupBy("__text").agg(F.max("__grade").alias("__grade"))
                 .orderBy(F.xxhash64("__text"), "__text").limit(sample_docs).select("__grade", "__text"))
    ship_by_value(__name__)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[tuple[str, bool], list[float]] = {}
            for grade, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f, x in shares(text or "").items():
                    t = totals.setdefault((f, grade > 0), [0, 0.0, 0.0])
                    t[0], t[1], t[2] = t[0] + 1, t[1] + x, t[2] + x * x
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in totals], pa.string()), pa.array([k for _, k in totals], pa.bool_()),
                 *(pa.array([float(t[i]) for t in totals.values()], pa.float64()) for i in range(3))],
                ["feature", "toxic", "n", "s", "q"])

    size = {r["__toxic"]: r["count"] for r in sample.groupBy((F.col("__grade") > 0).alias("__toxic")).count().collect()}
    if len(size) < 2:
        return OrdinalModel({}, [])
    part = lambda c, k: F.sum(F.when(F.col("toxic") == k, F.col(c)).otherwise(0.0))
    stats = (map_batches(sample, sums, "feature string, toxic boolean, n double, s double, q double").groupBy("feature")
             .agg(F.sum("n").alias("n"), part("s", True).alias("s1"), part("q", True).alias("q1"),
                  part("s", False).alias("s0"), part("q", False).alias("q0")).filter(F.col("n") >= MIN_DOCS))
    mean1, mean0 = F.col("s1") / size[True], F.col("s0") / size[False]
    spread = (F.col("q1") / size[True] - mean1 * mean1) / size[True] + (F.col("q0") / size[False] - mean0 * mean0) / size[False]
    welch = F.round(F.abs(mean1 - mean0) / F.sqrt(F.abs(spread) + 1e-12), 6)
    names = [r.feature for r in stats.orderBy(welch.desc(), "feature").limit(max_features).collect()]
    number = {f: i for i, f in enumerate(names)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{number[f]: x for f, x in shares(t or "").items() if f in number}
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([list(x) for x in found], pa.list_(pa.int32())),
                 pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))], ["grade", "cols", "vals"])

    rows = map_batches(sample, numbers, "grade int, cols array<int>, vals array<double>").toArrow()
    lists, values = rows["cols"].combine_chunks(), rows["vals"].combine_chunks()
    grades = rows["grade"].to_numpy().astype(np.int64)
    weights, thresholds = fit(np.repeat(np.arange(len(grades)), np.diff(lists.offsets.to_numpy())),
                              lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), grades, len(names))
    return OrdinalModel(dict(zip(names, map(float, weights), strict=True)), [float(t) for t in thresholds])


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """__row (the input row) and severity, the expected grade."""
    wrapped = docs.select(whole_row(docs).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    ship_by_value(__name__)
    ships = wrapped.select("__row").schema.add("severity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        # of a string between white space: its words, and its features that have a weight
        words: dict[str, int] = {}
        weighted: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column(1).to_pylist()]
            out = []
            for a, b in chunks(texts):
                if len(words) > MAX_STRINGS:
                    words, weighted = {}, {}
                split = [t.split() for t in texts[a:b]]
                new = set().union(*split) - words.keys()
                for s in new:
                    found = WORD.findall(s)
                    words[s] = len(found)
                    weighted[s] = tuple(f for w in found for f in features_of(w) if f in weights)
                for strings in split:
                    n = sum(map(words.__getitem__, strings))
                    counts = Counter(f for fs in map(weighted.__getitem__, strings) if fs for f in fs)
                    out.append(model.severity(sum(weights[f] * math.sqrt(k / n) for f, k in sorted(counts.items()))))
                for s in new:
                    if len(s) > LONG_STRING:
                        del words[s], weighted[s]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["__row", "severity"])

    return wrapped.mapInArrow(run, ships)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents below `reject`, unchanged."""
    return unwrap(score(docs, train(docs, labels)).filter(F.col("severity") < reject))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, toxic of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("__row.doc_id").alias("doc_id"), "severity", (F.col("severity") >= REJECT).alias("toxic"))
