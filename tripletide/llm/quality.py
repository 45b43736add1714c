"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration.

The statistics of a whole text (lengths, character classes, repetition, line shapes) are
standardised and mapped by random Fourier features, whose inner products approximate a
Gaussian kernel. Every partition sums its part of the normal equations, the sums meet in one
aggregation by cell, and the driver solves a system of FEATURES + 1 unknowns. Raw scores of
labelled documents that were not fitted on (every FOLD-th by hash) are calibrated by pooled
adjacent violators over score bins. What the driver holds does not grow with the input.

Learning uses every labelled row it may; there is no sample. Labels, language, source and
ids are no inputs of a score.

Cases: a null text counts as empty, and empty texts get a score like any other. Documents
with a null id are scored but never learned from. Null labels are ignored; repeated label rows
of a document count each time. Without any label, or with labels of one kind only, every score
is that kind's share (0.5 without labels). Repeated rows are each returned; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletide.llm.tables import runs, saved

FEATURES = 192
WIDTH = 4.0  # of the kernel, in standard deviations
RIDGE = 1e-3
BINS = 400
ORDER = 0.01  # share of the score that only orders documents of one calibrated level
FOLD = 5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOP | _SPACE)

NAMES = (
    "log_words", "log_word_length", "spread_of_word_lengths", "distinct_words", "distinct_pairs", "commonest_word",
    "commonest_pair", "same_as_before", "upper", "lower", "digit", "high", "stop", "mark", "commonest_mark",
    "mark_words", "upper_words", "log_line_words", "repeated_lines", "ended_lines", "entropy",
)


def statistics(text: str) -> list[float]:
    """The numbers named in NAMES, each finite and of moderate size."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = float(len(raw))
    common = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    spread = math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean))
    lines = [x for x in text.split("\n") if x]
    marks = counts * _MARK
    seen = counts[counts > 0] / size
    return [
        math.log1p(n), math.log1p(mean), spread / (mean + 1), len(common) / n ** 0.9,
        len(pairs) / max(1, n - 1), max(common.values()) / n, max(pairs.values(), default=0) / max(1, n - 1),
        sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        float(counts[_UPPER].sum()) / size, float(counts[_LOWER].sum()) / size, float(counts[_DIGIT].sum()) / size,
        float(counts[_HIGH].sum()) / size, float(counts[_STOP].sum()) / size, float(marks.sum()) / size,
        float(marks.max()) / size, sum(not w.isalnum() and not w.strip(".,;:!?'\"()").isalpha() for w in common) / len(common),
        sum(w.isupper() for w in common) / len(common), math.log1p(n / len(lines)) if lines else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(x[-1] in ".!?:" for x in lines) / len(lines) if lines else 0.0, float(-(seen * np.log(seen)).sum()),
    ]


def remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, "text"):
            rows = [statistics(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"]
            )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray  # raw scores at which the calibrated score changes
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        drawn = np.random.default_rng(7)
        omega = drawn.normal(size=(len(NAMES), FEATURES)) / WIDTH
        phase = drawn.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ omega + phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.weights is None else self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.values[0])
        raw = self.raw(stats)
        level = np.interp(raw, self.edges, self.values)  # constant on long stretches
        return (1 - ORDER) * level + ORDER / (1 + np.exp(np.clip(8 * (0.5 - raw), -50, 50)))


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` (pooled adjacent violators)."""
    groups: list[list[float]] = []
    for v, w in zip(values, weights):
        groups.append([v, w, 1])
        while len(groups) > 1 and groups[-2][0] >= groups[-1][0]:
            v2, w2, n2 = groups.pop()
            v1, w1, n1 = groups.pop()
            groups.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in groups]) if groups else np.zeros(0)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(NAMES))


def _normal(model: Model):
    size = FEATURES + 1
    rows, cols = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = model.features(_stats_of(batch)), batch.column("y").to_numpy().astype(float)
            left += z.T @ z
            right += z.T @ y
        values = np.concatenate([left[rows, cols], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "value"])

    return work


def _binned(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.clip(np.round(model.raw(_stats_of(batch)) * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], ["bin", "y"])

    return work


def fit(stats: DataFrame) -> Model:
    """``stats``: rows (stats, y 0 or 1, fold), y being what is learned."""
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(len(NAMES))]
    squares = [F.sum(F.col("stats")[i] * F.col("stats")[i]).alias(f"q{i}") for i in range(len(NAMES))]
    got = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *sums, *squares).head()
    n, ones = got["n"], got["ones"] or 0
    zero = np.zeros(len(NAMES))
    if n == 0 or ones in (0, n):
        return Model(zero, zero + 1, None, zero[:1], np.array([0.5 if n == 0 else ones / n]))
    mean = np.array([got[f"s{i}"] for i in range(len(NAMES))]) / n
    spread = np.sqrt(np.maximum(0, np.array([got[f"q{i}"] for i in range(len(NAMES))]) / n - mean**2))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), None, zero[:1], zero[:1])
    fitted = stats.filter("fold != 0") if stats.filter("fold != 0").select("y").distinct().count() == 2 else stats
    cells = fitted.mapInArrow(_normal(model), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    size = FEATURES + 1
    rows, cols = np.triu_indices(size)
    values = np.zeros(len(rows) + size)
    for r in cells.collect():  # one number for each cell of the system
        values[r["cell"]] = r["value"]
    system = np.zeros((size, size))
    system[rows, cols] = system[cols, rows] = values[: len(rows)]
    ridge = RIDGE * n * np.eye(size) / FEATURES
    ridge[-1, -1] = 0
    weights = np.linalg.lstsq(system + ridge, values[len(rows) :], rcond=None)[0]
    model = Model(model.mean, model.scale, weights, zero[:1], zero[:1])
    held = stats.filter("fold = 0")
    bins = held.mapInArrow(_binned(model), "bin long, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    bins = bins.orderBy("bin").collect()  # at most 3 * BINS + 1 rows
    if not bins or sum(b["ones"] for b in bins) in (0, sum(b["n"] for b in bins)):
        return Model(model.mean, model.scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    values = pooled(np.array([b["ones"] / b["n"] for b in bins]), np.array([b["n"] for b in bins], float))
    return Model(model.mean, model.scale, weights, np.array([b["bin"] / BINS for b in bins]), values)


def _scored(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats_of(batch)))], ["doc_id", "score"])

    return work


def learned(docs: DataFrame, labels: DataFrame, held_out: Column, known: DataFrame | None = None) -> Model:
    """A model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text), without held-out documents."""
    if known is None:
        wanted = labels.filter("quality is not null").select("doc_id").distinct()
        known, _ = saved(docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(_measured, "doc_id long, stats array<double>"), "statistics")
    rows = labels.filter("quality is not null").select("doc_id", F.when(F.col("quality") >= 1, 1).otherwise(0).alias("y"))
    rows = known.filter(F.col("doc_id").isNotNull() & ~held_out).join(rows, "doc_id")
    rows, _ = saved(rows.select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLD)).alias("fold")), "labelled")
    return fit(rows)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out of learning.
    """
    held_out = remainder("doc_id", 3) == 1
    known, _ = saved(docs.select("doc_id", "text").mapInArrow(_measured, "doc_id long, stats array<double>"), "statistics")
    model = learned(docs, labels, held_out, known)
    scored = known.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, learned as in ``quality_scores``."""
    model = learned(docs, labels, remainder("doc_id", 3) == 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                stats = np.array([statistics(t or "") for t in part.column("text").to_pylist()]).reshape(-1, len(NAMES))
                yield part.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(work, docs.schema)
