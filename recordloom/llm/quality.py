"""Quality selection by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share the weights ``w`` of
hashed text features, the thresholds are ordered. From them come a document's
expected grade and its probability of reaching a grade, on which it is selected.

Features are hashed tokens of the whole text: the first four bytes of each word
(presence, scaled by inverse document frequency in the sample) and five shape
tokens, the bands of its word count and of its shares of distinct words, upper
case, punctuation and digits. A bucket counts from ``MIN_DOCS`` sampled documents
on.

The model is fitted on the driver from at most ``sample_rows`` rated documents,
chosen by a hash of doc_id; one of over ``SAMPLE_BUCKETS`` buckets is left out. The
driver holds their feature numbers, not their texts. Scoring covers every row.

Defined cases: a null text is empty and has shape tokens only; rated ids without a
document, null grades and null ids don't count; of rows with a rated doc_id the one whose
text has the least hash counts; without two different grades there
is no model, every document gets the grade found (or null) and is kept; repeated
rows get equal scores; further columns pass through ``select`` untouched, but that the names
``__rl_expected`` and ``__rl_tail`` are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces, texts
from recordloom.llm.shingles import mix, word_spans

SAMPLE_ROWS, SAMPLE_BUCKETS = 16_000, 4096
BUCKETS, PREFIX, MIN_DOCS = 1 << 20, 4, 8
SHAPES, SHAPE_WEIGHT, IDF_SCALE = 100, 3.0, 2.0
PENALTY, STEPS = 3e-5, 200
BATCH_BYTES, BATCH_ROWS = 2 << 20, 5000

_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B] = 1
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_CLASS[0x30:0x3A] = 3


def features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each text's distinct prefix buckets, and its five shape tokens (n x 5)."""
    n = len(values)
    buf, starts, ends, first = word_spans(values)
    counts = np.diff(first)
    row = np.repeat(np.arange(n), counts)
    long_enough = ends - starts >= PREFIX
    at, row = starts[long_enough], row[long_enough]
    packed = np.zeros(len(at), np.uint64)
    for k in range(PREFIX):
        packed |= buf[at + k].astype(np.uint64) << np.uint64(8 * k)
    bucket = (mix(packed + np.uint64(1)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    key = np.unique(row * BUCKETS + bucket)
    row, bucket = key // BUCKETS, key % BUCKETS
    size = np.maximum(1, np.array([len(t) for t in values]))
    raw = np.frombuffer(b"".join(values), np.uint8)
    owner = np.repeat(np.arange(n), [len(t) for t in values])
    kinds = np.bincount(owner * 4 + _CLASS[raw], minlength=4 * n).reshape(n, 4) / size[:, None]
    distinct = np.bincount(row, minlength=n) / np.maximum(1, counts)
    band = lambda x, most: np.minimum(most, x).astype(np.int64)
    shape = [band(1.5 * np.log2(counts + 1), 19), 20 + band(10 * distinct, 9), 40 + band(20 * kinds[:, 1], 9), 60 + band(50 * kinds[:, 2], 19), 80 + band(50 * kinds[:, 3], 9)]
    return row, bucket, np.stack(shape, axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """Shared weights with ordered thresholds; ``grades`` are the grades in ascending order."""

    grades: list[int]
    thresholds: np.ndarray
    column: np.ndarray  # of each bucket: its weight's number, or -1
    weight: np.ndarray  # of the buckets, idf included
    shape_weight: np.ndarray

    def at_most(self, values: list[bytes]) -> np.ndarray:
        """P(grade <= k) for each text and all grades but the last."""
        row, bucket, shape = features(values)
        column = self.column[bucket]
        known = column >= 0
        score = np.bincount(row[known], self.weight[column[known]], minlength=len(values)) + self.shape_weight[shape].sum(axis=1)
        return _sigmoid(self.thresholds[None, :] - score[:, None])


def _minimize(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            used.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(used)):
            d = d + s * (a - (y @ d) / (s @ y))
        t, slope = (1.0 if past else min(1.0, 1 / max(1e-12, np.abs(g).sum()))), g @ d
        for _ in range(25):
            new = x + t * d
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        done = value - new_value < 1e-8
        x, value, g = new, new_value, new_g
        if done:
            break
    return x


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Model:
    """The model of texts given by (buckets, shape tokens) and their grades."""
    levels, y = np.unique(grades, return_inverse=True)
    n, k = len(rows), len(levels)
    row = np.repeat(np.arange(n), [len(b) for b, _ in rows])
    bucket = np.concatenate([b for b, _ in rows]).astype(np.int64)
    shape = np.stack([s for _, s in rows]).astype(np.int64)
    df = np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero((df >= MIN_DOCS) & (df < n))
    column = np.full(BUCKETS, -1, np.int32)
    column[used] = np.arange(len(used))
    idf = np.log(n / df[used]) / IDF_SCALE
    known = column[bucket] >= 0
    row, col = row[known], column[bucket[known]]
    m = len(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, v, a = x[:m], x[m : m + SHAPES], x[m + SHAPES :]
        steps = np.exp(np.clip(a[1:], -20, 20))
        edges = np.concatenate([[-np.inf], a[0] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        s = np.bincount(row, (idf * w)[col], minlength=n) + SHAPE_WEIGHT * v[shape].sum(axis=1)
        up, low = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
        up, low = np.where(y == k - 1, 1.0, up), np.where(y == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        by_score = (d_low - d_up) / n
        g = np.zeros_like(x)
        g[:m] = -np.bincount(col, by_score[row], minlength=m) * idf
        g[m : m + SHAPES] = -SHAPE_WEIGHT * np.bincount(shape.ravel(), np.repeat(by_score, shape.shape[1]), minlength=SHAPES)
        by_edge = (np.bincount(y, d_up, minlength=k)[:-1] - np.bincount(y, d_low, minlength=k)[1:]) / n
        above = np.cumsum(by_edge[::-1])[::-1]
        g[m + SHAPES :] = -above * np.concatenate([[1.0], steps])
        own = x[: m + SHAPES]
        g[: m + SHAPES] += 2 * PENALTY * own
        return float(-np.log(p).mean() + PENALTY * (own @ own)), g

    start = np.zeros(m + SHAPES + k - 1)
    start[m + SHAPES] = -1.0
    x = _minimize(loss, start, STEPS)
    a = x[m + SHAPES :]
    thresholds = a[0] + np.concatenate([[0], np.cumsum(np.exp(np.clip(a[1:], -20, 20)))])
    return Model([int(g) for g in levels], thresholds, column, x[:m] * idf, SHAPE_WEIGHT * x[m : m + SHAPES])


def fit(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | list[int]:
    """The model for ``ratings`` (doc_id, grade) of ``docs``; the list of grades where there are fewer than two."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).dropna()
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample_rows)
    met = texts(docs).join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    wanted = met.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES, BATCH_ROWS):
            values = batch.column("text").cast(pa.binary()).to_pylist()
            row, bucket, shape = features(values)
            cut = np.split(bucket.astype("<u4"), np.searchsorted(row, np.arange(1, len(values))))
            made = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([x.tobytes() for x in cut], pa.binary()), pa.array([x.astype(np.uint8).tobytes() for x in shape], pa.binary())],
                ["doc_id", "grade", "buckets", "shape"],
            )
            yield made.filter(pa.array([len(x) <= SAMPLE_BUCKETS for x in cut]))

    sample = wanted.mapInArrow(run, "doc_id long, grade int, buckets binary, shape binary").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("shape", "ascending")])
    grades = np.array(sample.column("grade").to_pylist(), np.int64)
    if len(set(grades.tolist())) < 2:
        return sorted(set(grades.tolist()))
    rows = [(np.frombuffer(b, "<u4"), np.frombuffer(s, np.uint8)) for b, s in zip(sample.column("buckets").to_pylist(), sample.column("shape").to_pylist())]
    return fit_rows(rows, grades)


def score(docs: DataFrame, model: Model | list[int], grade: int) -> DataFrame:
    """``docs`` with ``__rl_expected`` and ``__rl_tail`` = P(grade >= ``grade``) added; all columns stay."""
    if isinstance(model, list):
        only = F.lit(float(model[0])) if model else F.lit(None).cast("double")
        return docs.withColumns({"__rl_expected": only, "__rl_tail": F.lit(1.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias("__rl_expected"), F.lit(0.0).alias("__rl_tail")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        levels = np.array(own.grades, float)
        for batch in pieces(batches, "text", BATCH_BYTES, BATCH_ROWS):
            below = own.at_most([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            edges = np.concatenate([np.zeros((len(below), 1)), below, np.ones((len(below), 1))], axis=1)
            of_each = np.diff(edges, axis=1)
            columns = [pa.array(np.round(of_each @ levels, 6)), pa.array(np.round(of_each[:, levels >= grade].sum(axis=1), 6))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, ("__rl_expected", pa.float64()), ("__rl_tail", pa.float64())]))

    return docs.mapInArrow(run, schema)


def graded_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): one point for good quality, one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


#: A document is kept from this probability of the best grade on.
GRADE, KEEP_FROM = 2, 0.3


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, p_best, keep) for each document."""
    rows = texts(docs)
    scored = score(rows, fit(docs, graded_labels(labels)), GRADE)
    return scored.select("doc_id", F.col("__rl_expected").alias("expected_grade"), F.col("__rl_tail").alias("p_best"), (F.col("__rl_tail") >= KEEP_FROM).alias("keep"))


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of ``docs`` that are kept; all columns stay."""
    names = docs.columns
    scored = score(docs, fit(docs, graded_labels(labels)), GRADE)
    return scored.where(F.col("__rl_tail") >= KEEP_FROM).select(*names)
