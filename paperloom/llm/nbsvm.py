"""Document quality by naive Bayes support vectors.

Features are indicators of n-grams: word unigrams and bigrams, hashed into WORDS slots, and 1- to 4-grams of word shapes
(case, marks, digits, ending, repeats of an earlier word), hashed into SHAPES slots. Each indicator is scaled by its class log-count
ratio, each document by the root of its number of indicators, and a linear hinge-loss model is fitted by dual coordinate
descent. The score is a logistic function of the margin, fitted on the same rows.

Fitting uses about PER_CLASS labelled rows of each class, twice as many at most (those with the lowest hashes of doc_id), so its cost doesn't
grow. Scoring reads every text once; the model is two fixed-size weight tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import sampled, ship
from .text import LOWER, U64, column, crc, hash_spans, mix, pair, slices, spans

WORDS, SHAPES = 1 << 17, 1 << 12
PER_CLASS = 3000
EPOCHS, COST, SMOOTH = 12, 1.0, 0.5
_KIND = np.zeros(256, np.uint8)  # letter classes as bits: upper, lower or beyond ASCII, digit, mark
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 4, 1, 2, 2
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 8


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of each text, all in a row, and each text's first (length n + 1)."""
    data, at = column(col)
    starts, ends, first = spans(data, at)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    h = hash_spans(data, starts, ends)
    inner = doc[1:] == doc[:-1]
    kinds = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.uint64) if len(data) else h
    tail, head = _KIND[data[ends - 1]].astype(np.uint64), _KIND[data[starts]].astype(np.uint64)
    again = np.zeros(len(h), np.uint64)
    again[1:] = inner & (h[1:] == h[:-1])
    single = (ends - starts == 1).astype(np.uint64)
    # a word's own byte decides what a lone mark or a last mark is
    mark = np.where(tail == 8, data[ends - 1], 0).astype(np.uint64)
    shape = mix((kinds | tail << U64(4) | head << U64(8) | single << U64(12) | again << U64(13)) + (mark << U64(16)) + U64(1))
    where, slots = [doc, doc[1:][inner]], [(h >> U64(40)).astype(np.int64) % WORDS, ((pair(h[:-1], h[1:]) >> U64(40)).astype(np.int64) % WORDS)[inner]]
    g, ok = shape, np.ones(len(h), bool)
    for k in range(1, 5):
        if k > 1:
            g = pair(g[:-1], shape[k - 1 :])
            ok = doc[: len(g)] == doc[k - 1 :]
        if len(g):
            where.append(doc[: len(g)][ok])
            slots.append(WORDS + ((g >> U64(40)).astype(np.int64) % SHAPES)[ok])
    both = (np.concatenate(where) << 18) | np.concatenate(slots)
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both & ((1 << 18) - 1)).astype(np.int32), np.searchsorted(both >> 18, np.arange(n + 1))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for |w|^2 / 2 + bias^2 / 2 + sum of cost times hinge loss. Gives w, bias, the dual variables."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights by slot (count ratio times hinge weight), bias, and the logistic's slope and shift. One class or no rows:
    a constant model of that class (0.5 without rows)."""
    size = WORDS + SHAPES
    if not len(rows) or len(set(labels.tolist())) < 2:
        shift = 0.0 if not len(rows) else (3.0 if labels[0] > 0 else -3.0)
        return np.zeros(size), 0.0, 1.0, shift
    y = np.where(labels > 0, 1.0, -1.0)
    p, q = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for r, s in zip(rows, y):
        (p if s > 0 else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, bias, _ = descend(rows, values, y, cost, size, EPOCHS)
    margins = np.array([w[r] @ v + bias for r, v in zip(rows, values)])
    # one-dimensional logistic regression, weakly held to margin 1 = 0.9 so that separable data stay calibrated
    a, b = 2.2, 0.0
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        t = np.where(y > 0, 0.98, 0.02)
        s = z * (1 - z) + 1e-9
        ga, gb = ((z - t) * margins).mean() + 1e-3 * (a - 2.2), (z - t).mean() + 1e-3 * b
        haa, hab, hbb = (s * margins**2).mean() + 1e-3, (s * margins).mean(), s.mean() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(a - da, 1e-3), b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return w * ratio, float(bias), float(a), float(b)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            ids, first = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([ids[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["doc_id", "label", "slots"])


def scores(col: pa.Array, weights: np.ndarray, bias: float, a: float, shift: float) -> np.ndarray:
    """The score of each text of a column."""
    ids, first = features(col)
    total = np.concatenate([[0.0], np.cumsum(weights[ids])])
    margin = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(1, np.diff(first))) + bias
    return np.round(1 / (1 + np.exp(-np.clip(a * margin + shift, -30, 30))), 9)


def _score(model):
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                score = scores(b.column(1), *model.value)
                held = crc(b.column(0).to_pylist()) % 3 == 1
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names)

    return run


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS):
    """The model, from labelled rows whose crc32(doc_id) mod 3 is not 1: about per_class of each label."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    picked = [sampled(known.filter(F.col("label") == k), "doc_id", per_class, counts.get(k, 0)) for k in (0, 1)]
    sample = picked[0].union(picked[1])
    rows = _columns(docs).join(F.broadcast(sample), "doc_id").mapInArrow(_slots_of, "doc_id long, label int, slots binary").collect()  # at most 4 * per_class rows
    rows = sorted({(r.doc_id, r.label, bytes(r.slots)) for r in rows})
    return fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows]))


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _slots(b.select(["doc_id", "text", "label"]) for b in batches)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Labels come from labels (doc_id, quality; a doc_id with both labels counts as 1) by rows that are not held out: those
    with crc32(doc_id as text) mod 3 other than 1. A null text is empty; an empty text gets the model's bias. Without any label
    every score is 0.5; with labels of one class only, all are that class. Rows without doc_id are scored and not held out;
    repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))
    return _columns(docs).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns. See quality_scores."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for b in slices(whole, "text"):
                yield b.filter(pa.array(scores(b.column(at), *model.value) >= threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
