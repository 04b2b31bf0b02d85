"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

N-grams are of words, of word shapes (letters, digits and signs, each run once) and of the pattern of repeated
words. Indicators fall into a fixed number of hashed features. The hinge loss is minimised by dual coordinate
descent, and a logistic curve fitted on rows kept back turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.sampling import per_class, remainder
from aspectra.llm.words import Chunk, chunks, mix

#: Hashed features.
BITS = 18
#: Labelled documents of each class, at most, to fit on.
SAMPLE = 3000
#: Probability from which label 1 is predicted.
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("9")
_CLASS[0x41:0x5B] = ord("X")
_CLASS[0x61:0x7B] = ord("x")
_CLASS[0x80:] = ord("x")


def _shapes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: ``Hello,`` and ``Ab,`` are both ``Xx,``."""
    kinds = _CLASS[chunk.data]
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    small = Chunk(chunk.rows, kinds[keep], chunk.bounds)
    return small.hashes(place[starts], place[ends])


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every indicator that is set, sorted, each once."""
    starts, ends, row = chunk.words()
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word, shape = chunk.hashes(starts, ends, lower=True), _shapes(chunk, starts, ends)
    same = np.zeros(len(word), dtype=np.uint64)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    grams = []
    for kind, (values, most) in enumerate(((word, 2), (shape, 3), (same, 4))):
        gram = np.full(len(values), kind + 1, dtype=np.uint64)
        for n in range(1, most + 1):
            m = len(values) - n + 1
            if m < 1:
                break
            gram = mix(gram[:m] * np.uint64(0x9E3779B97F4A7C15) + values[n - 1 :])
            inside = row[:m] == row[n - 1 :]
            if kind < 2 or n == most:
                grams.append((row[:m][inside] << BITS) | (gram[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    keys = np.unique(np.concatenate(grams))
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class QualityModel:
    """Weight of each indicator (ratio included), a bias, and the logistic curve of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        size = np.bincount(row, minlength=n)
        margin = np.bincount(row, weights=self.weights[feature], minlength=n) / np.sqrt(np.maximum(size, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def log_count_ratios(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of class 1's indicators over that of class 0, per feature."""
    share = []
    for label in (1, 0):
        count = np.ones(1 << BITS)
        for d, y in zip(docs, labels):
            if y == label:
                count[d] += 1
        share.append(count / count.sum())
    return np.log(share[0] / share[1])


def dual_coordinate_descent(docs: list[np.ndarray], values: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 0):
    """Weights and bias of the hinge loss; a document's row is ``values`` of its features by the root of their number.

    Rows of the rarer class cost as much in all as those of the other.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    n = len(docs)
    most = cost * np.where(labels == 1, n / (2 * max((labels == 1).sum(), 1)), n / (2 * max((labels == 0).sum(), 1)))
    rows = [values[d] / np.sqrt(max(len(d), 1)) for d in docs]
    norm = np.array([r @ r + 1.0 for r in rows])
    alpha, w, bias = np.zeros(n), np.zeros(len(values)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            gradient = y[i] * (w[docs[i]] @ rows[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[docs[i]] += step * rows[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve of weighed rows, by damped Newton steps on smoothed targets."""
    weight = weight / weight.mean()
    up, down = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        miss = weight * (p - target)
        g = np.array([(miss * margin).sum(), miss.sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * margin * margin).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        size = np.abs(move).max()
        move *= min(1.0, 1.0 / size) if size else 0.0
        slope, shift = slope - move[0], shift - move[1]
        if size < 1e-6:
            break
    return max(float(slope), 1e-3), float(shift)


def fit(docs: list[np.ndarray], labels: np.ndarray, stands: tuple[float, float] = (1.0, 1.0)) -> QualityModel:
    """A model from the features of labelled documents; every fifth row is kept back for the logistic curve.

    ``stands`` has the number of labelled documents that a row of class 0 and of class 1 stands for.
    """
    if not len(docs) or labels.min() == labels.max():
        share = float(labels.mean()) if len(docs) else 0.5
        share = min(max(share, 0.01), 0.99)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    back = np.arange(len(docs)) % 5 == 4
    if len(set(labels[back])) < 2 or len(set(labels[~back])) < 2:
        back[:] = False
    used = [d for d, b in zip(docs, back) if not b]
    ratio = log_count_ratios(used, labels[~back])
    w, bias = dual_coordinate_descent(used, ratio, labels[~back])
    model = QualityModel(w * ratio, bias, 1.0, 0.0)
    kept = [(d, y) for d, y, b in zip(docs, labels, back) if b or not back.any()]
    margin = np.array([model.weights[d].sum() / np.sqrt(max(len(d), 1)) + bias for d, _ in kept])
    kept_labels = np.array([y for _, y in kept])
    model.slope, model.shift = _logistic(margin, kept_labels, np.asarray(stands, dtype=np.float64)[kept_labels])
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            m = len(chunk.bounds) - 1
            row, feature = features(chunk)
            cut = np.searchsorted(row, np.arange(1, m))
            packed = [f.astype(np.int32).tobytes() for f in np.split(feature, cut)]
            part = batch.slice(chunk.rows.start, m)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "features"])


def _predict(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                m = len(chunk.bounds) - 1
                score = model.score(*features(chunk), m)
                ids = batch.column("doc_id").slice(chunk.rows.start, m)
                yield pa.RecordBatch.from_arrays([ids, pa.array(score)], ["doc_id", "score"])

    return run, "doc_id long, score double"


def score_quality(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> DataFrame:
    """Quality of each whole text: doc_id, held_out, score (probability of label 1), predicted (score >= THRESHOLD).

    ``docs`` has doc_id (long) and text, ``labels`` doc_id and quality (0 or 1); other columns are ignored. The model
    is fitted on a bounded sample (SAMPLE documents a class) of labels whose crc32(doc_id) modulo ``divisor`` is not
    ``held``; its logistic curve weighs the classes by their numbers of all such labels. Labels that are null, neither 0 nor 1, or of unknown doc_ids are ignored; a doc_id with several labels
    counts with the greatest. A null or empty text has no indicators and gets the score of the bias; without two
    classes to learn from, every score is the share of label 1 (one half without any). A null doc_id is not held
    out. One row per row of ``docs``.
    """
    rest = remainder("doc_id", divisor)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", divisor) != held))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("quality"))
    total = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    stands = tuple(max(total.get(label, 0) / SAMPLE, 1.0) for label in (0, 1))
    # At most 2 * SAMPLE rows.
    sample = per_class(usable, "quality", SAMPLE)
    rows = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", "text").mapInArrow(_extract, "doc_id long, quality long, features binary").collect()
    rows.sort(key=lambda r: (hash(r.doc_id * 2654435761 % (1 << 32)), r.features))
    model = fit([np.frombuffer(r.features, dtype=np.int32) for r in rows], np.array([r.quality for r in rows], dtype=np.int64), stands)
    run, schema = _predict(model)
    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
