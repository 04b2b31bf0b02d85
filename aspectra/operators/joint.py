"""All heads fitted together: one softmax head per aspect, one distributed gradient for all of them.

A pass over the stored rows gives the gradient of the summed losses of every head. Each task adds up its own
rows and hands on one block of sums per range of features; blocks of one range are then merged in the shuffle, many
ranges side by side, so that no task and not the driver ever adds up the tasks' results. The driver holds the
model (features x heads x classes numbers) and moves it one step per pass, so a fit can be carried on for as many
epochs as wanted, stored, and taken up again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from aspectra.functions.labels import checked_class
from aspectra.functions.text import tokenize
from aspectra.schema import ASPECTS, CLASSES
from aspectra.session import stored

#: Numbers in one block of sums.
BLOCK = 1 << 13
#: Rows that are multiplied at once.
ROWS = 1024


@dataclass(frozen=True)
class WordFeatures:
    """Hashed words, weighted by their rarity; a text without a known word has no features."""

    size: int
    rarity: np.ndarray

    def inputs(self, text: str) -> list[Column]:
        return [hashed_words(F.col(text), self.size).alias("ids")]

    def rows(self, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, feature, value) of every feature that is not zero, and the number of rows."""
        ids = columns[0]
        n = len(ids)
        lengths = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
        row = np.repeat(np.arange(n), lengths)
        word = ids.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        cells, counts = np.unique(row * self.size + word, return_counts=True)
        row, word = np.divmod(cells, self.size)
        value = counts * self.rarity[word]
        norm = np.sqrt(np.bincount(row, value * value, n))
        return row, word, value / np.where(norm > 0, norm, 1)[row], n


@dataclass(frozen=True)
class VectorFeatures:
    """The components of a vector column, and a constant one."""

    size: int

    def inputs(self, vec: str) -> list[Column]:
        return [F.col(vec).cast("array<double>").alias("vec")]

    def rows(self, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        vecs = columns[0]
        n, width = len(vecs), self.size
        there = np.flatnonzero(np.asarray(vecs.is_valid()))
        flat = vecs.drop_null().flatten().to_numpy(zero_copy_only=False)
        if len(flat) != len(there) * width:
            raise ValueError(f"every vector must have {width} components")
        return np.repeat(there, width), np.tile(np.arange(width), len(there)), flat, n


def hashed_words(text: Column, size: int) -> Column:
    """Each word of a text as a number below ``size``."""
    return F.transform(tokenize(text), lambda w: F.pmod(F.hash(w), F.lit(size)))


def word_features(train: DataFrame, text: str = "text", size: int = 4096) -> WordFeatures:
    """Rarity of each hashed word: ln((rows + 1) / (rows with it + 1)). ``size`` numbers reach the driver."""
    ids = train.select(F.array_distinct(hashed_words(F.col(text), size)).alias("ids"))
    n = ids.count()
    rarity = np.full(size, np.log(n + 1.0))
    for row in ids.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        rarity[row["id"]] = np.log((n + 1.0) / (row["count"] + 1.0))
    return WordFeatures(size, rarity)


@dataclass
class JointHeads:
    """Weights (features x aspects x classes) and biases of a fit, and what it needs to be carried on."""

    features: WordFeatures | VectorFeatures
    aspects: tuple[str, ...] = tuple(ASPECTS)
    classes: int = CLASSES
    weights: np.ndarray = None
    bias: np.ndarray = None
    speed: tuple[np.ndarray, np.ndarray] = None
    epoch: int = 0
    losses: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        width = len(self.aspects) * self.classes
        if self.weights is None:
            self.weights, self.bias = np.zeros((self.features.size, width)), np.zeros(width)
            self.speed = np.zeros_like(self.weights), np.zeros_like(self.bias)

    def copy(self) -> JointHeads:
        return replace(self, weights=self.weights.copy(), bias=self.bias.copy(), speed=tuple(s.copy() for s in self.speed), losses=list(self.losses))


def labelled_rows(df: DataFrame, heads: JointHeads, source: str = "text") -> DataFrame:
    """The stored rows of a fit: the inputs of its features and the classes of all aspects, null where not rated.

    A score outside the classes ends the job. Rows without any score are left out.
    """
    scores = F.array(*[checked_class(F.col(a).cast("int"), heads.classes) for a in heads.aspects])
    rows = df.select(*heads.features.inputs(source), scores.alias("labels"))
    return stored(rows.where(F.exists("labels", lambda s: s.isNotNull())), "labelled")


def _spread_rows(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the ``values`` of each row; ``row`` is in ascending order."""
    out = np.zeros((n, values.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _logits(features, columns: list[pa.Array], weights: np.ndarray, bias: np.ndarray):
    row, word, value, n = features.rows(columns)
    return _spread_rows(row, weights[word] * value[:, None], n) + bias, (row, word, value)


def _gradient_blocks(features, weights: np.ndarray, bias: np.ndarray, heads: int, classes: int):
    """A function over Arrow batches that adds up gradients, losses and counts, and hands them on in blocks."""
    width = heads * classes
    # Sums in one line: weights, bias, loss and rows of each head.
    extra = width + 2 * heads
    schema = pa.schema([("block", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros_like(weights), np.zeros(extra)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                z, (row, word, value) = _logits(features, columns, weights, bias)
                labels = batch.column(batch.num_columns - 1).flatten()
                label = labels.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, heads)
                rated = label >= 0
                z = z.reshape(-1, heads, classes)
                z = z - z.max(axis=2, keepdims=True)
                p = np.exp(z)
                mass = p.sum(axis=2, keepdims=True)
                own = np.maximum(label, 0)[:, :, None]
                loss = np.log(mass[:, :, 0]) - np.take_along_axis(z, own, 2)[:, :, 0]
                p /= mass
                np.put_along_axis(p, own, np.take_along_axis(p, own, 2) - 1, 2)
                error = (p * rated[:, :, None]).reshape(-1, width)
                order = np.argsort(word, kind="stable")
                first = np.flatnonzero(np.diff(word[order], prepend=-1))
                if len(first):
                    total[word[order][first]] += np.add.reduceat(error[row[order]] * value[order][:, None], first, axis=0)
                rest += np.concatenate([error.sum(axis=0), (loss * rated).sum(axis=0), rated.sum(axis=0)])
        flat = np.concatenate([rest, total.ravel()])
        for block, start in enumerate(range(0, len(flat), BLOCK)):
            part = flat[start : start + BLOCK]
            # A block without a sum needs no place in the shuffle, except the first, which counts rows.
            if block == 0 or part.any():
                sums = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), sums], schema=schema)

    return run


def gradient(rows: DataFrame, heads: JointHeads) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the weights and biases, summed loss and number of rated rows per head, from one pass."""
    n, k = len(heads.aspects), heads.classes
    run = _gradient_blocks(heads.features, heads.weights, heads.bias, n, k)
    blocks = rows.mapInArrow(run, "block int, sums array<double>")
    # The merge is an aggregate by block; only the merged blocks, as many numbers as the model has, are collected.
    merged = blocks.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    flat = np.zeros(n * k + 2 * n + heads.weights.size)
    for row in merged.collect():
        flat[row["block"] * BLOCK : row["block"] * BLOCK + len(row["sums"])] = row["sums"]
    bias, loss, rated, weights = np.split(flat, np.cumsum([n * k, n, n]))
    return weights.reshape(heads.weights.shape), bias, loss, rated


def mean_loss(rows: DataFrame, heads: JointHeads) -> dict[str, float]:
    """Mean cross-entropy of every head over stored rows; not a number for a head without a rated row."""
    _, _, loss, rated = gradient(rows, heads)
    return dict(zip(heads.aspects, np.divide(loss, rated, out=np.full(len(loss), np.nan), where=rated > 0)))


def carry_on(
    rows: DataFrame,
    heads: JointHeads,
    epochs: int,
    rate: float = 2.0,
    momentum: float = 0.9,
    decay: float = 0.0,
    after: Callable[[JointHeads], None] | None = None,
) -> JointHeads:
    """The fit, ``epochs`` passes further; ``heads`` itself is left as it is.

    The loss is the sum over the heads of their mean cross-entropy, plus ``decay`` / 2 times the squared weights.
    A pass gives the loss at its start, kept in ``losses`` as {epoch, aspect: loss}; ``after`` sees the
    heads after each. The same rows, settings and number of passes give the same fit up to rounding, however the
    passes are divided into calls.
    """
    heads = heads.copy()
    for _ in range(epochs):
        d_weights, d_bias, loss, rated = gradient(rows, heads)
        if not rated.any():
            raise ValueError("no labelled rows to fit heads on")
        rated = np.where(rated > 0, rated, 1)
        share = np.repeat(1 / rated, heads.classes)
        steps = (d_weights * share + decay * heads.weights, d_bias * share)
        heads.speed = tuple(momentum * s - rate * d for s, d in zip(heads.speed, steps))
        heads.weights = heads.weights + heads.speed[0]
        heads.bias = heads.bias + heads.speed[1]
        heads.epoch += 1
        heads.losses.append({"epoch": heads.epoch, **dict(zip(heads.aspects, (loss / rated).tolist()))})
        if after is not None:
            after(heads)
    return heads


def joint_logits(df: DataFrame, heads: JointHeads, source: str = "text") -> DataFrame:
    """``df`` with ``logits``, aspects x classes flat. No shuffle."""
    features, weights, bias = heads.features, heads.weights, heads.bias

    @F.arrow_udf("array<double>")
    def product(inputs: pa.Array) -> pa.Array:
        parts = [_logits(features, [inputs.slice(s, ROWS)], weights, bias)[0] for s in range(0, len(inputs), ROWS)]
        scores = np.concatenate(parts) if parts else np.zeros((0, len(bias)))
        ends = np.arange(len(scores) + 1, dtype=np.int32) * len(bias)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel()))

    return df.withColumn("logits", product(features.inputs(source)[0]))


def loss_history(heads: JointHeads, spark) -> DataFrame:
    """(epoch, aspect, loss): the loss of every head at the start of each pass."""
    rows = [(h["epoch"], a, float(h[a])) for h in heads.losses for a in heads.aspects]
    return spark.createDataFrame(rows, "epoch int, aspect string, loss double")
