"""One-hot codecs and decoding of raw class scores, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aspectra.schema import ASPECTS, CLASSES, RATINGS


def checked_class(score: Column, classes: int = CLASSES) -> Column:
    """The score itself; a score outside 0..classes-1 ends the job, null passes."""
    wrong = F.raise_error(F.concat(F.lit("score out of range: "), score.cast("string")))
    return F.when(score.isNull() | score.between(0, classes - 1), score).otherwise(wrong.cast("int"))


def one_hot(scores: list[Column], ratings: int = RATINGS) -> Column:
    """Scores 0..ratings of each aspect as one flat 0/1 array; score 0 is all zeros, any other
    score is refused."""
    slots = F.sequence(F.lit(1), F.lit(ratings))

    def block(score: Column) -> Column:
        return F.transform(slots, lambda j: (score == j).cast("int"))

    return F.concat(*[bind(checked_class(s, ratings + 1), block) for s in scores])


def one_hot_decode(v: Column, aspect: int, ratings: int = RATINGS) -> Column:
    """Score of one aspect from the flat array: its last set slot, or 0 when none is set."""
    block = F.slice(v, aspect * ratings + 1, ratings)
    return F.array_max(F.transform(block, lambda x, j: F.when(x == 1, j + 1).otherwise(0)))


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def softmax(v: Column) -> Column:
    """Class probabilities; the largest score is subtracted first so that exp cannot overflow."""
    return bind(
        exp_shifted(v), lambda e: bind(array_sum(e), lambda s: F.transform(e, lambda x: x / s))
    )


def argmax_class(v: Column) -> Column:
    """Class with the largest score, the first one on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def threshold_decode(
    v: Column, aspect: int, threshold: float = 0.5, ratings: int = RATINGS
) -> Column:
    """Score of one aspect from flat raw scores: its best sigmoid slot if that reaches threshold."""
    return bind(
        sigmoid(F.slice(v, aspect * ratings + 1, ratings)),
        lambda b: F.when(F.array_max(b) >= threshold, argmax_class(b) + 1).otherwise(0),
    )


def nll(v: Column, label: Column) -> Column:
    """Cross-entropy of one row: log of the summed exponentials minus the label's own score."""
    return F.log(array_sum(exp_shifted(v))) + F.array_max(v) - F.element_at(v, label + 1)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body is an array lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exp_shifted(v: Column) -> Column:
    return bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def pad(v: Column, fill: float = 0.0, size: int = CLASSES) -> Column:
    """Extend a score array to ``size`` classes."""
    return F.concat(v, F.array_repeat(F.lit(fill), F.lit(size) - F.size(v)))


def aspect_index(aspect: Column, aspects=ASPECTS) -> Column:
    """Position of an aspect name in the head order, from 0."""
    return F.array_position(F.array(*[F.lit(a) for a in aspects]), aspect) - 1
