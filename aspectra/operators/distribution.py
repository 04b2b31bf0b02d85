"""Label distribution reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aspectra.operators.labels import unpivot_aspects
from aspectra.schema import ASPECTS


def label_distribution(df: DataFrame, aspects=ASPECTS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per score, one count column per aspect; a score an aspect never takes counts 0."""
    scores = unpivot_aspects(df, aspects, key=by).where(F.col("score").isNotNull())
    counts = scores.groupBy(*by, "score").pivot("aspect", list(aspects)).count()
    return counts.na.fill(0, list(aspects))


def split_report(df: DataFrame, aspects=ASPECTS) -> DataFrame:
    """The label distribution of every split, in one pass."""
    return label_distribution(df, aspects, by=("split",))
