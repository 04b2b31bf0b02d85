"""Column projections and reshaping of wide review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aspectra.functions.labels import one_hot as one_hot_array, one_hot_decode as decode_aspect
from aspectra.schema import ASPECTS


def split_xy(df: DataFrame, aspects=ASPECTS, key: str = "review_id"):
    """The table without its label columns, and its labels alone."""
    return df.drop(*aspects), df.select(key, *aspects)


def unpivot_aspects(df: DataFrame, aspects=ASPECTS, key="review_id", value: str = "score"):
    """One row per review and aspect."""
    ids = [key] if isinstance(key, str) else list(key)
    return df.unpivot(ids, list(aspects), "aspect", value)


def aspect_rows(df: DataFrame, keep: list[str], values: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per aspect with several values: ``{aspect: {column: expression}}``."""
    names = list(next(iter(values.values())))
    cells = [x for a, columns in values.items() for x in (F.lit(a), *columns.values())]
    return df.select(*keep, F.stack(F.lit(len(values)), *cells).alias("aspect", *names))


def one_hot(df: DataFrame, aspects=ASPECTS, col: str = "one_hot") -> DataFrame:
    return df.withColumn(col, one_hot_array([F.col(a) for a in aspects]))


def one_hot_decode(df: DataFrame, aspects=ASPECTS, col: str = "one_hot") -> DataFrame:
    scores = {a: decode_aspect(F.col(col), i) for i, a in enumerate(aspects)}
    return df.withColumns(scores).drop(col)
