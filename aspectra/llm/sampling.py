"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32(doc_id as text) modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def remainder_of(doc_id: int, divisor: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % divisor


def per_class(rows: DataFrame, label: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each label, the least by a hash of doc_id; rows without a label are left out.

    The rows of one label are first thinned per hash slice, so that no task ranks all of them: of 64 slices each
    passes on an eighth of the sample, eight times what an even spread needs.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = rows.where(F.col(label).isNotNull()).withColumn("_order", order).withColumn("_slice", F.pmod(F.xxhash64("_order"), F.lit(64)))
    sliced = Window.partitionBy(label, "_slice").orderBy("_order")
    whole = Window.partitionBy(label).orderBy("_order")
    first = rows.withColumn("_rank", F.row_number().over(sliced)).where(F.col("_rank") <= most // 8 + 8)
    return first.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= most).drop("_order", "_slice", "_rank")
