"""Word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line, blanks around it removed, each entry once: (word)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("word"))
    return lines.where(F.col("word") != "").distinct()
