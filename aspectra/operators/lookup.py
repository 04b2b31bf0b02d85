"""Joins of many rows with a table of words: broadcast if the table is small, else split by measured weight.

A table within ``MAX_ENTRIES`` rows and ``MAX_BYTES`` characters is broadcast. Beyond that both sides are dealt out by
the key, except for the keys that are too heavy for one task: these are counted first, and since fewer than P keys
can each hold more than a P-th of the rows, their part of the table is always small enough to broadcast. Words
that were taken out of a row are put back by a row number that is stored with the rows, so both ways give the same
rows whatever the review keys are, null or repeated ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aspectra.session import materialise, stored

#: Column with the stored row number.
ROW = "_row"

MAX_ENTRIES = 1 << 17
MAX_BYTES = 16 << 20


def small_count(
    table: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES
) -> int | None:
    """Row count of a table within both bounds, else None. Reads at most ``max_entries`` + 1 rows."""
    text = [F.length(c) for c, kind in table.dtypes if kind == "string"]
    width = sum(text[1:], text[0]) if text else F.lit(8)
    n, size = table.limit(max_entries + 1).agg(F.count("*"), F.sum(width)).first()
    return n if n <= max_entries and (size or 0) <= max_bytes else None


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, stored, so that every later read sees the same numbers.

    Rows that have such numbers already are returned as they are.
    """
    if ROW in df.columns:
        return df
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def lookup_join(
    facts: DataFrame, table: DataFrame, on: list[str], how: str = "left", large: bool = False
) -> DataFrame:
    """Join facts to a table with one row per key. ``how`` is one of inner, left, left_semi and left_anti.

    ``large`` takes the way of tables beyond the bounds; the rows are the same. That way reads the facts
    twice more, so they should be stored or cheap to make.
    """
    if not large and small_count(table) is not None:
        return facts.join(F.broadcast(table), on, how)
    return split_join(facts, table, on, how)


def heavy_keys(facts: DataFrame, on: list[str], parts: int) -> DataFrame:
    """The stored keys that hold more than one in ``parts`` of the rows: fewer than ``parts`` of them."""
    counts = facts.dropna(subset=on).groupBy(*on).count()
    total = facts.agg(F.count("*").alias("total")).first()["total"]
    return materialise(counts.where(F.col("count") * parts > total).select(*on))


def split_join(
    facts: DataFrame, table: DataFrame, on: list[str], how: str = "left", parts: int | None = None
) -> DataFrame:
    """The join in two parts: heavy keys by a broadcast of their rows of the table, the others by a shuffle."""
    parts = parts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(facts, on, parts)
    if heavy.isEmpty():
        return facts.join(table, on, how)
    few = F.broadcast(heavy)
    often = facts.join(few, on, "left_semi").join(F.broadcast(table.join(few, on, "left_semi")), on, how)
    return often.unionByName(facts.join(few, on, "left_anti").join(table, on, how))
