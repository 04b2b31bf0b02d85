"""Multilabel-stratified folds and the 80/10/10 split, as a distributed ranking.

A stratum is the set of aspects a review mentions. Reviews are ranked by (stratum, hash, id) and
dealt out by rank, so fold sizes differ by at most one, in the whole and inside every stratum. The
ranking is never done in one place: each stratum is cut into cells by the leading hash digits, rows
are ranked inside their cell, and the table of cell sizes supplies the running offset. The result
does not depend on the number of cells, so it can grow with the data: with four digits, a stratum
that holds a third of 10^11 reviews is ranked in 65,536 cells of half a million rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aspectra.operators.balance import iterative_folds
from aspectra.operators.lookup import ROW, numbered
from aspectra.schema import ASPECTS

HASH_DIGITS = 4
MAX_ASPECTS = 10


def stratum(aspects=ASPECTS) -> Column:
    """Bit set of mentioned aspects."""
    bits = [F.when(F.col(a) > 0, 1 << i).otherwise(0) for i, a in enumerate(aspects)]
    return sum(bits[1:], bits[0])


def _running_total(count: str, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(before), F.lit(0))


def _with_rank(df: DataFrame, aspects, seed: int, key: str, digits: int) -> DataFrame:
    # A null key is dealt out by a stored row number, so that no cell holds all of them and no row is lost to the join.
    nameless = df.where(F.col(key).isNull()).isEmpty()
    df = df.withColumn(ROW, F.lit(None).cast("long")) if nameless else numbered(df)
    row_key = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.col(ROW).cast("string")))
    row_hash = F.md5(F.concat(row_key, F.lit(f":{seed}")))
    keyed = df.withColumns({"stratum": stratum(aspects), "row_hash": row_hash}).withColumn(
        "cell", F.substring("row_hash", 1, digits)
    )
    sizes = keyed.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    # One row per stratum, so its ordering window and its broadcast are bounded by MAX_ASPECTS.
    strata = (
        sizes.groupBy("stratum")
        .agg(F.sum("n").alias("n"))
        .select("stratum", _running_total("n", Window.orderBy("stratum")).alias("base"))
    )
    cell_order = Window.partitionBy("stratum").orderBy("cell")
    offsets = (
        sizes.select("stratum", "cell", _running_total("n", cell_order).alias("inside"))
        .join(F.broadcast(strata), "stratum")
        .select("stratum", "cell", (F.col("base") + F.col("inside")).alias("offset"))
    )
    # The ranking window has partitioned the rows by (stratum, cell), which is also the join key:
    # only the small side moves.
    inside = Window.partitionBy("stratum", "cell").orderBy("row_hash", key, ROW)
    ranked = keyed.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["stratum", "cell"]).withColumn(
        "rank", F.col("place") + F.col("offset")
    )


def stratified_folds(
    df: DataFrame,
    aspects=ASPECTS,
    k: int = 5,
    seed: int = 0,
    key: str = "review_id",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Add ``fold`` (0 to k-1). ``key`` must be unique for the result to be repeatable.

    Beyond ``MAX_ASPECTS`` aspects there may be as many strata as rows; folds are then dealt out label by label
    (``balance.iterative_folds``).
    """
    if len(aspects) > MAX_ASPECTS:
        return iterative_folds(df, aspects, k, seed, key)
    ranked = _with_rank(df, aspects, seed, key, digits)
    return ranked.select(*df.columns, (F.col("rank") % k).cast("int").alias("fold"))


def train_val_test(
    df: DataFrame,
    aspects=ASPECTS,
    k: int = 5,
    seed: int = 0,
    key: str = "review_id",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Add ``split``: the last fold is halved into val and test, the others are train. Any number of aspects, as in
    ``stratified_folds``."""
    if len(aspects) > MAX_ASPECTS:
        part = F.when(F.col("fold") < 2 * (k - 1), "train").when(F.col("fold") == 2 * (k - 1), "val").otherwise("test")
        return iterative_folds(df, aspects, 2 * k, seed, key).select(*df.columns, part.alias("split"))
    ranked = _with_rank(df, aspects, seed, key, digits)
    half = F.floor(F.col("rank") / k) % 2
    split = (
        F.when(F.col("rank") % k < k - 1, "train").when(half == 0, "val").otherwise("test")
    )
    return ranked.select(*df.columns, split.alias("split"))
