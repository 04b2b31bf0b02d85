"""Cross-entropy of raw class scores. Input rows: (aspect, logits, label[, ordinal])."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aspectra.functions.labels import nll
from aspectra.schema import ASPECTS


def head_loss(rows: DataFrame) -> DataFrame:
    """Mean cross-entropy of each head: (aspect, loss)."""
    return rows.groupBy("aspect").agg(F.avg(nll(F.col("logits"), F.col("label"))).alias("loss"))


def cross_entropy(rows: DataFrame) -> DataFrame:
    """The head means, summed."""
    return head_loss(rows).agg(F.sum("loss").alias("loss"))


def batch_mean_loss(
    rows: DataFrame, size: int = 16, ordinal: str = "ordinal", aspects=ASPECTS
) -> DataFrame:
    """Loss averaged in each batch of ``size`` consecutive ordinals, then over the batches, so a
    short last batch weighs as much as the others.

    One aggregate per batch holds the mean of every head, so rows are shuffled once. Ordinals must be
    consecutive (``sources.reviews.with_ordinal`` makes them so); a batch that lacks a head or its
    scores is refused.
    """
    losses = rows.select(
        F.expr(f"`{ordinal}` div {int(size)}").alias("batch"),
        "aspect",
        nll(F.col("logits"), F.col("label")).alias("nll"),
    )
    heads = [F.avg(F.when(F.col("aspect") == a, F.col("nll"))) for a in aspects]
    batches = losses.groupBy("batch").agg(sum(heads[1:], heads[0]).alias("loss"))
    missing = F.raise_error(F.concat(F.lit("a head has no scores in batch "), F.col("batch").cast("string")))
    batches = batches.select("batch", F.coalesce("loss", missing.cast("double")).alias("loss"))
    return batches.agg(F.count("*").alias("batches"), F.avg("loss").alias("loss"))
