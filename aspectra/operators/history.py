"""Model selection from run histories. Input rows: (run_id, epoch, aspect, final_score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def epoch_means(history: DataFrame) -> DataFrame:
    return history.groupBy("run_id", "epoch").agg(F.avg("final_score").alias("mean_score"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Per epoch: whether its mean score strictly beats all earlier ones, and whether it is the
    last to do so (the one whose model is kept). The window runs over the epochs of a run."""
    run = Window.partitionBy("run_id")
    earlier = run.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max("mean_score").over(earlier)
    improved = best_before.isNull() | (F.col("mean_score") > best_before)
    kept = F.max(F.when(F.col("improved"), F.col("epoch"))).over(run)
    return (
        epoch_means(history)
        .withColumn("improved", improved)
        .withColumn("is_best", F.col("epoch") == kept)
    )


def rank_variants(history: DataFrame) -> DataFrame:
    """The best epoch of each run, runs ranked by its score (one row per run)."""
    best = best_epoch(history).where("is_best").drop("improved", "is_best")
    place = F.row_number().over(Window.orderBy(F.desc("mean_score"), "run_id"))
    return best.withColumn("place", place)
