"""Alignment of predictions with truth, and quality metrics per aspect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aspectra.operators.labels import aspect_rows
from aspectra.schema import ASPECTS, METRICS, RATINGS

# Fixed value: squared distance between the best and the worst rating.
MAX_SQUARED_ERROR = (RATINGS - 1) ** 2


def align(
    truth: DataFrame, pred: DataFrame, aspects=ASPECTS, key: str = "review_id"
) -> DataFrame:
    """Match wide truth and prediction tables: (key, aspect, truth, pred, has_truth, has_pred,
    truth_place, pred_place).

    The wide rows are joined first and unpivoted after, so each review is shuffled once, not once
    per aspect. A key that is repeated matches every row of the other side; the place of a row
    among those of its key (from 1) shows this, and the numbering uses the join's partitions. A
    null key matches nothing and is never a repetition.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(key, F.struct(*aspects).alias(name))
        place = F.row_number().over(Window.partitionBy(key).orderBy(name))
        numbered = rows.where(F.col(key).isNotNull()).withColumn(f"{name}_place", place)
        return numbered.unionByName(rows.where(F.col(key).isNull()).withColumn(f"{name}_place", F.lit(1)))

    both = side(truth, "t").join(side(pred, "p"), key, "full_outer")
    both = both.withColumns({"has_truth": F.col("t").isNotNull(), "has_pred": F.col("p").isNotNull()})
    both = both.withColumnsRenamed({"t_place": "truth_place", "p_place": "pred_place"})
    pairs = {a: {"truth": F.col("t")[a], "pred": F.col("p")[a]} for a in aspects}
    return aspect_rows(both, [key, "has_truth", "has_pred", "truth_place", "pred_place"], pairs)


def align_report(aligned: DataFrame) -> DataFrame:
    """Matched and missing rows per aspect, matched rows with a null score, and the rows of each
    side that repeat a key."""
    matched = F.col("has_truth") & F.col("has_pred")
    null_score = F.col("truth").isNull() | F.col("pred").isNull()
    return aligned.groupBy("aspect").agg(
        F.count_if(matched).alias("matched"),
        F.count_if(~F.col("has_pred")).alias("missing_pred"),
        F.count_if(~F.col("has_truth")).alias("missing_truth"),
        F.count_if(matched & null_score).alias("null_scores"),
        _repeats("truth_place", "pred_place").alias("duplicate_truth"),
        _repeats("pred_place", "truth_place").alias("duplicate_pred"),
    )


def _repeats(place: str, other: str) -> Column:
    """Each repeated row once, whatever it was matched with."""
    return F.count_if((F.col(place) > 1) & (F.coalesce(other, F.lit(1)) == 1))


def matched_pairs(aligned: DataFrame) -> DataFrame:
    """The rows that can be scored."""
    return aligned.where(F.col("truth").isNotNull() & F.col("pred").isNotNull())


def pair_counts(pairs: DataFrame, by: tuple[str, ...] = ("aspect",), aspects=ASPECTS) -> DataFrame:
    """Every count the metrics need, in one aggregate: tp, fp, fn, tn and the squared error of the
    pairs in which both sides mention the aspect (there are tp of those).

    Every group has a row for each of ``aspects``, with counts of 0 where it has no pair; pass None
    to leave such rows out. Those rows are added to the counts, not to the pairs.
    """
    t, p = F.col("truth") > 0, F.col("pred") > 0
    error = (F.col("truth") - F.col("pred")).cast("long")
    counts = pairs.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
        F.coalesce(F.sum(F.when(t & p, error * error)), F.lit(0)).alias("squared_error"),
    )
    return with_all_aspects(counts, by, aspects) if aspects and "aspect" in by else counts


#: What a report needs of its pairs; all of them add up.
COUNTS = ("tp", "fp", "fn", "tn", "squared_error")


def with_all_aspects(counts: DataFrame, by: tuple[str, ...], aspects=ASPECTS) -> DataFrame:
    """The counts, and a row of zeros for each aspect that a group has none for."""
    others = [c for c in by if c != "aspect"]
    groups = counts.select(*others).distinct() if others else counts.sparkSession.range(1).select()
    # The list is the small table, so it is the one on the left of a broadcast of the counts.
    every = groups.select(*[F.col(c).alias(f"_{c}") for c in others], F.explode(F.array(*map(F.lit, aspects))).alias("_aspect"))
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in others] + [F.col("_aspect") == F.col("aspect")]
    filled = every.join(counts, reduce(Column.__and__, same), "left")
    return filled.select(*[F.col(f"_{c}").alias(c) for c in by], *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def merge_counts(states: DataFrame, by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    """The sums of stored ``pair_counts`` by fewer columns: the state of all their pairs together."""
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def add_state(pairs: DataFrame, path: str, by: tuple[str, ...] = ("run", "split", "day", "aspect"), partition: str = "day") -> None:
    """Append the counts of new pairs, a row per group that occurs, to the states stored at ``path``.

    Reports over any of the ``by`` columns then come from the states alone; earlier pairs are not read again. A batch
    that is written again after a failure must go to the same partition with ``replace_state``.
    """
    pair_counts(pairs, by, None).write.mode("append").partitionBy(partition).parquet(path)


def replace_state(pairs: DataFrame, path: str, by: tuple[str, ...] = ("run", "split", "day", "aspect"), partition: str = "day") -> None:
    """As ``add_state``, in place of what the partitions of these pairs held."""
    writer = pair_counts(pairs, by, None).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(path)


def report_from_counts(counts: DataFrame, by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    """All five metrics from counts, merged or not."""
    scored = _with_r2(_with_prf(counts))
    return scored.withColumn("final_score", F.col("f1_score") * F.col("r2_score")).select(*by, *METRICS)


def merged_report(states: DataFrame, by: tuple[str, ...] = ("aspect",), aspects=ASPECTS) -> DataFrame:
    """``score_report`` of all pairs behind the stored states."""
    return report_from_counts(with_all_aspects(merge_counts(states, by), by, aspects), by)


def presence_counts(pairs: DataFrame, by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    return pair_counts(pairs, by).drop("squared_error")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def _with_r2(counts: DataFrame) -> DataFrame:
    worst = F.col("tp") * MAX_SQUARED_ERROR
    fit = F.when(F.col("tp") > 0, 1 - F.col("squared_error") / worst).otherwise(F.lit(1.0))
    return counts.withColumn("r2_score", fit)


def presence_prf(pairs: DataFrame, by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    """Precision, recall and F1 of mentioning the aspect at all; 0 where undefined."""
    return _with_prf(pair_counts(pairs, by)).select(*by, "precision", "recall", "f1_score")


def rating_r2(pairs: DataFrame, by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    """1 minus the squared error over its maximum, where both sides rate; 1 if they never do."""
    return _with_r2(pair_counts(pairs, by)).select(
        *by, F.col("tp").alias("rated"), "squared_error", "r2_score"
    )


def score_report(pairs: DataFrame, by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    """All five metrics per aspect from one shuffle; ``final_score`` is F1 times R2."""
    return report_from_counts(pair_counts(pairs, by), by)


def macro_report(report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean of each metric over the aspects."""
    return report.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS])
