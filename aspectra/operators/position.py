"""Truth and predictions that come without a key: lined up by place, and checked for rows that went missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aspectra.operators.labels import aspect_rows
from aspectra.schema import ASPECTS
from aspectra.session import stored
from aspectra.sources.reviews import with_ordinal


def align_by_position(
    truth: DataFrame, pred: DataFrame, order_by: str, pred_order_by: str | None = None, aspects=ASPECTS
) -> DataFrame:
    """Match the n-th row of one wide table with the n-th of the other: (ordinal, aspect, truth, pred, has_truth, has_pred).

    Each side is numbered without gaps in the order of its own column (``with_ordinal``), so keys need not agree. Where
    one side is longer, its last rows match nothing. Rows are joined wide and unpivoted after; the result goes on to
    ``metrics.matched_pairs``.
    """
    sides = {"t": with_ordinal(truth.select(order_by, *aspects), order_by), "p": with_ordinal(pred.select(pred_order_by or order_by, *aspects), pred_order_by or order_by)}
    t, p = (df.select("ordinal", F.struct(*aspects).alias(name)) for name, df in sides.items())
    both = t.join(p, "ordinal", "full_outer")
    both = both.withColumns({"has_truth": F.col("t").isNotNull(), "has_pred": F.col("p").isNotNull()})
    return aspect_rows(both, ["ordinal", "has_truth", "has_pred"], {a: {"truth": F.col("t")[a], "pred": F.col("p")[a]} for a in aspects})


def _prints(df: DataFrame, order_by: str, fingerprint: list[str]) -> DataFrame:
    """(ordinal, print): a hash of the columns that both sides carry."""
    numbered = with_ordinal(df.select(order_by, *[c for c in fingerprint if c != order_by]), order_by)
    return numbered.select("ordinal", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in fingerprint]).alias("print"))


def shift_report(
    truth: DataFrame, pred: DataFrame, order_by: str, fingerprint: list[str], pred_order_by: str | None = None, window: int = 1024, reach: int = 16
) -> DataFrame:
    """Where two tables that should line up by place do not: (first_ordinal, last_ordinal, rows, shift, agreeing).

    ``fingerprint`` names columns that both sides carry, such as the text. Places are taken in windows of ``window``
    truth rows; for each the shift within ``reach`` is found at which most rows agree, the least in size, then the
    negative one, on ties. A shift of s says that row n of the truth is row n + s of the predictions: -1 after a
    dropped prediction, 1 after an extra one. Consecutive windows of one shift are one row of the result, so lined-up
    tables give a single row of shift 0. A window without an agreeing row has shift null.

    Each truth row meets at most 2 * ``reach`` + 1 places by an equality join on place and fingerprint; text that repeats is
    no hot key, since the place is part of the key.
    """
    sides = [_prints(truth, order_by, fingerprint), _prints(pred, pred_order_by or order_by, fingerprint)]
    t, p = (stored(s, "prints") for s in sides)
    tried = t.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    found = tried.withColumn("place", F.col("ordinal") + F.col("shift")).join(
        p.select(F.col("ordinal").alias("place"), "print"), ["place", "print"], "left_semi"
    )
    part = F.floor(F.col("ordinal") / window)
    votes = found.groupBy(part.alias("part"), "shift").agg(F.count("*").alias("agreeing"))
    best = votes.groupBy("part").agg(F.max(F.struct("agreeing", (-F.abs("shift")).alias("near"), (-F.col("shift")).alias("sign"))).alias("b"))
    windows = t.groupBy(part.alias("part")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("rows"))
    seen = windows.join(best, "part", "left").select(
        "part", "first", "last", "rows", (-F.col("b.sign")).alias("shift"), F.coalesce("b.agreeing", F.lit(0)).alias("agreeing")
    )
    # One row per window from here on.
    order = Window.orderBy("part")
    changed = ~F.coalesce(F.col("shift").eqNullSafe(F.lag("shift").over(order)), F.lit(False)) | (F.lag("part").over(order).isNull())
    runs = seen.withColumn("new", changed.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run").agg(
        F.min("first").alias("first_ordinal"), F.max("last").alias("last_ordinal"), F.sum("rows").alias("rows"),
        F.first("shift").alias("shift"), F.sum("agreeing").alias("agreeing"),
    ).drop("run")


def position_report(aligned: DataFrame) -> DataFrame:
    """Per aspect: rows of both sides, rows matched by place and rows left over, from ``align_by_position``."""
    return aligned.groupBy("aspect").agg(
        F.count_if("has_truth").alias("truth_rows"), F.count_if("has_pred").alias("pred_rows"),
        F.count_if(F.col("has_truth") & F.col("has_pred")).alias("matched"), F.count_if(~F.col("has_pred")).alias("missing_pred"),
        F.count_if(~F.col("has_truth")).alias("missing_truth"),
    )
