"""Names and row shapes shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# The six rated aspects, in head order.
ASPECTS = ("entertainment", "lodging", "restaurant", "food", "transport", "shopping")

# Column names used by the review CSV files.
TEXT_HEADER = "Review"
ASPECT_HEADERS = {
    "giai_tri": "entertainment",
    "luu_tru": "lodging",
    "nha_hang": "restaurant",
    "an_uong": "food",
    "di_chuyen": "transport",
    "mua_sam": "shopping",
}

# Class 0 is "not mentioned", classes 1 to 5 are ratings.
RATINGS = 5
CLASSES = 6

METRICS = ("precision", "recall", "f1_score", "r2_score", "final_score")


def review_schema(aspects=ASPECTS, id_col: str | None = None, score=T.IntegerType()) -> T.StructType:
    """Explicit schema of a wide review table, so that no inference pass is needed."""
    fields = [T.StructField(id_col, T.LongType())] if id_col else []
    fields.append(T.StructField("review", T.StringType()))
    fields += [T.StructField(a, score) for a in aspects]
    return T.StructType(fields)
