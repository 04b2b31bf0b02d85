"""Reviews that arrive as a stream: the same preparation and the same heads, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aspectra.plans.models import Heads
from aspectra.plans.rater import Preparation, TextRater
from aspectra.schema import ASPECTS, review_schema


def read_review_stream(
    spark: SparkSession, path: str, id_col: str = "review_id", max_files: int = 100
) -> DataFrame:
    """Parquet reviews dropped into a folder; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(review_schema(ASPECTS, id_col))
    return reader.option("maxFilesPerTrigger", max_files).parquet(path)


def predict_stream(
    reviews: DataFrame, rater: TextRater | Heads, path: str, checkpoint: str
) -> StreamingQuery:
    """Class predictions of raw reviews as parquet files, a folder ``batch=<n>`` for each micro-batch.

    A batch is rated as any table is, so lists of compounds or stop words work as they do there; heads that come
    without a preparation get the default one. The checkpoint folder makes each input file count once across restarts:
    a batch that is run again after a failure replaces its own folder.
    """
    if not isinstance(rater, TextRater):
        rater = TextRater(Preparation(), rater)

    def rate(batch: DataFrame, number: int) -> None:
        rater.predict(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        reviews.writeStream.foreachBatch(rate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
