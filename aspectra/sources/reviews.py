"""Review tables: CSV and parquet in, split tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from aspectra.schema import ASPECTS, review_schema
from aspectra.session import new_table_path, stored

# Reviews hold line breaks, quotes and leading blanks; the reader and the writer must agree on how
# these are kept. A null is written as \N so that an empty text stays an empty text; a text of
# backslashes and one N is written with one backslash more.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_reviews(
    spark: SparkSession,
    path: str | list[str],
    aspects=ASPECTS,
    fmt: str = "csv",
    id_col: str | None = None,
) -> DataFrame:
    """Wide reviews: ``review`` and one score column per aspect, with an explicit schema.

    CSV columns are taken by position (text first, then the scores in aspect order), whatever the
    header calls them; an ``id_col`` comes before the text. Scores may be written as ``3`` or
    ``3.0``. A fraction, a value that is no number and a row with a column too few or too many end
    the job, so that no label is lost unseen. A quoted line break makes a CSV file one task, so keep
    large tables as many files or as parquet.
    """
    schema = review_schema(aspects, id_col)
    if fmt == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(
            *schema.fieldNames()
        )
    raw = (
        spark.read.schema(review_schema(aspects, id_col, T.DoubleType()))
        .options(**CSV_OPTIONS)
        .option("multiLine", "true")
        .option("enforceSchema", "true")
        .option("mode", "FAILFAST")
        # Every column is parsed, so that a bad row is seen whatever is selected.
        .option("columnPruning", "false")
        .csv(path)
    )
    text = F.regexp_replace("review", r"\A\\(\\+N)\z", "$1")
    return raw.withColumns({"review": text} | {a: _whole(a) for a in aspects})


#: Column that holds a row as it was written where it does not fit the schema.
CORRUPT = "_corrupt"


def split_reviews(
    spark: SparkSession, path: str | list[str], aspects=ASPECTS, id_col: str | None = None, classes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """CSV reviews in two stored tables from one pass: the good rows as ``read_reviews`` gives them, and the rows set aside.

    The second is (file, row, reason, column): the row as it was written, or its values joined by commas where it could be
    parsed, and ``columns`` (too few or too many columns, or a value that is no number), ``fraction`` (a score
    between two numbers) or ``class`` (a score outside 0 to ``classes`` - 1, if that is given), with the first column at
    fault. A row is in exactly one of the tables, so their counts add up to the rows of the files; see ``reject_counts``.
    A null score passes.
    """
    schema = review_schema(aspects, id_col, T.DoubleType()).add(CORRUPT, T.StringType())
    raw = (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS)
        .option("multiLine", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", "false")
        .csv(path)
    )

    def first_of(wrong) -> Column:
        return F.coalesce(*[F.when(wrong(F.col(a)), F.lit(a)) for a in aspects])

    fraction = first_of(lambda c: c != F.floor(c))
    outside = first_of(lambda c: ~c.between(0, classes - 1)) if classes else F.lit(None).cast("string")
    judged = raw.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_reason": F.when(F.col(CORRUPT).isNotNull(), "columns").when(fraction.isNotNull(), "fraction").when(outside.isNotNull(), "class"),
            "_column": F.when(F.col(CORRUPT).isNull(), F.coalesce(fraction, outside)),
        }
    )
    both = stored(judged.withColumn("_good", F.col("_reason").isNull()), "judged-reviews")
    text = F.regexp_replace("review", r"\A\\(\\+N)\z", "$1")
    ids = [id_col] if id_col else []
    good = both.where("_good").select(*ids, text.alias("review"), *[F.col(a).cast("int").alias(a) for a in aspects])
    written = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *ids, "review", *aspects))
    rejects = both.where("not _good").select(F.col("_file").alias("file"), written.alias("row"), F.col("_reason").alias("reason"), F.col("_column").alias("column"))
    return good, rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(reason, column, rows) of the rows that ``split_reviews`` set aside."""
    return rejects.groupBy("reason", "column").agg(F.count("*").alias("rows"))


def _whole(score: str) -> Column:
    c = F.col(score)
    wrong = F.raise_error(F.concat(F.lit(f"{score} is not a whole number: "), c.cast("string")))
    return F.when(c.isNull() | (c == F.floor(c)), c.cast("int")).otherwise(wrong.cast("int"))


def with_review_id(df: DataFrame) -> DataFrame:
    """Number reviews that come without a key. Unique, but only fixed once the result is stored."""
    return df.select(F.monotonically_increasing_id().alias("review_id"), *df.columns)


def with_ordinal(df: DataFrame, order_by: str, ordinal: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Number rows 0, 1, 2, ... in the order of a column, ties in no fixed order, nulls first.

    Rows are stored by ranges of the column; one count per range, summed in order, gives each range
    its first number. ``parts`` ranges (as many as shuffle partitions if None), whatever the rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_table_path(spark, "ordinal")
    ranged = df.repartitionByRange(parts, order_by, F.rand(0)).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order_by)) - 1
    numbered = rows.withColumn("_place", place).join(F.broadcast(starts), "_range")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place")).alias(ordinal))


def write_reviews(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    _write(df, path, fmt, mode)


def write_splits(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One folder per value of ``split``, written in one pass without a shuffle."""
    _write(df, path, fmt, mode, "split")


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    aspects=ASPECTS,
    fmt: str = "csv",
    id_col: str | None = None,
) -> DataFrame:
    """One split of ``write_splits``; only its folder is read."""
    return read_reviews(spark, f"{path}/split={split}", aspects, fmt, id_col)


def _write(df: DataFrame, path: str, fmt: str, mode: str, *partitions: str) -> None:
    writer = df.write.mode(mode)
    if partitions:
        writer = writer.partitionBy(*partitions)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        for name, kind in df.dtypes:
            if kind == "string" and name not in partitions:
                df = df.withColumn(name, F.regexp_replace(name, r"\A(\\+N)\z", r"\\$1"))
        writer = df.write.mode(mode)
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.options(**CSV_OPTIONS).option("quoteAll", "true").csv(path)
