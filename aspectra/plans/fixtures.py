"""Reviews, ratings, raw scores, vectors and run histories derived from the given tables.

The tables hold no rated reviews, so each document is rated on six aspects from its whole text: one
keyword per aspect, ``x = 100 * keyword count / word count``. The count over the odd word positions
gives the truth, the count over the even ones the prediction and the raw class scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aspectra.functions.text import lower_text, tokenize
from aspectra.operators.labels import aspect_rows, unpivot_aspects
from aspectra.schema import ASPECTS, CLASSES, RATINGS
from aspectra.session import spread

#: Components of a vector of the embeddings table.
VECTOR_SIZE = 64

KEYWORDS = dict(zip(ASPECTS, ("the", "of", "de", "la", "der", "is")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, text)"""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return spread(docs, "review_id")


def lower_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).withColumn("text", lower_text(F.col("text")))


def keyword_counts(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(review_id, text, n, odd_<aspect>, even_<aspect>), of the review_ids in ``only`` if given"""
    docs = reviews(spark, sf_dir)
    if only is not None:
        docs = docs.join(only, "review_id", "left_semi")

    def mark(word, i):
        side = F.when(i % 2 == 0, "odd").otherwise("even")
        return F.when(word.isin(*KEYWORDS.values()), F.concat_ws(" ", side, word))

    marked = (
        docs.withColumn("words", tokenize(lower_text(F.col("text"))))
        .withColumn("marks", F.filter(F.transform("words", mark), lambda m: m.isNotNull()))
    )

    def count(side, word):
        return F.size(F.filter("marks", lambda m: m == f"{side} {word}"))

    counts = {
        f"{side}_{a}": count(side, word)
        for side in ("odd", "even")
        for a, word in KEYWORDS.items()
    }
    return marked.select(
        "review_id", "text", F.size("words").alias("n"), *[c.alias(k) for k, c in counts.items()]
    )


def _scores(counts: DataFrame, side: str):
    n = F.col("n")

    def score(a):
        density = F.ceil(100 * F.col(f"{side}_{a}") / n)
        return F.when(n > 0, F.least(F.lit(RATINGS), density)).otherwise(0).cast("int")

    return [score(a).alias(a) for a in ASPECTS]


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, text, one score per aspect)"""
    counts = keyword_counts(spark, sf_dir)
    return counts.select("review_id", "text", *_scores(counts, "odd"))


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, one score per aspect) of the reviews with a word at an even position."""
    counts = keyword_counts(spark, sf_dir).where(F.col("n") >= 2)
    return counts.select("review_id", *_scores(counts, "even"))


def labelled_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of the reviews that the ``labels`` table covers."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"))
    return truth(spark, sf_dir).join(labels, "review_id", "left_semi")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, aspect, truth, pred)"""
    counts = keyword_counts(spark, sf_dir)
    sides = zip(ASPECTS, _scores(counts, "odd"), _scores(counts, "even"))
    return aspect_rows(counts, ["review_id"], {a: {"truth": t, "pred": p} for a, t, p in sides})


def large_pairs(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep`` columns, aspect, truth, pred) of every order line, from its keys."""
    lines = table(spark, sf_dir, "lineitem")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    both = {
        a: {
            "truth": (key * 7 + line * (i + 1)) % CLASSES,
            "pred": (key * 5 + line * (i + 2)) % CLASSES,
        }
        for i, a in enumerate(ASPECTS)
    }
    return aspect_rows(lines, list(keep), both)


def _density(a: str):
    x = F.lit(100.0) * F.col(f"even_{a}") / F.col("n")
    return F.when(F.col("n") > 0, x).otherwise(F.lit(0.0))


def flat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, logits): five raw scores per aspect, ``0.25 - (x - rating)^2``."""

    def block(a):
        x, slots = F.col(f"x_{a}"), F.sequence(F.lit(1), F.lit(RATINGS))
        return F.transform(slots, lambda j: F.lit(0.25) - (x - j) * (x - j))

    densities = keyword_counts(spark, sf_dir).select(
        "review_id", *[_density(a).alias(f"x_{a}") for a in ASPECTS]
    )
    return densities.select("review_id", F.concat(*[block(a) for a in ASPECTS]).alias("logits"))


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, aspect, logits, label): six raw scores per aspect, ``0 - (x - class)^2``."""
    counts = keyword_counts(spark, sf_dir)
    labels = zip(ASPECTS, _scores(counts, "odd"))
    long = aspect_rows(counts, ["review_id"], {a: {"label": s, "x": _density(a)} for a, s in labels})
    x = F.col("x")
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.lit(0.0) - (x - k) * (x - k)
    )
    return long.select("review_id", "aspect", logits.alias("logits"), "label")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, layer, vec): runs of eight vectors as the layers of one token."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 40).alias("doc_id"),
        F.floor((v % 40) / 8).alias("pos"),
        (v % 8).alias("layer"),
        F.col("embedding").alias("vec"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec_id, vec)"""
    return table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", F.col("embedding").alias("vec")
    )


def rated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, vec, one score per aspect)"""
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.col("embedding").alias("vec")
    )
    # Only reviews that have a vector are rated.
    counts = keyword_counts(spark, sf_dir, vecs.select("review_id"))
    return vecs.join(counts.select("review_id", *_scores(counts, "odd")), "review_id")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, aspect, final_score): event types as aspects, days as epochs."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % 3).alias("run_id"),
            F.dayofmonth("ts").alias("epoch"),
            F.col("event_type").alias("aspect"),
        )
        .agg(F.avg("value").alias("final_score"))
    )


def long_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, aspect, score)"""
    return unpivot_aspects(truth(spark, sf_dir).drop("text"))
