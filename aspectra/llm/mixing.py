"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], percent: int, cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order (null last) take the weights in turn and share ``percent`` / 100 of all sizes;
    a target stops at ``cap`` times its source's size and the excess goes to the others by weight. The sources
    that stop are those of the least cap for their weight, so one sorted pass finds them. All sums are exact.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1).select(
        "source", "source_size",
        F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int")).cast("decimal(20,0)").alias("w"),
        (F.col("source_size") * cap).cast("decimal(38,0)").alias("most"),
        "i",
    )
    by_level = Window.orderBy(F.col("most") / F.col("w"), "i")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levelled = ranked.select(
        "source", "source_size", "w", "most", "i",
        # What is left, times 100, for this source and all after it, whose weights add to wt.
        (F.sum(F.col("source_size")).over(everything).cast("decimal(38,0)") * percent - 100 * F.coalesce(F.sum("most").over(earlier), F.lit(0))).alias("left100"),
        F.sum("w").over(later).alias("wt"),
    )
    stops = F.col("most").cast("double") * 100 * F.col("wt").cast("double") <= F.col("w").cast("double") * F.col("left100").cast("double")
    open_first = Window.orderBy("k")
    flagged = levelled.withColumn("stops", stops).withColumn("k", F.row_number().over(by_level))
    # From the first source that does not stop on, all share its level.
    level = F.first(F.when(~F.col("stops"), F.struct("left100", "wt")), ignorenulls=True).over(open_first.rowsBetween(Window.unboundedPreceding, 0))
    shared = flagged.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(
        F.col("w").cast("double") * F.col("level.left100").cast("double") / (100.0 * F.col("level.wt").cast("double"))
    )
    return shared.select("source", "source_size", target.alias("target"))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the parts; the same in every run."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, cap: int = 2, seed: str = "mix") -> DataFrame:
    """Each document with its size, its source's size and target, and the copies the mix takes of it.

    ``docs`` has doc_id, text and source; other columns are kept out of the result. A source's rate is target by
    size; a document is taken floor(rate) times and once more if a hash of the seed, its doc_id and its text, a number in
    [0, 1), is below the rest. Returns doc_id, size (words), source_size, target, taken (words) and copies. A null
    text has no words; null sources are one source, ordered last; a source without words has target 0 and copies 0.
    Rows that repeat both doc_id and text are told apart by their place in the scan, so that each is drawn by itself. An
    empty table gives an empty table. The table of sources is summed before it is ordered and has one row per source.
    """
    taken = with_copies(docs, ["doc_id"], weights, percent, cap, seed)
    return taken.select(
        F.col("_doc.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


def with_copies(docs: DataFrame, keep: Sequence[str], weights: Sequence[int], percent: int, cap: int, seed: str) -> DataFrame:
    """(_doc, _size, _source_size, _target, _copies), where _doc holds the columns ``keep`` of ``docs``, whatever their names."""
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_doc"), word_count("text").alias("_size"),
        F.col("source").cast("string").alias("_source"), F.col("doc_id").cast("string").alias("_id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"), F.monotonically_increasing_id().alias("_place"),
    )
    # Two narrow passes over the texts: sizes of the sources, and keys that are there twice.
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes.withColumnRenamed("_source", "source"), weights, percent, cap)
    targets = targets.select(F.col("source").alias("_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    twice = sized.groupBy(F.col("_id").alias("_same_id"), F.col("_text").alias("_same_text")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("_id").eqNullSafe(F.col("_same_id")) & (F.col("_text") == F.col("_same_text"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    joined = sized.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_rate", rate).join(twice, same, "left")
    place = F.when(F.col("_same_text").isNotNull(), F.col("_place"))
    extra = uniform(seed, F.col("_id"), F.col("_text"), place) < F.col("_rate") - F.floor("_rate")
    copies = F.least(F.floor("_rate") + F.when(extra, 1).otherwise(0), F.lit(cap)).cast("long")
    return joined.select("_doc", "_size", "_source_size", "_target", copies.alias("_copies"))


def repeat_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken, with the columns of ``docs``.

    Cases as in ``mix_sources``; other columns may have any name.
    """
    taken = with_copies(docs, docs.columns, weights, percent, cap, seed).where("_copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
