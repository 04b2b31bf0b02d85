"""Compound words: learn them from the corpus, tag them, merge them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aspectra.functions.text import tokenize
from aspectra.operators.lookup import lookup_join
from aspectra.operators.runs import Found, count_pairs, count_runs, joined_words, key_filter, looked_up, with_word_ids
from aspectra.session import materialise, stored


def mine_compounds(
    df: DataFrame, min_count: int = 20, min_pmi: float | None = 1.0, text: str = "text"
) -> DataFrame:
    """Adjacent pairs seen at least ``min_count`` times with pointwise mutual information of at
    least ``min_pmi``: (first, second, count, pmi).

    Words are counted first. A pair is never more frequent than its words, so only pairs of two words that pass the filter
    of frequent words are counted; what it lets pass besides them falls to the count. Pairs are counted by ids of
    their words, which no two words share, and get the words back with their counts. Both counts leave a task as one
    row per distinct word or pair.
    """
    words = stored(df.select(joined_words(F.col(text)).alias("words")), "words")
    singles, salt = with_word_ids(count_runs(words, 1))
    frequent = singles.where(F.col("count") >= min_count)
    pairs = materialise(count_pairs(words, salt, key_filter(frequent, "phrase")).where(F.col("count") >= min_count))
    total = singles.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).scalar()
    for side in ("first", "second"):
        side_counts = frequent.select(
            F.col("id").alias(f"{side}_id"), F.col("phrase").alias(side), F.col("count").cast("double").alias(f"{side}_count")
        )
        pairs = lookup_join(pairs, side_counts, [f"{side}_id"], "inner")
    # As doubles: the product of two counts may pass 2^63.
    pmi = F.log(
        F.col("count").cast("double") * total.cast("double") / (F.col("first_count") * F.col("second_count"))
    )
    pairs = pairs.select("first", "second", "count", pmi.alias("pmi"))
    return pairs if min_pmi is None else pairs.where(F.col("pmi") >= min_pmi)


def tag_compounds(
    df: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "review_id", large: bool = False
) -> DataFrame:
    """Add ``tokens`` and ``tags``: a token is ``I`` when it and the one before it are a listed
    pair, else ``B``. ``lexicon`` is (first, second); it is read several times, so pass a stored
    table. ``large`` takes the way of lists beyond the bounds of a broadcast; the rows are the same."""
    pairs = lexicon.where(F.col("first").isNotNull() & F.col("second").isNotNull())
    pairs = pairs.select(F.concat_ws(" ", "first", "second").alias("pair")).distinct()
    found = looked_up(df, joined_words(F.col(text)), pairs, range(2, 3), _second_places, "places", "array<int>", large=large)
    return with_tags(found, text).select(*df.columns, "tokens", "tags")


def _second_places(found: Found, _: pa.Array | None) -> pa.Array:
    """Places of the second words of all pairs, from 0 in each row."""
    bounds = found.bounds()
    within = found.at + 1 - np.repeat(found.words.bounds[:-1], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(within, pa.int32()))


def with_tags(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``tokens`` and ``tags``, ``I`` at the ascending ``places`` (from 0) of the row."""
    tags = F.flatten(
        F.zip_with(
            # From each place to the next: one I, then B until the next place.
            F.col("places"),
            F.concat(F.slice("places", 2, F.size("places")), F.array(F.size("tokens"))),
            lambda at, then: F.concat(F.array(F.lit("I")), F.array_repeat(F.lit("B"), then - at - 1)),
        )
    )
    none = F.size("places") == 0
    before = F.array_repeat(F.lit("B"), F.coalesce(F.get("places", F.lit(0)), F.size("tokens")))
    tagged = rows.withColumn("tokens", tokenize(F.col(text)))
    tags = F.when(none, F.array_repeat(F.lit("B"), F.size("tokens"))).otherwise(F.concat(before, tags))
    return tagged.withColumn("tags", F.when(F.col("tokens").isNotNull(), tags)).drop("places")


def merge_compounds(tagged: DataFrame, text: str = "text") -> DataFrame:
    """Join each run of ``B I I ...`` tokens with ``_`` and the words with spaces, into ``text``."""
    pieces = F.zip_with(
        "tokens", "tags", lambda w, t: F.concat(F.when(t == "I", "_").otherwise(" "), w)
    )
    merged = F.substr(F.array_join(pieces, ""), F.lit(2))
    return tagged.withColumn(text, merged).drop("tokens", "tags")
