"""Word rows, corpus counts and stop words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from aspectra.functions.text import tokenize
from aspectra.operators.runs import Found, Words, joined_words, looked_up

# Listed as stop words, yet kept because they carry the sentiment.
KEEP_WORDS = ("không",)

# Longest Python word list that is put into the expression itself (a hashed IN list).
MAX_LITERALS = 4096


def token_rows(df: DataFrame, text: str = "text", key: str = "review_id") -> DataFrame:
    """(key, pos, word), positions from 1."""
    return df.select(key, F.posexplode(tokenize(F.col(text))).alias("pos", "word")).withColumn(
        "pos", F.col("pos") + 1
    )


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) over the corpus. Counts are merged inside each task before the shuffle."""
    words = df.select(F.explode(tokenize(F.col(text))).alias("word"))
    return words.groupBy("word").count()


def top_words(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words, ties in word order."""
    return counts.orderBy(F.desc("count"), "word").limit(n)


def remove_stopwords(
    df: DataFrame,
    words: DataFrame | Iterable[str],
    keep: Iterable[str] = KEEP_WORDS,
    text: str = "text",
    key: str = "review_id",
    large: bool = False,
) -> DataFrame:
    """Drop the listed words, except ``keep``, and re-join the others by single spaces.

    ``words`` is a Python collection or a one-column DataFrame ``word``. A review whose words are
    all dropped gets an empty text; a null text stays null. ``large`` takes the way of lists beyond
    the bounds; the rows are the same.
    """
    keep = list(keep)
    if not isinstance(words, DataFrame):
        listed = sorted(set(words) - set(keep))
        if len(listed) <= MAX_LITERALS and not large:
            kept = F.filter(tokenize(F.col(text)), lambda w: ~w.isin(*listed))
            return df.withColumn(text, F.array_join(kept, " "))
        words = df.sparkSession.createDataFrame([(w,) for w in listed], "word string")

    words = words.select("word").where(~F.col("word").isin(*keep)).distinct()
    found = looked_up(df, joined_words(F.col(text)), words, range(1, 2), _without, "_kept", "string", large=large)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.col("_kept"))).select(*df.columns)


def _without(found: Found, _: pa.Array | None) -> pa.Array:
    """The words that are not listed, joined by single spaces."""
    kept = np.ones(len(found.words.flat), bool)
    kept[found.at] = False
    bounds = pa.array(found.words.rows(kept), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(bounds, found.words.flat.filter(pa.array(kept))), " ")


def expand_terms(
    df: DataFrame, terms: DataFrame, text: str = "text", key: str = "review_id", large: bool = False
) -> DataFrame:
    """Replace whole words of cleaned text, in any letter case, by their full forms, from a table
    (short, full) with one row per short form; a repeated short form is refused. For a handful of
    rules the expression ``expand_abbrev`` does the same. ``large`` as in ``remove_stopwords``."""
    terms = terms.select(F.lower("short").alias("short"), "full")
    twice = terms.groupBy("short").count().where("count > 1").select("short").first()
    if twice:
        raise ValueError(f"two full forms for {twice.short!r}")
    # Lower case keeps the spaces where they are.
    found = looked_up(df, F.lower(text), terms, range(1, 2), _expanded, "_full", "string", extra=F.col(text), blank=True, large=large)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.col("_full"))).select(*df.columns)


def _expanded(found: Found, texts: pa.Array) -> pa.Array:
    """The words of the texts, those found replaced by their values."""
    words = Words.of(texts, blank=True)
    entry = np.full(len(words.flat), -1)
    entry[found.at] = found.entry
    full = found.values.take(pa.array(entry, mask=entry < 0)).cast(pa.string())
    bounds = pa.array(words.bounds, pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(bounds, pc.coalesce(full, words.flat)), " ")
