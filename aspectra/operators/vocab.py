"""Vocabulary and fixed-length encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aspectra.functions.text import tokenize
from aspectra.operators.runs import Found, looked_up
from aspectra.operators.tokens import token_counts, top_words

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(word, count, id): the ``size`` most frequent words, ids by descending frequency.

    The ranking window runs over the ``size`` kept words only, never over the corpus.
    """
    if size < 1:
        raise ValueError("vocabulary size must be positive")
    kept = top_words(token_counts(df, text), size)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "word"))
    return kept.select("word", "count", (rank + FIRST_WORD_ID - 1).alias("id"))


def encode(
    df: DataFrame, vocab: DataFrame, max_len: int, text: str = "text", large: bool = False
) -> DataFrame:
    """Add ``ids`` and ``mask``, both ``max_len`` long, and the uncut word count ``n_tokens``.

    ``vocab`` is (word, id), one row per word, as made by ``build_vocab``; it is read twice, so pass a
    stored table. The first ``max_len`` words of each row are looked up; ``large`` takes the way of
    tables beyond the bounds of a broadcast. The rows are the same.
    """
    vocab = vocab.select("word", "id")
    words = F.array_join(F.slice(tokenize(F.col(text)), 1, max_len), " ")
    coded = looked_up(df, words, vocab, range(1, 2), _ids, "ids", "array<int>", large=large)
    coded = coded.select(*df.columns, F.size(tokenize(F.col(text))).alias("n_tokens"), F.when(F.col(text).isNotNull(), F.col("ids")).alias("ids"))
    room = F.greatest(F.lit(max_len) - F.col("n_tokens"), F.lit(0))
    positions = F.sequence(F.lit(1), F.lit(max_len))
    return coded.withColumns(
        {
            "ids": F.concat("ids", F.array_repeat(F.lit(PAD_ID), room)),
            "mask": F.transform(positions, lambda i: (i <= F.col("n_tokens")).cast("int")),
        }
    )


def _ids(found: Found, _: pa.Array | None) -> pa.Array:
    """The value of each word, or the unknown id."""
    ids = np.full(len(found.words.flat), UNKNOWN_ID, np.int32)
    ids[found.at] = found.values.take(pa.array(found.entry)).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(found.words.bounds, pa.int32()), pa.array(ids))
