"""The text preparation chain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from aspectra.functions.text import ABBREVIATIONS, clean_text
from aspectra.operators.compounds import merge_compounds, tag_compounds
from aspectra.operators.lookup import numbered
from aspectra.operators.phrases import merge_phrases
from aspectra.operators.tokens import KEEP_WORDS, expand_terms, remove_stopwords


def prepare_text(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    stop_words: DataFrame | Iterable[str] | None = None,
    keep: Iterable[str] = KEEP_WORDS,
    rules: dict[str, str] | DataFrame = ABBREVIATIONS,
    whitespace: str = "delete",
    text: str = "text",
    key: str = "review_id",
) -> DataFrame:
    """Lowercase, punctuation, numbers, allow-list, abbreviations, compounds, stop words.

    The first five are one projection. ``rules`` is a short mapping or a table (short, full) of
    abbreviations. Compounds are merged when a ``lexicon`` is given: pairs (first, second) by tags, phrases
    (phrase, n) by longest match, phrases with scores (phrase, n, score) by the best path. Stop words go when a list is
    given. Both are off by default. The reviews are numbered and stored once if a step needs a table.
    """
    by_table = isinstance(rules, DataFrame)
    lists = isinstance(stop_words, DataFrame)
    cleaned = clean_text(F.col(text), rules={} if by_table else rules, whitespace=whitespace)
    out = df.withColumn(text, cleaned)
    if by_table + (lexicon is not None) + lists > 1:
        out = numbered(out)
    if by_table:
        out = expand_terms(out, rules, text, key)
    if lexicon is not None and "phrase" in lexicon.columns:
        out = merge_phrases(out, lexicon, text=text, best="score" in lexicon.columns)
    elif lexicon is not None:
        out = merge_compounds(tag_compounds(out, lexicon, text, key), text)
    if stop_words is not None:
        out = remove_stopwords(out, stop_words, keep, text, key)
    return out.select(*df.columns)
