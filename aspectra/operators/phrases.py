"""Words of several syllables: mined level by level, and found in texts by longest match or by the best path.

A phrase is its words joined by single spaces. A text's places where a listed phrase stands are found by looking up its
runs of two to ``longest`` words (``operators/runs.py``); what is kept of them is chosen in one pass over the places of a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aspectra.operators import lookup
from aspectra.operators.compounds import merge_compounds, with_tags
from aspectra.operators.lookup import ROW, lookup_join, numbered
from aspectra.operators.runs import Found, count_runs, joined_words, key_filter, looked_up
from aspectra.operators.tokens import token_rows
from aspectra.session import stored

#: Scores are whole numbers of this size, so that sums are exact and ties are ties everywhere.
MICRO = 1_000_000


def mine_phrases(
    df: DataFrame, min_count: int = 20, longest: int = 4, min_score: float | None = None, text: str = "text"
) -> DataFrame:
    """Runs of two to ``longest`` words seen at least ``min_count`` times: (phrase, n, count, score).

    Mined by levels: a run of n words is counted only where its first and its last n - 1 words both
    passed, which loses none, since no run is more frequent than its parts. A level keeps the places of the runs that
    passed, so each shuffle is bounded by the survivors of the one before; the first keeps frequent words. From a level
    that is beyond the bounds of a broadcast on, no places are kept: a filter of the level's runs picks the runs to count
    from the texts, and each task hands on distinct ones with their counts.
    The score is the mutual information per joint, ln(count * N^(n-1) / product of word counts) / (n - 1) with N the
    words of the corpus; ``min_score`` filters the result, not the growth.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    words = stored(df.select(joined_words(F.col(text)).alias("words")), "words")
    levels, places, parts = [], None, None
    for n in range(1, longest + 1):
        if places is not None:
            counts = places.groupBy("phrase").agg(F.count("*").alias("count"))
        else:
            counts = count_runs(words, n, parts)
        if n == 1:
            counts = stored(counts, "word-counts")
            total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).first()["total"]
        passed = counts.where(F.col("count") >= min_count)
        levels.append(stored(passed, f"phrases-{n}") if n > 1 else passed)
        if n == longest:
            break
        if (n == 1 or places is not None) and lookup.small_count(levels[-1].select("phrase")) is not None:
            if n == 1:
                places = token_rows(numbered(df.select(text)), text, ROW).withColumnRenamed("word", "phrase")
            survivors = places.join(F.broadcast(levels[-1].select("phrase")), ["phrase"], "left_semi")
            survivors = stored(survivors, f"places-{n}")
            row = Window.partitionBy(ROW).orderBy("pos")
            following, then = F.lead("phrase").over(row), F.lead("pos").over(row)
            grown = F.concat_ws(" ", "phrase", F.substring_index("next", " ", -1))
            places = (
                survivors.withColumns({"next": following, "next_pos": then})
                .where(F.col("next_pos") == F.col("pos") + 1)
                .select(ROW, "pos", grown.alias("phrase"))
            )
        else:
            places, parts = None, key_filter(levels[-1], "phrase")
    phrases = reduce(DataFrame.unionByName, (level.withColumn("n", F.lit(n + 2)) for n, level in enumerate(levels[1:])))
    words = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("word"))
    singles = levels[0].select(F.col("phrase").alias("word"), F.col("count").alias("word_count"))
    logs = lookup_join(words, singles, ["word"], "inner").groupBy("phrase").agg(F.sum(F.log("word_count")).alias("logs"))
    score = (F.log("count") + (F.col("n") - 1) * float(np.log(max(total, 1))) - F.col("logs")) / (F.col("n") - 1)
    scored = phrases.join(logs, "phrase").select("phrase", "n", "count", score.alias("score"))
    return scored if min_score is None else scored.where(F.col("score") >= min_score)


def from_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """(phrase, n) from a list of entries whose syllables are joined by ``_``; single syllables are left out."""
    phrase = F.lower(F.trim(F.regexp_replace(entry, "_+", " ")))
    listed = entries.select(phrase.alias("phrase")).distinct()
    return listed.withColumn("n", F.size(F.split("phrase", " "))).where("n >= 2")


def word_scores(df: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """(phrase, n, score) of all words of the corpus and the given (phrase, n, count): round(MICRO * ln(count / N))."""
    counts = token_rows(df.select(F.lit(0).alias(ROW), text), text, ROW).groupBy("word").agg(F.count("*").alias("count"))
    counts = stored(counts, "word-counts")
    total = counts.agg(F.sum("count").alias("total")).first()["total"] or 1
    every = counts.select(F.col("word").alias("phrase"), F.lit(1).alias("n"), "count").unionByName(phrases.select("phrase", "n", "count"))
    return every.select("phrase", "n", F.round(MICRO * F.log(F.col("count") / F.lit(float(total)))).cast("long").alias("score"))


def _longest_first(found: Found, _: pa.Array | None) -> pa.Array:
    """Places after the first of each chosen phrase: from the left, the longest that begins at the first free place."""
    at, n, finds = found.at.tolist(), found.n.tolist(), found.bounds().tolist()
    out = []
    for begin, start, stop in zip(found.words.bounds.tolist(), finds, finds[1:]):
        free, inside = begin, []
        for i in range(start, stop):
            if at[i] >= free:
                free = at[i] + n[i]
                inside.extend(range(at[i] + 1 - begin, free - begin))
        out.append(inside)
    return pa.array(out, pa.list_(pa.int32()))


def _best_path(found: Found, _: pa.Array | None) -> pa.Array:
    """The same for the division of the whole text with the greatest sum of scores.

    Worked from the end, so that among equal sums the one with the longer word at the first difference wins. A word
    counts 0 alone if it is not listed.
    """
    score = found.values.take(pa.array(found.entry)).to_numpy(zero_copy_only=False)
    alone = np.zeros(len(found.words.flat), np.int64)
    alone[found.at[found.n == 1]] = score[found.n == 1]
    more = found.n > 1
    # Of a place the shorter phrase first: the longer one comes last, and wins ties.
    at, n, score = found.at[more][::-1].tolist(), found.n[more][::-1].tolist(), score[more][::-1].tolist()
    alone, words = alone.tolist(), found.words.bounds.tolist()
    at.append(-1)
    out, j = [None] * (len(words) - 1), 0
    for row in range(len(words) - 2, -1, -1):
        start, stop = words[row], words[row + 1]
        best, step = [0] * (stop - start + 1), {}
        for i in range(stop - 1, start - 1, -1):
            here = i - start
            top = alone[i] + best[here + 1]
            while at[j] == i:
                other = score[j] + best[here + n[j]]
                if other >= top:
                    top, step[here] = other, n[j]
                j += 1
            best[here] = top
        inside, here = [], 0
        while here < stop - start:
            size = step.get(here, 1)
            inside.extend(range(here + 1, here + size))
            here += size
        out[row] = inside
    return pa.array(out, pa.list_(pa.int32()))


def tag_longest(df: DataFrame, phrases: DataFrame, longest: int = 4, text: str = "text", large: bool = False) -> DataFrame:
    """Add ``tokens`` and ``tags`` (``B``, then ``I`` in a phrase): longest match from the left.

    ``phrases`` is (phrase, n), as ``mine_phrases`` or ``from_entries`` give it; phrases of one word or of more than
    ``longest`` are not looked for. Rows that repeat a key, or have none, are kept apart; a null text has null
    tokens. ``large`` takes the way of lists beyond the bounds of a broadcast; the rows are the same.
    """
    listed = phrases.select("phrase").distinct()
    found = looked_up(df, joined_words(F.col(text)), listed, range(2, longest + 1), _longest_first, "places", "array<int>", large=large)
    return with_tags(found, text).select(*df.columns, "tokens", "tags")


def tag_best(df: DataFrame, scores: DataFrame, longest: int = 4, text: str = "text", large: bool = False) -> DataFrame:
    """The same for the most likely division of each text, where a phrase may overlap another.

    ``scores`` is (phrase, n, score) with whole-number scores, single words included (``word_scores``). A word
    without a score of its own counts 0 when it stands alone.
    """
    listed = scores.select("phrase", F.col("score").cast("long").alias("score"))
    found = looked_up(df, joined_words(F.col(text)), listed, range(1, longest + 1), _best_path, "places", "array<int>", large=large)
    return with_tags(found, text).select(*df.columns, "tokens", "tags")


def merge_phrases(df: DataFrame, phrases: DataFrame, longest: int = 4, text: str = "text", best: bool = False, large: bool = False) -> DataFrame:
    """``df`` with the words of each found phrase joined by ``_``, words by single spaces."""
    tag = tag_best if best else tag_longest
    return merge_compounds(tag(df, phrases, longest, text, large), text)
