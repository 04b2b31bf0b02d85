"""Phrases: mining by levels, longest match and best path, each against a plain version."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aspectra.operators import compounds, lookup, phrases, runs
from aspectra.plans import fixtures as fx

WORD = re.compile(r"[^\W]+", re.UNICODE)
ROWS = [(1, "a b c d a b c"), (1, "a b"), (None, "b c d"), (None, None), (2, ""), (3, "a , b. c"), (4, "d"), (5, "a b a b a b c d")]


def plain_counts(texts, longest):
    out = Counter()
    for t in texts:
        w = WORD.findall(t or "")
        for n in range(1, longest + 1):
            out.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = ROWS + [(100 + i, " ".join(rng.choices("abcde", weights=[6, 4, 2, 1, 1], k=rng.randrange(25)))) for i in range(60)]
    return spark.createDataFrame(rows, "review_id long, text string").repartition(3)


@pytest.mark.parametrize("least", [1, 5, 40])
def test_mining_by_levels(docs, least):
    texts = [r.text for r in docs.collect()]
    counts = plain_counts(texts, 4)
    total = sum(n for p, n in counts.items() if " " not in p)
    got = phrases.mine_phrases(docs, least, 4).collect()
    assert {(r.phrase, r.n, r["count"]) for r in got} == {(p, p.count(" ") + 1, n) for p, n in counts.items() if n >= least and " " in p}
    for r in got:
        words = r.phrase.split(" ")
        score = (np.log(r["count"]) + (r.n - 1) * np.log(total) - sum(np.log(counts[w]) for w in words)) / (r.n - 1)
        assert r.score == pytest.approx(score)
    kept = phrases.mine_phrases(docs, least, 4, min_score=0.1).collect()
    assert {r.phrase for r in kept} == {r.phrase for r in got if r.score >= 0.1}


def test_mining_pairs_is_the_older_pair_mining(spark, sf):
    docs = fx.lower_reviews(spark, sf)
    pairs = compounds.mine_compounds(docs, 20, None).select(F.concat_ws(" ", "first", "second").alias("phrase"), "count", F.round("pmi", 6).alias("s"))
    mined = phrases.mine_phrases(docs, 20, 2).select("phrase", "count", F.round("score", 6).alias("s"))
    assert mined.exceptAll(pairs).count() == 0 and pairs.count() == mined.count() > 0


def test_a_level_moves_its_survivors_only(docs, monkeypatch):
    """Only places whose word, and then pair, is frequent reach the next level."""
    kept = {}
    keep = phrases.stored

    def watched(df, name):
        kept[name] = keep(df, name)
        return kept[name]

    monkeypatch.setattr(phrases, "stored", watched)
    phrases.mine_phrases(docs, 60, 3)
    counts = plain_counts([r.text for r in docs.collect()], 2)
    for n in (1, 2):
        frequent = {p for p, c in counts.items() if c >= 60 and p.count(" ") == n - 1}
        assert {r.phrase for r in kept[f"places-{n}"].select("phrase").distinct().collect()} == frequent
        assert kept[f"places-{n}"].count() == sum(counts[p] for p in frequent)


def test_mining_an_empty_table(docs):
    assert phrases.mine_phrases(docs.where("false"), 1, 3).collect() == []


def plain_longest(words, listed, longest=4):
    out, i = [], 0
    while i < len(words):
        k = next((k for k in range(longest, 1, -1) if i + k <= len(words) and " ".join(words[i : i + k]) in listed), 1)
        out.append("_".join(words[i : i + k]))
        i += k
    return out


LISTED = ["a b", "b c d", "a b a b", "c d", "e a", "nothing here"]


@pytest.mark.parametrize("large", [False, True])
def test_longest_match(docs, spark, large):
    listed = spark.createDataFrame([(p, p.count(" ") + 1) for p in LISTED], "phrase string, n int")
    got = phrases.merge_phrases(docs, listed, large=large)
    assert got.columns == docs.columns
    want = Counter((r.review_id, r.text and " ".join(plain_longest(WORD.findall(r.text), LISTED))) for r in docs.collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    tagged = phrases.tag_longest(docs, listed, large=large)
    assert tagged.where("size(tokens) <> size(tags)").count() == 0 and tagged.where("tags is null").count() == 1


def test_longest_match_with_an_empty_list(docs, spark):
    nothing = spark.createDataFrame([], "phrase string, n int")
    want = Counter((r.review_id, r.text and " ".join(WORD.findall(r.text))) for r in docs.collect())
    assert Counter(tuple(r) for r in phrases.merge_phrases(docs, nothing).collect()) == want


def test_entries_of_a_shipped_list(spark):
    entries = spark.createDataFrame([("bấy_giờ",), ("bấy",), (" Bất_quá_chỉ ",), ("tính_từ_lúc_nào",), ("bấy_giờ",)], "entry string")
    assert {tuple(r) for r in phrases.from_entries(entries).collect()} == {("bấy giờ", 2), ("bất quá chỉ", 3), ("tính từ lúc nào", 4)}


def every_division(words, longest):
    for cuts in product([False, True], repeat=max(len(words) - 1, 0)):
        parts, part = [], words[:1]
        for word, cut in zip(words[1:], cuts):
            if cut:
                parts.append(part)
                part = []
            part = part + [word]
        parts.append(part)
        if all(len(p) <= longest for p in parts):
            yield parts


@pytest.mark.parametrize("large", [False, True])
def test_best_path_among_all_divisions(spark, large):
    rng = random.Random(3)
    scores = {"a": -20, "b": -30, "c": -30, "d": -50, "a b": -45, "b c": -44, "c d": -70, "a b c": -80, "b c d": -90, "a b c d": -109}
    rows = [(i, " ".join(rng.choices("abcdz", k=rng.randrange(10)))) for i in range(60)] + [(7, "a b c"), (None, "b c d a b"), (None, None)]
    docs = spark.createDataFrame(rows, "review_id long, text string").repartition(3)
    table = spark.createDataFrame([(p, p.count(" ") + 1, s) for p, s in scores.items()], "phrase string, n int, score long")
    want = Counter()
    for key, text in rows:
        if not text:
            want[key, text] += 1
            continue
        words = text.split(" ")
        ways = [w for w in every_division(words, 4) if all(len(p) == 1 or " ".join(p) in scores for p in w)]
        # Among equal sums the longer word at the first difference.
        best = max(ways, key=lambda w: (sum(scores.get(" ".join(p), 0) for p in w), [len(p) for p in w]))
        want[key, " ".join("_".join(p) for p in best)] += 1
    got = phrases.merge_phrases(docs, table, best=True, large=large)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_overlapping_pairs_make_no_chain(spark):
    """The older pair tags fuse a b and b c into one word; the best path keeps the more frequent pair."""
    docs = spark.createDataFrame([(i, "x b c y") for i in range(30)] + [(100 + i, "a b z") for i in range(10)] + [(999, "a b c")], "review_id long, text string")
    mined = phrases.mine_phrases(docs, 5, 2)
    pairs = mined.select(F.split("phrase", " ")[0].alias("first"), F.split("phrase", " ")[1].alias("second"))
    chained = compounds.merge_compounds(compounds.tag_compounds(docs, pairs)).where("review_id = 999").first().text
    scores = phrases.word_scores(docs, mined.where("phrase in ('a b', 'b c')"))
    best = phrases.merge_phrases(docs, scores, best=True).where("review_id = 999").first().text
    assert chained == "a_b_c" and best in ("a b_c", "a_b c")
    counts = {r.phrase: r.score for r in scores.collect()}
    assert (best == "a b_c") == (counts["a"] + counts["b c"] > counts["a b"] + counts["c"])


def test_best_path_of_a_long_text(spark):
    text = " ".join(["a b c d"] * 20000)
    docs = spark.createDataFrame([(1, text)], "review_id long, text string")
    table = spark.createDataFrame([("a b", 2, 5), ("b c d", 3, 7)], "phrase string, n int, score long")
    assert phrases.merge_phrases(docs, table, best=True).first().text.startswith("a b_c_d a b_c_d")


def test_numbers_are_given_once(docs):
    rows = lookup.numbered(docs)
    assert lookup.numbered(rows) is rows


@pytest.mark.parametrize("least", [1, 5, 40])
def test_mining_beyond_the_bounds_keeps_no_places(docs, monkeypatch, least):
    """The same phrases, counted from the texts level by level; no table of places is stored."""
    monkeypatch.setattr(lookup, "small_count", lambda *a, **k: None)
    names, keep = [], phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda df, name: names.append(name) or keep(df, name))
    counts = plain_counts([r.text for r in docs.collect()], 4)
    got = phrases.mine_phrases(docs, least, 4).collect()
    assert {(r.phrase, r.n, r["count"]) for r in got} == {(p, p.count(" ") + 1, n) for p, n in counts.items() if n >= least and " " in p}
    assert not [n for n in names if n.startswith("places")]


def test_long_lists_move_no_places(docs, spark):
    """Distinct runs of a batch are looked up, not a row for each place."""
    table = spark.createDataFrame([("a b", 2, 5), ("b c d", 3, 7)], "phrase string, n int, score long")
    for run in (phrases.tag_longest, phrases.tag_best):
        assert "Generate" not in run(docs, table, large=True)._jdf.queryExecution().executedPlan().toString()


def test_pair_ids_tell_words_apart(spark, monkeypatch):
    """Pairs are counted by ids of their words; a salt with which two words share an id is passed over."""
    made = runs.word_hashes
    texts = spark.createDataFrame([(i, "a b c b a b") for i in range(3)], "review_id long, text string")
    want = sorted(map(tuple, compounds.mine_compounds(texts, 1, None).collect()))
    assert {(r[0], r[1], r[2]) for r in want} == {("a", "b", 6), ("b", "c", 3), ("c", "b", 3), ("b", "a", 3)}
    monkeypatch.setattr(runs, "word_hashes", lambda w, salt=0: made(w, salt) if salt > 1 else made(w, salt) * 0)
    counted = spark.createDataFrame([("a", 6), ("b", 9), ("c", 3)], "phrase string, count long")
    _, salt = runs.with_word_ids(counted)
    assert salt == 2


def test_word_hashes_are_of_the_words_alone(spark):
    """The same for a word whatever stands beside it, and apart for words of the same bytes."""
    words = ["ab", "ba", "", "aab", "aba", "không", "a" * 5000, "a" * 4999 + "b"]
    together = runs.word_hashes(pa.array(words))
    alone = [runs.word_hashes(pa.array(["x" * i, w]).slice(1))[0] for i, w in enumerate(words)]
    assert together.tolist() == [int(h) for h in alone] and len(set(together.tolist())) == len(words)


def test_large_lookup_asks_one_row_per_batch_and_shard(spark, monkeypatch):
    """Runs asked of several shards, by several batches and slices, give the rows of the broadcast."""
    monkeypatch.setattr(runs, "ASKED", 2)
    monkeypatch.setattr(runs, "BATCH", 2)
    monkeypatch.setattr(runs, "SLICE", 64)
    rows = [(i % 7 if i % 5 else None, None if i % 11 == 3 else " ".join(f"w{(i * k) % 9}" for k in range(i % 13))) for i in range(60)]
    texts = spark.createDataFrame(rows, "review_id long, text string").repartition(3)
    listed = spark.createDataFrame([(f"w{a}", f"w{b}") for a in range(9) for b in range(0, 9, 2)], "first string, second string")
    one, two = (compounds.tag_compounds(texts, listed, large=large) for large in (False, True))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    plan = two._jdf.queryExecution().toString()
    assert "_runs" in plan and "_shard" in plan
