"""Folds, compounds, vocabularies, vectors and word tables: invariants and the large-table paths."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.operators import compounds, distribution, folds, heads, lookup, runs, tokens, vectors, vocab
from aspectra.plans import fixtures as fx
from aspectra.plans.oracle import ORACLE
from aspectra.plans.queries import QUERIES
from aspectra.schema import ASPECTS

LABELS = ", ".join(f"{a} int" for a in ASPECTS)


@pytest.fixture
def small_bounds(monkeypatch):
    """Treat every word table as too large to broadcast."""
    monkeypatch.setattr(lookup, "small_count", lambda *a, **k: None)


@pytest.fixture(scope="module")
def skewed(spark):
    """10,000 reviews, nine in ten of them in one stratum."""
    rows = spark.range(10000).select(
        F.col("id").alias("review_id"),
        *[
            F.when(F.col("id") % 10 > 0, 1)
            .otherwise((F.col("id").bitwiseAND(1 << (4 + i)) > 0).cast("int"))
            .alias(a)
            for i, a in enumerate(ASPECTS)
        ],
    )
    return rows


def test_folds_are_balanced_under_skew(spark, skewed):
    out = folds.stratified_folds(skewed).withColumn("s", folds.stratum())
    assert out.count() == 10000
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert sizes == [2000] * 5
    spread = (
        out.groupBy("s").pivot("fold", list(range(5))).count().na.fill(0)
        .select(F.max(F.greatest(*map(str, range(5))) - F.least(*map(str, range(5)))))
    )
    assert spread.first()[0] <= 1


def test_folds_keep_rows_without_a_key(skewed):
    nulls = skewed.withColumn("review_id", F.when(F.col("review_id") > 10, F.col("review_id")))
    assert folds.train_val_test(nulls).count() == 10000


def test_folds_do_not_depend_on_cells_or_partitions(spark, skewed):
    base = folds.train_val_test(skewed).select("review_id", "split")
    other = folds.train_val_test(skewed.repartition(3), digits=1).select("review_id", "split")
    assert base.exceptAll(other).count() == 0
    assert Counter(r.split for r in base.collect()) == {"train": 8000, "val": 1000, "test": 1000}
    reseeded = folds.train_val_test(skewed, seed=1).select("review_id", "split")
    assert base.exceptAll(reseeded).count() > 0


def test_splits_keep_the_label_distribution(skewed):
    report = distribution.split_report(folds.train_val_test(skewed)).collect()
    share = {r.split: r.food / {"train": 8, "val": 1, "test": 1}[r.split] for r in report if r.score}
    assert max(share.values()) - min(share.values()) <= 8


def test_compounds(spark):
    text = "new york city is a new york state of new things , york"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "one"), (4, None)], "review_id long, text string")
    mined = compounds.mine_compounds(docs, min_count=2, min_pmi=None).collect()
    # 13 words: new 3, york 3, the pair 2. "one" is a word of the corpus too.
    assert [(r.first, r.second, r["count"]) for r in mined] == [("new", "york", 2)]
    assert mined[0].pmi == pytest.approx(np.log(2 * 13 / 9))
    lexicon = spark.createDataFrame([("new", "york"), ("york", "city")], "first string, second string")
    merged = compounds.merge_compounds(compounds.tag_compounds(docs, lexicon))
    assert [r.text for r in merged.orderBy("review_id").collect()] == [
        "new_york_city is a new_york state of new things york", "", "one", None,
    ]
    nothing = compounds.merge_compounds(compounds.tag_compounds(docs, lexicon.limit(0)))
    assert nothing.where("review_id = 1").first().text == text.replace(" ,", "")


def test_join_paths_give_the_same_result(spark, sf, small_bounds):
    docs = fx.lower_reviews(spark, sf)
    lexicon = spark.createDataFrame(
        [("of", "the"), ("in", "the"), ("de", "la"), ("the", "the")], "first string, second string"
    )
    words = spark.createDataFrame([("the",), ("of",), ("is",)], "word string")
    joined_tags = compounds.tag_compounds(docs, lexicon).select("review_id", "tokens", "tags")
    joined_text = tokens.remove_stopwords(docs, words, keep=["is"])
    terms = spark.createDataFrame([("the", "all the"), ("of", "from")], "short string, full string")
    joined_terms = tokens.expand_terms(docs, terms)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lookup, "small_count", lambda table: table.count())
        tags = compounds.tag_compounds(docs, lexicon).select("review_id", "tokens", "tags")
        text = tokens.remove_stopwords(docs, words, keep=["is"])
        expanded = tokens.expand_terms(docs, terms)
    assert joined_tags.count() == tags.count() == docs.count()
    assert tags.exceptAll(joined_tags).count() == 0
    assert joined_terms.columns == expanded.columns and joined_terms.count() == docs.count()
    assert expanded.exceptAll(joined_terms).count() == 0 < expanded.exceptAll(docs).count()
    assert text.select("review_id", "text").exceptAll(joined_text.select("review_id", "text")).count() == 0


def test_one_word_may_be_most_of_the_corpus(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("review_id"),
        F.concat(F.repeat(F.lit("hot "), 50), F.lit("w"), (F.col("id") % 7).cast("string"))
        .alias("text"),
    )
    counts = {r.word: r["count"] for r in tokens.token_counts(docs).collect()}
    assert counts["hot"] == 100000 and sum(counts.values()) == 102000
    mined = {(r.first, r.second): r["count"] for r in compounds.mine_compounds(docs, 20, None).collect()}
    assert mined["hot", "hot"] == 98000 and sum(mined.values()) == 100000


def test_mining_with_split_joins(spark, sf, small_bounds):
    docs = fx.lower_reviews(spark, sf)
    split = compounds.mine_compounds(docs)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lookup, "small_count", lambda table: table.count())
        broadcast = compounds.mine_compounds(docs)
    assert broadcast.exceptAll(split).count() == 0 and split.count() == broadcast.count() > 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_with_a_hot_key(spark, how):
    """Null, hot, listed and unlisted keys; the hot one alone is broadcast."""
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("k")
    )
    table = spark.createDataFrame([("hot", 1), ("7", 2), ("8", 5), ("none", 3)], "k string, v int")
    assert [r.k for r in lookup.heavy_keys(facts, ["k"], 8).collect()] == ["hot"]
    assert lookup.heavy_keys(facts.where("k <> 'hot'"), ["k"], 8).count() == 0
    plain, split = facts.join(table, "k", how), lookup.split_join(facts, table, ["k"], how)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.collect()), key=repr)


def test_word_table_bounds(spark):
    table = spark.createDataFrame([("aaaa",), ("bb",)], "word string")
    assert lookup.small_count(table) == 2
    assert lookup.small_count(table, max_entries=1) is None
    assert lookup.small_count(table, max_bytes=5) is None
    assert lookup.small_count(table.limit(0)) == 0


def test_encode(spark):
    docs = spark.createDataFrame(
        [(1, "b a b c"), (2, ""), (3, "zz b"), (4, "b b b b b b")], "review_id long, text string"
    )
    words = vocab.build_vocab(docs, 2)
    assert [(r.word, r.id) for r in words.orderBy("id").collect()] == [("b", 2), ("a", 3)]
    rows = vocab.encode(docs, words, max_len=4).orderBy("review_id").collect()
    assert [r.ids for r in rows] == [[2, 3, 2, 1], [0, 0, 0, 0], [1, 2, 0, 0], [2, 2, 2, 2]]
    assert [r["mask"] for r in rows] == [[1, 1, 1, 1], [0, 0, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1]]
    assert [r.n_tokens for r in rows] == [4, 0, 2, 6]
    odd = docs.union(spark.createDataFrame([(None, "b q"), (1, "a"), (9, None)], "review_id long, text string"))
    both = [vocab.encode(odd, words, max_len=4, large=large) for large in (False, True)]
    assert both[0].columns == both[1].columns
    assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect()))
    assert vocab.build_vocab(docs, lookup.MAX_ENTRIES + 1).count() == 4


def test_large_lists_give_the_same_rows(spark):
    """Null and repeated keys, null and empty texts, on both sides of the bounds."""
    docs = spark.createDataFrame(
        [(1, "the cat of york"), (1, "the dog"), (None, "the new york"), (None, None), (2, ""), (3, "the")],
        "review_id long, text string",
    )
    words = spark.createDataFrame([("the",), ("zebra",)], "word string")
    lexicon = spark.createDataFrame([("new", "york"), ("the", "cat")], "first string, second string")
    terms = spark.createDataFrame([("THE", "this"), ("york", "York City")], "short string, full string")
    raw = docs.withColumn("text", F.initcap("text"))
    for run in (
        lambda large: tokens.remove_stopwords(docs, words, large=large),
        lambda large: compounds.tag_compounds(docs, lexicon, large=large),
        lambda large: tokens.expand_terms(raw, terms, large=large),
    ):
        small, large = run(False), run(True)
        assert small.columns == large.columns
        assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
    with pytest.raises(ValueError, match="two full forms"):
        tokens.expand_terms(docs, terms.union(spark.createDataFrame([("the", "x")], terms.schema)))


def test_mining_counts_beyond_a_long_product(spark, monkeypatch):
    def scaled(counts):
        return counts.withColumn("count", F.col("count") * 10**11)

    monkeypatch.setattr(compounds, "materialise", scaled)
    docs = spark.createDataFrame([(1, "a b a b c")], "review_id long, text string")
    mined = compounds.mine_compounds(docs, 1, None).where("first = 'a'").first()
    assert mined.pmi == pytest.approx(np.log(2 * 5 / 4))


def test_vectors(spark):
    rows = [(1, 1, layer, [float(layer), -1.0]) for layer in range(6)] + [
        (1, 2, layer, [0.0, float(layer)]) for layer in range(2)
    ]
    df = spark.createDataFrame(rows, "doc_id long, pos int, layer int, vec array<float>")
    joined = {r.pos: r.vec for r in vectors.concat_last(df).collect()}
    assert joined[1] == [2, -1, 3, -1, 4, -1, 5, -1]
    assert joined[2] == [0, 0, 0, 1]
    assert vectors.concat_last(df, n_layers=6).where("pos = 1").first().vec == joined[1]
    tokens_ = df.where("layer = 1").select("doc_id", "pos", "vec").union(
        spark.createDataFrame([(1, 3, None)], "doc_id long, pos int, vec array<float>")
    )
    assert vectors.pool(tokens_).first().vec == [0.5, 0]
    assert vectors.pool(tokens_, "mean_max").first().vec == [0.5, 0, 1, 1]
    assert vectors.pool(tokens_, "last").first().vec == [0, 1]
    with pytest.raises(ValueError):
        vectors.pool(tokens_, "median")


def test_pooling_of_vectors_of_several_lengths(spark):
    """Tokens with too few layers, alone in their group and beside whole ones."""
    rows = [(1, 0, [1.0, 2.0, 3.0]), (1, 1, [3.0]), (1, 2, [5.0, 4.0]), (2, 0, [7.0]), (3, 0, None), (4, 0, [1.0, 1.0, 1.0]), (4, 1, [0.0, 3.0, -1.0])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, vec array<float>")
    got = {r.doc_id: r.vec for r in vectors.pool(df, "mean_max").collect()}
    assert got == {1: [3, 3, 3, 5, 4, 3], 2: [7, None, None, 7, None, None], 4: [0.5, 2, 0, 1, 3, 1]}
    assert {r.doc_id: r.vec for r in vectors.pool(df).collect()} == {k: v[:3] for k, v in got.items()}


def test_pooled_tokens_of_an_odd_number_of_vectors(spark, sf, tmp_path):
    """As the SQL gives them: the last token has two layers, alone in its document, or beside others."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    for n in (42, 50):
        path = str(tmp_path / str(n))
        table.where(F.col("vec_id") < n).write.parquet(f"{path}/embeddings.parquet")
        got = QUERIES["pool_tokens"](spark, path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
        want = {(doc, dim): value for doc, dim, value in con.execute(ORACLE["pool_tokens"]).fetchall()}
        assert {(r.doc_id, r.dim): r.value for r in got.collect()} == pytest.approx(want)


def test_mean_heads(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i, [float(x) for x in rng.normal(size=3) + 4 * (i % 3)], *[i % 3] * 6) for i in range(60)
    ]
    df = spark.createDataFrame(rows, f"review_id long, vec array<double>, {LABELS}")
    fitted = heads.fit_mean_heads(df)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    centres = np.stack([x[y == k].mean(axis=0) for k in range(3)])
    np.testing.assert_allclose(fitted.weights[:3], centres)
    assert np.isneginf(fitted.bias[3:6]).all()
    nulls = df.select("review_id", "vec").union(
        spark.createDataFrame([(99, None)], "review_id long, vec array<double>")
    )
    scored = heads.score_heads(nulls, fitted)
    assert scored.where("review_id = 99").first().logits is None
    got = {
        r.review_id: r.pred
        for r in heads.head_classes(scored, "review_id", fitted).where("aspect = 'food'").collect()
    }
    with pytest.raises(Exception, match="out of range"):
        heads.fit_mean_heads(df.withColumn("food", F.lit(7)))
    uneven = df.withColumn("vec", F.when(F.col("review_id") == 5, F.array(F.lit(1.0))).otherwise(F.col("vec")))
    with pytest.raises(Exception, match="3 components"):
        heads.score_heads(uneven, fitted).collect()
    nearest = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[i] for i in range(60)] == nearest.tolist()


def test_pairs_are_counted_in_slices_and_looked_up_by_batch(spark, monkeypatch):
    """No row per place in the plan of a long list; slices and batches of a few rows change nothing."""
    docs = spark.range(300).select(F.col("id").alias("review_id"), F.concat_ws(" ", F.lit("new york"), F.col("id") % 9, F.lit("york city new york")).alias("text"))
    lexicon = spark.createDataFrame([("new", "york"), ("york", "city"), ("8", "york")], "first string, second string")
    whole = compounds.tag_compounds(docs, lexicon), compounds.mine_compounds(docs, 20, None)
    whole = [sorted(map(repr, df.collect())) for df in whole]
    tagged = compounds.tag_compounds(docs, lexicon, large=True)
    assert "Generate" not in tagged._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(runs, "BATCH", 3)
    monkeypatch.setattr(runs, "SLICE", 64)
    parts = compounds.tag_compounds(docs, lexicon, large=True), compounds.mine_compounds(docs, 20, None)
    assert whole == [sorted(map(repr, df.collect())) for df in parts]
    assert any(r.count("'I'") == 4 for r in whole[0])


def test_long_word_lists_move_no_words(spark):
    """Terms, stop words and ids are looked up by distinct words of a batch: no row for each word in the plan."""
    docs = spark.createDataFrame([(1, "the  Cat ΟΔΟΣ of York "), (2, ""), (3, None), (None, " the")], "review_id long, text string")
    terms = spark.createDataFrame([("THE", "this"), ("οδος", "Street"), ("york", None), ("of", "of the")], "short string, full string")
    words, ids = terms.select(F.lower("short").alias("word")), spark.createDataFrame([("the", 2), ("of", 3)], "word string, id int")
    for large in (False, True):
        for df in (tokens.expand_terms(docs, terms, large=large), tokens.remove_stopwords(docs, words, large=large), vocab.encode(docs, ids, 3, large=large)):
            assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
        got = {r.review_id: r.text for r in tokens.expand_terms(docs, terms, large=large).collect()}
        assert got == {1: "this  Cat Street of the York ", 2: "", 3: None, None: " this"}
