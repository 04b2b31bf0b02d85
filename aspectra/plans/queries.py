"""The registered queries: every operator over the whole of its tables.

Array results are written out as rows or joined text, and floats rounded to six digits, so that two
engines can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aspectra.functions import labels as L, text as X
from aspectra.operators import (
    balance,
    compounds,
    distribution,
    folds,
    heads,
    history,
    joint,
    labels,
    loss,
    metrics,
    phrases,
    position,
    subwords,
    tokens,
    vectors,
    vocab,
)
from aspectra.plans import bayes, fixtures as fx, models, prepare, rater
from aspectra.schema import ASPECTS, METRICS
from aspectra.session import materialise, new_table_path, stored
from aspectra.sources import reviews as reviews_io
from aspectra.sources.words import read_word_list

VOCAB_SIZE = 5000
MAX_LEN = 128
STOP_WORDS = 20
MIN_PAIR_COUNT = 20
MIN_PMI = 1.0
LONGEST_PHRASE = 4
MIN_WORD_COUNT = 5
JOINT_EPOCHS = 4
JOINT_RATE = 0.5
JOINT_MOMENTUM = 0.9
SUBWORD_MERGES = 16
SHIFT_WINDOW = 50
SHIFT_REACH = 16
# The default abbreviations are Vietnamese and do not occur in the test text; these do.
RULES = {**X.ABBREVIATIONS, "von": "from", "un": "one", "th": "this thing", "der": "jener"}

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def as_rows(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode(vec).alias("dim", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


# --- sources and sinks ---------------------------------------------------------------------------


@query
def review_source(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "reviews")
    reviews_io.write_reviews(fx.truth(spark, sf), path)
    return reviews_io.read_reviews(spark, path, id_col="review_id")


@query
def split_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "splits")
    reviews_io.write_splits(folds.train_val_test(fx.truth(spark, sf)), path)
    parts = [
        reviews_io.read_split(spark, path, s, id_col="review_id").withColumn("split", F.lit(s))
        for s in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def review_source_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews written with faults in some rows: how many are read, and how many are set aside for what."""
    path = new_table_path(spark, "faulty-reviews")
    i = F.col("review_id")
    rows = fx.truth(spark, sf).select("review_id", F.col("text").alias("review"), *[F.col(a).cast("string").alias(a) for a in ASPECTS])
    faults = {
        "lodging": F.when(i % 20 == 3, F.concat("lodging", F.lit(".5"))).otherwise(F.col("lodging")),
        "food": F.when(i % 20 == 5, "none").otherwise(F.col("food")),
        "shopping": F.when(i % 20 == 7, "9").when(i % 20 == 3, "-1").otherwise(F.col("shopping")),
    }
    reviews_io.write_reviews(rows.withColumns(faults).where(i % 20 != 9), path)
    reviews_io.write_reviews(rows.drop("shopping").where(i % 20 == 9), path, mode="append")
    good, rejects = reviews_io.split_reviews(spark, path, id_col="review_id", classes=L.CLASSES)
    kept = good.agg(F.lit("none").alias("reason"), F.lit(None).cast("string").alias("column"), F.count("*").alias("rows"))
    return reviews_io.reject_counts(rejects).unionByName(kept)


# --- label projections ---------------------------------------------------------------------------


@query
def feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_xy(fx.truth(spark, sf))[0]


@query
def label_projection(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_xy(fx.truth(spark, sf))[1]


@query
def aspect_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return fx.long_truth(spark, sf)


@query
def one_hot_encode(spark: SparkSession, sf: str) -> DataFrame:
    coded = labels.one_hot(fx.truth(spark, sf))
    return coded.select("review_id", F.array_join("one_hot", ",").alias("one_hot"))


@query
def one_hot_decode(spark: SparkSession, sf: str) -> DataFrame:
    coded = labels.one_hot(fx.truth(spark, sf)).select("review_id", "one_hot")
    return labels.one_hot_decode(coded)


# --- text preparation ----------------------------------------------------------------------------


@query
def text_lower(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lower_reviews(spark, sf)


@query
def text_punct(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reviews(spark, sf).withColumn("text", X.strip_punct(F.col("text")))


@query
def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reviews(spark, sf).withColumn("text", X.strip_numbers(F.col("text")))


@query
def text_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reviews(spark, sf).withColumn("text", X.keep_chars(F.col("text")))


@query
def text_allowlist_spaced(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.keep_chars(F.col("text"), whitespace="space")
    return fx.reviews(spark, sf).withColumn("text", kept)


@query
def abbrev_expand(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reviews(spark, sf).withColumn("text", X.clean_text(F.col("text"), rules=RULES))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES.items()), "short string, full string")


@query
def abbrev_expand_table(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.prepare_text(fx.reviews(spark, sf), rules=rule_table(spark))


@query
def abbrev_expand_large(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = prepare.prepare_text(fx.reviews(spark, sf), rules={})
    return tokens.expand_terms(cleaned, rule_table(spark), large=True)


@query
def abbrev_expand_raw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reviews(spark, sf).withColumn("text", X.expand_abbrev_raw(F.col("text"), RULES))


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(fx.lower_reviews(spark, sf))


def stop_list(docs: DataFrame) -> DataFrame:
    path = new_table_path(docs.sparkSession, "stop-words")
    tokens.top_words(tokens.token_counts(docs), STOP_WORDS).select("word").write.text(path)
    return read_word_list(docs.sparkSession, path)


@query
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    return tokens.remove_stopwords(docs, stop_list(docs), keep=["is"])


@query
def stopword_filter_large(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    return tokens.remove_stopwords(docs, stop_list(docs), keep=["is"], large=True)


def mined_lexicon(docs: DataFrame) -> DataFrame:
    return materialise(compounds.mine_compounds(docs, MIN_PAIR_COUNT, MIN_PMI))


@query
def compound_mine(spark: SparkSession, sf: str) -> DataFrame:
    mined = compounds.mine_compounds(fx.lower_reviews(spark, sf), MIN_PAIR_COUNT, MIN_PMI)
    return rounded(mined, "pmi")


@query
def compound_tag(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    return tag_rows(compounds.tag_compounds(docs, mined_lexicon(docs)))


@query
def compound_tag_large(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    return tag_rows(compounds.tag_compounds(docs, mined_lexicon(docs), large=True))


def tag_rows(tagged: DataFrame) -> DataFrame:
    return tagged.select(
        "review_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.filter("tags", lambda t: t == "I")).alias("n_inside"),
        F.array_join("tags", "").alias("tags"),
    )


@query
def compound_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    return compounds.merge_compounds(compounds.tag_compounds(docs, mined_lexicon(docs)))


def mined_phrases(docs: DataFrame) -> DataFrame:
    return phrases.mine_phrases(docs, MIN_PAIR_COUNT, LONGEST_PHRASE)


@query
def compound_mine_long(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of two to four words."""
    return rounded(mined_phrases(fx.lower_reviews(spark, sf)), "score")


@query
def compound_merge_list(spark: SparkSession, sf: str) -> DataFrame:
    """Longest match of the mined phrases whose words belong together, three and four words included."""
    docs = fx.lower_reviews(spark, sf)
    listed = stored(mined_phrases(docs).where(F.col("score") >= MIN_PMI).select("phrase", "n"), "phrase-list")
    return phrases.merge_phrases(docs, listed, LONGEST_PHRASE)


@query
def compound_best_path(spark: SparkSession, sf: str) -> DataFrame:
    """The most likely division of every text into words and mined phrases."""
    docs = fx.lower_reviews(spark, sf)
    scores = stored(phrases.word_scores(docs, mined_phrases(docs).where(F.col("score") >= MIN_PMI)), "phrase-scores")
    return phrases.merge_phrases(docs, scores, LONGEST_PHRASE, best=True)


@query
def prepare_text(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.prepare_text(fx.reviews(spark, sf))


@query
def prepare_text_full(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.reviews(spark, sf)
    lexicon = mined_lexicon(prepare.prepare_text(docs))
    return prepare.prepare_text(docs, lexicon, stop_words=list(fx.KEYWORDS.values()), keep=["is"])


@query
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.build_vocab(fx.lower_reviews(spark, sf), VOCAB_SIZE)


@query
def sequence_encode(spark: SparkSession, sf: str) -> DataFrame:
    return coded_rows(spark, sf, large=False)


@query
def sequence_encode_large(spark: SparkSession, sf: str) -> DataFrame:
    return coded_rows(spark, sf, large=True)


def coded_rows(spark: SparkSession, sf: str, large: bool) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    words = materialise(vocab.build_vocab(docs, VOCAB_SIZE))
    coded = vocab.encode(docs, words, MAX_LEN, large=large)
    return coded.select(
        "review_id",
        "n_tokens",
        F.array_join("ids", " ").alias("ids"),
        F.array_join("mask", "").alias("mask"),
    )


@query
def vocab_subword(spark: SparkSession, sf: str) -> DataFrame:
    """The first merges of a subword vocabulary over the words of all texts."""
    return subwords.learn_merges(fx.lower_reviews(spark, sf), SUBWORD_MERGES)


@query
def sequence_encode_subword(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.lower_reviews(spark, sf)
    counts = stored(tokens.token_counts(docs), "word-counts")
    merges = subwords.learn_merges(docs, SUBWORD_MERGES, counts=counts)
    vocab_rows = stored(subwords.subword_vocab(docs, merges, VOCAB_SIZE, counts=counts), "subwords")
    coded = subwords.encode_subwords(docs, merges, vocab_rows, MAX_LEN)
    return coded.select("review_id", "n_pieces", F.array_join("ids", " ").alias("ids"), F.array_join("mask", "").alias("mask"))


# --- splits and distributions --------------------------------------------------------------------


@query
def stratified_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.stratified_folds(fx.truth(spark, sf).drop("text")).select("review_id", "fold")


@query
def train_val_test(spark: SparkSession, sf: str) -> DataFrame:
    return folds.train_val_test(fx.truth(spark, sf).drop("text")).select("review_id", "split")


@query
def iterative_fold(spark: SparkSession, sf: str) -> DataFrame:
    """How evenly five folds, dealt out label by label, hold every label."""
    return balance.label_spread(balance.iterative_folds(fx.truth(spark, sf).drop("text")))


@query
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return distribution.label_distribution(fx.truth(spark, sf))


@query
def split_report(spark: SparkSession, sf: str) -> DataFrame:
    return distribution.split_report(folds.train_val_test(fx.truth(spark, sf).drop("text")))


# --- decoding ------------------------------------------------------------------------------------


@query
def head_softmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.head_rows(spark, sf).withColumn("p", L.softmax(F.col("logits")))
    return as_rows(rows, ["review_id", "aspect"], "p")


@query
def head_argmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.head_rows(spark, sf)
    return rows.select("review_id", "aspect", L.argmax_class(F.col("logits")).alias("pred"))


@query
def head_top_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.head_rows(spark, sf).withColumn("p", L.softmax(F.col("logits")))
    return rows.select(
        "review_id",
        "aspect",
        L.argmax_class(F.col("p")).alias("pred"),
        F.round(F.array_max("p"), 6).alias("prob"),
    )


@query
def threshold_decode(spark: SparkSession, sf: str) -> DataFrame:
    decoded = [L.threshold_decode(F.col("logits"), i).alias(a) for i, a in enumerate(ASPECTS)]
    return fx.flat_scores(spark, sf).select("review_id", *decoded)


# --- metrics -------------------------------------------------------------------------------------


@query
def align_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.align_report(metrics.align(fx.labelled_truth(spark, sf), fx.prediction(spark, sf)))


@query
def aligned_scores(spark: SparkSession, sf: str) -> DataFrame:
    aligned = metrics.align(fx.labelled_truth(spark, sf), fx.prediction(spark, sf))
    return rounded(metrics.score_report(metrics.matched_pairs(aligned)), *METRICS)


@query
def align_positional(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th truth row with the n-th prediction; some reviews have no prediction."""
    return position.align_by_position(fx.truth(spark, sf), fx.prediction(spark, sf), "review_id")


@query
def position_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Where reviews whose sixth letter is an e went missing, by the texts of both sides."""
    docs = fx.reviews(spark, sf)
    left = docs.where(F.substring("text", 6, 1) != "e")
    return position.shift_report(docs, left, "review_id", ["text"], window=SHIFT_WINDOW, reach=SHIFT_REACH)


@query
def presence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.presence_counts(fx.pairs(spark, sf))


@query
def presence_prf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.presence_prf(fx.pairs(spark, sf)), *METRICS[:3])


@query
def rating_r2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.rating_r2(fx.pairs(spark, sf)), "r2_score")


@query
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.score_report(fx.pairs(spark, sf)), *METRICS)


@query
def score_report_large(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.score_report(fx.large_pairs(spark, sf)), *METRICS)


@query
def score_report_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Three loads of pairs, each stored as counts by day; the report comes from the stored counts."""
    path = new_table_path(spark, "metric-states")
    pairs = fx.large_pairs(spark, sf, ("l_returnflag", "l_shipdate")).withColumnsRenamed({"l_returnflag": "run", "l_shipdate": "day"})
    for flag in ("A", "N", "R"):
        metrics.add_state(pairs.where(F.col("run") == flag), path, ("run", "day", "aspect"), "run")
    return rounded(metrics.merged_report(spark.read.parquet(path)), *METRICS)


@query
def score_report_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """One aspect without any pair still has its row, and counts in the mean."""
    return with_mean(metrics.score_report(fx.pairs(spark, sf).where(F.col("aspect") != ASPECTS[1])))


def with_mean(report: DataFrame) -> DataFrame:
    mean = metrics.macro_report(report).select(F.lit("mean").alias("aspect"), *METRICS)
    return rounded(report.unionByName(mean), *METRICS)


@query
def macro_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.macro_report(metrics.score_report(fx.pairs(spark, sf))), *METRICS)


@query
def head_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(loss.head_loss(fx.head_rows(spark, sf)), "loss")


@query
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(loss.cross_entropy(fx.head_rows(spark, sf)), "loss")


@query
def batch_mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.head_rows(spark, sf).withColumnRenamed("review_id", "ordinal")
    return rounded(loss.batch_mean_loss(rows, size=16), "loss")


@query
def dense_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return reviews_io.with_ordinal(fx.reviews(spark, sf).select("review_id"), "review_id")


@query
def batch_mean_loss_gapped(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with gaps, numbered without them before batches are cut."""
    rows = fx.head_rows(spark, sf).withColumn("review_id", F.col("review_id") * 7 + 3)
    ids = reviews_io.with_ordinal(rows.select("review_id").distinct(), "review_id")
    return rounded(loss.batch_mean_loss(rows.join(ids, "review_id"), size=16), "loss")


# --- vectors, heads and model selection ----------------------------------------------------------


@query
def concat_layers(spark: SparkSession, sf: str) -> DataFrame:
    return as_rows(vectors.concat_last(fx.layers(spark, sf), k=4), ["doc_id", "pos"], "vec")


@query
def pool_mean(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vectors.pool(fx.vectors(spark, sf), "mean", "label", "vec_id")
    return as_rows(pooled, ["label"], "vec")


@query
def pool_mean_max(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vectors.pool(fx.vectors(spark, sf), "mean_max", "label", "vec_id")
    return as_rows(pooled, ["label"], "vec")


@query
def pool_last(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vectors.pool(fx.vectors(spark, sf), "last", "label", "vec_id")
    return as_rows(pooled, ["label"], "vec")


@query
def pool_tokens(spark: SparkSession, sf: str) -> DataFrame:
    joined = vectors.concat_last(fx.layers(spark, sf), k=4)
    # A token with fewer than four layers leaves components without a value.
    return as_rows(vectors.pool(joined, "mean_max"), ["doc_id"], "vec").where(F.col("value").isNotNull())


@query
def head_scores(spark: SparkSession, sf: str) -> DataFrame:
    # Stored once: the split reads its rows twice.
    rated = folds.train_val_test(materialise(fx.rated_vectors(spark, sf)))
    fitted = heads.fit_mean_heads(rated.where(F.col("split") == "train"))
    everything = fx.vectors(spark, sf).withColumnRenamed("vec_id", "review_id")
    scored = heads.head_classes(heads.score_heads(everything, fitted), "review_id", fitted)
    return scored.select(
        "review_id", "aspect", "pred", F.round(F.array_max("logits"), 6).alias("top_logit")
    )


@query
def evaluate_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Class-mean heads fitted on the training split, scored on the rest."""
    rated = folds.train_val_test(materialise(fx.rated_vectors(spark, sf)))
    fitted = heads.fit_mean_heads(rated.where(F.col("split") == "train"))
    held = rated.where(F.col("split") != "train")
    classes = heads.head_classes(heads.score_heads(held, fitted), "review_id", fitted)
    wide = classes.groupBy("review_id").pivot("aspect", list(ASPECTS)).agg(F.first("pred"))
    return with_mean(metrics.score_report(metrics.matched_pairs(metrics.align(held, wide))))


@query
def joint_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of every head in the first passes of a joint fit over the rated vectors."""
    start = joint.JointHeads(joint.VectorFeatures(fx.VECTOR_SIZE))
    rows = joint.labelled_rows(fx.rated_vectors(spark, sf), start, "vec")
    fitted = joint.carry_on(rows, start, JOINT_EPOCHS, JOINT_RATE, JOINT_MOMENTUM)
    return rounded(joint.loss_history(fitted, spark), "loss")


def _fitted(spark: SparkSession, sf: str):
    # A folder per split, so that the fit reads the columns and rows it needs.
    path = new_table_path(spark, "raw-splits")
    reviews_io.write_splits(folds.train_val_test(fx.truth(spark, sf)), path, "parquet")
    data = spark.read.parquet(path)
    fit = {"fit": bayes.fit_bayes_heads, "text": "text", "min_count": MIN_WORD_COUNT}
    return rater.fit_rater(data.where(F.col("split") == "train"), **fit), data


@query
def aspect_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Heads fitted on raw reviews of the training split, scored on those of the validation split."""
    fitted, data = _fitted(spark, sf)
    report, _ = fitted.evaluate(data.where(F.col("split") == "val"), text="text")
    return rounded(report, *METRICS)


@query
def batch_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of all raw reviews, and the probability of each."""
    fitted, data = _fitted(spark, sf)
    return rounded(fitted.predict(data, text="text"), *[f"{a}_prob" for a in ASPECTS])


@query
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.best_epoch(fx.history(spark, sf)), "mean_score")


@query
def variant_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.rank_variants(fx.history(spark, sf)), "mean_score")
