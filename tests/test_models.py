"""Joint and closed-form heads against plain versions; raters, saved and loaded, in tables and streams."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.functions.labels import nll
from aspectra.operators import joint, metrics, phrases
from aspectra.plans import bayes, fixtures as fx, models, rater
from aspectra.plans.prepare import prepare_text
from aspectra.schema import ASPECTS, METRICS
from aspectra.streaming.reviews import predict_stream, read_review_stream

WORD = re.compile(r"\w+")


# --- joint heads ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 7))
    y = [[None if rng.random() < 0.1 else int(v) for v in row] for row in rng.integers(0, 6, size=(150, 6))]
    y[3] = [None] * 6
    for row in y:
        row[5] = None if row[5] is None else row[5] % 2
    rows = [(i, x[i].tolist(), *y[i]) for i in range(150)]
    schema = "review_id long, vec array<double>, " + ", ".join(f"{a} int" for a in ASPECTS)
    return spark.createDataFrame(rows, schema).repartition(5), x, y


def plain_fit(x, y, epochs, rate, momentum, decay):
    """Gradient descent with momentum on the summed mean losses of six heads."""
    w, b = np.zeros((6, x.shape[1], 6)), np.zeros((6, 6))
    vw, vb, history = np.zeros_like(w), np.zeros_like(b), []
    for _ in range(epochs):
        losses = []
        for a in range(6):
            here = [i for i in range(len(x)) if y[i][a] is not None]
            z = x[here] @ w[a] + b[a]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            label = [y[i][a] for i in here]
            losses.append(-np.mean(np.log(p[range(len(here)), label])))
            p[range(len(here)), label] -= 1
            vw[a] = momentum * vw[a] - rate * (x[here].T @ p / len(here) + decay * w[a])
            vb[a] = momentum * vb[a] - rate * p.mean(axis=0)
            w[a] += vw[a]
            b[a] += vb[a]
        history.append(losses)
    return w, b, history


def test_joint_fit_is_the_plain_one(vectors, monkeypatch):
    df, x, y = vectors
    monkeypatch.setattr(joint, "BLOCK", 50)
    start = joint.JointHeads(joint.VectorFeatures(7))
    rows = joint.labelled_rows(df, start, "vec")
    assert rows.count() == 149
    fit = joint.carry_on(rows, start, 8, rate=0.7, momentum=0.8, decay=0.01)
    w, b, history = plain_fit(x, y, 8, 0.7, 0.8, 0.01)
    assert np.allclose(fit.weights.reshape(7, 6, 6).transpose(1, 0, 2), w)
    assert np.allclose(fit.bias.reshape(6, 6), b)
    assert np.allclose([[h[a] for a in ASPECTS] for h in fit.losses], history)
    totals = [sum(h) for h in history]
    assert totals == sorted(totals, reverse=True) and start.epoch == 0
    assert joint.loss_history(fit, df.sparkSession).count() == 48


def test_joint_fit_goes_on_where_it_stopped(vectors):
    df, _, _ = vectors
    start = joint.JointHeads(joint.VectorFeatures(7))
    rows = joint.labelled_rows(df, start, "vec")
    seen = []
    once = joint.carry_on(rows, start, 5, 0.5)
    twice = joint.carry_on(rows, joint.carry_on(rows, start, 2, 0.5), 3, 0.5, after=lambda h: seen.append(h.epoch))
    assert np.allclose(once.weights, twice.weights) and once.epoch == twice.epoch == 5 and seen == [3, 4, 5]


def test_joint_pass_is_one_scan_merged_by_block(vectors):
    df, _, _ = vectors
    start = joint.JointHeads(joint.VectorFeatures(7))
    rows = joint.labelled_rows(df, start, "vec")
    run = joint._gradient_blocks(start.features, start.weights, start.bias, 6, 6)
    merged = rows.mapInArrow(run, "block int, sums array<double>").groupBy("block").agg(F.count("*"))
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_joint_refuses_bad_input(vectors):
    df, _, _ = vectors
    start = joint.JointHeads(joint.VectorFeatures(7))
    with pytest.raises(Exception, match="out of range"):
        joint.labelled_rows(df.withColumn("food", F.lit(6)), start, "vec")
    with pytest.raises(ValueError, match="no labelled rows"):
        joint.carry_on(joint.labelled_rows(df.where("false"), start, "vec"), start, 1)
    short = joint.labelled_rows(df.withColumn("vec", F.slice("vec", 1, 3)), start, "vec")
    with pytest.raises(Exception, match="7 components"):
        joint.carry_on(short, start, 1)


def test_word_features_weigh_rare_words(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, None), (4, "")], "review_id long, text string")
    features = joint.word_features(docs, size=1 << 12)
    ids = {w: i for w, i in docs.select(F.explode(F.arrays_zip(F.array(*map(F.lit, "abcz")).alias("w"), joint.hashed_words(F.lit("a b c z"), 1 << 12).alias("i")))).select("col.w", "col.i").collect()}
    rarity = {w: features.rarity[i] for w, i in ids.items()}
    assert rarity["a"] == pytest.approx(math.log(5 / 3)) and rarity["b"] == pytest.approx(math.log(5 / 2)) and rarity["z"] == pytest.approx(math.log(5))
    import pyarrow as pa

    row, word, value, n = features.rows([pa.array([[ids["a"], ids["a"], ids["b"]], None, [], [ids["c"]]], pa.list_(pa.int32()))])
    assert n == 4 and row.tolist() == [0, 0, 3] and np.bincount(row, value**2, 4).tolist() == pytest.approx([1, 0, 0, 1])
    by_word = dict(zip(word.tolist(), value.tolist()))
    assert by_word[ids["a"]] / by_word[ids["b"]] == pytest.approx(2 * rarity["a"] / rarity["b"])


# --- closed-form heads ---------------------------------------------------------------------------


def test_bayes_heads_are_the_plain_ones(spark):
    rows = [(1, "good good room", 5, 0), (2, "bad room", 1, None), (3, None, 1, 2), (4, "", 0, 2), (5, "food good", 5, 2), (5, "food good", 5, 2)]
    train = spark.createDataFrame(rows, "review_id long, text string, x int, y int")
    heads = bayes.fit_bayes_heads(train, ("x", "y"), min_count=2)
    vocab = {w for w, n in Counter(w for r in rows for w in WORD.findall(r[1] or "")).items() if n >= 2}
    assert {r.word for r in heads.words.collect()} == vocab == {"good", "room", "food"}
    base, weight = [], {w: [] for w in vocab}
    for a in (2, 3):
        rated = [r for r in rows if r[a] is not None]
        for k in range(6):
            inside = [r for r in rated if r[a] == k]
            counts = Counter(w for r in inside for w in WORD.findall(r[1] or "") if w in vocab)
            base.append(round(1e6 * math.log((len(inside) + 1) / (len(rated) + 6))))
            for w in vocab:
                weight[w].append(round(1e6 * math.log((counts[w] + 1) / (sum(counts.values()) + len(vocab)))))
    assert list(heads.base) == base and {r.word: r.weights for r in heads.words.collect()} == weight
    got = heads.logits(train.select("review_id", "text", F.lit("kept").alias("n")), "text").collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"review_id", "text", "n", "x_logits", "y_logits"}
    for r in got:
        sums = [b + sum(weight[w][i] for w in WORD.findall(r.text or "") if w in vocab) for i, b in enumerate(base)]
        assert r.x_logits + r.y_logits == pytest.approx([s / 1e6 for s in sums])


def test_bayes_join_paths_give_the_same_rows(spark, sf, monkeypatch):
    from aspectra.operators import lookup

    data = fx.truth(spark, sf)
    heads = bayes.fit_bayes_heads(data)
    small = models.predict(data, heads).collect()
    monkeypatch.setattr(lookup, "small_count", lambda *a, **k: None)
    assert sorted(map(repr, models.predict(data, heads).collect())) == sorted(map(repr, small))


# --- raters --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def raw(spark, sf):
    return fx.truth(spark, sf).withColumnRenamed("text", "review").cache()


def preparation(spark, raw):
    cleaned = prepare_text(raw, text="review").withColumnRenamed("review", "text")
    mined = phrases.mine_phrases(cleaned, 10, 3).where("score >= 1").select("phrase", "n")
    path_rows = [tuple(r) for r in mined.collect()]
    assert any(n == 3 for _, n in path_rows)
    lexicon = spark.createDataFrame(path_rows, "phrase string, n int")
    return rater.Preparation(rules={"von": "from", "der": "jener"}, whitespace="space", stop_words=("la",), keep=(), lexicon=lexicon)


FITS = {
    "joint": (models.fit_joint_heads, {"num_features": 256, "epochs": 4}),
    "bayes": (bayes.fit_bayes_heads, {"min_count": 2}),
    "logistic": (models.fit_aspect_heads, {"num_features": 256, "max_iter": 3}),
}


@pytest.mark.parametrize("kind", sorted(FITS))
def test_raters_from_raw_text(spark, raw, tmp_path, kind):
    """Raw and prepared input, the loaded copy and the stream give the same classes, with compounds on."""
    fit, settings = FITS[kind]
    made = preparation(spark, raw)
    own = rater.fit_rater(raw, made, fit, **settings)
    assert own.model.kind == kind and tuple(own.model.aspects) == ASPECTS
    keys = ["review_id", *ASPECTS]
    want = Counter(tuple(r) for r in own.predict(raw).select(*keys).collect())
    assert sum(want.values()) == raw.count() and len({k[1:] for k in want}) > 1
    prepared = made(raw)
    assert prepared.where(F.col("review").contains("_")).count() > 0
    assert Counter(tuple(r) for r in own.predict(prepared, prepared=True).select(*keys).collect()) == want
    own.save(str(tmp_path / "rater"))
    loaded = rater.TextRater.load(spark, str(tmp_path / "rater"))
    assert Counter(tuple(r) for r in loaded.predict(raw).select(*keys).collect()) == want
    report, mean = loaded.evaluate(raw)
    assert report.count() == 6 and 0 < mean.first().final_score <= 1
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        stream = read_review_stream(spark, str(tmp_path / "in"), max_files=2)
        predict_stream(stream, loaded, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 2
    assert Counter(tuple(r) for r in got.select(*keys).collect()) == want


def test_a_loaded_joint_fit_can_be_carried_on(spark, raw, tmp_path):
    model = models.fit_joint_heads(raw, text="review", num_features=64, epochs=2, rate=1.0)
    model.save(str(tmp_path / "m"))
    loaded = models.JointModel.load(spark, str(tmp_path / "m"))
    rows = joint.labelled_rows(raw, model.fit, "review")
    a, b = (joint.carry_on(rows, m.fit, 2, rate=1.0) for m in (model, loaded))
    assert np.allclose(a.weights, b.weights) and a.losses == b.losses and b.epoch == 4


def test_joint_model_learns(raw):
    model = models.fit_joint_heads(raw, text="review", num_features=512, epochs=25)
    losses = [sum(h[a] for a in ASPECTS) for h in model.fit.losses]
    assert losses[0] == pytest.approx(6 * math.log(6)) and losses[-1] < 0.6 * losses[0]
    seen = models.loss_rows(raw, model, text="review").agg(F.avg(nll(F.col("logits"), F.col("label"))).alias("x")).first().x
    assert 6 * seen < losses[-1] + 0.01


# --- stored counts -------------------------------------------------------------------------------


def test_reports_from_stored_counts(spark, tmp_path):
    rows = [(f"r{i % 2}", "val", f"d{i % 3}", a, (i * 7 + k) % 6, (i * 5 + 2 * k) % 6) for i in range(90) for k, a in enumerate(ASPECTS[:5])]
    pairs = spark.createDataFrame(rows, "run string, split string, day string, aspect string, truth int, pred int")
    path = str(tmp_path / "states")
    for day in ("d0", "d1", "d2"):
        metrics.add_state(pairs.where(F.col("day") == day), path)
    states = spark.read.parquet(path)
    for by in (("aspect",), ("run", "aspect"), ("run", "split", "day", "aspect")):
        want = metrics.score_report(pairs, by).select(*by, *METRICS)
        got = metrics.merged_report(states, by).select(*by, *METRICS)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert got.count() % 6 == 0
    # A day that is corrected is replaced; the others stay.
    fixed = pairs.withColumn("pred", F.when(F.col("day") == "d1", F.col("truth")).otherwise(F.col("pred")))
    metrics.replace_state(fixed.where("day = 'd1'"), path)
    spark.catalog.refreshByPath(path)
    got = metrics.merged_report(spark.read.parquet(path)).select("aspect", *METRICS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, metrics.score_report(fixed).select("aspect", *METRICS).collect()))


def test_null_groups_have_all_aspects(spark):
    pairs = spark.createDataFrame([(None, "food", 1, 1), ("x", "food", 0, 1)], "run string, aspect string, truth int, pred int")
    assert metrics.score_report(pairs, ("run", "aspect")).count() == 12
    assert metrics.score_report(pairs.where("false")).count() == 6
