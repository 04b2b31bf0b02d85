"""Files, stored tables, models and streams."""

import math

import pytest
from pyspark.sql import functions as F

from aspectra import session
from aspectra.operators import folds, history, loss
from aspectra.plans import fixtures as fx, models
from aspectra.plans.prepare import prepare_text
from aspectra.schema import ASPECT_HEADERS, ASPECTS, METRICS, TEXT_HEADER
from aspectra.sources import reviews as io
from aspectra.streaming.reviews import predict_stream, read_review_stream


def test_csv_with_source_headers(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        ",".join([TEXT_HEADER, *ASPECT_HEADERS]) + '\n"Đẹp, ""sạch""\ntốt ",5,0,1,2,3,4\n\\N,0,0,0,0,0,0\n'
        '"",1,1,1,1,1,1\n',
        encoding="utf-8",
    )
    df = io.read_reviews(spark, str(path))
    assert df.columns == ["review", *ASPECTS]
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert ('Đẹp, "sạch"\ntốt ', 5, 0, 1, 2, 3, 4) in rows
    assert (None, 0, 0, 0, 0, 0, 0) in rows and ("", 1, 1, 1, 1, 1, 1) in rows
    assert io.with_review_id(df).select("review_id").distinct().count() == 3


def _csv(tmp_path, *lines):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.csv"
    path.write_text(",".join([TEXT_HEADER, *ASPECT_HEADERS]) + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv_scores_as_numbers(spark, tmp_path):
    df = io.read_reviews(spark, _csv(tmp_path, "good,3.0,0,1.0,2,3,4", "bad,\\N,0,1,2,3,4"))
    assert [tuple(r)[1:3] for r in df.orderBy("review").collect()] == [(None, 0), (3, 0)]
    assert df.dtypes[1:] == [(a, "int") for a in ASPECTS]
    for line in ("x,3.5,0,1,2,3,4", "x,3,0,1", "x,3,0,1,2,3,four", "x,1,2,3,4,5,6,7"):
        with pytest.raises(Exception):
            io.read_reviews(spark, _csv(tmp_path, "fine,1,1,1,1,1,1", line)).select("review", "shopping").collect()
            io.read_reviews(spark, _csv(tmp_path, "fine,1,1,1,1,1,1", line)).collect()


def test_null_marks_survive(spark, tmp_path):
    texts = ["\\N", "\\\\N", None, "", "a\\N", "\\N\n"]
    df = spark.createDataFrame([(i, t, *[1] * 6) for i, t in enumerate(texts)], io.review_schema(ASPECTS, "review_id"))
    io.write_reviews(df, str(tmp_path / "marks"))
    back = io.read_reviews(spark, str(tmp_path / "marks"), id_col="review_id")
    assert [r.review for r in back.orderBy("review_id").collect()] == texts


def test_ordinals_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 13 % 1009).alias("k"), "id").repartition(5)
    rows = io.with_ordinal(df, "k").orderBy("k").collect()
    assert [r.ordinal for r in rows] == list(range(1000)) and rows[0].asDict().keys() == {"k", "id", "ordinal"}
    hot = io.with_ordinal(spark.range(500).select((F.col("id") % 2).alias("k")), "k")
    assert sorted(r.ordinal for r in hot.collect()) == list(range(500))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_splits_round_trip(spark, sf, tmp_path, fmt):
    truth = fx.truth(spark, sf).withColumnRenamed("text", "review")
    data = folds.train_val_test(truth)
    io.write_splits(data, str(tmp_path / "out"), fmt)
    for split in ("train", "val", "test"):
        back = io.read_split(spark, str(tmp_path / "out"), split, fmt=fmt, id_col="review_id")
        expected = data.where(F.col("split") == split).drop("split").select(*back.columns)
        assert back.count() == expected.count() > 0
        assert back.exceptAll(expected).count() == 0


def test_shared_dir_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_materialise_cuts_lineage(spark):
    stored = session.materialise(spark.range(10).withColumn("x", F.rand()))
    assert stored.collect() == stored.collect()
    assert "ExistingRDD" in stored._jdf.queryExecution().toString()


def test_spread_leaves_large_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert session.spread(wide, "id") is wide
    assert session.spread(wide.coalesce(1), "id").rdd.getNumPartitions() == 8


@pytest.fixture(scope="module")
def model_and_data(spark, sf):
    data = session.materialise(prepare_text(folds.train_val_test(fx.truth(spark, sf))))
    train = data.where(F.col("split") == "train")
    return models.fit_aspect_heads(train, num_features=512, max_iter=10), data


def test_model_beats_the_majority_class(spark, model_and_data):
    model, data = model_and_data
    train = data.where(F.col("split") == "train")
    predicted = models.predict(train, model).join(train.select("review_id", *[
        F.col(a).alias(f"t_{a}") for a in ASPECTS]), "review_id")
    n = predicted.count()
    for a in ASPECTS:
        top = train.groupBy(a).count().agg(F.max("count")).first()[0]
        assert predicted.where(F.col(a) == F.col(f"t_{a}")).count() / n >= top / n
    report, macro = models.evaluate(data.where(F.col("split") == "test"), model)
    assert report.count() == 6
    seen = models.loss_rows(train, model)
    assert 0 < loss.cross_entropy(seen).first().loss < 6 * math.log(6)
    probs = models.predict(train, model, all_probs=True)
    off = F.abs(F.aggregate("food_probs", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9
    assert probs.where(off | (F.size("food_probs") != 6)).count() == 0
    assert probs.where(F.element_at("food_probs", F.col("food") + 1) != F.col("food_prob")).count() == 0
    assert 0 < macro.first().final_score <= 1


def test_best_variant_is_kept(model_and_data):
    _, data = model_and_data
    train, val = (data.where(F.col("split") == s) for s in ("train", "val"))
    variants = {"narrow": {"num_features": 16}, "wide": {"num_features": 512}}
    best, runs = models.fit_best(train, val, variants, epochs=(1, 8))
    assert runs.count() == 2 * 2 * len(ASPECTS)
    kept = runs.select("run_id", "epoch", "train_loss", "val_loss", *METRICS).collect()
    assert all(0 < r.train_loss and 0 < r.val_loss for r in kept)
    ranked = {r.run_id: r.mean_score for r in history.rank_variants(runs).collect()}
    _, macro = models.evaluate(val, best)
    assert macro.first().final_score == pytest.approx(max(ranked.values()))


def test_heads_without_a_preparation_get_the_default_one(spark, model_and_data, tmp_path):
    model, data = model_and_data
    model.save(str(tmp_path / "model"))
    loaded = models.AspectModel.load(str(tmp_path / "model"))
    raw = data.select("review_id", F.col("text").alias("review"), *ASPECTS)
    expected = models.predict(prepare_text(raw, text="review"), model, text="review")
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_review_stream(spark, str(tmp_path / "in"), max_files=2)
    predict_stream(stream, loaded, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    keys = ["review_id", *ASPECTS]
    assert got.count() == expected.count()
    assert got.select(*keys).exceptAll(expected.select(*keys)).count() == 0
