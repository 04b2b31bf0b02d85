"""Codecs, decoding, metrics, losses and histories: worked cases and invariants."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from aspectra.functions import labels as L
from aspectra.operators import history, labels, loss, metrics
from aspectra.schema import ASPECTS, METRICS

WIDE = "review_id long, " + ", ".join(f"{a} int" for a in ASPECTS)


def one(spark, expr, vec):
    return spark.createDataFrame([(vec,)], "v array<double>").select(expr(F.col("v"))).first()[0]


def test_golden_report(spark):
    truth = spark.createDataFrame([(0, 1, 1, 3, 5, 3, 1), (1, 0, 0, 3, 4, 0, 0)], WIDE)
    pred = spark.createDataFrame([(0, 1, 0, 3, 4, 2, 0), (1, 0, 2, 2, 5, 1, 0)], WIDE)
    report = metrics.score_report(metrics.matched_pairs(metrics.align(truth, pred)))
    got = {r.aspect: tuple(r)[1:] for r in report.collect()}
    expected = [
        (1, 1, 1, 1, 1),
        (0, 0, 0, 1, 0),
        (1, 1, 1, 0.96875, 0.96875),
        (1, 1, 1, 0.9375, 0.9375),
        (0.5, 1, 2 / 3, 0.9375, 0.625),
        (0, 0, 0, 1, 0),
    ]
    for aspect, row in zip(ASPECTS, expected):
        assert got[aspect] == pytest.approx(row)
    mean = metrics.macro_report(report).first()
    assert [mean[m] for m in METRICS] == pytest.approx(
        [0.583333, 0.666667, 0.611111, 0.973958, 0.588542], abs=1e-6
    )


def test_align_counts_missing_and_null_rows(spark):
    truth = spark.createDataFrame([(1, 1, 1, 1, 1, 1, None), (2, 0, 0, 0, 0, 0, 0)], WIDE)
    pred = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 1), (3, 0, 0, 0, 0, 0, 0)], WIDE)
    aligned = metrics.align(truth, pred)
    report = {r.aspect: tuple(r)[1:5] for r in metrics.align_report(aligned).collect()}
    assert report["food"] == (1, 1, 1, 0)
    assert report["shopping"] == (1, 1, 1, 1)
    assert metrics.matched_pairs(aligned).count() == 5


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 6), min_size=1, max_size=50))
def test_one_hot_round_trip(spark, rows):
    wide = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], WIDE)
    coded = labels.one_hot(wide)
    assert coded.where(F.size("one_hot") != 30).count() == 0
    back = labels.one_hot_decode(coded.select("review_id", "one_hot")).orderBy("review_id")
    assert [tuple(r)[1:] for r in back.collect()] == rows


def test_last_set_slot_wins(spark):
    vec = [0.0, 1.0, 0.0, 1.0, 0.0] + [0.0] * 25
    assert one(spark, lambda v: L.one_hot_decode(v, 0), vec) == 4
    assert one(spark, lambda v: L.one_hot_decode(v, 1), vec) == 0


def test_softmax_argmax_and_ties(spark):
    p = one(spark, L.softmax, [1000.0, 1001.0, 999.0])
    assert sum(p) == pytest.approx(1) and p[1] == max(p)
    assert one(spark, L.argmax_class, [0.1, 2.0, 2.0, -1.0, 0.0, 0.5]) == 1
    assert one(spark, L.pad, [0.5, 0.5]) == [0.5, 0.5, 0, 0, 0, 0]


@pytest.mark.parametrize(
    "block, expected",
    [
        ([-1.0, -0.5, -3.0, -2.0, -9.0], 0),
        ([-1.0, 0.0, -3.0, -2.0, -9.0], 2),
        ([-1.0, 3.0, 3.0, -2.0, -9.0], 2),
        ([-1.0, 3.0, 3.0, -2.0, 9.0], 5),
    ],
)
def test_threshold(spark, block, expected):
    assert one(spark, lambda v: L.threshold_decode(v, 1), [0.0] * 5 + block + [0.0] * 20) == expected


def test_losses(spark):
    scores = [[0.0, 1.0, 0.0, 0.0, 0.0, 2.0], [3.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0] * 6]
    rows = [
        (i, a, v, (i + k) % 6) for i, v in enumerate(scores) for k, a in enumerate(ASPECTS)
    ]
    df = spark.createDataFrame(
        rows, "ordinal long, aspect string, logits array<double>, label int"
    )

    def nll(v, y):
        return math.log(sum(map(math.exp, v))) - v[y]

    per_row = [sum(nll(v, (i + k) % 6) for k in range(6)) for i, v in enumerate(scores)]
    assert loss.cross_entropy(df).first().loss == pytest.approx(sum(per_row) / 3)
    # Batches of two: the short last batch weighs as much as the first.
    batched = loss.batch_mean_loss(df, size=2).first()
    assert batched.batches == 2
    assert batched.loss == pytest.approx(((per_row[0] + per_row[1]) / 2 + per_row[2]) / 2)


def test_best_epoch_is_the_last_strict_improvement(spark):
    means = {"a": [0.2, 0.5, 0.5, 0.4], "b": [0.9, 0.1]}
    rows = [
        (run, e, a, m + d)
        for run, scores in means.items()
        for e, m in enumerate(scores)
        for a, d in (("x", 0.25), ("y", -0.25))
    ]
    df = spark.createDataFrame(rows, "run_id string, epoch int, aspect string, final_score double")
    best = history.best_epoch(df).orderBy("run_id", "epoch").collect()
    assert [r.improved for r in best] == [True, True, False, False, True, False]
    assert [r.is_best for r in best] == [False, True, False, False, True, False]
    ranked = history.rank_variants(df).orderBy("place").collect()
    assert [(r.run_id, r.epoch, r.place) for r in ranked] == [("b", 0, 1), ("a", 1, 2)]


def test_reports_hold_every_aspect(spark):
    pairs = spark.createDataFrame([("food", 3, 4), ("food", 0, 0)], "aspect string, truth int, pred int")
    report = {r.aspect: r for r in metrics.score_report(pairs).collect()}
    assert set(report) == set(ASPECTS)
    assert tuple(report["lodging"])[1:] == (0, 0, 0, 1, 0)
    mean = metrics.macro_report(metrics.score_report(pairs)).first()
    assert mean.final_score == pytest.approx(report["food"].final_score / 6)
    grouped = pairs.withColumn("epoch", F.lit(None).cast("int"))
    assert metrics.score_report(grouped, ("epoch", "aspect")).count() == 6
    assert metrics.pair_counts(pairs, aspects=None).count() == 1


def test_align_counts_repeated_keys(spark):
    row = (1, 1, 1, 1, 1, 1)
    truth = spark.createDataFrame([(1, *row), (1, *row), (2, *row), (2, *row), (None, *row), (None, *row)], WIDE)
    pred = spark.createDataFrame([(1, *row), (1, *row), (1, *row), (3, *row)], WIDE)
    report = {r.aspect: r for r in metrics.align_report(metrics.align(truth, pred)).collect()}["food"]
    assert (report.matched, report.missing_pred, report.missing_truth) == (6, 4, 1)
    assert (report.duplicate_truth, report.duplicate_pred) == (2, 2)


@pytest.mark.parametrize("score", [7, -1])
def test_scores_out_of_range_are_refused(spark, score):
    wide = spark.createDataFrame([(1, score, 1, 1, 1, 1, 1)], WIDE)
    with pytest.raises(Exception, match="out of range"):
        labels.one_hot(wide).collect()
