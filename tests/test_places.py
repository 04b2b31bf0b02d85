"""Rows set aside, tables lined up by place, folds dealt out label by label."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aspectra.operators import balance, folds, metrics, position
from aspectra.plans import fixtures as fx
from aspectra.schema import ASPECTS
from aspectra.sources import reviews as reviews_io

HEAD = "review_id,Review," + ",".join(f"s{i}" for i in range(6))


def test_rows_set_aside(spark, tmp_path):
    lines = [
        HEAD,
        '1,"good, and ""quoted""\nover two lines",1,2,3,4,5,0',
        "2,short,1,2,3,4,5",
        "3,long,1,2,3,4,5,0,7",
        "4,word,1,x,3,4,5,0",
        "5,fraction,1,2.5,3,4,5,0",
        "6,whole,1,2.0,3,4,5,0",
        "7,class,1,2,3,4,5,6",
        "8,nothing,\\N,\\N,\\N,\\N,\\N,\\N",
        "9,both,0.5,9,3,4,5,0",
        "10,negative,-1,2,3,4,5,0",
        "x,key,1,2,3,4,5,0",
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(HEAD + "\n11,other,1,1,1,1,1\n12,fine,1,1,1,1,1,1\n")
    good, rejects = reviews_io.split_reviews(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], id_col="review_id", classes=6)
    kept = {r.review_id: r for r in good.collect()}
    assert set(kept) == {1, 6, 8, 12} and good.columns == ["review_id", "review", *ASPECTS]
    assert kept[1].review == 'good, and "quoted"\nover two lines' and kept[6].lodging == 2 and kept[8].food is None
    found = {(r.file[-5:], r.row.split(",")[0]): (r.reason, r.column) for r in rejects.collect()}
    assert found == {
        ("a.csv", "2"): ("columns", None), ("a.csv", "3"): ("columns", None), ("a.csv", "4"): ("columns", None),
        ("a.csv", "5"): ("fraction", "lodging"), ("a.csv", "7"): ("class", "shopping"), ("a.csv", "9"): ("fraction", "entertainment"),
        ("a.csv", "10"): ("class", "entertainment"), ("a.csv", "x"): ("columns", None), ("b.csv", "11"): ("columns", None),
    }
    counts = {(r.reason, r.column): r.rows for r in reviews_io.reject_counts(rejects).collect()}
    assert counts["columns", None] == 5 and sum(counts.values()) + good.count() == 13
    # Without a number of classes any whole score is read.
    good, rejects = reviews_io.split_reviews(spark, str(tmp_path / "a.csv"), id_col="review_id")
    assert {r.review_id for r in good.collect()} == {1, 6, 7, 8, 10}


def test_good_files_have_no_rejects(spark, sf, tmp_path):
    reviews_io.write_reviews(fx.truth(spark, sf), str(tmp_path / "r"))
    good, rejects = reviews_io.split_reviews(spark, str(tmp_path / "r"), id_col="review_id", classes=6)
    plain = reviews_io.read_reviews(spark, str(tmp_path / "r"), id_col="review_id")
    assert rejects.count() == 0 and good.exceptAll(plain).count() == 0 and good.count() == plain.count()


def rated(spark, ids):
    return spark.createDataFrame([(i, f"t{i % 40}", *[(i + k) % 6 for k in range(6)]) for i in ids], "review_id long, text string, " + ", ".join(f"{a} int" for a in ASPECTS))


def test_lined_up_by_place(spark):
    truth, pred = rated(spark, range(50)), rated(spark, range(100, 148)).withColumn("when", F.col("review_id") * 3)
    aligned = position.align_by_position(truth, pred, "review_id", "when")
    report = position.position_report(aligned).collect()
    assert len(report) == 6 and {(r.truth_rows, r.pred_rows, r.matched, r.missing_pred, r.missing_truth) for r in report} == {(50, 48, 48, 2, 0)}
    for r in aligned.where("aspect = 'lodging' and has_pred").collect():
        assert (r.truth, r.pred) == ((r.ordinal + 1) % 6, (100 + r.ordinal + 1) % 6)
    assert metrics.score_report(metrics.matched_pairs(aligned)).count() == 6
    assert position.align_by_position(truth.where("false"), pred.where("false"), "review_id", "when").count() == 0


@pytest.mark.parametrize("case", ["same", "dropped", "extra", "dropped twice", "other"])
def test_shift_report(spark, case):
    """Texts repeat every 40 rows, further than the reach."""
    truth = rated(spark, range(1000))
    gone = {"dropped": [500], "dropped twice": [300, 700, 701]}.get(case, [])
    pred = truth.where(~F.col("review_id").isin(gone)) if gone else truth
    if case == "extra":
        pred = truth.withColumn("review_id", F.when(F.col("review_id") >= 500, F.col("review_id") + 1).otherwise(F.col("review_id"))).union(
            truth.where("review_id = 0").withColumns({"review_id": F.lit(500).cast("long"), "text": F.lit("new")})
        )
    if case == "other":
        pred = truth.withColumn("text", F.concat("text", F.lit("!")))
    got = [tuple(r) for r in position.shift_report(truth, pred, "review_id", ["text"], window=100, reach=8).orderBy("first_ordinal").collect()]
    assert got == {
        "same": [(0, 999, 1000, 0, 1000)],
        "dropped": [(0, 499, 500, 0, 500), (500, 999, 500, -1, 499)],
        "extra": [(0, 499, 500, 0, 500), (500, 999, 500, 1, 500)],
        "dropped twice": [(0, 299, 300, 0, 300), (300, 699, 400, -1, 399), (700, 999, 300, -3, 298)],
        "other": [(0, 999, 1000, None, 0)],
    }[case]


# --- folds ---------------------------------------------------------------------------------------


def labelled(spark, n, aspects, seed=1):
    rng = random.Random(seed)
    weights = [rng.choice([2, 5, 20]) for _ in aspects]
    rows = [(i, *[rng.choice([0] * w + [1, 2]) for w in weights]) for i in range(n)]
    return spark.createDataFrame(rows, "review_id long, " + ", ".join(f"{a} int" for a in aspects)).repartition(3)


def spread_of(folded, aspects):
    counts = defaultdict(Counter)
    for r in folded.collect():
        for a in aspects:
            if r[a]:
                counts[a, r[a]][r.fold] += 1
    return {k: max(c[f] for f in range(5)) - min(c[f] for f in range(5)) for k, c in counts.items()}


def test_every_label_is_spread(spark):
    aspects = [f"a{i}" for i in range(6)]
    df = labelled(spark, 600, aspects)
    folded = balance.iterative_folds(df, aspects).cache()
    assert folded.columns == [*df.columns, "fold"] and folded.drop("fold").exceptAll(df).count() == 0
    own, bits = spread_of(folded, aspects), spread_of(folds.stratified_folds(df, aspects), aspects)
    assert max(own.values()) <= max(bits.values()) and sum(own.values()) <= sum(bits.values())
    sizes = Counter(r.fold for r in folded.collect())
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 5
    seen = {(r.aspect, r.score): r.most - r.least for r in balance.label_spread(folded, aspects).collect()}
    assert seen == own
    again = balance.iterative_folds(df.repartition(7), aspects)
    assert again.exceptAll(folded).count() == 0
    assert balance.iterative_folds(df, aspects, seed=3).exceptAll(folded).count() > 0


def test_thirty_aspects(spark):
    aspects = [f"a{i}" for i in range(30)]
    df = labelled(spark, 300, aspects).select("review_id", *[F.when(F.col(a) > 0, 1).otherwise(0).alias(a) for a in aspects])
    split = folds.train_val_test(df, aspects)
    sizes = Counter(r.split for r in split.collect())
    assert sum(sizes.values()) == 300 and 200 <= sizes["train"] <= 270 and min(sizes["val"], sizes["test"]) >= 12
    few = folds.stratified_folds(df.select("review_id", *aspects[:11]), aspects[:11])
    assert max(spread_of(few, aspects[:11]).values()) <= 8


def test_null_keys_are_spread(spark):
    """Only null keys: rows of one stratum still fall into many cells, and folds stay even."""
    df = spark.range(400).select(F.lit(None).cast("long").alias("review_id"), *[F.lit(1).alias(a) for a in ASPECTS])
    ranked = folds._with_rank(df, ASPECTS, 0, "review_id", folds.HASH_DIGITS)
    assert ranked.select("cell").distinct().count() > 300
    sizes = Counter(r.fold for r in folds.stratified_folds(df).collect())
    assert sorted(sizes.values()) == [80] * 5 and folds.stratified_folds(df).columns == [*df.columns, "fold"]
    mixed = df.union(df.limit(5).withColumn("review_id", F.lit(3).cast("long")))
    assert sum(Counter(r.split for r in folds.train_val_test(mixed).collect()).values()) == 405


def test_no_labels_and_no_rows(spark):
    df = labelled(spark, 20, ["a"]).withColumn("a", F.lit(0))
    assert sorted(Counter(r.fold for r in balance.iterative_folds(df, ["a"]).collect()).values()) == [4] * 5
    assert balance.iterative_folds(df.where("false"), ["a"]).count() == 0
