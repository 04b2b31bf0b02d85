"""Fit, apply and evaluate six class heads over text."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from aspectra.functions.labels import argmax_class, checked_class, pad, softmax
from aspectra.functions.text import tokenize
from aspectra.operators.history import rank_variants
from aspectra.operators.joint import JointHeads, WordFeatures, carry_on, joint_logits, labelled_rows, mean_loss, word_features
from aspectra.operators.labels import aspect_rows
from aspectra.operators.metrics import macro_report, matched_pairs, score_report
from aspectra.plans.bayes import BayesHeads
from aspectra.schema import ASPECTS, METRICS
from aspectra.session import materialise


class Heads(Protocol):
    """What predictions need of a model, however it was fitted."""

    aspects: tuple[str, ...]

    def logits(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``<aspect>_logits``, six raw class scores for each aspect of its prepared text."""

    def save(self, path: str) -> None: ...


@dataclass(frozen=True)
class AspectModel:
    """Shared text features and one multinomial head per aspect, each fitted alone."""

    features: PipelineModel
    heads: dict[str, LogisticRegressionModel]

    kind = "logistic"

    @property
    def aspects(self) -> tuple[str, ...]:
        return tuple(self.heads)

    def logits(self, df: DataFrame, text: str) -> DataFrame:
        """Minus infinity for a class the fit has not seen. No shuffle."""
        out = self.features.transform(_with_tokens(df, text))
        for aspect, head in self.heads.items():
            applied = head.copy()
            applied.setFeaturesCol("features").setRawPredictionCol(f"{aspect}_raw")
            applied.setPredictionCol("").setProbabilityCol("")
            out = applied.transform(out)
        raw = {a: vector_to_array(F.col(f"{a}_raw")) for a in self.heads}
        return out.select(*df.columns, *[pad(v, float("-inf")).alias(f"{a}_logits") for a, v in raw.items()])

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        for aspect, head in self.heads.items():
            head.write().overwrite().save(f"{path}/heads/{aspect}")

    @classmethod
    def load(cls, path: str, aspects=ASPECTS) -> AspectModel:
        heads = {a: LogisticRegressionModel.load(f"{path}/heads/{a}") for a in aspects}
        return cls(PipelineModel.load(f"{path}/features"), heads)


@dataclass(frozen=True)
class JointModel:
    """Six heads over hashed words, fitted together (``operators.joint``)."""

    fit: JointHeads

    kind = "joint"

    @property
    def aspects(self) -> tuple[str, ...]:
        return self.fit.aspects

    def logits(self, df: DataFrame, text: str) -> DataFrame:
        """No shuffle: one matrix product per Arrow batch."""
        k = self.fit.classes
        scored = joint_logits(df, self.fit, text)
        return scored.select(*df.columns, *[F.slice("logits", i * k + 1, k).alias(f"{a}_logits") for i, a in enumerate(self.aspects)])

    def save(self, path: str) -> None:
        """Everything that a prediction, or a fit that is carried on, needs."""
        spark, fit = SparkSession.active(), self.fit
        rows = [
            (i, float(fit.features.rarity[i]), fit.weights[i].tolist(), fit.speed[0][i].tolist())
            for i in range(fit.features.size)
        ]
        spark.createDataFrame(rows, "id int, rarity double, weights array<double>, speed array<double>").write.mode("overwrite").parquet(f"{path}/features")
        row = [(list(fit.aspects), fit.classes, fit.epoch, fit.bias.tolist(), fit.speed[1].tolist(), json.dumps(fit.losses))]
        schema = "aspects array<string>, classes int, epoch int, bias array<double>, speed array<double>, losses string"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> JointModel:
        rows = spark.read.parquet(f"{path}/features").orderBy("id").collect()
        head = spark.read.parquet(f"{path}/heads").first()
        features = WordFeatures(len(rows), np.array([r["rarity"] for r in rows]))
        return cls(
            JointHeads(
                features,
                tuple(head["aspects"]),
                head["classes"],
                np.array([r["weights"] for r in rows]),
                np.array(head["bias"]),
                (np.array([r["speed"] for r in rows]), np.array(head["speed"])),
                head["epoch"],
                json.loads(head["losses"]),
            )
        )


def load_heads(spark: SparkSession, path: str, kind: str, aspects=ASPECTS) -> Heads:
    """A saved model of any kind."""
    if kind == AspectModel.kind:
        return AspectModel.load(path, aspects)
    return {JointModel.kind: JointModel, BayesHeads.kind: BayesHeads}[kind].load(spark, path)


def fit_joint_heads(
    train: DataFrame, aspects=ASPECTS, text: str = "text", num_features: int = 4096, epochs: int = 30, **settings
) -> JointModel:
    """Six heads fitted together over the prepared text of ``train``; one pass per epoch. ``settings`` are those
    of ``operators.joint.carry_on``."""
    heads = JointHeads(word_features(train, text, num_features), tuple(aspects))
    return JointModel(carry_on(labelled_rows(train, heads, text), heads, epochs, **settings))


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("tokens", tokenize(F.col(text)))


def fit_aspect_heads(
    train: DataFrame,
    aspects=ASPECTS,
    text: str = "text",
    num_features: int = 4096,
    max_iter: int = 20,
    reg_param: float = 0.01,
    parallelism: int = 2,
    aggregation_depth: int = 2,
) -> AspectModel:
    """TF-IDF features, computed once and shared, then one classifier per aspect.

    ``train`` holds prepared text and one score column per aspect. The features are stored in the
    shared folder, so that neither six fits nor a lost executor repeats the text work; each fit
    caches its own blocks of them. The fits are independent and run side by side, ``parallelism`` at
    a time, which is also how many copies of the features are in memory. A score outside the six
    classes is refused. Raise ``aggregation_depth`` on many executors, so that gradients are merged in more
    steps before the driver.
    """
    features, rows = fit_features(train, aspects, text, num_features)
    return fit_heads(features, rows, aspects, max_iter, reg_param, parallelism, aggregation_depth)


def fit_features(
    train: DataFrame, aspects=ASPECTS, text: str = "text", num_features: int = 4096
) -> tuple[PipelineModel, DataFrame]:
    """The TF-IDF model and the stored (features, one column per aspect) of the training rows."""
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features", minDocFreq=2)
    counted = tf.transform(_with_tokens(train.select(text, *aspects), text))
    features = PipelineModel(stages=[tf, idf.fit(counted)])
    checked = [checked_class(F.col(a)).alias(a) for a in aspects]
    return features, materialise(features.stages[1].transform(counted).select("features", *checked))


def fit_heads(
    features: PipelineModel,
    rows: DataFrame,
    aspects=ASPECTS,
    max_iter: int = 20,
    reg_param: float = 0.01,
    parallelism: int = 2,
    aggregation_depth: int = 2,
) -> AspectModel:
    """One classifier per aspect over the rows of ``fit_features``."""

    def fit(aspect: str) -> LogisticRegressionModel:
        head = LogisticRegression(
            featuresCol="features",
            labelCol=aspect,
            family="multinomial",
            maxIter=max_iter,
            regParam=reg_param,
            aggregationDepth=aggregation_depth,
        )
        return head.fit(rows.where(F.col(aspect).isNotNull()))

    run = inheritable_thread_target(rows.sparkSession)(fit)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        heads = dict(zip(aspects, pool.map(run, aspects)))
    return AspectModel(features, heads)


def head_logits(
    df: DataFrame,
    model: Heads,
    text: str = "text",
    key: str = "review_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, ``keep`` columns, ``<aspect>_logits``): six raw class scores per aspect."""
    out = model.logits(df.select(key, text, *keep), text)
    return out.select(key, *keep, *[f"{a}_logits" for a in model.aspects])


def predict(
    df: DataFrame,
    model: Heads,
    text: str = "text",
    key: str = "review_id",
    keep: tuple[str, ...] = (),
    all_probs: bool = False,
) -> DataFrame:
    """(key, ``keep`` columns, one class per aspect, ``<aspect>_prob`` of that class) for prepared
    text; with ``all_probs`` also ``<aspect>_probs``, the probability of every class."""
    probs = head_logits(df, model, text, key, keep).select(
        key, *keep, *[softmax(F.col(f"{a}_logits")).alias(f"{a}_probs") for a in model.aspects]
    )
    each = {a: F.col(f"{a}_probs") for a in model.aspects}
    return probs.select(
        key,
        *keep,
        *[argmax_class(p).alias(a) for a, p in each.items()],
        *[F.array_max(p).alias(f"{a}_prob") for a, p in each.items()],
        *(each.values() if all_probs else ()),
    )


def _labelled(df: DataFrame, model: Heads, text: str, key: str):
    true = {a: f"true_{a}" for a in model.aspects}
    return true, df.select(key, text, *[F.col(a).alias(t) for a, t in true.items()])


def loss_rows(
    df: DataFrame, model: Heads, text: str = "text", key: str = "review_id"
) -> DataFrame:
    """(key, aspect, logits, label) of a labelled table, the input of the losses."""
    true, labelled = _labelled(df, model, text, key)
    scored = head_logits(labelled, model, text, key, tuple(true.values()))
    heads = {a: {"logits": F.col(f"{a}_logits"), "label": F.col(t)} for a, t in true.items()}
    return aspect_rows(scored, [key], heads)


def evaluate(
    df: DataFrame, model: Heads, text: str = "text", key: str = "review_id"
) -> tuple[DataFrame, DataFrame]:
    """Per-aspect report and its mean over aspects, for a labelled table.

    Truth stays in the row that is classified, so nothing is joined; predictions that come as a
    table of their own go through ``metrics.align`` instead.
    """
    true, labelled = _labelled(df, model, text, key)
    scored = predict(labelled, model, text, key, keep=tuple(true.values()))
    pairs = aspect_rows(
        scored, [key], {a: {"truth": F.col(t), "pred": F.col(a)} for a, t in true.items()}
    )
    report = score_report(matched_pairs(pairs))
    return report, macro_report(report)


def fit_best(
    train: DataFrame,
    val: DataFrame,
    variants: dict[str, dict],
    epochs: tuple[int, ...] = (5, 10, 20),
    aspects=ASPECTS,
    text: str = "text",
    key: str = "review_id",
) -> tuple[JointModel, DataFrame]:
    """Fit every variant (settings of ``fit_joint_heads``) once, look at it after each of ``epochs`` passes, and keep
    the model with the best mean final score on ``val``, the earliest on ties. A fit is carried on from one look to the
    next. Features depend on a variant's ``num_features`` alone and are made once for it.

    Also returns the history (run_id, epoch, aspect, train_loss, val_loss and the five metrics of
    ``val``), ready for ``best_epoch`` and ``rank_variants``. Each look leaves six rows; the reviews
    never reach the driver.
    """
    fits, reports, made = {}, [], {}
    spark = train.sparkSession
    for run_id, settings in variants.items():
        settings = dict(settings)
        size = settings.pop("num_features", 4096)
        if size not in made:
            heads = JointHeads(word_features(train, text, size), tuple(aspects))
            made[size] = heads, labelled_rows(train, heads, text), labelled_rows(val, heads, text)
        heads, rows, val_rows = made[size]
        for epoch in sorted(epochs):
            heads = carry_on(rows, heads, epoch - heads.epoch, **settings)
            model = fits[run_id, epoch] = JointModel(heads)
            report, _ = evaluate(val, model, text, key)
            losses = [mean_loss(r, heads) for r in (rows, val_rows)]
            table = [(a, *(None if np.isnan(part[a]) else float(part[a]) for part in losses)) for a in aspects]
            losses = spark.createDataFrame(table, "aspect string, train_loss double, val_loss double")
            columns = ["aspect", "train_loss", "val_loss", *METRICS]
            run = report.join(losses, "aspect", "left").select(F.lit(run_id).alias("run_id"), F.lit(epoch).alias("epoch"), *columns)
            reports.append(materialise(run))
    history = reduce(DataFrame.unionByName, reports)
    best = rank_variants(history).where("place = 1").first()
    return fits[best.run_id, best.epoch], history
