"""Raw reviews in, classes out: preparation and heads as one object, for tables, single reports and streams."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from aspectra.functions.text import ABBREVIATIONS
from aspectra.operators.tokens import KEEP_WORDS
from aspectra.plans import models
from aspectra.plans.models import Heads
from aspectra.plans.prepare import prepare_text


@dataclass(frozen=True)
class Preparation:
    """The settings of ``prepare_text``, kept with the model that was fitted on their result.

    ``lexicon`` is a stored table of pairs or phrases, or None; the other settings are small values.
    """

    rules: dict[str, str] = field(default_factory=lambda: dict(ABBREVIATIONS))
    whitespace: str = "delete"
    stop_words: tuple[str, ...] | None = None
    keep: tuple[str, ...] = KEEP_WORDS
    lexicon: DataFrame | None = None

    def __call__(self, df: DataFrame, text: str = "review", key: str = "review_id") -> DataFrame:
        """``df`` with its text prepared."""
        return prepare_text(df, self.lexicon, self.stop_words, self.keep, self.rules, self.whitespace, text, key)

    def settings(self) -> dict:
        stop = None if self.stop_words is None else list(self.stop_words)
        return {"rules": self.rules, "whitespace": self.whitespace, "stop_words": stop, "keep": list(self.keep)}


@dataclass(frozen=True)
class TextRater:
    """Heads of any kind, and the preparation of the texts they were fitted on."""

    preparation: Preparation
    model: Heads

    def _prepared(self, df: DataFrame, text: str, key: str, prepared: bool) -> DataFrame:
        return df if prepared else self.preparation(df, text, key)

    def predict(
        self, df: DataFrame, text: str = "review", key: str = "review_id", keep: tuple[str, ...] = (),
        all_probs: bool = False, prepared: bool = False,
    ) -> DataFrame:
        """``models.predict`` for raw reviews; with ``prepared`` for text that went through ``preparation`` before."""
        ready = self._prepared(df.select(key, text, *keep), text, key, prepared)
        return models.predict(ready, self.model, text, key, keep, all_probs)

    def evaluate(
        self, df: DataFrame, text: str = "review", key: str = "review_id", prepared: bool = False
    ) -> tuple[DataFrame, DataFrame]:
        """``models.evaluate`` for raw labelled reviews."""
        return models.evaluate(self._prepared(df.select(key, text, *self.model.aspects), text, key, prepared), self.model, text, key)

    def save(self, path: str) -> None:
        """Preparation, list and heads below ``path``; ``load`` needs nothing else."""
        self.model.save(f"{path}/model")
        spark = SparkSession.active()
        if self.preparation.lexicon is not None:
            self.preparation.lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
        about = {
            "kind": self.model.kind,
            "aspects": list(self.model.aspects),
            "lexicon": self.preparation.lexicon is not None,
            "preparation": self.preparation.settings(),
        }
        spark.createDataFrame([(json.dumps(about, ensure_ascii=False),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextRater:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        made = about["preparation"]
        preparation = Preparation(
            made["rules"],
            made["whitespace"],
            None if made["stop_words"] is None else tuple(made["stop_words"]),
            tuple(made["keep"]),
            spark.read.parquet(f"{path}/lexicon") if about["lexicon"] else None,
        )
        return cls(preparation, models.load_heads(spark, f"{path}/model", about["kind"], tuple(about["aspects"])))


def fit_rater(train: DataFrame, preparation: Preparation = Preparation(), fit=models.fit_joint_heads, text: str = "review", key: str = "review_id", **settings) -> TextRater:
    """A rater fitted on raw reviews with a score per aspect. ``fit`` is one of ``fit_joint_heads``,
    ``fit_bayes_heads`` and ``fit_aspect_heads``; ``settings`` are its own."""
    return TextRater(preparation, fit(preparation(train, text, key), text=text, **settings))
