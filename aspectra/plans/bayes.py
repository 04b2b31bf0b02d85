"""Six class heads in closed form: multinomial naive Bayes over the words of a text.

One aggregate gives, for every word, its occurrences in the reviews of each class of each aspect; nothing is
iterated. Weights are whole numbers, so sums do not depend on the order of the rows, and a rerun, or another engine,
gives the same classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aspectra.functions.labels import checked_class
from aspectra.functions.text import tokenize
from aspectra.operators.runs import Found, joined_words, looked_up
from aspectra.schema import ASPECTS, CLASSES
from aspectra.session import stored

#: Weights are in parts of this number.
MICRO = 1_000_000
#: Words whose weights are added up at once.
AT_ONCE = 1 << 16


def _micro(c: Column) -> Column:
    return F.round(MICRO * F.log(c)).cast("long")


@dataclass(frozen=True)
class BayesHeads:
    """``words``: (word, weights), one weight per aspect and class; ``base``: those of a text without words."""

    words: DataFrame
    base: tuple[int, ...]
    aspects: tuple[str, ...] = tuple(ASPECTS)
    classes: int = CLASSES

    kind = "bayes"

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        row = [(list(self.base), list(self.aspects), self.classes)]
        spark = self.words.sparkSession
        spark.createDataFrame(row, "base array<long>, aspects array<string>, classes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/base")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BayesHeads:
        row = spark.read.parquet(f"{path}/base").first()
        return cls(spark.read.parquet(f"{path}/words"), tuple(row["base"]), tuple(row["aspects"]), row["classes"])

    def logits(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``<aspect>_logits``: the summed weights of its words, in natural logarithms.

        Words are looked up and summed in the tasks that hold the texts.
        """
        found = looked_up(df, joined_words(F.col(text)), self.words.select("word", "weights"), range(1, 2), _sums(len(self.base)), "_sums", "array<long>")

        def head(a: int) -> Column:
            places = range(a * self.classes, (a + 1) * self.classes)
            return F.array(*[(F.col("_sums")[i] + F.lit(self.base[i])) / float(MICRO) for i in places])

        return found.select(*df.columns, *[head(a).alias(f"{name}_logits") for a, name in enumerate(self.aspects)])


def _sums(size: int):
    """The sums of the finds' values, ``size`` whole numbers, in each row."""

    def choose(found: Found, _: pa.Array | None) -> pa.Array:
        bounds = found.bounds()
        out = np.zeros((len(bounds) - 1, size), np.int64)
        if len(found.at):
            weights = found.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            rows = np.flatnonzero(np.diff(bounds))
            starts, first = bounds[:-1][rows], 0
            while first < len(rows):
                # Some rows at a time, so that the weights of all their words are a matrix of bounded size.
                last = max(int(np.searchsorted(starts, starts[first] + AT_ONCE)), first + 1)
                begin, end = starts[first], bounds[rows[last - 1] + 1]
                out[rows[first:last]] = np.add.reduceat(weights[found.entry[begin:end]], starts[first:last] - begin, axis=0)
                first = last
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.ravel()))

    return choose


def fit_bayes_heads(
    train: DataFrame, aspects=ASPECTS, text: str = "text", min_count: int = 1, classes: int = CLASSES
) -> BayesHeads:
    """Heads over the words seen at least ``min_count`` times in ``train``, prepared text with a score per aspect.

    With n(w) the occurrences of a word in the reviews of a class, T their sum over the V kept words, d the reviews of
    the class and D those rated on the aspect: a word weighs ln((n(w) + 1) / (T + V)), the class itself
    ln((d + 1) / (D + classes)), both rounded to millionths. A null score leaves the review out of that
    aspect's head; a score outside the classes ends the job. A hot word leaves each task as one row. Besides the table
    of words, aspects x classes pairs of counts reach the driver.
    """
    heads = [(a, k) for a in aspects for k in range(classes)]
    checked = train.select(text, *[checked_class(F.col(a), classes).alias(a) for a in aspects])
    words = checked.select(F.explode(tokenize(F.col(text))).alias("word"), *aspects)
    counts = words.groupBy("word").agg(
        F.count("*").alias("count"), *[F.count_if(F.col(a) == k).alias(f"n{i}") for i, (a, k) in enumerate(heads)]
    )
    counts = stored(counts.where(F.col("count") >= min_count), "word-classes")
    sums = counts.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(heads))]).first()
    reviews = checked.agg(*[F.count_if(F.col(a) == k).alias(f"d{i}") for i, (a, k) in enumerate(heads)])
    rated = {a: sum(F.col(f"d{i}") for i, (b, _) in enumerate(heads) if a == b) for a in aspects}
    base = reviews.select(*[_micro((F.col(f"d{i}") + 1) / (rated[a] + classes)).alias(f"b{i}") for i, (a, _) in enumerate(heads)]).first()
    weights = F.array(*[_micro((F.col(f"n{i}") + 1) / F.lit(sums[f"n{i}"] + sums["v"])) for i in range(len(heads))])
    return BayesHeads(stored(counts.select("word", weights.alias("weights")), "word-weights"), tuple(base), tuple(aspects), classes)
