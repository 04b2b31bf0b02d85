"""Layer concatenation and pooling of vector tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def concat_last(
    df: DataFrame,
    k: int = 4,
    keys: tuple[str, ...] = ("doc_id", "pos"),
    layer: str = "layer",
    vec: str = "vec",
    n_layers: int | None = None,
) -> DataFrame:
    """The last ``k`` layer vectors of each token, joined in layer order; all of them when a token
    has fewer. A group holds one row per model layer, so its size does not grow with the data.

    When every token is known to have the layers 0 to ``n_layers`` - 1, pass that number: the other
    layers are then filtered out in the scan instead of being shuffled.
    """
    if n_layers is not None:
        df = df.where(F.col(layer) >= n_layers - k)
    layers = F.array_sort(F.collect_list(F.struct(layer, vec)))
    grouped = df.groupBy(*keys).agg(layers.alias("layers"))
    last = F.slice("layers", F.greatest(F.lit(1), F.size("layers") - (k - 1)), k)
    return grouped.select(*keys, F.flatten(F.transform(last, lambda s: s[vec])).alias(vec))


def pool(
    df: DataFrame, how: str = "mean", group: str = "doc_id", pos: str = "pos", vec: str = "vec"
) -> DataFrame:
    """One vector per group: ``mean``, ``mean_max`` (both joined) or ``last`` (highest position).

    All three are partial aggregates: a group of any size leaves each task as one buffer per vector length, so a
    hot group neither moves its rows nor meets in one task. A null vector is not a position of its group. Vectors may
    differ in length, as those of tokens with too few layers do: a component is pooled over the vectors that have
    it, and a pooled vector is as long as the longest of the table, null where its group has no such component.
    """
    df = df.where(F.col(vec).isNotNull())
    if how == "last":
        return df.groupBy(group).agg(F.max_by(vec, pos).alias(vec))
    if how not in ("mean", "mean_max"):
        raise ValueError("how must be 'mean', 'mean_max' or 'last'")
    metrics = ("mean",) if how == "mean" else ("mean", "max")
    width = df.agg(F.coalesce(F.max(F.size(vec)), F.lit(0))).first()[0]
    vectors = df.select(group, F.size(vec).alias("size"), array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    # The summary takes vectors of one length; a group has few.
    summary = vectors.groupBy(group, "size").agg(
        F.count("*").alias("n"), Summarizer.metrics(*metrics).summary(F.col("v")).alias("s")
    )
    part = F.struct("n", *[vector_to_array(F.col("s")[m]).alias(m) for m in metrics])
    parts = summary.groupBy(group).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select(group, F.concat(*[_merged(m, width) for m in metrics]).alias(vec))


def _merged(metric: str, width: int) -> Column:
    """One metric of the ``parts`` (n, one array per metric) of a group, component by component."""

    def component(i: Column) -> Column:
        having = F.filter("parts", lambda p: F.size(p[metric]) > i)
        values = F.transform(having, lambda p: p[metric][i])
        if metric == "max":
            return F.array_max(values)
        total = F.aggregate(having, F.lit(0.0), lambda s, p: s + p["n"] * p[metric][i])
        count = F.aggregate(having, F.lit(0).cast("long"), lambda s, p: s + p["n"])
        return F.when(F.size(values) == 1, values[0]).when(count > 0, total / count)

    alone = F.col("parts")[0][metric]
    even = (F.size("parts") == 1) & (F.size(alone) == width)
    places = F.array(*map(F.lit, range(width))).cast("array<int>")
    return F.when(even, alone).otherwise(F.transform(places, component))
