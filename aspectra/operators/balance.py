"""Folds that keep every label's share, dealt out label by label, the rarest first; for any number of aspects.

A label is an (aspect, score above 0). In each round the label that the fewest unplaced rows carry is dealt out: each fold
has a quota of that label, its share of the whole less what earlier rounds gave it, and the rows, in the order of a
hash, fill the quotas one after another. Rows without any label come last and fill the folds up to their size. A round is
two aggregates over narrow rows; ranks inside a label are taken in cells of the hash, so that a label that a
third of all rows carries is not ranked in one task.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aspectra.schema import ASPECTS
from aspectra.session import stored

#: Hash digits of a cell: a label is ranked in 16 to this power pieces.
CELL_DIGITS = 3
#: Rounds after which the placed rows are written out.
STORE_EVERY = 8


def _quotas(counts: list[int], folds: int, placed: list[int]) -> list[int]:
    """Rows that each fold still gets of ``sum(counts)`` rows of a label, ``placed`` being what it has: as even as may be."""
    total = sum(counts) + sum(placed)
    want = [max((total * (i + 1)) // folds - (total * i) // folds - placed[i], 0) for i in range(folds)]
    left = sum(counts) - sum(want)
    # Earlier rounds may have given a fold more than its share: the others give way, those with most first.
    while left:
        i = max(range(folds), key=lambda f: want[f]) if left < 0 else min(range(folds), key=lambda f: placed[f] + want[f])
        step = -min(-left, max(want[i] // folds, 1)) if left < 0 else max(left // folds, 1)
        want[i] += step
        left -= step
    return want


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of their hash; only counts of cells go through one task."""
    cells = rows.withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("hash", "row")) - 1
    return cells.withColumn("place", place).join(F.broadcast(offsets), "cell").withColumn("rank", F.col("offset") + F.col("place")).drop("cell", "place", "offset")


def _fold_of(rank: Column, quotas: list[int]) -> Column:
    ends = [sum(quotas[: i + 1]) for i in range(len(quotas))]
    return reduce(lambda made, i: F.when(rank < ends[i], i).otherwise(made), range(len(quotas) - 2, -1, -1), F.lit(len(quotas) - 1)).cast("int")


def iterative_folds(df: DataFrame, aspects=ASPECTS, k: int = 5, seed: int = 0, key: str = "review_id") -> DataFrame:
    """Add ``fold`` (0 to k-1) such that each label is as evenly spread as the rarer ones before it allow.

    Rows are stored with a number of their own first, so null and repeated keys are rows like others; a null key is dealt
    by its number, any other by its hash. Null and 0 scores carry no label. The driver holds one count per label and fold.
    """
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    labels = F.array_compact(F.array(*[F.when(F.col(a) > 0, F.concat(F.lit(f"{i}:"), F.col(a).cast("string"))) for i, a in enumerate(aspects)]))
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.col("_row").cast("string")))
    row_hash = F.md5(F.concat(own, F.lit(f":{seed}")))
    open_rows = stored(rows.select(F.col("_row").alias("row"), row_hash.alias("hash"), labels.alias("labels")), "labels")
    given: dict[str, list[int]] = {}
    done = None
    sizes, round_no = [0] * k, 0
    counts = Counter({r["label"]: r["count"] for r in open_rows.select(F.explode("labels").alias("label")).groupBy("label").count().collect()})
    while counts := +counts:
        rarest = min(counts, key=lambda label: (counts[label], label))
        quotas = _quotas([counts[rarest]], k, given.get(rarest, [0] * k))
        mine = _ranked(open_rows.where(F.array_contains("labels", rarest)))
        placed = stored(mine.select("row", "labels", _fold_of(F.col("rank"), quotas).alias("fold")), "placed")
        # The empty label counts the rows themselves.
        each = F.explode(F.concat("labels", F.array(F.lit("")))).alias("label")
        for r in placed.select("fold", each).groupBy("fold", "label").count().collect():
            if r["label"]:
                given.setdefault(r["label"], [0] * k)[r["fold"]] += r["count"]
                counts[r["label"]] -= r["count"]
            else:
                sizes[r["fold"]] += r["count"]
        done = placed if done is None else done.unionByName(placed)
        open_rows = open_rows.where(~F.array_contains("labels", rarest))
        round_no += 1
        if round_no % STORE_EVERY == 0:
            open_rows = stored(open_rows, "labels")
    rest = open_rows.count()
    last = _ranked(open_rows).select("row", "labels", _fold_of(F.col("rank"), _quotas([rest], k, sizes)).alias("fold"))
    done = last if done is None else done.unionByName(last)
    return rows.join(done.select(F.col("row").alias("_row"), "fold"), "_row").select(*df.columns, "fold")


def label_spread(folded: DataFrame, aspects=ASPECTS, k: int = 5) -> DataFrame:
    """(aspect, score, rows, least, most): the rows of each label, and its rows in the folds that have fewest and most."""
    long = folded.unpivot(["fold"], list(aspects), "aspect", "score").where("score > 0")
    counts = long.groupBy("aspect", "score", "fold").agg(F.count("*").alias("n"))
    # A fold without a row of the label has no count.
    least = F.when(F.count("*") < k, 0).otherwise(F.min("n")).cast("long")
    return counts.groupBy("aspect", "score").agg(F.sum("n").alias("rows"), least.alias("least"), F.max("n").alias("most"))
