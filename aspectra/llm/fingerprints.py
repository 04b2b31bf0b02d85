"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A sketch is three tables of cells; a digest enters one cell of each, adding to its count and xor-ing itself and
its check. Sketches of two versions subtract cell by cell, which cancels what both share. Peeling then reads a
digest off every cell that holds exactly one, takes it out of its other cells and goes on until all cells are
empty. If cells are left over, the difference was too large for the sketch, and larger ones are tried with fresh
positions: the digests are split among groups of one small sketch each. Everything is built from DataFrame
functions on the arrays of one row, so nothing is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.session import new_table_path

#: Cells of one table (three tables make a sketch), a power of two.
WIDTH = 8
#: Digests of both versions together for each group of the first larger sketch.
LOAD = 8
#: Larger sketches tried after the fingerprints; each has twice the groups of the one before.
RETRIES = 4
#: Digests that are split into groups at once.
BLOCK = 1024
#: Rounds of peeling; a sketch of 24 cells is empty or stuck by then.
ROUNDS = 24
#: Rows of the (doc_id, text hash) table in one range of the order of documents, and the most ranges.
RANGE_ROWS, RANGES = 200_000, 4096


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often the result names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def paragraphs(text: Column) -> Column:
    """Distinct paragraphs: lines, cut at the first white space after every 320 characters; where a word of more than
    80 characters stands there, the rest of the line is one paragraph, so that long runs stay linear."""
    cut = F.regexp_replace(text, r"((?:\G|(?<=\n))[^\n]{320}\S{0,80}+)\s", "$1\n")
    return F.array_distinct(F.filter(F.transform(F.split(cut, "\n"), F.trim), lambda p: p != ""))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _entry(digest: Column, sign: Column, seed: Column) -> Column:
    """A digest with its sign, its check and its three cells."""

    def made(h: Column) -> Column:
        spot = [F.shiftright(h, 20 * t).bitwiseAND(WIDTH - 1).cast("int") for t in range(3)]
        return F.struct(digest.alias("k"), sign.cast("long").alias("n"), h.alias("c"), spot[0].alias("p0"), spot[1].alias("p1"), spot[2].alias("p2"))

    return _let(F.xxhash64(digest, seed), made)


def _add(entries: Column, cells: Column | None = None) -> Column:
    """Cells after adding the entries, a bound variable, to ``cells`` (None: empty cells)."""

    def cell(start: Column, here: Column) -> Column:
        return F.aggregate(
            here, start,
            lambda s, e: F.struct((s["n"] + e["n"]).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c")),
        )

    def table(t: int) -> Column:
        at = lambda i: F.filter(entries, lambda e: e[f"p{t}"] == i)
        if cells is None:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
            return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: cell(zero, at(i)))
        return F.transform(F.slice(cells, WIDTH * t + 1, WIDTH), lambda c, i: cell(c, at(i)))

    return F.concat(*(table(t) for t in range(3)))


def sketch(digest: Column) -> Column:
    """The sketch of an array of distinct digests."""
    return _let(F.transform(digest, lambda d: _entry(d, F.lit(1), F.lit(0))), lambda e: _add(e))


def subtract(one: Column, two: Column) -> Column:
    return F.zip_with(
        one, two,
        lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c")),
    )


def peel(cells: Column, seed: Column) -> Column:
    """The digests in a subtracted sketch, or null if it does not come out empty."""

    def step(s: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["k"], seed) == c["c"]))
        # Taken out with the opposite sign.
        out = F.array_distinct(F.transform(pure, lambda c: _entry(c["k"], -c["n"], seed)))
        return _let(
            out,
            lambda o: F.when(
                F.size(o) > 0,
                F.struct(_add(o, s["cells"]).alias("cells"), F.concat(s["got"], F.transform(o, lambda e: e["k"])).alias("got"), F.lit(True).alias("go")),
            ).otherwise(F.struct(s["cells"].alias("cells"), s["got"].alias("got"), F.lit(False).alias("go"))),
        )

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("got"), F.lit(True).alias("go"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["go"], step(s)).otherwise(s),
        lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)), s["got"]),
    )


def _in_groups(one: Column, two: Column, turn: Column) -> Column:
    """Difference by one sketch per group of digests, or null if a group does not come out empty."""
    seed = turn + 1
    signed = F.concat(F.transform(one, lambda d: _entry(d, F.lit(1), seed)), F.transform(two, lambda d: _entry(d, F.lit(-1), seed)))

    def split(entries: Column, most: Column, salt: Column) -> Column:
        """Arrays of the entries, a bound variable, by a hash of the digest, of about ``most`` each."""
        n = F.greatest(F.ceil(F.size(entries) / most), F.lit(1)).cast("int")

        def parts(n: Column) -> Column:
            group = lambda e: F.pmod(F.xxhash64(e["k"], salt), n.cast("long"))
            return F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.filter(entries, lambda e: group(e) == g))

        return _let(n, lambda n: F.when(n == 1, F.array(entries)).otherwise(parts(n)))

    blocks = _let(signed, lambda s: split(s, F.lit(BLOCK), seed + 1000))
    groups = F.flatten(F.transform(blocks, lambda b: split(b, LOAD / F.pow(F.lit(2), turn), seed + 2000)))
    parts = F.transform(groups, lambda g: peel(_add(g), seed))
    return _let(parts, lambda parts: F.when(~F.exists(parts, lambda p: p.isNull()), F.flatten(parts)))


def difference(one: Column, two: Column, digest_one: Column, digest_two: Column) -> Column:
    """Digests of exactly one of two documents, from their sketches and, where these are too small, larger ones."""
    larger = F.aggregate(
        F.sequence(F.lit(0), F.lit(RETRIES - 1)), F.lit(None).cast("array<bigint>"),
        lambda got, turn: F.when(got.isNotNull(), got).otherwise(_in_groups(digest_one, digest_two, turn)),
    )
    # What no sketch decodes (about one pair in 10^9) is compared directly.
    direct = F.concat(F.array_except(digest_one, digest_two), F.array_except(digest_two, digest_one))
    return F.coalesce(peel(subtract(one, two), F.lit(0)), larger, direct)


def likeness(gone: Column, digest_one: Column, digest_two: Column) -> Column:
    """Shared digests, twice, by the digests of both; 1 for two empty documents."""
    both = F.size(digest_one) + F.size(digest_two)
    return F.when(both == 0, 1.0).otherwise((both - F.size(gone)) / both)


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"]))), " ")


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n, next_id, next_tk) for each distinct (doc_id, tk), in ascending order; the last is followed by the first.

    Null doc_ids come first; texts of one doc_id follow each other by text hash.
    """
    spark = docs.sparkSession
    keys = docs.groupBy("doc_id", "tk").agg(F.min("n").alias("n"))
    ranges = min(max(keys.count() // RANGE_ROWS + 1, 1), RANGES)
    path = new_table_path(spark, "order")
    keys.repartitionByRange(ranges, "doc_id", "tk").withColumn("range", F.spark_partition_id()).write.parquet(path)
    keys = spark.read.parquet(path)
    inside = Window.partitionBy("range").orderBy("doc_id", "tk")
    keys = keys.withColumn("here", F.struct("doc_id", "tk"))
    # One row per range, of which there are at most RANGES.
    heads = keys.groupBy("range").agg(F.min("here").alias("head"))
    order = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("later"))
    keys = keys.withColumn("next", F.lead("here").over(inside)).join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "later"))
    return keys.select("doc_id", "tk", "n", F.col("next.doc_id").alias("next_id"), F.col("next.tk").alias("next_tk"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of each document and of its edited text, and their likeness to it.

    ``docs`` has doc_id (long) and text; other columns are ignored. The edited text has the last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; an empty
    text has a sketch of empty cells, and two of them have likeness 1. Equal rows get equal results, and the next
    document is the next one that differs from them in doc_id or text; a single document follows itself.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tk", F.xxhash64("text"))
    order = following(docs.select("doc_id", "tk", F.length("text").alias("n")))
    path = new_table_path(spark, "order")
    order.write.parquet(path)
    order = spark.read.parquet(path)

    # What each document gives to the one before it.
    given = order.select(F.col("doc_id").alias("to_id"), F.col("tk").alias("to_tk"), F.col("n").alias("to_n"), F.col("next_id").alias("doc_id"), F.col("next_tk").alias("tk"))
    match = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])
    head = (
        docs.join(given, match(docs, given))
        .select("to_id", "to_tk", F.expr("substring(text, 1, to_n div 2)").alias("head"), digests(F.col("text")).alias("next_digests"))
        .dropDuplicates(["to_id", "to_tk"])
    )
    joined = docs.join(head, docs["doc_id"].eqNullSafe(head["to_id"]) & (docs["tk"] == head["to_tk"]))
    n = F.length("text")
    edited = joined.select("doc_id", "text", n.alias("n_chars"), "next_digests", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), "head").alias("edited"))
    path = new_table_path(spark, "digests")
    edited.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), F.col("next_digests").alias("following"),
    ).write.parquet(path)
    return _compare(spark.read.parquet(path))


def _compare(rows: DataFrame) -> DataFrame:
    own, changed, after = (F.col(c) for c in ("own", "changed", "following"))
    sketched = rows.withColumns({"s": sketch(own), "s_changed": sketch(changed), "s_after": sketch(after)})
    diffed = sketched.withColumns(
        {
            "gone": difference(F.col("s"), F.col("s_changed"), own, changed),
            "gone_after": difference(F.col("s"), F.col("s_after"), own, after),
        }
    )
    return diffed.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("s_changed")).alias("edited_fingerprint"),
        likeness(F.col("gone"), own, changed).alias("near_edited"), likeness(F.col("gone_after"), own, after).alias("near_next"),
    )
