"""How far the sources of a language differ in the terms they use, from term stripes folded in the mappers.

A task folds whole documents into hash stripes, term to (document frequency, occurrences by source), and hands the
stripes on whenever they hold ``ENTRIES`` counts, so that its memory does not grow with its input. Stripes of one term
are then merged by key. Every later figure comes from merged stripes: a stripe gives the terms' shares in the
groups that use it, and each task adds up the differences between the sources of its own stripes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.session import stored

#: Counts that a task holds before it hands its stripes on.
ENTRIES = 500_000
#: Pairs of counts that are compared at once, and sums of pairs held before they are handed on.
PAIRS = 1 << 20
#: Shares are stated in parts of this number.
WHOLE = 1_000_000_000

# Bytes of a term stay (A-Z in lower case), the others separate terms. In UTF-8 every byte of a character beyond
# ASCII is at least 80, so this equals [^\x00-\x40\x5B-\x60\x7B-\x7F]+ on code points.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_STRIPES = pa.schema([
    ("lang", pa.string()),
    ("term", pa.string()),
    ("docs", pa.int64()),
    ("stripe", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))),
])


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


class _Stripes:
    """Hash stripes by language; the empty term marks the sources that occur, whether they have terms or not."""

    def __init__(self) -> None:
        self.tables: dict[str, dict[bytes, list]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: str) -> None:
        table = self.tables.setdefault(lang, {})
        counts = Counter(terms(text))
        counts[b""] = 0
        for term, n in counts.items():
            stripe = table.get(term)
            if stripe is None:
                table[term] = [1, {source: n}]
                self.entries += 1
            else:
                stripe[0] += 1
                by_source = stripe[1]
                if source in by_source:
                    by_source[source] += n
                else:
                    by_source[source] = n
                    self.entries += 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, table in self.tables.items():
            rows = list(table.items())
            for start in range(0, len(rows), 20_000):
                part = rows[start : start + 20_000]
                sources, counts, ends = [], [], [0]
                for _, (_, by_source) in part:
                    sources.extend(by_source)
                    counts.extend(by_source.values())
                    ends.append(len(counts))
                entries = pa.StructArray.from_arrays([pa.array(sources, pa.string()), pa.array(counts, pa.int64())], names=["source", "n"])
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([term for term, _ in part], pa.binary()).cast(pa.string()),
                    pa.array([docs for _, (docs, _) in part], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_STRIPES)
        self.tables, self.entries = {}, 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Stripes()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            for lang, source, text in zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "text"))):
                held.add(lang, source, text)
                if held.entries >= ENTRIES:
                    yield from held.flush()
    yield from held.flush()


def merged_stripes(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, stripe) with one row per language and term; stripe has (source, n) for each source of it.

    The sums run by (lang, term, source) on rows dealt out by (lang, term), so that no task gathers the stripes of
    many mappers before they are added up. The row of the empty term lists the sources of a language.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    folded = texts.mapInArrow(_fold, "lang string, term string, docs long, stripe array<struct<source string, n long>>")
    entries = folded.repartition("lang", "term").select(
        "lang", "term", "docs", F.posexplode("stripe").alias("place", "entry")
    )
    # The documents of a stripe go with its first entry only.
    summed = entries.groupBy("lang", "term", F.col("entry.source").alias("source")).agg(
        F.sum("entry.n").alias("n"), F.sum(F.when(F.col("place") == 0, F.col("docs")).otherwise(0)).alias("docs")
    )
    return summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("stripe"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(WHOLE * (count + 1) / (total + kept)), exact for totals below 2^53; null where there are no kept terms.

    Long division in three steps of a thousand, since the product itself may leave 64 bits.
    """
    whole, rest, over = "0L", f"({count} + 1L)", f"({total} + {kept})"
    for _ in range(3):
        step = f"({rest} * 1000L)"
        whole, rest = f"({whole} * 1000L + {step} div {over})", f"({step} % {over})"
    return F.when(F.expr(f"{kept} > 0"), F.expr(f"1L + {whole}"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


_PAIR_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, source, item) of what the terms that both use add to what either alone accounts for."""
    sums: dict[tuple[str, int, int], int] = {}
    names: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        known = list(names)
        keys = list(sums)
        columns = [[k[0] for k in keys], [known[k[1]] for k in keys], [known[k[2]] for k in keys], list(sums.values())]
        sums.clear()
        names.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIR_SUMS)], schema=_PAIR_SUMS)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        stripes = batch.column("stripe")
        lengths = np.diff(stripes.offsets.to_numpy()).astype(np.int64)
        flat = stripes.flatten()
        p, none = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("p", "none"))
        texts = flat.field("source").dictionary_encode()
        here = np.array([names.setdefault(s, len(names)) for s in texts.dictionary.to_pylist()], dtype=np.int64)
        source = here[texts.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        size = np.repeat(lengths, lengths)
        kinds, lang_of = np.unique(langs.astype(str), return_inverse=True) if len(langs) else (np.zeros(0), np.zeros(0, np.int64))
        lang = np.repeat(lang_of, lengths)
        done = np.cumsum(size)
        start = 0
        while start < len(size):
            limit = (done[start - 1] if start else 0) + PAIRS
            stop = max(int(np.searchsorted(done, limit, side="right")), start + 1)
            k = size[start:stop]
            a = np.repeat(np.arange(start, stop), k)
            b = np.repeat(first[start:stop], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            a, b = a[a != b], b[a != b]
            value = _gaps(p[a], p[b]) - _gaps(p[a], none[b]) - _gaps(none[a], p[b]) + _gaps(none[a], none[b])
            codes, place = np.unique((lang[a] * len(names) + source[a]) * len(names) + source[b], return_inverse=True)
            total = np.zeros(len(codes), dtype=np.int64)
            np.add.at(total, place, value)
            for code, add in zip(codes.tolist(), total.tolist()):
                rest, item = divmod(code, len(names))
                which, own = divmod(rest, len(names))
                key = (str(kinds[which]), own, item)
                sums[key] = sums.get(key, 0) + add
            start = stop
        if len(sums) > PAIRS:
            yield flush()
    yield flush()


def divergences(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """Per (lang, source): how its term shares differ from each other source's, and its most typical terms.

    ``docs`` has text, lang and source, null read as ''; other columns are ignored. Terms are the longest runs of
    ASCII letters, in lower case, and of characters beyond ASCII. A language keeps the terms of at least
    ``least_docs`` of its documents; V is their number. A group's share of a term it uses c times is
    1 + floor(10^9 (c + 1) / (N + V)), N its uses of all kept terms; a term it does not use has c = 0. The gap of p to
    q is floor((p - q)^2 / q). Returns lang, source, part, item, value and rank: part ``pair`` has a row for every
    other source of the language, value the gaps to it summed over all kept terms (0 if there are none); part ``term``
    has the ``most_terms`` kept terms of the greatest gap among those that the source uses more than the whole
    language does. Ranks go by value downwards, ties by item. Documents that are there twice count twice; a group
    without terms has pairs and no terms; a language of one source has no pairs; an empty table gives an empty one.

    Totals must stay below 2^53. Terms that neither of two sources uses are not visited: what they, and the terms
    of one of them alone, add follows from counts of equal shares; stripes add what the terms of both change.
    """
    merged = stored(merged_stripes(docs), "term-stripes")
    kept = merged.where((F.col("term") != "") & (F.col("docs") >= least_docs)).select("lang", "term", "stripe")
    uses = kept.select("lang", "term", F.explode("stripe").alias("e")).select("lang", "term", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    every = merged.where("term = ''").select("lang", F.explode("stripe.source").alias("source"))
    used = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    in_lang = Window.partitionBy("lang")
    groups = (
        every.join(used, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept")))
        .withColumn("lang_total", F.sum("total").over(in_lang))
        .withColumn("none", share("0L", "total", "kept"))
    )
    groups = stored(groups, "term-groups")

    spread_out = kept.select("lang", "term", F.aggregate("stripe", F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("all"), F.explode("stripe").alias("e"))
    shares = (
        spread_out.select("lang", "term", "all", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
        .join(groups, ["lang", "source"])
        .select("lang", "source", "term", "none", "all", "n", "lang_total", "kept", share("n", "total", "kept").alias("p"))
    )
    typical = (
        shares.withColumn("q", share("all", "lang_total", "kept"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    )

    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    level = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("terms"))
    # For each pair: all kept terms as if neither used them, ...
    pairs = groups.join(other, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("kept") * gap(F.col("none"), F.col("other_none")), F.lit(0)).alias("value"))
    # ... what the terms of the one change against that, ...
    levels = level.join(other, "lang").where("source <> item")
    own = levels.select("lang", "source", "item", (F.col("terms") * (gap(F.col("p"), F.col("other_none")) - gap(F.col("none"), F.col("other_none")))).alias("value"))
    # ... those of the other, ...
    theirs = levels.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"),
        (F.col("terms") * (gap(F.col("other_none"), F.col("p")) - gap(F.col("other_none"), F.col("none")))).alias("value"),
    )
    # ... and those of both.
    both = (
        shares.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "p", "none")).alias("stripe"))
        .select("lang", "stripe")
        .mapInArrow(_shared, "lang string, source string, item string, value long")
    )
    exact = F.sum(F.col("value").cast("decimal(38,0)")).cast("long")
    differing = base.unionByName(own).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(exact.alias("value"))
    differing = differing.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = typical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return differing.withColumn("rank", F.row_number().over(order)).unionByName(top)
