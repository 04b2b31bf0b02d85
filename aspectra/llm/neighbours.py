"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

Equal shingle sets are one class. Classes that share a band of their MinHash signature are candidates. A
candidate pair compares its signatures batch by batch and is dropped once the posterior probability that its
similarity reaches the threshold falls below the chosen miss probability; what is left is decided on the full
sets.

A band's bucket may hold thousands of classes, so its pairs are not all listed. First every member meets the
bucket's hub, the member that shares most buckets with others, which links most of a group. Members of buckets
that still hold several components then meet by prefixes: in one order of all shingles, rare ones first, two
sets of enough similarity share one of their first shingles, at places that still allow the overlap they need.
This second way is exact, so the components are those of all candidate pairs.

All tables here grow with the input, so joins are by sort and merge whatever their size, and none passes through the
driver as a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.components import components
from aspectra.llm.words import Chunk, chunks, lists, mix, rolling
from aspectra.session import materialise, stored

#: At a similarity of 0.8, 40 bands of 5 rows miss a pair with probability 1.2e-7.
BANDS, ROWS = 40, 5
#: Signature values compared before each look at the posterior.
BATCH = 25
#: Counters of the shingle frequencies that order the prefixes.
COUNTERS = 1 << 20

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and their number per row."""
    starts, ends, row = chunk.words()
    h = chunk.hashes(starts, ends, lower=True)
    whole = rolling(h, k, 0x8CB92BA72F3D8DD7) if len(h) >= k else h[:0]
    bounds = np.searchsorted(row, np.arange(len(chunk.bounds)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(rolling(h[a:b], int(b - a), 0x8CB92BA72F3D8DD7) ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    counts = np.array([len(x) for x in out], dtype=np.int64)
    return (np.concatenate(out) if out else h[:0]), counts


def _signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty set, 32 bits each."""
    at = (np.cumsum(counts) - counts)[counts > 0]
    n = BANDS * ROWS
    out = np.empty((len(at), n), dtype=np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((((values ^ _SEEDS[i]) * (_SEEDS[n + i] | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _node(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One id per non-empty set, equal for equal sets."""
    at = (np.cumsum(counts) - counts)[counts > 0]
    size = counts[counts > 0].astype(np.uint64)
    return mix(np.add.reduceat(mix(values), at) ^ mix(np.bitwise_xor.reduceat(mix(values + np.uint64(7)), at) + size))


def _band_rows(k: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("d", pa.int64()), ("tk", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                part = batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start)
                values, counts = _sets(chunk, k)
                full = counts > 0
                node = np.zeros(len(counts), dtype=np.int64)
                bands = np.zeros((0, BANDS), dtype=np.int64)
                if full.any():
                    node[full] = _node(values, counts).view(np.int64)
                    sig = _signatures(values, counts).astype(np.uint64).reshape(-1, BANDS, ROWS)
                    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                    bands = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("d"), part.column("tk"), pa.array(counts),
                        pa.array(node, mask=~full), lists(pa.int64(), bands.ravel(), np.where(full, BANDS, 0)),
                    ],
                    schema=schema,
                )

    return run, "doc_id long, d long, tk long, n_shingles long, node long, bands array<long>"


def _set_rows(k: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                part = batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start)
                values, counts = _sets(chunk, k)
                if not counts.sum():
                    continue
                sig = _signatures(values, counts)
                items = [v.tobytes() for v in np.split(values, np.cumsum(counts)[:-1]) if len(v)]
                full = pa.array(counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").filter(full), pa.array(counts[counts > 0]),
                        pa.array([s.tobytes() for s in sig], type=pa.binary()), pa.array(items, type=pa.binary()),
                    ],
                    schema=schema,
                )

    return run, "node long, n long, sig binary, items binary"


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) for each batch.

    Under a uniform prior, the similarity given ``m`` matches of ``n`` is Beta(m + 1, n - m + 1); it reaches
    ``threshold`` with the probability that a binomial of n + 1 trials is at most m.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        reach, m = 0.0, 0
        for m in range(n + 1):
            reach += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if reach >= miss:
                break
        out.append((n, m))
    return out


def _prune(threshold: float, miss: float):
    looks = least_matches(threshold, miss)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            live, hits, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            for n, least in looks:
                hits[live] += (one[live, done:n] == two[live, done:n]).sum(axis=1)
                live, done = live[hits[live] >= least], n
            keep = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], schema=schema)

    return run, "a long, b long"


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                one, two = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            keep = pa.array(good, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=schema)

    return run, "a long, b long"


def _slots(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(44)).astype(np.int64) % COUNTERS


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for items in batch.column("items"):
            np.add.at(counts, _slots(np.frombuffer(items.as_buffer(), dtype=np.uint64)), 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["slot", "n"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, root, n, at): the first shingles of each set, rare ones first, and their places.

    The order is by the count of a shingle's slot, then by the shingle itself, so it is one order for all sets;
    the table of slots has COUNTERS entries whatever the input.
    """
    # No shingle of these sets is in a slot of count 0, so those of 1 need not be listed.
    slots = sets.select("items").mapInArrow(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    n = slots.column("n").to_numpy()
    counts = np.ones(COUNTERS, dtype=np.min_scalar_type(n.max(initial=1)))
    counts[slots.column("slot").to_numpy()] = n
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, items in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), batch.column("items")):
                values = np.frombuffer(items.as_buffer(), dtype=np.uint64)
                n = len(values)
                first = n + (-percent * n // 100) + 1
                values = values[np.lexsort((values, shared.value[_slots(values)]))[:first]]
                k = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), *(pa.array(np.full(k, v, dtype=np.int64)) for v in (node, root, n)), pa.array(np.arange(k))],
                    ["token", "node", "root", "n", "at"],
                )

    return stored(sets.mapInArrow(run, "token long, node long, root long, n long, at long"), "prefixes")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Component of each document under links of 100 * intersection >= ``percent`` * union of shingle sets.

    ``docs`` has doc_id (long) and text; other columns are ignored. Texts are taken whole, A-Z lower-cased;
    a set holds the distinct ``words``-word shingles, or the whole word sequence when there are fewer words.
    Returns doc_id, n_shingles, component_id (least doc_id of the component) and kept (doc_id is
    component_id), one row per input row. Null and wordless texts have no shingles, link with nothing and are
    kept. Null doc_ids count as none in the least doc_id; a component without any has a null component_id and
    keeps all of its rows. Rows that repeat a doc_id get the same answer each.
    """
    if not 50 <= percent <= 100 or (1 - (percent / 100) ** ROWS) ** BANDS > 0.3:
        raise ValueError("percent must be 50 to 100")
    threshold = percent / 100
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.xxhash64("text").alias("tk"),
        F.col("text").cast("string").alias("text"),
    )
    run, schema = _band_rows(words)
    rows = stored(docs.mapInArrow(run, schema), "bands")
    filled = rows.where("n_shingles > 0")

    bands = filled.select("node", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("bucket")
    # Members of buckets of several classes: the candidates.
    members = stored(bands.join(shared.hint("merge"), "bucket").select("bucket", "node").distinct(), "buckets")

    reps = (
        filled.select("node", "d", "tk").join(members.select("node").distinct().hint("merge"), "node")
        .groupBy("node").agg(F.min("d").alias("d"), F.min_by("tk", "d").alias("tk"))
    )
    run, schema = _set_rows(words)
    sets = stored(docs.join(reps.hint("merge"), ["d", "tk"]).select("node", "text").mapInArrow(run, schema).dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Links among the pairs (a, b) with a < b, stored."""

        def ends(column: str) -> tuple[DataFrame, DataFrame]:
            return tuple(sets.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col(column).alias(f"{column}_{e}")) for e in "ab")

        one, two = ends("sig")
        # Sets of too different a size cannot reach the threshold.
        alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        run, schema = _prune(threshold, miss)
        left = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(alike).select("a", "b", "sig_a", "sig_b").mapInArrow(run, schema)
        left = stored(left, f"{label}-left")
        one, two = ends("items")
        run, schema = _confirm(percent)
        return stored(left.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "items_a", "items_b").mapInArrow(run, schema), f"{label}-links")

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    met = members.join(sizes.hint("merge"), "bucket").groupBy("node").agg(F.sum("m").alias("met"))
    hubs = members.join(met.hint("merge"), "node").groupBy("bucket").agg(F.max_by("node", "met").alias("hub"))
    links = verified(members.join(hubs.hint("merge"), "bucket").where("node != hub").select(*ordered("node", "hub")).distinct(), "hubs")
    roots = materialise(components(links))

    placed = members.join(roots.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    apart = stored(placed.join(split.hint("merge"), "bucket").select("node", "root").distinct().join(sets.hint("merge"), "node").select("node", "root", "items"), "apart")
    starts = _prefixes(apart, percent)
    one, two = (starts.select("token", *(F.col(c).alias(f"{c}_{e}") for c in ("node", "root", "n", "at"))) for e in "ab")
    # What two sets must share, and what they still can from these places on.
    need = percent * (F.col("n_a") + F.col("n_b"))
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (100 + percent)
    pairs = one.join(two.hint("merge"), "token").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (reach >= need))
    more = verified(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "prefixes")
    if not more.isEmpty():
        # The components found so far stand for the links they came from.
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(roots.hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.select("node", "root").join(groups.hint("merge"), "root").select("node", "component_id")
    full = filled.select("doc_id", "n_shingles", "node").join(nodes.hint("merge"), "node").select("doc_id", "n_shingles", "component_id")
    bare = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without shingles.

    Of a component the row of the least doc_id stays, null ids last; of several such rows the first in the scan. All
    columns stay, whatever their names. The rows are numbered and stored first, so that rows which repeat a doc_id, or
    have none, are decided one by one.
    """
    text, doc_id = F.col("_doc.text").cast("string"), F.col("_doc.doc_id").cast("long")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.monotonically_increasing_id().alias("_at"))
    rows = stored(packed, "numbered")
    found = near_duplicates(rows.select(F.col("_at").alias("doc_id"), text.alias("text")), words, percent, miss)
    ids = rows.select(F.col("_at").alias("doc_id"), F.struct(doc_id.isNull(), doc_id, F.col("_at").alias("at")).alias("order"))
    # A large component leaves each task as one row.
    kept = found.join(ids.hint("merge"), "doc_id").groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.at").alias("_at"))
    return rows.join(kept.hint("merge"), "_at", "left_semi").select("_doc.*")
