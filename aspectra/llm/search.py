"""Exact top-k inner products over KD-trees, one tree per shard of the vectors.

The upper splits are the same for the whole table: medians of a bounded sample deal every vector to a cell, and the rows
of a cell are split on at medians of their widest dimension until they are shards, so that a shard is a region with a
tight box. A shard's own tree goes on to small leaves; every node has the tight box of its vectors. A box bounds the
inner product of a query with anything inside, so nodes are visited best bound first until none can reach the query's
k-th score.

A query first searches its own shard. With the k-th score found there, blocks of queries meet the boxes alone, and a
query goes to a few shards of best bounds; with the score then reached, it goes to every other shard whose box can still
beat it, and to no more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.session import stored

#: Most vectors of a shard and of a leaf, queries of a block.
SHARD, LEAF, BLOCK = 4096, 64, 512
#: Shards cut out of one stretch of a cell's rows, which a task holds at once.
GROUP = 8
#: Components of the sample that the upper splits are taken from, and its vectors for each cell.
SAMPLE, CELL = 1 << 21, 16
#: Boxes of a pack, shards of a query in the second round, blocks that share one copy of a shard.
PACK, NEAR, SPAN = 1024, 2, 64
#: Bytes of all boxes up to which their packs are broadcast; above, blocks are joined to them by a shuffle.
BOX_BYTES = 32 << 20
#: The k-th score of a query that has none yet.
NONE = -(1 << 63)


def _spans(n: int) -> list[tuple[int, int, int]]:
    """(start, end, index of the first child or -1) of the nodes over ``n`` sorted rows, parents first."""
    spans, todo = [[0, n, -1]], [0]
    while todo:
        i = todo.pop()
        a, b, _ = spans[i]
        if b - a > LEAF:
            spans[i][2] = len(spans)
            todo += [len(spans), len(spans) + 1]
            spans += [[a, (a + b) // 2, -1], [(a + b) // 2, b, -1]]
    return [tuple(s) for s in spans]


def order_of(points: np.ndarray) -> np.ndarray:
    """Row order in which every node of the tree is a consecutive range."""
    order = np.arange(len(points))
    todo = [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        part = points[order[a:b]]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        mid = (a + b) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], mid - a)]
        todo += [(a, mid), (mid, b)]
    return order


class Tree:
    """The tree over points in the order of ``order_of``."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.spans = points, ids, _spans(len(points))
        self.low = np.array([points[a:b].min(axis=0) for a, b, _ in self.spans], dtype=np.float64)
        self.high = np.array([points[a:b].max(axis=0) for a, b, _ in self.spans], dtype=np.float64)

    def top(self, query: np.ndarray, k: int, least: float, skip: int) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least ``least``, best first; equal scores go to the smaller id.

        ``skip`` is the row of the query itself, or -1.
        """
        wide = query.astype(np.float64)
        bound = np.maximum(self.low * wide, self.high * wide).sum(axis=1)
        bound += 1e-9 * np.abs(bound) + 1e-6
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        if bound[0] < least:
            return best
        todo = [(-bound[0], 0)]
        while todo:
            negative, node = heapq.heappop(todo)
            if -negative < (max(best[0][0], least) if len(best) == k else least):
                break
            a, b, child = self.spans[node]
            if child >= 0:
                heapq.heappush(todo, (-bound[child], child))
                heapq.heappush(todo, (-bound[child + 1], child + 1))
                continue
            scores = self.points[a:b] @ query
            floor = max(best[0][0], least) if len(best) == k else least
            for i in np.flatnonzero(scores >= floor):
                if a + i == skip:
                    continue
                entry = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of a batch, by the length of the vectors."""
    column = batch.column("embedding")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


class Cells:
    """The upper splits for vectors of one length: a complete tree, the children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, rows: float, shard: int):
        """``points`` are sampled from about ``rows`` vectors."""
        depth = int(np.log2(max(min(len(points) / CELL, rows / shard), 1)))
        self.axis, self.value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = [points]
        for node in range(2**depth - 1):
            part = parts[node]
            if len(part):
                self.axis[node] = np.argmax(part.max(axis=0) - part.min(axis=0))
                self.value[node] = np.median(part[:, self.axis[node]])
            right = part[:, self.axis[node]] > self.value[node]
            parts += [part[~right], part[right]]
        share = np.bincount(self.of(points), minlength=2**depth) / max(len(points), 1)
        #: Stretches of each cell, so that one that holds a third of all rows is not one task's.
        self.slices = np.maximum(np.ceil(rows * share / (GROUP * shard)), 1).astype(np.int64)

    def of(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(len(self.axis).bit_length()):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.value[node])
        return node - len(self.axis)


def _fit(rows: DataFrame, shard: int) -> dict[int, Cells]:
    """Cells for each length of vectors in a sample of about ``SAMPLE`` components."""
    n, values = rows.agg(F.count("*"), F.sum(F.size("embedding").cast("long"))).first()
    if n <= shard:
        return {}
    most = max(SAMPLE // (values // n), CELL)
    sample: dict[int, list[np.ndarray]] = {}
    for batch in rows.select("embedding").sample(min(most / n, 1.0), 7).limit(most).toArrow().to_batches():
        for _, points in _vectors(batch):
            sample.setdefault(points.shape[1], []).append(points)
    total = sum(len(p) for parts in sample.values() for p in parts)
    return {dim: Cells(p := np.concatenate(parts), n * len(p) / total, shard) for dim, parts in sample.items()}


def _dealt(cells: dict[int, Cells]):
    """Vectors with their cell and its number of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, points in _vectors(batch):
                dim, n = points.shape[1], len(rows)
                cell, slices = np.zeros(n, np.int64), np.ones(n, np.int64)
                if dim in cells:
                    cell = cells[dim].of(points)
                    slices = cells[dim].slices[cell]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(np.full(n, dim, np.int64)), pa.array(cell), pa.array(slices), pa.array([p.tobytes() for p in points], pa.binary())],
                    ["vec_id", "dim", "cell", "slices", "point"],
                )

    return run, "vec_id long, dim long, cell long, slices long, point binary"


def _pieces(points: np.ndarray, shard: int) -> Iterator[np.ndarray]:
    """Row numbers of the shards that median splits make of the points."""
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= shard:
            yield rows
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        rows = rows[np.argpartition(part[:, axis], len(rows) // 2)]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]


def _shards(shard: int):
    """Shards of at most ``shard`` rows, in tree order, of rows that come sorted by length, cell and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, place = TaskContext.get().partitionId(), 0, None
        held: list[tuple[int, bytes]] = []

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = np.array([i for i, _ in held], np.int64)
            points = np.frombuffer(b"".join(p for _, p in held), np.int64).reshape(len(ids), -1)
            held.clear()
            for rows in _pieces(points, shard):
                rows = rows[order_of(points[rows])]
                box = [points[rows].min(axis=0).astype(np.float64).tobytes(), points[rows].max(axis=0).astype(np.float64).tobytes()]
                values = [(task << 31) + made, points.shape[1], ids[rows].tobytes(), points[rows].tobytes(), *box]
                made += 1
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["shard", "dim", "ids", "points", "low", "high"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("dim", "cell", "slice", "vec_id", "point"))
            for dim, cell, piece, vec_id, point in zip(*columns):
                if held and ((dim, cell, piece) != place or len(held) == GROUP * shard):
                    yield from cut()
                place = (dim, cell, piece)
                held.append((vec_id, point))
        if held:
            yield from cut()

    return run, "shard long, dim long, ids binary, points binary, low binary, high binary"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return ids, np.frombuffer(row["points"], dtype=np.int64).reshape(len(ids), -1)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _own(divisor: int, k: int):
    """Blocks of queries with their best in their own shard and the k-th score; a query is known by block and place."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    top = pa.list_(pa.struct([("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
    names = ["block", "dim", "home", "query_id", "points", "least", "top"]
    kinds = [pa.int64(), pa.int64(), longs, longs, pa.binary(), longs, top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, dim = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal made
            found = [{"q": q, "query_id": x[1], "vec_id": j, "score": s} for q, x in enumerate(held) for s, j in x[4]]
            row = ((task << 31) + made, dim, [x[0] for x in held], [x[1] for x in held], b"".join(x[2] for x in held), [x[3] for x in held], found)
            made += 1
            held.clear()
            return _table([row], names, kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if held and dim != row["dim"]:
                    yield block()
                dim = row["dim"]
                ids, points = _unpack(row)
                tree = Tree(points, ids)
                for i in np.flatnonzero(ids % divisor == 0):
                    got = tree.top(points[i], k, NONE, int(i))
                    held.append((row["shard"], int(ids[i]), points[i].tobytes(), got[-1][0] if len(got) == k else NONE, got))
                    if len(held) == BLOCK:
                        yield block()
        if held:
            yield block()

    return run, "block long, dim long, home array<long>, query_id array<long>, points binary, least array<long>, top array<struct<q int, query_id long, vec_id long, score long>>"


def _reached(near: int | None):
    """Queries of a block for every shard of a pack whose box reaches their k-th score; with ``near``, its best so many."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    names = ["shard", "block", "q", "query_id", "points", "least"]
    kinds = [pa.int64(), pa.int64(), ints, longs, pa.binary(), longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, ids, least = row["dim"], np.array(row["query_id"], np.int64), np.array(row["least"], np.int64)
                for x in row["tight"] or []:
                    least[x["q"]] = max(least[x["q"]], x["score"])
                points = np.frombuffer(row["points"], np.int64).reshape(-1, dim)
                shard = np.array([x["shard"] for x in row["boxes"]], np.int64)
                low, high = (np.frombuffer(b"".join(x[side] for x in row["boxes"]), np.float64).reshape(-1, dim) for side in ("low", "high"))
                wide = points.astype(np.float64)
                bound = np.maximum(wide, 0) @ high.T + np.minimum(wide, 0) @ low.T
                # More than the sums can be off by.
                bound += 1e-9 * np.outer(np.abs(wide).sum(axis=1), np.maximum(np.abs(low), np.abs(high)).max(axis=1)) + 1e-6
                reach = (bound >= least[:, None].astype(np.float64)) & (np.array(row["home"], np.int64)[:, None] != shard)
                place = {s: j for j, s in enumerate(shard.tolist())}
                for x in row["seen"] or []:
                    if x["shard"] in place:
                        reach[x["q"], place[x["shard"]]] = False
                if near is not None and near < len(shard):
                    bound[~reach] = -np.inf
                    best = np.zeros_like(reach)
                    np.put_along_axis(best, np.argpartition(-bound, near - 1, axis=1)[:, :near], True, axis=1)
                    reach &= best
                out = []
                for j in np.flatnonzero(reach.any(axis=0)):
                    q = np.flatnonzero(reach[:, j])
                    out.append((int(shard[j]), row["block"], q.tolist(), ids[q].tolist(), points[q].tobytes(), least[q].tolist()))
                if out:
                    yield _table(out, names, kinds)

    return run, "shard long, block long, q array<int>, query_id array<long>, points binary, least array<long>"


def _searched(k: int):
    """The best of a shard for the queries sent to it; rows come sorted, a shard before its queries."""
    names, kinds = ["block", "q", "query_id", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] is None:
                    ids, points = _unpack(row)
                    tree = Tree(points, ids)
                    continue
                queries = np.frombuffer(row["points"], np.int64).reshape(len(row["q"]), -1)
                out = []
                for q, query_id, query, least in zip(row["q"], row["query_id"], queries, row["least"]):
                    out += [(row["block"], q, query_id, vec_id, score) for score, vec_id in tree.top(query, k, least, -1)]
                if out:
                    yield _table(out, names, kinds)

    return run, "block long, q int, query_id long, vec_id long, score long"


def _meet(blocks: DataFrame, packs: DataFrame, near: int | None) -> DataFrame:
    columns = ["block", "dim", "home", "query_id", "points", "least", "tight", "seen", "boxes"]
    run, schema = _reached(near)
    return blocks.join(packs, ["dim", "pack"]).select(*columns).mapInArrow(run, schema)


def _visit(sent: DataFrame, shards: DataFrame, spans: int, k: int) -> DataFrame:
    """What the shards hold for the queries sent to them. A shard goes once to each span of blocks that has some for it."""
    sent = sent.withColumn("span", F.pmod(F.xxhash64("block"), F.lit(spans)))
    sides = shards.select("shard", "ids", "points").join(sent.select("shard", "span").distinct(), "shard")
    both = sides.unionByName(sent, allowMissingColumns=True)
    run, schema = _searched(k)
    return both.repartition("shard", "span").sortWithinPartitions("shard", "span", F.asc_nulls_first("block")).mapInArrow(run, schema)


class _Rounds(NamedTuple):
    found: DataFrame
    blocks: DataFrame
    shards: DataFrame
    sent: list[DataFrame]


def _ranked(found: DataFrame) -> DataFrame:
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best))


def _rounds(vectors: DataFrame, k: int, divisor: int, shard: int) -> _Rounds:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good)
    run, schema = _dealt(_fit(rows, shard))
    dealt = rows.mapInArrow(run, schema).withColumn("slice", F.pmod(F.xxhash64("vec_id", "point"), "slices")).drop("slices")
    place = ["dim", "cell", "slice"]
    run, schema = _shards(shard)
    shards = stored(dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, schema), "shards")
    run, schema = _own(divisor, k)
    blocks = stored(shards.select("shard", "dim", "ids", "points").mapInArrow(run, schema), "queries")
    found = blocks.select("block", F.explode("top").alias("x")).select("block", "x.*")

    count, size = shards.agg(F.count("*"), F.sum(F.length("low") + F.length("high"))).first()
    if count <= 1:
        return _Rounds(found, blocks, shards, [])
    number, spans = -(-count // PACK), blocks.count() // SPAN + 1
    box = shards.select("dim", F.pmod(F.xxhash64("shard"), F.lit(number)).cast("int").alias("pack"), F.struct("shard", "low", "high").alias("box"))
    packs = stored(box.groupBy("dim", "pack").agg(F.collect_list("box").alias("boxes")), "boxes")
    packs = F.broadcast(packs) if size <= BOX_BYTES else packs

    # The best few shards of one pack, for a k-th score to go on with.
    blank = blocks.select("block", "dim", "home", "query_id", "points", "least")
    start = blank.withColumn("tight", F.lit(None).cast("array<struct<q int, score long>>")).withColumn("seen", F.lit(None).cast("array<struct<shard long, q array<int>>>"))
    start = start.withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(number)).cast("int"))
    near = stored(_meet(start, packs, NEAR), "near")
    found = found.unionByName(stored(_visit(near, shards, spans, k), "near-found"))

    # All other shards that reach it.
    tight = _ranked(found).where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("q", "score")).alias("tight"))
    seen = near.groupBy("block").agg(F.collect_list(F.struct("shard", "q")).alias("seen"))
    again = blank.join(tight, "block", "left").join(seen, "block", "left").withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    rest = stored(_meet(again, packs, None), "rest")
    return _Rounds(found.unionByName(_visit(rest, shards, spans, k)), blocks, shards, [near, rest])


def top_inner_products(vectors: DataFrame, k: int = 5, divisor: int = 50, shard: int = SHARD) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id (long) and embedding (array of numbers); other columns are ignored. A component x becomes
    floor(256 * x). Queries are the rows whose vec_id is divisible by ``divisor``, candidates all rows but the
    query's own; ties go to the smaller vec_id, and a query with fewer candidates than k returns all. Rows whose
    vec_id is null or whose vector is null, empty or holds a null or a non-finite component take no part; vectors
    meet those of their length only. Rows that repeat a vec_id are rows of their own. Products are exact while
    they stay below 2^63. ``shard`` is the most vectors of a shard.
    """
    best = _ranked(_rounds(vectors, k, divisor, shard).found).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_effort(vectors: DataFrame, k: int = 5, divisor: int = 50, shard: int = SHARD) -> DataFrame:
    """One row on the search: queries, shards, pairs (of a query and a shard other than its own), near_pairs and
    rest_pairs (those searched in the second and the third round) and searched, their share of pairs (null without any).
    """
    rounds = _rounds(vectors, k, divisor, shard)
    sizes = rounds.shards.select("dim", F.lit(0).alias("queries"), F.lit(1).alias("shards"))
    sizes = sizes.union(rounds.blocks.select("dim", F.size("query_id"), F.lit(0))).groupBy("dim").agg(F.sum("queries").alias("queries"), F.sum("shards").alias("shards"))
    rows = sizes.select("queries", "shards", (F.col("queries") * (F.col("shards") - 1)).alias("pairs"))
    for name, sent in zip(("near_pairs", "rest_pairs"), rounds.sent):
        rows = rows.unionByName(sent.select(F.size("q").cast("long").alias(name)), allowMissingColumns=True)
    names = ["queries", "shards", "pairs", "near_pairs", "rest_pairs"]
    known = [F.coalesce(F.sum(n) if n in rows.columns else F.lit(0), F.lit(0)).cast("long").alias(n) for n in names]
    return rows.agg(*known).withColumn("searched", F.expr("try_divide(near_pairs + rest_pairs, pairs)"))
