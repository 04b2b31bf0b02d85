"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case, joined by one space, and an end mark. Each byte is eight binary decisions, and
each decision has a tree of contexts: the last 0 to DEPTH bytes. A node estimates its decision from its counts
after Krichevsky and Trofimov, and the weighted probability of a node is half its own and half the product of its
children's. In prediction the estimates of all depths on the path are mixed by the weights that the training
counts give them; a path ends at the deepest context that the training texts have.

Every byte with its DEPTH bytes of context is a gram. Grams and words are counted over all texts, weighed in groups
of equal last three context bytes, and each gram gets one probability. Texts then look up the most frequent grams
and words in tables of a fixed size, and the rest by a join, so that none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.sampling import remainder
from aspectra.llm.words import Chunk, chunks, lowered, mix
from aspectra.session import stored

#: Bytes of context.
DEPTH = 5
#: Entries of the tables that every task holds; the rest of the grams and words is joined.
GRAMS, WORDS = 1 << 20, 1 << 18
#: Counted keys a task holds before it passes them on.
HELD = 1 << 20
SPACE, END = 0x20, 0x0A
_GRAM, _WORD, _TEXT = 0, 1, 2


def byte_stream(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every byte of the normalised texts, and the row of each."""
    m = len(chunk.bounds) - 1
    words = np.bincount(row, minlength=m)
    size = ends - starts
    # DEPTH end marks before each text, and one after; a text without words is its end mark.
    before = (np.arange(m) + 1) * DEPTH + np.concatenate([[0], np.cumsum(words == 0)[:-1]])
    place = np.cumsum(size + 1) - (size + 1) + before[row]
    letters = np.full(m * DEPTH + int((size + 1).sum()) + int((words == 0).sum()), SPACE, dtype=np.uint8)
    text_size = np.bincount(row, weights=size + 1, minlength=m).astype(np.int64) + (words == 0)
    stop = np.cumsum(text_size + DEPTH)
    start = stop - text_size
    source = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    letters[np.repeat(place - starts, size) + source] = lowered(chunk.data[source])
    letters[stop - 1] = END
    for k in range(1, DEPTH + 1):
        letters[start - k] = END
    wide = letters.astype(np.uint64)
    gram = wide.copy()
    for k in range(1, DEPTH + 1):
        gram[k:] |= wide[:-k] << np.uint64(8 * k)
    owner = np.repeat(np.arange(m), text_size)
    at = np.arange(len(owner)) + (owner + 1) * DEPTH
    return gram[at], owner


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; for x of at least 1/2."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to a sequence of so many zeros and ones."""
    small = np.array([0.5])
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 2 * _log_gamma(small)[0] - _log_gamma(zeros + ones + 1.0)


def _nodes(key: np.ndarray, bit: np.ndarray, n: np.ndarray):
    """Distinct keys, each pair's place among them, and the keys' counts of zeros and ones."""
    keys, of = np.unique(key, return_inverse=True)
    ones = np.bincount(of, weights=n * bit, minlength=len(keys))
    return keys, of, np.bincount(of, weights=n, minlength=len(keys)) - ones, ones


def _weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the share of their own estimates in it."""
    weighted = np.logaddexp(own, below) + np.log(0.5)
    return weighted, np.exp(own + np.log(0.5) - weighted)


#: Context bytes that the grams of one group share, and those of the tables made from all groups.
_GROUP, _UPPER = 3, 2


def _decisions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each gram and bit: the gram's place, the decision node (1 to 255) and the bit."""
    byte = (gram & np.uint64(255)).astype(np.int64)
    level = np.arange(8)
    node = (1 << level) | (byte[:, None] >> (8 - level))
    bit = (byte[:, None] >> (7 - level)) & 1
    return np.repeat(np.arange(len(gram)), 8), node.ravel(), bit.ravel()


def _subtree(gram: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Nodes of depth DEPTH up to _GROUP: (keys, place of each decision, zeros, ones, weighted, own share)."""
    of, node, bit = _decisions(gram)
    times = n[of].astype(np.float64)
    out: list[tuple] = []
    for depth in range(DEPTH, _GROUP - 1, -1):
        context = (gram[of] >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
        keys, place, zeros, ones = _nodes((context << np.uint64(8)) | node.astype(np.uint64), bit, times)
        own = log_kt(zeros, ones)
        if out:
            parent = np.empty(len(out[-1][0]), dtype=np.int64)
            parent[out[-1][1]] = place
            weighted, share = _weigh(own, np.bincount(parent, weights=out[-1][4], minlength=len(keys)))
        else:
            weighted, share = own, np.ones(len(keys))
        out.append((keys, place, zeros, ones, weighted, share))
    return out


def _upper_rows(table: pa.Table) -> pa.Table:
    """Of one group: each decision node of the two-byte context above it, with counts and weighted probability."""
    keys, _, zeros, ones, weighted, _ = _subtree(table.column("key").to_numpy().view(np.uint64), table.column("trained").to_numpy())[-1]
    context, node = (keys >> np.uint64(8)) & np.uint64((1 << (8 * _UPPER)) - 1), keys & np.uint64(255)
    return pa.table({"node": ((context << np.uint64(8)) | node).astype(np.int64), "zeros": zeros, "ones": ones, "below": weighted})


class Upper:
    """Estimates of the contexts of 0 to _UPPER bytes: at most 256^2 * 255 decisions, whatever the input."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.levels = []
        for depth in range(_UPPER, -1, -1):
            short = (((node >> 8) & ((1 << (8 * depth)) - 1)) << 8) | (node & 255)
            node, of = np.unique(short, return_inverse=True)
            zeros, ones, below = (np.bincount(of, weights=x, minlength=len(node)) for x in (zeros, ones, below))
            weighted, share = _weigh(log_kt(zeros, ones), below)
            self.levels.append((depth, node, zeros, ones, share))
            below = weighted


def _gram_logs(upper: Upper, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of each gram's byte after its context."""
    of, node, bit = _decisions(gram)
    p = np.full(len(of), 0.5)

    def step(p: np.ndarray, zeros: np.ndarray, ones: np.ndarray, share: np.ndarray, deepest: np.ndarray):
        total = zeros + ones
        own = (np.where(bit == 1, ones, zeros) + 0.5) / (total + 1)
        seen = total > 0
        # The deepest context that training has stands alone; those above mix with what is below.
        return np.where(seen, np.where(deepest, own, share * own + (1 - share) * p), p), deepest & ~seen

    deepest = np.ones(len(of), dtype=bool)
    for _, place, zeros, ones, _, share in _subtree(gram, n):
        p, deepest = step(p, zeros[place], ones[place], share[place], deepest)
    context = (gram[of] >> np.uint64(8)).astype(np.int64)
    for depth, keys, zeros, ones, share in upper.levels:
        at = np.searchsorted(keys, ((context & ((1 << (8 * depth)) - 1)) << 8) | node)
        p, deepest = step(p, zeros[at], ones[at], share[at], deepest)
    return np.bincount(of, weights=np.log10(p), minlength=len(gram))


class Lookup:
    """A fixed map from 64-bit keys to rows, by open addressing, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max((2 * len(keys) - 1).bit_length(), 4) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.used = np.zeros(1 << bits, dtype=bool)
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = np.flatnonzero(~self.used[at[todo]])
            spot, first = np.unique(at[todo[free]], return_index=True)
            took = todo[free[first]]
            self.used[spot], self.keys[spot], self.values[spot] = True, keys[took], values[took]
            todo = np.setdiff1d(todo, took, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each key is there."""
        at = self._home(keys)
        hit = self.used[at] & (self.keys[at] == keys)
        values = np.where(hit, self.values[at], 0.0)
        left = np.flatnonzero(~hit & self.used[at])
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            spot = at[left]
            same = self.used[spot] & (self.keys[spot] == keys[left])
            values[left[same]] = self.values[spot[same]]
            hit[left[same]] = True
            left = left[~same & self.used[spot]]
        return values, hit


class _Counter:
    """Sums of two counts by key, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.fresh = 0

    def add(self, keys: np.ndarray, trained: np.ndarray) -> None:
        keys, of = np.unique(keys, return_inverse=True)
        self.parts.append((keys, np.bincount(of, weights=trained, minlength=len(keys)).astype(np.int64), np.bincount(of, minlength=len(keys))))
        self.size += len(keys)
        self.fresh += len(keys)
        if self.fresh >= HELD:
            self.merge()

    def merge(self) -> None:
        self.fresh = 0
        if len(self.parts) > 1:
            keys, of = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            sums = [np.bincount(of, weights=np.concatenate([p[i] for p in self.parts]), minlength=len(keys)).astype(np.int64) for i in (1, 2)]
            self.parts, self.size = [(keys, *sums)], len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        self.merge()
        got, self.parts, self.size = (self.parts[0] if self.parts else None), [], 0
        return got


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = {_GRAM: _Counter(), _WORD: _Counter()}
    texts = 0

    def emit(kind: int) -> Iterator[pa.RecordBatch]:
        got = counters[kind].take()
        if got is None:
            return
        for at in range(0, len(got[0]), 1 << 16):
            keys, trained, seen = (x[at : at + (1 << 16)] for x in got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(trained), pa.array(seen)], ["kind", "key", "trained", "seen"])

    for batch in batches:
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        texts += int(train.sum())
        for chunk in chunks(batch.column("text")):
            starts, ends, row = chunk.words()
            used = train[chunk.rows]
            gram, owner = byte_stream(chunk, starts, ends, row)
            counters[_GRAM].add(gram, used[owner])
            word = chunk.hashes(starts, ends, lower=True)
            counters[_WORD].add(word, used[row])
            for kind, counter in counters.items():
                if counter.size > HELD:
                    yield from emit(kind)
    for kind in counters:
        yield from emit(kind)
    yield pa.RecordBatch.from_arrays([pa.array([_TEXT], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "trained", "seen"])


_SCORED = "kind int, key long, row long, times long, doc_id long, held_out boolean, n_words long, model double, base double, known long, coded long"


def _score_rows(tables):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(_SCORED.split(", "), kinds)])

    def rest(kind: int, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """Keys that no table holds, once per text."""
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(keys)))
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(keys[at].view(np.int64)), pa.array(rows[at]), pa.array(times), *(pa.nulls(n, t) for t in kinds[4:])],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = tables.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                m = len(chunk.bounds) - 1
                starts, ends, row = chunk.words()
                ids = number + np.arange(m)
                number += m
                gram, owner = byte_stream(chunk, starts, ends, row)
                log, hit = grams.get(gram)
                model = np.bincount(owner, weights=log, minlength=m)
                if not hit.all():
                    yield rest(_GRAM, gram[~hit], ids[owner[~hit]])
                word = chunk.hashes(starts, ends, lower=True)
                count, hit = words.get(word)
                base = np.bincount(row, weights=np.log10(count.astype(np.float64) + 1), minlength=m)
                known = np.bincount(row[hit], minlength=m)
                if not hit.all():
                    yield rest(_WORD, word[~hit], ids[row[~hit]])
                part = batch.slice(chunk.rows.start, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, _TEXT, dtype=np.int32)), pa.array(mix(ids.astype(np.uint64)).view(np.int64)), pa.array(ids), pa.nulls(m, pa.int64()),
                        part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(row, minlength=m)), pa.array(model), pa.array(base), pa.array(known), pa.array(np.bincount(owner, minlength=m)),
                    ],
                    schema=schema,
                )

    return run, _SCORED


def _frequent(table: DataFrame, most: int) -> int:
    """A ``seen`` that at most ``most`` keys reach, and about as many as that allows.

    Counts are taken by buckets of ``seen``, a 32nd of a doubling wide from 1,024 on, of which there are a few thousand
    whatever the table; a bucket that does not fit any more is left out whole.
    """
    bucket = F.when(F.col("seen") < 1024, F.col("seen")).otherwise(1024 + F.floor(F.log2(F.col("seen").cast("double")) * 32))
    counts = table.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("seen").alias("top"))
    total = 0
    for r in sorted(counts.collect(), reverse=True):
        total += r["n"]
        if total > most:
            return r["top"] + 1
    return 0


def gram_table(counts: DataFrame) -> DataFrame:
    """(key, seen, value): log10 of each gram's byte after its context, from (key, trained, seen) of all grams."""
    grams = counts.withColumn("g", F.expr(f"(key >> 8) & {(1 << (8 * _GROUP)) - 1}"))
    upper = grams.groupBy("g").applyInArrow(_upper_rows, "node long, zeros double, ones double, below double")
    # At most 256^2 * 255 rows, and only as many as there are pairs of bytes in use.
    rows = upper.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toArrow()
    tables = counts.sparkSession.sparkContext.broadcast(Upper(*(rows.column(i).to_numpy() for i in range(4))))

    def logs(table: pa.Table) -> pa.Table:
        gram = table.column("key").to_numpy().view(np.uint64)
        return pa.table({"key": table.column("key"), "seen": table.column("seen"), "value": _gram_logs(tables.value, gram, table.column("trained").to_numpy())})

    return grams.groupBy("g").applyInArrow(logs, "key long, seen long, value double")


def score_texts(docs: DataFrame, divisor: int = 7, held: int = 2) -> DataFrame:
    """Unigram and context-tree scores of each whole text.

    ``docs`` has doc_id (long) and text; other columns are ignored. Training texts are those whose crc32(doc_id)
    modulo ``divisor`` is not ``held``. Returns doc_id, held_out, n_tokens (words and the end), n_known, train_tokens,
    base_score (add-one unigrams), score (log10 probability of the normalised text, end included) and
    code_length_per_byte (bits for each of its bytes, the end one of them), one row per input row. A null text is empty: its only token is the end. A null doc_id is not held out. Without training
    texts every bit costs one bit.
    """
    spark = docs.sparkSession
    rest = remainder("doc_id", divisor)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(_count_rows, "kind int, key long, trained long, seen long")
    counts = stored(counted.groupBy("kind", "key").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen")), "counts")
    words = counts.where((F.col("kind") == _WORD) & (F.col("trained") > 0)).select("key", F.col("trained").alias("seen"), F.col("trained").cast("double").alias("value"))
    grams = stored(gram_table(counts.where(F.col("kind") == _GRAM).select("key", "trained", "seen")), "grams")

    texts = counts.where(F.col("kind") == _TEXT).agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    n, v = words.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long"), F.count("*")).first()
    n, v = n + texts, v + (texts > 0)

    lookups, joined = [], None
    for kind, table, most in ((_GRAM, grams, GRAMS), (_WORD, words, WORDS)):
        least = _frequent(table, most)
        top = table.where(F.col("seen") >= least).select("key", "value").toArrow()
        lookups.append(Lookup(top.column("key").to_numpy().view(np.uint64), top.column("value").to_numpy()))
        part = table.where(F.col("seen") < least).select(F.lit(kind).alias("kind"), "key", "value")
        joined = part if joined is None else joined.union(part)
    run, schema = _score_rows(spark.sparkContext.broadcast(tuple(lookups)))
    scored = docs.mapInArrow(run, schema).join(joined, ["kind", "key"], "left")
    gram, word = F.col("kind") == _GRAM, (F.col("kind") == _WORD) & F.col("value").isNotNull()
    sums = scored.select(
        "row", "doc_id", "held_out", "n_words",
        F.when(gram, F.col("times") * F.col("value")).otherwise(F.col("model")).alias("model"),
        F.when(word, F.col("times") * F.log10(F.col("value") + 1)).otherwise(F.col("base")).alias("base"),
        F.when(word, F.col("times")).otherwise(F.col("known")).alias("known"), "coded",
    ).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_words").alias("n_words"),
        F.sum("model").alias("model"), F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("coded").alias("coded"),
    )
    tokens = F.col("n_words") + 1
    end = float(np.log10(texts + 1))
    return sums.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + int(texts > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + end - tokens * float(np.log10(n + v + 1))).alias("base_score"), F.col("model").alias("score"),
        (-F.col("model") * float(np.log2(10)) / F.col("coded")).alias("code_length_per_byte"),
    )
