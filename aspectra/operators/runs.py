"""Runs of words, counted and looked up in the tasks that hold the texts, an Arrow batch at a time.

A text's words come joined by single spaces, and a run of n words is such a string too. What is counted leaves a slice of
texts as one row per distinct run, a pair of words as the ids of both. What is looked
up does not move its places: a table within the bounds of a broadcast goes to the tasks; of a larger one, each batch of
``1 << BATCH`` numbered rows asks for its distinct runs, in one row per batch and shard of the table, and the answers meet
the rows of the batch. A filter of hashes keeps runs from being asked for, or counted, that the table cannot have; it
lets a few others pass, and these find nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, _parse_datatype_string

from aspectra.functions.text import tokenize
from aspectra.operators import lookup
from aspectra.operators.lookup import ROW, numbered
from aspectra.session import stored

#: Rows of a batch, as a power of two.
BATCH = 11
#: Bytes of text that are handled at once; a longer text is handled alone.
SLICE = 8 << 20
#: Bits of a filter for each key, and of any filter, as a power of two.
KEY_BITS, MOST_BITS = 10, 27
#: Runs that all batches may ask of a shard of the table, and most shards, as powers of two.
ASKED, MOST_SHARDS = 20, 16
_ODD, _MIX, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def joined_words(text: Column) -> Column:
    """All words of a text, joined by single spaces; null for a null text."""
    return F.array_join(tokenize(text), " ")


@dataclass(frozen=True)
class Words:
    """The words of some rows one after the other, and where each row begins and ends among them."""

    flat: pa.Array
    bounds: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, blank: bool = False) -> Words:
        """Of joined words; an empty text has no word, or with ``blank`` an empty one."""
        column = _array(column).cast(pa.string()).fill_null("")
        lists = pc.split_pattern(column, " ")
        sizes, flat = np.asarray(pc.list_value_length(lists)).astype(np.int64), lists.flatten()
        if not blank:
            empty = np.asarray(pc.binary_length(column)) == 0
            if empty.any():
                flat = flat.filter(pa.array(np.repeat(~empty, sizes)))
                sizes = np.where(empty, 0, sizes)
        return cls(flat, np.concatenate([[0], np.cumsum(sizes)]))

    def starts(self, n: int) -> np.ndarray:
        """Where runs of n words begin."""
        inside = np.ones(len(self.flat), bool)
        for k in range(1, n):
            last = self.bounds[1:] - k
            inside[last[last >= self.bounds[:-1]]] = False
        return np.flatnonzero(inside)

    def runs(self, starts: np.ndarray, n: int) -> pa.Array:
        words = [self.flat.take(pa.array(starts + k)) for k in range(n)]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")

    @cached_property
    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's place in the distinct words, and these."""
        coded = self.flat.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        codes, distinct = self.coded
        return word_hashes(distinct)[codes]

    def kinds(self, starts: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n words, the same for equal runs and for no others."""
        codes, distinct = self.coded
        kind = codes[starts]
        for k in range(1, n):
            # Numbered anew, so that the product stays small.
            kind = kind if k == 1 else np.unique(kind, return_inverse=True)[1]
            kind = kind * len(distinct) + codes[starts + k]
        return kind

    def rows(self, kept: np.ndarray) -> np.ndarray:
        """Bounds of the rows among those words that are kept."""
        return np.concatenate([[0], np.cumsum(kept)])[self.bounds]


def _array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def word_hashes(words: pa.Array, salt: int = 0) -> np.ndarray:
    """The sum of the hashes of a word's bytes, each with its place, for all words at once."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
    bounds -= bounds[0]
    place = (np.arange(len(raw)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    h = (raw + (place << np.uint64(8)) + np.uint64((salt << 48) + 1)) * _ODD
    h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _OTHER
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h ^ (h >> np.uint64(31)), dtype=np.uint64)])[bounds]
    return total[1:] - total[:-1]


def run_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = (h ^ words[starts + k]) * _ODD
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return (h ^ (h >> np.uint64(27))) * _OTHER


@dataclass(frozen=True)
class KeyFilter:
    """Two bits for each key of a table, by hashes of its words; a key of the table always passes."""

    bits: np.ndarray
    power: int

    @staticmethod
    def places(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - power)
        return (hashes >> shift).astype(np.int64), ((hashes * _ODD) >> shift).astype(np.int64)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        one, two = ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in self.places(hashes, self.power))
        return (one & two).astype(bool)


def key_filter(table: DataFrame, key: str) -> KeyFilter:
    """The filter of a stored table's keys, at most 16 MB. More keys than that is made for let more others pass."""
    power = int(np.clip(np.ceil(np.log2(KEY_BITS * max(table.count(), 1))), 15, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words.of(batch.column(0), blank=True)
            hashes, sizes = words.hashes(), np.diff(words.bounds)
            for n in np.unique(sizes).tolist():
                for places in KeyFilter.places(run_hashes(hashes, words.bounds[:-1][sizes == n], n), power):
                    yield pa.RecordBatch.from_arrays([pa.array(places + 1)], ["place"])

    places = table.where(F.col(key).isNotNull()).select(key).mapInArrow(run, "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    size = (1 << 15) // 8
    bits = np.zeros((1 << power) // 8, np.uint8)
    for r in parts.collect():
        bits[(r.part - 1) * size : r.part * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return KeyFilter(bits, power)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to, of at most SLICE bytes of text or of one row."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + SLICE, side="right")), start + 1)
        yield start, stop
        start = stop


def count_runs(texts: DataFrame, n: int, parts: KeyFilter | None = None, words: str = "words") -> DataFrame:
    """(phrase, count) of the runs of n words in joined words. With ``parts``, a filter of runs of n - 1 words, only of
    those whose first and last n - 1 words pass."""
    spark = texts.sparkSession
    sent = None if parts is None else spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for start, stop in slices(column):
                got = Words.of(column.slice(start, stop - start))
                at = got.starts(n)
                if sent is not None:
                    shorter = got.starts(n - 1)
                    passing = np.zeros(len(got.flat) + 1, bool)
                    passing[shorter] = sent.value.passing(run_hashes(got.hashes(), shorter, n - 1))
                    at = at[passing[at] & passing[at + 1]]
                if len(at):
                    counts = pc.value_counts(got.runs(at, n))
                    yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["phrase", "count"])

    counted = texts.select(words).mapInArrow(run, "phrase string, count long")
    return counted.groupBy("phrase").agg(F.sum("count").alias("count"))


def with_word_ids(counted: DataFrame) -> tuple[DataFrame, int]:
    """(phrase, count, id) of distinct words, stored, and the salt of the ids: the first with which no two words share one."""
    salt = 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], salt: int = salt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word = batch.column(0).cast(pa.string())
                yield pa.RecordBatch.from_arrays([word, batch.column(1), pa.array(word_hashes(word, salt).view(np.int64))], ["phrase", "count", "id"])

        counted = stored(counted.select("phrase", "count").mapInArrow(run, "phrase string, count long, id long"), "word-counts")
        if counted.groupBy("id").count().where("count > 1").isEmpty():
            return counted, salt
        salt += 1


def count_pairs(texts: DataFrame, salt: int, frequent: KeyFilter, words: str = "words") -> DataFrame:
    """(first_id, second_id, count) of the adjacent pairs of words that pass the filter, by the ids of ``with_word_ids``."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for start, stop in slices(column):
                got = Words.of(column.slice(start, stop - start))
                codes, distinct = got.coded
                passing = sent.value.passing(run_hashes(word_hashes(distinct), np.arange(len(distinct)), 1))[codes]
                at = got.starts(2)
                at = at[passing[at] & passing[np.minimum(at + 1, len(codes) - 1)]]
                if len(at):
                    ids, many = word_hashes(distinct, salt).view(np.int64), len(distinct)
                    kinds, counts = np.unique(codes[at] * many + codes[at + 1], return_counts=True)
                    columns = [pa.array(ids[kinds // many]), pa.array(ids[kinds % many]), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["first_id", "second_id", "count"])

    counted = texts.select(words).mapInArrow(run, "first_id long, second_id long, count long")
    return counted.groupBy("first_id", "second_id").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class Found:
    """Where runs of the table begin: place in ``words.flat``, length, and row of ``values``; by place, longest first."""

    words: Words
    at: np.ndarray
    n: np.ndarray
    entry: np.ndarray
    values: pa.Array | None

    def bounds(self) -> np.ndarray:
        """Where the finds of each row begin and end."""
        return np.searchsorted(self.at, self.words.bounds)


def _find(words: Words, keys: pa.Array, values: pa.Array | None, lengths: range, passing: KeyFilter | None = None) -> Found:
    hashes = None if passing is None else words.hashes()
    found = []
    for n in lengths:
        at = words.starts(n)
        if passing is not None:
            at = at[passing.passing(run_hashes(hashes, at, n))]
        # Each distinct run is looked up once.
        _, first, kind = np.unique(words.kinds(at, n), return_index=True, return_inverse=True)
        entry = pc.index_in(words.runs(at[first], n), value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False)[kind]
        hit = entry >= 0
        found.append((at[hit], np.full(int(hit.sum()), n), entry[hit]))
    at, n, entry = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-n, at))
    return Found(words, at[order], n[order], entry[order], values)


Choose = Callable[[Found, "pa.Array | None"], pa.Array]


def looked_up(
    rows: DataFrame, words: Column, table: DataFrame, lengths: range, choose: Choose, name: str, kind: str,
    extra: Column | None = None, blank: bool = False, large: bool = False,
) -> DataFrame:
    """``rows`` with a column ``name`` of type ``kind``: what ``choose`` makes of the finds in a slice of rows, one
    value per row, and of the column ``extra``.

    ``words`` are joined words, ``table`` is (key) or (key, value) with one row per key, read several times. ``large``
    takes the way of tables beyond the bounds of a broadcast; the rows are the same.
    """
    value = len(table.columns) > 1
    table = table.toDF(*["_key", "_value"][: 1 + value])
    table = table.where(F.col("_key").isNotNull())
    small = not large and lookup.small_count(table) is not None
    kept = [c for c in rows.columns if c != name]
    if not small:
        # The words are made once and stored with the rows, as both sides of the exchange read them.
        kept += [] if ROW in kept else [ROW]
        rows, words = numbered(rows.withColumn("_words", words)), F.col("_words")
    schema = StructType([rows.schema[c] for c in kept] + [StructField(name, _parse_datatype_string(kind))])
    more = [] if extra is None else [extra.alias("_extra")]
    beside = bool(more)
    sent_rows = rows.select(*kept, words.alias("_words"), *more)

    def made(batch: pa.RecordBatch | pa.Table, keys: pa.Array, values: pa.Array | None, passing: KeyFilter | None) -> Iterator[list]:
        column = _array(batch.column("_words"))
        for start, stop in slices(column):
            part = batch.slice(start, stop - start)
            got = _find(Words.of(column.slice(start, stop - start), blank), keys, values, lengths, passing)
            out = choose(got, _array(part.column("_extra")) if beside else None)
            yield [*(_array(part.column(c)) for c in kept), out]

    names = [*kept, name]
    spark = rows.sparkSession
    if small:
        entries = table.toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((_array(entries.column(0)).cast(pa.string()), _array(entries.column(1)) if value else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for columns in made(batch, *sent.value, None):
                    yield pa.RecordBatch.from_arrays(columns, names)

        return sent_rows.mapInArrow(run, schema)

    passing = spark.sparkContext.broadcast(key_filter(table, "_key"))
    asked_at_most = table.count() * ((rows.count() >> BATCH) + 1)
    power = int(np.clip(np.ceil(np.log2(max(asked_at_most, 1))) - ASKED, 0, MOST_SHARDS))
    shift = np.uint64(64 - power) if power else None

    def shard_of(hashes: np.ndarray) -> np.ndarray:
        return np.zeros(len(hashes), np.int64) if shift is None else ((hashes * _MIX) >> shift).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy() >> BATCH
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for first, last in zip(cuts, cuts[1:]):
                column = batch.column(1).slice(first, last - first)
                for start, stop in slices(column):
                    got = Words.of(column.slice(start, stop - start), blank)
                    hashes = got.hashes()
                    for n in lengths:
                        at = got.starts(n)
                        hashed = run_hashes(hashes, at, n)
                        here = passing.value.passing(hashed)
                        at, hashed = at[here], hashed[here]
                        if not len(at):
                            continue
                        one = np.unique(got.kinds(at, n), return_index=True)[1]
                        shard = shard_of(hashed[one])
                        order = np.argsort(shard, kind="stable")
                        shard = shard[order]
                        begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                        runs = pa.ListArray.from_arrays(pa.array(np.append(begin, len(shard)), pa.int32()), got.runs(at[one[order]], n))
                        yield pa.RecordBatch.from_arrays([pa.array(shard[begin]), pa.array(np.full(len(begin), number[first])), runs], ["_shard", "_batch", "_runs"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words.of(batch.column(0), blank=True)
            hashes, sizes = words.hashes(), np.diff(words.bounds)
            shard = np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes).tolist():
                shard[sizes == n] = shard_of(run_hashes(hashes, words.bounds[:-1][sizes == n], n))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["_shard", *batch.schema.names])

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        runs = _array(asked.column("_runs"))
        keys = _array(known.column("_key")).cast(pa.string())
        entry = pc.index_in(runs.flatten().cast(pa.string()), value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = entry >= 0
        sizes = np.asarray(pc.list_value_length(runs)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
        bounds, found = pa.array(bounds, pa.int32()), pa.array(entry[hit])
        columns = [_array(asked.column("_batch")), pa.ListArray.from_arrays(bounds, keys.take(found))]
        if value:
            columns.append(pa.ListArray.from_arrays(bounds, _array(known.column("_value")).take(found)))
        return pa.table(columns, ["_batch", "_keys", "_values"][: 2 + value])

    asked = rows.select(ROW, words.alias("_words")).mapInArrow(ask, "_shard long, _batch long, _runs array<string>")
    dealt = table.mapInArrow(deal, StructType([StructField("_shard", LongType()), *table.schema.fields]))
    told = [StructField("_batch", LongType()), StructField("_keys", ArrayType(StringType()))]
    if value:
        told.append(StructField("_values", ArrayType(table.schema["_value"].dataType)))
    answers = asked.groupBy("_shard").cogroup(dealt.groupBy("_shard")).applyInArrow(reply, StructType(told))

    def answer(batch: pa.Table, known: pa.Table) -> pa.Table:
        # A run that two slices of a batch ask for has two answers; the first is taken.
        keys = _array(known.column("_keys")).flatten().cast(pa.string())
        values = _array(known.column("_values")).flatten() if value else None
        parts = [pa.table(columns, names) for columns in made(batch, keys, values, passing.value)]
        return pa.concat_tables(parts)

    batches = sent_rows.withColumn("_batch", F.shiftright(F.col(ROW), BATCH)).groupBy("_batch")
    return batches.cogroup(answers.groupBy("_batch")).applyInArrow(answer, schema)
