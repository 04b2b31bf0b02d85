"""Removal of word windows that occur more than once, found by recompression.

Every task names words by a content hash and compresses each text in rounds: a run of one name becomes one
symbol, then neighbours of a left and a right class (a hash bit of the name and round) become one symbol.
Names are functions of content, so they are global without a dictionary, and equal substrings get equal
symbols except near their borders. For each window the symbols that its own words fix, whatever surrounds
it, are known by position arithmetic; the longest of these on the highest level that has any is its anchor.
Equal windows have equal anchors, so only windows whose anchor name occurs again can repeat. Consecutive
windows of one anchor are one row with a 96-bit hash of all their words: if all rows of a name agree, they
repeat in full; else their single windows are counted by a 96-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.words import Chunk, chunks, lists, mix, rolling
from aspectra.session import new_table_path

#: Rounds of runs and pairs; symbols of four rounds have three words on average.
ROUNDS = 4
_POSITION = np.uint64(0xFFFFFFFF)
#: States of a row of windows: known to repeat in full; to be compared window by window.
_REPEATS, _OPEN = 1, 2
_FIRST, _SECOND = 0xD6E8FEB86659FD93, 0xCA5A826395121157


def _second(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words beside that of base ``_FIRST``."""
    return rolling(mix(h ^ np.uint64(0x5851F42D4C957F2D)), k, _SECOND)


def _upper(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits."""
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _compress(names: np.ndarray, row: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, rnd: int):
    """One round: the new symbols and, for windows knowing symbols lo..hi-1, what they know of these."""
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    times = np.diff(np.append(at, len(names)))
    # The outer runs of a window may go on outside.
    lo, hi = of[lo] + 1, of[hi - 1]
    names = np.where(times > 1, mix(names[at] ^ (times.astype(np.uint64) << np.uint64(40))), names[at])
    row, length = row[at], np.add.reduceat(length, at)

    right = (mix(names + np.uint64(rnd + 1)) & np.uint64(1)).astype(bool)
    second = np.zeros(len(names), dtype=bool)
    second[1:] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    at = np.flatnonzero(~second)
    of = np.cumsum(~second) - 1
    joined = np.zeros(len(names), dtype=bool)
    joined[:-1] = second[1:]
    live = lo < hi
    lo, hi = np.where(live, lo, 0), np.where(live, hi, 1)
    # A right symbol at the left end, or a left one at the right end, may pair with one outside.
    lo, hi = of[lo] + right[lo], of[hi - 1] + right[hi - 1]
    hi = np.where(live, hi, lo)
    after = np.minimum(at + 1, len(names) - 1)
    pair = mix(names[at] * np.uint64(0x9E3779B97F4A7C15) ^ mix(names[after] + np.uint64(0x632BE59BD9B4E019)))
    both = joined[at]
    return np.where(both, pair, names[at]), row[at], length[at] + np.where(both, length[after], 0), lo, hi


def _best(names: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the longest symbol in each range; ties by hash, then the first."""
    n = len(names)
    key = np.minimum(length, 63).astype(np.uint64) << np.uint64(58)
    key |= (mix(names) >> np.uint64(38)) << np.uint64(32)
    key |= _POSITION - np.arange(n, dtype=np.uint64)
    size = hi - lo
    out = np.zeros(len(lo), dtype=np.uint64)
    width = 1
    while True:
        here = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(here):
            out[here] = np.maximum(key[lo[here]], key[hi[here] - width])
        if 2 * width > size.max(initial=0):
            break
        grown = key.copy()
        grown[: n - width] = np.maximum(key[: n - width], key[width:])
        key = grown
        width *= 2
    return (_POSITION - (out & _POSITION)).astype(np.int64)


def _anchors(h: np.ndarray, row: np.ndarray, k: int):
    """Rows of consecutive windows that share an anchor: first word, windows, name, two hashes of all words."""
    if len(h) < k:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 3
    first = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
    anchor = np.zeros(len(first), dtype=np.int64)
    name = np.zeros(len(first), dtype=np.uint64)
    which = np.arange(len(first))
    lo, hi = first, first + k
    names, owner, length = h, row, np.ones(len(h), dtype=np.int64)
    for level in range(ROUNDS + 1):
        if not len(which):
            break
        nxt = _compress(names, owner, length, lo, hi, level) if level < ROUNDS else None
        stay = nxt[3] < nxt[4] if nxt else np.zeros(len(which), dtype=bool)
        end = ~stay
        if end.any():
            best = _best(names, length, lo[end], hi[end])
            anchor[which[end]] = best * (ROUNDS + 1) + level
            name[which[end]] = mix(names[best] + np.uint64(level))
        if nxt:
            names, owner, length, lo, hi = nxt
            which, lo, hi = which[stay], lo[stay], hi[stay]
    if not len(first):
        return first, first, name, name, name
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first)))
    step = (np.arange(len(first)) - np.repeat(at, count)).astype(np.uint64)
    step *= np.uint64(0xA24BAED4963EE407)
    whole, check = (
        mix(np.add.reduceat(mix(window[first] + step), at) + count.astype(np.uint64))
        for window in (rolling(h, k, _FIRST), _second(h, k))
    )
    return first[at], count, name[at], whole, check


def _anchor_rows(k: int):
    schema = pa.schema([("name", pa.int64()), ("whole", pa.int64()), ("check", pa.int32()), ("row", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                starts, ends, row = chunk.words()
                first, count, name, whole, check = _anchors(chunk.hashes(starts, ends), row, k)
                if not len(first):
                    continue
                of = row[first]
                local = first - np.searchsorted(row, of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(_upper(check)),
                        pa.array(ids[chunk.rows][of]),
                        pa.array((local << 6) | count),
                    ],
                    schema=schema,
                )

    return run, "name long, whole long, check int, row long, at long"


def _kept(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, gone: np.ndarray) -> list[str]:
    """Hex SHA-256 of each row's remaining words, joined by one space."""
    data = np.append(chunk.data, np.uint8(0x20))
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[~gone]] += 1
    edge[ends[~gone] + 1] -= 1
    # Each kept word with the byte after it, which becomes the joining space.
    if len(ends):
        touching = np.flatnonzero((ends[:-1] == starts[1:])) if len(ends) > 1 else np.zeros(0, dtype=np.int64)
    else:
        touching = np.zeros(0, dtype=np.int64)
    out = []
    bounds = np.searchsorted(row, np.arange(len(chunk.bounds)))
    if len(touching):  # words of neighbouring rows without a byte between them
        raw = chunk.data.tobytes()
        for r in range(len(chunk.bounds) - 1):
            w = range(bounds[r], bounds[r + 1])
            out.append(hashlib.sha256(b" ".join([raw[starts[i] : ends[i]] for i in w if not gone[i]])).hexdigest())
        return out
    data[ends] = 0x20
    take = np.cumsum(edge[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(take)])
    kept = data[take].tobytes()
    for r in range(len(chunk.bounds) - 1):
        w0, w1 = bounds[r], bounds[r + 1]
        a = before[starts[w0]] if w1 > w0 else 0
        b = before[ends[w1 - 1] + 1] if w1 > w0 else 0
        out.append(hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest())
    return out


def _cover(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def _resolve(k: int):
    """Per document: the result, or what is needed to finish once its single windows are counted."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()),
            ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
            ("covered", pa.binary()), ("windows", pa.list_(pa.int64())), ("h1", pa.list_(pa.int64())),
            ("h2", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for chunk in chunks(texts):
                part = batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start)
                m = part.num_rows
                starts, ends, row = chunk.words()
                bounds = np.searchsorted(row, np.arange(m + 1))
                runs = part.column("runs")
                sizes = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(m), sizes)
                state, count, local = flat & 3, (flat >> 2) & 63, flat >> 8
                first = bounds[of] + local
                sure, compare = (state & _REPEATS) > 0, (state & _OPEN) > 0
                gone = _cover(len(starts), first[sure], first[sure] + count[sure] + k - 1)
                open_rows = np.zeros(m, dtype=bool)
                open_rows[of[~sure]] = True
                # Every window to compare, once.
                many = count[compare]
                window = np.repeat(first[compare], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                window = np.unique(window)
                h = chunk.hashes(starts, ends) if len(window) else np.zeros(0, dtype=np.uint64)
                one = rolling(h, k, _FIRST)[window] if len(window) else h
                two = _second(h, k)[window] if len(window) else h
                per = np.bincount(row[window], minlength=m) if len(window) else np.zeros(m, dtype=np.int64)
                dead = np.flatnonzero(gone)
                removed = np.bincount(row[dead], minlength=m)
                shas = _kept(chunk, starts, ends, row, gone)
                offset = bounds[:-1]
                covered = [np.packbits(gone[bounds[i] : bounds[i + 1]]).tobytes() if o else None for i, o in enumerate(open_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row"),
                        pa.array(np.diff(bounds), type=pa.int64()), pa.array(removed, type=pa.int64()),
                        pa.array(shas),
                        pa.array(covered, type=pa.binary()),
                        lists(pa.int64(), window - offset[row[window]], per),
                        lists(pa.int64(), one.view(np.int64), per), lists(pa.int32(), _upper(two), per),
                    ],
                    schema=schema,
                )

    return run, (
        "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, "
        "covered binary, windows array<long>, h1 array<long>, h2 array<int>"
    )


def _finish(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                part = batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start)
                m = part.num_rows
                starts, ends, row = chunk.words()
                bounds = np.searchsorted(row, np.arange(m + 1))
                of, at = flat(part.column("again"))
                first = bounds[of] + at
                gone = _cover(len(starts), first, first + k)
                for i, bits in enumerate(part.column("covered").to_pylist()):
                    gone[bounds[i] : bounds[i + 1]] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=bounds[i + 1] - bounds[i]).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("n_words"),
                        pa.array(np.bincount(row[gone], minlength=m), type=pa.int64()),
                        pa.array(_kept(chunk, starts, ends, row, gone)),
                    ],
                    schema=schema,
                )

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _store(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_repeats(docs: DataFrame, k: int = 35) -> DataFrame:
    """Words left in each document once every window of ``k`` words that occurs elsewhere is removed.

    ``docs`` has doc_id (long) and text; other columns are ignored. Returns doc_id, n_words, n_removed and
    kept_sha256 (SHA-256 of the kept words joined by one space). Windows are judged on the input, copies in
    the same document count, and one row of ``docs`` is one document: a repeated row repeats all of its
    windows. A null text has no words; a text under ``k`` words keeps all; null doc_ids stay null. ``k`` is
    1 to 63.
    """
    if not 1 <= k <= 63:
        raise ValueError("k must be 1 to 63")
    spark = docs.sparkSession
    # Numbered and stored, so that rows are told apart whatever their doc_id and text, alike in every pass.
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")
    )
    docs = _store(numbered, "numbered")
    run, schema = _anchor_rows(k)
    anchors = docs.select("row", "text").mapInArrow(run, schema)
    # Stored, so that the joins below are between two shuffled tables, whose hot keys Spark can split.
    names = _store(
        anchors.groupBy("name")
        .agg(F.count("*").alias("c"), *(f(h).alias(f"{n}_{h}") for h in ("whole", "check") for n, f in (("least", F.min), ("most", F.max))))
        .where("c > 1")
        .select("name", F.expr("least_whole != most_whole or least_check != most_check").alias("mixed")),
        "names",
    )
    found = _store(anchors.join(names, "name"), "runs")
    # Rows of one name and the same hashes of all words are a class: its windows repeat if it has two rows, and one of
    # them then stands for it when single windows are compared.
    one = F.xxhash64("row", "at")
    classes = _store(
        found.where("mixed").groupBy("name", "whole", "check").agg(F.count("*").alias("c"), F.min(one).alias("stands")).where("c > 1").select("name", "whole", "check", "stands"),
        "classes",
    )
    mixed = found.where("mixed").join(classes, ["name", "whole", "check"], "left")
    again = F.col("stands").isNotNull()
    states = found.where("not mixed").select("row", "at", F.lit(_REPEATS).alias("state")).union(
        mixed.select("row", "at", F.when(~again, _OPEN).when(one == F.col("stands"), _REPEATS | _OPEN).otherwise(_REPEATS).alias("state"))
    )
    runs = states.select("row", F.expr("(at << 2) | state").alias("run")).groupBy("row").agg(F.collect_list("run").alias("runs"))
    run, schema = _resolve(k)
    first = _store(docs.join(runs, "row", "left").select("doc_id", "row", "text", "runs").mapInArrow(run, schema), "substrings")

    unsettled = F.col("covered").isNotNull()
    windows = (
        first.where(F.size("windows") > 0)
        .select("row", F.explode(F.arrays_zip("windows", "h1", "h2")).alias("w"))
        .select("row", "w.windows", "w.h1", "w.h2")
    )
    twice = _store(windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "windows")
    again = windows.join(twice, ["h1", "h2"]).groupBy("row").agg(F.collect_list("windows").alias("again"))
    run, schema = _finish(k)
    rest = (
        docs.select("row", "doc_id", "text")
        .join(first.where(unsettled).select("row", "n_words", "covered"), "row")
        .join(again, "row", "left")
        .select("doc_id", "n_words", "text", "covered", "again")
        .mapInArrow(run, schema)
    )
    return first.where(~unsettled).select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest)
