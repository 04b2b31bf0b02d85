"""Concatenate and cut: token streams laid end to end and cut into windows of a fixed length.

Texts are tokenised once and stored with their place in their partition. The token totals of the partitions,
summed in order, give every partition its offset in the whole stream, and so every document its own; then each
document is cut where its windows end.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.session import new_table_path

#: Units (a space and what follows) whose ids a task remembers; later ones are encoded each time.
CACHE = 200_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The ids of the ``tokenizers`` file at ``path``, read once in each task's process.

    Byte-level BPE files whose ids follow the order of the merges run on the faster ``tiktoken``; texts that hold
    the written form of an added token, which the file turns into that token's id, go through ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    added = [t["content"] for t in spec.get("added_tokens", [])]
    slow = Tokenizer.from_file(path)

    def exact(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if spec["model"].get("type") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
        try:
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        except KeyError:
            ranks = {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"].get(a + b, -1) for a, b in merges]
        prefix = spec["pre_tokenizer"].get("add_prefix_space")
        if ranks and order == sorted(order) and not prefix:
            fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            return Encoder(exact, fast.encode_ordinary, added)
    return Encoder(exact, None, added)


#: A space before something else than white space: there the word pattern starts a new piece, whatever precedes.
#: A space inside a run of white space may belong to the piece before it.
_UNIT = re.compile(r" (?=\S)")


@dataclass(frozen=True)
class Encoder:
    """Exact encoding of any text, and a faster one of texts without the written form of an added token."""

    exact: Callable[[str], list[int]]
    fast: Callable[[str], list[int]] | None
    added: list[str]

    def ids(self, text: str, cache: dict[str, bytes]) -> bytes:
        """Ids as little-endian unsigned 32-bit values; units are encoded one by one and remembered."""
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.exact(text), dtype="<u4").tobytes()
        first, *rest = _UNIT.split(text)
        out = [np.array(self.fast(first), dtype="<u4").tobytes()] if first else []
        for unit in rest:
            got = cache.get(unit)
            if got is None:
                got = np.array(self.fast(" " + unit), dtype="<u4").tobytes()
                if len(cache) < CACHE and len(unit) < 40:
                    cache[unit] = got
            out.append(got)
        return b"".join(out)


def _tokenise(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        cache: dict[str, bytes] = {}
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                ids, places, sizes = [], [], []
                for text in rows.column("text").to_pylist():
                    got = encode.ids(text or "", cache) + end
                    n = len(got) // 4
                    narrow = np.frombuffer(got, dtype="<u4")
                    # Two bytes an id where they suffice; the length tells.
                    ids.append(narrow.astype("<u2").tobytes() if n and narrow.max() < 1 << 16 else got)
                    places.append(before)
                    sizes.append(n)
                    before += n
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([part] * len(ids), pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    schema=schema,
                )

    return run, "doc_id long, part long, before long, n long, ids binary"


def _cut(length: int):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "at", "n"))
            for doc_id, at, n, ids in zip(*columns, batch.column("ids")):
                raw = ids.as_buffer()
                full = np.frombuffer(raw, dtype="<u2" if raw.size == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc_id, start, size, zlib.crc32(full[4 * start : 4 * (start + size)]), n, sequence, offset))
                    start += size
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run, ", ".join(f"{n} long" for n in names)


def pack(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids, all full but the last.

    ``docs`` has doc_id (long) and text; other columns are ignored. A document's ids are those of the
    ``tokenizer`` file (byte_bpe_50k.json if None) and then ``end_id``; a null text is empty, so it is that one
    id. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset, a row per piece. Rows that
    repeat a doc_id are documents of their own. An empty table gives an empty table. The stored token table is
    read in place of the texts after the first pass, so that every piece uses the same order of documents.
    """
    if length < 1:
        raise ValueError("length must be positive")
    spark = docs.sparkSession
    path = new_table_path(spark, "tokens")
    run, schema = _tokenise(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    # One row per partition of the first pass: their number does not depend on the documents.
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    run, schema = _cut(length)
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(run, schema)
