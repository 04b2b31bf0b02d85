"""SentencePiece encoding that keeps the place of every piece in the text, and decoding.

A text is normalised first: at each place where a key of the model's compiled character map may begin, the longest key
is looked up by walking the map's double array, and its replacement is written; the rest is copied. Spaces become the
visible space mark and one goes before the text. For each byte written the byte of the text it came from is kept, so that a
piece, a range of normalised bytes, is projected to a range of bytes of the text. Pieces come from byte-pair merges in
the order of the vocabulary's scores; no piece reaches over the border before a space mark, so a task merges each
word once and remembers it.
"""

from __future__ import annotations

import codecs
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.words import chunks

#: Words whose pieces a task remembers, and the longest word it remembers.
CACHE, CACHED_LENGTH = 300_000, 60
#: Characters up to which the pairs of a word are simply looked through.
SHORT = 40
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BATCH_BYTES = 1 << 20
SPACE = "▁"

# Kinds of pieces in the model format.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6

# One replacement character for each byte that is not part of a character, as the library writes them.
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class CharMap:
    """The compiled character map of a model: a double array over UTF-8 keys, and their replacements.

    A cell of the array is 32 bits: the byte it was reached by, whether a key ends here, and the offset of the next
    cells; the cell of an ended key holds the place of its replacement among null-terminated strings.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.cells = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.texts = compiled[4 + size :]
        self.first = frozenset(b for b in range(256) if self._step(self._root(), b) is not None) if self.cells else frozenset()

    def _offset(self, cell: int) -> int:
        return (cell >> 10) << (8 if cell & 0x200 else 0)

    def _root(self) -> int:
        return self._offset(self.cells[0])

    def _step(self, base: int, byte: int) -> tuple[int, int] | None:
        """The cell reached by a byte, and the base of its own next cells."""
        at = base ^ byte
        if at >= len(self.cells) or self.cells[at] & 0x800000FF != byte:
            return None
        return self.cells[at], at ^ self._offset(self.cells[at])

    def longest(self, raw: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at ``start``, and its replacement."""
        base, found = self._root(), None
        for i in range(start, len(raw)):
            step = self._step(base, raw[i])
            if step is None:
                break
            cell, base = step
            if cell & 0x100:
                found = i + 1 - start, self.cells[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """Normalised bytes of a text, and for each of them, and for their end, a byte place in the text."""

    def __init__(self, charmap: CharMap, prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.map, self.prefix, self.squeeze, self.escape = charmap, prefix, squeeze, escape
        begins = b"".join(re.escape(bytes([b])) for b in sorted(charmap.first))
        self.begins = re.compile(b"[" + begins + b"]") if begins else None

    def _mapped(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the character map, and the place in the text of the character each came from."""
        if self.begins is None:
            return np.frombuffer(raw, dtype=np.uint8), np.arange(len(raw), dtype=np.int32)
        out, places, done, at = [], [], 0, 0
        while (match := self.begins.search(raw, at)) is not None:
            at = match.start()
            found = self.map.longest(raw, at)
            if found is None:
                # Go on behind this character, so that no key begins inside it.
                at += 1
                while at < len(raw) and raw[at] & 0xC0 == 0x80:
                    at += 1
                continue
            size, text = found
            out += [raw[done:at], text]
            places += [np.arange(done, at, dtype=np.int32), np.full(len(text), at, dtype=np.int32)]
            done = at = at + size
        out.append(raw[done:])
        places.append(np.arange(done, len(raw), dtype=np.int32))
        return np.frombuffer(b"".join(out), dtype=np.uint8), np.concatenate(places)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode()
        data, place = self._mapped(raw)
        end = len(raw)
        blank = data == 0x20
        if self.squeeze:
            # Of a run of spaces the first stays; none at the start.
            inner = np.flatnonzero(~blank)
            if not len(inner):
                return b"", np.array([end], dtype=np.int32)
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            keep[: inner[0]] = False
            data, place, blank = data[keep], place[keep], blank[keep]
        if not len(raw):
            return b"", np.array([0], dtype=np.int32)
        mark = SPACE.encode() if self.escape else b" "
        if self.escape:
            place = np.repeat(place, np.where(blank, len(mark), 1))
        out = data.tobytes().replace(b" ", mark)
        if self.prefix:
            head = int(place[0]) if len(place) else 0
            out = mark + out
            place = np.concatenate([np.full(len(mark), head, dtype=np.int32), place])
        if self.squeeze:
            size = len(out)
            while out.endswith(mark, 0, size):
                size -= len(mark)
                end = int(place[size])
            out, place = out[:size], place[:size]
        return out, np.append(place, np.int32(end))


def _copies(lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of the chosen lists in all lists laid end to end, and the length of each choice."""
    counts = lengths[which]
    first = (np.cumsum(lengths) - lengths)[which]
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts), counts


class Pieces:
    """A byte-pair model with byte fallback: encoding with places, and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only byte-pair models with byte fallback, without pieces of the user's own, are supported")
        if model.trainer_spec.treat_whitespace_as_suffix or model.HasField("denormalizer_spec") and model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models that put spaces after words, or rewrite decoded text, are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.end_id = model.trainer_spec.eos_id
        self.normalise = Normaliser(CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.strips = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.strips_all = spec.remove_extra_whitespaces
        # No merge can reach over a place where no piece has both sides.
        self.closed = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.surface = [self._surface(p) for p in model.pieces]
        self.content = [p.type == _NORMAL for p in model.pieces]
        self.silent = [p.type == _CONTROL for p in model.pieces]
        self.surface_bytes = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        self.surface_sizes = np.array([len(p) for p in self.surface], dtype=np.int64)
        self.silent_ids = np.array(self.silent, dtype=np.int64)
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}

    def _surface(self, piece) -> bytes:
        if piece.type == _CONTROL:
            return b""
        if piece.type == _BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        return " ⁇ ".encode() if piece.type == _UNKNOWN else piece.piece.replace(SPACE, " ").encode()

    def _merge(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word and, for each, its normalised bytes, as little-endian unsigned 32-bit values.

        The pair of the best score is merged first, of equal ones the leftmost. A character outside the
        vocabulary becomes its bytes; the last of them stands for the character's place.
        """
        parts = self._short(list(word)) if len(word) <= SHORT else self._long(list(word))
        ids, sizes = array("I"), array("I")
        for part in parts:
            found = self.ids.get(part)
            if found is not None:
                ids.append(found)
                sizes.append(len(part) if part.isascii() else len(part.encode()))
            else:
                raw = part.encode()
                ids.extend(self.byte[b] for b in raw)
                sizes.extend([0] * (len(raw) - 1) + [len(raw)])
        return ids.tobytes(), sizes.tobytes()

    def _short(self, parts: list[str]) -> list[str]:
        """Merged parts of a short word: the best of all pairs, time after time."""
        cost, none = self.cost.get, math.inf
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        """The same for a word of any length, with the pairs in a queue."""
        before = list(range(-1, len(parts) - 1))
        after = [*range(1, len(parts)), -1]
        queue = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                found = self.cost.get(parts[a] + parts[b])
                if found is not None:
                    heapq.heappush(queue, (found, a, b, len(parts[a]) + len(parts[b])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, size = heapq.heappop(queue)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [part for part in parts if part]

    def _known(self, word: bytes) -> tuple[bytes, bytes]:
        got = self.cache.get(word)
        if got is None:
            got = self._merge(word.decode())
            if len(self.cache) < CACHE and len(word) <= CACHED_LENGTH:
                self.cache[word] = got
        return got

    def _words(self, written: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words begin in normalised texts laid end to end: at each text, and at each space mark behind
        something else, since no piece reaches over such a place."""
        first = np.zeros(len(written) + 1, dtype=bool)
        if self.closed:
            mark = np.frombuffer(SPACE.encode(), dtype=np.uint8)
            marks = np.zeros(len(written), dtype=bool)
            n = len(written) - len(mark) + 1
            if n > 0:
                marks[:n] = np.logical_and.reduce([written[i : i + n] == b for i, b in enumerate(mark)])
            after = np.zeros(len(written), dtype=bool)
            after[len(mark) :] = marks[: -len(mark)]
            first[:-1] = marks & ~after
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(first)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, how many each has, and the bytes of its text where each begins and ends.

        Equal words of all texts are merged once; their ids are then copied to wherever they occur.
        """
        made = [self.normalise(text) for text in texts]
        data = b"".join(written for written, _ in made)
        places = np.concatenate([place for _, place in made]) if made else np.zeros(0, dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(written) for written, _ in made], dtype=np.int64)]).astype(np.int64)
        starts = self._words(np.frombuffer(data, dtype=np.uint8), bounds)
        edges = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        pairs = [self._known(word) for word in words.dictionary.to_pylist()]
        # One more word, of the end id alone, behind each text.
        pairs.append((np.array([self.end_id], dtype="<u4").tobytes(), b"\0\0\0\0"))
        which = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, bounds[1:]), len(pairs) - 1)
        text = np.insert(np.searchsorted(bounds, starts, side="right") - 1, np.searchsorted(starts, bounds[1:]), np.arange(len(texts)))
        lengths = np.array([len(ids) // 4 for ids, _ in pairs], dtype=np.int64)
        at, counts = _copies(lengths, which)
        ids = np.frombuffer(b"".join(p[0] for p in pairs), dtype="<u4")[at]
        sizes = np.frombuffer(b"".join(p[1] for p in pairs), dtype="<u4")[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        # A text has one place more than bytes.
        own = np.repeat(text, counts)
        return ids, np.bincount(own, minlength=len(texts)), places[ends - sizes + own], places[ends + own]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, _, begins, ends = self.encode_all([text])
        return ids, begins, ends

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; the bytes of all are put together at once, odd runs decoded one by one."""
        at, _ = _copies(self.surface_sizes, ids)
        data = self.surface_bytes[at].tobytes()
        bounds = np.concatenate([[0], np.cumsum(counts)])
        edges = np.concatenate([[0], np.cumsum(self.surface_sizes[ids])])[bounds].tolist()
        silent = np.concatenate([[0], np.cumsum(self.silent_ids[ids])])[bounds]
        plain = np.diff(silent) - self.silent_ids[ids[np.maximum(bounds[1:] - 1, 0)]] == 0 if len(ids) else np.zeros(len(counts), bool)
        out = []
        for k, (start, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            text = None
            if plain[k] and stop > start and not self.strips_all:
                first = ids[start]
                drop = self.strips and self.content[first] and self.surface[first].startswith(b" ")
                try:
                    text = data[edges[k] + drop : edges[k + 1]].decode()
                except UnicodeDecodeError:
                    text = None
            out.append(self.decode(ids[start:stop].tolist()) if text is None else text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are silent, and a space mark before the first text is dropped."""
        runs: list[list[int]] = [[]]
        for i in ids:
            # Bytes on both sides of a control piece are not of one character.
            if self.silent[i]:
                runs.append([])
            else:
                runs[-1].append(i)
        runs = [run for run in runs if run]
        texts = [b"".join(map(self.surface.__getitem__, run)).decode(errors="each_byte") for run in runs]
        lead = 0
        for i in (i for run in runs for i in run) if self.strips else ():
            marked = self.content[i] and self.surface[i].startswith(b" ")
            lead += marked
            if not (marked and self.strips_all and self.surface[i] == b" "):
                break
        return "".join(texts)[lead:]


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    """The model at a path, read once in each task's process."""
    return Pieces(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("ids", "begins", "ends")), ("decoded", pa.string())])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            # Runs of rows of at most BATCH_BYTES, a longer text alone.
            for chunk in chunks(batch.column("text"), BATCH_BYTES):
                rows = batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start)
                ids, counts, begins, ends = pieces.encode_all([t or "" for t in rows.column("text").to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, begins, ends)]
                texts = pa.array(pieces.decode_all(ids, counts), pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists, texts], schema=_ENCODED)

    return run


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each document's ids, where its pieces stand in the text, and the text that the ids decode to.

    ``docs`` has doc_id (long) and text; other columns are ignored. Returns doc_id, ids (end id last), begins and ends (bytes
    of the UTF-8 text, end exclusive; of the bytes of one character the last has its range; the end id has the empty
    range at the end) and decoded. ``path`` is a SentencePiece model (piece_bpe_32k.model if None): byte pairs with byte
    fallback. A null text is empty, and an empty text has the end id alone; rows that repeat a doc_id each give a row;
    an empty table gives an empty table. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
    return rows.mapInArrow(_encode(path or public_tokenizers.path("piece_bpe_32k.model")), schema)


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by single spaces, decoded_sha256, and covered_bytes, the bytes of the text in pieces."""
    return encode_documents(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda s, x: s + x).alias("covered_bytes"),
    )
