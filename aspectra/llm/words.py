"""Words of whole Arrow text columns as numpy arrays, without one Python object per word.

A word is a longest run of bytes outside ``20`` and ``09``-``0D``; in UTF-8 those bytes never occur inside
a longer character, so this equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE_LOWER = _BYTE[_LOWER]


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every k consecutive values, by doubling."""
    out, have, power, width = None, 0, h, 1
    while True:
        if k & width:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - have)
                out = out[:m] + power[have : have + m] * np.uint64(pow(base, have, 1 << 64))
            have += width
        width *= 2
        if width > k:
            return mix(out)
        m = len(power) - width // 2
        power = power[: max(m, 0)] + power[width // 2 :] * np.uint64(pow(base, width // 2, 1 << 64))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS["up"], _POWERS["down"] = powers(_BASE, size), powers(_INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


class Chunk:
    """Some rows of a batch: ``rows`` (slice), their bytes ``data`` and each row's byte ``bounds``."""

    def __init__(self, rows: slice, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the row (from 0 in this chunk) it belongs to."""
        inside = ~_SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        if len(inside):
            cut = self.bounds[1:-1]
            cut = cut[(cut > 0) & (cut < len(inside))]
            same = np.ones(len(inside), dtype=bool)
            same[cut] = False
            first[1:] &= ~(inside[:-1] & same[1:])
            last[:-1] &= ~(inside[1:] & same[1:])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte range; equal ranges have equal hashes in every task."""
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column (null: empty) into runs of whole rows of at most ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield Chunk(slice(row, stop), raw[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row])
        row = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def lists(values: pa.Array, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of lists from flat values and the number of values in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=values))
