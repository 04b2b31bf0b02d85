"""Fill-in-middle order of documents, assembled by a secondary sort of their pieces.

A text is cut into units, its prefix, middle and suffix end at unit borders, and each part goes out in pieces of at
most ``UNITS`` units, keyed by document and place in the output. ``repartitionAndSortWithinPartitions`` brings the pieces of
a document together in order, so a task reads them one after another and holds none but the current one: it adds each to a
digest, and reads the markers in the stream to find out where a piece stood in the text. Pieces are then
sorted again by that place, in the same partitions and so without a second shuffle, to rebuild the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of one piece.
UNITS = 2048
#: Bytes of text that a partition of the sort holds on average.
PART_BYTES = 32 << 20
#: Markers of the prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Parts in output order, each with the marker before it; the place of a part in the text is its index in "pms".
_ORDER = {PLAIN: (("p", ""),), PSM: (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE)), SPM: (("s", SUFFIX), ("p", PREFIX), ("m", MIDDLE))}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Place of the row that describes a document: before all its pieces.
_HEAD = -1


def unit_ends(text: str) -> list[int]:
    """Where each unit of a text ends: a word with the white space before it, or white space at the end."""
    ends = [m.end() for m in _WORD.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def plan(doc_id: int | None, text: str, seed: str = "42", rate: int = 50, spm: int = 80) -> tuple[str, list[int], int, int]:
    """Form, unit ends, and the numbers of units after which the prefix and the middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    ends = unit_ends(text)
    first, second = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, ends, first, second
    return (SPM if h4 % 100 < spm else PSM), ends, first, second


def pieces(doc_id: int | None, text: str, units: int = UNITS, **options) -> tuple[tuple, Iterator[str]]:
    """A document's description (doc_id, n, form, prefix_chars, middle_chars) and its output in pieces."""
    form, ends, first, second = plan(doc_id, text, **options)
    n = len(ends)
    borders = {"p": (0, first), "m": (first, second), "s": (second, n)} if form != PLAIN else {"p": (0, n)}
    at = [0, *ends]

    def run() -> Iterator[str]:
        for part, marker in _ORDER[form]:
            if marker:
                yield marker
            start, stop = borders[part]
            for k in range(start, stop, units):
                yield text[at[k] : at[min(k + units, stop)]]

    size = (None, None) if form == PLAIN else (at[first], at[second] - at[first])
    return (doc_id, n, form, *size), run()


class _Reader:
    """Finds the parts of an output that arrives in pieces of any length, from the markers in it."""

    def __init__(self, form: str):
        self.order, self.held, self.step = _ORDER[form], "", 0
        self.part = "p" if form == PLAIN else ""

    def read(self, text: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """(part, text) as far as they are known; the end of a text that may begin a marker is held back."""
        self.held += text
        while self.step < len(self.order):
            part, marker = self.order[self.step]
            found = self.held.find(marker) if marker else 0
            if found < 0:
                break
            if found and self.part:
                yield self.part, self.held[:found]
            self.held, self.part, self.step = self.held[found + len(marker) :], part, self.step + 1
        keep = 0
        if not last and self.step < len(self.order):
            marker = self.order[self.step][1]
            keep = max((k for k in range(1, len(marker)) if self.held.endswith(marker[:k])), default=0)
        ready = self.held[: len(self.held) - keep]
        self.held = self.held[len(ready) :]
        if ready and self.part:
            yield self.part, ready


def _by_document(key: tuple[int, int, int]) -> int:
    """Partition of a key; only the document part of it counts."""
    return (key[0] * 0x9E3779B97F4A7C15 >> 20) & 0x7FFFFFFF


def _emit(units: int, options: dict):
    def run(part: int, rows: Iterator) -> Iterator[tuple[tuple[int, int, int], object]]:
        for i, (doc_id, text) in enumerate(rows):
            document = part << 40 | i
            head, out = pieces(doc_id, text or "", units, **options)
            yield (document, _HEAD, 0), head
            for place, piece in enumerate(out):
                yield (document, 0, place), piece

    return run


def sorted_pieces(docs: DataFrame, units: int = UNITS, **options) -> RDD:
    """((document, kind, place), value) in order: a document's description, then its output pieces.

    A document is a row of the scan, so rows that repeat a doc_id, or have none, stay apart.
    """
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).rdd
    emitted = rows.mapPartitionsWithIndex(_emit(units, options))
    # As many partitions as the text needs, whatever the number of files it lies in.
    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string"))).alias("size")).first()["size"] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return emitted.repartitionAndSortWithinPartitions(n, _by_document)


def _documents(rows: Iterator) -> Iterator[tuple[tuple, Iterator[tuple[tuple, str]]]]:
    """Descriptions, each with an iterator over the rows that follow it in the same document."""
    for _, group in groupby(rows, key=lambda row: row[0][0]):
        yield next(group), group


def _output(rows: Iterator) -> Iterator[tuple[tuple[int, int, int], object]]:
    """Digests of the outputs, and their pieces keyed by their place in the text."""
    for (key, head), group in _documents(rows):
        digest, reader = hashlib.sha256(), _Reader(head[2])
        places = {"p": 0, "m": 0, "s": 0}
        for _, piece in group:
            digest.update(piece.encode())
            for part, text in reader.read(piece):
                yield (key[0], "pms".index(part), places[part]), text
                places[part] += 1
        for part, text in reader.read("", last=True):
            yield (key[0], "pms".index(part), places[part]), text
            places[part] += 1
        yield key, (*head, digest.hexdigest())


def _restored(rows: Iterator) -> Iterator[tuple]:
    for (_, head), group in _documents(rows):
        digest = hashlib.sha256()
        for _, piece in group:
            digest.update(piece.encode())
        yield (*head, digest.hexdigest())


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(docs: DataFrame, units: int = UNITS, **options) -> DataFrame:
    """What became of each document, with digests of its output and of the text rebuilt from that.

    ``docs`` has doc_id and text; other columns are ignored. Options: ``seed``, ``rate`` (documents in a hundred that are
    reordered) and ``spm`` (of these, how many in a hundred put the suffix first). Returns doc_id, n (units), form,
    prefix_chars, middle_chars (code points; null if plain), output_sha256 and restored_sha256. A null text is empty; an
    empty text, and one that holds a marker, stays plain; a null doc_id counts as an empty string in the hash. Repeated
    rows each give a row. An empty table gives an empty table.
    """
    out = sorted_pieces(docs, units, **options)
    placed = out.mapPartitions(_output, preservesPartitioning=True)
    again = placed.repartitionAndSortWithinPartitions(out.getNumPartitions(), _by_document)
    return docs.sparkSession.createDataFrame(again.mapPartitions(_restored), DIGESTS, verifySchema=False)


def _joined(rows: Iterator) -> Iterator[tuple]:
    for (_, (doc_id, _, form, _, _)), group in _documents(rows):
        yield doc_id, form, "".join(piece for _, piece in group)


def fill_in_middle(docs: DataFrame, units: int = UNITS, **options) -> DataFrame:
    """The outputs themselves: doc_id, form, text. Options and cases as in ``digests``."""
    joined = sorted_pieces(docs, units, **options).mapPartitions(_joined)
    return docs.sparkSession.createDataFrame(joined, "doc_id long, form string, text string", verifySchema=False)


def _undo(rows: Iterator) -> Iterator[tuple]:
    for doc_id, form, text in rows:
        parts = {"p": [], "m": [], "s": []}
        for part, piece in _Reader(form).read(text or "", last=True):
            parts[part].append(piece)
        yield doc_id, "".join(parts["p"] + parts["m"] + parts["s"])


def restore(made: DataFrame) -> DataFrame:
    """(doc_id, text) from the rows of ``fill_in_middle``."""
    rows = made.select("doc_id", "form", "text").rdd.mapPartitions(_undo)
    return made.sparkSession.createDataFrame(rows, "doc_id long, text string", verifySchema=False)
