"""Language ID by a byte convolutional network, trained and run in numpy.

Filters of several widths slide over the bytes of a window; each filter keeps its largest response in the
window, and a softmax layer turns these into language probabilities. A filter response is a sum of one table
entry per byte of its width, so a batch of windows costs one lookup per position, width and filter. A text is
cut into fixed-length windows that cover it whole; the sum of their log-probabilities over the root of their number decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.llm.sampling import per_class, remainder
from aspectra.llm.words import chunks

#: Bytes of a window, and what consecutive windows share so that every byte group lies in one of them.
WINDOW = 128
#: Filter widths, and filters of each.
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Texts of each language at most, and windows of each of them, to fit on.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 800, 4
#: Languages that can be predicted: the most frequent labels, so that stray ones do not grow the sample or the network.
LANGUAGES = 64
UNDECIDED = "und"
_OVERLAP = max(WIDTHS) - 1


@dataclass
class ByteNetwork:
    """Tables of (width, byte, filter) for each width, and a softmax layer over the pooled filters."""

    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    languages: list[str]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window (at least 0), and where it is."""
        values, places = [], []
        for table, width in zip(self.tables, WIDTHS):
            n = windows.shape[1] - width + 1
            response = table[0][windows[:, :n]]
            for k in range(1, width):
                response += table[k][windows[:, k : k + n]]
            at = response.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :])
        return np.maximum(np.concatenate(values, axis=1) + self.bias, 0), np.concatenate(places, axis=1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = self.pooled(windows)[0] @ self.weights + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each row's bytes (the last one filled up with 0) and the row of each window."""
    step = WINDOW - _OVERLAP
    sizes = np.diff(bounds)
    counts = np.maximum(-(-(sizes - _OVERLAP) // step), 1)
    counts[sizes == 0] = 0
    row = np.repeat(np.arange(len(sizes)), counts)
    start = bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    at = start[:, None] + np.arange(WINDOW)
    inside = at < bounds[row + 1][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), row


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 0) -> ByteNetwork:
    """Adam on the cross-entropy of windows; the gradient of a pooled filter goes to its best place only."""
    rng = np.random.default_rng(seed)
    width_sum = FILTERS * len(WIDTHS)
    net = ByteNetwork(
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(width_sum, np.float32),
        rng.normal(0, 0.3, (width_sum, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
        languages,
    )
    params = [*net.tables, net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            x, y = windows[pick], labels[pick]
            hidden, places = net.pooled(x)
            scores = hidden @ net.weights + net.offset
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.weights.T) * (hidden > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                grad = np.zeros_like(net.tables[i])
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                for k in range(w):
                    seen = np.take_along_axis(x, places[:, cols] + k, axis=1)
                    np.add.at(grad[k], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), back[:, cols])
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for param, grad, m, v in zip(params, grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, seed: int = 0) -> ByteNetwork | None:
    """A network from rows of doc_id, text and lang: at most SAMPLE_TEXTS texts of each of the LANGUAGES most
    frequent languages; None without any."""
    rng = np.random.default_rng(seed)
    windows, labels = [], []
    # Some windows of each text, cut out before any row is moved.
    spots = [rng.random() for _ in range(SAMPLE_WINDOWS)]
    parts = F.array(*(F.expr(f"substring(text, 1 + cast(floor(greatest(length(text) - {WINDOW}, 0) * {s}) as int), {WINDOW})") for s in spots))
    usual = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    narrow = labelled.where(F.length("text") > 0).join(F.broadcast(usual), "lang").select("doc_id", "lang", parts.alias("parts"))
    sample = per_class(narrow, "lang", SAMPLE_TEXTS, seed)
    rows = sorted((r.lang, r.doc_id is None, r.doc_id or 0, r.parts) for r in sample.collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    for lang, _, _, texts in rows:
        for text in dict.fromkeys(texts):
            raw = np.frombuffer(text.encode()[:WINDOW].ljust(WINDOW, b"\0"), dtype=np.uint8)
            windows.append(raw)
            labels.append(languages.index(lang))
    return train(np.array(windows), np.array(labels), languages, seed=seed)


def _predict(net: ByteNetwork | None, names: list[str]):
    """Adds lang_pred and score to rows of the columns ``names`` beside text and letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("_letters").to_pylist()
            for chunk in chunks(batch.column("_text"), 1 << 18):
                m = len(chunk.bounds) - 1
                langs: list[str] = [UNDECIDED] * m
                scores = np.zeros(m)
                if net is not None and len(chunk.data):
                    windows, row = windows_of(chunk.data, chunk.bounds)
                    logs = np.concatenate([net.log_probabilities(windows[i : i + 1024]) for i in range(0, len(windows), 1024)])
                    total = np.stack([np.bincount(row, weights=logs[:, c], minlength=m) for c in range(logs.shape[1])], axis=1)
                    # More windows are more evidence, but not as much as if they were independent.
                    mean = total / np.sqrt(np.maximum(np.bincount(row, minlength=m), 1))[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    for i in range(m):
                        if letters[chunk.rows.start + i]:
                            langs[i], scores[i] = net.languages[best[i]], p[i, best[i]]
                kept = [batch.column(c).slice(chunk.rows.start, m) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(scores)], [*names, "_lang", "_lang_score"])

    return run


def with_languages(docs: DataFrame, divisor: int = 4, held: int = 2, seed: int = 0) -> DataFrame:
    """(_doc, _lang, _lang_score), where _doc holds all columns of ``docs``; cases as in ``identify_languages``."""
    rest = remainder("doc_id", divisor)
    text = F.col("text").cast("string")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit(labelled.where(F.coalesce(rest != held, F.lit(True)) & F.col("lang").isNotNull()), seed)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), text.alias("_text"), letters.alias("_letters"))
    schema = T.StructType([rows.schema["_doc"], T.StructField("_lang", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    return rows.mapInArrow(_predict(net, ["_doc"]), schema)


def identify_languages(docs: DataFrame, divisor: int = 4, held: int = 2, seed: int = 0) -> DataFrame:
    """Language of each whole text: doc_id, held_out, lang_pred, score (probability).

    ``docs`` has doc_id (long), text and lang; other columns are ignored. The network is fitted on a bounded sample
    (SAMPLE_TEXTS texts of each of the LANGUAGES most frequent languages) of rows with a lang whose crc32(doc_id) modulo ``divisor`` is not ``held``; its
    lang is no input of a prediction. Texts that are null or have no letter, and all texts if there is nothing to
    learn from, get ``und`` and score 0. A null doc_id is not held out. One row per input row; ties go to the
    first language in code point order.
    """
    rest = remainder("doc_id", divisor)
    names = {"doc_id": "long", "text": "string", "lang": "string"}
    docs = docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in names.items()))
    scored = with_languages(docs, divisor, held, seed).withColumn("doc_id", F.col("_doc.doc_id"))
    return scored.select("doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))
