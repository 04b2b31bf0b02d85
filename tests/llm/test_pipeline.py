"""The pipeline, row by row, against plain versions of its stages."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aspectra.llm import language, mixing, neighbours, personal

CLASHES = ["target", "source_size", "_row", "_kept", "_lang", "_doc", "_at", "_text", "first", "row", "node"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Whole documents, with rows that are there twice, null ids, null and wordless texts and clashing names."""
    base = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 90").collect()]
    rng = random.Random(2)
    rows = list(base)
    for r in base[:6]:
        rows += [dict(r), dict(r, doc_id=None), dict(r, doc_id=None), dict(r, doc_id=r["doc_id"] + 1000)]
    for r in base[10:16]:
        words = (r["text"] or "").split(" ")
        words.insert(rng.randrange(len(words) + 1), "inserted")
        rows.append(dict(r, doc_id=r["doc_id"] + 2000, text=" ".join(words)))
    rows += [{"doc_id": 3000, "text": None, "lang": "en", "source": None}, {"doc_id": 3001, "text": "", "lang": None, "source": "s"}]
    rows += [{"doc_id": 3002, "text": "12 34", "lang": "en", "source": "s"}] * 2
    made = [(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"] or ""), *range(len(CLASHES))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame(made, schema).repartition(4).cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars"))


def plain_dedup(rows):
    """One row of each component: the least id, nulls last; which of equal rows does not show."""
    roots = plain.near_components([plain.shingles(r["text"], 5) for r in rows], 80)
    best = {}
    for r, root in zip(rows, roots):
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        if root not in best or order < best[root][0]:
            best[root] = order, r
    return [r for _, r in best.values()]


def test_every_stage_is_the_plain_one(spark, sf, docs, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "personal_data", "source_mix", "packing"]

    def run(name, table):
        path = str(tmp_path / name)
        stages[name](spark, table, sf).write.parquet(path)
        return spark.read.parquet(path)

    # Language: the rows that the operator decides, by the stated probability.
    found = Counter((r.doc_id, r.lang_pred != language.UNDECIDED and r.score >= corpus_pipeline.LANGUAGE_SCORE) for r in language.identify_languages(docs).collect())
    known = run("language_id", docs)
    assert known.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows_of(known)) == Counter({i: n for (i, good), n in found.items() if good})
    assert not {3000, 3001, 3002} & {r["doc_id"] for r in rows_of(known)}

    # One document of each group, over texts that the first stage kept.
    before, apart = rows_of(known), run("near_dedup", known)
    want = plain_dedup(before)
    assert apart.columns == docs.columns
    assert Counter(r["text"] for r in rows_of(apart)) == Counter(r["text"] for r in want)
    assert Counter(r["doc_id"] for r in rows_of(apart) if r["doc_id"] is not None) == Counter(r["doc_id"] for r in want if r["doc_id"] is not None)
    assert apart.count() < known.count() and max(Counter(r["text"] for r in rows_of(apart)).values()) == 1

    # Personal data: every base span goes, and what is left is the text around the spans.
    clean = run("personal_data", apart)
    assert clean.columns == docs.columns
    spans = {r.doc_id: r.spans for r in personal.find_personal_data(apart).collect()}
    texts = {r["doc_id"]: r["text"] for r in rows_of(apart)}
    for r in rows_of(clean):
        places = sorted((int(s), -int(e), personal.KINDS.index(k), k) for k, s, e in (x.split(":") for x in spans[r["doc_id"]].split(",") if x))
        out, at, text = "", 0, texts[r["doc_id"]]
        for s, e, _, k in places:
            if s >= at:
                out += text[at:s] + f"[{k.upper()}]"
                at = -e
            else:
                at = max(at, -e)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
        assert not plain.personal(r["text"])

    # The mix: floor(rate) copies and one more by the stated hash.
    mixed = run("source_mix", clean)
    assert mixed.columns == docs.columns
    rate = {r.source: r.target / r.source_size if r.source_size else 0 for r in mixing.source_targets(
        clean.groupBy("source").agg(F.sum(mixing.word_count()).alias("source_size")), (5, 2, 1), 150, 2).collect()}
    want = Counter()
    for r in rows_of(clean):
        text = hashlib.md5((r["text"] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}:{text}:".encode()).hexdigest()[:8], 16) / 2**32
        whole = int(rate[r["source"]])
        want[key(r)] += min(whole + (u < rate[r["source"]] - whole), 2)
    assert Counter(key(r) for r in rows_of(mixed)) == +want

    # Packing: the tokenizer's ids of every row, cut into full sequences.
    pieces = rows_of(run("packing", mixed))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total, seen = Counter(), Counter()
    for r in rows_of(mixed):
        total[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in rows_of(mixed)}
    for p in pieces:
        seen[p["doc_id"]] += p["length"]
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert seen == total
    ends = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for sequence, offset, length in ends:
        assert sequence * 1024 + offset == at and offset + length <= 1024
        at += length


def test_groups_of_rows_without_ids(spark):
    """Null-id copies of a document with an id go, and one row of a group without any id stays."""
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (None, other), (None, other), (None, None), (5, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in neighbours.one_of_each(docs).collect())
    assert got == Counter([(1, text), (None, other), (None, None), (5, None), (None, "")])
