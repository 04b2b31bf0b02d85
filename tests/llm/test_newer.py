"""Encoding, fill-in-middle and divergence: against the library, plain versions and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import TEXTS, table
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from aspectra.llm import ctw, divergence, language, middle, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- pieces --------------------------------------------------------------------------------------


def strange_texts(n, seed=5):
    rng = random.Random(seed)
    letters = [*"ab \n\té▁ü12漢字🙂<s>\0", " ", "　", "‍", "ﬁ", "①", "Ａ", "é", "㌔", "\xad", "</s>", "<0x0A>", "<unk>", "the ", "hello", "    ", "\r\n"]
    return ["", " ", "   ", "▁", "▁▁ ▁", "a" * 900, " " * 700] + ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_pieces_as_the_library(tmp_path, rule, squeeze, prefix):
    """Ids, byte places and decoded text for compiled character maps and white-space rules of every kind."""
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    if rule:
        made = sentencepiece_model_pb2.ModelProto()
        made.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        spec.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = squeeze
    spec.normalizer_spec.add_dummy_prefix = prefix
    path = tmp_path / "own.model"
    path.write_bytes(spec.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Pieces(str(path))
    assert bool(rule) == bool(own.normalise.map.first)
    for text in strange_texts(1500):
        ids, begins, ends = own.encode(text)
        want = library.encode(text, add_eos=True)
        assert ids.tolist() == want, text
        assert own.decode(want) == library.decode(want), text
        places = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[:-1] == places, text


def test_pieces_decode_any_ids():
    rng = random.Random(2)
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Pieces(PATH)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, 259, 260, 29871, 28705, 200, 250, rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_pieces_places_tile_the_text(odd):
    for row in pieces.encode_documents(odd).collect():
        assert row.ids[-1] == 2 and len(row.ids) == len(row.begins) == len(row.ends)
        assert row.begins[1:] == row.ends[:-1] and row.begins[0] == 0


def test_pieces_table(odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter()
    for row in odd.collect():
        ids = library.encode(row.text or "", add_eos=True)
        want[row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((row.text or "").encode())] += 1
    assert Counter(tuple(r) for r in pieces.encoding_digests(odd).collect()) == want
    assert pieces.encoding_digests(empty).collect() == []


def test_pieces_other_models_are_refused(tmp_path):
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.byte_fallback = False
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))


# --- fill in the middle --------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    made = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if h4 % 100 < 80 else "psm", len(p), len(m), made


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    bits = ["<", "<P", "P>", "<S", "S>", "<M", "M>", "<<M", " ", "\n", "word", "ü", "　", "<P >"]
    rows = TEXTS + [(i, "".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(100, 400)]
    rows += [(7, "again " * 9), (7, "again " * 9), (500, "a <S> b"), (501, "<M>"), (502, "w" * 5000)]
    return table(spark, rows).repartition(5).cache()


@pytest.mark.parametrize("units", [1, 3, middle.UNITS])
def test_middle_as_plain(marked, units):
    want = Counter()
    for row in marked.collect():
        *head, made = plain_middle(row.doc_id, row.text)
        want[(*head, sha(made), sha(row.text or ""))] += 1
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}
    assert Counter(tuple(r) for r in middle.digests(marked, units=units).collect()) == want


def test_middle_texts_and_back(marked, empty):
    made = middle.fill_in_middle(marked, units=2)
    want = Counter((r.doc_id, plain_middle(r.doc_id, r.text)[2], plain_middle(r.doc_id, r.text)[-1]) for r in marked.collect())
    assert Counter(tuple(r) for r in made.collect()) == want
    assert Counter(tuple(r) for r in middle.restore(made).collect()) == Counter((r.doc_id, r.text or "") for r in marked.collect())
    assert middle.digests(empty).collect() == [] and middle.fill_in_middle(empty).collect() == []


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_middle_reader_takes_pieces_of_any_length(form):
    rng = random.Random(6)
    for _ in range(300):
        parts = {k: "".join(rng.choices("<PSM> a", k=rng.randrange(6))) for k in "pms"}
        if form == "plain":
            parts = {"p": parts["p"], "m": "", "s": ""}
        if any(x in "".join(parts.values()) for x in ("<P>", "<S>", "<M>")):
            continue
        out = "".join(marker + parts[part] for part, marker in middle._ORDER[form])
        reader, found, at = middle._Reader(form), defaultdict(str), 0
        while at < len(out):
            step = rng.randrange(1, 5)
            for part, text in reader.read(out[at : at + step]):
                found[part] += text
            at += step
        for part, text in reader.read("", last=True):
            found[part] += text
        assert {k: found[k] for k in "pms"} == parts


def test_middle_second_sort_does_not_shuffle(marked):
    """Pieces are moved once; the restoration sorts them where they are."""
    out = middle.sorted_pieces(marked)
    placed = out.mapPartitions(middle._output, preservesPartitioning=True)
    assert placed.partitionBy(out.getNumPartitions(), middle._by_document) is placed


# --- source divergence ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, least=3, most=200):
    df, uses, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        df[lang].update(set(found))
        uses[lang, source].update(found)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(uses[lang, s]) for s in names}
        q = shares(sum((uses[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:top])]
    return out


def check_divergence(df, **options):
    want = plain_divergence([(r.lang, r.source, r.text) for r in df.collect()], **options)
    names = {"least": "least_docs", "most": "most_terms"}
    got = divergence.divergences(df, **{names[k]: v for k, v in options.items()}).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    return want


def test_divergence_awkward(odd, empty):
    check_divergence(odd)
    assert check_divergence(odd.withColumn("lang", F.lit("en")), least=1, most=5)
    assert divergence.divergences(empty).collect() == []


def test_divergence_random(spark, monkeypatch):
    """Many sources, few of which use a term; stripes and pair sums are handed on early."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = rng.choices(["Alpha", "beta", "γάμμα", "ÄÖ", "x1y", "Ünder_score", *(f"t{c}" for c in "abcdefghij")], k=rng.randrange(12))
        rows.append((i, " ".join(words) or None, rng.choice(["en", "fr", None, "it", "it"]), rng.choice(["hot"] * 6 + [None, *(f"s{k}" for k in range(25))]), 0))
    rows.append((999, "alone Alpha", "only", "one", 0))
    rows.append((1000, "", "wordless", "one", 0))
    rows.append((1001, "rare", "wordless", "two", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term int").repartition(4)
    want = check_divergence(df)
    assert ("wordless", "one", "pair", "two", 0, 1) in want and not any(r[0] == "only" for r in want)
    check_divergence(df, least=1, most=3)


def test_divergence_stripes_spill(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ENTRIES", 7)
    rows = [("en", f"s{k % 3}", f"a b c{chr(97 + k % 5)}") for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])
    spilled, docs, counts = list(divergence._fold(iter([batch]))), Counter(), Counter()
    for part in spilled:
        for row in part.to_pylist():
            docs[row["term"]] += row["docs"]
            for entry in row["stripe"]:
                counts[row["term"], entry["source"]] += entry["n"]
    assert len(spilled) > 3 and docs["a"] == docs["b"] == docs[""] == 40 and counts["a", "s0"] == 14


def test_share_is_exact_for_large_counts(spark):
    pairs = [(7 * 10**15, 8 * 10**15, 12345), (0, 0, 1), (5, 5, 10**6), (9 * 10**12, 9 * 10**12, 0)]
    got = spark.createDataFrame(pairs, "c long, t long, v long").select(divergence.share("c", "t", "v").alias("p"), F.col("v")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (t + v) if v else None for c, t, v in pairs]


# --- byte network --------------------------------------------------------------------------------


def test_byte_network_is_a_convolution():
    """Probabilities of whole texts against loops over windows, filters, places and widths."""
    rng = np.random.default_rng(1)
    n = language.FILTERS * len(language.WIDTHS)
    net = language.ByteNetwork(
        [rng.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS],
        rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), ["a", "b", "c"],
    )
    for text in ("short", "x" * 127, "y" * 128, "z" * 129, "Ünïcödé words and more " * 40):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        windows, row = language.windows_of(raw, np.array([0, len(raw)]))
        step, starts = language.WINDOW - language._OVERLAP, []
        while not starts or starts[-1] + language.WINDOW < len(raw):
            starts.append(len(starts) * step)
        assert len(windows) == len(starts) and (row == 0).all()
        for window, start in zip(windows, starts):
            assert bytes(window) == bytes(raw[start : start + language.WINDOW]).ljust(language.WINDOW, b"\0")
            hidden = []
            for table, width in zip(net.tables, language.WIDTHS):
                for f in range(language.FILTERS):
                    hidden.append(max(sum(float(table[k, window[i + k], f]) for k in range(width)) for i in range(language.WINDOW - width + 1)))
            hidden = np.maximum(np.array(hidden) + net.bias, 0)
            scores = hidden @ net.weights + net.offset
            want = scores - scores.max() - np.log(np.exp(scores - scores.max()).sum())
            assert np.allclose(net.log_probabilities(window[None, :])[0], want, atol=1e-4)


# --- context trees -------------------------------------------------------------------------------


def plain_tree_scores(rows, depth=5):
    """log10 probability of every text, and its coded bytes, from nested dictionaries."""

    def coded(text):
        data = " ".join(plain.words(text, True)).encode() + b"\n"
        padded = b"\n" * depth + data
        return [(padded[i : i + depth], b) for i, b in enumerate(data)]

    counts = defaultdict(lambda: [0, 0])
    for doc_id, text in rows:
        if doc_id is None or plain.crc(doc_id, 7) != 2:
            for context, byte in coded(text):
                for level in range(8):
                    node = 1 << level | byte >> (8 - level)
                    for d in range(depth + 1):
                        counts[d, context[depth - d :], node][byte >> (7 - level) & 1] += 1

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)

    weighted, share, below = {}, {}, defaultdict(float)
    for d in range(depth, -1, -1):
        for key in [k for k in counts if k[0] == d]:
            own = kt(*counts[key])
            weighted[key] = own if d == depth else math.log(0.5) + np.logaddexp(own, below[key])
            share[key] = 1.0 if d == depth else math.exp(own + math.log(0.5) - weighted[key])
            if d:
                below[d - 1, key[1][1:], key[2]] += weighted[key]

    out = []
    for doc_id, text in rows:
        total, stream = 0.0, coded(text)
        for context, byte in stream:
            for level in range(8):
                node, bit = 1 << level | byte >> (8 - level), byte >> (7 - level) & 1
                p, deepest = 0.5, True
                for d in range(depth, -1, -1):
                    key = (d, context[depth - d :], node)
                    if key in counts:
                        own = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                        p = own if deepest else share[key] * own + (1 - share[key]) * p
                        deepest = False
                total += math.log10(p)
        out.append((doc_id, total, len(stream)))
    return out


@pytest.mark.parametrize("held_in_tables", [True, False])
def test_scores_are_those_of_a_plain_context_tree(spark, monkeypatch, held_in_tables):
    """Grams looked up in the tables of the tasks, and grams that are joined."""
    if not held_in_tables:
        monkeypatch.setattr(ctw, "GRAMS", 20)
        monkeypatch.setattr(ctw, "WORDS", 3)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Sat", "on", "mat", "état", "x", "世界"]) for _ in range(rng.randrange(9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "the cat"), (102, "\tunseen  words!\n")]
    got = ctw.score_texts(table(spark, rows).repartition(3)).collect()
    want = sorted((str(i), round(total, 6), n) for i, total, n in plain_tree_scores(rows))
    assert sorted((str(r.doc_id), round(r.score, 6), round(-r.score * math.log2(10) / r.code_length_per_byte)) for r in got) == want
