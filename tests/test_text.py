"""Text preparation against Python's own regular expressions and worked cases."""

import re
import string
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from aspectra.functions import text as X
from aspectra.operators.tokens import remove_stopwords
from aspectra.plans.prepare import prepare_text
from aspectra.sources.words import read_word_list

SAMPLES = [
    "Khách sạn RẤT đẹp, giá 1.200.000đ/đêm!!! 😍",
    "ks này ko sạch nv  tk h đh đc",
    "x² ١٢ đh_h Ⅷ",
    "line\nbreak\tand\r\nmore",
    "",
    "   ",
    "ĐIỂM mua sắm: quà lưu niệm; 100% (tốt) {ok} [a] ^ ~ ` | \\ @ # $ & * + = < > / _ - '\"",
    unicodedata.normalize("NFD", "khách sạn"),
]


def run(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("text"))).collect()]


def py_keep(s):
    return "".join(
        c for c in s if c in string.ascii_letters + string.digits + ".,!? " or c in X.ALLOWED_LETTERS
    )


def py_clean(s):
    s = re.sub(r"\d+", " ", "".join(" " if c in string.punctuation else c for c in s.lower()))
    return " ".join(X.ABBREVIATIONS.get(w, w) for w in py_keep(s).split(" "))


def test_letters_are_67_lowercase_and_one_capital():
    assert len(X.ALLOWED_LETTERS) == len(set(X.ALLOWED_LETTERS)) == 68
    assert [c for c in X.ALLOWED_LETTERS if c.isupper()] == ["Đ"]


def test_every_character_of_the_basic_plane(spark):
    chars = [chr(i) for i in range(1, 0x3000)]
    kept = run(spark, chars, X.keep_chars)
    assert kept == [py_keep(c) for c in chars]
    punct = run(spark, chars, X.strip_punct)
    assert punct == [" " if c in string.punctuation else c for c in chars]


@pytest.mark.parametrize(
    "expr, python",
    [
        (X.lower_text, str.lower),
        (X.strip_numbers, lambda s: re.sub(r"\d+", " ", s)),
        (X.keep_chars, py_keep),
        (X.tokenize, lambda s: re.findall(r"\w+", unicodedata.normalize("NFC", s))),
        (X.clean_text, py_clean),
    ],
)
def test_same_as_python(spark, expr, python):
    samples = SAMPLES[:-1] if expr is X.tokenize else SAMPLES
    assert run(spark, samples, expr) == [python(s) for s in samples]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("aKsk h.,đĐcC_1²\n-xnv oạ"), max_size=30), min_size=40))
def test_random_texts(spark, texts):
    def raw(s):
        for short, full in X.ABBREVIATIONS.items():
            s = re.sub(rf"\b{short}\b", full, s, flags=re.IGNORECASE)
        return s

    assert run(spark, texts, X.clean_text) == [py_clean(s) for s in texts]
    assert run(spark, texts, X.expand_abbrev_raw) == [raw(s) for s in texts]


def test_worked_cases(spark):
    assert run(spark, ["ks này ko sạch nv  tk h đh đc"], X.expand_abbrev) == [
        "khách sạn này không sạch nhân viên  tài khoản giờ đh được"
    ]
    assert run(spark, ["x² ١٢ đh_h"], X.tokenize) == [["x²", "١٢", "đh_h"]]
    assert run(spark, ["5 h ١٢"], X.strip_numbers) == ["  h  "]
    assert run(spark, ["a\nb"], X.keep_chars) == ["ab"]
    assert run(spark, ["a\nb"], lambda c: X.keep_chars(c, whitespace="space")) == ["a b"]
    assert run(spark, ["Ks, KO! (Đc)"], X.expand_abbrev_raw) == ["khách sạn, không! (được)"]
    assert run(spark, [None], X.clean_text) == [None]


def test_stop_words_from_list_and_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("  rất \nkhông\nvà\n\nvà\n", encoding="utf-8")
    words = read_word_list(spark, str(tmp_path / "words.txt"))
    assert sorted(r.word for r in words.collect()) == ["không", "rất", "và"]
    docs = spark.createDataFrame(
        [(1, "không rất đẹp, và sạch"), (2, "và rất"), (3, ""), (4, None)],
        "review_id long, text string",
    )
    expected = [(1, "không đẹp sạch"), (2, ""), (3, ""), (4, None)]
    for listed in (words, ["rất", "không", "và"]):
        got = remove_stopwords(docs, listed).orderBy("review_id").collect()
        assert [tuple(r) for r in got] == expected
    assert remove_stopwords(docs, []).where("review_id = 1").first().text == "không rất đẹp và sạch"


def test_prepare_text_with_everything_on(spark):
    docs = spark.createDataFrame(
        [(1, "Khách sạn rất SẠCH, nv ko tốt 5*")], "review_id long, text string"
    )
    lexicon = spark.createDataFrame(
        [("khách", "sạn"), ("nhân", "viên")], "first string, second string"
    )
    out = prepare_text(docs, lexicon, stop_words=["rất", "không"])
    assert out.first().text == "khách_sạn sạch nhân_viên không tốt"
