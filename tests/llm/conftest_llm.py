"""Small tables with the awkward cases every operator must define."""

from __future__ import annotations

LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(45))
TEXTS = [
    (1, "Alpha beta gamma delta."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, PASSAGE + " own ending one"),
    (6, "another start " + PASSAGE),
    (7, PASSAGE + " own ending one"),
    (8, LONG),
    (9, "same " * 60),
    (None, "no id here but words enough to count"),
    (10, "Ünïcödé ßtraße and mail me at a.b@c-d.org or +1 (755) 555-9729, 44.161.181.40 x"),
    (11, "one"),
    (12, "ONE"),
    (13, "!!! 123 ###"),
]


def table(spark, rows, extra=True):
    """doc_id, text, lang, source, n_chars and columns whose names clash with inner ones."""
    langs = ["en", "fr", None]
    made = [
        (i, t, langs[k % 3], ["a", "b", None][k % 3], len(t or ""), k, "x", [1], "y")
        for k, (i, t) in enumerate(rows)
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        return spark.createDataFrame(made, schema + ", row int, name string, node array<int>, `odd.name` string")
    return spark.createDataFrame([m[:5] for m in made], schema)
