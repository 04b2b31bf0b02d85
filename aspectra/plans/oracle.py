r"""The same results in SQL, for an independent engine over the same tables.

Word characters are ``[\p{L}\p{N}_]`` here too; ``\w`` and ``\b`` are ASCII-only in that engine.
"""

from __future__ import annotations

from aspectra.functions.text import ABBREVIATIONS, ALLOWED_LETTERS
from aspectra.plans.fixtures import KEYWORDS
from aspectra.plans.queries import (
    JOINT_EPOCHS,
    JOINT_MOMENTUM,
    JOINT_RATE,
    LONGEST_PHRASE,
    MAX_LEN,
    MIN_PAIR_COUNT,
    MIN_PMI,
    MIN_WORD_COUNT,
    RULES,
    SHIFT_REACH,
    SHIFT_WINDOW,
    STOP_WORDS,
    SUBWORD_MERGES,
    VOCAB_SIZE,
)
from aspectra.schema import ASPECTS

WORD = r"[\p{L}\p{N}_]"
EDGE = r"[^\p{L}\p{N}_]"


def each(template: str, sep: str = ", ") -> str:
    return sep.join(
        template.format(a=a, i=i, word=KEYWORDS[a]) for i, a in enumerate(ASPECTS)
    )


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(value: str) -> str:
    """Six digits; adding zero turns a negative zero into zero."""
    return f"(round({value}, 6) + 0.0::DOUBLE)"


def rnd(*cols: str) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in cols)


# (review_id, t): all words; (review_id, pos, word): one row per word.
WORDS = (
    "w AS (SELECT doc_id AS review_id, text,"
    f" regexp_extract_all(lower(text), '{WORD}+') AS t FROM documents)"
)
TOKENS = (
    "tok AS (SELECT review_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM w)"
)

# (review_id, n, odd_<aspect>, even_<aspect>) and the scores made from them.
COUNTS = (
    "c AS (SELECT w.review_id, any_value(w.text) AS text, any_value(len(t)) AS n, "
    + each("count(*) FILTER (word = '{word}' AND pos % 2 = 1) AS odd_{a}")
    + ", "
    + each("count(*) FILTER (word = '{word}' AND pos % 2 = 0) AS even_{a}")
    + " FROM w LEFT JOIN tok USING (review_id) GROUP BY w.review_id)"
)
SCORE = "CAST(CASE WHEN n > 0 THEN least(5, (100 * {side}_{{a}} + n - 1) // n) ELSE 0 END AS INT)"
ODD, EVEN = SCORE.format(side="odd"), SCORE.format(side="even")
DENSITY = "CASE WHEN n > 0 THEN 100.0::DOUBLE * even_{a} / n ELSE 0.0::DOUBLE END"
RATED = [WORDS, TOKENS, COUNTS]
TRUTH = "truth AS (SELECT review_id, text, " + each(ODD + " AS {a}") + " FROM c)"
PRED = "pred AS (SELECT review_id, " + each(EVEN + " AS {a}") + " FROM c WHERE n >= 2)"
PAIRS = "pairs AS (" + each(
    "SELECT review_id, '{a}' AS aspect, " + ODD + " AS truth, " + EVEN + " AS pred FROM c",
    " UNION ALL ",
) + ")"
HEADS = "heads AS (" + each(
    "SELECT review_id, '{a}' AS aspect, " + ODD + " AS label, " + DENSITY + " AS x FROM c",
    " UNION ALL ",
) + ")"
# One row per class.
CLASSES = (
    "z AS (SELECT review_id, aspect, label, CAST(k AS INT) AS k,"
    " 0.0::DOUBLE - (x - k) * (x - k) AS z FROM heads, range(6) AS r(k))"
)
PROBS = (
    "p AS (SELECT review_id, aspect, label, k, z, exp(z - m) / sum(exp(z - m)) OVER h AS p,"
    " ln(sum(exp(z - m)) OVER h) + m - z AS nll FROM"
    " (SELECT *, max(z) OVER (PARTITION BY review_id, aspect) AS m FROM z)"
    " WINDOW h AS (PARTITION BY review_id, aspect))"
)

# Metrics over (aspect, truth, pred).
TALLY = (
    "tally AS (SELECT aspect, count(*) FILTER (truth > 0 AND pred > 0) AS tp,"
    " count(*) FILTER (truth = 0 AND pred > 0) AS fp,"
    " count(*) FILTER (truth > 0 AND pred = 0) AS fn,"
    " count(*) FILTER (truth = 0 AND pred = 0) AS tn,"
    " CAST(coalesce(sum((truth - pred) * (truth - pred)) FILTER (truth > 0 AND pred > 0), 0)"
    " AS BIGINT) AS squared_error FROM pairs GROUP BY aspect)"
)
REPORT = (
    "report AS (SELECT *, f1_score * r2_score AS final_score FROM (SELECT *,"
    " CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,"
    " CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall,"
    " CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)"
    " ELSE 0.0::DOUBLE END AS f1_score,"
    " CASE WHEN tp > 0 THEN 1 - squared_error / (tp * 16) ELSE 1.0::DOUBLE END AS r2_score"
    " FROM tally))"
)
ALL_METRICS = rnd("precision", "recall", "f1_score", "r2_score", "final_score")
ALL_MEANS = ", ".join(
    f"{r6(f'avg({m})')} AS {m}"
    for m in ("precision", "recall", "f1_score", "r2_score", "final_score")
)
SCORED = [*RATED, PAIRS, TALLY, REPORT]

# Stratified ranking over a table with one column per aspect.
RANKED = (
    "ranked AS (SELECT *, row_number() OVER (ORDER BY "
    + each("CASE WHEN {a} > 0 THEN 1 << {i} ELSE 0 END", " + ")
    + ", md5(concat(review_id, ':0')), review_id) - 1 AS g FROM {table})"
)
SPLIT = (
    "CASE WHEN g % 5 < 4 THEN 'train' WHEN (g // 5) % 2 = 0 THEN 'val' ELSE 'test' END AS split"
)
SPLITS = [*RATED, TRUTH, RANKED.replace("{table}", "truth"),
          "splits AS (SELECT *, " + SPLIT + " FROM ranked)"]
LONG_TRUTH = each("SELECT review_id, '{a}' AS aspect, {a} AS score FROM truth", " UNION ALL ")

# Cleaning.
ALLOWED = f"a-zA-Z0-9.,!? {ALLOWED_LETTERS}"
LOWER_SPACED = (
    r"regexp_replace(regexp_replace(lower(text), '[[:punct:]]', ' ', 'g'), '\p{Nd}+', ' ', 'g')"
)
KEPT = f"regexp_replace({LOWER_SPACED}, '[^{ALLOWED}]', '', 'g')"


def cleaned(rules: dict[str, str]) -> str:
    expanded = (
        f"array_to_string(list_transform(string_split({KEPT}, ' '), lambda w: CASE w "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items())
        + " ELSE w END), ' ')"
    )
    return f"clean AS (SELECT doc_id AS review_id, {expanded} AS text FROM documents)"


CLEAN = cleaned(ABBREVIATIONS)


def raw_abbreviations() -> str:
    """Two rounds, since neighbouring abbreviations share the separator that a match consumes."""
    out = "text"
    for short, full in RULES.items():
        for _ in range(2):
            out = (
                rf"regexp_replace({out}, '(^|{EDGE})(?i:{short})({EDGE}|$)', '\1{full}\2', 'g')"
            )
    return out


# Compounds.
MINE = [
    "uni AS (SELECT word, count(*) AS n FROM tok GROUP BY word)",
    "seq AS (SELECT review_id, pos, word,"
    " lag(word) OVER (PARTITION BY review_id ORDER BY pos) AS prev FROM tok)",
    "bi AS (SELECT prev AS first, word AS second, count(*) AS count FROM seq"
    f" WHERE prev IS NOT NULL GROUP BY prev, word HAVING count(*) >= {MIN_PAIR_COUNT})",
    "mined AS (SELECT first, second, count,"
    " ln(count * (SELECT sum(n) FROM uni)::DOUBLE / (a.n::DOUBLE * b.n)) AS pmi"
    " FROM bi JOIN uni AS a ON a.word = first JOIN uni AS b ON b.word = second)",
    f"lex AS (SELECT first, second FROM mined WHERE pmi >= {MIN_PMI})",
]


MINED = [WORDS, TOKENS, *MINE]


def tagged(seq: str, name: str) -> str:
    return (
        f"{name} AS (SELECT s.review_id, s.pos, s.word,"
        " CASE WHEN lex.first IS NULL THEN 'B' ELSE 'I' END AS tag"
        f" FROM {seq} AS s LEFT JOIN lex ON lex.first = s.prev AND lex.second = s.word)"
    )


def merged(tag_table: str) -> str:
    """Runs of a B and its I words, then runs joined in order."""
    return (
        "runs AS (SELECT *, sum(CASE WHEN tag = 'B' THEN 1 ELSE 0 END)"
        f" OVER (PARTITION BY review_id ORDER BY pos) AS run FROM {tag_table}),\n"
        "compounds AS (SELECT review_id, run, string_agg(word, '_' ORDER BY pos) AS compound"
        " FROM runs GROUP BY review_id, run)"
    )


STOPPED = ", ".join(f"'{w}'" for w in KEYWORDS.values() if w != "is")
TOP = "row_number() OVER (ORDER BY count(*) DESC, word)"


def vector_rows(select: str) -> str:
    return f"SELECT {select}, CAST(dim - 1 AS INT) AS dim, {r6('value')} AS value FROM"


DIMS = (
    "dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,"
    " generate_subscripts(embedding, 1) AS dim FROM embeddings)"
)
LAYERS = (
    "layers AS (SELECT vec_id // 40 AS doc_id, (vec_id % 40) // 8 AS pos,"
    " dim + 64 * (row_number() OVER (PARTITION BY vec_id // 8, dim ORDER BY vec_id % 8 DESC) - 1)"
    " AS back, vec_id % 8 AS layer, dim, x, vec_id FROM dims)"
)
LAST4 = (
    "last4 AS (SELECT doc_id, pos, layer, x,"
    " row_number() OVER (PARTITION BY doc_id, pos ORDER BY layer, dim) AS dim"
    " FROM layers WHERE back <= 256)"
)
HISTORY = [
    "hist AS (SELECT user_id % 3 AS run_id, CAST(day(ts) AS INT) AS epoch, event_type AS aspect,"
    " avg(value) AS final_score FROM events GROUP BY ALL)",
    "means AS (SELECT run_id, epoch, avg(final_score) AS mean_score FROM hist GROUP BY ALL)",
    "marked AS (SELECT *, coalesce(mean_score > max(mean_score) OVER (PARTITION BY run_id"
    " ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved"
    " FROM means)",
    "best AS (SELECT *, epoch = max(CASE WHEN improved THEN epoch END)"
    " OVER (PARTITION BY run_id) AS is_best FROM marked)",
]
CENTRES = [
    "rated AS (SELECT t.* FROM truth AS t JOIN embeddings ON vec_id = review_id)",
    RANKED.replace("{table}", "rated"),
    "train AS (SELECT * FROM ranked WHERE g % 5 < 4)",
    "labelled AS (" + each("SELECT review_id, '{a}' AS aspect, {a} AS k FROM train", " UNION ALL ")
    + ")",
    "centre AS (SELECT aspect, k, dim, avg(x) AS m FROM labelled JOIN dims ON vec_id = review_id"
    " GROUP BY ALL)",
    "bias AS (SELECT aspect, k, -0.5 * sum(m * m) AS b FROM centre GROUP BY ALL)",
    "dots AS (SELECT vec_id, aspect, k, sum(x * m) AS d FROM dims JOIN centre USING (dim)"
    " GROUP BY ALL)",
    "logit AS (SELECT vec_id, aspect, k, d + b AS z FROM dots JOIN bias USING (aspect, k))",
]
FULL_REPORT = (
    "full_report AS (SELECT v.aspect, coalesce(precision, 0) AS precision,"
    " coalesce(recall, 0) AS recall, coalesce(f1_score, 0) AS f1_score,"
    " coalesce(r2_score, 1) AS r2_score, coalesce(final_score, 0) AS final_score"
    " FROM (VALUES " + each("('{a}')") + ") AS v(aspect) LEFT JOIN report USING (aspect))"
)
WITH_MEAN = (
    f"SELECT aspect, {ALL_METRICS} FROM full_report UNION ALL"
    f" SELECT 'mean' AS aspect, {ALL_MEANS} FROM full_report"
)
LARGE_PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS aspect, (l_orderkey * 7 + l_linenumber * {i + 1}) % 6 AS truth,"
    f" (l_orderkey * 5 + l_linenumber * {i + 2}) % 6 AS pred FROM lineitem"
    for i, a in enumerate(ASPECTS)
) + ")"
MATCHED = "pairs AS (" + each(
    "SELECT '{a}' AS aspect, t.{a} AS truth, p.{a} AS pred FROM truth AS t"
    " JOIN pred AS p USING (review_id) WHERE review_id IN (SELECT doc_id FROM labels)",
    " UNION ALL ",
) + ")"
COLS = ", ".join(ASPECTS)


def distribution(group: str, source: str) -> str:
    head = f"{group}, " if group else ""
    long = " UNION ALL ".join(
        f"SELECT {head}'{a}' AS aspect, {a} AS score FROM {source}" for a in ASPECTS
    )
    counts = each("count(*) FILTER (aspect = '{a}') AS {a}")
    return f"SELECT {head}score, {counts} FROM ({long}) GROUP BY ALL"


ORACLE = {
    "review_source": cte(*RATED, TRUTH)
    + f"SELECT review_id, text AS review, {COLS} FROM truth",
    "split_sink": cte(*SPLITS)
    + f"SELECT review_id, text AS review, {COLS}, split FROM splits",
    "feature_projection": "SELECT doc_id AS review_id, text FROM documents",
    "label_projection": cte(*RATED, TRUTH) + f"SELECT review_id, {COLS} FROM truth",
    "aspect_unpivot": cte(*RATED, TRUTH) + LONG_TRUTH,
    "one_hot_encode": cte(*RATED, TRUTH) + "SELECT review_id, concat_ws(',', "
    + each(
        "CASE {a} WHEN 0 THEN '0,0,0,0,0' WHEN 1 THEN '1,0,0,0,0' WHEN 2 THEN '0,1,0,0,0'"
        " WHEN 3 THEN '0,0,1,0,0' WHEN 4 THEN '0,0,0,1,0' ELSE '0,0,0,0,1' END"
    )
    + ") AS one_hot FROM truth",
    "one_hot_decode": cte(*RATED, TRUTH) + f"SELECT review_id, {COLS} FROM truth",
    "text_lower": "SELECT doc_id AS review_id, lower(text) AS text FROM documents",
    "text_punct": "SELECT doc_id AS review_id,"
    " regexp_replace(text, '[[:punct:]]', ' ', 'g') AS text FROM documents",
    "text_numbers": "SELECT doc_id AS review_id,"
    r" regexp_replace(text, '\p{Nd}+', ' ', 'g') AS text FROM documents",
    "text_allowlist": "SELECT doc_id AS review_id,"
    f" regexp_replace(text, '[^{ALLOWED}]', '', 'g') AS text FROM documents",
    "text_allowlist_spaced": "SELECT doc_id AS review_id, regexp_replace("
    rf"regexp_replace(text, '[\s\v]', ' ', 'g'), '[^{ALLOWED}]', '', 'g') AS text FROM documents",
    "abbrev_expand": cte(cleaned(RULES)) + "SELECT review_id, text FROM clean",
    "abbrev_expand_table": cte(cleaned(RULES)) + "SELECT review_id, text FROM clean",
    "abbrev_expand_raw": f"SELECT doc_id AS review_id, {raw_abbreviations()} AS text"
    " FROM documents",
    "token_counts": cte(WORDS, TOKENS) + "SELECT word, count(*) AS count FROM tok GROUP BY word",
    "stopword_filter": cte(
        WORDS,
        TOKENS,
        "stop AS (SELECT word FROM (SELECT word, " + TOP + " AS place FROM tok GROUP BY word)"
        f" WHERE place <= {STOP_WORDS} AND word <> 'is')",
        "kept AS (SELECT review_id, string_agg(word, ' ' ORDER BY pos) AS text FROM tok"
        " WHERE word NOT IN (SELECT word FROM stop) GROUP BY review_id)",
    )
    + "SELECT review_id, coalesce(kept.text, '') AS text FROM w LEFT JOIN kept USING (review_id)",
    "compound_mine": cte(*MINED)
    + f"SELECT first, second, count, {r6('pmi')} AS pmi FROM mined WHERE pmi >= {MIN_PMI}",
    "compound_tag": cte(
        *MINED,
        tagged("seq", "tags"),
        "g AS (SELECT review_id, string_agg(tag, '' ORDER BY pos) AS tags,"
        " count(*) FILTER (tag = 'I') AS n_inside FROM tags GROUP BY review_id)",
    )
    + "SELECT review_id, CAST(len(t) AS INT) AS n_tokens,"
    " CAST(coalesce(n_inside, 0) AS INT) AS n_inside, coalesce(tags, '') AS tags"
    " FROM w LEFT JOIN g USING (review_id)",
    "compound_merge": cte(
        *MINED,
        tagged("seq", "tags"),
        merged("tags"),
        "g AS (SELECT review_id, string_agg(compound, ' ' ORDER BY run) AS text FROM compounds"
        " GROUP BY review_id)",
    )
    + "SELECT review_id, coalesce(g.text, '') AS text FROM w LEFT JOIN g USING (review_id)",
    "prepare_text": cte(CLEAN) + "SELECT review_id, text FROM clean",
    "prepare_text_full": cte(
        CLEAN,
        "tok AS (SELECT review_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM"
        f" (SELECT review_id, regexp_extract_all(text, '{WORD}+') AS t FROM clean))",
        *MINE,
        tagged("seq", "tags"),
        merged("tags"),
        "g AS (SELECT review_id, string_agg(compound, ' ' ORDER BY run) AS text FROM compounds"
        f" WHERE compound NOT IN ({STOPPED}) GROUP BY review_id)",
    )
    + "SELECT review_id, coalesce(g.text, '') AS text FROM clean LEFT JOIN g USING (review_id)",
    "vocab_build": cte(WORDS, TOKENS)
    + f"SELECT word, count(*) AS count, CAST({TOP} + 1 AS INT) AS id FROM tok GROUP BY word"
    f" QUALIFY id <= {VOCAB_SIZE + 1}",
    "sequence_encode": cte(
        WORDS,
        TOKENS,
        f"voc AS (SELECT word, {TOP} + 1 AS id FROM tok GROUP BY word"
        f" QUALIFY id <= {VOCAB_SIZE + 1})",
        "ids AS (SELECT review_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM tok"
        f" LEFT JOIN voc USING (word) WHERE pos <= {MAX_LEN} GROUP BY review_id)",
        f"full_ids AS (SELECT review_id, least(len(t), {MAX_LEN}) AS m, len(t) AS n,"
        " coalesce(ids, []) AS ids FROM w LEFT JOIN ids USING (review_id))",
    )
    + "SELECT review_id, CAST(n AS INT) AS n_tokens,"
    f" array_to_string(list_concat(ids, list_transform(range({MAX_LEN} - m), lambda x: 0)), ' ')"
    f" AS ids, concat(repeat('1', m), repeat('0', {MAX_LEN} - m)) AS mask FROM full_ids",
    "stratified_fold": cte(*SPLITS)
    + "SELECT review_id, CAST(g % 5 AS INT) AS fold FROM splits",
    "train_val_test": cte(*SPLITS) + "SELECT review_id, split FROM splits",
    "label_distribution": cte(*RATED, TRUTH) + distribution("", "truth"),
    "split_report": cte(*SPLITS) + distribution("split", "splits"),
    "head_softmax": cte(*RATED, HEADS, CLASSES, PROBS)
    + f"SELECT review_id, aspect, k AS dim, {r6('p')} AS value FROM p",
    "head_argmax": cte(*RATED, HEADS, CLASSES)
    + "SELECT review_id, aspect, k AS pred FROM z QUALIFY row_number() OVER"
    " (PARTITION BY review_id, aspect ORDER BY z DESC, k) = 1",
    "head_top_class": cte(*RATED, HEADS, CLASSES, PROBS)
    + f"SELECT review_id, aspect, k AS pred, {r6('p')} AS prob FROM p QUALIFY row_number() OVER"
    " (PARTITION BY review_id, aspect ORDER BY p DESC, k) = 1",
    "threshold_decode": cte(*RATED, "x AS (SELECT review_id, " + each(DENSITY + " AS {a}")
                            + " FROM c)")
    + "SELECT review_id, "
    + each(
        "CAST(coalesce((SELECT arg_max(j, z ORDER BY j) FROM (SELECT j,"
        " 1 / (1 + exp(-(0.25::DOUBLE - ({a} - j) * ({a} - j)))) AS z FROM range(1, 6) AS r(j))"
        " HAVING max(z) >= 0.5), 0) AS INT) AS {a}"
    )
    + " FROM x",
    "align_report": cte(
        *RATED,
        TRUTH,
        PRED,
        "lt AS (SELECT * FROM truth WHERE review_id IN (SELECT doc_id FROM labels))",
        "j AS (SELECT lt.review_id AS t, pred.review_id AS p FROM lt FULL OUTER JOIN pred"
        " ON lt.review_id = pred.review_id)",
    )
    + "SELECT aspect, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS matched,"
    " count(*) FILTER (p IS NULL) AS missing_pred, count(*) FILTER (t IS NULL) AS missing_truth,"
    " CAST(0 AS BIGINT) AS null_scores,"
    " (SELECT count(*) - count(DISTINCT review_id) FROM lt) AS duplicate_truth,"
    " (SELECT count(*) - count(DISTINCT review_id) FROM pred) AS duplicate_pred"
    " FROM j, (VALUES "
    + each("('{a}')")
    + ") AS v(aspect) GROUP BY aspect",
    "aligned_scores": cte(*RATED, TRUTH, PRED, MATCHED, TALLY, REPORT)
    + f"SELECT aspect, {ALL_METRICS} FROM report",
    "presence_counts": cte(*RATED, PAIRS, TALLY) + "SELECT aspect, tp, fp, fn, tn FROM tally",
    "presence_prf": cte(*SCORED)
    + f"SELECT aspect, {rnd('precision', 'recall', 'f1_score')} FROM report",
    "rating_r2": cte(*SCORED)
    + f"SELECT aspect, tp AS rated, squared_error, {rnd('r2_score')} FROM report",
    "score_report": cte(*SCORED) + f"SELECT aspect, {ALL_METRICS} FROM report",
    "score_report_large": cte(LARGE_PAIRS, TALLY, REPORT)
    + f"SELECT aspect, {ALL_METRICS} FROM report",
    "score_report_sparse": cte(
        *RATED,
        PAIRS.replace("pairs AS (", "every_pair AS ("),
        f"pairs AS (SELECT * FROM every_pair WHERE aspect <> '{ASPECTS[1]}')",
        TALLY,
        REPORT,
        FULL_REPORT,
    )
    + WITH_MEAN,
    "evaluate_heads": cte(
        *RATED,
        TRUTH,
        DIMS,
        *CENTRES,
        "guess AS (SELECT vec_id AS review_id, aspect, k AS pred FROM logit QUALIFY row_number() OVER"
        " (PARTITION BY vec_id, aspect ORDER BY z DESC, k) = 1)",
        "held AS (" + each(
            "SELECT review_id, '{a}' AS aspect, {a} AS truth FROM ranked WHERE g % 5 = 4", " UNION ALL "
        ) + ")",
        "pairs AS (SELECT aspect, truth, pred FROM held JOIN guess USING (review_id, aspect))",
        TALLY,
        REPORT,
        FULL_REPORT,
    )
    + WITH_MEAN,
    "macro_report": cte(*SCORED) + f"SELECT {ALL_MEANS} FROM report",
    "head_loss": cte(*RATED, HEADS, CLASSES, PROBS)
    + f"SELECT aspect, {r6('avg(nll)')} AS loss FROM p WHERE k = label GROUP BY aspect",
    "cross_entropy": cte(*RATED, HEADS, CLASSES, PROBS)
    + f"SELECT {r6('sum(loss)')} AS loss FROM"
    " (SELECT avg(nll) AS loss FROM p WHERE k = label GROUP BY aspect)",
    "batch_mean_loss": cte(*RATED, HEADS, CLASSES, PROBS)
    + f"SELECT count(*) AS batches, {r6('avg(loss)')} AS loss FROM (SELECT b, sum(loss) AS loss"
    " FROM (SELECT review_id // 16 AS b, aspect, avg(nll) AS loss FROM p WHERE k = label"
    " GROUP BY ALL) GROUP BY b)",
    "dense_ordinal": "SELECT doc_id AS review_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal"
    " FROM documents",
    "concat_layers": cte(DIMS, LAYERS, LAST4)
    + vector_rows("doc_id, pos") + " (SELECT doc_id, pos, dim, x AS value FROM last4)",
    "pool_mean": cte(DIMS) + vector_rows("label")
    + " (SELECT label, dim, avg(x) AS value FROM dims GROUP BY ALL)",
    "pool_mean_max": cte(DIMS) + vector_rows("label")
    + " (SELECT label, dim, avg(x) AS value FROM dims GROUP BY ALL UNION ALL"
    " SELECT label, dim + 64 AS dim, max(x) AS value FROM dims GROUP BY ALL)",
    "pool_last": cte(DIMS) + vector_rows("label")
    + " (SELECT label, dim, x AS value FROM dims QUALIFY row_number() OVER"
    " (PARTITION BY label, dim ORDER BY vec_id DESC) = 1)",
    "pool_tokens": cte(DIMS, LAYERS, LAST4) + vector_rows("doc_id")
    + " (SELECT doc_id, dim, avg(x) AS value FROM last4 GROUP BY ALL UNION ALL"
    " SELECT doc_id, dim + 256 AS dim, max(x) AS value FROM last4 GROUP BY ALL)",
    "head_scores": cte(*RATED, TRUTH, DIMS, *CENTRES)
    + f"SELECT vec_id AS review_id, aspect, k AS pred, {r6('z')} AS top_logit FROM logit"
    " QUALIFY row_number() OVER (PARTITION BY vec_id, aspect ORDER BY z DESC, k) = 1",
    "best_epoch": cte(*HISTORY)
    + f"SELECT run_id, epoch, {r6('mean_score')} AS mean_score, improved, is_best FROM best",
    "variant_rank": cte(*HISTORY)
    + f"SELECT run_id, epoch, {r6('mean_score')} AS mean_score, CAST(row_number() OVER"
    " (ORDER BY mean_score DESC, run_id) AS INT) AS place FROM best WHERE is_best",
}

# Phrases: every run of two to four words, however its parts fare; the lists are the same.
RUNS = [
    "len_w AS (SELECT review_id, t, len(t) AS m FROM w)",
    "run AS (" + " UNION ALL ".join(
        f"SELECT review_id, i AS pos, {n} AS n, array_to_string(t[i : i + {n - 1}], ' ') AS phrase FROM"
        f" (SELECT review_id, t, unnest(range(1, m - {n - 2})) AS i FROM len_w WHERE m >= {n})"
        for n in range(2, LONGEST_PHRASE + 1)
    ) + ")",
    "uni AS (SELECT word, count(*) AS c FROM tok GROUP BY word)",
    f"often AS (SELECT phrase, n, count(*) AS count FROM run GROUP BY phrase, n HAVING count(*) >= {MIN_PAIR_COUNT})",
    "part AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS word FROM often)",
    "logs AS (SELECT phrase, sum(ln(c::DOUBLE)) AS logs FROM part JOIN uni USING (word) GROUP BY phrase)",
    "phrases AS (SELECT phrase, n, count, (ln(count::DOUBLE) + (n - 1) * ln((SELECT sum(c) FROM uni)::DOUBLE) - logs)"
    " / (n - 1) AS score FROM often JOIN logs USING (phrase))",
]


def longest_match(steps: int = 15) -> list[str]:
    """The words at which a longest match begins: 2^k steps at a time, from the first word of every text."""
    parts = [
        f"best AS (SELECT review_id, pos, max(n) AS n FROM run WHERE phrase IN (SELECT phrase FROM phrases WHERE score >= {MIN_PMI})"
        " GROUP BY review_id, pos)",
        "jump0 AS MATERIALIZED (SELECT tok.review_id, tok.pos, tok.pos + coalesce(n, 1) AS nxt FROM tok"
        " LEFT JOIN best ON best.review_id = tok.review_id AND best.pos = tok.pos)",
        "at0 AS MATERIALIZED (SELECT review_id, CAST(1 AS BIGINT) AS pos FROM w WHERE len(t) > 0)",
    ]
    for k in range(steps):
        parts += [
            f"at{k + 1} AS MATERIALIZED (SELECT review_id, pos FROM at{k} UNION"
            f" SELECT a.review_id, j.nxt AS pos FROM at{k} AS a JOIN jump{k} AS j ON j.review_id = a.review_id AND j.pos = a.pos)",
            f"jump{k + 1} AS MATERIALIZED (SELECT a.review_id, a.pos, b.nxt FROM jump{k} AS a JOIN jump{k} AS b"
            " ON b.review_id = a.review_id AND b.pos = a.nxt)",
        ]
    return parts + [
        f"tags AS (SELECT tok.review_id, tok.pos, tok.word, CASE WHEN a.pos IS NULL THEN 'I' ELSE 'B' END AS tag FROM tok"
        f" LEFT JOIN at{steps} AS a ON a.review_id = tok.review_id AND a.pos = tok.pos)",
    ]


# Closed-form heads: words of the cleaned text, weights in millionths.
BAYES = [
    *SPLITS,
    CLEAN,
    f"words AS (SELECT review_id, unnest(regexp_extract_all(text, '{WORD}+')) AS word FROM clean)",
    "seen AS (SELECT review_id, word, count(*) AS n FROM words GROUP BY ALL)",
    "kept AS (SELECT word FROM seen JOIN splits USING (review_id) WHERE split = 'train' GROUP BY word"
    f" HAVING sum(n) >= {MIN_WORD_COUNT})",
    "label AS (" + each("SELECT review_id, split, '{a}' AS aspect, {a} AS k FROM splits", " UNION ALL ") + ")",
    "cls AS (SELECT aspect, CAST(k AS INT) AS k FROM (VALUES " + each("('{a}')") + ") AS v(aspect), range(6) AS r(k))",
    "hit AS (SELECT aspect, k, word, sum(n) AS n FROM label JOIN seen USING (review_id) JOIN kept USING (word)"
    " WHERE split = 'train' GROUP BY ALL)",
    "total AS (SELECT c.aspect, c.k, coalesce(sum(n), 0) + (SELECT count(*) FROM kept) AS t FROM cls AS c"
    " LEFT JOIN hit USING (aspect, k) GROUP BY ALL)",
    "weight AS (SELECT t.aspect, t.k, kept.word,"
    " round(1000000 * ln((coalesce(hit.n, 0) + 1)::DOUBLE / t.t::DOUBLE))::BIGINT AS x FROM total AS t CROSS JOIN kept"
    " LEFT JOIN hit ON hit.aspect = t.aspect AND hit.k = t.k AND hit.word = kept.word)",
    "base AS (SELECT c.aspect, c.k, round(1000000 * ln((count(l.review_id) + 1)::DOUBLE"
    " / ((SELECT count(*) FROM splits WHERE split = 'train') + 6)::DOUBLE))::BIGINT AS x FROM cls AS c"
    " LEFT JOIN label AS l ON l.aspect = c.aspect AND l.k = c.k AND l.split = 'train' GROUP BY c.aspect, c.k)",
    "sums AS (SELECT review_id, aspect, k, sum(n * x) AS s FROM seen JOIN weight USING (word) GROUP BY ALL)",
    "logit AS (SELECT d.review_id, b.aspect, b.k, (b.x + coalesce(s.s, 0))::DOUBLE / 1000000 AS z"
    " FROM splits AS d CROSS JOIN base AS b LEFT JOIN sums AS s ON s.review_id = d.review_id AND s.aspect = b.aspect AND s.k = b.k)",
    "chosen AS (SELECT review_id, aspect, k AS pred, 1 / sum(exp(z - m)) OVER (PARTITION BY review_id, aspect) AS prob, z, m"
    " FROM (SELECT *, max(z) OVER (PARTITION BY review_id, aspect) AS m FROM logit)"
    " QUALIFY row_number() OVER (PARTITION BY review_id, aspect ORDER BY z DESC, k) = 1)",
]


def joint_fit() -> list[str]:
    """Gradient steps of all heads over the vectors, written out pass by pass."""
    parts = [
        "rated AS (SELECT t.* FROM truth AS t JOIN embeddings ON vec_id = review_id)",
        "label AS MATERIALIZED (" + each("SELECT review_id AS vec_id, '{a}' AS aspect, {a} AS y FROM rated", " UNION ALL ") + ")",
        "x AS MATERIALIZED (SELECT d.vec_id, d.dim, d.x FROM dims AS d JOIN rated ON review_id = vec_id"
        " UNION ALL SELECT review_id, 0, 1.0::DOUBLE FROM rated)",
        "rows_n AS (SELECT count(*)::DOUBLE AS n FROM rated)",
        "cell AS (SELECT aspect, CAST(k AS INT) AS k, dim FROM (SELECT DISTINCT aspect FROM label), range(6) AS r(k),"
        " (SELECT DISTINCT dim FROM x))",
        "w0 AS (SELECT aspect, k, dim, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM cell)",
    ]
    for e in range(JOINT_EPOCHS):
        parts += [
            f"z{e} AS (SELECT vec_id, aspect, k, sum(x * w) AS z FROM x JOIN w{e} USING (dim) GROUP BY ALL)",
            f"p{e} AS MATERIALIZED (SELECT vec_id, aspect, k, y, exp(z - m) / sum(exp(z - m)) OVER h AS p,"
            " ln(sum(exp(z - m)) OVER h) + m - z AS nll FROM (SELECT vec_id, aspect, k, z, y,"
            f" max(z) OVER (PARTITION BY vec_id, aspect) AS m FROM z{e} JOIN label USING (vec_id, aspect))"
            " WINDOW h AS (PARTITION BY vec_id, aspect))",
            f"g{e} AS (SELECT aspect, k, dim, sum((p - CASE WHEN k = y THEN 1 ELSE 0 END) * x) / (SELECT n FROM rows_n) AS g"
            f" FROM p{e} JOIN x USING (vec_id) GROUP BY ALL)",
            f"w{e + 1} AS MATERIALIZED (SELECT aspect, k, dim, w + {JOINT_MOMENTUM}::DOUBLE * v - {JOINT_RATE}::DOUBLE * g AS w,"
            f" {JOINT_MOMENTUM}::DOUBLE * v - {JOINT_RATE}::DOUBLE * g AS v FROM w{e} JOIN g{e} USING (aspect, k, dim))",
        ]
    return parts


def subword_merges() -> list[str]:
    """Symbols between bars, so that a merge is a replacement of text; one round after the other."""
    parts = [
        "sub0 AS MATERIALIZED (SELECT word, count(*) AS c,"
        " '|' || array_to_string(regexp_extract_all(word, '.'), '||') || '</w>|' AS x FROM tok GROUP BY word)",
    ]
    for i in range(SUBWORD_MERGES):
        parts += [
            f"two{i} AS (SELECT l, r, sum(c)::BIGINT AS n FROM (SELECT c, s[j] AS l, s[j + 1] AS r FROM (SELECT c, s, unnest(range(1, len(s))) AS j"
            f" FROM (SELECT c, string_split(x[2 : len(x) - 1], '||') AS s FROM sub{i}) WHERE len(s) > 1)) GROUP BY l, r)",
            f"top{i} AS MATERIALIZED (SELECT l, r, n FROM two{i} ORDER BY n DESC, l, r LIMIT 1)",
            f"sub{i + 1} AS MATERIALIZED (SELECT word, c, replace(x, '|' || l || '||' || r || '|', '|' || l || r || '|') AS x FROM sub{i}, top{i})",
        ]
    return parts


ORACLE |= {
    "vocab_subword": cte(WORDS, TOKENS, *subword_merges())
    + " UNION ALL ".join(f'SELECT CAST({i} AS INT) AS rank, l AS "left", r AS "right", n AS count FROM top{i}' for i in range(SUBWORD_MERGES)),
    "sequence_encode_subword": cte(
        WORDS,
        TOKENS,
        *subword_merges(),
        f"cut AS (SELECT word, c, string_split(x[2 : len(x) - 1], '||') AS s FROM sub{SUBWORD_MERGES})",
        "piece AS (SELECT word, c, unnest(s) AS piece, generate_subscripts(s, 1) AS place FROM cut)",
        "voc AS (SELECT piece, row_number() OVER (ORDER BY sum(c) DESC, piece) + 1 AS id FROM piece GROUP BY piece"
        f" QUALIFY id <= {VOCAB_SIZE + 1})",
        "ids AS (SELECT review_id, list(coalesce(id, 1) ORDER BY pos, place) AS ids FROM tok JOIN piece USING (word)"
        " LEFT JOIN voc USING (piece) GROUP BY review_id)",
        f"full_ids AS (SELECT review_id, coalesce(len(ids), 0) AS n, least(coalesce(len(ids), 0), {MAX_LEN}) AS m,"
        f" coalesce(ids[1:{MAX_LEN}], []) AS ids FROM w LEFT JOIN ids USING (review_id))",
    )
    + "SELECT review_id, CAST(n AS INT) AS n_pieces,"
    f" array_to_string(list_concat(ids, list_transform(range({MAX_LEN} - m), lambda x: 0)), ' ')"
    f" AS ids, concat(repeat('1', m), repeat('0', {MAX_LEN} - m)) AS mask FROM full_ids",
    "compound_mine_long": cte(WORDS, TOKENS, *RUNS)
    + f"SELECT phrase, n, count, {r6('score')} AS score FROM phrases",
    "compound_merge_list": cte(
        WORDS,
        TOKENS,
        *RUNS,
        *longest_match(),
        merged("tags"),
        "g AS (SELECT review_id, string_agg(compound, ' ' ORDER BY run) AS text FROM compounds GROUP BY review_id)",
    )
    + "SELECT review_id, coalesce(g.text, '') AS text FROM w LEFT JOIN g USING (review_id)",
    "score_report_merged": ORACLE["score_report_large"],
    "review_source_rejects": "SELECT reason, \"column\", count(*) AS rows FROM (SELECT CASE WHEN doc_id % 20 IN (5, 9) THEN 'columns'"
    " WHEN doc_id % 20 = 3 THEN 'fraction' WHEN doc_id % 20 = 7 THEN 'class' ELSE 'none' END AS reason,"
    " CASE WHEN doc_id % 20 = 3 THEN 'lodging' WHEN doc_id % 20 = 7 THEN 'shopping' END AS \"column\" FROM documents) GROUP BY ALL",
    "align_positional": cte(
        *RATED,
        TRUTH,
        PRED,
        "t AS (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS ordinal FROM truth)",
        "p AS (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS ordinal FROM pred)",
    )
    + each(
        "SELECT coalesce(t.ordinal, p.ordinal) AS ordinal, '{a}' AS aspect, t.{a} AS truth, p.{a} AS pred,"
        " t.ordinal IS NOT NULL AS has_truth, p.ordinal IS NOT NULL AS has_pred FROM t FULL OUTER JOIN p ON t.ordinal = p.ordinal",
        " UNION ALL ",
    ),
    "position_shift": cte(
        "t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, text FROM documents)",
        "p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, text FROM documents WHERE substr(text, 6, 1) <> 'e')",
        f"tried AS (SELECT ordinal, text, s AS shift FROM t, range(-{SHIFT_REACH}, {SHIFT_REACH + 1}) AS r(s))",
        f"votes AS (SELECT ordinal // {SHIFT_WINDOW} AS part, shift, count(*) AS agreeing FROM tried JOIN p"
        " ON p.place = ordinal + shift AND p.text = tried.text GROUP BY ALL)",
        "best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY part ORDER BY agreeing DESC, abs(shift), shift) = 1)",
        f"win AS (SELECT ordinal // {SHIFT_WINDOW} AS part, min(ordinal) AS f, max(ordinal) AS l, count(*) AS n FROM t GROUP BY part)",
        "seen AS (SELECT win.part, f, l, n, shift, coalesce(agreeing, 0) AS agreeing FROM win LEFT JOIN best ON best.part = win.part)",
        "marked AS (SELECT *, CASE WHEN lag(part) OVER (ORDER BY part) IS NOT NULL"
        " AND shift IS NOT DISTINCT FROM lag(shift) OVER (ORDER BY part) THEN 0 ELSE 1 END AS new FROM seen)",
        "runs AS (SELECT *, sum(new) OVER (ORDER BY part) AS run FROM marked)",
    )
    + "SELECT min(f) AS first_ordinal, max(l) AS last_ordinal, CAST(sum(n) AS BIGINT) AS rows, CAST(any_value(shift) AS INT) AS shift,"
    " CAST(sum(agreeing) AS BIGINT) AS agreeing FROM runs GROUP BY run",
    "aspect_heads": cte(
        *BAYES,
        "pairs AS (SELECT l.aspect, l.k AS truth, c.pred FROM label AS l JOIN chosen AS c USING (review_id, aspect)"
        " WHERE split = 'val')",
        TALLY,
        REPORT,
        FULL_REPORT,
    )
    + f"SELECT aspect, {ALL_METRICS} FROM full_report",
    "batch_predict": cte(*BAYES)
    + "SELECT review_id, " + each("CAST(max(pred) FILTER (aspect = '{a}') AS INT) AS {a}") + ", "
    + each("(round(max(prob) FILTER (aspect = '{a}'), 6) + 0.0::DOUBLE) AS {a}_prob") + " FROM chosen GROUP BY review_id",
    "joint_heads": cte(*RATED, TRUTH, DIMS, *joint_fit())
    + " UNION ALL ".join(
        f"SELECT CAST({e + 1} AS INT) AS epoch, aspect, {r6('avg(nll)')} AS loss FROM p{e} WHERE k = y GROUP BY aspect"
        for e in range(JOINT_EPOCHS)
    ),
}

# The way of large lists and the numbering of ids with gaps change no row.
ORACLE |= {
    "abbrev_expand_large": ORACLE["abbrev_expand"],
    "stopword_filter_large": ORACLE["stopword_filter"],
    "compound_tag_large": ORACLE["compound_tag"],
    "sequence_encode_large": ORACLE["sequence_encode"],
    "batch_mean_loss_gapped": cte(*RATED, HEADS, CLASSES, PROBS)
    + f"SELECT count(*) AS batches, {r6('avg(loss)')} AS loss FROM (SELECT b, sum(loss) AS loss"
    " FROM (SELECT n // 16 AS b, aspect, avg(nll) AS loss FROM (SELECT *,"
    " dense_rank() OVER (ORDER BY review_id * 7 + 3) - 1 AS n FROM p WHERE k = label)"
    " GROUP BY ALL) GROUP BY b)",
}
