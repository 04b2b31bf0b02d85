"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM doc WHERE len(ws) >= 35)
), again AS (
  SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), word AS (
  SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM doc)
), marked AS (
  SELECT w.doc_id, w.i, w.w, max(a.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last
  FROM word w LEFT JOIN again a ON a.doc_id = w.doc_id AND a.i = w.i
), kept AS (
  SELECT doc_id, count(*) FILTER (last IS NOT NULL AND last > i - 35) AS n_removed,
    string_agg(w, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - 35) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
  ) AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END
  ) AS s FROM doc
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), sized AS (
  SELECT doc_id, n, hash(s) AS h FROM shingle JOIN size USING (doc_id)
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b
    ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), step AS (
  SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, s.y FROM reach r JOIN step s ON s.x = r.y
)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN size z ON z.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op7_kd_tree_search": r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
  CAST(row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS INT) AS rank,
  c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
""",
    "op8_source_mixing": r"""
WITH doc AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM doc GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][i % 3 + 1] AS w, 2 * total AS most FROM src
), levelled AS (
  SELECT *, row_number() OVER lv AS k,
    sum(total) OVER () * 150 - 100 * coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left100,
    sum(w) OVER (ORDER BY most::DOUBLE / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wt
  FROM weighed WINDOW lv AS (ORDER BY most::DOUBLE / w, i)
), open AS (
  SELECT k, left100, wt FROM levelled WHERE most::DOUBLE * 100 * wt::DOUBLE > w::DOUBLE * left100::DOUBLE ORDER BY k LIMIT 1
), aim AS (
  SELECT l.source, l.total, CASE WHEN o.k IS NULL OR l.k < o.k THEN l.most::DOUBLE
    ELSE l.w::DOUBLE * o.left100::DOUBLE / (100.0::DOUBLE * o.wt::DOUBLE) END AS target
  FROM levelled l LEFT JOIN open o ON true
), rated AS (
  SELECT d.doc_id, d.size, a.total AS source_size, a.target, CASE WHEN a.total > 0 THEN a.target / a.total ELSE 0::DOUBLE END AS rate,
    ('0x' || md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.t || ':')[1:8])::BIGINT / 4294967296::DOUBLE AS u
  FROM doc d JOIN aim a ON a.source IS NOT DISTINCT FROM d.source
), taken AS (
  SELECT *, least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 2)::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
""",
    "op12_fill_in_middle": r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), cut AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
    least(('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS a,
    greatest(('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50
      THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM doc
), part AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p,
    coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM part
""",
    "op13_source_divergence": r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
  ) AS ts FROM documents
), term AS (
  SELECT d, lang, source, t, count(*) AS n FROM (SELECT d, lang, source, unnest(ts) AS t FROM doc) GROUP BY ALL
), kept AS (
  SELECT lang, t, sum(n) AS n FROM term GROUP BY lang, t HAVING count(*) >= 3
), whole AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), used AS (
  SELECT lang, source, t, sum(x.n) AS n FROM term x JOIN kept k USING (lang, t) GROUP BY lang, source, t
), grp AS (
  SELECT DISTINCT lang, source FROM doc
), size AS (
  SELECT g.lang, g.source, coalesce(sum(u.n), 0)::HUGEINT AS total FROM grp g LEFT JOIN used u USING (lang, source) GROUP BY ALL
), share AS (
  SELECT z.lang, z.source, k.t, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0)::HUGEINT + 1)) // (z.total + w.v) AS p,
    1 + (1000000000::HUGEINT * (k.n::HUGEINT + 1)) // (w.total + w.v) AS q
  FROM size z JOIN kept k ON k.lang = z.lang JOIN whole w ON w.lang = z.lang
  LEFT JOIN used u ON u.lang = z.lang AND u.source = z.source AND u.t = k.t
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // q AS value FROM share WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
