"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
WORDS = r"'[^\x20\x09-\x0D]+'"

_RULES = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > n_words"}


def _prior(k: str) -> str:
    return f"sum(f_{k}) / sum(n) AS m_{k}, sum(f_{k} * f_{k} / n) AS ff_{k}"


def _weight(k: str) -> str:
    own = f"((ff_{k} - t * m_{k} * m_{k}) / (m_{k} * (1 - m_{k})) - (hosts - 1)) / (t - nn / t - (hosts - 1))"
    some = f"m_{k} * (1 - m_{k}) > 0 AND t - nn / t - (hosts - 1) > 0"
    return f"CASE WHEN {some} THEN CASE WHEN {own} > 0 THEN least(1e6, greatest(0.01, 1 / ({own}) - 1)) ELSE 1e6 END ELSE 1e6 END AS w_{k}"


def _bad(k: str) -> str:
    rate = f"((f_{k} + w_{k} * m_{k}) / (n + w_{k}))"
    return f"{rate} - 2 * sqrt(greatest(0, {rate} * (1 - {rate})) / (n + w_{k} + 1)) > greatest(0.2, 2 * m_{k})"


QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
g AS (SELECT r, i, ws[i:i + 4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
again AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g JOIN again USING (r, g)) GROUP BY r),
c AS (SELECT d.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep ON d.r = rep.r),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"sum(CASE WHEN {x} THEN 1e0 ELSE 0e0 END) AS f_{k}" for k, x in _RULES.items())} FROM c WHERE source IS NOT NULL GROUP BY source),
p0 AS (SELECT count(*) AS hosts, sum(n) AS t, sum(n * n) AS nn, {", ".join(map(_prior, _RULES))} FROM h),
p AS (SELECT *, {", ".join(map(_weight, _RULES))} FROM p0),
bad AS (SELECT source FROM h, p WHERE {" OR ".join(map(_bad, _RULES))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept FROM c"""

MAX_SCORE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""

N_GRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id"""

SQL = {"op2_quality_rules": QUALITY_RULES, "op3_max_score": MAX_SCORE, "op10_n_gram_join": N_GRAM_JOIN}
