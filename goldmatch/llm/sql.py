"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from goldmatch.llm.quality import STOP_WORDS

_SQL: dict[str, str] = {}

_SQL["op11_hard_negatives"] = """
WITH sound AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

_SQL["op12_url_filters"] = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), rest AS (
  SELECT row_number() OVER () AS row_no, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT row_no, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) = 1
"""

_SQL["op6_quality_rules"] = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), windows AS (
  SELECT row_no, i, [w[i], w[i + 1], w[i + 2]] AS three FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM parts)
), again AS (
  SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, three) > 1
), covered AS (
  SELECT row_no, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row_no
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len([x for x in w if list_contains({STOP_WORDS!r}, x)]) AS n_stop_words
  FROM parts LEFT JOIN covered USING (row_no)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.2
         AND n_stop_words / n_words >= 0.03 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM based
"""


_SQL["op1_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 8 WHEN 'system' THEN 6 ELSE 8 + 2 * strlen(role) END + length(text) + 4
         + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?SYS\]|ROLE=)')) AS chars
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""

_SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT row_no, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)])
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM parts
), members AS (
  SELECT row_no, doc_id, len(s) AS n, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL
), links AS (
  SELECT DISTINCT a, b FROM (
    SELECT any_value(x.doc_id) AS a, any_value(y.doc_id) AS b FROM members x JOIN members y ON x.shingle = y.shingle AND x.row_no <> y.row_no
    GROUP BY x.row_no, y.row_no HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
  ) WHERE a <> b
), reached(doc_id, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), lowest AS (
  SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id
)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(least_id, s.doc_id)) AS component_id,
       coalesce(s.doc_id <= least_id, true) AS kept
FROM sets s LEFT JOIN lowest l ON s.doc_id = l.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
