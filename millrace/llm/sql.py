"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from millrace.llm.license_scan import PHRASES, TEMPLATES, template_table

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _places(phrase: str) -> str:
    here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {here})"


def _license() -> str:
    found = ", ".join(f"{_places(p)} AS p{i}" for i, p in enumerate(PHRASES))
    every = "flatten([" + ", ".join(f"p{i}" for i in range(len(PHRASES))) + "])"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{x}' END" for i, x in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    templates = ", ".join(f"('{label}', {_list(words)}, {run})" for _, label, words, run in template_table(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {found} FROM d),
q AS (SELECT doc_id, n_words, {every} AS places, {base} AS base FROM p),
t(label, words, run) AS (VALUES {templates}),
m AS (SELECT doc_id, label, len(words) AS size,
  list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i])), lambda i: len(list_intersect(words, w[i:i + run - 1])))) AS shared FROM d, t),
k AS (SELECT doc_id, list(DISTINCT label) AS more, max(shared / size) AS share FROM m WHERE shared >= ceil(0.8 * size - 1e-9) GROUP BY doc_id)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN k USING (doc_id)"""


HOST = r"nullif(translate(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
DOMAINS = "list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))"

URLS = rf"""
WITH c AS (SELECT page_id, {HOST} AS host, DATE '2024-01-01' + (page_id * 7919 % 366)::INT AS fetched_at FROM pages),
n AS (SELECT DISTINCT unnest({DOMAINS}) AS domain FROM c WHERE host IS NOT NULL),
k AS (SELECT domain, ascii(domain) * 37 + coalesce(ascii(substring(domain, 3, 1)), 0) * 11 + length(domain) * 5 AS k FROM n),
e AS (
  SELECT 'ads' AS list, domain, 'add' AS action, k % 300 AS number FROM k UNION ALL
  SELECT 'ads', domain, 'remove', k % 300 + k % 60 + 1 FROM k UNION ALL
  SELECT 'ads', domain, 'add', k % 300 + 90 FROM k UNION ALL
  SELECT 'malware', domain, 'add', k % 200 FROM k WHERE k % 3 = 0 UNION ALL
  SELECT 'malware', domain, 'remove', k % 200 + 100 FROM k WHERE k % 2 = 0 UNION ALL
  SELECT 'adult', domain, 'add', -30 FROM k WHERE k % 5 = 0),
a AS (SELECT list, domain, DATE '2024-01-01' + number::INT AS day, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT list, domain, day AS since, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until, action FROM a),
x AS (SELECT page_id, fetched_at, unnest({DOMAINS}) AS domain FROM c WHERE host IS NOT NULL),
h AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(domain, length(domain)) AS domain, min(since) AS listed_since
  FROM x JOIN v USING (domain) WHERE action = 'add' AND since <= fetched_at AND (until IS NULL OR fetched_at < until) GROUP BY page_id)
SELECT page_id, fetched_at, host, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, domain, listed_since FROM c LEFT JOIN h USING (page_id)"""

EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
o AS (SELECT doc_id, n, k, item_id FROM runs JOIN windows USING (n, words)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLES = {"op2_license_scan": _license(), "op3_url_filter": URLS, "op8_exact_dedup": EXACT, "op10_decontaminate": CONTAMINATION}
