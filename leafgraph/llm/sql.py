"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from leafgraph.llm import license_scan, mixing
from leafgraph.llm.queries import MIX, URL_RULES

UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def op1() -> str:
    """Means of at most mixing.PART only: each document's number has one part."""
    own = ", ".join(f"'{s}'" for s in MIX if s != mixing.REST)
    shares = ", ".join(f"('{g}', {w!r}::DOUBLE)" for g, w in MIX.items())
    return f"""
WITH d AS (SELECT *, CASE WHEN source IN ({own}) THEN source ELSE '{mixing.REST}' END AS g FROM documents),
n AS (SELECT g, count(*) AS c FROM d GROUP BY g),
w AS (SELECT g, c, share FROM n JOIN (VALUES {shares}) AS v(g, share) USING (g)),
m AS (SELECT g, (SELECT count(*) FROM documents) * share / (SELECT sum(share) FROM w) / c AS mean FROM w),
steps AS (SELECT g, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1.0))) OVER (PARTITION BY g ORDER BY k) AS below
  FROM m, range(0, 200) AS r(k)),
u AS (SELECT *, ('0x' || substr(md5('1:' || doc_id || ':1'), 1, {mixing.HEX}))::BIGINT / {float(mixing.STEPS)!r} AS u FROM d),
t AS (SELECT u.*, (SELECT count(*) FROM steps s WHERE s.g = u.g AND s.below <= u.u) AS times FROM u)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('1:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM t)"""


OP2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""


def op5() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {UP}, {LOW}) AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES {rules}),
m AS (SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS rank
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rank = 1"""


def op4() -> str:
    quoted = lambda x: x.replace("'", "''")
    rows = ", ".join(f"('{quoted(k)}', '{quoted(v)}')" for k, v in license_scan.TEMPLATES.items())
    return rf"""
WITH t(license, text) AS (VALUES {rows}),
words AS (SELECT license, regexp_extract_all(lower(text), '{license_scan.WORD}') AS w FROM t),
sh AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM words)),
c AS (SELECT license, count(*) AS total, pow(2, ceil(log2(count(*))))::INT AS size FROM sh GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{license_scan.WORD}') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT doc_id, license, pos, s, size, total FROM p JOIN sh USING (s) JOIN c USING (license)),
k AS (SELECT *, pos // size AS k FROM h UNION ALL SELECT *, pos // size - 1 AS k FROM h WHERE pos >= size),
n AS (SELECT doc_id, license, k, size, total, count(DISTINCT s) AS shared FROM k GROUP BY ALL)
SELECT doc_id, license, shared, total, (k * size)::BIGINT AS first_word FROM n WHERE shared * 5 >= total * 4
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY shared DESC, k * size) = 1"""


OP9 = rf"""
WITH word(p) AS (VALUES ('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP}, {LOW}), (SELECT p FROM word)) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UP}, {LOW}), (SELECT p FROM word)) AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(w[k:k + 9]) AS n, array_to_string(w[k:k + 9], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
found AS (SELECT doc_id, k, pos.n, item_id FROM pos JOIN wins ON pos.s = wins.s AND pos.n = wins.n),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""


OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id,
  regexp_extract_all(translate(coalesce(text, ''), {UP}, {LOW}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[k:k + 3], ' ') FOR k IN range(1, greatest(len(w) - 3, 1) + 1)]) AS s
  FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN s USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mixing": op1(), "op2_exact_dedup": OP2, "op4_license_scan": op4(), "op5_url_filter": op5(), "op9_decontamination": OP9, "op10_near_dedup": OP10}
