"""SQL twins of the operators' queries where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) >= 5 THEN len(ws) - 4 WHEN len(ws) > 0 THEN 1 ELSE 0 END)) AS s FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[s + 1:s + 5], ' ') AS shingle FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
roots AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)
"""

REPEATS = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
passages AS (SELECT doc_id, s, array_to_string(ws[s + 1:s + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(greatest(0, len(ws) - 19))) AS s FROM words)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM passages) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM later, range(20) t(j)),
each AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS word FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each WHERE NOT EXISTS (FROM gone WHERE gone.doc_id = each.doc_id AND gone.p = each.p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS width, array_to_string(ws[s + 1:s + 10], ' ') AS k FROM (SELECT item_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - 9) END)) AS s FROM items)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (SELECT doc_id, width, s, array_to_string(ws[s + 1:s + width], ' ') AS k FROM (SELECT doc_id, ws, width, unnest(range(greatest(0, len(ws) - width + 1))) AS s FROM words, widths)),
hits AS (SELECT doc_id, s, p.width, item_id FROM places p JOIN windows w ON p.width = w.width AND p.k = w.k),
hit_words AS (SELECT doc_id, count(DISTINCT s + j) AS n FROM hits, range(10) t(j) WHERE j < width GROUP BY 1),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

#: With links: canonical ones and refreshes, absolute or completed by the page's URL (links with dot segments, which the tables don't have, are left to tests of the operator).
URLS = r"""
WITH RECURSIVE low(f, t) AS (VALUES ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
parts AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), f, t) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages, low),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
named AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '://[^?#]*([^#]*)', 1) ELSE url END AS node FROM parts),
tags AS (SELECT node, host, path, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\s[^>]*(?:canonical|refresh)[^>]*>')) AS tag FROM named WHERE url IS NOT NULL),
hrefs AS (SELECT *, CASE WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS link FROM tags),
full_ AS (SELECT node AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link = '' OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(link, '//') THEN 'http:' || link WHEN NOT contains(url, '://') THEN NULL
    WHEN starts_with(link, '/') THEN 'http://' || host || link WHEN starts_with(link, '#') THEN url WHEN starts_with(link, '?') THEN 'http://' || host || CASE WHEN path = '' THEN '/' ELSE path END || link
    ELSE 'http://' || host || regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '^(.*/)', 1) || link END AS u FROM hrefs),
ends AS (SELECT a, translate(regexp_extract(u, '://([^/?#]*)', 1), f, t) AS h, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(u, '://[^?#]*([^#]*)', 1) AS q FROM full_, low WHERE u IS NOT NULL),
edges AS (SELECT DISTINCT a, regexp_replace(h, ':(80|443)$', '') || CASE WHEN p = '' THEN '/' ELSE p END || q AS b FROM ends),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (SELECT node AS n FROM named WHERE node IS NOT NULL UNION SELECT b FROM edges),
reach AS (SELECT n, n AS m FROM nodes UNION SELECT r.n, b FROM reach r JOIN both_ ON r.m = a),
places AS (SELECT n, regexp_extract(n, '^([^/?#]*)', 1) AS host, regexp_extract(n, '^[^/?#]*([^?#]*)', 1) AS path FROM nodes),
own AS (SELECT n, verdict, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) AS r FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
blocked AS (SELECT DISTINCT reach.n FROM reach JOIN own ON own.n = reach.m AND r = 1 AND verdict = 'block'),
fits AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS r FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN node IN (FROM blocked) AND contains(url, '://') THEN 'block' ELSE 'allow' END) AS verdict FROM named LEFT JOIN (FROM fits WHERE r = 1) USING (page_id)
"""


def _vector_codes(parts: int = 16, entries: int = 64, width: int = 4, rounds: int = 2) -> str:
    cells = ", ".join(f"v[{width} * p + {i + 1}] AS c{i}" for i in range(width))
    names = ", ".join(f"c{i}" for i in range(width))
    distance = " + ".join(f"(x.c{i} - e.c{i}) * (x.c{i} - e.c{i})" for i in range(width))
    near = lambda book: f"SELECT x.row, x.p, {', '.join(f'any_value(x.c{i}) AS c{i}' for i in range(width))}, min(({distance}) * 256 + e.e) AS best FROM pieces x JOIN {book} e ON e.p = x.p GROUP BY x.row, x.p"
    means = ", ".join(f"CAST(floor(sum(c{i}) / count(*)) AS BIGINT) AS c{i}" for i in range(width))
    steps = "".join(
        f"""near{r} AS ({near(f"book{r}")}),
means{r} AS (SELECT p, best % 256 AS e, {means} FROM near{r} GROUP BY ALL),
book{r + 1} AS (SELECT b.p, b.e, {", ".join(f"coalesce(m.c{i}, b.c{i}) AS c{i}" for i in range(width))} FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e),
"""
        for r in range(rounds)
    )
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT row, p, {cells} FROM kept, range({parts}) t(p)),
book0 AS (SELECT p, row AS e, {names} FROM pieces WHERE row < {entries}),
{steps}last AS ({near(f"book{rounds}")}),
codes AS (SELECT row, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM last GROUP BY row),
digest AS (SELECT sha256(string_agg(concat_ws(',', {names}), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (row), digest
"""


VECTOR_CODES = _vector_codes()
