"""SQL for DuckDB that gives the rows of queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS whole FROM s GROUP BY 1),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n),
one AS (SELECT s.doc_id, s.x, n FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ WHERE 100 * k >= 80 * (na + nb - k)),
side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS m FROM side UNION SELECT side.b, reach.m FROM reach JOIN side ON side.a = reach.node WHERE reach.m < side.b),
least_ AS (SELECT node, min(m) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(least_.m, c.class_id, d.doc_id) AS component_id, coalesce(least_.m, c.class_id, d.doc_id) = d.doc_id AS kept, coalesce(c.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN least_ ON least_.node = c.class_id"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, n, i AS j, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q))),
hit AS (SELECT doc_id, n, i, j, item_id FROM t JOIN q USING (n, x)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1),
run AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS id, n, i, j, j - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY j) AS g FROM hit),
match AS (SELECT doc_id, id, min(i) - 1 AS first, min(j) - 1 AS item_first, count(*) + n - 1 AS words FROM run GROUP BY doc_id, id, n, i - j, g),
best AS (SELECT * FROM match QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, first, id, item_first) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
coalesce(best.words, 0) AS longest, best.first AS longest_first, best.id AS longest_item, best.item_first AS longest_item_first
FROM d LEFT JOIN place ON place.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id"""

_BIT = "((instr('0123456789ABCDEF', substr(h, CAST(2 * (k // 8) + CASE WHEN k % 8 < 4 THEN 2 ELSE 1 END AS BIGINT), 1)) - 1) >> CAST(k % 4 AS BIGINT)) & 1"
RESAMPLING = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
raw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY 1, 2), aim AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY 1),
word AS (SELECT x, list_transform(range(0, 4 * len(h)), lambda k: {_BIT}) AS bits FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM raw UNION SELECT x FROM aim))),
crc AS (SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(bits AS BIGINT[])), lambda c, k: xor(c >> 1, 3988292384 * (xor(c, k) & 1))), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM word),
s AS (SELECT bucket, sum(n) AS s FROM raw JOIN crc USING (x) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM aim JOIN crc USING (x) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (SELECT coalesce(sum(s), 0) + 10000.0::DOUBLE FROM s) / ((s + 1.0::DOUBLE) * (SELECT coalesce(sum(t), 0) + 10000.0::DOUBLE FROM t)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, sum(n * gain) AS weight FROM raw JOIN crc USING (x) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= (SELECT 10 * count(*) // 100 FROM ranked) THEN nth END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""

JACCARD_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS whole FROM s GROUP BY 1),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id, count(*) OVER (PARTITION BY whole) AS copies FROM n),
one AS (SELECT s.doc_id, s.x, n, copies FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.copies) AS ca, any_value(b.copies) AS cb, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b, ca, cb FROM both_ WHERE 100 * k >= 80 * (na + nb - k)),
side AS (SELECT a, b, cb AS copies FROM link UNION ALL SELECT b, a, ca FROM link),
linked AS (SELECT a AS class_id, sum(copies) AS links FROM side GROUP BY 1),
reach AS (SELECT DISTINCT a AS node, a AS m FROM side UNION SELECT side.b, reach.m FROM reach JOIN side ON side.a = reach.node WHERE reach.m < side.b),
least_ AS (SELECT node, min(m) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(least_.m, c.class_id, d.doc_id) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(c.copies, 1) - 1 + coalesce(linked.links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN least_ ON least_.node = c.class_id LEFT JOIN linked ON linked.class_id = c.class_id"""
