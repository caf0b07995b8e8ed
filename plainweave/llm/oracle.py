"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

OP5 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (
  SELECT doc_id, bare, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(bare) AS text_sha256 FROM r
"""

OP7 = rf"""
WITH d AS (
  SELECT doc_id, source, {WORDS}::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS u FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER o AS n,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS others
  FROM s WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
k AS (SELECT n AS k, rest AS level_rest, others AS level_others FROM o WHERE weight * rest <= cap * others ORDER BY n LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN n < k THEN cap::DOUBLE ELSE (weight * level_rest)::DOUBLE / level_others END AS target FROM o, k),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
e AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND upto::DOUBLE - size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""

OP6 = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'porn', 'spam', 'track', 'warez']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, text, t.line AS line, t.pos AS pos
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM (SELECT DISTINCT doc_id, text FROM documents)) d,
    unnest(list_zip(x, range(len(x)))) AS u(t0), (SELECT t0[1] AS line, t0[2] AS pos) t),
k AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS k
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT *, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2
  FROM k WINDOW d AS (PARTITION BY doc_id, text ORDER BY pos)),
s AS (
  SELECT *, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id NULLS LAST, k) > 1 AND l2 IS NOT NULL AS later FROM w),
c AS (
  SELECT doc_id, text, pos, k, coalesce(max(later) OVER (PARTITION BY doc_id, text ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS gone
  FROM s),
b AS (
  SELECT l.doc_id, l.text, l.line, l.pos, c.k, coalesce(c.gone, false) AS gone FROM l LEFT JOIN c
    ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.text = c.text AND l.pos = c.pos),
f AS (
  SELECT *, last_value(CASE WHEN k IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id, text ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
    first_value(CASE WHEN k IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id, text ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM b),
g AS (
  SELECT doc_id, text, count(k)::BIGINT AS n_lines, (count(*) FILTER (k IS NOT NULL AND gone))::BIGINT AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT CASE WHEN k IS NOT NULL THEN gone ELSE coalesce(before AND after, false) END), '') AS kept
  FROM f GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, r, unnest(range(len(w) - 49)) AS pos, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, r, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h FROM p),
f AS (SELECT *, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY h) AS first FROM h),
c AS (SELECT DISTINCT r, unnest(range(pos, pos + 50)) AS pos FROM f WHERE coalesce(doc_id, 9223372036854775807) > first),
x AS (SELECT d.doc_id, d.r, d.w, t.i FROM d, unnest(range(len(d.w))) AS t(i)),
k AS (SELECT x.r, string_agg(x.w[x.i + 1], ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN c ON x.r = c.r AND x.i = c.pos WHERE c.pos IS NULL GROUP BY x.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""

ORACLE = {"op3_substring_dedup": OP3, "op5_exact_dedup": OP5, "op6_url_filter": OP6, "op7_mixing": OP7, "op9_line_dedup": OP9}
