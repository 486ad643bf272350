"""SQL of the operators that SQL can express, for the same rows as their queries."""

# Words as the operators take them: runs of digits, ASCII letters (lower-cased) and code points from U+0080.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
x AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i))),
hit AS (SELECT DISTINCT r, s, x.n, item FROM x JOIN i ON x.phrase = i.phrase AND x.n = i.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, row_number() OVER () AS r, {WORDS} AS w FROM documents),
c AS (SELECT r, g, count(*) AS k FROM (SELECT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda s: array_to_string(w[s : s + 4], ' ')) END) AS g FROM d WHERE len(w) > 0) GROUP BY r, g),
t AS (SELECT r, sum(k) AS n FROM c GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, sum(least(a.k, b.k)) AS m FROM c a JOIN c b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN t tx ON tx.r = x JOIN t ty ON ty.r = y WHERE 5 * m >= 4 * (tx.n + ty.n - m)
  UNION SELECT a.r, b.r FROM d a JOIN d b ON a.text = b.text AND a.r < b.r),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
walk AS (SELECT r, r AS o FROM d UNION SELECT walk.r, y FROM walk JOIN both_ways ON o = x)
SELECT d.doc_id, min(other.doc_id) AS class_id, count(*) AS class_size
FROM d JOIN walk USING (r) JOIN d other ON other.r = walk.o GROUP BY d.r, d.doc_id"""

# Terms of the source divergence: runs of ASCII letters (lower-cased) and code points from U+0080.
TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"""

SOURCE_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(m) AS whole FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, k.term, m, coalesce(n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM every GROUP BY lang, source),
p AS (SELECT e.lang, e.source, e.term, e.n,
    1 + (CAST(1000000000 AS HUGEINT) * (e.n + 2)) // (t.total + 2 * l.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (e.m + 2)) // (l.whole + 2 * l.v) AS q
  FROM every e JOIN t ON t.lang = e.lang AND t.source = e.source JOIN l ON l.lang = e.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""
