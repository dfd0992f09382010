"""DuckDB SQL of the corpus queries that SQL can express; brute force, for tables of the checks' size."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLOSURE = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (an + bn - o)),
{_CLOSURE}
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(c.y, doc_id)) AS component_id FROM s LEFT JOIN c ON c.x = s.doc_id"""

SUBSTRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s AND f.m < w.doc_id),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n),
u AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM u),
q AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
{_CLOSURE},
k AS (SELECT a AS x, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.y, vec_id)) AS kept FROM v LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id"""

MIX = f"""WITH m AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents),
z AS (SELECT *, floor(log2(size + 1))::INT AS class,
  (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '-') || '|' || mark || '|mix'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM m),
s0 AS (SELECT source, sum(size)::BIGINT AS words FROM z GROUP BY source),
s1 AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight, words * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS full_cap, (sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0) AS free FROM s1
  WINDOW o AS (ORDER BY cap / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max(level) AS level FROM (SELECT ((SELECT sum(words) FROM s0) * 1.5::DOUBLE - full_cap) / free AS level, cap, weight FROM s2) WHERE level * weight <= cap
  OR level = (SELECT max(((SELECT sum(words) FROM s0) * 1.5::DOUBLE - full_cap) / free) FROM s2)),
t AS (SELECT source, words, least(weight * (SELECT level FROM lv), cap) AS target FROM s1),
c0 AS (SELECT source, class, sum(size) AS s, pow(2.0, -0.25 * class) AS w FROM z GROUP BY source, class),
c1 AS (SELECT c0.*, t.words, t.target, (t.target - 2.0 * coalesce(sum(s) OVER (PARTITION BY c0.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(w * s) OVER (PARTITION BY c0.source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c
  FROM c0 JOIN t ON t.source IS NOT DISTINCT FROM c0.source),
c2 AS (SELECT *, arg_min(c, class) FILTER (WHERE c * w <= 2.0) OVER (PARTITION BY source) AS k FROM c1),
c3 AS (SELECT *, least(2.0, greatest(0.0, coalesce(k, 2.0) * w)) AS e FROM c2),
c4 AS (SELECT *, floor(e + 1e-12) AS sure, greatest(0.0, e - floor(e + 1e-12)) AS p FROM c3),
c5 AS (SELECT *, target - sum(sure * s) OVER (PARTITION BY source) AS rest FROM c4),
j AS (SELECT z.doc_id, z.mark, z.size, z.source, c5.words, c5.target, c5.sure, c5.rest, CASE WHEN p > 1e-12 AND size > 0 THEN u / (1 - u) * (1 - p) / p END AS odds
  FROM z JOIN c5 ON c5.source IS NOT DISTINCT FROM z.source AND c5.class = z.class),
y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, mark ROWS UNBOUNDED PRECEDING) AS upto FROM j WHERE odds IS NOT NULL)
SELECT doc_id, size, words AS source_size, target, (size * (sure + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM y
UNION ALL SELECT doc_id, size, words, target, (size * sure)::BIGINT FROM j WHERE odds IS NULL"""


def _grams(m: int) -> str:
    return f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM pc)"


PHRASES = f"""WITH pc0 AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
pc AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pc0),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pc GROUP BY lang),
c AS (SELECT lang, m, g, count(*)::HUGEINT AS f FROM ({' UNION ALL '.join(_grams(m) for m in range(1, 6))}) GROUP BY lang, m, g HAVING count(*) >= 100),
o AS (SELECT DISTINCT lang, f, unnest([array_to_string(string_split(g, ' ')[1:m - 1], ' '), array_to_string(string_split(g, ' ')[2:], ' ')]) AS g FROM c WHERE m > 2),
s AS (SELECT c.* FROM c ANTI JOIN o ON c.lang = o.lang AND c.g = o.g AND o.f >= c.f WHERE m > 1),
k AS (SELECT lang, m, g, f, k, array_to_string(string_split(g, ' ')[1:k], ' ') AS h, array_to_string(string_split(g, ' ')[k + 1:], ' ') AS e
  FROM (SELECT *, unnest(range(1, m)) AS k FROM s)),
z AS (SELECT k.lang, k.g, k.f, k.k, l.f AS l, r.f AS r, t.n, (1000 * k.f * t.n) // (l.f * r.f) AS score FROM k JOIN c l ON l.lang = k.lang AND l.g = h
  JOIN c r ON r.lang = k.lang AND r.g = e JOIN t ON t.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS pick FROM z),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(g)) AS rank FROM b WHERE pick = 1)
SELECT lang, rank::BIGINT AS rank, g AS phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM y WHERE rank <= 2000"""

NEGATIVES = """WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank, n.b AS negative_id,
  p.score AS positive_score, n.score AS negative_score FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
  QUALIFY rank <= 5"""
