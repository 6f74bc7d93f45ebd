"""DuckDB SQL of the queries that SQL can express."""

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""

# all pairs of a label, and the smallest id reached by links
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (
  SELECT vec_id, label, x FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
   AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT vec_id AS u, vec_id AS r FROM v
  UNION
  SELECT l.u, reach.r FROM reach JOIN links l ON l.v = reach.u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u),
c AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""

# one part for each started 500 of a mean; a copy for each sum that the number reaches
MIXING = """
WITH sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(sqrt(CAST(chars AS DOUBLE))) AS all_weight, CAST(sum(chars) AS DOUBLE) AS all_chars FROM sizes),
rates AS (
  SELECT source, sqrt(CAST(chars AS DOUBLE)) / all_weight * all_chars / chars AS rate FROM sizes, totals
  WHERE chars > 0),
parts AS (
  SELECT source, rate, greatest(CAST(ceil(rate / 500) AS INT), 1) AS parts FROM rates),
terms AS (
  SELECT source, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p
  FROM parts, generate_series(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 30) AS INT)) s(k)),
cdf AS (
  SELECT source, list(total) AS sums FROM (
    SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS total FROM terms) x GROUP BY source),
docs AS (
  SELECT d.doc_id, d.source, d.text, p.rate, p.parts, c.sums, coalesce(CAST(d.doc_id AS VARCHAR), '') AS id
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
  JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
drawn AS (
  SELECT doc_id, source, text, rate, id, CAST(list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(sums,
    lambda s: s <= CAST(('0x' || substr(md5('42|' || id || '|' || i), 1, 13)) AS BIGINT) / 4503599627370496.0))))
    AS BIGINT) AS n_copies
  FROM docs),
copies AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM drawn WHERE n_copies > 0)
SELECT doc_id, source, text, round(rate, 6) AS rate, n_copies, copy,
       md5('order 42|' || id || '|' || copy) AS shuffle_key
FROM copies
"""

# crc32 of the decimal id, bit by bit: a step of -1 shifts, any other is a byte's xor
PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
           range(1, len(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: [CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END),
           CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns) d),
rebuilt AS (
  SELECT i.conv_id, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL
  SELECT i.conv_id, 100 + t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h),
steps AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, strlen(text) AS bytes,
         md5(len(role) || ':' || role || text) AS h FROM rebuilt),
prefixes AS (
  SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS node, NULL AS parent FROM ids
  UNION ALL
  SELECT conv_id, depth, bytes, string_agg(h, '') OVER w AS node,
         coalesce(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING
                                          AND 1 PRECEDING), '') AS parent
  FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved
  FROM prefixes GROUP BY node, depth, parent),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (
  SELECT n.node AS low, substr(n.node, 1, 32 * CAST(u.d AS INT)) AS node, n.saved,
         CASE WHEN k.node IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN kids k ON k.node = n.node, unnest(range(0, n.depth + 1)) AS u(d)),
below AS (SELECT node, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM above GROUP BY node),
lasts AS (SELECT conv_id, arg_max(node, depth) AS node FROM prefixes GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
         FROM lasts GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON p.node = n.parent
LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))
    AS phrase
  FROM words, range(1, 5) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, CAST(k AS BIGINT) AS k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j.j, x.a AS l, y.a AS r,
         CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM candidates c JOIN range(1, 4) AS j(j) ON j.j < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j.j + 1:], ' ')),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(c.w[i.i:i.i + m.m - 1], ' ') AS phrase, max(c.a) AS around
  FROM candidates c JOIN range(2, 4) AS m(m) ON m.m < c.k JOIN range(1, 4) AS i(i) ON i.i + m.m - 1 <= c.k
  GROUP BY 1, 2),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_phrases p ON p.lang = l.lang AND p.phrase = l.phrase
  WHERE p.around IS NULL OR 100 * CAST(p.around AS HUGEINT) < 80 * CAST(l.a AS HUGEINT))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n,
       score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000
"""

ORACLES = {"op2_exact_dedup": EXACT_DEDUP, "op3_embedding_dedup": EMBEDDINGS, "op7_mixing": MIXING,
           "op12_prefix_trie": PREFIX_TRIE, "op13_collocations": COLLOCATIONS}
