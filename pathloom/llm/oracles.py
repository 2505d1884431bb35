"""DuckDB SQL for the results of the queries that SQL can express."""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, {_WORDS}::BIGINT AS size, coalesce(text, '') AS t, md5(coalesce(text, '')) AS th,
         (('0x' || substr(md5('29|' || coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
q AS (
  SELECT *, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars,
         length(t) - length(translate(t, '#*$%&|<>{{}}', '')) AS symbols FROM d),
e AS (
  SELECT doc_id, s, size, th, row_number() OVER () AS k,
         -ln(u) / (1 + (size >= 50)::INT + (chars >= 3 * size AND chars <= 12 * size)::INT + (symbols * 20 <= size)::INT) AS es FROM q),
z AS (SELECT s, sum(size)::BIGINT AS source_size FROM e GROUP BY s),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM z),
l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         1.5::DOUBLE * sum(source_size) OVER () AS want FROM w),
v AS (SELECT *, (want - capped) / open AS level FROM l),
m AS (SELECT arg_min(level, struct_pack(r := cap / w, s := s)) AS level FROM v WHERE level * w < cap),
g AS (SELECT s, source_size, CASE WHEN m.level IS NULL OR m.level * w > cap THEN cap ELSE m.level * w END AS target FROM v LEFT JOIN m ON true),
h AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM g),
r AS (SELECT *, greatest(target - epochs * source_size, 0) AS rest FROM h),
c AS (SELECT e.*, r.rest, sum(size) OVER (PARTITION BY s ORDER BY es, doc_id NULLS FIRST, size, th, k)::BIGINT AS upto FROM e JOIN r USING (s)),
f AS (SELECT s, coalesce(max(upto) FILTER (upto <= rest), 0) AS got FROM c GROUP BY s),
b AS (SELECT s, arg_min(k, struct_pack(m := abs(size - (rest - got)), es := es, size := size, th := th, k := k)) AS close
      FROM c JOIN f USING (s) WHERE upto > rest AND abs(size - (rest - got)) < rest - got GROUP BY s)
SELECT c.doc_id, c.size, r.source_size, r.target,
       (c.size * (r.epochs + CASE WHEN c.upto <= c.rest OR coalesce(b.close = c.k, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN r USING (s) LEFT JOIN b USING (s)
"""

# crc32 by its table of 256 entries, built by the rule, over the bytes of the text.
_OP9 = r"""
WITH tb AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tb FROM range(256) r(i)),
d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS s, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, tb),
k AS (SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, '~') || '|' || size || '|' || text_crc32) AS h FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size, text_crc32) AS k, count(*) OVER (PARTITION BY s) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k - 1) / (2 * n), s, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM r),
q AS (SELECT *, (pos * 40 // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - (shard::BIGINT * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM q
"""

SQL = {"op5_quality_weighted_mix": _OP5, "op9_stratified_interleave": _OP9}

_SPACES = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

_OP8 = rf"""
WITH x AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

SQL["op8_bloom_line_dedup"] = _OP8

_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '~') AS h, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5),
g AS (SELECT r, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM p),
q AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, sum(least(5, coalesce(j - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM q) GROUP BY r),
l AS (SELECT r, h, unnest(string_split(t, chr(10))) AS line FROM d),
x AS (SELECT r, h, line, lower(trim(line, {_SPACES})) AS k FROM l WHERE trim(line, {_SPACES}) <> ''),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM x GROUP BY r),
o AS (SELECT h, k FROM x GROUP BY h, k HAVING count(DISTINCT r) > 10),
z AS (SELECT r, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM x SEMI JOIN o USING (h, k) GROUP BY r),
s AS (
  SELECT doc_id, len(w) AS n_words, length(translate(t, {_SPACES}, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(z.n, 0) AS lost
  FROM d LEFT JOIN u USING (r) LEFT JOIN c USING (r) LEFT JOIN z USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - lost >= 0.3 * n_words AS kept
FROM s
"""

SQL["op7_line_frequency_rules"] = _OP7

_OP6 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT host FROM p GROUP BY host HAVING NOT bool_or(starts_with(url, 'https://'))),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

SQL["op6_bloom_cascade_urls"] = _OP6

_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

SQL["op1_skipping_jaccard_join"] = _OP1

# Trees are folded level by level; a document's siblings are those of its run on every level.
_OP11 = r"""
WITH RECURSIVE tb AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tb FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('s' || lang, 'n') AS tree, n_chars,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '0'))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, tb),
l AS (
  SELECT k, doc_id, tree, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(length((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || tail) AS given FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (
  SELECT tree, 0 AS level, i, n, leaf AS node FROM r
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(node || coalesce(after, ''))
  FROM (SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY i) AS after FROM t WHERE n > 1) WHERE i % 2 = 0),
s AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, i, n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(node || coalesce(after, ''))
  FROM (SELECT *, lead(node) OVER (ORDER BY i) AS after FROM u WHERE n > 1) WHERE i % 2 = 0),
p AS (
  SELECT r.k, t.level, coalesce(b.node, '') AS other, (r.i >> t.level) & 1 AS own
  FROM r JOIN (SELECT DISTINCT tree, level FROM t WHERE n > 1) t USING (tree) LEFT JOIN t b ON b.tree = r.tree AND b.level = t.level AND b.i = xor(r.i >> t.level, 1)
  UNION ALL
  SELECT r.k, 1000 + u.level, coalesce(b.node, ''), (s.i >> u.level) & 1
  FROM r JOIN s USING (tree) JOIN (SELECT DISTINCT level FROM u WHERE n > 1) u ON true LEFT JOIN u b ON b.level = u.level AND b.i = xor(s.i >> u.level, 1)),
q AS (SELECT k, string_agg(other, '' ORDER BY level) AS proof, list(struct_pack(o := other, own := own) ORDER BY level) AS steps FROM p GROUP BY k),
f AS (
  SELECT k, 1 AS j, given AS node, steps FROM r LEFT JOIN q USING (k)
  UNION ALL
  SELECT k, j + 1, sha256(CASE WHEN steps[j].own = 1 THEN steps[j].o || node ELSE node || steps[j].o END), steps FROM f WHERE j <= len(steps)),
g AS (SELECT k, arg_max(node, j) AS folded_root FROM f GROUP BY k)
SELECT doc_id, leaf, subroot, u.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = u.node AS verified
FROM r JOIN s USING (tree) JOIN g USING (k) LEFT JOIN q USING (k) JOIN u ON u.n = 1
"""

SQL["op11_merkle_dag_manifest"] = _OP11

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT k, doc_id, len(t) AS n, sum(len(t)) OVER ()::BIGINT AS l, count(*) OVER () AS total FROM d WHERE len(t) > 0),
i AS (
  SELECT row_number() OVER () AS j, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
q AS (SELECT j, item_id, t, count(*) AS n FROM (SELECT j, item_id, unnest(t) AS t FROM i) GROUP BY ALL),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(t) AS t FROM d) GROUP BY k, t),
f AS (SELECT t, floor(1000 * ln((2 * (SELECT count(*) FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY t),
c AS (
  SELECT j, item_id, s.k, s.doc_id, sum(q.n * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * s.n * total) // l))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN s ON s.k = p.k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

SQL["op13_k2_treap_search"] = _OP13
