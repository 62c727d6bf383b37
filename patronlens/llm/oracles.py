"""SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_3 = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER.format("coalesce(text, '')"))

# Smallest id reachable over the links of (a, b), each pair in both directions.
REACHED = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(least(a, b)) AS low FROM reach GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y
          ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
{REACHED},
c AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id,
       vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN lowest ON lowest.a = vec_id
"""

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                          ELSE w END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
common AS (SELECT e.doc_id AS a, f.doc_id AS b, e.n AS n, f.n AS m, count(*) AS c
           FROM e JOIN e f ON e.x = f.x AND e.doc_id < f.doc_id AND 100 * least(e.n, f.n) >= 80 * greatest(e.n, f.n)
           GROUP BY ALL),
half AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
{REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, doc_id = coalesce(low, doc_id) AS kept
FROM s LEFT JOIN lowest ON lowest.a = doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS_3} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {WORDS_3} AS w FROM benchmark),
g AS (SELECT DISTINCT item, list_slice(w, s, s + 9) AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(gram) AS k FROM g),
windows AS (SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS gram
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, k, item FROM windows JOIN g USING (gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n
           FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hits))
           GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit,
       coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = rf"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                  THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host_rule, path_rule, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, host_rule || path_rule AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(host_rule || path_rule) DESC) AS k
      FROM p JOIN r ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, 'casino|adult|free-bets|spam-farm|malware|phishing')
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (page_id)
"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
lt AS (SELECT lang, term, count(*) AS l FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, sum(l) AS nl, count(*) AS v FROM lt GROUP BY lang),
g AS (SELECT lang, source, term, count(*) AS c FROM t JOIN lt USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(n, 0) AS n
           FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM g GROUP BY ALL) USING (lang, source)),
full_g AS (SELECT lang, source, term, coalesce(c, 0) AS c, l,
                  (1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v))::BIGINT AS p,
                  (1 + (1000000000::HUGEINT * (l + 2)) // (nl + 2 * v))::BIGINT AS q
           FROM groups JOIN lt USING (lang) JOIN langs USING (lang) LEFT JOIN g USING (lang, source, term)),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
         FROM full_g x JOIN full_g y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM full_g WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 10
"""

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12 = f"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS nr, unnest(parts) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, {LOWER.format(f"trim(line, {SPACE})")} AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN line END, chr(10) ORDER BY nr), '')) AS kept_sha256
FROM k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id
"""

# crc32 of a decimal number, bit by bit.
CRC32 = """xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, byte:
  list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295)"""
OP13 = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, md5(length(role) || ':' || role || text) AS content, words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {CRC32} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, content, words, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d
      FROM (SELECT convs.c, content, words, k, 0 AS own FROM convs JOIN t ON t.c = convs.c - convs.c % 20 AND k <= h
            UNION ALL SELECT convs.c, content, words, k, 1 FROM convs JOIN t ON t.c = convs.c AND k > h)),
p(c, d, name, words) AS (
  SELECT c, 0::BIGINT, 'root', 0::BIGINT FROM convs
  UNION ALL SELECT p.c, r.d, md5(p.name || r.content), r.words FROM p JOIN r ON r.c = p.c AND r.d = p.d + 1),
n AS (SELECT d, name, min(c) AS conv, count(*) AS n, any_value(words) AS words FROM p GROUP BY d, name),
up AS (SELECT n.*, above.name AS above FROM n LEFT JOIN p above ON above.c = n.conv AND above.d = n.d - 1),
kids AS (SELECT d - 1 AS d, above AS name, count(*) AS kids FROM up WHERE d > 0 GROUP BY ALL),
subtree AS (SELECT p.d, p.name, sum((v.n - 1) * v.words) AS saved, count(*) FILTER (kids IS NULL) AS leaves
            FROM n v LEFT JOIN kids ON kids.d = v.d AND kids.name = v.name JOIN p ON p.c = v.conv AND p.d <= v.d
            GROUP BY p.d, p.name),
ends AS (SELECT d, name, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
         FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) USING (c, d) GROUP BY d, name)
SELECT up.conv AS conv_id, up.d AS depth, parent.conv AS parent_conv_id, up.n AS n_convs,
       coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM up JOIN subtree USING (d, name) LEFT JOIN kids USING (d, name) LEFT JOIN ends USING (d, name)
LEFT JOIN n parent ON parent.d = up.d - 1 AND parent.name = up.above
"""

ORACLES: dict[str, str] = {
    "op1_vector_duplicates": OP1,
    "op2_text_duplicates": OP2,
    "op3_decontaminate": OP3,
    "op10_url_filter": OP10,
    "op11_source_divergence": OP11,
    "op12_line_dedup": OP12,
    "op13_conversation_trie": OP13,
}
