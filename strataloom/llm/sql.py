"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, length(text) AS chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sums),
weighed AS (
  SELECT source, source_size, rank, source_size * 2.0::DOUBLE AS most,
         CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(most) OVER before, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, (most / weight, rank)) AS level FROM levels WHERE level <= most / weight),
targets AS (
  SELECT source, source_size, least(most, coalesce(weight * (SELECT level FROM chosen), most)) AS target FROM weighed),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT s.doc_id, s.size, r.source_size, r.target,
       s.size * (floor(r.rate)::BIGINT + CASE
         WHEN ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
              < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""

OP6 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP11 = """
WITH RECURSIVE crc_bytes AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
f AS (
  SELECT doc_id, lang, n_chars, coalesce(xor(list_reduce(
           [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS changed,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
         || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
         coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail
  FROM documents, crc_bytes),
h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + changed::INT)::VARCHAR)::VARCHAR || ':' || (n_chars + changed::INT)::VARCHAR, '-') || tail) AS shown
  FROM f),
leaves AS (
  SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS width, *
  FROM h),
nodes AS (
  SELECT tree, 0 AS level, idx, width, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (width + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes
  WHERE width > 1 GROUP BY tree, level, idx // 2, width),
walk AS (
  SELECT r, tree, 0 AS level, idx, width, shown AS node, '' AS siblings FROM leaves
  UNION ALL
  SELECT r, w.tree, w.level + 1, w.idx // 2, (w.width + 1) // 2,
         CASE WHEN s.digest IS NULL THEN sha256(node) WHEN w.idx % 2 = 0 THEN sha256(node || s.digest) ELSE sha256(s.digest || node) END,
         siblings || coalesce(s.digest, '')
  FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.idx = xor(w.idx, 1)
  WHERE w.width > 1),
subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS width FROM nodes WHERE width = 1),
tops AS (
  SELECT 0 AS level, tree AS idx, width, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (width + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops
  WHERE width > 1 GROUP BY level, idx // 2, width),
climb AS (
  SELECT r, 0 AS level, w.tree AS idx, s.width, node, siblings FROM walk w JOIN subroots s ON s.tree = w.tree AND w.width = 1
  UNION ALL
  SELECT r, w.level + 1, w.idx // 2, (w.width + 1) // 2,
         CASE WHEN s.digest IS NULL THEN sha256(node) WHEN w.idx % 2 = 0 THEN sha256(node || s.digest) ELSE sha256(s.digest || node) END,
         siblings || coalesce(s.digest, '')
  FROM climb w LEFT JOIN tops s ON s.level = w.level AND s.idx = xor(w.idx, 1)
  WHERE w.width > 1)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(c.siblings) AS proof_sha256, c.node AS folded_root, c.node = t.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN climb c ON c.r = l.r AND c.width = 1 JOIN tops t ON t.width = 1
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
items AS (
  SELECT DISTINCT item, n, array_to_string(ws[k : k + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0), LATERAL unnest(range(1, len(ws) - n + 2)) AS t(k)),
hits AS (
  SELECT DISTINCT r, k, n, item
  FROM (SELECT r, n, k, array_to_string(ws[k : k + n - 1], ' ') AS w
        FROM d CROSS JOIN (SELECT DISTINCT n FROM items), LATERAL unnest(range(1, len(ws) - n + 2)) AS t(k)) JOIN items USING (n, w)),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, LATERAL unnest(range(k, k + n)) AS u(p) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN listed USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": OP4, "op6_exact_dedup": OP6, "op11_merkle_manifest": OP11, "op12_winnowing": OP12}
