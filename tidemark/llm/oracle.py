"""DuckDB statements that recompute the registered queries from the tables."""

from __future__ import annotations

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), w AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS place
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM w
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce('=' || source, '') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s
), level AS (  -- the least level at which the sources take all words: where one more source meets its limit, or between
  SELECT c.x AS x,
         (SELECT coalesce(sum(3 * source_size), 0) FROM w WHERE 3 * source_size <= c.x * weight) AS spent,
         (SELECT coalesce(sum(weight), 0) FROM w WHERE 3 * source_size > c.x * weight) AS left_w,
         (SELECT sum(source_size) FROM w) AS total
  FROM (SELECT DISTINCT 3 * source_size / weight AS x FROM w UNION SELECT 0) c
), pick AS (
  SELECT * FROM level WHERE spent + left_w * x <= total ORDER BY x DESC LIMIT 1
), t AS (
  SELECT w.source, w.source_size,
         CASE WHEN 3 * source_size <= x * weight OR left_w = 0 THEN (3 * source_size)::DOUBLE
              ELSE (weight * (total - spent))::DOUBLE / left_w END AS target
  FROM w, pick
), r AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM r
"""


def _crc32(hexed: str) -> str:
    """CRC-32 of the bytes whose hex digits ``hexed`` names: a fold over each byte and its eight shifts (-1)."""
    bits = f"list_prepend(('0x' || substr({hexed}, 2 * i - 1, 2))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])"
    steps = f"flatten(list_transform(range(1, length({hexed}) // 2 + 1), lambda i: {bits}))"
    step = "CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda s, x: {step}), 4294967295)"


TRIE = rf"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
         octet_length(encode(coalesce(text, '')))::BIGINT AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("hexed")} % 9 AS h
  FROM (SELECT DISTINCT conv_id, hex(encode(conv_id::VARCHAR)) AS hexed FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, nth, name, bytes FROM c JOIN t ON t.conv_id = c.base AND nth <= h
  UNION ALL
  SELECT c.conv_id, 1, nth, name, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND nth > h
), p AS (  -- every prefix of every conversation, by a digest of its turns
  SELECT conv_id, bytes, row_number() OVER w AS depth, sha256(string_agg(name, ',') OVER w) AS path,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth)
  UNION ALL
  SELECT c.conv_id, 0, 0, 'top', count(r.conv_id) FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends
  FROM p GROUP BY path, depth
), up AS (  -- a node's ancestors, itself included, along its least conversation
  SELECT node.path, node.depth, a.path AS above, a.depth AS above_depth
  FROM node JOIN p AS a ON a.conv_id = node.conv_id AND a.depth <= node.depth
), kids AS (
  SELECT above AS path, above_depth AS depth, count(*) AS n FROM up WHERE above_depth = up.depth - 1 GROUP BY ALL
), sums AS (
  SELECT above AS path, above_depth AS depth, count(*) FILTER (WHERE kids.n IS NULL) AS leaves,
         sum((node.n_convs - 1) * node.bytes)::BIGINT AS saved
  FROM up JOIN node ON node.path = up.path AND node.depth = up.depth
  LEFT JOIN kids ON kids.path = up.path AND kids.depth = up.depth
  GROUP BY above, above_depth
)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums ON sums.path = node.path AND sums.depth = node.depth
LEFT JOIN kids ON kids.path = node.path AND kids.depth = node.depth
LEFT JOIN up ON up.path = node.path AND up.depth = node.depth AND above_depth = node.depth - 1
LEFT JOIN node AS parent ON parent.path = up.above AND parent.depth = up.above_depth
"""

RESAMPLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT row, unnest(words) AS word FROM d
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), known AS (
  SELECT word, {_crc32("hexed")} % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS hexed FROM (SELECT word FROM w UNION SELECT word FROM target))
), s AS (
  SELECT bucket, count(*) AS n FROM w JOIN known USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM target JOIN known USING (word) GROUP BY bucket
), gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE
                         / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT row, sum(g)::BIGINT AS weight FROM w JOIN known USING (word) JOIN gain USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                 / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (row)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank
FROM placed
"""

SQL = {
    "op2_mixing": MIX,
    "op10_exact_dedup": EXACT,
    "op11_prefix_trie": TRIE,
    "op12_resampling": RESAMPLE,
}
