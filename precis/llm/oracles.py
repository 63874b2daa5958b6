"""DuckDB SQL of the training-data queries that SQL can express.

The classifiers, the approximate search, the secret scan's randomness tests, packing,
BPE and the page extraction are tested in ``tests/llm`` instead.
"""

from __future__ import annotations

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS s FROM w
), t AS (
  SELECT doc_id, unnest(s) AS x FROM sh
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN sh p ON p.doc_id = a JOIN sh q ON q.doc_id = b
  WHERE 100 * common >= 90 * (len(p.s) + len(q.s) - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sh
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sh.doc_id) AS component_id FROM sh
"""

# Base 32 of a hex digest: five hex digits are four symbols.
_B32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {15 - 5 * k}) % 32 + 1, 1)"
    for g in range(8) for k in range(4)
)
OP9 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM f
"""

def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP11 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, {_leaf('n_chars')} AS h, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS other,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, count(*) OVER (PARTITION BY lang) AS n FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM leaf
), low AS (
  SELECT tree, 0 AS lv, idx, h, n FROM placed
  UNION ALL
  SELECT tree, lv + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lv, idx // 2, n
), tops AS (
  SELECT tree, h, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS tree, 0 AS lv, tree - 1 AS idx, h, n FROM tops
  UNION ALL
  SELECT 0, lv + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lv, idx // 2, n
), node AS (
  SELECT * FROM low UNION ALL SELECT * FROM high
), climb AS (
  SELECT doc_id, h AS leaf, tree AS home, tree, 0 AS lv, idx, n, coalesce(other, h) AS acc, '' AS sib FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.home, CASE WHEN c.n = 1 THEN 0 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.lv + 1 END,
         CASE WHEN c.n = 1 THEN c.tree - 1 ELSE c.idx // 2 END,
         CASE WHEN c.n = 1 THEN (SELECT max(n) FROM tops) ELSE (c.n + 1) // 2 END,
         CASE WHEN c.n = 1 THEN c.acc WHEN s.h IS NULL THEN sha256(c.acc)
              WHEN c.idx % 2 = 1 THEN sha256(s.h || c.acc) ELSE sha256(c.acc || s.h) END,
         CASE WHEN c.n = 1 THEN c.sib ELSE c.sib || coalesce(s.h, '') END
  FROM climb c LEFT JOIN node s ON s.tree = c.tree AND s.lv = c.lv AND s.idx = xor(c.idx, 1)
  WHERE c.n > 1 OR c.tree > 0
), root AS (
  SELECT h FROM high WHERE n = 1
)
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = root.h AS verified
FROM climb JOIN tops ON tops.tree = climb.home, root WHERE climb.tree = 0 AND climb.n = 1
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 5
"""

OP13 = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), common AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON c.key = k.key GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_topk": OP7, "op8_jaccard": OP8, "op9_warc": OP9, "op11_merkle": OP11, "op12_hard_negatives": OP12,
        "op13_line_dedup": OP13,
    }
