"""DuckDB counterparts of the named queries that SQL can express."""

from __future__ import annotations

from twinline.llm import quality_rules, queries, sharding, vector_codes

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

OP2 = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.HASH_BITS // 4}))::BIGINT AS h,
    CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n
  FROM documents
),
t AS (
  SELECT l, h >> ({sharding.HASH_BITS} - l) AS p FROM d, range(0, {sharding.HASH_BITS + 1}) r(l)
  WHERE n <= {queries.SHARD_BYTES} GROUP BY 1, 2 HAVING sum(n) <= {queries.SHARD_BYTES}
),
k AS (
  SELECT h, min(l) AS depth FROM (SELECT DISTINCT h FROM d) JOIN t ON p = h >> ({sharding.HASH_BITS} - l) GROUP BY h
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), {sharding.HASH_BITS}, '0'), 1, CAST(depth AS INTEGER)) END AS shard,
  CAST(depth AS INTEGER) AS shard_depth, n AS shard_row_bytes
FROM d JOIN k USING (h)
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM (
    SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)
  )
),
v AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE c > 1
  ) GROUP BY r
),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>!?@~^=+_{{}}\\[\\]]')) AS BIGINT) AS n_marks,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stops
  FROM w LEFT JOIN v USING (r)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1
    AND n_marks / n_words <= 0.3 AND n_stops / n_words >= 0.05
    AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id WHERE c.root < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(m.root, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY 1) m USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(_FIELD.format(f) for f in fields) + ")"


OP11 = f"""
WITH RECURSIVE crc AS (  -- the checksum's 256 steps, from their rule
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t
  FROM range(256) r(i)
),
d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf('text')} AS leaf,
    CASE WHEN (list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)) & 1) = 1
      THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS bent
  FROM documents, crc
),
l AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id, leaf) AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
),
up(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3
),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3
),
nodes AS (
  SELECT tree, lvl, pos, h FROM up WHERE n > 1
  UNION ALL
  SELECT s.tree, x.lvl + (SELECT max(lvl) FROM up u WHERE u.tree = s.tree), x.pos, x.h FROM top x, subs s WHERE x.n > 1
),
height AS (SELECT u.tree, max(lvl) AS lvls, any_value(s.pos) AS own, any_value(s.h) AS subroot FROM up u JOIN subs s USING (tree) GROUP BY u.tree),
runs AS (SELECT tree, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY 1, 2, 3),
walk(id, tree, lvl, pos, proof, cur) AS (
  SELECT id, tree, 0, CASE WHEN lvls = 0 THEN own ELSE pos END, '', bent FROM l JOIN height USING (tree)
  UNION ALL
  SELECT id, w.tree, w.lvl + 1, CASE WHEN w.lvl + 1 = g.lvls THEN g.own ELSE w.pos // 3 END,
    w.proof || array_to_string(list_concat(hs[1 : w.pos % 3], hs[w.pos % 3 + 2 :]), ''),
    sha256(array_to_string(list_concat(list_append(hs[1 : w.pos % 3], w.cur), hs[w.pos % 3 + 2 :]), ''))
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.pos // 3 JOIN height g ON g.tree = w.tree
),
ends AS (SELECT id, arg_max(proof, lvl) AS proof, arg_max(cur, lvl) AS folded_root FROM walk GROUP BY id),
ids AS (SELECT id, doc_id, leaf, subroot FROM l JOIN height USING (tree))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ids JOIN ends USING (id), (SELECT h AS root FROM top WHERE n = 1)
"""


def _op13() -> str:
    """Each round twice: distances of every part to every entry, then the entries' means."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {vector_codes.SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
q AS MATERIALIZED (
  SELECT row, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) t(p)
),
b0 AS (
  SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM q) WHERE e < {entries}
)"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(
            f"""a{k} AS (
  SELECT row, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m
  FROM q JOIN b{k} USING (p) GROUP BY row, p
)"""
        )
        if k < vector_codes.ROUNDS:
            steps.append(
                f"""m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS m
    FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM q JOIN a{k} USING (row, p)) GROUP BY ALL
  ) GROUP BY p, e
),
b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
            )
    last = vector_codes.ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f""",
o AS (
  SELECT vec_id, label, row, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
  FROM q JOIN a{last} USING (row, p) GROUP BY vec_id, label, row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
   FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{last})) AS codebooks_sha256
FROM o
"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op2_shards": OP2, "op4_quality_rules": OP4, "op5_jaccard_join": OP5, "op6_warc": OP6,
            "op11_merkle_manifest": OP11, "op13_vector_codes": _op13()}
