"""DuckDB twins of what SQL can express."""

from __future__ import annotations

from siftgate.llm.mixing import BLOCK_WORDS, CAP, LEAST_BLOCKS, SHARD_SLOTS, WEIGHTS, P, round_keys

WS = "[^\\x20\\x09-\\x0D]+"


def _permuted(rows: str, out: str, x: str, n: str, seed: str) -> str:
    """A SELECT with the place of x in the seed's permutation of 0..n-1, one round per level."""
    sql = f"(SELECT *, CAST({x} AS BIGINT) AS p_x, CAST({seed} AS BIGINT) AS p_seed FROM {rows})"
    for a, b, c, d, e, f in round_keys():
        key = f"((p_seed % {P} * {a} + {b}) % {P} * {P} + (p_seed % {P} * {b} + {a}) % {P}) % {n}"
        sql = f"(SELECT *, ({key} + {n} - p_x) % {n} AS p_y FROM {sql})"
        sql = f"(SELECT *, (greatest(p_x, p_y) % {P} * {c} + p_seed % {P} * {d} + {e}) % {P} AS p_h FROM {sql})"
        sql = f"(SELECT * EXCLUDE (p_x, p_y, p_h), CASE WHEN (p_h * p_h + {f}) % {P} % 2 = 1 THEN p_y ELSE p_x END AS p_x FROM {sql})"
    return f"(SELECT * EXCLUDE (p_x, p_seed), p_x AS {out} FROM {sql})"


_WEIGHT = f"[{', '.join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1]"
_BLOCK_OF = "CASE WHEN {0} < longer * (short + 1) THEN {0} // (short + 1) ELSE longer + ({0} - longer * (short + 1)) // short END"

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WS}')) AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
limited AS (SELECT *, CAST({_WEIGHT} AS BIGINT) AS weight, source_size * {CAP} AS lim FROM ranked),
levelled AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT)
    - CAST(coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM limited),
aimed AS (
  SELECT *, least(CAST(lim AS DOUBLE), coalesce(max(CASE WHEN lim > level * weight THEN level END) OVER () * weight, 0e0)) AS target
  FROM levelled),
cut AS (SELECT *, CAST(greatest(ceil(source_size / {BLOCK_WORDS}), least(source_size, {LEAST_BLOCKS})) AS BIGINT) AS blocks FROM aimed),
slotted AS (
  SELECT *, CASE WHEN blocks > 0 THEN source_size // blocks END AS short, CASE WHEN blocks > 0 THEN source_size % blocks END AS longer,
    CASE WHEN target > 0 AND source_size > 0 THEN greatest(CAST(floor(target * blocks / source_size + 0.5e0) AS BIGINT), 1) ELSE 0 END AS slots FROM cut),
targets AS (
  SELECT *, CAST(coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot,
    CAST(sum(slots) OVER () AS BIGINT) AS all_slots FROM slotted),
each AS (
  SELECT rank, blocks, all_slots, k // blocks AS pass, k % blocks AS r, first_slot + k AS u
  FROM (SELECT *, unnest(range(slots)) AS k FROM targets WHERE slots > 0)),
drawn AS (SELECT * FROM {_permuted('each', 'block', 'r', 'blocks', 'rank * 64 + pass + 1')}),
dealt AS (SELECT * FROM {_permuted('drawn', 'spot', 'u', 'all_slots', '0')}),
times AS (SELECT rank, block, count(*) AS times, min(spot // {SHARD_SLOTS}) AS first_shard FROM dealt GROUP BY rank, block),
placed AS (
  SELECT doc_id, size, rank, source_size, target, short, longer,
    CAST(sum(size) OVER (PARTITION BY rank ORDER BY doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
parts AS (
  SELECT *, least(start + size, (block + 1) * short + least(block + 1, longer)) - greatest(start, block * short + least(block, longer)) AS words
  FROM (SELECT *, unnest(range({_BLOCK_OF.format('start')}, {_BLOCK_OF.format('(start + size - 1)')} + 1)) AS block FROM placed WHERE size > 0)),
taking AS (
  SELECT doc_id, size, source_size, target, CAST(sum(coalesce(times, 0) * words) AS BIGINT) AS taken, min(first_shard) AS first_shard
  FROM parts LEFT JOIN times USING (rank, block) GROUP BY rank, start, doc_id, size, source_size, target)
SELECT * FROM taking UNION ALL SELECT doc_id, size, source_size, target, 0, NULL FROM placed WHERE size = 0
"""

# Unsigned CRC-32 of a decimal id, bit by bit; then paths, nodes and their subtrees by plain joins.
TRIE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT c, count(*) AS n, c - c % 20 AS donor,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], range(8 * length(CAST(c AS VARCHAR)))), lambda v, k:
      xor((CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), (k // 8 + 1)::INTEGER, 1))::BIGINT) ELSE v END) >> 1,
        3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), (k // 8 + 1)::INTEGER, 1))::BIGINT) ELSE v END) & 1))), 4294967295) % 4 AS h
  FROM t GROUP BY c),
v AS (SELECT s.*, least(s.h, coalesce(d.n, 0)) AS k FROM s LEFT JOIN s d ON d.c = s.donor),
p0 AS (
  SELECT v.c, t.i - v.h + v.k AS d, t.r, t.x FROM t JOIN v ON t.c = v.c WHERE t.i > v.h
  UNION ALL SELECT v.c, t.i, t.r, t.x FROM t JOIN v ON t.c = v.donor WHERE t.i <= v.k
  UNION ALL SELECT v.c, 0, NULL, NULL FROM v),
p AS (
  SELECT c, d, x, coalesce(string_agg(md5(strlen(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d), '') AS path,
    lag(d) OVER (PARTITION BY c ORDER BY d DESC) IS NULL AS last FROM p0),
n AS (
  SELECT path, d, min(c) AS c, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends,
    len(regexp_extract_all(coalesce(any_value(x), ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM p GROUP BY path, d),
kids AS (SELECT left(path, -32) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.path = n.path),
sums AS (
  SELECT p.path, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
  FROM w JOIN p ON p.c = w.c AND p.d <= w.d GROUP BY p.path)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, up.c AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sums ON sums.path = w.path LEFT JOIN n up ON w.d > 0 AND up.path = left(w.path, -32) AND up.d = w.d - 1
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
