"""DuckDB SQL of the queries on conversations and embeddings."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII expression, bit by bit."""
    bit = "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, "text") AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY u.own, u.place) AS place, u.role, u.body
  FROM c JOIN (SELECT *, 0 AS own FROM t UNION ALL SELECT *, 1 FROM t) u
    ON CASE u.own WHEN 0 THEN u.conv_id = c.base AND u.place <= c.h ELSE u.conv_id = c.conv_id AND u.place > c.h END
), p AS (
  SELECT conv_id, place AS depth, list(md5(role || chr(1) || body)) OVER (PARTITION BY conv_id ORDER BY place) AS k, strlen(body) AS bytes,
         place = max(place) OVER (PARTITION BY conv_id) AS ends
  FROM r
  UNION ALL
  SELECT conv_id, 0, []::VARCHAR[], 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c
), n AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256, count(*) FILTER (ends) = count(*) AS leaf
  FROM p GROUP BY k, depth
), s AS (
  SELECT k[1:d] AS k, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT k, leaf, saved, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY ALL
), b AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN b ON b.k = n.k LEFT JOIN n o ON n.depth > 0 AND o.k = n.k[1:n.depth - 1]
"""


def _way(rest: str, cost: str, edit: str) -> str:
    """A way is nine digits of cost and the edits, so that the least text is the cheapest way, then the least in letters."""
    return f"lpad((substr({rest}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({rest}, 10)"


def _row(state: int, keeps: dict[str, int], behind: int) -> str:
    keep = "CASE " + " ".join(f"WHEN lower(x) = '{role}' THEN {_way(f'e{to}', 'm', 'K')}" for role, to in keeps.items()) + " END"
    return f"least({_way(f'e{state}', '4', 'D')}, {keep}, CASE WHEN x <> 'x' THEN {_way(f'e{behind}', 'm + 3', 'R')} END) AS r{state}"


OP13 = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS body,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv_id, turn, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, body ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         rtrim(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, lag(role[1:1]) OVER w || role[1:1] AS pair
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, copy)
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), q AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(letter) ELSE letter END AS x
  FROM (SELECT *, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS letter FROM f)
), e AS (
  SELECT conv_id, max(place) AS place, '000000000' AS e0, '000000006II' AS e1, '000000003I' AS e2, '000000000' AS e3 FROM q GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place - 1, least(r0, {_way("r2", "3", "I")}, {_way("r3", "6", "II")}), least(r1, {_way("r2", "3", "I")}, {_way("r3", "6", "II")}),
         least(r2, {_way("r3", "3", "I")}), least(r3, {_way("r2", "3", "I")})
  FROM (
    SELECT e.conv_id, e.place, {_row(0, {"s": 1, "u": 2}, 2)}, {_row(1, {"u": 2}, 2)}, {_row(2, {"a": 3}, 3)}, {_row(3, {"u": 2}, 2)}
    FROM e JOIN (SELECT conv_id, place, x, CASE WHEN x = lower(x) THEN 0 ELSE 3 END AS m FROM q) q ON q.conv_id IS NOT DISTINCT FROM e.conv_id AND q.place = e.place
  )
), a AS (SELECT conv_id, substr(e0, 1, 9)::BIGINT AS cost, substr(e0, 10) AS audit FROM e WHERE place = 0
), c AS (
  SELECT conv_id, i, audit[i:i] AS edit, length(regexp_replace(audit[1:i], 'I', '', 'g')) AS place, length(regexp_replace(audit[1:i - 1], 'D', '', 'g')) AS made
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM a)
), l AS (
  SELECT c.conv_id, c.i, c.edit, c.made, q.role, coalesce(CASE WHEN c.edit <> 'I' THEN q.body END, '') AS body,
         max(c.made = 0 AND c.edit = 'K' AND q.letter = 's') OVER (PARTITION BY c.conv_id) AS system
  FROM c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id AND q.place = c.place WHERE c.edit <> 'D'
), t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - system::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || body, chr(10) ORDER BY i) AS repaired
  FROM l GROUP BY conv_id
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM q GROUP BY conv_id
)
SELECT i.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
       coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""

OP12 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS vec,
         coalesce(len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0, false) AS fine
  FROM embeddings
), u AS (
  SELECT r, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM v WHERE fine AND label IS NOT NULL
), e AS (
  SELECT a.r, b.r AS s FROM u a JOIN u b ON b.label = a.label AND len(b.vec) = len(a.vec) AND b.r <> a.r WHERE list_dot_product(a.vec, b.vec) >= 0.98
), c AS (
  SELECT r, r AS s FROM v UNION SELECT c.r, e.s FROM c JOIN e ON e.r = c.s
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id IS NOT DISTINCT FROM m.component_id AS kept
FROM v LEFT JOIN (SELECT r, count(*) AS n FROM e GROUP BY r) n ON n.r = v.r
JOIN (SELECT c.r, min(w.vec_id) AS component_id FROM c JOIN v w ON w.r = c.s GROUP BY c.r) m ON m.r = v.r
"""
