"""SQL of the operators whose rows SQL can state in full."""

from __future__ import annotations

# crc32 of an ASCII expression, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda crc, code: list_reduce(list_prepend(xor(crc, code), range(8)), "
    "lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)


def _stated(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


_HEAD = " || ".join(_stated(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP13_SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
      sha256({_HEAD} || {_stated("text")}) AS leaf,
      CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_HEAD} || {_stated("replace(text, chr(10), '')")})
           ELSE sha256({_HEAD} || {_stated("text")}) END AS given
    FROM documents)
), up(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM leaf
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 3, n
), subs AS MATERIALIZED (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n
), low_path AS (
  SELECT tree, place, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM (
    SELECT a.tree, a.pos AS place, u.level,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < a.pos // pow(3, u.level)::BIGINT), '') AS l,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > a.pos // pow(3, u.level)::BIGINT), '') AS r
    FROM leaf a JOIN up u ON a.tree = u.tree AND u.n > 1 AND u.pos // 3 = (a.pos // pow(3, u.level)::BIGINT) // 3 GROUP BY ALL)
  GROUP BY ALL
), top_path AS (
  SELECT tree, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM (
    SELECT a.tree, u.level,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < a.pos // pow(3, u.level)::BIGINT), '') AS l,
      coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > a.pos // pow(3, u.level)::BIGINT), '') AS r
    FROM subs a JOIN top u ON u.n > 1 AND u.pos // 3 = (a.pos // pow(3, u.level)::BIGINT) // 3 GROUP BY ALL)
  GROUP BY ALL
), proofs AS (
  SELECT leaf.doc_id, leaf.leaf, subs.subroot, (SELECT h FROM top WHERE n = 1) AS root, leaf.given,
    list_concat(coalesce(low_path.path, []), coalesce(top_path.path, [])) AS path
  FROM leaf JOIN subs USING (tree) LEFT JOIN low_path ON leaf.tree = low_path.tree AND leaf.pos = low_path.place LEFT JOIN top_path ON leaf.tree = top_path.tree
), folds AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': given, 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root
  FROM proofs
)
SELECT *, folded_root = root AS verified FROM folds
"""


# Conversations: the states of the wanted pattern are carried row by row as (cost, audit, repaired lines).

def _move(state: str, cost: str, letter: str, line: str, when: str = "TRUE") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}} END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_USER, _ANSWER, _BOTH = "'user:' || chr(10)", "'assistant:' || chr(10)", "'user:' || chr(10) || 'assistant:' || chr(10)"
_TO_ANSWER = ["s3", _move("s2", "5", "I", _ANSWER), _move("s0", "10", "II", _BOTH), _move("s1", "10", "II", _BOTH)]
_TO_USER = ["s2", *[_move(s, "5", "I", _USER) for s in ("s0", "s1", "s3")]]


def _kept(state: str, initial: str) -> str:
    return _move(state, "extra", "K", "role || ':' || text || chr(10)", f"stays AND initial = '{initial}'")


def _changed(state: str, role: str) -> str:
    return _move(state, "extra + 1", "R", f"'{role}:' || text || chr(10)", "stays")


def _deleted(state: str) -> str:
    return _move(state, "2", "D", "''")


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

OP12_SQL = f"""
WITH RECURSIVE marked AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS rid,
    {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, rid, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS pos, left(role, 1) AS initial, rtrim(text, {_SPACES}) AS bare
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), item AS MATERIALIZED (
  SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM item GROUP BY conv_id
), walk(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'r': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR),
    NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) FROM counts
  UNION ALL
  SELECT conv_id, pos, {_deleted("s0")}, {_least(_deleted("s1"), _kept("s0", "s"))},
    {_least(_deleted("e2"), *[_kept(s, "u") for s in ("s0", "s1", "e3")], *[_changed(s, "user") for s in ("s0", "s1", "e3")])},
    {_least(_deleted("e3"), _kept("e2", "a"), _changed("e2", "assistant"))}
  FROM (SELECT item.*, s0, s1, {_least(*_TO_USER)} AS e2, {_least(*_TO_ANSWER)} AS e3
    FROM walk JOIN item ON walk.conv_id IS NOT DISTINCT FROM item.conv_id AND item.pos = walk.pos + 1)
), ends AS (
  SELECT counts.*, {_least("s0", *_TO_ANSWER)} AS best FROM walk JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND walk.pos = counts.n
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(CASE WHEN coalesce(best.r, '') = '' THEN '' ELSE left(best.r, length(best.r) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
