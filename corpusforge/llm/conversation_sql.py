"""DuckDB SQL for ``op11_conversation_repair``: the least repair by stepping the best (cost, audit, lines) of each state
of the structure through a conversation's rows."""

from __future__ import annotations

FAR = 1_000_000_000


def _step(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': CAST({state}.c + {cost} AS BIGINT), 'a': {state}.a || {letter}, 't': {state}.t || {line}}}"


def _taken(state: str, initial: str, role: str) -> str:
    """The row kept, or given the role that the structure asks for."""
    return _step(state, f"pay + CAST(initial <> '{initial}' AS BIGINT)", f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END",
                 f"chr(10) || CASE WHEN initial = '{initial}' THEN role ELSE '{role}' END || ':' || text")


def _inserted(state: str, role: str) -> str:
    return _step(state, "5", "'I'", f"chr(10) || '{role}:'")


_DELETED = {s: _step(s, "2", "'D'") for s in ("s0", "s1", "s2", "s3")}
_SYSTEM = _step("s0", f"CASE WHEN initial = 's' THEN pay ELSE {FAR} END", "'K'", "chr(10) || role || ':' || text")

ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list_reduce([CAST(i AS UBIGINT)] || list_transform(range(0, 8), lambda x: CAST(x AS UBIGINT)),
                     lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END) AS entry, i
  FROM range(0, 256) AS r(i)),
crc AS (
  SELECT list(entry ORDER BY i) AS entries FROM bits),
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(
               regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
               lambda h: CAST('0x' || h AS UBIGINT)),
             lambda a, b: xor(a >> 8, entries[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS harm
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged),
marked AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, i,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed),
paid AS (
  SELECT *, CAST(CASE fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 5 ELSE {FAR} END AS BIGINT) AS pay,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM marked),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM paid GROUP BY conv_id),
search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {{'c': CAST({FAR} AS BIGINT), 'a': '', 't': ''}} AS s1,
         {{'c': CAST(5 AS BIGINT), 'a': 'I', 't': chr(10) || 'user:'}} AS s2,
         {{'c': CAST(10 AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, least(s3, {_inserted('s2', 'assistant')}) AS s3
  FROM (
    SELECT conv_id, i, s0, s1, least(s2, {_inserted('least(s0, s1, s3)', 'user')}) AS s2, s3
    FROM (
      SELECT s.conv_id, p.i, {_DELETED['s0']} AS s0, least({_DELETED['s1']}, {_SYSTEM}) AS s1,
             least({_DELETED['s2']}, {_taken('s0', 'u', 'user')}, {_taken('s1', 'u', 'user')}, {_taken('s3', 'u', 'user')}) AS s2,
             least({_DELETED['s3']}, {_taken('s2', 'a', 'assistant')}) AS s3
      FROM search s JOIN paid p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.i + 1)))
SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, least(s0, s3).c AS cost, least(s0, s3).a AS audit,
       sha256(substr(least(s0, s3).t, 2)) AS repaired_sha256
FROM search s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id
WHERE s.i = coalesce(c.n, 0)
"""
