"""DuckDB SQL for the conversation queries."""

#: CRC-32 of an ASCII text, bit by bit
CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), "
       "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))")
#: rows of equal turn stand by this
DIGEST = "sha256(concat_ws(':', strlen({role}), {role}, {text}))"

TRIE = f"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, id, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS place
  FROM (SELECT *, {DIGEST.format(role='role', text='text')} AS id FROM named)),
convs AS (SELECT conv_id, {CRC.format(text='conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM named)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, place, id, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place < c.h
  UNION ALL
  SELECT c.conv_id, 1 AS part, place, id, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
paths AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path,
         coalesce(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lengths AS (SELECT c.conv_id, coalesce(max(depth), 0) AS n FROM convs c LEFT JOIN paths p USING (conv_id) GROUP BY c.conv_id),
members AS (
  SELECT conv_id, depth, path, parent, size, depth = n AS ended FROM paths JOIN lengths USING (conv_id)
  UNION ALL SELECT conv_id, 0, '', NULL, 0, n = 0 FROM lengths),
nodes AS (
  SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY path),
families AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN families USING (path)),
below AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM full_nodes a JOIN full_nodes b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN below USING (path) LEFT JOIN nodes p ON p.path = a.parent
"""


def _moved(state: str, cost: str, letter: str, added: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {added}}}"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_NEVER = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}"


def _into(role: str, initial: str, states: tuple[str, ...]) -> list[str]:
    """Rows kept, if they have the initial, or given the role, from these states."""
    out = []
    for state in states:
        out.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_moved(state, 'extra', 'K', 'shown')} ELSE {_NEVER} END")
        if role:
            out.append(f"CASE WHEN NOT gone THEN {_moved(state, '3 + extra', 'R', role + ' || text')} ELSE {_NEVER} END")
    return out


REPAIR = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS lot_of FROM conversations),
lots AS (SELECT lot_of, {CRC.format(text='lot_of')} % 20 AS lot FROM (SELECT DISTINCT lot_of FROM named)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN translate(text, '.!?', '') ELSE text END AS text, lot
  FROM named JOIN lots USING (lot_of) WHERE lot != 0),
twice AS (SELECT conv_id, turn, role, text FROM damaged UNION ALL SELECT conv_id, turn, role, text FROM damaged WHERE lot = 3),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {DIGEST.format(role='role', text='text')}) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial FROM twice),
told AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN min(i) OVER (PARTITION BY conv_id, role, text) < i THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
steps AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS name, i, initial, fault IN ('blank', 'duplicate') AS gone,
         CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra, chr(10) || role || ':' || text AS shown, text FROM told),
walk AS (
  SELECT DISTINCT name, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS e, {_NEVER} AS s,
         {{'c': 3::BIGINT, 'a': 'I', 'r': {_USER}}} AS u, {{'c': 6::BIGINT, 'a': 'II', 'r': {_USER} || {_ASSISTANT}}} AS p FROM steps
  UNION ALL
  SELECT name, i, e, s, u, {_least('p', _moved('u', '3', 'I', _ASSISTANT))} AS p FROM (
    SELECT name, i, e, s, {_least('u', *[_moved(x, '3', 'I', _USER) for x in 'esp'])} AS u, p FROM (
      SELECT walk.name, i, {_moved('e', '4', 'D')} AS e,
             {_least(_moved('s', '4', 'D'), *_into('', 's', ('e',)))} AS s,
             {_least(_moved('u', '4', 'D'), *_into(_USER, 'u', ('e', 's', 'p')))} AS u,
             {_least(_moved('p', '4', 'D'), *_into(_ASSISTANT, 'a', ('u',)))} AS p
      FROM walk JOIN steps ON steps.name = walk.name AND steps.i = walk.k + 1))),
ends AS (SELECT name, {_least('e', 'p')} AS won FROM walk QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1),
counts AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS name, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY ALL)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(won.c, 0) AS BIGINT) AS cost,
       coalesce(won.a, '') AS audit, sha256(coalesce(substr(won.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS name FROM conversations) LEFT JOIN counts USING (name) LEFT JOIN ends USING (name)
"""
