"""SQL of the conversation query: damage, faults, and the best ways row by row."""

from __future__ import annotations

# CRC-32 of a list of bytes, by the table of its 256 remainders.
CRC_TABLE = """crc_table AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs
            FROM (SELECT unnest(range(256)) AS i))"""


def crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, k: xor(c >> 8, crcs[1 + (xor(c, k) & 255)])), 4294967295)"


def _went(way: str, cost: str, letter: str, line: str | None = None) -> str:
    """A way to a state, lengthened by an edit: its cost, letters and repaired lines."""
    lines = f"{way}.t" if line is None else f"CASE WHEN {way}.t = '' THEN {line} ELSE {way}.t || chr(10) || {line} END"
    return f"{{'c': {way}.c + {cost}, 'l': {way}.l || '{letter}', 't': {lines}}}"


_NO_WAY = "{'c': 1000000000::BIGINT, 'l': '', 't': ''}"
_OWN_LINE = "role || ':' || text"


def _taken(way: str, role: str) -> str:
    kept, changed = _went(way, "fine", "K", _OWN_LINE), _went(way, "fine + 1", "R", f"'{role}:' || text")
    return f"CASE WHEN must_go THEN {_NO_WAY} WHEN initial = '{role[0]}' THEN {kept} ELSE {changed} END"


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _inserted(source: str) -> str:
    """The four states with insertions, from those without."""
    user = _best("u", _went("e", "5", "I", "'user:'"), _went("s", "5", "I", "'user:'"))
    return f"""SELECT * REPLACE ({_best("u", _went("a", "5", "I", "'user:'"))} AS u)
            FROM (SELECT * REPLACE ({_best("a", _went("u", "5", "I", "'assistant:'"))} AS a)
            FROM (SELECT * REPLACE ({user} AS u) FROM ({source})))"""


_START = f"""SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'l': '', 't': ''}} AS e, {_NO_WAY} AS s, {_NO_WAY} AS u, {_NO_WAY} AS a
            FROM (SELECT DISTINCT conv_id FROM given)"""
_SYSTEM = f"CASE WHEN must_go OR initial <> 's' THEN {_NO_WAY} ELSE {_went('e', 'fine', 'K', _OWN_LINE)} END"
_STEP = f"""SELECT ways.conv_id, rows.pos, {_went("e", "2", "D")} AS e, {_best(_went("s", "2", "D"), _SYSTEM)} AS s,
                {_best(_went("u", "2", "D"), _taken("e", "user"), _taken("s", "user"), _taken("a", "user"))} AS u,
                {_best(_went("a", "2", "D"), _taken("u", "assistant"))} AS a
            FROM ways JOIN rows ON rows.conv_id IS NOT DISTINCT FROM ways.conv_id AND rows.pos = ways.pos + 1"""

REPAIR = f"""
        WITH RECURSIVE {CRC_TABLE},
        given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
            FROM conversations),
        faulty AS (
            SELECT given.*, {crc("list_transform(string_split(place, ''), lambda x: ord(x)::BIGINT)")} % 20 AS fault FROM given, crc_table),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
            FROM faulty WHERE fault <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
            FROM damaged),
        looked AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                   right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial
            FROM placed),
        named AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind
            FROM looked),
        rows AS (
            SELECT *, kind IN ('blank', 'duplicate') AS must_go, CASE WHEN kind = 'truncated' THEN 5 ELSE 0 END AS fine,
                   coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS bad
            FROM named),
        ways AS (
            {_inserted(_START)}
            UNION ALL
            {_inserted(_STEP)}),
        ends AS (
            SELECT conv_id, list_min([e, a]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS r FROM ways) WHERE r = 1),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
                   count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
            FROM rows GROUP BY conv_id)
        SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.l AS audit, sha256(best.t) AS repaired_sha256
        FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id"""
