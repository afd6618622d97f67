"""DuckDB fragments of the checking SQL, written from the definitions and apart from the Spark operators."""

from __future__ import annotations

from deucebase.functions import naming
from deucebase.functions.notation import BACKHAND, FOREHAND, LETTERS, STROKES
from deucebase.sources.adapter import CTES


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


VALID = "svr IN (1, 2) AND pt_winner IN (1, 2)"
BASE = "trim(regexp_replace(regexp_replace(replace(lower(trim(tournament)), '&', 'and'), '\\bmasters\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_TEAM = " OR ".join(f"contains(lower(tournament), '{t}')" for t in naming.TEAM)
TIER = f"""CASE WHEN {BASE} = '' THEN 'Other / Unknown' WHEN {BASE} IN ({strings(naming.SLAMS)}) THEN 'Grand Slam'
 WHEN {BASE} IN ({strings(naming.FINALS)}) OR lower(trim(tournament)) IN ({strings(naming.FINALS)}) THEN 'Tour Finals' WHEN {_TEAM} THEN 'Team / Other Event'
 WHEN contains(lower(tournament), 'masters') OR {BASE} IN ({strings(naming.ATP_1000)}) OR (gender = 'W' AND {BASE} IN ({strings(naming.WTA_1000)})) THEN 'Masters / WTA 1000'
 WHEN regexp_matches({BASE}, '[a-z]') THEN 'Tour (250/500)' ELSE 'Other / Unknown' END"""
CANON = "CASE WHEN regexp_replace(tournament, '(?i)\\s*masters$', '') IN ('Montreal', 'Toronto') THEN 'Canada' ELSE regexp_replace(tournament, '(?i)\\s*masters$', '') END"
_TOK = "CASE {0} WHEN '0' THEN 0 WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 WHEN 'AD' THEN 4 END"
_A, _B = "split_part(pts, '-', 1)", "split_part(pts, '-', 2)"
_DONE = f"coalesce({_TOK.format(_A)} + {_TOK.format(_B)}, try_cast({_A} AS INT) + try_cast({_B} AS INT))"
SIDE = f"CASE WHEN len(string_split(pts, '-')) <> 2 OR {_DONE} IS NULL THEN 'na' WHEN {_DONE} % 2 = 0 THEN 'deuce' ELSE 'ad' END"
PRESSURE = f"""CASE WHEN NOT contains(pts, '-') THEN 'na' WHEN {_TOK.format(_A)} IS NULL OR {_TOK.format(_B)} IS NULL OR (gm1 >= 6 AND gm2 >= 6) THEN 'tiebreak'
 WHEN pts IN ('0-40', '15-40', '30-40', '40-AD') THEN 'break_pt' WHEN pts IN ('40-0', '40-15', '40-30', 'AD-40') THEN 'game_pt' WHEN pts = '40-40' THEN 'deuce' ELSE 'normal' END"""

PLAYERS = f"""{CTES}, pv AS (
 SELECT *, player1 AS player, 1 AS slot, svr = 1 AS serving, (pt_winner = 1)::INT AS won FROM points WHERE {VALID}
 UNION ALL SELECT *, player2, 2, svr = 2, (pt_winner = 2)::INT FROM points WHERE {VALID})"""

_L = LETTERS
DECODED = f"""{CTES}, d1 AS (
 SELECT *, CASE WHEN trim(coalesce(second_serve, '')) <> '' THEN 2 ELSE 1 END AS serve_in_play,
        CASE WHEN trim(coalesce(second_serve, '')) <> '' THEN trim(second_serve) ELSE trim(coalesce(first_serve, '')) END AS raw,
        CASE WHEN svr IN (1, 2) THEN svr ELSE 1 END AS server FROM points),
d2 AS (SELECT *, regexp_replace(raw, '^[^0-9]*', '') AS rest FROM d1),
d3 AS (SELECT *, regexp_extract(rest, '^[4560]') AS dir, substr(rest, length(regexp_extract(rest, '^[4560]')) + 1) AS body FROM d2),
d4 AS (SELECT *, regexp_extract_all(body, '[{_L}][^{_L}]*') AS strokes, regexp_extract(body, '^[^{_L}]*') AS head, dir <> '' AS has FROM d3),
d5 AS (SELECT *, len(strokes) + has::INT AS rally_len, CASE WHEN len(strokes) > 0 THEN substr(strokes[-1], 1, 1) ELSE '' END AS letter,
              CASE WHEN len(strokes) > 0 THEN substr(strokes[-1], 2) WHEN has THEN head END AS tail, len(strokes) = 0 AND has AS on_serve FROM d4),
d6 AS (SELECT *, nullif(regexp_extract(tail, '^.*([*#@])', 1), '') AS terminal, nullif(regexp_extract(tail, '^.*([ndwx])', 1), '') AS err,
              CASE WHEN rally_len = 0 THEN NULL WHEN on_serve THEN server WHEN len(strokes) % 2 = 1 THEN 3 - server ELSE server END AS last_hitter FROM d5),
d7 AS (SELECT *, CASE WHEN terminal = '*' AND on_serve THEN 'ace' WHEN terminal = '*' THEN 'winner' WHEN terminal = '#' THEN 'forced_error' WHEN terminal = '@' THEN 'unforced_error'
                      WHEN on_serve AND err IS NOT NULL AND serve_in_play = 2 THEN 'double_fault' WHEN on_serve AND err IS NOT NULL THEN 'fault_unfinished' ELSE 'unknown' END AS outcome FROM d6),
decoded AS (SELECT * REPLACE (server::INT AS server), CASE WHEN outcome IN ('ace', 'winner') THEN last_hitter WHEN outcome IN ('forced_error', 'unforced_error') THEN 3 - last_hitter WHEN outcome = 'double_fault' THEN 3 - server END AS winner_by_notation,
                   pt_winner = server AS server_won, outcome <> 'unknown' AND has AS parse_ok FROM d7)"""

_SIDE_OF = f"CASE WHEN letter IN ({strings(FOREHAND)}) THEN 'FH' WHEN letter IN ({strings(BACKHAND)}) THEN 'BH' ELSE '' END"
NAME_OF = "CASE letter " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STROKES.items()) + " ELSE 'unknown_shot' END"
KIND_OF = "CASE WHEN {serve} THEN 'serve' WHEN letter IN ('f', 'b') THEN 'drive' WHEN letter IN ('r', 's') THEN 'slice' WHEN letter IN ('v', 'z', 'o', 'p', 'u', 'y') THEN 'net' ELSE 'other' END"
SIDE_OF = _SIDE_OF
SHOTS = f"""{DECODED}, s1 AS (
 SELECT match_id, pt, gender, player1, player2, date, year, pts, server, server_won, serve_in_play, parse_ok, rally_len, 1 AS idx, server AS hitter, true AS is_serve, '' AS letter, head AS tail, dir AS dir0 FROM decoded WHERE has
 UNION ALL SELECT match_id, pt, gender, player1, player2, date, year, pts, server, server_won, serve_in_play, parse_ok, rally_len, j + has::INT, CASE WHEN j % 2 = 1 THEN 3 - server ELSE server END, false, substr(strokes[j], 1, 1), substr(strokes[j], 2), NULL
 FROM (SELECT *, unnest(range(1, len(strokes) + 1)) AS j FROM decoded)),
shots AS (SELECT *, {_SIDE_OF} AS side, coalesce(nullif(regexp_extract(tail, '^.*([123])', 1), ''), dir0) AS direction, nullif(regexp_extract(tail, '^.*([789])', 1), '') AS depth,
 nullif(regexp_extract(tail, '^.*([ndwx])', 1), '') AS error_loc, nullif(regexp_extract(tail, '^.*([*#@])', 1), '') AS terminal,
 lead(nullif(regexp_extract(tail, '^.*([*#@])', 1), '')) OVER w AS next_terminal, CASE WHEN hitter = 1 THEN player1 ELSE player2 END AS player FROM s1 WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx))"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text: a fold over its bytes, eight bit steps each (the engine has no such function)."""
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"


def binom_tail(k: str, n: str, p: str) -> str:
    """P(X >= k), every term."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    return f"CASE WHEN {k} <= 0 THEN 1.0 WHEN {p} <= 0 THEN 0.0 WHEN {p} >= 1 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(({k})::BIGINT, ({n})::BIGINT + 1), lambda i: {term}))) END"


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact test: all tables no likelier than the given one."""
    prob = f"exp(lgamma({a} + {b} + 1) - lgamma(x + 1) - lgamma({a} + {b} - x + 1) + lgamma({c} + {d} + 1) - lgamma({a} + {c} - x + 1) - lgamma({d} - {a} + x + 1) - lgamma({a} + {b} + {c} + {d} + 1) + lgamma({a} + {c} + 1) + lgamma({b} + {d} + 1))"
    own = prob.replace("(x +", f"({a} +").replace("- x +", f"- {a} +").replace("+ x +", f"+ {a} +")
    terms = f"list_transform(range(greatest(0, {a} - {d})::BIGINT, least({a} + {b}, {a} + {c})::BIGINT + 1), lambda x: CASE WHEN {prob} <= {own} * (1 + 1e-9) THEN {prob} ELSE 0 END)"
    return f"least(1.0, list_sum({terms}))"


def bh(table: str, p: str, family: str, tie: str, name: str = "q") -> str:
    """``table`` with Benjamini-Hochberg values."""
    return f"(SELECT * EXCLUDE (_r, _m), least(1.0, min({p} * _m / _r) OVER (PARTITION BY {family} ORDER BY _r DESC ROWS UNBOUNDED PRECEDING)) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY {p}, {tie}) AS _r, count(*) OVER (PARTITION BY {family}) AS _m FROM {table}))"
