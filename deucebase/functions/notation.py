"""The shot-notation decoder as Column expressions: no Python worker is involved.

A serve string is a lead that is skipped, a serve direction, then strokes: a letter and its descriptors. The decoder
cuts the strokes with one regular expression and reads each descriptor with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the notation.
FOREHAND = {"f": "forehand", "r": "forehand_slice", "v": "forehand_volley", "o": "overhead", "u": "forehand_halfvolley", "l": "forehand_lob", "h": "forehand_swinging_volley", "j": "forehand_dropshot"}
BACKHAND = {"b": "backhand", "s": "backhand_slice", "z": "backhand_volley", "p": "backhand_overhead", "y": "backhand_halfvolley", "m": "backhand_lob", "i": "backhand_swinging_volley", "k": "backhand_dropshot"}
OTHER = {"t": "trick", "q": "unknown_shot"}
KINDS = {"drive": "fb", "slice": "rs", "net": "vzopuy"}

STROKES = FOREHAND | BACKHAND | OTHER
LETTERS = "".join(STROKES)


def other_player(player: Column) -> Column:
    return F.when(player == 1, 2).otherwise(1)


def stroke_kind(letter: Column, is_serve: Column) -> Column:
    c = F.when(is_serve, "serve")
    for kind, letters in KINDS.items():
        c = c.when(letter.isin(*letters), kind)
    return c.otherwise("other")


def wing(letter: Column) -> Column:
    return F.when(letter.isin(*FOREHAND), "FH").when(letter.isin(*BACKHAND), "BH").otherwise("")


def stroke_name(letter: Column) -> Column:
    c = F.when(letter == "", "serve")
    for k, name in STROKES.items():
        c = c.when(letter == k, name)
    return c.otherwise("unknown_shot")


def _last(tail: Column, chars: str) -> Column:
    """The last of ``chars`` in ``tail``, null if there is none: descriptors are overwritten by later ones."""
    return F.nullif(F.regexp_extract(tail, f"^.*([{chars}])", 1), F.lit(""))


def _shot(idx: Column, hitter: Column, is_serve: bool, letter: Column, tail: Column, direction: Column) -> Column:
    return F.struct(
        idx.cast("int").alias("idx"), hitter.cast("int").alias("hitter"), F.lit(is_serve).alias("is_serve"), letter.alias("letter"), wing(letter).alias("side"), stroke_name(letter).alias("stroke"),
        direction.alias("direction"), _last(tail, "789").alias("depth"), F.regexp_replace(tail, r"[^+=^\-]", "").alias("modifiers"), _last(tail, "ndwx").alias("error_loc"), _last(tail, "*#@").alias("terminal"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parsed(raw: Column, server: Column, serve_in_play: Column, winner: Column) -> Column:
    """Struct of all that a point's string tells. Every step is bound to a name: the expression stays linear in size
    wherever the optimizer copies it."""
    returner = other_player(server)

    def cut(rest: Column) -> Column:
        return F.struct(F.regexp_extract(rest, "^[4560]", 0).alias("dir"), F.regexp_replace(rest, "^[4560]", "").alias("body"))

    def shots(c: Column) -> Column:
        has, lead = c["dir"] != "", (c["dir"] != "").cast("int")
        head = F.regexp_extract(c["body"], f"^[^{LETTERS}]*", 0)
        serve = F.array(_shot(F.lit(1), server, True, F.lit(""), head, F.coalesce(_last(head, "123"), c["dir"])))

        def stroke(s: Column, j: Column) -> Column:
            return _let(F.substring(s, 2, 1 << 20), lambda tail: _shot(j + 1 + lead, F.when(j % 2 == 0, returner).otherwise(server), False, F.substring(s, 1, 1), tail, _last(tail, "123")))

        strokes = F.transform(F.regexp_extract_all(c["body"], F.lit(f"[{LETTERS}][^{LETTERS}]*"), F.lit(0)), stroke)
        return F.struct(has.alias("has"), F.concat(F.when(has, serve).otherwise(F.slice(serve, 1, 0)), strokes).alias("shots"))

    def ended(x: Column) -> Column:
        return F.struct(x["has"].alias("has"), x["shots"].alias("shots"), F.try_element_at(x["shots"], F.lit(-1)).alias("last"))

    def outcome(x: Column) -> Column:
        last = x["last"]
        t, missed = last["terminal"], last["is_serve"] & last["error_loc"].isNotNull()
        how = (
            F.when(t == "*", F.when(last["is_serve"], "ace").otherwise("winner")).when(t == "#", "forced_error").when(t == "@", "unforced_error")
            .when(missed & (serve_in_play == 2), "double_fault").when(missed, "fault_unfinished").otherwise("unknown")
        )
        return F.struct(x["has"].alias("has"), x["shots"].alias("shots"), last.alias("last"), how.alias("outcome"))

    def won(x: Column) -> Column:
        hitter = x["last"]["hitter"]
        by = F.when(x["outcome"].isin("ace", "winner"), hitter).when(x["outcome"].isin("forced_error", "unforced_error"), other_player(hitter)).when(x["outcome"] == "double_fault", returner)
        return F.struct(x["has"].alias("has"), x["shots"].alias("shots"), x["last"].alias("last"), x["outcome"].alias("outcome"), by.cast("int").alias("by"))

    def fields(x: Column) -> Column:
        last, none = x["last"], x["last"].isNull()
        server_won = F.when(winner.isin(1, 2), winner == server).when(x["by"].isNotNull(), x["by"] == server)
        return F.struct(
            x["shots"].alias("shots"), F.size(x["shots"]).alias("rally_len"), last["hitter"].alias("last_hitter"), F.coalesce(last["side"], F.lit("")).alias("ending_side"), F.coalesce(last["stroke"], F.lit("")).alias("ending_stroke"),
            F.when(none, "").otherwise(stroke_kind(last["letter"], last["is_serve"])).alias("ending_kind"), x["outcome"].alias("outcome"), x["by"].alias("winner_by_notation"), server_won.alias("server_won"),
            ((x["outcome"] != "unknown") & x["has"]).alias("parse_ok"), flags(x).alias("flags"),
        )

    def flags(x: Column) -> Column:
        """What was odd: skipped leads, strays before the first stroke, unknown descriptors, and what is missing at the end."""
        lead, body = F.regexp_extract(raw, "^[^0-9]*", 0), F.regexp_replace(raw, "^[^0-9]*", "")
        direct = body.rlike("^[4560]")
        rest = F.regexp_replace(body, "^[4560]", "")
        head = F.when(direct, "").otherwise(F.regexp_extract(rest, f"^[^{LETTERS}]*", 0))
        tail = F.when(direct, rest).otherwise(F.regexp_replace(rest, f"^[^{LETTERS}]*", ""))
        each = lambda s, name: F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.concat(F.lit(f"{name}:"), ch))
        unknown = F.regexp_replace(tail, rf"[{LETTERS}123789ndwx*#@+=^\-]", "")
        none = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        missed = x["outcome"] == "fault_unfinished"
        return F.when(raw == "", F.array(F.lit("empty"))).otherwise(F.concat(
            each(lead, "lead"), none(~direct, "no_serve_dir"), each(head, "stray"), each(unknown, "unk"), none(F.size(x["shots"]) == 0, "no_shots"), none(missed, "first_fault_no_second"),
            none((x["outcome"] == "unknown") & (F.size(x["shots"]) > 0), "no_terminal"), none(F.coalesce(winner.isin(1, 2) & (x["by"] != winner), F.lit(False)), "winner_mismatch"),
        ))

    steps = F.regexp_replace(raw, "^[^0-9]*", "")
    for step in (cut, shots, ended, outcome, won, fields):
        steps = _let(steps, step)
    return steps


def decoded(points: DataFrame, first: str = "first_serve", second: str = "second_serve", svr: str = "svr", winner: str = "pt_winner") -> DataFrame:
    """``points`` with raw, serve_in_play, server, shots, rally_len, last_hitter, ending_*, outcome, winner_by_notation,
    server_won, flags and parse_ok. A non-empty second serve is the one that is decoded; the charted winner decides who
    won. Points that are decoded already come back as they are."""
    if "shots" in points.columns:
        return points
    ss, fs = F.trim(F.coalesce(F.col(second), F.lit(""))), F.trim(F.coalesce(F.col(first), F.lit("")))
    d = points.withColumn("serve_in_play", F.when(ss != "", 2).otherwise(1)).withColumn("raw", F.when(ss != "", ss).otherwise(fs))
    d = d.withColumn("server", F.when(F.col(svr).isin(1, 2), F.col(svr)).otherwise(1).cast("int"))
    # A generator of one row: filters and projections above it use its output and do not run the decoder again.
    return d.select("*", F.inline(F.array(_parsed(F.col("raw"), F.col("server"), F.col("serve_in_play"), F.col(winner)))))


FEATURES = ["match_id", "pt", "server", "serve_in_play", "rally_len", "last_hitter", "ending_side", "ending_stroke", "ending_kind", "outcome", "winner_by_notation", "server_won", "parse_ok"]


def point_features(points: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One flat row per point; unused parts of the decoder are pruned."""
    return decoded(points).select(*FEATURES, *extra)


def shot_table(points: DataFrame, keep: tuple[str, ...] = ("match_id", "pt", "gender", "player1", "player2", "server", "server_won", "serve_in_play", "parse_ok", "rally_len")) -> DataFrame:
    """One row per stroke, with the next and previous ones' facts read from the array: no window, no shuffle."""
    d = decoded(points).select(*keep, "shots")

    def linked(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            prev = F.get(x, i - 1)
            return F.struct(s.alias("shot"), F.get(x, i + 1)["terminal"].alias("next_terminal"), prev["letter"].alias("prev_letter"), prev["direction"].alias("prev_direction"), prev["depth"].alias("prev_depth"), prev["is_serve"].alias("prev_is_serve"))

        return F.transform(x, one)

    d = d.select(*keep, F.explode(_let(F.col("shots"), linked)).alias("x"))
    return d.select(*keep, "x.shot.*", "x.next_terminal", "x.prev_letter", "x.prev_direction", "x.prev_depth", "x.prev_is_serve")


def aggressive(shots: DataFrame) -> DataFrame:
    """is_winner, own_unforced, induced_forced per stroke: a forced error is credited to the stroke before it."""
    return shots.withColumn("is_winner", F.coalesce(F.col("terminal") == "*", F.lit(False))).withColumn("own_unforced", F.coalesce(F.col("terminal") == "@", F.lit(False))).withColumn("induced_forced", F.coalesce(F.col("next_terminal") == "#", F.lit(False)))


def serve_dir(s: Column) -> Column:
    """Direction of a serve string without decoding it: 4/5/6, "0", or "" if a stroke comes first."""
    return F.regexp_extract(F.coalesce(s, F.lit("")), f"^[^{LETTERS}4560]*([4560])", 1)


def first_serve_dir(s: Column) -> Column:
    """4/5/6, scanning past 0; "?" if there is none."""
    d = F.regexp_extract(F.coalesce(s, F.lit("")), f"^[^{LETTERS}456]*([456])", 1)
    return F.when(d == "", "?").otherwise(d)


# Parts of a stroke's word.
SERVE_WORDS = {"4": "W", "5": "B", "6": "T"}
KIND_WORDS = {"drive": "d", "slice": "s", "net": "v", "other": "o"}


def _mapped(c: Column, words: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in words.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def shot_token(shot: Column, mirror: Column) -> Column:
    """One word per stroke: sv and the serve's target, or wing, kind and direction, the thirds turned if ``mirror``."""
    direction = F.coalesce(shot["direction"], F.lit("·"))
    seen = F.when(mirror, F.translate(direction, "13", "31")).otherwise(direction)
    side = _mapped(shot["side"], {"FH": "F", "BH": "B"}, "?")
    stroke = F.concat(side, _mapped(stroke_kind(shot["letter"], F.lit(False)), KIND_WORDS, "o"), seen)
    return F.when(shot["is_serve"], F.concat(F.lit("sv"), _mapped(shot["direction"], SERVE_WORDS, "?"))).otherwise(stroke)


#: Characters of a stroke's code: letter (S: the serve), direction, depth, terminal, whether it went to the net, error.
CODE = 6
_PLACES = {1: "123", 2: "789", 3: "*#@", 5: "ndwx"}
#: A letter stands for all of its wing and kind.
_ALIKE = "".join(next(r for r in LETTERS if (r in FOREHAND, r in BACKHAND) == (c in FOREHAND, c in BACKHAND) and [r in k for k in KINDS.values()] == [c in k for k in KINDS.values()]) for c in LETTERS)


def _table(chars: str, to: str = "") -> np.ndarray:
    """Bytes to whether they are in ``chars``; to ``to``, the others to themselves, where that is given."""
    t = np.arange(256, dtype=np.uint8) if to else np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = np.frombuffer(to.encode(), np.uint8) if to else True
    return t


def stroke_codes(raw: pa.Array) -> pa.Array:
    """(code, words) of serve strings, null where no serve is charted: :data:`CODE` characters a stroke, a dot for what is
    not there, and two that tell its word (letter for all of its wing and kind, direction). Whole batches at a time: a
    stroke starts at the serve's direction or a letter; of several descriptors the last is written last."""
    raw = raw.cast(pa.binary())
    off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    text = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    row = np.repeat(np.arange(len(raw)), np.diff(off))
    digits = np.flatnonzero(_table("0123456789")[text])
    serve = digits[np.diff(row[digits], prepend=-1) > 0]  # the first digit of a row: leads are skipped
    serve = serve[_table("4560")[text[serve]]]
    begins = np.full(len(raw), len(text), np.int64)
    begins[row[serve]] = serve
    at = np.flatnonzero(np.arange(len(text)) >= begins[row])
    char, row = text[at], row[at]
    start = _table(LETTERS)[char] | (at == begins[row])
    stroke = np.cumsum(start) - 1
    code = np.full((int(start.sum()), CODE), ord("."), np.uint8)
    served = at[start] == begins[row[start]]
    code[:, 0] = np.where(served, ord("S"), char[start])
    code[served, 1] = char[start][served]
    live = ~start
    ends = np.flatnonzero(_table("\n\r")[char] | (char >= 0x80))
    if len(ends):  # a line's end hides what follows it in the stroke, of all but + and -
        two, three = np.append(char[1:], 0), np.append(char[2:], [0, 0])
        line = (char == 10) | (char == 13) | ((char == 0xC2) & (two == 0x85)) | ((char == 0xE2) & (two == 0x80) & np.isin(three[: len(char)], (0xA8, 0xA9)))
        first = np.full(len(code), len(text), np.int64)
        np.minimum.at(first, stroke[line], at[line])
        seen = live & (at < first[stroke])
    else:
        seen = live
    for place, chars in _PLACES.items():
        k = np.flatnonzero(seen & _table(chars)[char])
        code[stroke[k], place] = char[k]
    code[stroke[live & _table("+-")[char]], 4] = ord("+")
    words = code[:, :2].copy()
    words[:, 0] = _table(LETTERS, _ALIKE)[words[:, 0]]
    words[served, 1] = np.where(_table("456")[words[served, 1]], words[served, 1], ord("?"))
    size = np.bincount(row[start], minlength=len(raw))

    def strings(values: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(size * values.shape[1])]).astype(np.int32)
        known = np.packbits(size > 0, bitorder="little")
        return pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(values.tobytes()), pa.py_buffer(known))

    return pa.StructArray.from_arrays([strings(code), strings(words)], ["code", "words"])


def coded(points: DataFrame, first: str = "first_serve", second: str = "second_serve", svr: str = "svr", winner: str = "pt_winner") -> DataFrame:
    """``points`` with serve_in_play, server, code and words (:func:`stroke_codes`), rally_len, outcome, server_won and
    parse_ok, as :func:`decoded` has them."""
    c = F.col
    ss, fs = F.trim(F.coalesce(c(second), F.lit(""))), F.trim(F.coalesce(c(first), F.lit("")))
    served = [F.when(ss != "", 2).otherwise(1).alias("serve_in_play"), F.when(c(svr).isin(1, 2), c(svr)).otherwise(1).cast("int").alias("server")]
    d = points.select("*", *served, F.arrow_udf(stroke_codes, "code string, words string")(F.when(ss != "", ss).otherwise(fs)).alias("_x"))
    d = d.select("*", "_x.*", (F.length("_x.code") / CODE).cast("int").alias("rally_len")).drop("_x")
    t, alone = F.substring("code", 4 - CODE - 1, 1), c("rally_len") == 1
    missed = alone & (F.substring("code", -1, 1) != ".")
    how = F.when(t == "*", F.when(alone, "ace").otherwise("winner")).when(t == "#", "forced_error").when(t == "@", "unforced_error").when(missed & (c("serve_in_play") == 2), "double_fault").when(missed, "fault_unfinished").otherwise("unknown")
    d = d.select("*", F.when(c("code").isNotNull(), how).alias("outcome"))
    last = c("rally_len") % 2 == 1
    won = F.when(c("outcome").isin("ace", "winner"), last).when(c("outcome").isin("forced_error", "unforced_error"), ~last).when(c("outcome") == "double_fault", F.lit(False))
    return d.select("*", F.coalesce(c("outcome") != "unknown", F.lit(False)).alias("parse_ok"), F.when(c(winner).isin(1, 2), c(winner) == c("server")).otherwise(won).alias("server_won"))


def code_at(i: Column, place: int) -> Column:
    """Character ``place`` of stroke ``i`` (0: the serve) of ``code``; empty beyond the end."""
    return F.substring(F.col("code"), i * CODE + (place + 1), F.lit(1))


def spelled(pair: Column) -> Column:
    """The word of two characters of :func:`stroke_codes`, as :func:`shot_token` has it."""
    words = {f"S{k}": f"sv{w}" for k, w in SERVE_WORDS.items()} | {"S?": "sv?"}
    for c in dict.fromkeys(_ALIKE):
        kind = next((k for k, letters in KINDS.items() if c in letters), "other")
        words |= {f"{c}{d}": ("F" if c in FOREHAND else "B" if c in BACKHAND else "?") + KIND_WORDS[kind] + d.replace(".", "·") for d in "123."}
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), pair)


def pretty(token: Column) -> Column:
    """A stroke's word in plain words."""
    serve = _mapped(F.substring(token, 3, 10), {"W": "serve wide", "B": "serve body", "T": "serve T"}, "serve ?")
    side, kind = _mapped(F.substring(token, 1, 1), {"F": "FH", "B": "BH"}, "?"), _mapped(F.substring(token, 2, 1), {"d": "drive", "s": "slice", "v": "net"}, "shot")
    return F.when(token.isin("<s>", "<end>"), token).when(token.startswith("sv"), serve).otherwise(F.concat(side, F.lit(" "), kind, F.lit("→"), F.substring(token, 3, 10)))


def pretty_context(context: Column) -> Column:
    """Words of a context, one space apart, in plain words."""
    return F.array_join(F.transform(F.split(context, " "), pretty), " · ")
