"""Chat formatting by prefix-target expansion: one example for every assistant turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deucebase.llm.common import released, short_batches

# The template's control strings.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
CONTROL = re.compile(r"(\\*)(\[/?INST\]|<</?SYS>>|</?s>|<\|/?role(?::[^|]*)?\|>)")
OPENED = {o: role for role, (o, _) in MARKS.items()}
_FLUSH = 4_000_000


def escape(text: str) -> str:
    """A backslash more before every control string in ``text``."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def turn_marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"<|role:{quote(role, safe='')}|>", "<|/role|>")


def render(role: str, text: str) -> str:
    """One turn. A space stands on either side of the text, so a text can neither close its turn nor escape its mark."""
    o, c = turn_marks(role)
    return f"{o} {escape(text)} {c}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) that :func:`render` wrote one after the other."""
    found, role, at = [], None, 0
    for m in CONTROL.finditer(formatted):
        if m[1]:
            continue
        if role is None:
            role = OPENED.get(m[2])
            role = unquote(m[2][7:-2]) if role is None else role
            at = m.end() + 1
        else:
            found.append((role, unescape(formatted[at : m.start() - 1])))
            role = None
    return found


EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_DDL = "conv_id bigint, example bigint, formatted string, loss_start bigint, loss_end bigint"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    conv, prefix, n, spoken, rows, held = none, "", 0, True, [], 0

    def batch():
        return pa.RecordBatch.from_pylist([dict(zip(EXAMPLES.names, r, strict=True)) for r in rows], EXAMPLES)

    for b in batches:
        for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if c != conv:
                if not spoken:
                    rows.append((conv, n, prefix, None, None))
                    held += len(prefix)
                conv, prefix, n = c, "", 0
            start = len(prefix)
            prefix += render(role, text)
            spoken = role == "assistant"
            if spoken:
                o, x = turn_marks(role)
                rows.append((c, n, prefix, start + len(o) + 1, len(prefix) - len(x) - 1))
                n += 1
                held += len(prefix)
            if held > _FLUSH:
                yield batch()
                rows, held = [], 0
    if not spoken:
        rows.append((conv, n, prefix, None, None))
    if rows:
        yield batch()


def format_chats(conversations: DataFrame) -> DataFrame:
    """Examples conv_id, example, formatted, loss_start, loss_end, in order within a conversation.

    Every assistant turn becomes an example: all turns before it as context, then the turn itself; only the
    reply's text (code points loss_start to loss_end of ``formatted``) is trainable. Turns after the last
    assistant turn are in one more example with nothing trainable (null spans), so that no turn is lost.

    Rows go by turn, then role, then text (nulls first), so ties and repeated rows have one order; all are used.
    Null text or role: empty. Null conv_id: a conversation of its own. A conversation is read as a stream: what is
    held is its prefix and a few MB of output, however many turns it has. Other columns are not read.
    """
    short_batches(conversations.sparkSession, 2000)
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(released(_expand), _DDL)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    conv, last, chars, n_loss, n, loss, rows = none, "", 0, 0, 0, hashlib.sha256(), []

    def close():
        turns, h = read_turns(last), hashlib.sha256()
        for role, text in turns:
            h.update(f"{role}\n{text}\n".encode())
        rows.append((conv, len(turns), h.hexdigest(), n_loss, loss.hexdigest(), chars, n))

    for b in batches:
        for c, _, formatted, s, e in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if c != conv:
                if conv is not none:
                    close()
                conv, chars, n_loss, n, loss = c, 0, 0, 0, hashlib.sha256()
            last = formatted
            chars += len(formatted)
            n += 1
            if s is not None:
                reply = unescape(formatted[s:e])
                n_loss += len(reply)
                loss.update(reply.encode())
        if len(rows) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], _READ)
            rows = []
    if conv is not none:
        close()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], _READ)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    ``examples`` are as :func:`format_chats` gives them: a conversation's stand together, in order.
    """
    return examples.mapInArrow(released(_read), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint")
