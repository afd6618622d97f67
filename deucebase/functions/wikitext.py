"""Wiki markup: nesting is read by one pass over its brackets; draws and calendars come out as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

# Fixed values.
MONTHS = "January February March April May June July August September October November December".split()
ENTRY_TAGS = ("Q", "WC", "LL", "PR", "SE")
SURFACES = ("Hard", "Clay", "Grass", "Carpet")

_BRACKETS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|\||\||\n")
_MARKUP = re.compile(r"<!--.*?-->|\{\{\s*flagicon\s*\|[^}]*\}\}|'{2,}", re.S | re.I)
_LINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]")


@dataclass
class Template:
    """A ``{{...}}`` of any depth: its name and its fields, as written."""

    name: str
    fields: list[str] = field(default_factory=list)

    def named(self) -> dict[str, str]:
        """Fields of the form key = value; keys in capitals."""
        pairs = (f.split("=", 1) for f in self.fields if "=" in f)
        return {k.strip().upper(): v for k, v in pairs}


def templates(text: str) -> list[Template]:
    """All templates in the order in which they begin; a bar inside a link or an inner template cuts no outer field."""
    found, open_ = [], []  # open templates: (place in found, starts of fields); links are None
    for m in _BRACKETS.finditer(text):
        mark = m[0]
        if mark == "{{":
            found.append(None)
            open_.append([len(found) - 1, [m.end()], []])
        elif mark == "[[":
            open_.append(None)
        elif mark == "]]":
            if open_ and open_[-1] is None:
                open_.pop()
        elif mark == "}}":
            while open_ and open_[-1] is None:  # a link left open
                open_.pop()
            if open_:
                at, starts, ends = open_.pop()
                parts = [text[a:b] for a, b in zip(starts, [*ends, m.start()], strict=True)]
                found[at] = Template(parts[0].strip(), parts[1:])
        elif mark in ("|", "||") and open_ and open_[-1] is not None:
            for k in range(len(mark)):
                open_[-1][2].append(m.start() + k)
                open_[-1][1].append(m.start() + k + 1)
    return [t for t in found if t]


def cells(text: str) -> Iterator[tuple[str | None, str]]:
    """(month heading above, cell) of the tables: a cell ends at a line's end or a double bar outside all brackets."""
    month, depth, at = None, 0, 0

    def closed(piece: str) -> str | None:
        nonlocal month
        s = piece.strip()
        head = re.fullmatch(r"=+\s*(\w+)\s*=+", s)
        if head and head[1].title() in MONTHS:
            month = head[1].title()
            return None
        return re.sub(r"^(\|-|\|\}|[|!])", "", s) if s else None

    for m in [*_BRACKETS.finditer(text), None]:
        mark = m[0] if m else "\n"
        if mark in ("{{", "[["):
            depth += 1
        elif mark in ("}}", "]]"):
            depth = max(0, depth - 1)
        elif (mark == "\n" or mark == "||") and (depth == 0 or m is None):
            if (c := closed(text[at : m.start() if m else len(text)])) is not None:
                yield month, c
            at = m.end() if m else len(text)


def _plain(raw: str) -> str:
    s = re.sub(r"<[^>]+>", " ", _MARKUP.sub("", raw)).replace("&nbsp;", " ")
    return " ".join(s.split())


def clean_player(raw: str | None) -> str:
    """The name in a cell: a link's target without its closing brackets of distinction, else the bare text."""
    link = _LINK.search(re.sub(r"<!--.*?-->", "", raw or "", flags=re.S))
    return re.sub(r"\s*\([^)]*\)$", "", " ".join(link[1].split())) if link else _plain(raw or "")


def clean_seed(raw: str | None) -> str | None:
    """Of a seed cell: its number, else its usual entry tag, else whatever comes first."""
    words = re.findall(r"[A-Za-z0-9]+", _plain(raw or ""))
    number = next((w for w in words if w.isdigit()), None)
    tag = next((w.upper() for w in words if w.upper() in ENTRY_TAGS), None)
    return number or tag or (words[0].upper() if words else None)


def draw_section(text: str) -> str:
    """What stands under the heading Draw, to the next heading of its level; all of it without one."""
    parts = re.split(r"(?m)^==([^=\n][^\n]*?)==[ \t]*$", text or "")
    for title, body in zip(parts[1::2], parts[2::2], strict=True):
        if title.strip().lower() == "draw":
            return body
    return text or ""


def parse_draw(text: str | None, size: int = 16) -> list[tuple]:
    """First-round slots of a draw page: (slot, a, b, seed_a, seed_b, bye, partial). A pair that is left out is a bye of
    who stands in round two. An empty page gives none."""
    out: list[tuple] = []
    for t in templates(draw_section(text or "")):
        if not re.match(rf"(?i){size}TeamBracket", t.name):
            continue
        cell = t.named()
        team = lambda r, k: clean_player(cell.get(f"RD{r}-TEAM{k:02d}"))  # noqa: B023, E731
        seed = lambda r, k: clean_seed(cell.get(f"RD{r}-SEED{k:02d}"))  # noqa: B023, E731
        for k in range(1, size // 2 + 1):
            a, b, through = team(1, 2 * k - 1), team(1, 2 * k), team(2, k)
            slot = len(out) + 1
            if a and b:
                out.append((slot, a, b, seed(1, 2 * k - 1), seed(1, 2 * k), False, False))
            elif through and not a and not b:
                out.append((slot, through, None, seed(2, k), None, True, False))
            else:
                out.append((slot, a or b or None, None, None, None, False, True))
    return out


def parse_calendar(text: str | None) -> list[tuple]:
    """Events of a season page: (event, city, tier, surface, indoor, month, draw_size, singles_pages), the first mention of
    an event with the draw pages of all."""
    found: dict[str, list] = {}
    for month, cell in cells(text or ""):
        level = re.search(r"\b(ATP|WTA)\s*(1000|500|250|125)\b", cell)
        slam = re.search(r"\bgrand slam\b", cell, re.I)
        if not re.search(r"<br", cell) or not (level or re.search(r"\bGrand Slam\b", cell)):
            continue
        links = [(a.strip(), (b or "").strip()) for a, b in _LINK.findall(cell)]
        event = (links[0][1] or links[0][0]) if links else ""
        lines = [x for x in re.split(r"<br\s*/?>", cell) if x.strip()]
        city = " ".join(_LINK.sub(lambda m: m[1], lines[1]).split(",")[0].split()).strip(" '|") if len(lines) > 1 else ""
        if not city:
            city = next((a.split(",")[0].strip() for a, _ in links[1:] if not re.search("singles|doubles", a, re.I)), "")
        surface = re.search(rf"\b({'|'.join(SURFACES)})\b\s*(\(i\))?", cell, re.I)
        size = re.search(r"\b(\d+)S\b", cell)
        row = found.setdefault(event, [event, city, "Grand Slam" if slam else f"{level[1]} {level[2]}", surface[1].title() if surface else None, bool(surface and surface[2]), MONTHS.index(month) + 1 if month else None, int(size[1]) if size else None, []])
        row[7] += [a for a, _ in links if a.lower().endswith("singles") and "qualif" not in a.lower() and a not in row[7]]
    return [tuple(r) for r in found.values()]


@udtf(returnType="slot int, a string, b string, seed_a string, seed_b string, bye boolean, partial boolean")
class DrawSlots:
    def eval(self, text: str):
        yield from parse_draw(text)


@udtf(returnType="event string, city string, tier string, surface string, indoor boolean, month int, draw_size int, singles_pages array<string>")
class CalendarEvents:
    def eval(self, text: str):
        yield from parse_calendar(text)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file of a folder: path, text."""
    from pyspark.sql import functions as F

    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def register(spark: SparkSession) -> None:
    """parse_draw(text) and parse_calendar(text) as table functions of SQL (LATERAL)."""
    spark.udtf.register("parse_draw", DrawSlots)
    spark.udtf.register("parse_calendar", CalendarEvents)
