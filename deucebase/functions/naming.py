"""Names of events and matches: tiers, stable keys, the parts of a match id."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Events by level.
SLAMS = ("australian open", "roland garros", "french open", "wimbledon", "us open")
WTA_1000 = ("indian wells", "miami", "madrid", "rome", "canada", "montreal", "toronto", "cincinnati", "beijing", "wuhan", "dubai", "doha", "guadalajara", "cancun", "tokyo", "charleston")
ATP_1000 = ("monte carlo", "shanghai", "hamburg")
FINALS = ("tour finals", "atp finals", "wta finals", "masters cup", "wta championships", "year-end championships")
TEAM = ("davis cup", "fed cup", "billie jean king cup", "united cup", "laver cup", "hopman cup", "atp cup", "olympic")
TIERS = ("Grand Slam", "Masters / WTA 1000", "Tour Finals", "Tour (250/500)", "Team / Other Event", "Other / Unknown")
ALIASES = {"french open": "roland garros", "us open tennis championships": "us open", "montreal": "canada", "toronto": "canada"}
CANADA = ("Montreal", "Toronto")


def event_base(name: Column) -> Column:
    s = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit("and"))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\bmasters\b", " "), r"\s+", " "))


def classify_tier(tournament: Column, gender: Column) -> Column:
    raw, base = F.lower(F.trim(F.coalesce(tournament, F.lit("")))), event_base(tournament)
    team = F.lit(False)
    for marker in TEAM:
        team = team | raw.contains(marker)
    slam, masters, finals, tour, other_event, unknown = TIERS
    return (
        F.when(base == "", unknown).when(base.isin(*SLAMS), slam).when(raw.isin(*FINALS) | base.isin(*FINALS), finals).when(team, other_event)
        .when(raw.contains("masters") | base.isin(*ATP_1000) | ((F.upper(gender) == "W") & base.isin(*WTA_1000)), masters)
        .when(base.rlike("[a-z]"), tour).otherwise(unknown)
    )


def canon_masters_event(name: Column) -> Column:
    s = F.trim(F.regexp_replace(name, r"[_\s]+", " "))
    s = F.trim(F.regexp_replace(s, r"(?i)\s*masters$", ""))
    return F.when(s.isin(*CANADA), "Canada").otherwise(s)


def fold_name(name: Column) -> Column:
    """Lower-case words of plain letters, for text that is ASCII already."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[.\-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z ]", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def normalize_name(s: pd.Series) -> pd.Series:
    """Like :func:`fold_name`, with accents stripped first (Spark has no Unicode decomposition)."""
    plain = s.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())
    return plain.str.replace(r"[.\-]", " ", regex=True).str.replace(r"[^a-z ]", " ", regex=True).str.split().str.join(" ")


def tourn_key(name: Column, folded: Column | None = None) -> Column:
    f = fold_name(name) if folded is None else folded
    k = F.trim(F.regexp_replace(F.regexp_replace(f, r"\bmasters\b", " "), r"\s+", " "))
    c = F.when(k == "", f)
    for a, b in ALIASES.items():
        c = c.when(k == a, b)
    return c.otherwise(k)


def match_id_parts(match_id: Column) -> Column:
    """Struct of date, gender, tournament, round, player1, player2; null where a hyphen inside a field makes it ambiguous."""
    m = r"^(\d{8})-([MW])-(.+)$"
    parts = F.split(F.regexp_extract(F.trim(match_id), m, 3), "-")
    whole = F.trim(match_id).rlike(m) & (F.size(parts) == 4) & F.forall(parts, lambda x: x != "")
    spaced = lambda i: F.replace(F.get(parts, F.lit(i)), F.lit("_"), F.lit(" "))
    return F.when(whole, F.struct(F.regexp_extract(F.trim(match_id), m, 1).alias("date"), F.regexp_extract(F.trim(match_id), m, 2).alias("gender"), spaced(0).alias("tournament"), F.get(parts, F.lit(1)).alias("round"), spaced(2).alias("player1"), spaced(3).alias("player2")))
