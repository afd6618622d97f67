"""Language identification by cross-parsing entropy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deucebase.llm.common import released, short_batches

#: Symbols of the automata: 0 is anything that is not a letter; the most frequent letters of the samples have a symbol
#: each; any other letter is written with the last ``DIGITS``, as its code point. No letter is lost or merged.
ALPHABET, DIGITS = 64, 16
SEGMENT = 2048
_CODED = 255


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``symbols``: row per state, -1 where there is none; state 0 is the root."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for i, d in enumerate(nxt):
        for c, t in d.items():
            table[i, c] = t
    return table


@dataclass
class Model:
    """``table``: the automata of all languages in one; an entry is the next state, or ~(the state after the first symbol
    of a new phrase). States count in symbols of ``table``. ``rate``: phrases a symbol on each language's own text."""

    langs: list[str]
    symbol_of: dict[int, int]
    table: np.ndarray
    roots: np.ndarray
    rate: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as symbols; anything between letters is one 0."""
        if not text:
            return np.zeros(0, np.uint8)
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self._lut()[points]
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        s, points = s[keep], points[keep]
        if not (s == _CODED).any():
            return s
        size = np.where(s == _CODED, np.where(points > 0xFFFF, 6, 4), 1)
        left = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1  # digits that still follow
        out, points = np.repeat(s, size), np.repeat(points, size)
        coded = out == _CODED
        out[coded] = ALPHABET - DIGITS + ((points >> (4 * left).astype(np.uint32)) & 15)[coded]
        return out

    def _lut(self) -> np.ndarray:
        if not hasattr(self, "_made"):
            self._made = np.where(_letters(), np.uint8(_CODED), np.uint8(0))
            for point, symbol in self.symbol_of.items():
                self._made[point] = symbol
        return self._made

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text (rows) parsed by every language's automaton (columns).

        All texts go forward in step, in segments of ``SEGMENT`` symbols, so that a long one holds up nobody. A
        segment's last phrase counts; every language pays that alike.
        """
        owner, parts = [], []
        for i, t in enumerate(texts):
            for k in range(0, len(t), SEGMENT):
                owner.append(i)
                parts.append(t[k : k + SEGMENT])
        out = np.zeros((len(texts), len(self.langs)))
        if not parts:
            return out
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        size, longest = size[order], int(size[order[0]])
        grid = np.zeros((longest, len(parts)), np.int32)
        for j, k in enumerate(order):
            grid[: len(parts[k]), j] = parts[k]
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        state = np.repeat(self.roots[:, None], len(parts), 1)
        count = np.ones(state.shape, np.int32)
        for t in range(longest):
            n = active[t]
            new = self.table[state[:, :n] + grid[t, :n]]
            sign = new >> 31
            count[:, :n] -= sign
            state[:, :n] = new ^ sign
        np.add.at(out, np.array(owner)[order], count.T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parsed = [self.symbols(t or "") for t in texts]
        count = self.phrases(parsed) / self.rate
        found = []
        for s, c in zip(parsed, count, strict=True):
            if not len(self.langs) or not (s > 0).any():
                found.append(("und", 0.0))
                continue
            k = int(np.argmin(c))
            found.append((self.langs[k], float(1 / np.exp(-np.minimum(c - c[k], 50)).sum())))
        return found


def _evenly(parts: list[np.ndarray], total: int) -> np.ndarray:
    """At most ``total`` symbols, as many of each part as that allows; parts stand apart."""
    size = np.sort([len(p) for p in parts])
    before = np.cumsum(size) - size
    fits = before + size * np.arange(len(size), 0, -1) <= total  # all longer ones cut to this one's length
    k = int(fits.sum())
    each = int(size[-1]) if k == len(size) else (total - int(before[k])) // (len(size) - k)
    apart = np.zeros(1, np.uint8)
    return np.concatenate([x for p in parts for x in (apart, p[:each])] or [apart])


def fit(samples: dict[str, list[str]], chars: int = 20_000) -> Model:
    """One automaton a language, of at most ``chars`` symbols drawn evenly from every other of its samples; as many of
    the others give its own phrase rate. A lone sample is cut in two."""
    seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
    symbol_of = {ord(c): i + 1 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - DIGITS - 1])}
    langs = sorted(samples)
    model = Model(langs, symbol_of, np.zeros(0, np.int32), np.zeros(len(langs), np.int32), np.ones(len(langs)))
    tables, checks, at = [], [], 0
    for k, lang in enumerate(langs):
        parts = [model.symbols(t) for t in samples[lang]]
        if len(parts) == 1:
            parts = [parts[0][: len(parts[0]) * 3 // 4], parts[0][len(parts[0]) * 3 // 4 :]]
        s = _evenly(parts[::2], chars)
        t = suffix_automaton(s.tolist(), ALPHABET).astype(np.int64)
        first = np.where(t[0] >= 0, t[0], 0)
        t = np.where(t >= 0, at + t * ALPHABET, ~(at + first * ALPHABET)[None, :])
        tables.append(t.astype(np.int32).ravel())
        model.roots[k] = at
        at += tables[-1].size
        checks.append(_evenly(parts[1::2], chars))
    model.table = np.concatenate(tables) if tables else model.table
    own = model.phrases(checks)
    model.rate = np.array([max(own[k, k], 1) / max(len(checks[k]), 1) for k in range(len(langs))])
    model.rate = model.rate / max(model.rate.mean(), 1e-9) if len(langs) else model.rate
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 150, piece: int = 4000, chars: int = 20_000) -> Model:
    """Model of a bounded sample of the labelled rows that are not held out: about ``docs_per_lang`` documents a
    language, picked by a hash of their id, ``piece`` characters of each; nothing more reaches the driver. Of these,
    2 * ``chars`` symbols a language are used, drawn evenly from all of them (:func:`fit`)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit({})
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) / 1_000_000
    got = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", F.left("text", F.lit(piece)).alias("text"), F.xxhash64("doc_id").alias("o"))
    samples: dict[str, list[str]] = {}
    for lang, text, _ in sorted(got.collect(), key=lambda r: (r[0], r[2], r[1])):
        samples.setdefault(lang, []).append(text)
    return fit(samples, chars)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per input row.

    A text is parsed, from its start, into the longest phrases that a language's sample contains; the language that
    needs fewest, divided by what it needs for its own text, wins. ``score`` is its share of exp(-phrases).

    Null text, or no letter in it: ``und`` with score 0; so is everything if nothing is labelled. Ties go to the
    first language in order. Only labelled rows whose crc32 of the id is not divisible by 5 are learned from.
    Rows are independent and whole texts are read; repeated rows give repeated rows. A null id is not held out.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is undetermined; ``lang`` becomes the predicted language. Other columns stay."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    names, at, to = docs.columns, docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x[0] for x in shared.value.predict(b.column(at).to_pylist())]
            columns = [pa.array(found, pa.string()) if i == to else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([x != "und" for x in found]))

    return docs.mapInArrow(released(run), docs.schema)
