"""Secret scans: base patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from deucebase.llm.common import released, short_batches

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
KINDS = ("assign", "access", "hex", "entropy")
# Fixed values of the contract.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class: pattern of its strings, window, least entropy in bits of some window.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z"), 24, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 20, 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 20, 3.7),
)
#: Strings that look random and are not secrets.
ALLOW = (
    re.compile(r"[A-Za-z]+\Z"),  # letters only: words, identifiers
    re.compile(r"[0-9_=/+-]+\Z"),  # digits only: numbers, rules
    re.compile(r"[A-Z]?[a-z]*(?:[-_/][A-Za-z]?[a-z]*)*[0-9]{0,4}\Z"),  # words with joints
    re.compile(r"(?i).*example"),
    re.compile(r"(?:(.)\1*|(..)\2*|(...)\3*|(....)\4*)\Z"),  # one short unit again and again
)


def entropy_spans(text: str, allow=ALLOW) -> list[tuple[int, int]]:
    """Spans of candidate strings covered by windows of high entropy.

    The window slides by one character; its entropy is log2(w) - sum(c log2 c) / w, and the sum changes only in
    the counts of the character that comes and of the one that goes.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(a.match(s) for a in allow):
            continue
        window, least = next((w, e) for _, p, w, e in CLASSES if p.match(s))
        w = min(window, len(s))
        term = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]
        most = w * (math.log2(w) - least)  # entropy >= least exactly when the sum is at most this
        counts: dict[str, int] = {}
        total, start, end = 0.0, -1, -1
        for i, ch in enumerate(s):
            if i >= w:
                c = counts[s[i - w]]
                counts[s[i - w]] = c - 1
                total += term[c - 1] - term[c]
            c = counts.get(ch, 0)
            counts[ch] = c + 1
            total += term[c + 1] - term[c]
            if i >= w - 1 and total <= most + 1e-9:
                at = i - w + 1
                if start < 0:
                    start = at
                elif at > end:
                    found.append((m.start() + start, m.start() + end))
                    start = at
                end = i + 1
        if start >= 0:
            found.append((m.start() + start, m.start() + end))
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("entropy", *s) for s in entropy_spans(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> (code points, end exclusive), one row per input row.

    Null text counts as empty: no spans. Every whole text is scanned in one pass; nothing is shuffled. Rows are
    independent: repeated rows give repeated rows. Other columns are not read.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(released(run), "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def secret_report(docs: DataFrame, **cols: str) -> DataFrame:
    """The digest columns of :func:`scan_secrets`, made of its spans: a row for every row, null and empty texts with counts
    of 0 and the digest of no span."""
    found = scan_secrets(docs, **cols)

    def joined(s: str) -> str:
        return f"array_join(transform({s}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"

    count = "CAST(size(filter(spans, x -> x.kind = '{0}')) AS bigint) AS n_{0}"
    base = "filter(spans, x -> x.kind <> 'entropy')"
    return found.selectExpr("doc_id", *(count.format(k) for k in KINDS), f"sha2({joined(base)}, 256) AS base_sha256", f"{joined('spans')} AS spans")

