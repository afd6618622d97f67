"""BPE encoding and decoding by tree concatenation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from deucebase.llm.common import released, short_batches

#: A lone space between two characters that are not white space: pieces of the pre-tokenizer never reach across it.
UNIT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeBpe:
    """Encoder and decoder for one byte-level vocabulary file.

    ``leaf``: characters that are encoded in one go. Longer texts are halved; the halves are encoded on their own
    and joined by encoding a window around the cut again, growing it until it agrees with both sides.
    """

    def __init__(self, path: str, leaf: int = 8192, piece_leaf: int = 256):
        import regex
        import tiktoken

        with open(path, encoding="utf8") as f:
            data = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {k: v for k, v in data["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}
        self.core = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self.bytes = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in self.special.items()}
        self.pieces = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf, self.piece_leaf = leaf, piece_leaf
        self.long_space = re.compile(r"\s{%d}" % piece_leaf)

    # --- leaves

    def _plain(self, text: str) -> list[int]:
        """Text without special strings. Only where a run of characters is long can a piece be long."""
        if max(map(len, text.split()), default=0) < self.piece_leaf and not self.long_space.search(text):
            return self.core.encode_ordinary(text)
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += self._piece(piece)
        return ids

    def _leaf(self, text: str) -> list[int]:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        ids: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._plain(part)
        return ids

    # --- a piece that the pre-tokenizer leaves whole

    def _piece(self, piece: str) -> list[int]:
        if len(piece) <= self.piece_leaf:
            return self.core.encode_ordinary(piece)
        leaves, n = [], -(-len(piece) // self.piece_leaf)
        step = -(-len(piece) // n)
        for i in range(0, len(piece), step):
            leaves.append(piece[i : i + step])
        level = self.core.encode_ordinary_batch(leaves, num_threads=2)  # the leaves in parallel
        while len(level) > 1:
            level = [self._join_piece(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _join_piece(self, a: list[int], b: list[int]) -> list[int]:
        """Exact, as a sequence is the encoding of its bytes if every two neighbours encode to themselves: the window's
        neighbours do, so do those of either side, and the window shares its outer tokens with them."""
        k = 8
        while True:
            x, y = min(k, len(a)), min(k, len(b))
            raw = b"".join(map(self.bytes.__getitem__, [*a[len(a) - x :], *b[:y]]))
            whole = x == len(a) and y == len(b)
            try:
                window = self.core.encode_ordinary(raw.decode())
            except UnicodeDecodeError:  # its ends cut a character
                window = None
            if window is not None and (whole or ((x == len(a) or window[0] == a[-x]) and (y == len(b) or window[-1] == b[y - 1]))):
                return a[: len(a) - x] + window + b[y:]
            k *= 2

    # --- long texts

    def encode(self, text: str) -> list[int]:
        return self._tree(text)

    def _tree(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._leaf(text)
        cut = len(text) // 2
        left, right = text[:cut], text[cut:]
        # A side without a safe boundary is one unit with what stands beyond the cut: it is not halved here.
        if not UNIT.search(left) or not UNIT.search(right):
            return self._leaf(text)
        return self._join(left, self._tree(left), right, self._tree(right))

    def _join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The window runs from a safe boundary left of the cut to one right of it; both are boundaries of pieces in any
        context. It grows until its outer units are those that either side has there."""
        w = 64
        while True:
            tail, head = left[-w:], right[:w]
            at = [m.start() for m in UNIT.finditer(tail)]
            to = [m.start() for m in UNIT.finditer(head)]
            done = w >= len(left) and w >= len(right)
            if (len(at) > 1 and len(to) > 1) or (done and at and to):
                s, e = at[0], to[-1]
                window = self._leaf(tail[s:] + head[:e])
                old_a, old_b = self._leaf(tail[s:]), self._leaf(head[:e])
                first = self._leaf(tail[s : at[1]]) if len(at) > 1 else []
                last = self._leaf(head[to[-2] : e]) if len(to) > 1 else []
                agrees = window[: len(first)] == first and window[len(window) - len(last) :] == last
                if done or (agrees and a[len(a) - len(old_a) :] == old_a and b[: len(old_b)] == old_b):
                    return a[: len(a) - len(old_a)] + window + b[len(old_b) :]
            w *= 2

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, leaf: int = 8192) -> TreeBpe:
    return TreeBpe(path, leaf)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = 8192) -> DataFrame:
    """doc_id, ids array<int>: every whole text as token ids, special strings in it as special tokens.

    Null text: empty, no ids. Rows are independent, nothing is shuffled; repeated rows give repeated rows. Other
    columns are not read. ``vocabulary`` is the path of the vocabulary file, read by each worker.
    """
    path = vocabulary or default_vocabulary()
    short_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, leaf)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(released(run), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, text: the text that ``ids`` stand for, special tokens included, broken UTF-8 as U+FFFD. Null ids: empty."""
    path = vocabulary or default_vocabulary()
    short_batches(encoded.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            text = [bpe.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id bigint, ids array<int>, text string")


def token_report(docs: DataFrame, vocabulary: str | None = None, **cols: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of :func:`encode` and :func:`decode`: a row for every row, null texts
    as empty ones with no token."""
    both = decode(encode(docs, vocabulary, **cols), vocabulary)
    return both.selectExpr("doc_id", "CAST(size(ids) AS bigint) AS n_tokens", "sha2(array_join(CAST(ids AS array<string>), ','), 256) AS ids_sha256", "sha2(text, 256) AS decoded_sha256")
