"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deucebase.llm.common import components, released, remove, save, short_batches

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_FULL = 1024  # members of a run that are compared in one group; longer runs go in pairs of chunks
_SHINGLES, _TEXTS = 1 << 18, 4096  # of a block of texts that are compared exactly; larger components go in pairs of blocks


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64) * _M3
    for i in range(k):
        h = mix64(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


class Bands:
    """Size bands: two sets can only be similar if they are in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def most(self, total):
        """Largest symmetric difference of a similar pair whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def scheme(self, k: int) -> tuple[int, int]:
        """For pairs whose smaller set is in band ``k``: the largest symmetric difference, and the number of segments."""
        a = int(self.low[k + 1]) - 1
        d = self.most(a + a * self.den // self.num)
        return d, max(1, (d + 1) * 5 // 4)


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set for the scheme of its band and of the one below.

    A scheme hashes every shingle into one of its segments and XORs it there into a 64-bit sketch, so each shingle in
    the symmetric difference of two sets disturbs one segment. With at most d such shingles, d + 1 segments of one set
    cannot all be disturbed. Every set gives all its segments of at least c shingles, c the largest number of which it
    has d + 1 such segments: for the set with the larger c, one of them is the same in the other set, and the other
    gives it too. Nothing is lost, and the nearly empty segments that many sets have in common are left out.
    """
    n, found = len(h), []
    if not n:
        return np.zeros(0, np.uint64)
    band = bands.of(n)
    folded = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mix64(h ^ _M3))])
    for k in {band, max(band - 1, 0)}:
        d, s = bands.scheme(k)
        seg = ((h >> np.uint64(32)) * np.uint64(s)) >> np.uint64(32)  # rises with h
        cut = np.searchsorted(seg, np.arange(s + 1, dtype=np.uint64))
        count = np.diff(cut)
        c = np.sort(count)[::-1][d]
        at = np.flatnonzero(count >= c)
        word = folded[cut[at + 1]] ^ folded[cut[at]]
        place = (np.uint64(k) << np.uint64(40)) + at.astype(np.uint64)
        found.append(mix64(mix64(place * _M3 + count[at].astype(np.uint64)) ^ word))
    return np.concatenate(found)


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parity sketch: each shingle flips one bit. Its length, a power of two, is two bits a shingle, 128 to 16384; a longer
    sketch folds to a shorter one by XOR of its halves. The Hamming distance never exceeds the symmetric difference."""
    m = max(128, 1 << min(14, int(2 * len(h) - 1).bit_length()))
    bit = mix64(h + _M1) & np.uint64(m - 1)
    odd = np.flatnonzero(np.bincount(bit.astype(np.int64), minlength=m) & 1)
    out = np.zeros(m, np.uint8)
    out[odd] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _fold(s: np.ndarray, words: int) -> np.ndarray:
    while len(s) > words:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


# --- what runs in the workers


def _node(words: list[bytes]) -> int | None:
    """64-bit name of a word sequence; none for no words."""
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) if words else None


def _first(n: int, bands: Bands):
    """Of rows doc_id, text_hash, text: what one reading of a text gives. A null id is no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, node, sketch, sigs = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words_of(t)
                h = shingle_set(w, n)
                size.append(len(h))
                node.append(None if i is None else _node(w))
                sketch.append(bit_sketch(h).tobytes() if node[-1] is not None else None)
                sigs.append(signatures(h, bands).view(np.int64) if node[-1] is not None else np.zeros(0, np.int64))
            columns = [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "id", "sketch", "sigs"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per signature; copies of one text in a task give theirs once."""
    seen: set[int] = set()
    for b in batches:
        new = []
        for i in b.column(0).to_pylist():
            new.append(i not in seen)
            seen.add(i)
        b = b.filter(pa.array(new, pa.bool_()))
        if b.num_rows:
            lists = b.column(1)
            yield pa.RecordBatch.from_arrays([lists.flatten(), np.repeat(b.column(0).to_numpy(), lists.value_lengths().to_numpy())], names=["sig", "id"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and id: the members of every signature that two texts or more have.

    ``k`` is -1 for a whole run; one of over ``_FULL`` members comes in chunks 0, 1, ... of at most that many.
    """
    none = np.zeros(0, np.int64)
    sig, id_, k = none, none, 0  # the run that may go on, and how many of its chunks are out

    def out(rows):
        values, sizes = [r[2] for r in rows], [len(r[2]) for r in rows]
        ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(values))
        return pa.RecordBatch.from_arrays([np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), ids], names=["sig", "k", "ids"])

    def closed(s, members, at):
        if at == 0 and 2 <= len(members) <= _FULL:
            return [(s, -1, members)]
        if at or len(members) > _FULL:
            return [(s, at + i // _FULL, members[i : i + _FULL]) for i in range(0, len(members), _FULL)]
        return []

    for b in batches:
        sig, id_ = np.concatenate([sig, b.column(0).to_numpy()]), np.concatenate([id_, b.column(1).to_numpy()])
        if not len(sig):
            continue
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (id_[1:] != id_[:-1])])
        sig, id_ = sig[new], id_[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        last, found = start[-1], []
        if len(start) > 1:
            if k:
                found += closed(sig[0], id_[: start[1]], k)
            size = np.diff(start)
            for i in np.flatnonzero(size > 1):
                if i or not k:
                    found += closed(sig[start[i]], id_[start[i] : start[i + 1]], 0)
            k = 0
        sig, id_ = sig[last:], id_[last:]
        while len(id_) >= 2 * _FULL:
            found.append((sig[0], k, id_[:_FULL]))
            sig, id_, k = sig[_FULL:], id_[_FULL:], k + 1
        if found:
            yield out(found)
    if len(sig) and (found := closed(sig[0], id_, k)):
        yield out(found)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows sorted by their first column: the other columns of each group, as lists."""
    rows, group = [], None
    for b in batches:
        for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if g != group:
                if len(rows) > 1:
                    yield tuple(map(list, zip(*rows, strict=True)))
                rows, group = [], g
            rows.append(row)
    if len(rows) > 1:
        yield tuple(map(list, zip(*rows, strict=True)))


def _spanning(m: int, side: np.ndarray, like) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which ``like(i, others)`` says who of ``others`` is linked to ``i``.

    Whoever is reached is compared no more, so a group of like members takes few comparisons. Side 0: all pairs; else
    only pairs of different sides.
    """
    free, edges = np.arange(m), []
    while len(free):
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            i = queue.pop()
            other = free if not side[i] else free[side[free] != side[i]]
            hit = other[like(i, other)] if len(other) else other
            if len(hit):
                edges += [(i, j) for j in hit]
                queue += hit.tolist()
                free = np.setdiff1d(free, hit, assume_unique=True)
    return edges


def _pairs(edges: list[tuple[int, int]], name: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([name[[e[0] for e in edges]], name[[e[1] for e in edges]]], names=["a", "b"])


def _close(bands: Bands):
    """Of rows g, id, n, side, sketch: a spanning forest of the pairs whose sizes and Hamming distance allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for id_, n, side, sketch in _groups(batches):
            words = min(map(len, sketch)) // 8
            s = np.stack([_fold(np.frombuffer(x, np.uint64), words) for x in sketch])
            n = np.array(n)

            def like(i, j, s=s, n=n):
                ok = bands.den * np.minimum(n[i], n[j]) >= bands.num * np.maximum(n[i], n[j])
                ok[ok] = np.bitwise_count(s[j[ok]] ^ s[i]).sum(1) <= bands.most(n[i] + n[j[ok]])
                return ok

            found.append((_spanning(len(n), np.array(side), like), np.array(id_)))
            if len(found) >= 2000:
                yield pa.Table.from_batches([_pairs(e, i) for e, i in found if e], _EDGE).combine_chunks().to_batches()[0] if any(e for e, _ in found) else _NO_EDGE
                found = []
        if any(e for e, _ in found):
            yield pa.Table.from_batches([_pairs(e, i) for e, i in found if e], _EDGE).combine_chunks().to_batches()[0]

    return run


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_NO_EDGE = pa.RecordBatch.from_arrays([np.zeros(0, np.int64), np.zeros(0, np.int64)], schema=_EDGE)
_DENSE = 32  # a shingle of that many texts or more counts by a matrix product, a rarer one pair by pair


def overlaps(sets: list[np.ndarray], cut: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``sets``, or of those before ``cut`` (rows) with those from it on."""
    m, size = len(sets), np.array(list(map(len, sets)))
    left = slice(0, cut if cut is not None else m)
    right = slice(cut or 0, m)
    rows, columns = left.stop, m - right.start
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(code, kind="stable")
    owner, many = owner[order], count[code[order]]
    out = np.zeros(rows * columns, np.int64)
    for f in np.unique(many[(many > 1) & (many < _DENSE)]):
        r = owner[many == f].reshape(-1, f)
        i, j = np.repeat(r, f, axis=1).ravel(), np.tile(r, (1, f)).ravel()
        ok = (i < left.stop) & (j >= right.start)
        out += np.bincount(i[ok] * columns + j[ok] - right.start, minlength=rows * columns)
    out = out.reshape(rows, columns)
    often = np.flatnonzero(count >= _DENSE)
    rank = np.full(len(count), -1)
    rank[often] = np.arange(len(often))
    at = rank[code]
    owner = np.repeat(np.arange(m), size)
    for k in range(0, len(often), 4096):
        here = (at >= k) & (at < k + 4096)
        x = np.zeros((m, min(4096, len(often) - k)), np.float32)
        x[owner[here], at[here] - k] = 1
        out += (x[left] @ x[right].T).astype(np.int64)
    if cut is None:
        out[np.arange(m), np.arange(m)] = size
    return out


def _counted(n: int, num: int, den: int):
    """Of rows g, id, side, weight, text: a, b, links. Verified links as a spanning forest (links null), and for every
    text the weight of the texts linked to it here (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, side, weight, text in _groups(batches):
            sets, keep, last = [], [], None
            for k, t in enumerate(text):
                if id_[k] != last:  # repeated rows of one id and text
                    last = id_[k]
                    sets.append(shingle_set(words_of(t), n))
                    keep.append(k)
            if len(keep) < 2:
                continue
            id_, side, weight = (np.array([x[k] for k in keep]) for x in (id_, side, weight))
            size = np.array(list(map(len, sets)))
            cut = int((side == 1).sum()) if side.any() else None
            if cut in (0, len(sets)):
                continue
            both = overlaps(sets, cut)
            left, right = size[:cut] if cut is not None else size, size[cut:] if cut is not None else size
            ok = den * both >= num * (left[:, None] + right[None, :] - both)
            if cut is None:
                np.fill_diagonal(ok, False)
                links = ok @ weight
                whole = ok
            else:
                links = np.concatenate([ok @ weight[cut:], weight[:cut] @ ok])
                whole = np.zeros((len(sets), len(sets)), bool)
                whole[:cut, cut:] = ok
                whole[cut:, :cut] = ok.T
            edges = _spanning(len(sets), np.zeros(len(sets), np.int8), lambda i, j, w=whole: w[i, j])
            hit = np.flatnonzero(links)
            a = np.concatenate([id_[[e[0] for e in edges]], id_[hit]]) if edges else id_[hit]
            b = pa.array([int(id_[e[1]]) for e in edges] + [None] * len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([a.astype(np.int64), b, pa.array([None] * len(edges) + links[hit].tolist(), pa.int64())], names=["a", "b", "links"])

    return run


def _meetings(df: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ``group``, in blocks ``mine`` of ``blocks``, once for each meeting of their block: g and side.

    Blocks i <= j meet in g; within i = j side is 0, else 1 in the lower block and 2 in the higher.
    """
    met = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    g = F.xxhash64(*group, F.least("mine", "other"), F.greatest("mine", "other"))
    return met.withColumns({"g": g, "side": side}).drop("mine", "other", "blocks")


def join_similar(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of ``n``-word shingles have Jaccard similarity num / den or more.

    One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and
    n_links: to how many other rows it is linked, copies of its own word sequence included.

    1. One reading of a text gives its set's size, name, bit sketch and signatures (see :func:`signatures`). Rows of one
       word sequence are one node, whatever their ids.
    2. Signatures are joined by value; equal sets of members count once. Within each, sizes and the Hamming distance of
       bit sketches decide who may be linked; what leaves a group is a spanning forest of that, never its pairs.
    3. Components of these forests hold every true link. Each component's whole texts come together, in blocks of
       bounded size that meet in pairs, and every pair is compared exactly; a spanning forest of the true links and the
       link counts come out.

    No cap on partners or candidates; links between different texts are all counted. Null or empty texts: size 0, no
    link, component is the own id. A null id links with nothing and has no component. Rows that share an id are nodes of
    their own wherever their words differ. Other columns are not read. Shingles and word sequences are compared by
    64-bit hashes.
    """
    return _joined(docs, n, num, den, id_col, text_col).select("doc_id", "n_shingles", F.coalesce("rep.doc_id", "doc_id").alias("component_id"), "n_links")


def _joined(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, rep (the smallest doc_id and text_hash of the component; null for no node), n_links."""
    spark = docs.sparkSession
    bands = Bands(num, den)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    short_batches(spark)
    first = save(rows.mapInArrow(released(_first(n, bands)), "doc_id bigint, text_hash bigint, n_shingles bigint, id bigint, sketch binary, sigs array<bigint>"))
    nodes = first.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = save(nodes.select("id", "rep.doc_id", "rep.text_hash", "weight", "n", "sketch"))
    meta = save(first.select("doc_id", "text_hash", "n_shingles", "id"))
    sigs = first.where("id IS NOT NULL").select("id", "sigs").mapInArrow(_spread, "sig bigint, id bigint")
    short_batches(spark, 10_000)
    runs = save(sigs.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(released(_runs), "sig bigint, k int, ids array<bigint>"))
    remove(first)

    whole = runs.where("k < 0").select("ids").distinct().select(F.xxhash64("ids").alias("g"), F.lit(0).alias("side"), "ids")
    long = runs.where("k >= 0").withColumnRenamed("k", "mine")
    long = _meetings(long.join(long.groupBy("sig").agg((F.max("mine") + 1).alias("blocks")), "sig"), ["sig"])
    met = whole.unionByName(long.select("g", "side", "ids")).select("g", "side", F.explode("ids").alias("id"))
    met = met.join(nodes.select("id", "n", "sketch"), "id").select("g", "id", "n", "side", "sketch")
    short_batches(spark, 1000)
    close = save(met.repartition("g").sortWithinPartitions("g", "side", "id").mapInArrow(released(_close(bands)), "a bigint, b bigint").distinct())
    remove(runs)
    maybe = components(close)

    sized = nodes.select("id", "doc_id", "text_hash", "weight", "n").join(maybe, "id")
    bulk = sized.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("texts"))
    blocks = F.greatest(F.ceil(F.col("total") / _SHINGLES), F.ceil(F.col("texts") / _TEXTS)).cast("int")
    units = sized.join(bulk.select("component", blocks.alias("blocks")), "component").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    texts = _meetings(rows.join(units, ["doc_id", "text_hash"]), ["component"]).select("g", "id", "side", "weight", "text")
    short_batches(spark, 128)
    counted = save(texts.repartition("g").sortWithinPartitions("g", "side", "id").mapInArrow(released(_counted(n, num, den)), "a bigint, b bigint, links bigint"))
    remove(close)

    joined = components(counted.where("b IS NOT NULL").select("a", "b"))
    rep = F.struct("doc_id", "text_hash")
    least = nodes.join(joined, "id").groupBy("component").agg(F.min(rep).alias("least"))
    placed = joined.join(least, "component").select("id", "least")
    links = counted.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known = nodes.select("id", rep.alias("own"), "weight").join(placed, "id", "left").join(links, "id", "left")
    known = known.select("id", F.coalesce("least", "own").alias("rep"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = meta.where("id IS NOT NULL").join(known, "id").select("doc_id", "text_hash", "n_shingles", "rep", "n_links")
    alone = meta.where("id IS NULL").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("struct<doc_id: bigint, text_hash: bigint>").alias("rep"), F.lit(0).cast("bigint").alias("n_links"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of :func:`join_similar`, the one of the smallest id; same columns.

    Documents without words are in no group and stay, and so do rows with a null id. Where texts of a group share its
    smallest id, the one of the smallest text hash stays; rows equal in id and text stay together.
    """
    groups = _joined(docs, n, num, den, id_col, text_col).where("rep IS NOT NULL")
    gone = groups.where("doc_id <> rep.doc_id OR text_hash <> rep.text_hash").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, (F.col(id_col) == F.col("_gone")) & (F.xxhash64(F.col(text_col)) == F.col("_hash")), "left_anti")
