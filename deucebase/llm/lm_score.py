"""LM scoring by masked pseudo-likelihood: a window network that sees both sides of every token."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deucebase.llm.common import free_shuffles, released, save, short_batches

OFFSETS = (-2, -1, 1, 2)
_CHUNK = 16_384
_ROWS = 1_024  # rows whose choices are worked out at once: they stay in the cache of a core
DEPTH = 2  # levels of the tree over the ids


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf8", "surrogatepass").lower().split()


@dataclass
class Vocabulary:
    """The most frequent words by name, all others by one of ``buckets`` hash buckets; then one id for the edge of a text.

    Ids fall with frequency, names and buckets together; they are the leaves of a tree of ``fan`` children a node. ``prior`` is the log of
    each id's share of all tokens. ``inside`` is log p(word | id): 0 for a name; for a bucket that of a word counted
    once: the log of a word's own count comes on top (:func:`own_logs`).
    """

    index: dict[bytes, int]
    bucket_ids: np.ndarray
    prior: np.ndarray
    inside: np.ndarray
    fan: int

    @property
    def edge(self) -> int:
        return len(self.prior)

    @property
    def dtype(self) -> type:
        return np.uint16 if self.edge < 1 << 16 else np.uint32

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the hashes of those that are not named."""
        get = self.index.get
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        other = np.flatnonzero(ids < 0)
        tail = hashes([words[k] for k in other])
        ids[other] = self.bucket_ids[tail % len(self.bucket_ids)]
        return ids.astype(self.dtype), tail


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, bucket hash, n) over all whole texts; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(hashes(list(c))), pa.array(list(c.values()), pa.int64())], names=["word", "h", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(tokens_of(t))
                if len(c) > 200_000:
                    yield out()
                    c.clear()
        if c:
            yield out()

    return docs.select(text_col).mapInArrow(released(run), "word binary, h bigint, n bigint").groupBy("word", "h").agg(F.sum("n").alias("n"))


def _fan(n: int) -> int:
    """Children of a node, so that ``DEPTH`` levels hold ``n`` ids."""
    return max(2, next(f for f in range(1, n + 3) if f**DEPTH >= n))


def build_vocabulary(counts: DataFrame, size: int = 4096, buckets: int = 512) -> Vocabulary:
    """Names for the ``size`` most frequent words or, where that is more, for twice the square root of the number of
    different words; ``buckets`` grow alike. Only these words, the bucket sums and the counts of counts reach the driver."""
    often = sorted(((r[0], r[1]) for r in counts.groupBy("n").count().collect()), reverse=True)
    names = max(size, math.ceil(2 * math.sqrt(sum(k for _, k in often))))
    buckets = buckets * names // size
    least, held = 0, 0
    for least, k in often:  # the count of the last word with a name
        held += k
        if held >= names:
            break
    top = sorted(((bytes(r[0]), r[1]) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(names).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))
    mass = np.zeros(len(top) + buckets)
    mass[: len(top)] = [n for _, n in top]
    for b, n in counts.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.sum("n").alias("n")).collect():
        mass[len(top) + b] = n
    np.subtract.at(mass, len(top) + hashes([w for w, _ in top]) % buckets, mass[: len(top)])
    mass = np.maximum(mass, 0)
    order = np.argsort(-mass, kind="stable")
    id_of = np.empty(len(mass), np.int64)
    id_of[order] = np.arange(len(mass))
    inside = np.zeros(len(mass), np.float32)
    inside[id_of[len(top) :]] = -np.log(np.maximum(mass[len(top) :], 1))
    prior = np.log((mass[order] + 0.5) / (mass + 0.5).sum()).astype(np.float32)
    return Vocabulary({w: int(id_of[i]) for i, (w, _) in enumerate(top)}, id_of[len(top) :], prior, inside, _fan(len(mass)))


def own_logs(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, own): the sum of log count over a text's words without a name; rows where it is 0 may be missing."""
    many = counts.where("n > 1").select("h", "n").hint("shuffle_hash")
    return coded.select("row", F.explode("tail").alias("h")).join(many, "h").groupBy("row").agg(F.sum(F.log("n")).alias("own"))


class WindowNet:
    """Embeddings per offset, summed, through tanh, to the token in the middle: down a tree over the ids in order, with a
    softmax over the ``fan`` children of every node on the way. All see both sides; at first they give the plain shares."""

    def __init__(self, vocabulary: Vocabulary, width: int = 16, seed: int = 3):
        r = np.random.default_rng(seed)
        prior, self.fan = vocabulary.prior, vocabulary.fan
        self.e = (r.standard_normal((len(OFFSETS), len(prior) + 1, width)) * 0.1).astype(np.float32)
        share = np.exp(prior.astype(np.float64))
        self.levels = []  # from the top: ids at a level, and by that number, weights and biases
        step = self.fan ** (DEPTH - 1)
        while step:
            c = np.log(np.add.reduceat(share, np.arange(0, len(share), step))) if len(share) else share
            self.levels.append((step, (r.standard_normal((len(c), width)) * 0.1).astype(np.float32), c.astype(np.float32)))
            step = step // self.fan if step > 1 else 0

    def _all(self) -> list[np.ndarray]:
        return [self.e, *(x for _, v, c in self.levels for x in (v, c))]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._all()])

    def load(self, flat: np.ndarray) -> WindowNet:
        at = 0
        for a in self._all():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.e[0], context[0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += np.take(self.e[k], context[k], axis=0)
        return np.tanh(h, out=h)

    def _choices(self, target: np.ndarray):
        """For every level: is it the top, the rows in order of their nodes (None: as they are), and of every node that some
        target passes the first of its run of these rows, the children, which child each row takes."""
        for step, v, c in self.levels:
            child = target // step
            parent = child // self.fan
            if len(c) <= self.fan:
                yield True, None, [(0, v, c, child)]
                continue
            order = np.argsort(parent.astype(np.uint16) if len(c) < 1 << 16 else parent, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(parent[order]) > 0, [True]]))
            child = child[order]
            first = (parent[order[cut[:-1]]] * self.fan).tolist()
            yield False, order, [(a, v[f : f + self.fan], c[f : f + self.fan], child[a:b] - f) for a, b, f in zip(cut[:-1], cut[1:], first, strict=True)]

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | context) of every row."""
        h, out = self.hidden(context), np.zeros(len(target), np.float32)
        for _, order, nodes in self._choices(target):
            ho = h if order is None else np.take(h, order, axis=0)
            p = np.empty(len(target), np.float32)
            for first, v, c, slot in nodes:
                for k in range(0, len(slot), _ROWS):
                    took = slot[k : k + _ROWS]
                    run = slice(first + k, first + k + len(took))
                    z = ho[run] @ v.T
                    z += c
                    p[run] = z[np.arange(len(took)), took] - _log_sum(z)
            out[slice(None) if order is None else order] += p
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        h = self.hidden(context)
        gh = np.zeros_like(h)
        for top, order, nodes in self._choices(target):  # v and c are views
            ho = h if order is None else np.take(h, order, axis=0)
            back = np.empty_like(h)
            for first, v, c, slot in nodes:
                gv, gc = np.zeros_like(v), np.zeros_like(c)
                for k in range(0, len(slot), _ROWS):
                    took = slot[k : k + _ROWS]
                    run = slice(first + k, first + k + len(took))
                    hc = ho[run]
                    g = hc @ v.T
                    g += c
                    _shares(g)
                    g[np.arange(len(took)), took] -= 1
                    np.matmul(g, v, out=back[run])
                    gv += g.T @ hc
                    gc += g.sum(0)
                pace = np.float32(rate / (len(slot) + (0 if top else 16)))  # a lower node is met by a part of the batch
                v -= pace * gv
                c -= pace * gc
            gh[slice(None) if order is None else order] += back
        for _, v, _c in self.levels:
            np.clip(v, -_MOST, _MOST, out=v)
        h *= h
        np.subtract(1, h, out=h)
        gh *= h
        gh *= np.float32(-rate / 20)  # embeddings are touched rarely; their steps are not averaged over the batch
        for k in range(len(OFFSETS)):  # rows of one id are summed first: scattered sums are several times slower
            ids = context[k]
            order = np.argsort(ids.astype(np.uint16) if self.e.shape[1] < 1 << 16 else ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            self.e[k][ids[first]] += np.add.reduceat(np.take(gh, order, axis=0), first)


#: Weights stay within this bound, so that sums over the 16 or so hidden units, each within 1, never overflow exp.
_MOST = np.float32(4)


def _log_sum(z: np.ndarray) -> np.ndarray:
    """log of the sum of exp of every row; ``z`` is not kept."""
    return np.log(np.exp(z).sum(1))


def _shares(z: np.ndarray) -> None:
    """Softmax of every row, in place."""
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)


def _masked(n: np.ndarray, shard: int, every: int, turn: int, rounds: int) -> np.ndarray:
    """Which positions of texts of ``n`` tokens, one after the other, are targets in round ``turn``: over ``rounds`` rounds
    each at least once."""
    mine = np.zeros(every, bool)
    mine[turn % every :: rounds] = True
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mine[(at + np.repeat(n * 7 + shard, n)) % every]


def _windows(texts: list[np.ndarray], edge: int, which=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: ids, what stands at each of OFFSETS (rows) around every token, tokens a text; of all
    tokens or of those that ``which`` picks by the lengths of the texts."""
    n = np.array([len(t) for t in texts], np.int64)
    reach = max(OFFSETS)
    rim = np.full(reach, edge, np.int64)
    padded = np.concatenate([x for t in texts for x in (rim, t)] + [rim]).astype(np.int64)
    place = np.arange(n.sum()) + np.repeat(reach * np.arange(1, len(n) + 1), n)
    if which is not None:
        place = place[which(n)]
    return padded[place], padded[np.array(OFFSETS)[:, None] + place], n


def _train(shared, every: int, turn: int, rounds: int, rate: float, batch: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, width = shared.value
        net = WindowNet(vocabulary, width)
        shard, seen = None, 0
        texts, held = [], 0

        def out():
            parts = np.array_split(net.flat(), blocks)
            return pa.RecordBatch.from_arrays([np.arange(blocks, dtype=np.int32), np.full(blocks, shard, np.int64), np.full(blocks, float(seen)), pa.array(parts, pa.list_(pa.float32()))], names=["block", "shard", "weight", "params"])

        def learn():
            ids, around, _ = _windows(texts, vocabulary.edge, lambda n: _masked(n, shard, every, turn, rounds))
            for k in range(0, len(ids), batch):
                net.step(around[:, k : k + batch], ids[k : k + batch], rate)
            return len(ids)

        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != shard:
                    if held:
                        seen += learn()
                    if shard is not None and seen:
                        yield out()
                    net.load(flat)
                    shard, seen, texts, held = s, 0, [], 0
                texts.append(np.frombuffer(raw, vocabulary.dtype))
                held += len(texts[-1])
                if held >= 16 * batch:
                    seen += learn()
                    texts, held = [], 0
        if held:
            seen += learn()
        if shard is not None and seen:
            yield out()

    return run


def _mean(key, g):  # no hints: Spark reads them as another kind of function
    w = g["weight"].to_numpy()
    total = sum(x * np.asarray(p.as_py(), np.float64) for x, p in zip(w, g["params"], strict=True))
    return pa.table({"block": g["block"][:1], "shard": pa.array([key[1].as_py()], pa.int64()), "weight": pa.array([w.sum()]), "params": pa.array([(total / w.sum()).astype(np.float32)], pa.list_(pa.float32()))})


def _averaged(parts: DataFrame, shards: int, fan: int = 16) -> np.ndarray:
    """The weighted mean of all shards' parameters, ``fan`` at a time, so that no task holds more than that many parts."""
    ddl = "block int, shard bigint, weight double, params array<float>"
    parts = save(parts)
    while shards > 1:
        shards = -(-shards // fan)
        parts = save(parts.withColumn("to", F.floor(F.col("shard") / fan).cast("bigint")).groupBy("block", "to").applyInArrow(_mean, ddl))
    got = sorted((r[0], r[1]) for r in parts.select("block", "params").collect())
    return np.concatenate([np.asarray(p, np.float32) for _, p in got]) if got else np.zeros(0, np.float32)


def summed(net: WindowNet, vocabulary: Vocabulary, texts: Iterator[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Tokens and summed log p of every text; short texts share a chunk."""
    size, total, held, waiting = [], [], [], 0

    def flush():
        ids, around, n = _windows(held, vocabulary.edge)
        p = np.empty(len(ids))
        for k in range(0, len(ids), _CHUNK):
            at = slice(k, k + _CHUNK)
            p[at] = net.log_p(around[:, at], ids[at])
        p += vocabulary.inside[ids]
        total.append(np.bincount(np.repeat(np.arange(len(n)), n), p, len(n)))
        size.extend(n.tolist())
        held.clear()

    for ids in texts:
        held.append(ids)
        waiting += len(ids)
        if waiting >= 4 * _CHUNK:
            flush()
            waiting = 0
    if held:
        flush()
    return size, np.concatenate(total) if total else np.zeros(0)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, width = shared.value
        net = WindowNet(vocabulary, width).load(flat)
        for b in batches:
            size, total = summed(net, vocabulary, (np.frombuffer(raw, vocabulary.dtype) for raw in b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(total, pa.float64())], names=["row", "doc_id", "n_tokens", "log_likelihood"])

    return run


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, shard_docs: int = 4096, every: int = 8, rate: float = 2.0, batch: int = 8192, width: int = 16, size: int = 4096, buckets: int = 512) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, score: one row per input row.

    log_likelihood is the sum over all tokens of log p(token | the two tokens on either side); score is its mean a
    token, 0 for a text without tokens (null, empty, white space). The network learns from the corpus itself: word
    counts over all texts stay in a table; the most frequent give the network's vocabulary, at least ``size`` words and
    ``buckets`` buckets, which grow with the number of different words. A named word's probability is the network's own,
    from both sides; for a word without a name that of its bucket, times the word's share of the bucket by its own
    count, which is joined in (words meet there by 64-bit hash). In each round every shard of about ``shard_docs`` documents
    (more as the vocabulary grows) trains the network on masked tokens of each of its texts, and the shards' parameters
    are averaged by tokens. A text's positions are dealt into ``every`` residues and these over the ``rounds``, so that
    every token of every text is learned from, once where ``rounds`` is at most ``every``. Shards go by a hash of the id, so the result does not hang on partitions, and a hot source is spread out.

    Repeated rows count each time. A null id is an id like any other. Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counts = save(word_counts(rows))
    vocabulary = build_vocabulary(counts, size, buckets)
    words = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [words.value.encode(tokens_of(t)) for t in b.column(1).to_pylist()]
            ids, tail = pa.array([x.tobytes() for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), ids, tail], names=["row", "doc_id", "ids", "tail"])

    coded = save(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(released(run), "row bigint, doc_id bigint, ids binary, tail array<bigint>"))
    own = save(own_logs(coded, counts))
    free_shuffles(spark)
    # Each shard writes all parameters: shards grow with the vocabulary, so that what they write keeps pace with the input.
    shards = max(1, -(-coded.count() // (shard_docs * max(size + buckets, vocabulary.edge) // (size + buckets))))
    placed = coded.select(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(shards)).alias("shard"), F.xxhash64(F.lit(18), "doc_id").alias("h"), "ids")
    flat = WindowNet(vocabulary, width).flat()
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, flat, width))
        dealt = placed.repartition("shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        parts = dealt.mapInArrow(released(_train(shared, every, r, rounds, rate / (1 + r), batch, 16)), "block int, shard bigint, weight double, params array<float>")
        new = _averaged(parts, shards)
        flat = new if len(new) else flat
    shared = spark.sparkContext.broadcast((vocabulary, flat, width))
    out = coded.select("row", "doc_id", "ids").mapInArrow(released(_scored(shared)), "row bigint, doc_id bigint, n_tokens bigint, log_likelihood double")
    out = out.join(own, "row", "left").select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("own", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).otherwise(0.0))
