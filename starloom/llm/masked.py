"""Op 6. Masked pseudo-likelihood of a bidirectional window network.

A token is a lower-cased word. The network sees the SIDE tokens on either side of a place,
never the token itself: tanh of the sum of their embeddings by place. It predicts the token
in two softmaxes, of its class and of the word in the class, both learnt and both seeing the
context. The vocabulary is the most frequent words, twice the square root of the number of
distinct words of the corpus (LEAST_WORDS to MOST_WORDS): the HEAD most frequent in classes
of HEAD_SIZE, the others in about as many classes as half a class has words. All other words
are of TAILS classes by the hash of their last two bytes, and divide their class evenly.
Word counts are of the whole corpus. A document's score is the sum of
log P(token | both sides) over all its tokens.

Training (numpy): documents are dealt by a hash of id and text to shards, whose number
follows the corpus, and lie in a shard by that hash. In every round each shard starts from
the current network and learns by Adagrad one place in ROUNDS of all its documents, each
place in one round; the networks of all shards are averaged, weighted by places. Parameters
travel in slices that are summed in two steps, so no task and not the driver holds more than
one network and one step's share. What is learnt does not depend on how Spark cuts the
input, nor on the order of its rows; scores then differ by the rounding of sums at most.

Defined results: a null or text without words has no tokens, log_prob 0 and null perplexity;
a null doc_id is a row like others; repeated rows give repeated results; an empty table
gives an empty result; further columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textops

LEAST_WORDS, MOST_WORDS, TAILS = 1024, 1 << 15, 16
HEAD, HEAD_SIZE = 256, 32
SIDE, HIDDEN = 2, 16
ROUNDS, BATCH, RATE = 4, 1 << 13, 0.2
#: Tokens that are laid out at a time; tokens of a shard, and shards at least; slices of a network and shards summed together.
LOT, SHARD_TOKENS, MIN_SHARDS = 1 << 15, 1 << 24, 24
SLICES, STEP = 32, 64
_OFFSETS = [d for d in range(-SIDE, SIDE + 1) if d]


class Tier(NamedTuple):
    """Words of neighbouring ids in classes of equal size: the first id and class, and how many there are."""

    word: int
    words: int
    klass: int
    classes: int
    size: int


class Words(NamedTuple):
    """The vocabulary: hashes ascending and their ids, which are ranks by frequency.

    Ids from `known` on are the TAILS, and `pad` stands beside a text. By id: class, place in
    the class, and log share (of a tail's single words; 0 for words). Counts by id, for the start.
    """

    h: np.ndarray
    ids: np.ndarray
    known: int
    pad: int
    tiers: tuple[Tier, ...]
    klass: np.ndarray
    member: np.ndarray
    share: np.ndarray
    counts: np.ndarray


class Net(NamedTuple):
    """Embeddings by place, hidden bias; weights and bias of classes, and of words in each tier's classes."""

    e: np.ndarray
    b: np.ndarray
    u: np.ndarray
    c: np.ndarray
    u0: np.ndarray
    c0: np.ndarray
    u1: np.ndarray
    c1: np.ndarray


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail of every word, and each row's first word."""
    buf, offsets = textops.as_bytes(pc.utf8_lower(col))
    starts, ends, _ = textops.runs(buf, offsets, textops.WORD)
    last = buf[ends - 1].astype(np.uint64) * np.uint64(257) + np.where(ends - starts > 1, buf[ends - 2], 0).astype(np.uint64)
    return textops.hashes(buf, starts, ends), (textops.splitmix(last) % np.uint64(TAILS)).astype(np.int32), np.searchsorted(starts, offsets)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, tail, n: how often each word occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts, 1 << 20):
                h, tail, _ = tokens(texts[a:b])
                own, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(tail[at]), pa.array(n, pa.int64())], names=["h", "tail", "n"])

    return store.mapped(docs.select("text"), run, "h long, tail int, n long").groupBy("h", "tail").agg(F.sum("n").alias("n"))


def tiers_of(known: int) -> tuple[Tier, Tier]:
    """How ids 0 to known - 1 are dealt to classes."""
    head = min(known, HEAD)
    first = Tier(0, head, 0, -(-head // HEAD_SIZE), HEAD_SIZE)
    rest = known - head
    size = 2 * isqrt(2 * rest)
    return first, Tier(head, rest, first.classes, -(-rest // size) if rest else 0, size)


def vocabulary(docs: DataFrame) -> tuple[Words, int]:
    """The words of the corpus, and its number of tokens."""
    counts = store.written(word_counts(docs), "word-counts")
    tails = {r["tail"]: (r["n"], r["types"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}  # TAILS rows
    types = sum(x for _, x in tails.values())
    top = counts.orderBy(F.desc("n"), "h").limit(min(MOST_WORDS, max(LEAST_WORDS, 2 * isqrt(types)))).collect()  # MOST_WORDS rows at most
    store.removed(counts)
    known, tiers = len(top), tiers_of(len(top))
    n, share = np.zeros(known + TAILS + 1), np.zeros(known + TAILS + 1)
    n[:known] = [r["n"] for r in top]
    for t in range(TAILS):
        mine = [r["n"] for r in top if r["tail"] == t]
        total, kinds = tails.get(t, (0, 0))
        n[known + t], share[known + t] = total - sum(mine), -np.log(max(1, kinds - len(mine)))
    klass, member = np.zeros(known + TAILS + 1, np.int64), np.zeros(known + TAILS + 1, np.int64)
    for t in tiers:
        at = np.arange(t.words)
        klass[t.word : t.word + t.words], member[t.word : t.word + t.words] = t.klass + at // t.size, at % t.size
    klass[known : known + TAILS] = tiers[1].klass + tiers[1].classes + np.arange(TAILS)
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Words(h[order], order.astype(np.int64), known, known + TAILS, tiers, klass, member, share, n), sum(x for x, _ in tails.values())


def ids_of(words: Words, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    out = words.known + tail.astype(np.int64)
    if len(words.h):
        at = np.minimum(np.searchsorted(words.h, h), len(words.h) - 1)
        known = words.h[at] == h
        out[known] = words.ids[at[known]]
    return out.astype(np.uint16)


def encoded(docs: DataFrame, words: Words, shards: int) -> DataFrame:
    """doc_id, ids of its words (16-bit, as bytes), shard and h (its place in the shard), dealt by shard."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                h, tail, first = tokens(texts[a:b])
                ids = ids_of(sent.value, h, tail)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([ids[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary()), batch.column(1)[a:b]], names=["doc_id", "ids", "h"])

    rows = store.mapped(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text"), run, "doc_id long, ids binary, h long")
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "doc_id", "ids")


def start(words: Words, seed: int = 5) -> Net:
    """Small random weights; the biases make it the corpus's share of every word."""
    rng = np.random.default_rng(seed)
    total = words.tiers[1].klass + words.tiers[1].classes + TAILS
    n = words.counts[: words.pad] + 0.5
    by_class = np.bincount(words.klass[: words.pad], weights=n, minlength=total)
    by_class[by_class == 0] = 0.5
    e = rng.normal(0, 0.3, (len(_OFFSETS), words.pad + 1, HIDDEN))
    u = rng.normal(0, 0.05, (HIDDEN, total))
    parts = [e, np.zeros(HIDDEN), u, np.log(by_class / by_class.sum())]
    for t in words.tiers:
        c = np.full(t.classes * t.size, -1e4)
        own = np.arange(t.word, t.word + t.words)
        c[: t.words] = np.log(n[own] / by_class[words.klass[own]])
        parts += [rng.normal(0, 0.05, (t.classes, HIDDEN, t.size)), c.reshape(t.classes, t.size)]
    return Net(*(x.astype(np.float32) for x in parts))


class Lot(NamedTuple):
    """Some rows' ids with SIDE pads before and after each; the places of tokens, less SIDE; row sizes."""

    ids: np.ndarray
    at: np.ndarray
    sizes: np.ndarray


def lot(rows: list[np.ndarray], pad: int) -> Lot:
    gap = np.full(SIDE, pad, np.uint16)
    sizes = np.array([len(x) for x in rows], np.int64)
    return Lot(np.concatenate([gap, *(p for x in rows for p in (x, gap))]), np.arange(sizes.sum()) + np.repeat(SIDE * np.arange(len(rows)), sizes), sizes)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities in place; each row's log normaliser."""
    top = z.max(axis=1, keepdims=True)
    z -= top
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    z /= total
    return (np.log(total) + top)[:, 0]


def _hidden(net: Net, around: list[np.ndarray]) -> np.ndarray:
    total = net.e[0].take(around[0], axis=0)
    for k in range(1, len(around)):
        total += net.e[k].take(around[k], axis=0)
    total += net.b
    return np.tanh(total, out=total)


class Members(NamedTuple):
    """The places of a batch whose words a tier holds, by class: places, class in the tier, where each class begins, hidden states, logits."""

    at: np.ndarray
    klass: np.ndarray
    cuts: list[tuple[int, int, int]]
    hidden: np.ndarray
    logits: np.ndarray


def _members(words: Words, t: Tier, u: np.ndarray, c: np.ndarray, hidden: np.ndarray, own: np.ndarray) -> Members:
    at = np.flatnonzero((own >= t.word) & (own < t.word + t.words))
    klass = (words.klass[own[at]] - t.klass).astype(np.uint16)
    order = np.argsort(klass, kind="stable")
    at, klass = at[order], klass[order]
    edge = np.searchsorted(klass, np.arange(t.classes + 1))
    cuts = [(k, a, b) for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if a < b]
    mine = hidden.take(at, axis=0)
    logits = c.take(klass, axis=0)
    for k, a, b in cuts:
        logits[a:b] += mine[a:b] @ u[k]
    return Members(at, klass, cuts, mine, logits)


class Learner:
    """Adagrad on a copy of a network."""

    def __init__(self, net: Net, words: Words):
        self.words = words
        self.net = Net(*(x.copy() for x in net))
        self.square = Net(*(np.full_like(x, 1e-6) for x in net))
        self.places = 0

    def gradients(self, around: list[np.ndarray], own: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Of the mean of -log P: by parameter, and by place for the sum of embeddings."""
        net, words, n = self.net, self.words, len(own)
        hidden = _hidden(net, around)
        p = hidden @ net.u
        p += net.c
        _softmax(p)
        p[np.arange(n), words.klass[own]] -= 1
        p *= np.float32(1 / n)
        back, out = p @ net.u.T, {2: hidden.T @ p, 3: p.sum(axis=0)}
        for i, t in enumerate(words.tiers):
            if not t.classes:
                continue
            u = net[4 + 2 * i]
            m = _members(words, t, u, net[5 + 2 * i], hidden, own)
            z = m.logits
            _softmax(z)
            z[np.arange(len(z)), words.member[own[m.at]]] -= 1
            z *= np.float32(1 / n)
            gu, gc, more = np.zeros_like(u), np.zeros_like(net[5 + 2 * i]), np.empty_like(m.hidden)
            for k, a, b in m.cuts:
                gu[k] = m.hidden[a:b].T @ z[a:b]
                gc[k] = z[a:b].sum(axis=0)
                np.matmul(z[a:b], u[k].T, out=more[a:b])
            back[m.at] += more
            out[4 + 2 * i], out[5 + 2 * i] = gu, gc
        hidden *= hidden
        back *= 1 - hidden
        out[1] = back.sum(axis=0)
        return out, back

    def learn(self, around: list[np.ndarray], own: np.ndarray) -> None:
        self.places += len(own)
        dense, back = self.gradients(around, own)
        for k, grad in dense.items():
            self.square[k][...] += grad * grad
            self.net[k][...] -= RATE * grad / np.sqrt(self.square[k])
        for k, ids in enumerate(around):
            order = np.argsort(ids, kind="stable")
            found = ids[order]
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            grad, rows = np.add.reduceat(back.take(order, axis=0), first, axis=0), found[first]
            square = self.square.e[k].take(rows, axis=0) + grad * grad
            self.square.e[k][rows] = square
            self.net.e[k][rows] -= RATE * grad / np.sqrt(square)


def _around(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ids around each place of a padded array; at counts without the padding."""
    return [ids[at + SIDE + d] for d in _OFFSETS]


def _slices(net: Net) -> list[np.ndarray]:
    return np.array_split(np.concatenate([x.ravel() for x in net]), SLICES)


def _network(flat: np.ndarray, like: Net) -> Net:
    cuts = np.cumsum([x.size for x in like])[:-1]
    return Net(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, cuts), like)))


def _added(table: pa.Table, key: str) -> pa.Table:
    """The sum of networks' slices, each times its places, in the order of shards or steps."""
    table = table.sort_by([("shard", "ascending")])
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("x"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "shard": table.column(key).slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())})


def lots(batches: Iterator[pa.RecordBatch], pad: int) -> Iterator[tuple[int, pa.Array, Lot]]:
    """Shard, ids and lot of rows of a shard, up to the row that reaches LOT tokens, wherever batches end."""
    held: list[tuple[object, np.ndarray]] = []
    size, now = 0, None

    def made() -> tuple[int, pa.Array, Lot]:
        return now, [x for x, _ in held], lot([x for _, x in held], pad)

    for batch in batches:
        for doc, ids, shard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            if held and (shard != now or size >= LOT):
                yield made()
                held, size = [], 0
            now = shard
            held.append((doc, np.frombuffer(ids.as_buffer(), np.uint16)))
            size += len(held[-1][1]) + 1
    if held:
        yield made()


def train(rows: DataFrame, words: Words, rounds: int = ROUNDS) -> Net:
    """The network after all rounds over rows (doc_id, ids, shard)."""
    net = start(words)
    kind = "slice int, shard int, n long, x binary"
    for r in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((net, words))

        def told(learner: Learner, shard: int) -> pa.RecordBatch:
            x = [(p.astype(np.float64) * learner.places).tobytes() for p in _slices(learner.net)]
            return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([shard] * SLICES, pa.int32()), pa.array([learner.places] * SLICES, pa.int64()), pa.array(x, pa.binary())], names=["slice", "shard", "n", "x"])

        def run(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            first, own = sent.value
            learner, now = None, None
            for shard, _, some in lots(batches, own.pad):
                if shard != now:
                    if learner and learner.places:
                        yield told(learner, now)
                    learner, now = Learner(first, own), shard
                at = some.at[r % ROUNDS :: ROUNDS]
                for i in range(0, len(at), BATCH):
                    places = at[i : i + BATCH]
                    learner.learn(_around(some.ids, places), some.ids[places + SIDE].astype(np.int64))
            if learner and learner.places:
                yield told(learner, now)

        # two steps: the second sums what STEP groups of shards gave
        some = store.mapped(rows, run, kind).withColumn("step", F.pmod("shard", F.lit(STEP)))
        some = some.groupBy("slice", "step").applyInArrow(lambda t: _added(t, "step"), kind)
        parts = sorted((x["slice"], x["n"], x["x"]) for x in some.groupBy("slice").applyInArrow(lambda t: _added(t, "shard"), kind).collect())  # one network
        sent.unpersist()
        if not parts:
            break
        net = _network(np.concatenate([np.frombuffer(x, np.float64) / n for _, n, x in parts]), net)
    return net


def log_probs(net: Net, words: Words, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(token | its sides) at each place."""
    out = np.zeros(len(at))
    for i in range(0, len(at), BATCH):
        places = at[i : i + BATCH]
        own = ids[places + SIDE].astype(np.int64)
        hidden = _hidden(net, _around(ids, places))
        z = hidden @ net.u
        z += net.c
        got = z[np.arange(len(own)), words.klass[own]].astype(np.float64)
        got += words.share[own] - _normaliser(z)
        for k, t in enumerate(words.tiers):
            if t.classes:
                m = _members(words, t, net[4 + 2 * k], net[5 + 2 * k], hidden, own)
                got[m.at] += m.logits[np.arange(len(m.at)), words.member[own[m.at]]] - _normaliser(m.logits)
        out[i : i + BATCH] = got
    return out


def _normaliser(z: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row, which are lost; the logits are small."""
    top = z.max(axis=1, keepdims=True) if z.size else z[:, :1]
    return np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]


FIELDS = "doc_id long, n_tokens long, log_prob double, mean_log_prob double, perplexity double"


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every document's summed and mean log-probability and pseudo-perplexity."""
    words, total = vocabulary(docs)
    rows = store.written(encoded(docs, words, max(MIN_SHARDS, total // SHARD_TOKENS)), "ids").select("doc_id", "ids", "shard")
    sent = docs.sparkSession.sparkContext.broadcast((train(rows, words, rounds), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, own = sent.value
        for _, ids, some in lots(batches, own.pad):
            sizes = some.sizes
            total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=log_probs(net, own, some.ids, some.at), minlength=len(sizes)).astype(np.float64)
            empty = sizes == 0
            mean = total / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(total), pa.array(mean, mask=empty), pa.array(np.exp(-mean), mask=empty)], names=[x.split()[0] for x in FIELDS.split(", ")])

    return store.mapped(rows, run, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
