"""Op 10. Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed values, in 2**20 places, of its lower-cased
words, of each word's beginnings (four and six bytes, for inflected forms), of word pairs
and of pairs with one word skipped. Training is online, with a learning rate for each
coordinate and L1 sparsity, so that the weights are a small sparse vector that every task
gets as a broadcast of at most 12 bytes for each of its places.

Training reads a bounded sample of labelled rows: at most MAX_POSITIVE and MAX_NEGATIVE,
chosen by a hash of their ids among those allowed, and in the order of that hash no more
once they hold MAX_PLACES features in all (4 bytes each; the row that reaches the bound is
the last). Online learning is a sequence, so one task does it; only the compact weights come
to the driver. The intercept is corrected to the share of positives among all allowed
labels. Every document is scored over its whole text.

Defined results: a null or empty text has no features and gets the intercept's score;
labels other than 0 and 1, or of unknown documents, are ignored, and repeated ones count
as often as they occur; without labels of both kinds all scores are the positives' share
(0.5 without any label); a null doc_id has no label and is not held out; repeated rows give repeated results; further columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textops

BITS = 20
MAX_POSITIVE, MAX_NEGATIVE, MAX_PLACES = 3000, 5000, 1 << 25
#: Chosen on one half of the rows that may be learnt from, fitted on the other.
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 8.0, 1.0, 10
THRESHOLD = 0.7
STEMS = (4, 6)

Weights = tuple[float, np.ndarray, np.ndarray]


def places(col: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each kind of feature the places of all occurrences and their rows; the number of rows."""
    buf, offsets = textops.as_bytes(pc.utf8_lower(col))
    starts, ends, row = textops.runs(buf, offsets, textops.WORD)
    word = textops.hashes(buf, starts, ends)
    kinds = [(word, row)]
    for k in STEMS:
        long = ends - starts > k
        kinds.append((textops.splitmix(textops.hashes(buf, starts[long], starts[long] + k) + np.uint64(k)), row[long]))
    for gap in (1, 2):
        if len(word) > gap:
            pair = textops.splitmix(word[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + word[gap:])
            same = row[:-gap] == row[gap:]
            kinds.append((pair[same], row[:-gap][same]))
    return [(h >> np.uint64(64 - BITS)).astype(np.int32) for h, _ in kinds], [r for _, r in kinds], len(offsets) - 1


def features(col: pa.Array) -> list[np.ndarray]:
    """The distinct places of each row, ascending."""
    at, rows, n = places(col)
    both = np.unique((np.concatenate(rows).astype(np.int64) << BITS) | np.concatenate(at))
    cuts = np.searchsorted(both >> BITS, np.arange(n + 1))
    low = (both & ((1 << BITS) - 1)).astype(np.int32)
    return [low[a:b] for a, b in zip(cuts, cuts[1:])]


def fit(samples: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Weights:
    """Intercept, places with a weight, and their weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    b, bn = 0.0, 0.0
    order = np.random.default_rng(seed)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(samples)):
            at = samples[i]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -30, 30))) - labels[i]
            root = np.sqrt(ni)
            ni = ni + g * g
            n[at] = ni
            z[at] = zi + g - (np.sqrt(ni) - root) / ALPHA * w
            bn += g * g
            b -= ALPHA / (BETA + np.sqrt(bn)) * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return float(b), at.astype(np.int32), w[at]


def score(col: pa.Array, bias: float, dense: np.ndarray) -> np.ndarray:
    """Probability for each row; each distinct feature counts once."""
    at, rows, n = places(col)
    hit = [dense[p] != 0 for p in at]
    both = np.unique(np.concatenate([(r[h].astype(np.int64) << BITS) | p[h] for p, r, h in zip(at, rows, hit)]))
    total = bias + np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _digit(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Weights:
    """Weights from a bounded sample of the labelled rows for which `allowed` (of doc_id) holds."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known if allowed is None else known.filter(allowed)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    drawn = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(most) for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                at = [x.tobytes() for x in features(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], batch.column(2)[a:b], pa.array(at, pa.binary())], names=["doc_id", "toxic", "h", "at"])

    chosen = F.broadcast(drawn[0].unionByName(drawn[1]).withColumn("h", order))  # MAX_POSITIVE + MAX_NEGATIVE rows at most
    table = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.col("toxic").cast("int"), "h", "text")
    rows = store.mapped(table, run, "doc_id long, toxic int, h long, at binary")
    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_learnt, "n0 long, n1 long, bias double, at binary, w binary").first()
    share = (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + counts.get(1, 0) + 1)
    prior = float(np.log(share / (1 - share)))
    if not found or not found["n0"] or not found["n1"]:
        return prior, np.zeros(0, np.int32), np.zeros(0)
    bias = found["bias"] + prior - float(np.log(found["n1"] / found["n0"]))
    return bias, np.frombuffer(found["at"], np.int32), np.frombuffer(found["w"], np.float64)


def _learnt(rows: pa.Table) -> pa.Table:
    """One row: numbers of rows of either label that were learnt, intercept, places and weights."""
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])
    samples, y, held = [], [], 0
    for x, label in zip(rows.column("at"), rows.column("toxic").to_pylist()):
        if held >= MAX_PLACES:
            break
        samples.append(np.frombuffer(x.as_buffer(), np.int32))
        y.append(label)
        held += len(samples[-1])
    n1 = sum(y)
    bias, at, w = fit(samples, np.array(y, np.float64)) if 0 < n1 < len(y) else (0.0, np.zeros(0, np.int32), np.zeros(0))
    return pa.table({"n0": [len(y) - n1], "n1": [n1], "bias": [bias], "at": pa.array([at.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})


def scored(docs: DataFrame, weights: Weights, keep: bool = False, below: float | None = None) -> DataFrame:
    """Every document's score; keep: with all columns of docs instead; below: only those that score less."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                got = score(texts[a:b], bias, dense)
                part = batch.slice(a, b - a)
                if not keep:
                    part = pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], names=["doc_id", "score"])
                yield part if below is None else part.filter(pa.array(got < below))

    if keep:
        return store.mapped(docs, run, docs.schema)
    return store.mapped(docs.select("doc_id", "text"), run, "doc_id long, score double")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, that score under the threshold; fitted on all labels."""
    return scored(docs, train(docs, labels), keep=True, below=threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = train(docs, labels, _digit(F.col("doc_id")) != 1)
    return scored(docs, weights).select("doc_id", F.coalesce(_digit(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
