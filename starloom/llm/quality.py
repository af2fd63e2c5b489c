"""Op 1. Quality by co-training a text view and a metadata view.

The text view sees what a text is made of: shares of letters, capitals, digits, symbols and
marks, word and line lengths, repetition of words and lines, each in one of BINS fixed
bins. The metadata view sees the columns lang, source and n_chars, each by itself and in
pairs, never the text. Each view is a naive Bayes classifier whose tables are counts over
documents that have a label or a pseudo-label. In every round each view gives the other
those documents without a label that it is most confident of: for each class the SHARE x
round of them (times the class's share of the labels) that score most for it. A pseudo-label
is soft: the giving view's calibrated probability, and counts as PSEUDO of UNIT as much as a
label. A view takes the new tables if the held-out fifth of the labels, which neither view
counts, is predicted no worse (log loss after Platt calibration) than by its old ones. At
the end a logistic regression on that fifth combines the two views' calibrated log-odds.

All counts are of fixed size, whatever the input: tasks count what they read, the counts
are summed and only sums come to the driver. Every document is scored.

Defined results: a null text counts as empty; null metadata is a value like others; labels
other than 0 and 1 are ignored and a document's repeated labels vote (ties: 1); without
labels of both kinds every score is the smoothed share of label 1; repeated rows give
repeated results; a null doc_id has no label; an empty table gives an empty result. Further
columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textops

ROUNDS, BINS, META_BINS = 4, 16, 1 << 10
TEXT_FEATURES, META_FEATURES = 18, 6
FOLDS = 5
#: Of the documents without a label, how many a view gives in each round more than before; weights of a label and a pseudo-label.
SHARE, UNIT, PSEUDO = 0.1, 16, 4
_EDGE, _STEP = 60, 0.25  # scores are kept as histograms of this half width and step

_KIND = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:'\"-()", b"!?", b"#$%&*@|~<>=^_{}[]\\/+`")):
    _KIND[[*_chars]] = _k
_KIND[128:] = 8
_LINE = np.ones(256, bool)
_LINE[10] = False


def _level(share: np.ndarray) -> np.ndarray:
    """Bin of a share in 0..1, finer near 0: 0 for none, then powers of two of 1/2048."""
    return np.clip(np.ceil(np.log2(np.maximum(share, 0) * 2048 + 1)), 0, BINS - 1)


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(h[a:b])) for a, b in zip(first, first[1:])], np.float64)


def _mix(part: np.ndarray) -> np.ndarray:
    """How many bytes there are of each kind."""
    return sum((np.bincount(_KIND[part[i : i + textops.WINDOW]], minlength=9) for i in range(0, len(part), textops.WINDOW)), np.zeros(9))


def text_bins(col: pa.Array) -> np.ndarray:
    """Rows x TEXT_FEATURES bins."""
    buf, offsets = textops.as_bytes(col)
    made = np.array([_mix(buf[a:b]) for a, b in zip(offsets, offsets[1:])], np.float64).reshape(-1, 9)
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, _ = textops.runs(buf, offsets, textops.WORD)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    words = np.maximum(n_words, 1)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    short = np.concatenate([[0], np.cumsum(ends - starts <= 3)])
    l_starts, l_ends, _ = textops.runs(buf, offsets, _LINE)
    l_first = np.searchsorted(l_starts, offsets)
    lines = np.maximum(np.diff(l_first), 1)
    letters = np.maximum(made[:, 0] + made[:, 1] + made[:, 8], 1)
    fresh = _distinct(textops.hashes(buf, starts, ends), first) / words
    new_lines = _distinct(textops.hashes(buf, l_starts, l_ends), l_first) / lines
    cols = [
        _level(made[:, 1] / letters),
        _level(made[:, 2] / size),
        _level(made[:, 3] / size),
        _level(made[:, 4] / size),
        _level(made[:, 5] / size),
        _level(made[:, 6] / size),
        _level(made[:, 7] / size),
        _level(made[:, 8] / size),
        np.clip(np.diff(lengths[first]) / words, 0, BINS - 1),
        np.clip(np.diff(short[first]) / words * BINS, 0, BINS - 1),
        np.clip(fresh * (BINS - 1), 0, BINS - 1),
        np.clip(new_lines * (BINS - 1), 0, BINS - 1),
        # joint bins: any kind of mark, and repetition against length
        _level(np.maximum(np.maximum(made[:, 5], made[:, 6]) / size, np.maximum(made[:, 1] / letters - 0.25, 0))),
        4 * np.clip(np.log2(words) / 2 - 1, 0, 3).astype(np.int64) + np.clip(fresh * 4, 0, 3).astype(np.int64),
        4 * np.clip(np.log2(lines), 0, 3).astype(np.int64) + np.clip(new_lines * 4, 0, 3).astype(np.int64),
        np.clip(np.log2(n_words + 1), 0, BINS - 1),
        np.clip(np.log2(n_words / lines + 1) * 2, 0, BINS - 1),
        np.clip(np.log2(lines), 0, BINS - 1),
    ]
    return np.stack(cols, axis=1).astype(np.uint8)


def bins(docs: DataFrame) -> DataFrame:
    """doc_id, t (text bins) and m (metadata bins) of every document."""
    length = F.coalesce(F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1) * 2), F.lit(-1)).cast("int")
    parts = [[F.col("lang")], [F.col("source")], [length], [F.col("lang"), F.col("source")], [F.col("lang"), length], [F.col("source"), length]]
    hashed = [F.pmod(F.xxhash64(F.lit(i), *c), F.lit(META_BINS)).cast("int") for i, c in enumerate(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                t = text_bins(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x.tobytes() for x in t], pa.binary()), batch.column(1)[a:b]], names=["doc_id", "t", "m"])

    return store.mapped(docs.select("doc_id", F.array(*hashed).alias("m"), "text"), run, "doc_id long, t binary, m array<int>")


class Model:
    """Log-odds tables of both views and their calibrations, and how the views are combined."""

    def __init__(self) -> None:
        self.tables = [np.zeros((TEXT_FEATURES, BINS)), np.zeros((META_FEATURES, META_BINS))]
        self.lines = [(0.0, 0.0), (0.0, 0.0)]  # Platt's slope and intercept for each view
        self.both = (1.0, 1.0, 0.0)  # weights of the views' log-odds, and intercept
        self.rounds: list[dict] = []  # what was exchanged: by round and view

    def raw(self, t: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        return [table[np.arange(len(table)), at].sum(axis=1) for table, at in zip(self.tables, (t, m))]

    def views(self, t: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        """Calibrated log-odds."""
        return [np.clip(a * x + b, -30, 30) for x, (a, b) in zip(self.raw(t, m), self.lines)]

    def combined(self, views: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.both[0] * views[0] + self.both[1] * views[1] + self.both[2], -60, 60)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(batch)
    t = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, TEXT_FEATURES)
    m = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, META_FEATURES)
    y = batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
    return t, m, y, batch.column(4).to_numpy(zero_copy_only=False)


Counts = tuple[np.ndarray, np.ndarray]  # keys (rows of four) and what each counts


def _summed(rows: DataFrame, count) -> dict[tuple[int, int, int, int], int]:
    """The sums over all batches of the (view, feature, bin, label) counts that count(batch) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts: list[Counts] = count(batch)
                keys, which = np.unique(np.concatenate([k for k, _ in parts]), axis=0, return_inverse=True)
                n = np.bincount(which.ravel(), weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys.T), pa.array(n)], names=["v", "f", "b", "y", "n"])

    got = store.mapped(rows, run, "v int, f int, b int, y int, n long").groupBy("v", "f", "b", "y").agg(F.sum("n").alias("n"))
    return {(r["v"], r["f"], r["b"], r["y"]): r["n"] for r in got.collect()}  # 2 x features x bins at most


def _keys(view: int, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Counts:
    n, k = at.shape
    return np.stack([np.full(n * k, view), np.tile(np.arange(k), n), at.ravel(), np.repeat(y, k)], axis=1).astype(np.int64), np.repeat(weight, k)


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(scores / _STEP), -_EDGE / _STEP, _EDGE / _STEP).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slopes (0 at least) for the columns of x and an intercept, by Newton's method on smoothed labels."""
    pos, neg = n[y == 1].sum(), n[y == 0].sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    use = list(range(x.shape[1]))
    while True:
        a = np.concatenate([x[:, use], np.ones((len(x), 1))], axis=1)
        ridge = np.diag([1e-3] * len(use) + [1e-9])
        w = np.zeros(a.shape[1])
        w[-1] = np.log((pos + 1) / (neg + 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (n * (p - goal)) + ridge @ w)
            w -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-7:
                break
        worst = min(range(len(use)), key=lambda i: w[i], default=None)
        if worst is None or w[worst] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*use, -1]] = w
            return out
        use.pop(worst)


def _loss(x: np.ndarray, y: np.ndarray, n: np.ndarray, line: tuple[float, float]) -> float:
    """Mean log loss of calibrated scores."""
    z = np.clip(line[0] * x + line[1], -30, 30)
    return float((n * np.logaddexp(0, np.where(y == 1, -z, z))).sum() / n.sum())


def thresholds(histogram: dict[int, int], share: float, positive: float) -> tuple[float, float]:
    """The bins at or below which class 0, and at or above which class 1, is given: `share` of all, dealt by the class's part."""
    out, total = [], sum(histogram.values())
    for sign, part in ((1, 1 - positive), (-1, positive)):
        reached, at = 0, None
        for b in sorted(histogram, key=lambda b: sign * b):
            if reached >= share * part * total:
                break
            reached, at = reached + histogram[b], b
        out.append(at if at is not None else -sign * np.inf)
    return out[0], out[1]


def log_odds(table: np.ndarray) -> np.ndarray:
    """From weighted counts by feature, bin and label; 0 for bins that were not met."""
    odds = (table + UNIT / 2) / (table.sum(axis=1, keepdims=True) + UNIT / 2 * table.shape[1])
    return np.log(odds[:, :, 1] / odds[:, :, 0]) * (table.sum(axis=2) > 0)


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[Model, float]:
    """The views after all rounds and the prior log-odds; rows: doc_id, t, m, y, fold."""
    model, spark = Model(), rows.sparkSession
    labelled = {r["y"]: r["n"] for r in rows.filter("y IS NOT NULL").groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((labelled.get(1, 0) + 0.5) / (labelled.get(0, 0) + 0.5)))
    if len(labelled) < 2:
        model.lines, model.both = [(0.0, prior)] * 2, (1.0, 1.0, -prior)
        return model, prior
    positive = labelled[1] / (labelled[0] + labelled[1])
    losses = [np.inf, np.inf]
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        given: list[tuple[float, float]] = [(-np.inf, np.inf)] * 2
        if r:

            def spread(batch: pa.RecordBatch) -> list[Counts]:
                t, m, _, _ = _read(batch)
                return [_keys(v, _bins(x)[:, None], np.zeros(len(x), np.int64), np.ones(len(x))) for v, x in enumerate(sent.value.raw(t, m))]

            free = _summed(rows.filter("y IS NULL"), spread)
            given = [thresholds({b: n for (w, _, b, _), n in free.items() if w == v}, SHARE * r, positive) for v in (0, 1)]

        def count(batch: pa.RecordBatch, given: list[tuple[float, float]] = given) -> list[Counts]:
            t, m, y, fold = _read(batch)
            raw, views = sent.value.raw(t, m), sent.value.views(t, m)
            own, out = (y >= 0) & (fold > 0), []
            for view, at in ((0, t), (1, m)):
                out.append(_keys(view, at[own], y[own], np.full(own.sum(), UNIT)))
                low, high = given[1 - view]
                sure = (y < 0) & ((_bins(raw[1 - view]) <= low) | (_bins(raw[1 - view]) >= high))
                p = np.rint(PSEUDO / (1 + np.exp(-views[1 - view][sure])))
                for label, weight in ((1, p), (0, PSEUDO - p)):
                    out.append(_keys(view, at[sure], np.full(len(p), label), weight))
                # feature -1 holds how many pseudo-labels the view was given
                out.append((np.stack([np.full(len(p), view), np.full(len(p), -1), np.zeros(len(p)), p * 2 >= PSEUDO], axis=1).astype(np.int64), np.ones(len(p))))
            return out

        made = [np.zeros((TEXT_FEATURES, BINS, 2)), np.zeros((META_FEATURES, META_BINS, 2))]
        got = [{0: 0, 1: 0}, {0: 0, 1: 0}]
        for (v, f, b, y), n in _summed(rows, count).items():
            if f < 0:
                got[v][y] = n
            else:
                made[v][f, b, y] = n
        next_ = Model()
        next_.tables, next_.rounds = [log_odds(x) for x in made], [*model.rounds]
        judged = spark.sparkContext.broadcast(next_)

        def histogram(batch: pa.RecordBatch) -> list[Counts]:
            t, m, y, _ = _read(batch)
            return [_keys(v, _bins(x)[:, None], y, np.ones(len(y))) for v, x in enumerate(judged.value.raw(t, m))]

        held = _summed(rows.filter("y IS NOT NULL AND fold = 0"), histogram)
        for v in (0, 1):
            mine = np.array(sorted((b * _STEP, y, n) for (w, _, b, y), n in held.items() if w == v), np.float64).reshape(-1, 3).T
            two = len(set(mine[1].tolist())) == 2
            line = tuple(map(float, _logistic(mine[0][:, None], mine[1], mine[2]))) if two else (1.0, prior)
            loss = _loss(*mine, line) if mine.shape[1] else 0.0
            better = loss <= losses[v]
            next_.rounds.append({"round": r, "view": ("text", "metadata")[v], "given_0": got[v][0], "given_1": got[v][1], "loss": loss, "taken": better})
            if better:
                next_.lines[v], losses[v] = line, loss
            else:
                next_.tables[v], next_.lines[v] = model.tables[v], model.lines[v]
        model = next_
    model.both = _combination(rows, model, prior)
    return model, prior


def _combination(rows: DataFrame, model: Model, prior: float) -> tuple[float, float, float]:
    """Weights of the two views' log-odds and an intercept, fitted on the held-out labels."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def pairs(batch: pa.RecordBatch) -> list[Counts]:
        t, m, y, _ = _read(batch)
        text, meta = (_bins(x) for x in sent.value.views(t, m))
        return [(np.stack([np.zeros(len(y)), text, meta, y], axis=1).astype(np.int64), np.ones(len(y)))]

    held = np.array(sorted((f * _STEP, b * _STEP, y, n) for (_, f, b, y), n in _summed(rows.filter("y IS NOT NULL AND fold = 0"), pairs).items()), np.float64).reshape(-1, 4).T
    if len(set(held[2].tolist())) < 2:
        return 1.0, 1.0, -prior
    return tuple(map(float, _logistic(held[:2].T, held[2], held[3])))


FIELDS = "doc_id long, score double, text_score double, metadata_score double, predicted int"


def views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's bins (t, m), label (y, null if none) and fold, as a written table."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.round(F.avg("quality")).cast("int").alias("y"))
    table = bins(docs).join(known, F.col("doc_id") == F.col("l_id"), "left")
    return store.written(table.select("doc_id", "t", "m", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")), "views")


def scored(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every document's score for label 1, the score by each view, and 1 where the score is 0.5 or more."""
    table = views(docs, labels)
    model, _ = train(table, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                t, m, _, _ = _read(batch)
                by_text, by_meta = sent.value.views(t, m)
                all_, a, b = (1 / (1 + np.exp(-x)) for x in (sent.value.combined([by_text, by_meta]), by_text, by_meta))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_), pa.array(a), pa.array(b), pa.array((all_ >= 0.5).astype(np.int32))], names=[x.split()[0] for x in FIELDS.split(", ")])

    return store.mapped(table, run, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, labels)
