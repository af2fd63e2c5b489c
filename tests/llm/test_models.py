import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.llm import masked, quality, toxicity

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4), spark.read.parquet(f"{SF}/labels.parquet")


def auc(scores, y):
    order = np.argsort(np.argsort(scores))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("sf", [SF, LARGE])
def test_toxicity_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in toxicity.query(spark, sf).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    held = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    y = np.array([t for _, t in held])
    # the smaller table has some 30 toxic documents to learn from
    assert auc(np.array([r["score"] for r, _ in held]), y) > (0.95 if sf == LARGE else 0.9)
    assert np.mean([r["predicted"] == t for r, t in held]) > 0.9
    clean = [r["predicted"] for r, t in held if t == 0]
    assert np.mean(clean) < 0.03


def test_toxicity_scores_do_not_know_the_label_side(spark, tables):
    docs, labels = tables
    few = docs.filter("doc_id < 300")
    w = toxicity.train(few, labels)
    a = {r["doc_id"]: r["score"] for r in toxicity.scored(few, w).collect()}
    other = few.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    assert a == {r["doc_id"]: r["score"] for r in toxicity.scored(other, w).collect()}


def test_toxicity_edges(spark, make_docs):
    docs = make_docs([None, "", "word"]).withColumnRenamed("lang", "toxic")
    labels = spark.createDataFrame([(0, 1), (2, 0), (9, 1), (None, 1), (2, 5)], "doc_id long, toxic int")
    w = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, w).collect()}
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.kept(docs, labels.limit(0)).count() == 3
    assert toxicity.kept(docs.limit(0), labels).count() == 0


def test_ftrl_steps_by_hand(monkeypatch):
    """The proximal steps of two coordinates, one sample after another, in plain Python."""
    monkeypatch.setattr(toxicity, "L1", 0.05)
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    samples, y = [np.array([3], np.int32), np.array([3, 8], np.int32), np.array([8], np.int32)], np.array([1.0, 0.0, 0.0])
    z, n, b, bn = {3: 0.0, 8: 0.0}, {3: 0.0, 8: 0.0}, 0.0, 0.0

    def weight(j):
        if abs(z[j]) <= 0.05:
            return 0.0
        return -(z[j] - 0.05 * (1 if z[j] > 0 else -1)) / ((toxicity.BETA + n[j] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(3):
            w = {j: weight(j) for j in samples[i].tolist()}
            g = 1 / (1 + np.exp(-(b + sum(w.values())))) - y[i]
            for j, wj in w.items():
                sigma = ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / toxicity.ALPHA
                z[j] += g - sigma * wj
                n[j] += g * g
            bn += g * g
            b -= toxicity.ALPHA / (toxicity.BETA + bn**0.5) * g
    bias, at, w = toxicity.fit(samples, y)
    assert bias == pytest.approx(b) and dict(zip(at.tolist(), w)) == pytest.approx({j: weight(j) for j in z if weight(j)})


def test_score_equals_dense_sum():
    rng = np.random.default_rng(0)
    dense = np.where(rng.random(1 << toxicity.BITS) < 0.5, rng.normal(size=1 << toxicity.BITS), 0.0)
    texts = pa.array(["one two three one two", "", "Übermäßig groß"])
    found = toxicity.features(texts)
    want = [1 / (1 + np.exp(-(0.25 + dense[f].sum()))) for f in found]
    assert toxicity.score(texts, 0.25, dense) == pytest.approx(want)


def test_quality_held_out(spark, tables):
    docs, labels = tables
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learn = labels.filter(F.col("doc_id") % 3 != 0)
    rows = {r["doc_id"]: r for r in quality.scored(docs, learn).collect()}
    assert len(rows) == docs.count()
    held = [(rows[i], y) for i, y in known.items() if i % 3 == 0]
    y = np.array([t for _, t in held])
    both = auc(np.array([r["score"] for r, _ in held]), y)
    assert both > 0.8
    assert np.mean([r["predicted"] == t for r, t in held]) > max(y.mean(), 1 - y.mean()) - 0.02


def test_quality_round_by_hand(spark, tables):
    """Tables, exchange and calibration inputs of two rounds, counted in plain Python."""
    docs, labels = tables
    rows = quality.views(docs, labels.filter("doc_id % 2 = 0"))
    first, second = quality.train(rows, 1)[0], quality.train(rows, 2)[0]
    table = [(tuple(r["t"]), tuple(r["m"]), r["y"], r["fold"]) for r in rows.collect()]
    known = [r for r in table if r[2] is not None and r[3] > 0]

    def odds(counts, features, bins):
        out = np.zeros((features, bins))
        for f in range(features):
            total = [sum(n for (g, _, y), n in counts.items() if (g, y) == (f, label)) for label in (0, 1)]
            for b in range(bins):
                n0, n1 = counts.get((f, b, 0), 0), counts.get((f, b, 1), 0)
                if n0 + n1:
                    out[f, b] = math.log((n1 + 8) / (total[1] + 8 * bins)) - math.log((n0 + 8) / (total[0] + 8 * bins))
        return out

    shapes = ((quality.TEXT_FEATURES, quality.BINS), (quality.META_FEATURES, quality.META_BINS))
    for view in (0, 1):
        counts = Counter()
        for r in known:
            for f, b in enumerate(r[view]):
                counts[f, b, r[2]] += 16
        assert np.allclose(first.tables[view], odds(counts, *shapes[view]))
    # what the text view gives the metadata view in round 1
    free = [r for r in table if r[2] is None]
    raw = [sum(first.tables[0][f, b] for f, b in enumerate(r[0])) for r in free]
    bins = [max(-240, min(240, round(x / 0.25))) for x in raw]
    n = Counter(r[2] for r in table if r[2] is not None)
    low, high = quality.thresholds(Counter(bins), 0.1, n[1] / (n[0] + n[1]))
    counts, told = Counter(), Counter()
    for r in known:
        for f, b in enumerate(r[1]):
            counts[f, b, r[2]] += 16
    a, c = first.lines[0]
    for r, x, at in zip(free, raw, bins):
        if at <= low or at >= high:
            p = round(4 / (1 + math.exp(-max(-30, min(30, a * x + c)))))
            told[int(p >= 2)] += 1
            for f, b in enumerate(r[1]):
                counts[f, b, 1] += p
                counts[f, b, 0] += 4 - p
    entry = second.rounds[-1]
    assert (entry["view"], entry["given_0"], entry["given_1"]) == ("metadata", told[0], told[1]) and told[0] and told[1]
    want = odds(counts, *shapes[1])
    assert np.allclose(second.tables[1], want if entry["taken"] else first.tables[1])
    assert all(x["given_0"] + x["given_1"] > 0 for x in second.rounds[2:])


def test_thresholds_take_the_ends():
    assert quality.thresholds({-2: 10, 0: 80, 3: 10}, 0.1, 0.5) == (-2, 3)
    assert quality.thresholds({}, 0.1, 0.5) == (-np.inf, np.inf)


def test_quality_views_are_apart(make_docs):
    docs = make_docs(["Some words here.", "Some words here."], ["a", "b"])
    got = {r["doc_id"]: r for r in quality.bins(docs).collect()}
    assert got[0]["t"] == got[1]["t"] and got[0]["m"] != got[1]["m"]


def test_quality_edges(spark, make_docs):
    docs = make_docs([None, "", "x"], [None, "s", "s"]).withColumnRenamed("lang", "y").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, 7)], "doc_id long, quality int")
    got = [r["score"] for r in quality.scored(docs, labels).collect()]
    assert len(set(got)) == 1 and got[0] == pytest.approx(2.5 / 3)
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.scored(docs, labels.limit(0)).count() == 3


def sentences(rng, n):
    grammar = [["the", "a"], ["cat", "dog", "bird"], ["sees", "hears"], ["the", "a"], ["tree", "house"], ["and"]]
    return [w for _ in range(n) for w in (rng.choice(x) for x in grammar)]


def test_masked_scores_order(spark, make_docs):
    rng = random.Random(3)
    good = [sentences(rng, 30) for _ in range(120)]
    bad = [rng.sample(x, len(x)) for x in good[:20]]
    texts = [" ".join(x) for x in good + bad]
    rows = {r["doc_id"]: r for r in masked.scored(make_docs(texts)).collect()}
    assert all(r["n_tokens"] == 180 and r["log_prob"] < 0 for r in rows.values())
    fine = [rows[i]["mean_log_prob"] for i in range(20)]
    shuffled = [rows[120 + i]["mean_log_prob"] for i in range(20)]
    assert all(f > s for f, s in zip(fine, shuffled))


@pytest.fixture(scope="module")
def trained(spark, make_docs):
    """A corpus with more words than the head has, its words, and a network of one round."""
    rng = random.Random(5)
    texts = [" ".join([*sentences(rng, 3), *(f"w{rng.randrange(1500)}" for _ in range(30))]) for _ in range(200)]
    docs = make_docs(texts)
    words, total = masked.vocabulary(docs)
    assert total == sum(len(t.split()) for t in texts) and words.known == masked.LEAST_WORDS
    rows = docs.transform(lambda d: masked.encoded(d, words, 3)).select("doc_id", "ids", "shard")
    return texts, words, masked.train(rows, words, 1), rows


def plain_log_prob(net, words, ids, i):
    """log P(ids[i] | its sides), number by number."""
    around = [ids[i + d] if 0 <= i + d < len(ids) else words.pad for d in (-2, -1, 1, 2)]
    hidden = [math.tanh(float(net.b[j]) + sum(float(net.e[k][w][j]) for k, w in enumerate(around))) for j in range(masked.HIDDEN)]

    def log_softmax(u, c, at):
        z = [float(c[k]) + sum(h * float(u[j][k]) for j, h in enumerate(hidden)) for k in range(len(c))]
        return z[at] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))

    own = ids[i]
    out = log_softmax(net.u, net.c, words.klass[own])
    if own >= words.known:
        return out + float(words.share[own])
    k = 0 if own < words.tiers[0].words else 1
    inner = words.klass[own] - words.tiers[k].klass
    return out + log_softmax(net[4 + 2 * k][inner], net[5 + 2 * k][inner], words.member[own])


def test_masked_sum_by_hand(trained):
    _, words, net, rows = trained
    for r in rows.limit(2).collect():
        ids = np.frombuffer(r["ids"], np.uint16)
        some = masked.lot([np.zeros(0, np.uint16), ids], words.pad)
        got = masked.log_probs(net, words, some.ids, some.at)
        assert got == pytest.approx([plain_log_prob(net, words, ids.tolist(), i) for i in range(len(ids))], abs=1e-4)


def test_masked_probabilities_sum_to_one(trained):
    _, words, net, _ = trained
    ids = np.array([words.pad, 3, 0, 500, words.known], np.uint16)
    total = 0.0
    for own in range(words.pad):
        ids[2] = own
        # a tail's share is of one of its words; it has exp(-share) of them
        total += float(np.exp(masked.log_probs(net, words, ids, np.array([0]))[0] - words.share[own]))
    assert total == pytest.approx(1, abs=1e-4)


def test_masked_gradients_are_those_of_the_loss(trained):
    _, words, net, rows = trained
    learner = masked.Learner(masked.Net(*(x.astype(np.float64) for x in net)), words)
    some = masked.lot([np.frombuffer(r["ids"], np.uint16) for r in rows.limit(3).collect()], words.pad)
    around, own = masked._around(some.ids, some.at), some.ids[some.at + masked.SIDE].astype(np.int64)
    dense, back = learner.gradients(around, own)

    def loss():
        return -masked.log_probs(learner.net, words, some.ids, some.at).mean()

    rng = np.random.default_rng(1)
    for k, grad in dense.items():
        flat, own_grad = learner.net[k].reshape(-1), grad.reshape(-1)
        for j in [*rng.integers(0, len(flat), 3), int(np.abs(own_grad).argmax())]:
            kept = flat[j]
            flat[j] = kept + 1e-4
            up = loss()
            flat[j] = kept - 1e-4
            down = loss()
            flat[j] = kept
            assert own_grad[j] == pytest.approx((up - down) / 2e-4, abs=2e-5)
    word = int(around[1][5])
    want = back[around[1] == word].sum(axis=0)
    for j in range(3):
        learner.net.e[1][word, j] += 1e-4
        up = loss()
        learner.net.e[1][word, j] -= 2e-4
        down = loss()
        learner.net.e[1][word, j] += 1e-4
        assert want[j] == pytest.approx((up - down) / 2e-4, abs=2e-5)


def test_masked_scores_do_not_depend_on_the_cut(trained, make_docs):
    texts = trained[0]
    one, other = ({r["doc_id"]: r["log_prob"] for r in masked.scored(d, 1).collect()} for d in (make_docs(texts).coalesce(1), make_docs(texts).repartition(7, "text")))
    assert one == pytest.approx(other, abs=1e-3)


def test_masked_rounds_learn_every_place():
    at = np.arange(1003)
    assert sorted(np.concatenate([at[r :: masked.ROUNDS] for r in range(masked.ROUNDS)]).tolist()) == at.tolist()


def test_masked_edges(spark, make_docs):
    docs = make_docs([None, "", "...", "one"]).withColumnRenamed("lang", "ids")
    got = {r["doc_id"]: r for r in masked.scored(docs).collect()}
    assert [got[i]["n_tokens"] for i in range(4)] == [0, 0, 0, 1]
    assert got[0]["log_prob"] == 0 and got[0]["perplexity"] is None and got[3]["log_prob"] < 0
    assert masked.scored(docs.limit(0)).count() == 0
