import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.llm import graph, neardup


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def corpus():
    rng = random.Random(4)
    texts = []
    for size in (1, 2, 5, 40):
        base = words(rng, 200)
        for k in range(size):
            t = list(base)
            if k:
                t[rng.randrange(200)] = words(rng, 1)[0]
            texts.append(" ".join(t))
    texts += [" ".join(words(rng, rng.randint(3, 300))) for _ in range(60)]
    texts += [texts[0]] * 30 + ["", "", "One two.", "one two", None]
    half = texts[0].split()
    texts.append(" ".join(half[:100] + words(rng, 100)))
    return texts


def test_classes_equal_brute_force(make_docs):
    texts = corpus()
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (texts[i] or "") == (texts[j] or "") or jaccard((texts[i] or "").replace(".", ""), (texts[j] or "").replace(".", "")) >= 0.8]
    want = components(len(texts), edges)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in neardup.deduplicated(make_docs(texts)).collect()}
    assert kept == set(want)


def test_large_buckets_lose_no_link(make_docs, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 150)
    texts = []
    for _ in range(120):  # one group of near copies, far over SMALL
        t = list(base)
        t[rng.randrange(150)] = words(rng, 1)[0]
        texts.append(" ".join(t))
    texts += [" ".join(words(rng, 150)) for _ in range(40)]
    got = [r["class_id"] for r in neardup.classes(make_docs(texts)).orderBy("doc_id").collect()]
    assert got[:120] == [0] * 120 and got[120:] == list(range(120, 160))


def test_large_buckets_of_many_classes(make_docs):
    # one letter in many versions: the two texts of a version are just alike, others are not, and most share buckets
    rng = random.Random(12)
    base, texts = words(rng, 180), []
    for _ in range(120):
        own = list(base)
        own[rng.randrange(10, 170)] = words(rng, 1)[0]
        texts += [" ".join(own + words(rng, 20)) for _ in range(2)]
    assert 0.8 < jaccard(texts[0], texts[1]) < 0.85 and max(jaccard(texts[0], t) for t in texts[2:]) < 0.8
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    ca = rng.integers(1, 6, 300)
    cb = np.where(rng.random(300) < 0.3, rng.integers(1, 6, 300), ca)
    keep = rng.random(300) < 0.9
    true = neardup.similarity(a, ca, a[keep], cb[keep])
    # P(agree) by the definition: sum over x of 1 / sum over y of max(wa_y / wa_x, wb_y / wb_x)
    wb = np.where(keep, cb, 0)
    by_hand = sum(1 / np.maximum(ca / ca[x], wb / wb[x]).sum() for x in range(300) if wb[x])
    assert true == pytest.approx(by_hand)
    agree = []
    for seed in range(40):
        h = neardup.textops.splitmix(a + np.uint64(seed * 7919))
        order, order_b = np.argsort(h), np.argsort(h[keep])
        won = neardup.signatures([(h[order], ca[order]), (h[keep][order_b], cb[keep][order_b])])
        agree.append((won[0] == won[1]).mean())
    assert np.mean(agree) == pytest.approx(true, abs=0.03)


def test_shingles_are_whole_texts():
    (one, n), (two, _), (none, _) = neardup.shingles(pa.array(["a b c d e a b c d e", "a b", " . "]))
    assert n.tolist() == sorted(n.tolist(), reverse=False) or n.sum() == 6
    assert n.sum() == 6 and len(two) == 1 and len(none) == 0


def test_edges(spark, make_docs):
    docs = make_docs([None, "", "x y", "x y"]).withColumn("node", F.lit("clash")).withColumnRenamed("lang", "key")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == [0, 2]
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.deduplicated(docs.limit(0)).count() == 0
    same = make_docs([(7, "p q"), (7, "p q"), (None, "r s"), (None, "r s")])
    assert neardup.deduplicated(same).count() == 2


def test_distinct_texts_without_own_ids_stay(make_docs):
    docs = make_docs([(None, "p q"), (None, "r s"), (None, "r s"), (3, "t u"), (3, "v w"), (3, "v w")])
    assert sorted(r["text"] for r in neardup.deduplicated(docs).collect()) == ["p q", "r s", "t u", "v w"]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(5, 5), (None, 3)]
    want = components(500, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got and all(want[n] == c for n, c in got.items())
    assert set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}
