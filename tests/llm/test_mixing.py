import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from starloom.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "é", "x y"]) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(400)] + [None, "", " \x0b\x0c x\ty "]
    sources = [rng.choice(["web", "web", "web", "web", "wiki", "code", None]) for _ in texts]
    return texts, sources


def test_targets_by_hand():
    # weights 3 1 2 for a, b, null; 150 % of 160 = 240: a 120, b 40, null 80; a is capped at 80, b at 40
    assert mixing.targets({"b": 20, None: 100, "a": 40}) == {"a": 80.0, "b": 40.0, None: 120.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_taken(make_docs):
    texts, sources = corpus()
    docs = make_docs(texts, sources)
    rows = mixing.taken(docs).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by_source, got = Counter(), Counter()
    for r in rows:
        by_source[r["source"]] += r["size"]
        got[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = mixing.targets(dict(by_source))
    for r in rows:
        assert r["source_size"] == by_source[r["source"]] and r["target"] == want[r["source"]]
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.taken(docs.repartition(2)).collect()), key=repr)


def test_the_mix_holds_what_was_taken(make_docs):
    texts, sources = corpus()
    docs = make_docs(texts, sources)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    rows = mixing.mixed(docs, shards=4).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += len(WORDS.findall(r["text"] or ""))
        assert (texts[r["doc_id"]] or "").startswith(r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}
    assert {r["mix_shard"] for r in rows} <= set(range(4)) and len({(r["doc_id"], r["mix_copy"]) for r in rows}) == len(rows)


def test_a_draw_that_no_shard_owns_is_not_taken():
    made = mixing.Plan(["a"], np.array([20]), np.array([30.0]), np.array([4]), np.array([1]), np.array([2]), [(0.7, 3, 5)], np.array([0]), np.array([[0, 3, 7]]), 2)
    u, size = np.array([0.1, 0.3, 0.6, 0.8]), np.full(4, 5)
    got = mixing.draws(made, np.zeros(4, np.int64), u, np.arange(4), size)
    # one document in each block: draws 0 and 4, 1 and 5, 2 and (before the cut in the edge block) 6, 3
    rows = list(zip(*(x.tolist() for x in got)))
    assert rows == [(0, 0, 5, 0), (0, 1, 5, 1), (1, 0, 5, 0), (1, 1, 5, 1), (2, 0, 5, 0), (2, 1, 5, 1), (3, 0, 5, 1)]
    short = made._replace(offsets=np.array([[0, 3, 6]]))
    assert mixing.draws(short, np.zeros(4, np.int64), u, np.arange(4), size).words.sum() == got.words.sum() - 5


def test_clashing_names(make_docs):
    docs = make_docs(["a b", "c"], ["s", "t"])
    for c in ("copy", "words", "shard", "size", "position", "mix_shard", "p_u", "u"):
        docs = docs.withColumn(c, F.lit("kept"))
    rows = mixing.mixed(docs).collect()
    assert rows and all(r[c] == "kept" for r in rows for c in ("copy", "words", "shard", "size", "position", "mix_shard", "p_u", "u"))
    assert {"_mix_shard", "_mix_copy"} <= set(mixing.mixed(docs).columns)
    assert mixing.taken(docs).count() == 2


def test_split_is_exact():
    quotas = np.array([100, 0, 7, 1000], np.int64)
    offsets = mixing.split_quotas(quotas, 8, 3)
    assert (offsets[:, -1] == quotas).all() and (np.diff(offsets, axis=1) >= 0).all()
    sizes = np.diff(offsets, axis=1).sum(axis=0)
    assert sizes.max() - sizes.min() <= 3


def test_edges(spark, make_docs):
    docs = make_docs(["a b", "a b"], ["s", "s"])
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    same = docs.withColumn("doc_id", F.lit(1).cast("long"))
    assert sum(r["taken"] for r in mixing.taken(same).collect()) == 6
    nothing = make_docs([None, ""], [None, "a"])
    assert [r["taken"] for r in mixing.taken(nothing).collect()] == [0, 0]
