import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.llm import spans


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def brute(texts):
    """Sentences kept, by an own splitter: sentences have 3 to 12 words here and end with a full stop."""
    split = [[s.strip() for s in t.split(".") if s.strip()] for t in texts]
    seen, drop = {}, [set() for _ in texts]
    for d, own in enumerate(split):
        for i in range(len(own)):
            j, words = i, 0
            while j < len(own):
                words += len(own[j].split())
                j += 1
                if j - i >= spans.RUN and words >= spans.WORDS:
                    key = tuple(" ".join(own[i:j]).lower().split())
                    if key in seen:
                        drop[d] |= set(range(i, j))
                    else:
                        seen[key] = d
                    break
    return [[s for i, s in enumerate(own) if i not in drop[d]] for d, own in enumerate(split)]


def corpus():
    rng = random.Random(8)
    shared = [sentence(rng, 10) for _ in range(12)]
    texts = []
    for _ in range(60):
        own = [sentence(rng, rng.randint(3, 12)) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            a = rng.randint(0, 7)
            at = rng.randint(0, len(own))
            own[at:at] = shared[a : a + rng.randint(1, 5)]
        texts.append(" ".join(own))
    return [*texts, texts[3], texts[3] + " Tail.", ""]


def test_equals_brute_force(make_docs):
    texts = corpus()
    got = {r["doc_id"]: r["text"] for r in spans.removed(make_docs(texts)).collect()}
    assert [[s.strip() for s in got[i].split(".") if s.strip()] for i in range(len(texts))] == brute(texts)


def test_passages_that_sentences_do_not_mark(make_docs):
    rng = random.Random(2)
    words = [sentence(rng, 1)[:-1].lower() for _ in range(3000)]
    passage = " ".join(words[:400])
    docs = make_docs([" ".join(words[500:900]) + " " + passage + " " + " ".join(words[900:1000]), " ".join(words[1000:1100]) + " " + passage, " ".join(words[1200:1600])])
    got = {r["doc_id"]: r for r in spans.removed(docs, report=True).collect()}
    assert got[0]["n_removed"] == 0 and got[2]["n_removed"] == 0
    assert len(got[1]["text"].split()) < 100 + 60


def common_spans(x, y):
    one, other = (set(spans.spans(spans.sentences(pa.array([t])))[0].tolist()) for t in (x, y))
    return one & other


@pytest.mark.parametrize("most", [4, 9, 16, 30, 400])
def test_passages_of_51_words_at_any_place(most):
    rng = random.Random(most)
    texts = [" ".join(sentence(rng, rng.randint(1, most)) for _ in range(400 // most + 3)).split() for _ in range(3)]
    for _ in range(100):
        a, x, y = (rng.randrange(len(t) - 51) for t in texts)
        passage = texts[0][a : a + 51]
        assert common_spans(*(" ".join(t[:i] + passage + t[i:]) for t, i in ((texts[1], x), (texts[2], y))))


def test_spans_of_one_hash_but_other_words_stay(make_docs, monkeypatch):
    whole = spans.spans

    def few(s):
        h, *rest = whole(s)
        return h % 3, *rest

    texts = corpus()
    monkeypatch.setattr(spans, "spans", few)
    got = {r["doc_id"]: r["text"] for r in spans.removed(make_docs(texts)).collect()}
    assert [[s.strip() for s in got[i].split(".") if s.strip()] for i in range(len(texts))] == brute(texts)


def test_tables_on_the_way_are_removed(spark, make_docs, monkeypatch):
    gone = []
    monkeypatch.setattr(spans.store, "removed", lambda *frames: gone.extend(frames))
    spans.repeated(make_docs(corpus())).collect()
    assert len(gone) == 4


def test_edges(spark, make_docs):
    docs = make_docs([None, "", "Short. Text."])
    assert {r["doc_id"]: r["text"] for r in spans.removed(docs).collect()} == {0: None, 1: "", 2: "Short. Text."}
    assert spans.removed(docs.limit(0)).count() == 0
    rng = random.Random(1)
    t = " ".join(sentence(rng, 10) for _ in range(5))
    clash = make_docs([t, t]).withColumnRenamed("lang", "cuts").withColumnRenamed("source", "h")
    got = {r["doc_id"]: r for r in spans.removed(clash).collect()}
    assert got[0]["text"] == t and got[1]["text"].strip() == "" and got[1]["n_chars"] == len(got[1]["text"])
    same = make_docs([t, t]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["text"] for r in spans.removed(same).collect()] == [t, t]


@pytest.mark.parametrize("report", [True, False])
def test_extra_columns(make_docs, report):
    docs = make_docs(["a"]).withColumn("__x", F.lit(1))
    assert spans.removed(docs, report=report).count() == 1
