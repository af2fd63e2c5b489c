import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from starloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=60):
    rng = random.Random(3)
    parts = ["the", " cat", "  ", "\n\n", "\t", "don't", "I'LL", "123456", "éàü", "日本語", "😀", "👩‍👩‍👧", "...", "!?", " ", "a" * 40, "<|endoftext|>", "\r\n", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(n)] + ["", " " * 500, "x" * 700, "\n" * 333, "<|endoftext|>"]


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (50, 10), (64, 64), (1 << 16, 1 << 10)])
def test_stitched_chunks_equal_the_whole(reference, chunk, overlap):
    for t in texts():
        assert bpe.encode(PATH, t, chunk, overlap).tolist() == reference.encode_ordinary(t)


def test_tables(spark, make_docs, reference):
    given = [*texts(20), None]
    docs = make_docs(given)
    got = {r["doc_id"]: r for r in bpe.encoded(docs, chunk=40, overlap=8, long=150, digest=True).collect()}
    for i, t in enumerate(given):
        ids = reference.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(given)}


def test_edges(spark, make_docs):
    docs = make_docs(["a b c"])
    assert bpe.encoded(docs.limit(0), digest=True).count() == 0
    more = docs.withColumnRenamed("lang", "ids").unionByName(docs.withColumnRenamed("lang", "ids"))
    assert [r["n_tokens"] for r in bpe.encoded(more, digest=True).collect()] == [3, 3]
    assert bpe.encoded(more, keep=True).columns == ["doc_id", "text", "source", "n_chars", "ids"] or set(bpe.encoded(more, keep=True).columns) == {*more.columns}
    assert bpe.encoded(more, keep=True).first()["ids"] == bpe.encode(PATH, "a b c").tolist()
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert bpe.encoded(nulls, digest=True).first()["n_tokens"] == 0
