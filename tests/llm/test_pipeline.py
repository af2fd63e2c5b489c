import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from starloom.llm import bpe, mixing, pii, store

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table after every stage, over a small folder of tables."""
    source, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("sf")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(str(folder / f"{t}.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, str(folder)), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return str(folder), out


def test_stages(stages):
    _, (docs, safe, unique, clean, mix, encoded) = stages
    assert all(x.columns == docs.columns for x in (safe, unique, clean, mix))
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, safe))
    assert 0.7 * len(before) < len(after) <= len(before) and all(before[i] == t for i, t in after.items())
    one = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert set(one) <= set(after) and len(set(one.values())) == len(one)
    redacted = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert redacted == {i: t if t is None else pii.redact(t, pii.spans(t)) for i, t in one.items()}


def test_mix_and_encoding(stages):
    _, (*_, clean, mix, encoded) = stages
    rows = clean.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(WORDS.findall(r["text"] or ""))
    got = Counter()
    for r in mix.collect():
        got[r["source"]] += len(WORDS.findall(r["text"] or ""))
    want = mixing.targets(dict(size))
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.coder(path).encoding

    def digest(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert Counter((r["doc_id"], *digest(r["text"])) for r in mix.collect()) == Counter(tuple(r) for r in encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


def test_run_repeats(spark, stages):
    folder, (*_, encoded) = stages
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, encoded.collect()), key=repr)


def test_no_rows_and_nulls(spark, tmp_path):
    """Empty tables give an empty result; rows of nulls pass every stage."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, "", None, "s", 0), (2, "a word", "en", None, 6)])):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path / "nulls")).collect()}
    assert {i for i, _ in got} <= {None, 1, 2} and (2, 2) in got


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n for n in range(1, 11)} == {int(m[1]) for x in names if (m := re.match(r"op(\d+)_", x))}
    assert set(entry.oracle_sql()) <= set(names)
