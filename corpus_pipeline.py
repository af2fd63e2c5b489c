"""From raw documents to token counts and digests of a training mix, in five stages.

Every stage works on all that its predecessor kept, and is written to the shared folder and
read again before the next one starts, so that a lost executor costs no more than a stage's
own tasks. Nulls, empty texts and tables, ties and repeated rows are defined by the
operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import bpe, mixing, neardup, pii, store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by tags."""
    return pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies, and the parts of documents, that make up the mix."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row of the mix its number of tokens and digests of ids and decoded bytes."""
    return bpe.encoded(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL expresses none of the stages' models, signatures or encodings; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
