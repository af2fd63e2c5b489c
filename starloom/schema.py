"""The statement row: one relation that every operator reads and returns."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Datatype IRIs that parsed literals get.
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"

#: Columns of a statement. A null datatype says that the value is an IRI.
FIELDS = ("dataset", "subject", "predicate", "value", "datatype", "language", "context")
#: Where a parsed statement stood; sorts back to file order.
ORIGIN = ("_file", "_block", "_seq")
#: Two statements are equal if these are (nulls too); dataset and context do not count.
IDENTITY = ("subject", "predicate", "value", "datatype", "language")

STATEMENT = T.StructType([T.StructField(c, T.StringType(), c not in ("subject", "predicate", "value")) for c in FIELDS])


class Target(str, Enum):
    """The field by which statements are sorted, grouped or merged."""

    SUBJECT = "subject"
    PREDICATE = "predicate"
    VALUE = "value"
    GRAPH = "context"


def key_name(target: Target | str) -> str:
    """The column of a target; `graph` and any column of the row are accepted by name."""
    name = target.value if isinstance(target, Target) else target
    return "context" if name == "graph" else name


def statement(subject: Column, predicate: Column | str, value: Column, datatype: Column | str | None = None, language: Column | str | None = None, context: Column | str | None = None, dataset: Column | str | None = None) -> Column:
    """A statement struct; strings are constants, None is null."""

    def as_column(x: Column | str | None) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    parts = dict(zip(FIELDS, (dataset, subject, predicate, value, datatype, language, context)))
    return F.struct(*(as_column(parts[c]).alias(c) for c in FIELDS))


def has_object_predicate() -> Column:
    """True where the value is an absolute IRI and no literal."""
    return F.col("datatype").isNull() & F.col("language").isNull() & F.try_parse_url(F.col("value"), F.lit("PROTOCOL")).isNotNull()


def typed_object() -> Column:
    """The object as a struct: kind (iri or literal), value, and a literal's datatype and language.

    A literal without a datatype but with a language is a language string; a language that
    stands at another datatype is none.
    """
    literal = F.col("datatype").isNotNull() | F.col("language").isNotNull()
    datatype = F.when(literal, F.coalesce("datatype", F.lit(LANG_STRING)))
    return F.struct(
        F.when(literal, "literal").otherwise("iri").alias("kind"),
        F.col("value").alias("value"),
        datatype.alias("datatype"),
        F.when(datatype == LANG_STRING, F.col("language")).alias("language"),
    )


def conform(df: DataFrame, dataset: str | None = None) -> DataFrame:
    """df with all statement columns, in order, before its other columns; missing ones are null."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in FIELDS]
    out = df.select(*cols, *(c for c in df.columns if c not in FIELDS))
    return out.withColumn("dataset", F.coalesce("dataset", F.lit(dataset))) if dataset else out
