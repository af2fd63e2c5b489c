"""Orders of statements. Strings compare by code point and nulls come first, as Spark has it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.schema import IDENTITY, Target, key_name
from starloom.shared import materialised


def sort_columns(target: Target | str = Target.SUBJECT) -> list[str]:
    """The target first; the other fields break ties, so that results repeat."""
    key = key_name(target)
    return [key, *(c for c in (*IDENTITY, "context", "dataset") if c != key)]


def sort_by(df: DataFrame, target: Target | str = Target.SUBJECT) -> DataFrame:
    """All statements in the total order of a target: one range shuffle."""
    return df.orderBy(*sort_columns(target))


def sort_fully(df: DataFrame) -> DataFrame:
    """Subject, predicate, value, datatype, language."""
    return df.orderBy(*IDENTITY)


def sort_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.orderBy(column)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points; nulls are equal and first."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)


def numbered(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with its place, from 1, in a total order, without a window over one partition.

    Sorted partitions are written once; each partition's offset, one number for each
    partition, is then added to the places within it.
    """
    sorted_ = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    table = materialised(sorted_, "numbered")
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    rows = df.sparkSession.createDataFrame(list(offsets.items()), "__p long, __offset long")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = table.withColumn("__part", part).join(F.broadcast(rows), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__offset") + within + 1).select(*df.columns, name)


def first_rows(df: DataFrame, order: Sequence[str], n: int = 10_000) -> DataFrame:
    """The first n rows of an order; each partition keeps n at most before they meet."""
    return df.orderBy(*order).limit(n)
