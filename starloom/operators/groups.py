"""Groups of statements by key, runs of equal keys, and key statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from starloom.schema import Target, key_name

from .merges import grouped, tagged


def groups(df: DataFrame, target: Target | str = Target.SUBJECT) -> DataFrame:
    """key, n, statements: all statements of each key, in their order."""
    return grouped(tagged(df), target)


def group_of(df: DataFrame, target: Target | str, value: str | None) -> DataFrame:
    """The statements of one key; the filter reaches the scan."""
    return df.filter(F.col(key_name(target)).eqNullSafe(F.lit(value)))


def sizes(df: DataFrame, target: Target | str = Target.SUBJECT) -> DataFrame:
    return df.groupBy(F.col(key_name(target)).alias("key")).agg(F.count("*").alias("n"))


def runs(df: DataFrame, key: str, order: Sequence[str] = ("_seq",), slices: Sequence[str] = ("_file", "_block"), stream: Sequence[str] = ("_file",)) -> DataFrame:
    """df with `run`: the number, within its stream, of the unbroken run of equal keys that a row is in.

    slices are columns by which rows fall into stretches of the order that fit a task (the
    blocks of a file; the hours of a log), ascending as the order does. Runs are found
    within stretches; one row for each stretch then says where runs go on across edges and
    how many came before. Null is a key like others.
    """
    slices, stream = list(slices), list(stream)
    inner = W.Window.partitionBy(*slices).orderBy(*order)
    fresh = (F.row_number().over(inner) == 1) | ~F.col(key).eqNullSafe(F.lag(key).over(inner))
    marked = df.withColumn("__fresh", fresh.cast("long"))
    at = F.struct(*order)
    edge = marked.groupBy(*slices).agg(F.sum("__fresh").alias("__n"), F.min_by(F.struct(key), at).alias("__first"), F.max_by(F.struct(key), at).alias("__last"))
    across = W.Window.partitionBy(*stream).orderBy(*(c for c in slices if c not in stream))
    goes_on = F.coalesce(F.col("__first").eqNullSafe(F.lag("__last").over(across)) & (F.row_number().over(across) > 1), F.lit(False)).cast("long")
    edge = edge.withColumn("__goes_on", goes_on)
    before = F.coalesce(F.sum(F.col("__n") - F.col("__goes_on")).over(across.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(slices)), (before - F.col("__goes_on")).alias("__before"))
    same = None
    for i, c in enumerate(slices):
        one = F.col(c).eqNullSafe(F.col(f"__s{i}"))
        same = one if same is None else same & one
    numbered = marked.withColumn("__in", F.sum("__fresh").over(inner.rowsBetween(W.Window.unboundedPreceding, 0)))
    return numbered.join(edge, same).withColumn("run", F.col("__before") + F.col("__in")).select(*df.columns, "run")


def run_groups(df: DataFrame, key: str, order: Sequence[str] = ("_seq",), slices: Sequence[str] = ("_file", "_block"), stream: Sequence[str] = ("_file",)) -> DataFrame:
    """One row for each run: stream, run, key, n."""
    return runs(df, key, order, slices, stream).groupBy(*stream, "run").agg(F.any_value(key).alias("key"), F.count("*").alias("n"))


def descents(df: DataFrame, key: str, order: Sequence[str] = ("_seq",), slices: Sequence[str] = ("_file", "_block"), stream: Sequence[str] = ("_file",)) -> DataFrame:
    """One row for each stream with `descents`: how many keys are less than the one before; 0 if it is sorted.

    Null sorts first. Edges of stretches are compared by one row each, as in runs().
    """
    slices, stream = list(slices), list(stream)

    def falls(now: Column, last: Column, second: Column) -> Column:
        return F.coalesce((second & last.isNotNull() & (now.isNull() | (now < last))), F.lit(False)).cast("long")

    inner = W.Window.partitionBy(*slices).orderBy(*order)
    marked = df.withColumn("__falls", falls(F.col(key), F.lag(key).over(inner), F.row_number().over(inner) > 1))
    at = F.struct(*order)
    edge = marked.groupBy(*slices).agg(F.sum("__falls").alias("__n"), F.min_by(F.struct(F.col(key).alias("k")), at).alias("__first"), F.max_by(F.struct(F.col(key).alias("k")), at).alias("__last"))
    across = W.Window.partitionBy(*stream).orderBy(*(c for c in slices if c not in stream))
    edge = edge.withColumn("__edge", falls(F.col("__first.k"), F.lag("__last").over(across)["k"], F.row_number().over(across) > 1))
    return edge.groupBy(*stream).agg(F.sum(F.col("__n") + F.col("__edge")).alias("descents"))


def next_characters(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """How often each character follows a prefix in the keys that begin with it; '' at their end."""
    return df.filter(F.startswith(F.col(key), F.lit(prefix))).groupBy(F.substring(F.col(key), F.lit(len(prefix) + 1), F.lit(1)).alias("next")).agg(F.count("*").alias("n"))


def bucket_statistics(df: DataFrame, bucket: str) -> DataFrame:
    """One row: number of buckets, rows, mean size, the largest bucket (the least on ties) and its size."""
    per = df.groupBy(F.col(bucket).alias("b")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("buckets"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean_size"), F.min_by("b", F.struct((-F.col("n")).alias("m"), "b")).alias("largest"), F.max("n").alias("largest_size"))
