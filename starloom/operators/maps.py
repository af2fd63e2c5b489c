"""Maps over statements and over groups of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.schema import FIELDS, STATEMENT, Target, key_name


def map_statements(df: DataFrame, make: Column | Iterable[Column]) -> DataFrame:
    """Flat map by expressions: an array of statement structs (or several structs) for each statement.

    Null structs are left out, so a conditional statement is a `when` without otherwise.
    """
    made = make if isinstance(make, Column) else F.array(*make)
    return df.select(F.explode(made).alias("s")).filter("s IS NOT NULL").select("s.*")


def map_batches(df: DataFrame, change: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType = STATEMENT) -> DataFrame:
    """Flat map by a Python function over Arrow batches; for what expressions cannot say."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (change(f) for f in frames)

    return df.mapInPandas(run, schema)


def map_groups(df: DataFrame, target: Target | str, change: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType = STATEMENT, order: Iterable[str] = ("_source", "_file", "_block", "_seq")) -> DataFrame:
    """Flat map over all statements that share a key, in their order.

    A group is held by one task, as the function asks for. Null is a key like others. Keys
    with more statements than a task can hold need map_statements or an aggregate instead.
    """
    by = [c for c in order if c in df.columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return change(frame.sort_values(by, kind="stable") if by else frame)

    return df.groupBy(key_name(target)).applyInPandas(run, schema)


class GroupJob:
    """A job over merged groups: subclasses say what becomes of one; by default it stays as it is."""

    schema = STATEMENT
    target: Target | str = Target.SUBJECT

    def process(self, group: pd.DataFrame) -> pd.DataFrame:
        return group[list(FIELDS)]

    def run(self, lead: DataFrame, *others: DataFrame) -> DataFrame:
        from .merges import merge_lead

        return map_groups(merge_lead(lead, *others, target=self.target), self.target, self.process, self.schema)


def changed(df: DataFrame, **fields: Column) -> DataFrame:
    """df with some of its statement fields replaced."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no statement fields: {sorted(unknown)}")
    return df.withColumns(fields)
