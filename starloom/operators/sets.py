"""Duplicates and unions of statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.schema import IDENTITY, ORIGIN


def distinct(df: DataFrame, order: Sequence[str] = ORIGIN, within: Sequence[str] = ()) -> DataFrame:
    """One of each set of equal statements: the first in the given order (further columns break ties).

    within: columns of a batch; equal statements of different batches stay. The first row is
    an aggregate combined before its shuffle, so many copies of a statement are no hot group.
    Columns of df that are neither identity nor order come from the row that stays.
    """
    by = [c for c in (*within, *IDENTITY) if c in df.columns]
    first = [c for c in order if c in df.columns and c not in by]
    rest = [c for c in df.columns if c not in by and c not in first]
    if not first and not rest:
        return df.select(*by).distinct().select(*df.columns)
    kept = df.groupBy(*by).agg(F.min(F.struct(*first, *rest)).alias("__row"))
    return kept.select(*by, "__row.*").select(*df.columns)


def union(*sources: DataFrame) -> DataFrame:
    """All statements of all sources; repeated ones stay."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
