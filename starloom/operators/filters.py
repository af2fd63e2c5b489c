"""Filters on statements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Terms = str | Iterable[str] | None


def terms(given: Terms) -> list[str]:
    """A list as it is; a string cut at commas and trimmed. Nothing, or nothing but blanks, is no constraint."""
    if given is None:
        return []
    return [x.strip() for x in given.split(",") if x.strip()] if isinstance(given, str) else [x for x in given if x is not None]


def condition(subject: Terms = None, predicate: Terms = None, value: Terms = None, graph: Terms = None, dataset: str | None = None) -> Column:
    """All constraints together. Statements without a graph pass any graph constraint; those without a dataset pass no dataset constraint."""
    out = F.lit(True)
    for name, wanted in (("subject", terms(subject)), ("predicate", terms(predicate)), ("value", terms(value))):
        if wanted:
            out = out & F.col(name).isin(wanted)
    if graphs := terms(graph):
        out = out & (F.col("context").isNull() | F.col("context").isin(graphs))
    if dataset:
        out = out & F.coalesce(F.col("dataset") == dataset, F.lit(False))
    return out


def matching(df: DataFrame, **constraints: Terms) -> DataFrame:
    """The statements that meet condition(**constraints)."""
    return df.filter(condition(**constraints))


def among(df: DataFrame, keys: DataFrame, column: str, negate: bool = False) -> DataFrame:
    """Statements whose column is (negate: is not) in the only column of keys: for lists too long for an expression."""
    wanted = keys.select(F.col(keys.columns[0]).alias("__wanted")).distinct()
    return df.join(wanted, F.col(column) == F.col("__wanted"), "left_anti" if negate else "left_semi")


def without_titles(df: DataFrame, column: str = "title", prefixes: tuple[str, ...] = ("File:", "Template:")) -> DataFrame:
    """Rows whose title begins with none of the prefixes; null titles stay."""
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.startswith(F.col(column), F.lit(p))
    return df.filter(~F.coalesce(bad, F.lit(False)))
