"""Merges of several datasets by one key.

All sources are tagged and put in one table, so that a merge takes one shuffle however many
sources there are, and their order on disk does not matter. The row forms leave rows as
they are: a key with a large share of all rows is then no burden for a single task. The
group forms put each key's rows in one array, for those who need them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.schema import FIELDS, ORIGIN, Target, key_name


def tagged(*sources: DataFrame) -> DataFrame:
    """All sources in one table, with `_source`: 0 for the first, and so on."""
    out = None
    for i, df in enumerate(sources):
        one = df.withColumn("_source", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to merge")
    return out


def merge_all(*sources: DataFrame) -> DataFrame:
    """Full merge: every row of every source, tagged. Its groups are the keys of all sources."""
    return tagged(*sources)


def merge_lead(lead: DataFrame, *others: DataFrame, target: Target | str = Target.SUBJECT) -> DataFrame:
    """Left merge: the rows of the lead source, and of the others those whose key the lead has.

    Null is a key like others. Semi-joins of exchanged sides: Spark splits their skewed keys.
    """
    key = key_name(target)
    keys = lead.select(F.col(key).alias("__key")).distinct()
    met = [df.join(keys, _same_key(df, key, keys), "left_semi") for df in others]
    return tagged(lead, *met)


def _same_key(df: DataFrame, key: str, keys: DataFrame) -> Column:
    """Whether df's key is __key, null like others.

    Strings are met by a hash and then compared: IRIs begin alike, so a sort by them compares
    whole texts, while one by a number needs none. Two bounds say that texts are equal, as Spark
    would take an equation for a second key to sort by.
    """
    a, b = F.col(key), F.col("__key")
    if not df.schema[key].dataType == keys.schema["__key"].dataType == T.StringType():
        return a.eqNullSafe(b)
    return (F.xxhash64(a) == F.xxhash64(b)) & F.coalesce((a <= b) & (a >= b), a.isNull() & b.isNull())


def grouped(rows: DataFrame, target: Target | str = Target.SUBJECT, lead_only: bool = False) -> DataFrame:
    """One row for each key of tagged rows: the key, `n`, and `statements` in the order of source and origin.

    lead_only keeps keys that source 0 has; the whole left merge is then this one shuffle.
    """
    key = key_name(target)
    order = [c for c in ("_source", *ORIGIN) if c in rows.columns]
    fields = [c for c in FIELDS if c in rows.columns]
    rest = [c for c in fields if c != key] + [key]
    out = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("_source").alias("_first"), F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("statements"))
    out = out.filter(F.col("_first") == 0) if lead_only else out
    return out.drop("_first")


def group_sizes(rows: DataFrame, sources: int, target: Target | str = Target.SUBJECT, lead_only: bool = False) -> DataFrame:
    """For each key of tagged rows how many each source has (`n0`, `n1`, …): counts combined before the shuffle."""
    counts = [F.count_if(F.col("_source") == i).alias(f"n{i}") for i in range(sources)]
    out = rows.groupBy(F.col(key_name(target)).alias("key")).agg(*counts)
    return out.filter("n0 > 0") if lead_only else out


def attach(entities: DataFrame, links: DataFrame, name: str, entity_key: str = "id") -> DataFrame:
    """Left join with a list: to each entity the sorted subjects of the links whose value it is; null if none."""
    lists = links.groupBy(F.col("value").alias("__value")).agg(F.sort_array(F.collect_list("subject")).alias(name))
    return entities.join(lists, F.col(entity_key) == F.col("__value"), "left").drop("__value")


def drop_linked(entities: DataFrame, *links: DataFrame, entity_key: str = "id") -> DataFrame:
    """Anti join: entities that are the subject of no link."""
    for df in links:
        gone = df.select(F.col("subject").alias("__subject")).distinct()
        entities = entities.join(gone, F.col(entity_key) == F.col("__subject"), "left_anti")
    return entities


def lookup(annotations: DataFrame, documents: DataFrame, ids: str = "ids", document_key: str = "id") -> DataFrame:
    """Each annotation with `documents`: the structs of those documents that its id list names, by id."""
    cols = annotations.columns
    # rows are numbered in one branch only: a number that two branches compute need not be the same
    row = annotations.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(F.col(f"`{c}`") for c in cols)).alias("__own"))
    row = row.select("__row", "__own", F.explode_outer(F.array_distinct(F.col("__own")[ids])).alias("__id"))
    body = documents.select(F.col(document_key).alias("__doc"), F.struct(*documents.columns).alias("__body"))
    met = F.when(F.col("__doc").isNotNull(), F.struct("__doc", "__body"))
    found = row.join(body, F.col("__id") == F.col("__doc"), "left").groupBy("__row").agg(F.first("__own").alias("__own"), F.transform(F.array_sort(F.collect_list(met)), lambda s: s["__body"]).alias("documents"))
    return found.select("__own.*", F.when(F.size("documents") > 0, F.col("documents")).alias("documents"))
