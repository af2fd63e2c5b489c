"""A store of documents as a DataFrame: schema, checks, inserts, upserts and deletions."""

from __future__ import annotations

import fnmatch
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest value, in bytes of UTF-8, of a field of type `string`.
MOST_BYTES = 32_766


class DocumentError(Exception):
    """A document store's refusal."""


class StoredDocument(Protocol):
    """What can be stored: an id and a row."""

    def document_id(self) -> str: ...

    def document_row(self) -> dict: ...


class Field(NamedTuple):
    name: str
    type: str = "string"
    multi_valued: bool = False
    indexed: bool = True
    stored: bool = True
    required: bool = False
    dynamic: bool = False


class DocumentSchema:
    """Fields by exact name, then by pattern with a leading or trailing asterisk."""

    def __init__(self, fields: Iterable[Field]):
        every = list(fields)
        self.fixed = {f.name: f for f in every if not f.dynamic}
        self.patterns = [f for f in every if f.dynamic]

    @classmethod
    def from_xml(cls, text: str) -> DocumentSchema:
        """`field` and `dynamicField` elements, anywhere in the document, with their flags."""

        def flag(x: ET.Element, name: str, default: bool) -> bool:
            return x.get(name, str(default)).strip().lower() == "true"

        out = []
        for x in ET.fromstring(text).iter():
            if x.tag in ("field", "dynamicField"):
                out.append(Field(x.get("name", ""), x.get("type", "string"), flag(x, "multiValued", False), flag(x, "indexed", True), flag(x, "stored", True), flag(x, "required", False), x.tag == "dynamicField"))
        return cls(out)

    def field(self, name: str) -> Field | None:
        return self.fixed.get(name) or next((f for f in self.patterns if fnmatch.fnmatchcase(name, f.name)), None)

    def names(self) -> list[str]:
        return [*self.fixed, *(f.name for f in self.patterns)]


def field_bytes(x: Column, array: bool = True) -> Column:
    """Bytes of a value, or of all members of a list together; nulls have none."""
    if not array:
        return F.coalesce(F.octet_length(x), F.lit(0)).cast("long")
    return F.aggregate(F.coalesce(x, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, v: n + F.coalesce(F.octet_length(v), F.lit(0)))


def checked(docs: DataFrame, schema: DocumentSchema) -> DataFrame:
    """docs as the schema has them: unknown columns raise, single values become lists where a field
    takes many, lists in a field that takes one raise, and string fields that are too large become null."""
    cols = []
    for c in docs.schema:
        f = schema.field(c.name)
        if f is None:
            raise DocumentError(f"no field {c.name!r}")
        x, is_list = F.col(c.name), isinstance(c.dataType, T.ArrayType)
        if is_list and not f.multi_valued:
            raise DocumentError(f"field {c.name!r} takes one value")
        if f.multi_valued and not is_list:
            x, is_list = F.when(x.isNotNull(), F.array(x)), True
        text = isinstance(c.dataType.elementType if isinstance(c.dataType, T.ArrayType) else c.dataType, T.StringType)
        if f.type == "string" and text:
            x = F.when(field_bytes(x, is_list) <= MOST_BYTES, x)
        cols.append(x.alias(c.name))
    missing = [f.name for f in schema.fixed.values() if f.required and f.name not in docs.columns]
    if missing:
        raise DocumentError(f"required fields are missing: {missing}")
    return docs.select(*cols)


def delete_ids(docs: DataFrame, ids: DataFrame | Iterable[str] | None, key: str = "id") -> DataFrame:
    """docs without those of the given ids; no ids, nothing deleted."""
    if ids is None:
        return docs
    if isinstance(ids, DataFrame):
        gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
        return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
    few = [i for i in ids if i is not None]
    return docs.filter(~F.coalesce(F.col(key).isin(few), F.lit(False))) if few else docs


def delete_where(docs: DataFrame, condition: Column | None) -> DataFrame:
    """docs without those that meet a condition; unknown counts as not met."""
    return docs if condition is None else docs.filter(~F.coalesce(condition, F.lit(False)))


def delete_all(docs: DataFrame) -> DataFrame:
    return docs.limit(0)


def add(docs: DataFrame, more: DataFrame) -> DataFrame:
    return docs.unionByName(more, allowMissingColumns=True)


def upsert(docs: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """docs with the new ones in place of those with the same id."""
    return add(delete_ids(docs, more.select(key), key), more)


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, key: str = "id", name: str = "children") -> DataFrame:
    """Parents with the list of their child documents (structs, by content); an empty list if none."""
    rest = [c for c in children.columns if c != parent_key]
    lists = children.groupBy(F.col(parent_key).alias("__parent")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, F.col(key) == F.col("__parent"), "left").drop("__parent").withColumn(name, F.coalesce(name, empty))


def has_children(name: str = "children") -> Column:
    return F.size(F.coalesce(F.col(name), F.array())) > 0
