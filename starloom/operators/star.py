"""Entity documents: everything that several datasets say about a subject, as one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.uris import wiki_decode
from starloom.schema import ORIGIN

from .filters import without_titles
from .merges import attach, drop_linked

# Predicates of the fields.
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
NAME = "http://xmlns.com/foaf/0.1/name"
NICK = "http://xmlns.com/foaf/0.1/nick"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBJECT = "http://purl.org/dc/terms/subject"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
EXACT_MATCH = "http://www.w3.org/2004/02/skos/core#exactMatch"
RANK = "http://purl.org/voc/vrank#rankValue"


@dataclass(frozen=True)
class StarRules:
    """What depends on the data: where resources and the ontology live, and which titles there are."""

    resource_base: str = ""
    ontology_base: str = ""
    title_properties: tuple[str, ...] = ("title", "alternativeTitle", "originalTitle", "subtitle", "tag")
    unwanted: str = "^Category:"


def clean(x: Column, rules: StarRules) -> Column:
    return F.regexp_replace(x, rules.unwanted, "")


def _last_segment(x: Column) -> Column:
    return wiki_decode(F.substring_index(x, "/", -1))


def _listed(condition: Column, order: Column) -> Column:
    """Values of the statements that meet a condition, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(order.alias("o"), F.col("value").alias("v"))))), lambda s: s["v"])


def entity_documents(rows: DataFrame, rules: StarRules | None = None, redirects: DataFrame | None = None, disambiguations: DataFrame | None = None) -> DataFrame:
    """One document for each subject of tagged rows (see merges): a single shuffle by subject.

    Statements that no field takes leave no more than their subject in what is shuffled. "First" is by source and
    origin. Entities that are themselves redirects or disambiguations are dropped, and those
    that others point to list them. Null subjects give no document.
    """
    rules = rules or StarRules()
    p, order = F.col("predicate"), F.struct(*(c for c in ("_source", *ORIGIN, "predicate", "value") if c in rows.columns))
    titles = [rules.ontology_base + t for t in rules.title_properties]
    named = F.startswith(p, F.lit(rules.ontology_base)) & F.contains(F.lower(p), F.lit("name")) if rules.ontology_base else F.lit(False)
    alternative = p.isin(NAME, NICK, *titles) | named
    few = rows.filter(F.col("subject").isNotNull())
    docs = few.groupBy(F.col("subject").alias("id")).agg(
        _listed(p == LABEL, order).alias("labels"),
        F.min_by(F.when(p == COMMENT, F.col("value")), F.when(p == COMMENT, order)).alias("comment"),
        _listed(p == TYPE, order).alias("type_uri"),
        F.min_by(F.when(p == RANK, F.col("value")), F.when(p == RANK, order)).try_cast("float").alias("pagerank"),
        _listed(alternative, order).alias("others"),
        F.array_distinct(_listed(p.isin(SAME_AS, EXACT_MATCH), order)).alias("same_as_uri"),
        F.array_distinct(_listed(p == SUBJECT, order)).alias("subjects_uri"),
    )
    docs = docs.withColumn("title", clean(wiki_decode(F.when(F.startswith(F.col("id"), F.lit(rules.resource_base)), F.substring(F.col("id"), F.lit(len(rules.resource_base) + 1), F.length("id"))).otherwise(F.col("id"))), rules))
    docs = without_titles(docs)
    docs = drop_linked(docs, *(d for d in (redirects, disambiguations) if d is not None))
    alt = F.array_distinct(F.concat(F.slice("labels", 2, F.greatest(F.size("labels"), F.lit(1))), F.col("others")))
    docs = docs.withColumn("alt_label", F.transform(alt, lambda x: clean(x, rules))).withColumn("label", clean(F.try_element_at("labels", F.lit(1)), rules))
    for name, links in (("redirects", redirects), ("disambiguations", disambiguations)):
        docs = attach(docs, links, f"{name}_uri") if links is not None else docs.withColumn(f"{name}_uri", F.lit(None).cast("array<string>"))
    uris = ("same_as_uri", "subjects_uri", "redirects_uri", "disambiguations_uri")
    docs = texts(docs, uris, rules)
    return docs.select("id", "title", "label", "comment", "pagerank", "type_uri", "alt_label", *(c for u in uris for c in (u, u.replace("_uri", "_text"))), positions(("alt_label", "same_as_text", "redirects_text", "disambiguations_text")).alias("dynamic"))


def texts(docs: DataFrame, uris: tuple[str, ...], rules: StarRules) -> DataFrame:
    """docs with, for each list of IRIs, the readable last segments.

    IRIs with escapes are decoded as one joined text a row; a list without any stays in SQL.
    """
    for u in uris:
        segments = F.transform(F.col(u), lambda x: F.substring_index(x, "/", -1))
        joined = wiki_decode(F.array_join(segments, "\n"))
        plain = F.split(joined, "\n")
        docs = docs.withColumn(u.replace("_uri", "_text"), F.when(F.size(u) > 0, F.transform(plain, lambda x: clean(F.trim(x), rules))).otherwise(F.col(u)))
    return docs


def positions(fields: tuple[str, ...]) -> Column:
    """A map of the lists' members by name and place: alt_label_0, alt_label_1, …"""

    def entries(field: str) -> Column:
        members = F.coalesce(F.col(field), F.array().cast("array<string>"))
        return F.map_from_entries(F.transform(members, lambda x, i: F.struct(F.concat(F.lit(f"{field}_"), i.cast("string")).alias("key"), x.alias("value"))))

    return F.map_concat(*map(entries, fields))
