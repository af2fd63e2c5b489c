"""Namespaces and their prefixes: a small fixed table, extended by settings."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.sorts import numbered

from .text import IRI_ESCAPES, escape_chars


class Namespace(NamedTuple):
    prefix: str
    iri: str
    validate: bool = True


# Well-known namespaces, and whether names in them are validated. Project-specific ones come from settings.
KNOWN = (
    Namespace("owl", "http://www.w3.org/2002/07/owl#"),
    Namespace("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    Namespace("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    Namespace("foaf", "http://xmlns.com/foaf/0.1/"),
    Namespace("geo", "http://www.w3.org/2003/01/geo/wgs84_pos#"),
    Namespace("georss", "http://www.georss.org/georss/"),
    Namespace("gml", "http://www.opengis.net/gml/"),
    Namespace("xsd", "http://www.w3.org/2001/XMLSchema#"),
    Namespace("dc", "http://purl.org/dc/elements/1.1/"),
    Namespace("dct", "http://purl.org/dc/terms/"),
    Namespace("skos", "http://www.w3.org/2004/02/skos/core#"),
    Namespace("schema", "http://schema.org/", False),
    Namespace("bibo", "http://purl.org/ontology/bibo/", False),
    Namespace("wikidata", "http://www.wikidata.org/entity/", False),
    Namespace("d0", "http://www.ontologydesignpatterns.org/ont/d0.owl#", False),
    Namespace("dul", "http://www.ontologydesignpatterns.org/ont/dul/DUL.owl#", False),
    Namespace("rr", "http://www.w3.org/ns/r2rml#"),
    Namespace("rml", "http://semweb.mmlab.be/ns/rml#"),
    Namespace("ql", "http://semweb.mmlab.be/ns/ql#"),
    Namespace("fnml", "http://semweb.mmlab.be/ns/fnml#"),
    Namespace("fno", "http://w3id.org/function/ontology#"),
    Namespace("crml", "http://semweb.mmlab.be/ns/crml#"),
    Namespace("nif", "http://persistence.uni-leipzig.org/nlp2rdf/ontologies/nif-core#"),
    Namespace("html", "http://www.w3.org/1999/xhtml/"),
    Namespace("cidoccrm", "http://purl.org/NET/cidoc-crm/core#", False),
    Namespace("bio", "http://purl.org/vocab/bio/0.1/", False),
)


class Namespaces:
    """A table of namespaces. The first prefix of an IRI and the first IRI of a prefix hold."""

    def __init__(self, more: dict[str, str] | Iterable[Namespace] = ()):
        extra = [Namespace(p, i) for p, i in more.items()] if isinstance(more, dict) else list(more)
        self.table: list[Namespace] = []
        for n in (*extra, *KNOWN):
            if all(n.iri != m.iri and n.prefix != m.prefix for m in self.table):
                self.table.append(n)

    def _pick(self, key: Column, values: dict, default: Column) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)

    def full_iri(self, name: Column | str, default: str = "") -> Column:
        """The IRI of a prefixed name; a name without a known prefix goes to the default namespace whole.

        Local parts are escaped as IRIs need it.
        """
        name = F.col(name) if isinstance(name, str) else name
        known = self._known(name)
        local = F.when(known, F.substring(name, F.instr(name, ":") + 1, F.length(name))).otherwise(name)
        space = F.when(known, self._pick(self._prefix(name), {n.prefix: n.iri for n in self.table}, F.lit(default))).otherwise(F.lit(default))
        return F.concat(space, escape_chars(local, IRI_ESCAPES))

    @staticmethod
    def _prefix(name: Column) -> Column:
        return F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1))

    def _known(self, name: Column) -> Column:
        return F.coalesce(self._prefix(name).isin(*(n.prefix for n in self.table)), F.lit(False))

    def validated(self, name: Column | str) -> Column:
        """True if the name's prefix is known and its namespace asks for validation."""
        name = F.col(name) if isinstance(name, str) else name
        return F.coalesce(self._prefix(name).isin(*(n.prefix for n in self.table if n.validate)), F.lit(False))

    def _best(self, iri: Column) -> tuple[Column, Column]:
        """Prefix and IRI of the longest namespace that the IRI begins with; nulls if none."""
        longest = sorted(self.table, key=lambda n: -len(n.iri))
        prefix = space = F.lit(None).cast("string")
        for n in reversed(longest):
            hit = F.startswith(iri, F.lit(n.iri))
            prefix, space = F.when(hit, n.prefix).otherwise(prefix), F.when(hit, n.iri).otherwise(space)
        return prefix, space

    def split(self, df: DataFrame, column: str) -> DataFrame:
        """df with `ns_prefix`, `ns_iri` and `local_name` of an IRI column.

        An IRI in no known namespace is cut after its last slash or hash; such namespaces are
        named uns1, uns2, … in the order of their IRIs. Null IRIs get nulls.
        """
        cut = F.regexp_extract(column, r"\A(?s:.*)[/#]", 0)
        prefix, space = self._best(F.col(column))
        marked = df.withColumn("ns_prefix", prefix).withColumn("ns_iri", F.when(F.col(column).isNotNull(), F.coalesce(space, cut)))
        # one row for each unknown namespace of the data's predicates
        unknown = marked.filter(F.col("ns_prefix").isNull() & F.col("ns_iri").isNotNull()).select(F.col("ns_iri").alias("u_iri")).distinct()
        unknown = numbered(unknown, ["u_iri"], "u_rank").select("u_iri", F.concat(F.lit("uns"), F.col("u_rank")).alias("u_prefix"))
        out = marked.join(unknown, (F.col("ns_iri") == F.col("u_iri")) & F.col("ns_prefix").isNull(), "left")
        out = out.withColumn("ns_prefix", F.coalesce("ns_prefix", "u_prefix")).drop("u_iri", "u_prefix")
        return out.withColumn("local_name", F.substring(F.col(column), F.length("ns_iri") + 1, F.length(column)))
