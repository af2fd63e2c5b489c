"""Statements as text: N-Triples, N-Quads, Turtle-style lines, TriX and RDF/JSON."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.text import escape_json, escape_numeric, escape_short, escape_xml
from starloom.schema import LANG_STRING, XSD_STRING
from starloom.sources.headers import stamp

BAD = "BAD URI: "


class Format(NamedTuple):
    family: str
    quads: bool
    turtle: bool


REGISTRY = {
    "trix-triples": Format("trix", False, True),
    "trix-quads": Format("trix", True, True),
    "turtle-triples": Format("terse", False, True),
    "turtle-quads": Format("terse", True, True),
    "n-triples": Format("terse", False, False),
    "n-quads": Format("terse", True, False),
    "rdf-json": Format("json", False, True),
}


def _good(u: Column) -> Column:
    return F.try_parse_url(u, F.lit("PROTOCOL")).isNotNull()


def checked_uri(u: Column) -> Column:
    """The URI itself, or what is wrong with it."""
    relative = F.try_parse_url(u, F.lit("PATH")).isNotNull()
    return F.when(u.isNull(), BAD + "null").when(_good(u), u).when(relative, F.concat(F.lit(BAD + "not absolute: "), u)).otherwise(F.concat(F.lit(BAD + "malformed: "), u))


def _bracketed(x: Column) -> Column:
    # what is wrong with a URI is told in a lambda, which keeps that rare branch out of the generated code
    told = F.transform(F.array(x), lambda u: F.concat(F.lit("<"), escape_short(checked_uri(u)), F.lit(">")))
    return F.when(_good(x), F.concat(F.lit("<"), x, F.lit(">"))).otherwise(told[0])


def _terse(df: DataFrame, keep: list[str], f: Format, raw: bool) -> DataFrame:
    """Lines. raw: literals are as a parser left them, so escapes stay as they are.

    A statement with bad URIs is commented out, by one mark for each of them. Characters that
    need a numeric escape are escaped in the whole line at once; the line's own are none.
    Each step is a projection of its own, so that none is computed twice.
    """
    s, p, v, dt, lang, ctx = (F.col(c) for c in ("subject", "predicate", "value", "datatype", "language", "context"))
    typed = dt.isNotNull() & (dt != LANG_STRING) & (dt != XSD_STRING)
    places = {"__s": _bracketed(s), "__p": _bracketed(p), "__v": F.when(dt.isNull(), _bracketed(v)), "__t": F.when(typed, _bracketed(dt))}
    if f.quads:
        places["__c"] = F.when(ctx.isNotNull(), _bracketed(ctx))
    df = df.select(*keep, "value", "datatype", "language", *(x.alias(k) for k, x in places.items()))
    quoted = F.concat(F.lit('"'), v if raw else escape_short(v), F.lit('"'), F.when(dt == LANG_STRING, F.coalesce(F.concat(F.lit("@"), lang), F.lit(""))).when(F.col("__t").isNotNull(), F.concat(F.lit("^^"), "__t")).otherwise(""))
    marks = [F.when(F.startswith(F.col(k), F.lit("<" + BAD)), "# ").otherwise("") for k in places]
    parts = ["__s", "__p", F.coalesce("__v", quoted), *(["__c"] if f.quads else []), F.lit(".")]
    df = df.select(*keep, F.concat(*marks, F.concat_ws(" ", *parts)).alias("__line"))
    return df.select(*keep, (F.col("__line") if raw else escape_numeric("__line", f.turtle)).alias("__line"))


def _trix(df: DataFrame, keep: list[str], f: Format) -> DataFrame:
    """Graph elements of several lines each."""
    s, p, v, dt, lang, ctx = (F.col(c) for c in ("subject", "predicate", "value", "datatype", "language", "context"))
    uri = lambda x, d: F.concat(F.lit(" " * d + "<uri>"), escape_xml(checked_uri(x)), F.lit("</uri>"))
    plain = F.concat(F.lit("      <plainLiteral"), F.coalesce(F.concat(F.lit(' xml:lang="'), lang, F.lit('"')), F.lit("")), F.lit(">"), escape_xml(v), F.lit("</plainLiteral>"))
    typed = F.concat(F.lit('      <typedLiteral datatype="'), escape_xml(checked_uri(dt)), F.lit('">'), escape_xml(v), F.lit("</typedLiteral>"))
    value = F.when(dt.isNull(), uri(v, 6)).when(dt == LANG_STRING, plain).otherwise(typed)
    graph = [uri(ctx, 4)] if f.quads else []
    return df.select(*keep, F.concat_ws("\n", F.lit("  <graph>"), *graph, F.lit("    <triple>"), uri(s, 6), uri(p, 6), value, F.lit("    </triple>"), F.lit("  </graph>")).alias("__line"))


def _json(df: DataFrame, keep: list[str]) -> DataFrame:
    """Fragments with one statement each, comma included."""
    dt, lang = F.col("datatype"), F.col("language")
    texts = {"__s": checked_uri(F.col("subject")), "__p": checked_uri(F.col("predicate")), "__v": F.when(dt.isNull(), checked_uri(F.col("value"))).otherwise(F.col("value")), "__t": dt}
    df = df.select(*keep, "datatype", "language", *(F.concat(F.lit('"'), escape_json(x), F.lit('"')).alias(k) for k, x in texts.items()))
    head = F.concat(F.lit("{"), "__s", F.lit(" : { "), "__p")
    more = F.when(dt == LANG_STRING, F.coalesce(F.concat(F.lit(', "lang" : "'), lang, F.lit('"')), F.lit(""))).otherwise(F.concat(F.lit(', "datatype" : '), "__t"))
    literal = F.concat(F.lit(': [ { "value" : '), "__v", F.lit(', "type" : "literal"'), more, F.lit(" } ] "))
    iri = F.concat(F.lit(' : [ { "value" : '), "__v", F.lit(', "type" : "uri" } ]'))
    return df.select(*keep, F.concat(head, F.when(dt.isNull(), iri).otherwise(literal), F.lit(" } },")).alias("__line"))


def render(df: DataFrame, fmt: str = "n-triples", raw: bool = False, keep: Iterable[str] = (), name: str = "value") -> DataFrame:
    """df's statements as text in one of the REGISTRY's formats, without the final line end.

    keep: columns of df to carry along. raw holds for line formats: literals were parsed
    and still have their escapes.
    """
    if fmt not in REGISTRY:
        raise ValueError(f"{fmt!r} is none of {sorted(REGISTRY)}")
    f, own = REGISTRY[fmt], [f"__k{i}" for i, _ in enumerate(keep)]
    df = df.withColumns(dict(zip(own, (F.col(c) for c in keep)))) if own else df
    out = _terse(df, own, f, raw) if f.family == "terse" else _trix(df, own, f) if f.family == "trix" else _json(df, own)
    return out.select(*(F.col(k).alias(c) for k, c in zip(own, keep)), F.col("__line").alias(name))


def header(fmt: str) -> str | None:
    family = REGISTRY[fmt].family
    return f"# started {stamp()}" if family == "terse" else '<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/" >' if family == "trix" else None


def footer(fmt: str) -> str | None:
    family = REGISTRY[fmt].family
    return f"# completed {stamp()}" if family == "terse" else "</TriX>" if family == "trix" else None
