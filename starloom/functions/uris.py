"""IRI functions: percent decoding, canonical resource IRIs, URI checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NAME_ESCAPES, clean_space, escape_chars, percent_pairs, wiki_encode

_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Escapes that IRI decoding keeps (the last one stands for the pipe in existing data).
KEPT_ESCAPES = ("%3F", "%23", "%5B", "%5D", "%7D")
# Schemes of links that are taken over.
KNOWN_SCHEMES = ("http", "https", "ftp")
#: Dropped from resource names, but for the space, which becomes an underscore.
_INVISIBLE = " \u00a0\u200e\u200f\u2028\u202a\u202b\u202c\u3000"
_ESCAPED = dict(percent_pairs(NAME_ESCAPES))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percent_decode(s: str) -> str:
    """Runs of percent escapes as UTF-8; malformed bytes become U+FFFD, other text stays."""
    return _RUN.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), s)


_UNIT = re.compile(r"\[[^\]]*\]?|(?:%[^%]?[^%]?)+", re.S)
_UPPER = re.compile(r"%[0-9A-F]{2}")


def iri_decode_once(s: str) -> str:
    """As percent_decode, but plus signs are spaces (unless one leads or %20 occurs), brackets shield
    their content, lower-case escapes and those of reserved characters stay."""
    if s.find("+") > 0 and "%20" not in s:
        s = s.replace("+", " ")
    if "%" not in s:
        return s

    def run(m: re.Match) -> str:
        if m[0][0] == "[":
            return m[0]
        out = bytearray()
        for unit in re.findall(r"%[^%]?[^%]?", m[0], re.S):
            # what follows a valid escape or an incomplete one is plain text
            if _UPPER.match(unit) and unit not in KEPT_ESCAPES:
                out.append(int(unit[1:], 16))
            else:
                out += unit.encode()
        return out.decode("utf-8", "replace")

    return _UNIT.sub(run, s)


def _settled(s: str, step) -> str:
    while (t := step(s)) != s:
        s = t
    return s


@F.pandas_udf(T.StringType())
def _percent_decoded(s: pd.Series) -> pd.Series:
    return s.map(percent_decode, na_action="ignore")


@F.pandas_udf(T.StringType())
def _iri_decoded(s: pd.Series) -> pd.Series:
    return s.map(iri_decode_once, na_action="ignore")


@F.pandas_udf(T.StringType())
def _iri_settled(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _settled(x, iri_decode_once), na_action="ignore")


def decode_uri(x: Column | str) -> Column:
    """Percent-decoded text. Texts without a percent sign never leave the JVM."""
    x = _col(x)
    return F.coalesce(_percent_decoded(F.when(F.contains(x, F.lit("%")), x)), x)


def decode_iri(x: Column | str, settle: bool = False) -> Column:
    """IRI-decoded text; settle: over and over, until nothing changes."""
    x = _col(x)
    return F.coalesce((_iri_settled if settle else _iri_decoded)(F.when(x.rlike("[%+]"), x)), x)


def wiki_decode(x: Column | str) -> Column:
    return clean_space(decode_uri(x))


def scheme(x: Column | str) -> Column:
    """The scheme of an absolute URI; null for anything that java.net.URI rejects or that is relative."""
    return F.try_parse_url(_col(x), F.lit("PROTOCOL"))


def _part(x: Column, name: str) -> Column:
    return F.try_parse_url(x, F.lit(name))


def is_uri(x: Column | str) -> Column:
    """True for absolute and relative URIs, false for malformed ones and null."""
    x = _col(x)
    return _part(x, "PROTOCOL").isNotNull() | _part(x, "PATH").isNotNull()


def has_known_scheme(x: Column | str) -> Column:
    return _col(x).rlike(r"\A(https?|ftp)://")


def _without_dots(path: str) -> str:
    """The path without . and .. segments; .. at the start stay, as do double slashes only once."""
    lead, out = path.startswith("/"), []
    parts = [p for i, p in enumerate(path.split("/")) if p or i == len(path.split("/")) - 1]
    tail = path.endswith("/") or parts[-1:] in (["."], [".."])
    for p in parts:
        if p == "..":
            if out and out[-1] != "..":
                out.pop()
                continue
        elif p in (".", ""):
            continue
        out.append(p)
    return ("/" if lead else "") + "/".join(out) + ("/" if tail and out else "")


@F.pandas_udf(T.StringType())
def _normal_path(s: pd.Series) -> pd.Series:
    return s.map(_without_dots, na_action="ignore")


def clean_link(x: Column | str) -> Column:
    """The link without dot segments if its scheme is a known one, else null."""
    x = _col(x)
    path = _part(x, "PATH")
    dotted = path.rlike(r"(^|/)\.{1,2}(/|$)|//")
    plain = F.coalesce(_normal_path(F.when(dotted, path)), path)
    rest = F.concat(F.coalesce(F.concat(F.lit("?"), _part(x, "QUERY")), F.lit("")), F.coalesce(F.concat(F.lit("#"), _part(x, "REF")), F.lit("")))
    whole = F.concat(scheme(x), F.lit("://"), _part(x, "AUTHORITY"), plain, rest)
    return F.when(scheme(x).isin(*KNOWN_SCHEMES), F.when(dotted, whole).otherwise(x))


def relativize(parent: Column | str, child: Column | str) -> Column:
    """The path from a parent folder to the child; null if it does not lie below."""
    parent, child = _col(parent), _col(child)
    folder = F.when(F.endswith(parent, F.lit("/")), parent).otherwise(F.concat(parent, F.lit("/")))
    return F.when(child == parent, "").when(F.startswith(child, folder), F.substring(child, F.length(folder) + 1, F.length(child)))


def _unescape_java(s: str) -> str:
    named = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    return re.sub(r"\\(?:u+([0-9a-fA-F]{4})|([0-3]?[0-7]{1,2})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2], 8)) if m[2] else named.get(m[3], m[3]), s, flags=re.S)


@F.pandas_udf(T.StringType())
def _java_unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _unescape_java(x).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), na_action="ignore")


def unescape_java(x: Column | str) -> Column:
    x = _col(x)
    return F.coalesce(_java_unescaped(F.when(F.contains(x, F.lit("\\")), x)), x)


def create_uri(x: Column | str) -> Column:
    """Unescaped, form-decoded and re-encoded; null where that gives no URI or holds a backslash."""
    plain = F.try_url_decode(unescape_java(x))
    made = escape_chars(plain, "\"<>[\\]^`{|}")
    return F.when(~F.contains(plain, F.lit("\\")) & is_uri(made), made)


def _clean_part(s: str) -> str:
    s = _settled(s, percent_decode)
    return "".join(_ESCAPED.get(c, c) if c in "<>\"#%?[\\]^`{|}" else c for c in s)


def _resource(s: str, marker: str) -> str:
    at = s.index(marker) + len(marker)
    rest, _, fragment = s[at:].partition("#")
    has_fragment = "#" in s[at:]
    name, q, query = rest.partition("?")
    out = s[:at] + _clean_part(name)
    if q:
        out += "?" + _clean_part(query)
    if has_fragment:
        out += "#" + _clean_part(fragment)
    return out


def resource_uri(x: Column | str, base: str) -> Column:
    """The canonical URI of a resource whose IRI holds `base`; other URIs as create_uri has them.

    Spaces become underscores, invisible characters go, name, query and fragment are decoded
    until nothing changes and encoded again. Null where the result is no URI.
    """
    text = F.translate(unescape_java(x), _INVISIBLE, "_")
    inside = F.contains(text, F.lit(base))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _resource(v, base), na_action="ignore")

    made = run(F.when(inside, text))
    return F.when(inside, F.when(is_uri(made), made)).otherwise(create_uri(F.when(~inside, text)))


def uri_to_iri(x: Column | str, base: str) -> Column:
    """The resource's IRI: readable characters instead of escapes, reserved ones kept; null for what is no hierarchical URI."""
    uri = resource_uri(x, base)

    def readable(part: Column) -> Column:
        return F.replace(wiki_encode(decode_iri(part, settle=True)), F.lit("%25"), F.lit("%"))

    query, ref = (readable(_part(uri, p)) for p in ("QUERY", "REF"))
    return F.concat(scheme(uri), F.lit("://"), _part(uri, "AUTHORITY"), readable(_part(uri, "PATH")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.coalesce(F.concat(F.lit("#"), ref), F.lit("")))

