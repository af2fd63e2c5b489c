"""String, number and time functions as Spark columns.

Everything that SQL can say is SQL; but for replace_by, whose function is the caller's, no
text leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are percent-escaped in names, and in local parts of IRIs.
NAME_ESCAPES = "\"#%<>?[\\]^`{|}"
IRI_ESCAPES = "".join(map(chr, range(0x21))) + NAME_ESCAPES + "".join(map(chr, range(0x7F, 0xA0)))
#: Kept lower: their capitals are several letters.
NOT_CAPITALISED = "ßﬁﬀﬂﬃﬄﬅﬆ"

_CONTROLS = [chr(c) for c in (*range(0x20), *range(0x7F, 0xA0))]
_HEX_ESCAPED = [c for c in _CONTROLS if c not in "\n\r\t"]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each left string replaced by its right one, in order."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def _only_where(pattern: str, x: Column, change: Callable[[Column], Column]) -> Column:
    return F.when(x.rlike(pattern), change(x)).otherwise(x)


def _once(x: Column, make: Callable[[Column], Column]) -> Column:
    """make(x), where x is computed once however often it is used."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def _regex_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


# --- Turtle / N-Triples escapes -------------------------------------------------------------

_SHORT = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
_BEYOND_ASCII = "[^ -~]"
_HEX4 = "[0-9a-fA-F]{4}"
_NO_SURROGATE = "(?![dD][89a-fA-F])"
#: What unescapes. Possessive quantifiers keep the matcher iterative, here and below.
_ESCAPED = rf"""(?s)\A(?:[^\\]++|\\(?:["trn\\]|u{_NO_SURROGATE}{_HEX4}|U(?:0000{_NO_SURROGATE}|000[1-9a-fA-F]|0010){_HEX4}))*+\z"""


def _in_pieces(x: Column, some: str, piece: str, change: Callable[[Column], Column]) -> Column:
    """Each match of `piece` changed. Matches of `some`, a bounded number of pieces, are done one
    after the other, so that a long text is never in memory as pieces. Every character is in a match of both."""

    def changed(part: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(part, F.lit(piece), F.lit(0)), change), "")

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(some), F.lit(0)), changed), "")


def _escape_beyond_ascii(x: Column) -> Column:
    def escaped(run: Column) -> Column:
        short = F.regexp_replace(F.hex(F.encode(run, "UTF-16BE")), "(.{4})", r"\\u$1")
        long = F.regexp_replace(F.hex(F.encode(run, "UTF-32")), "(.{8})", r"\\U$1")
        return F.when((run >= " ") & (run < "\x7f"), run).when(run < "\U00010000", short).otherwise(long)

    wide = r"\x{10000}-\x{10FFFF}"
    return _in_pieces(x, "(?s).{1,4096}+", f"[ -~]++|[{wide}]++|[^ -~{wide}]++", escaped)


def escape_short(x: Column | str) -> Column:
    """The escapes of one letter: backslash, double quote, line ends and tab."""
    return _only_where(r'[\\"\n\r\t]', _col(x), lambda c: replaced(c, _SHORT))


def escape_numeric(x: Column | str, turtle: bool = True) -> Column:
    """Escapes by code point: for control characters (turtle), or for all but printable ASCII."""
    x = _col(x)
    if turtle:
        return _only_where(_regex_class("".join(_HEX_ESCAPED)), x, lambda c: replaced(c, [(k, f"\\u{ord(k):04X}") for k in _HEX_ESCAPED]))
    return _once(x, lambda c: _only_where(_BEYOND_ASCII, c, _escape_beyond_ascii))


def escape_turtle(x: Column | str, turtle: bool = True) -> Column:
    """Literal text as Turtle (characters from U+00A0 on kept) or N-Triples (all escaped) has it."""
    return escape_numeric(escape_short(x), turtle)


def _unescape(x: Column) -> Column:
    def plain(run: Column) -> Column:
        short = F.decode(F.unhex(F.replace(run, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        # a byte order mark goes first, as the decoder takes one away
        long = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.replace(run, F.lit("\\U"), F.lit("")))), "UTF-32")
        single = F.translate(F.substring(run, 2, 1), "trn", "\t\r\n")
        return F.when(~F.startswith(run, F.lit("\\")), run).when(F.startswith(run, F.lit("\\u")), short).when(F.startswith(run, F.lit("\\U")), long).otherwise(single)

    escape = rf"\\(?:u{_HEX4}|U.{{8}}|.)"
    return _in_pieces(x, rf"(?s)(?:[^\\]{{1,4096}}+|{escape}){{1,256}}+", rf"(?s)[^\\]++|(?:\\u{_HEX4})++|(?:\\U.{{8}})++|\\.", plain)


def unescape_turtle(x: Column | str) -> Column:
    """The inverse of escape_turtle; null where an escape is unknown or cut short, or no character."""
    return _once(_col(x), lambda c: F.when(~F.contains(c, F.lit("\\")), c).when(c.rlike(_ESCAPED), _unescape(c)))


# --- XML and JSON ---------------------------------------------------------------------------


def escape_xml(x: Column | str) -> Column:
    """Entities for < > & and the double quote; control characters other than line ends and tabs are dropped."""
    x = F.regexp_replace(_col(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return replaced(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def escape_json(x: Column | str) -> Column:
    """A JSON string's content, with the solidus and all control characters escaped."""
    short = [("\\", "\\\\"), ('"', '\\"'), ("/", "\\/"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    rest = [c for c in _CONTROLS if c not in "\b\f\n\r\t"]
    return _only_where(_regex_class("".join(rest)), replaced(_col(x), short), lambda c: replaced(c, [(k, f"\\u{ord(k):04x}") for k in rest]))


# --- general strings --------------------------------------------------------------------------


def percent_pairs(chars: str) -> list[tuple[str, str]]:
    """Each character with its UTF-8 bytes in percent form; the percent sign itself first."""
    ordered = sorted(chars, key=lambda c: c != "%")
    return [(c, "".join(f"%{b:02X}" for b in c.encode())) for c in ordered]


def escape_chars(x: Column | str, chars: str = NAME_ESCAPES, sign: str = "%") -> Column:
    """The given characters as sign and hex of their UTF-8 bytes."""
    pairs = [(c, p.replace("%", sign)) for c, p in percent_pairs(chars)]
    if sign in chars:
        pairs.sort(key=lambda p: p[0] != sign)
    return _only_where(_regex_class(chars), _col(x), lambda c: replaced(c, pairs))


def replace_chars(x: Column | str, chars: str, by: str) -> Column:
    """Each character by the one at its place; those beyond `by` are deleted."""
    return F.translate(_col(x), chars, by)


def md5_hex(x: Column | str) -> Column:
    return F.md5(_col(x).cast("binary"))


def longest_prefix(a: Column | str, b: Column | str) -> Column:
    """The longest common prefix, in code points, found by halving: 31 comparisons a row at most."""
    a, b = _col(a), _col(b)
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))

    def longer(n: Column, step: Column) -> Column:
        fits = (n <= most - step) & (F.left(a, n + step) == F.left(b, n + step))
        return F.when(fits, n + step).otherwise(n)

    return F.left(a, F.aggregate(steps, F.lit(0), longer))


def int_literal(x: Column | str) -> Column:
    """The 32-bit integer that the text spells, else null."""
    x = _col(x)
    return F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("int"))


def boolean_literal(x: Column | str) -> Column:
    low = F.lower(_col(x))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def capitalize(x: Column | str) -> Column:
    """The first character in upper case, unless its capital is several letters."""
    x = _col(x)
    first = F.left(x, F.lit(1))
    return F.when(first.isin(*NOT_CAPITALISED), x).otherwise(F.concat(F.upper(first), F.substring(x, F.lit(2), F.length(x))))


def uncapitalize(x: Column | str) -> Column:
    x = _col(x)
    return F.concat(F.lower(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))


def camel_case(x: Column | str, split_at: str = r"[ _]+") -> Column:
    """Words joined, each but the first capitalised."""
    words = F.split(_col(x), split_at)
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(capitalize(w))), "")


def replace_by(x: Column | str, pattern: str, make: Callable[[re.Match], str]) -> Column:
    """Every match of a Python pattern by what `make` gives for it."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: re.sub(pattern, make, v), na_action="ignore")

    return run(_col(x))


def trim_split(x: Column | str, sep: str = ",") -> Column:
    """Parts between runs of the separator or white space, without empty ones."""
    return F.filter(F.split(_col(x), f"(?:{re.escape(sep)}|\\s)+"), lambda p: p != "")


# --- wiki titles ------------------------------------------------------------------------------

_SPACES = "_\u00a0\u200e\u200f\u2028\u202a\u202b\u202c\u3000"  # the first two become spaces, the rest go


def clean_space(x: Column | str) -> Column:
    one = F.regexp_replace(F.translate(_col(x), _SPACES, "  "), " +", " ")
    return F.regexp_replace(one, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def wiki_encode(x: Column | str) -> Column:
    """A page name: spaces and underscores as single underscores, none at the ends, reserved characters escaped."""
    x = F.regexp_replace(F.regexp_replace(_col(x), "[ _]+", "_"), r"\A_|_\z", "")
    return escape_chars(x)


def remove_emphasis(x: Column | str) -> Column:
    x = _col(x)
    for marks in ("'''''", "'''", "''"):
        x = F.regexp_replace(x, f"(?s){marks}(.*?){marks}", "$1")
    return x


def encode_component(x: Column | str) -> Column:
    """Form encoding, with %20 for spaces and ! ' ( ) ~ kept."""
    return replaced(F.url_encode(_col(x)), [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")])


# --- times and numbers ------------------------------------------------------------------------


def _whole(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def format_timestamp(ms: Column | str) -> Column:
    """UTC, to the second, years of as many digits as they have and no sign; '' before 1970."""
    ms = _col(ms).cast("long")
    seconds = _whole(ms, 1000)
    days, rest = _whole(seconds, 86_400), (seconds % 86_400).cast("int")
    # the calendar repeats after 400 years; dates of the first ones are enough for any number
    day = F.date_from_unix_date((days % 146_097).cast("int"))
    year = F.year(day) + _whole(days, 146_097) * 400
    clock = F.format_string("T%02d:%02d:%02dZ", _whole(rest, 3600), _whole(rest % 3600, 60), rest % 60)
    return F.when(ms < 0, "").otherwise(F.concat(year.cast("string"), F.date_format(day, "-MM-dd"), clock))


def parse_timestamp(x: Column | str) -> Column:
    """Milliseconds since 1970; -1 for null, empty or no time with a zone."""
    x = _col(x)
    good = F.when(x.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}(:?\d{2})?)\z"), F.try_to_timestamp(x))
    return F.coalesce(F.unix_millis(good), F.lit(-1).cast("long"))


def pretty_millis(ms: Column | str) -> Column:
    """mm:ss.SSSs, minutes without bound."""
    ms = _col(ms).cast("long")
    return F.format_string("%02d:%02d.%03ds", F.floor(ms / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000), F.pmod(ms, F.lit(1000)))


def to_hex(n: Column | str, digits: int) -> Column:
    """Upper-case hex of exactly so many digits (16 at most); higher ones are cut, negatives wrap."""
    return F.right(F.lpad(F.hex(_col(n).cast("long")), 16, "0"), F.lit(digits))


def from_hex(x: Column | str, bits: int = 32) -> Column:
    """The signed integer of up to bits/4 hex digits; null for anything else."""
    x = _col(x)
    wide = F.lpad(x, bits // 4, "0")
    high = F.conv(F.substring(wide, F.lit(1), F.lit(bits // 8)), 16, 10).cast("long")
    low = F.conv(F.substring(wide, F.lit(bits // 8 + 1), F.lit(bits // 8)), 16, 10).cast("long")
    span = 1 << (bits // 2)
    signed = F.when(high >= span // 2, high - span).otherwise(high)
    good = x.rlike(rf"\A[0-9a-fA-F]{{1,{bits // 4}}}\z")
    return F.when(good, signed * F.lit(span).cast("long") + low).cast("int" if bits == 32 else "long")
