"""Op 8. Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, digits, plus signs, URL schemes and
identifier cues. A local parser at each anchor then expands to the value's boundaries and
validates it; parsers are deterministic and read each character a bounded number of times.

Kinds, in the order of results: email, ip, card, phone (the base kinds), then url, account
and secret (a key or token that is assigned to a name, of 16 characters or more with letters
and digits). Within a kind spans do not overlap; across kinds they may. Offsets count code
points, ends exclusive.

Defined results: a null text counts as empty and has no spans; texts of any length are
read whole; repeated rows give repeated results; an empty table gives an empty result;
further columns do not take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textops

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "mailto:", "sftp://")
CUES = ("iban", "ssn", "passport", "account no", "account number", "acct", "routing number", "tax id", "social security")
SECRETS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "secret key", "secret_key", "private key", "private_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CLUSTER = frozenset("0123456789 .()+-")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_ACCOUNT = re.compile(r"[\s:#.=-]{1,4}((?:[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){10,30})|[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[ \t]{0,3}[\"'`]?[ \t]{0,3}(?::=|=>|[=:])[ \t]{0,3}[\"'`]?([A-Za-z0-9_+/.~-]{16,}={0,2})")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]
_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _automata:
        made = ahocorasick.Automaton()
        for word in ("@", "+", *"0123456789"):
            made.add_word(word, ("@" if word == "@" else "+" if word == "+" else "0", 1))
        for word in SCHEMES:
            for form in {word, word.upper(), word.capitalize()}:
                made.add_word(form, ("url", len(word)))
        for kind, words in (("cue", CUES), ("secret", SECRETS)):
            for word in words:
                for form in {word, word.upper(), word.capitalize(), word.title()}:
                    made.add_word(form, (kind, len(word)))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    rest = 0
    for c in value[4:] + value[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _email(text: str, at: int, least: int) -> Span | None:
    """The address around an at-sign whose local part starts at `least` or later."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (domain := _DOMAIN.match(text, at + 1)):
        return None
    return start, domain.end()


def _cluster(text: str, at: int, least: int) -> Span:
    """The run of number characters around an anchor; no ip, card or phone crosses its ends."""
    start, end = at, at + 1
    while start > least and text[start - 1] in _CLUSTER:
        start -= 1
    while end < len(text) and text[end] in _CLUSTER:
        end += 1
    return start, end


def _numbers(text: str, start: int, end: int, found: dict[str, list[Span]]) -> None:
    groups = [m.span() for m in _DIGITS.finditer(text, start, end)]
    i = 0
    while i + 3 < len(groups):
        four = groups[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
                found["ip"].append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    for m in _CARD.finditer(text, start, end):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if text.find("+", start, end) >= 0:
        for m in _PHONE.finditer(text, start, end):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())


def spans(text: str) -> dict[str, list[Span]]:
    """All spans of a text by kind, each kind by start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    email_end = cluster_end = url_end = account_end = secret_end = 0
    for last, (kind, length) in _automaton().iter(text):
        if kind == "@":
            if last >= email_end and (got := _email(text, last, email_end)):
                found["email"].append(got)
                email_end = got[1]
        elif kind in "0+":
            if last >= cluster_end:
                start, cluster_end = _cluster(text, last, cluster_end)
                _numbers(text, start, cluster_end, found)
        elif kind == "url":
            start = last + 1 - length
            if start >= url_end and not (start and text[start - 1].isalnum()) and (rest := _URL.match(text, last + 1)):
                end = rest.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > last + 1 and ("." in text[last + 1 : end] or "@" in text[last + 1 : end] or ":" in text[last + 1 : end]):
                    found["url"].append((start, end))
                    url_end = end
        elif kind == "secret":
            start = last + 1 - length
            if start < secret_end or start and text[start - 1].isalnum() or not (got := _SECRET.match(text, last + 1)):
                continue
            secret_end = got.end(1)
            if _LETTER.search(text, *got.span(1)) and _DIGIT.search(text, *got.span(1)):
                found["secret"].append(got.span(1))
        else:
            start = last + 1 - length
            if start < account_end or start and text[start - 1].isalnum() or not (got := _ACCOUNT.match(text, last + 1)):
                continue
            value = got[1]
            if _iban(value) or not value[:2].isalpha() and len(_NOT_DIGIT.sub("", value)) >= 6:
                found["account"].append(got.span(1))
                account_end = got.end(1)
    return found


def listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str, found: dict[str, list[Span]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind's tag."""
    every = sorted((a, -b, k) for k in KINDS for a, b in found[k])
    out, at = [], 0
    for a, b, k in every:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long, n_secret long, n_spans long"


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document the count of each kind, a digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in textops.strings(batch, "text"):
                found = spans(x.as_py())
                rows.append((*(len(found[k]) for k in BASE), hashlib.sha256(listed(found, BASE).encode()).hexdigest(), listed(found, KINDS), *(len(found[k]) for k in KINDS[len(BASE) :]), sum(map(len, found.values()))))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 10, kinds))], names=[f.split()[0] for f in FIELDS.split(", ")])

    return store.mapped(docs.select("doc_id", "text"), run, FIELDS)


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by tags; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [None if x is None else redact(x, spans(x)) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = store.mapped(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
