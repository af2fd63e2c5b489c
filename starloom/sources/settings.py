"""Job settings: properties or JSON files, with defaults that a job's own file overrides."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Names of serialisations that a `format.<suffix>` key may choose.
FORMATS = ("trix-triples", "trix-quads", "turtle-triples", "turtle-quads", "n-triples", "n-quads", "rdf-json")

LANGUAGE = re.compile(r"[a-z][a-z0-9-]+")
EXCLUDED = re.compile(r"!([a-z][a-z0-9-]+)")
RANGE = re.compile(r"(\d*)-(\d*)")
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
MAX_INT = 2**31 - 1


def parse_properties(text: str) -> dict[str, str]:
    """Key-value lines: `#` and `!` comments, `=`, `:` or white space between, `\\` continuations and escapes."""
    out, held = {}, ""
    for raw in text.splitlines():
        line = held + raw.lstrip(" \t\f")
        if not held and (not line or line[0] in "#!"):
            continue
        tail = len(line) - len(line.rstrip("\\"))
        if tail % 2:
            held = line[:-1]
            continue
        held = ""
        m = re.match(r"((?:\\.|[^\\=: \t\f])*)[ \t\f]*[=:]?[ \t\f]*(.*)", line, re.S)
        out[_unescaped(m[1])] = _unescaped(m[2])
    if held:
        out[_unescaped(held)] = ""
    return out


def _unescaped(s: str) -> str:
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), s, flags=re.S)


def trim_split(text: str, sep: str) -> list[str]:
    """Parts between runs of the separator or white space; empty ones are dropped."""
    return [x for x in re.split(rf"(?:{re.escape(sep)}|\s)+", text) if x]


def to_range(low: str, high: str) -> tuple[int, int]:
    """Bounds of an open range: nothing below is 0, nothing above the largest integer. ValueError if reversed."""
    lo, hi = int(low or 0), int(high or MAX_INT)
    if lo > hi:
        raise ValueError(f"{lo} > {hi}")
    return lo, hi


def parse_range(text: str) -> tuple[int, int] | None:
    m = RANGE.fullmatch(text)
    return to_range(m[1], m[2]) if m else None


def parse_version(text: str | None) -> str:
    """A version that begins with a year of this millennium and a month, such as 2016-10; else ValueError."""
    got = (text or "").strip()
    m = re.search(r"2\d{3}-\d{2}", got)
    if not m or m.end() != 7:
        raise ValueError(f"no version: {text!r}")
    return got


def parse_languages(items: list[str]) -> tuple[list[str], list[str]]:
    """Languages to take and, marked by !, to leave out."""
    out = [m[1] for x in items if (m := EXCLUDED.fullmatch(x))]
    return [x for x in items if LANGUAGE.fullmatch(x) and x not in out], out


@dataclass(frozen=True)
class Settings:
    """Values by key, as strings or JSON values."""

    values: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, *layers: Mapping[str, object]) -> Settings:
        """Later layers win."""
        merged: dict[str, object] = {}
        for layer in layers:
            merged |= layer
        return cls(merged)

    @classmethod
    def load(cls, spark: SparkSession, path: str, defaults: Mapping[str, object] | None = None) -> Settings:
        """From a .json file or else a properties file, by any path that Spark reads."""
        text = spark.read.text(path, wholetext=True).first()
        body = text[0] if text else ""
        return cls.of(defaults or {}, json.loads(body) if path.endswith(".json") else parse_properties(body))

    def string(self, key: str, required: bool = False, default: str | None = None) -> str | None:
        got = self.values.get(key)
        if got is None and required:
            raise KeyError(f"no value for {key!r}")
        return default if got is None else str(got)

    def value(self, key: str, convert: Callable[[str], object], required: bool = False):
        got = self.string(key, required)
        return None if got is None else convert(got)

    def strings(self, key: str, sep: str = ",", required: bool = False) -> list[str]:
        return trim_split(self.string(key, required) or "", sep)

    def mapping(self, key: str, sep: str = ";", required: bool = False) -> dict[str, str]:
        """`a->b` items."""
        return dict(x.split("->", 1) for x in self.strings(key, sep, required))

    def formats(self, prefix: str = "format") -> dict[str, str]:
        """Serialisation by file suffix, from `format.<suffix>=<name>[;policy]` keys."""
        out = {}
        for key in self.values:
            if key.startswith(f"{prefix}."):
                parts = self.strings(key, ";", required=True)
                if not 1 <= len(parts) <= 2 or parts[0] not in FORMATS:
                    raise ValueError(f"{key}: {parts} must name one of {sorted(FORMATS)}, and a policy at most")
                out[key[len(prefix) + 1 :]] = parts[0]
        return out

    def format(self) -> str | None:
        """The format of the output suffix, or else of the input suffix."""
        suffix = self.string("output-suffix") or self.string("suffix") or ""
        return self.formats().get(suffix.removeprefix("."))

    @property
    def datasets(self) -> list[str]:
        return list(dict.fromkeys(self.strings("input-datasets")))

    @property
    def base_dir(self) -> str:
        return self.string("base-dir", required=True)
