"""Search over documents: conditions, BM25 scores, and tagging of texts by a dictionary."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.shared import materialised

from .sorts import first_rows

K1, B = 1.2, 0.75
MOST_RESULTS, MOST_TAGS, MOST_WORDS = 10_000, 5_000, 8
OVERLAPS = ("ALL", "NO_SUB", "LONGEST_DOMINANT_RIGHT")
_WORD = re.compile(r"[A-Za-z0-9_]+")
#: A dictionary of up to so many bytes goes to the tasks.
SENT_BYTES = 32 << 20


def tokens(x: Column | str) -> Column:
    """Lower-case runs of word characters."""
    x = F.col(x) if isinstance(x, str) else x
    return F.filter(F.split(F.lower(x), r"\W+"), lambda t: t != "")


def _times(low: Column, term: str) -> Column:
    return F.regexp_count(low, F.lit(rf"(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])"))


def bm25(docs: DataFrame, query: Iterable[str], id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B, length_norm: bool = True, payload_col: str | None = None) -> DataFrame:
    """id and score of every document that has a query term.

    score = Σ idf · tf (k1 + 1) / (tf + k1 (1 - b + b · length / mean length)), with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); without length_norm the length counts as the
    mean. A payload divides a document's score by its root. Terms are counted within each
    row and the counts written, so texts are read once and no token is shuffled; N, mean
    length and df are one aggregate over the counts. What is no word never occurs.
    """
    terms = sorted({t.lower() for t in query if re.fullmatch(r"[A-Za-z0-9_]+", t)})
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"), *([F.col(payload_col).alias("__payload")] if payload_col else []))
    names = [f"__tf{i}" for i in range(len(terms))]
    counted = low.select("id", F.regexp_count("__low", F.lit("[A-Za-z0-9_]++")).alias("__length"), *(_times(F.col("__low"), t).alias(n) for n, t in zip(names, terms)), *(["__payload"] if payload_col else []))
    counted = materialised(counted, "term-counts")
    total = counted.agg(F.count("*").alias("n"), F.avg("__length").alias("mean"), *(F.count_if(F.col(n) > 0).alias(n) for n in names)).first()  # one row
    ratio = F.col("__length") / F.lit(total["mean"] or 1.0) if length_norm else F.lit(1.0)
    score, some = F.lit(0.0), F.lit(False)
    for name in names:
        n, df = F.col(name), total[name]
        idf = math.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
        score = score + F.when(n > 0, F.lit(idf) * n * (k1 + 1) / (n + k1 * (1 - b + b * ratio))).otherwise(0.0)
        some = some | (n > 0)
    if payload_col:
        score = score * F.coalesce(F.lit(1.0) / F.sqrt(F.when(F.col("__payload") > 0, F.col("__payload"))), F.lit(1.0))
    return counted.filter(some).select("id", score.alias("score"))


def find(docs: DataFrame, condition: Column, filters: Iterable[Column] = (), order: Iterable[str] = ("id",), rows: int = MOST_RESULTS) -> DataFrame:
    """The first documents, by the given order, that meet a condition and all filters."""
    for c in filters:
        condition = condition & c
    return first_rows(docs.filter(condition), list(order), rows)


def contains_words(text_col: str, words: str) -> Column:
    """True where all words occur."""
    own = tokens(text_col)
    out = F.lit(True)
    for w in sorted({w.lower() for w in _WORD.findall(words)}):
        out = out & F.array_contains(own, w)
    return out


def phrase(x: Column | str) -> Column:
    """A label as its words, single-spaced."""
    return F.array_join(tokens(x), " ")


def _text_phrases(lengths: list[int], known: dict[str, list[str]] | None, overlap: str, most: int):
    """Every run of the given numbers of words of each text: row, id, start, end (code points), match_text, phrase, ids.

    With a dictionary (phrase to ids) only its phrases, with their ids, and of these the
    tags that the text keeps; without one ids are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, out = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
                hits = []
                for n in lengths:
                    for k in range(len(words) - n + 1):
                        p = words[k][2] if n == 1 else " ".join([w for _, _, w in words[k : k + n]])
                        if known is None or p in known:
                            hits.append((words[k][0], words[k + n - 1][1], p))
                if known is not None and hits:
                    good = set(resolved([(a, b) for a, b, _ in hits], overlap)[:most])
                    hits = [h for h in hits if h[:2] in good]
                out += [(first + i, i, a, b, text[a:b], p, known and known[p]) for a, b, p in hits]
                if len(out) >= 50_000:
                    yield _hits(batch.column(0), out)
                    out = []
            if out:
                yield _hits(batch.column(0), out)
                out = []
            first += len(batch)

    return run


def _hits(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    row, i, a, b, m, p, found = (list(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), ids.take(pa.array(i)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(m), pa.array(p), pa.array(found, pa.list_(pa.string()))], names=["row", "id", "start", "end", "match_text", "phrase", "ids"])


def resolved(spans: list[tuple[int, int]], overlap: str) -> list[tuple[int, int]]:
    """The spans that an overlap rule keeps, ascending.

    ALL: every one. NO_SUB: none that lies wholly within another. LONGEST_DOMINANT_RIGHT:
    again and again the longest of those left (the right-most on ties), without those that
    overlap it.
    """
    every = sorted(set(spans))
    if overlap == "ALL":
        return every
    if overlap == "NO_SUB":
        out, far = [], -1
        for a, b in sorted(every, key=lambda s: (s[0], -s[1])):
            if b > far:
                out.append((a, b))
                far = b
        return sorted(out)
    kept: list[tuple[int, int]] = []
    for a, b in sorted(every, key=lambda s: (s[0] - s[1], -s[0])):
        if all(b <= x or y <= a for x, y in _near(kept, a, b)):
            insort(kept, (a, b))
    return kept


def _near(kept: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    i = bisect_left(kept, (a, a))
    return kept[max(0, i - 1) : i + 1]


def tag(texts: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text", overlap: str = "ALL", most: int = MOST_TAGS) -> DataFrame:
    """Occurrences of dictionary labels (id, label) in texts: id, start_offset, end_offset, match_text, ids.

    Labels of up to MOST_WORDS words match word by word, whatever their case. A dictionary of
    up to SENT_BYTES goes to the tasks, and a text's tags are found, resolved and cut out
    where the text is read. Beyond that texts give their phrases of the lengths that labels
    have, which meet the labels in an equality join, and each text's overlaps are resolved
    from its matches alone. At most `most` tags a text, the first ones. Texts of one id are
    texts of their own.
    """
    if overlap not in OVERLAPS:
        raise ValueError(f"overlap must be one of {OVERLAPS}")
    entries = dictionary.select(F.col("id").cast("string").alias("entry"), phrase("label").alias("phrase"))
    entries = entries.filter((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) <= MOST_WORDS))
    entries = entries.groupBy("phrase").agg(F.sort_array(F.collect_set("entry")).alias("ids"))
    entries = materialised(entries, "phrases")
    size = F.length("phrase") + F.aggregate("ids", F.lit(64), lambda n, x: n + F.length(x) + 64)
    sized = entries.groupBy(F.size(F.split("phrase", " ")).alias("n")).agg(F.sum(size).alias("bytes")).collect()  # MOST_WORDS rows at most
    known = None
    if sum(r["bytes"] for r in sized) <= SENT_BYTES:
        known = {r["phrase"]: r["ids"] for r in entries.collect()}
    kind = texts.schema[id_col].dataType.simpleString()
    named = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = _text_phrases(sorted(r["n"] for r in sized), known, overlap, most)
    found = named.mapInArrow(run, f"row long, id {kind}, start int, end int, match_text string, phrase string, ids array<string>")
    if known is None:
        hits = found.drop("ids").join(entries, "phrase").select("row", "id", "start", "end", "match_text", "ids")

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            spans = list(zip(frame["start"].tolist(), frame["end"].tolist()))
            good = set(resolved(spans, overlap)[:most])
            return frame[[s in good for s in spans]]

        found = hits.groupBy("row").applyInPandas(choose, hits.schema)
    return found.select("id", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "match_text", "ids")
