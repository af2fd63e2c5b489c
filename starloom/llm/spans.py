"""Op 4. Substring deduplication by sliding spans of sentences.

A sentence ends at . ! ? ; or a line's end; one of over LONG words is cut further, after
each word whose hash is the least of some CUT words in a row within it (the last of equal
ones), so that text without punctuation resynchronises too and no piece has over CUT words.
From every sentence a span runs on to the first sentence that gives it at least RUN
sentences and WORDS words. What stands around a passage moves cuts in its first and last
CUT - 1 words only, or leaves up to LONG words of a sentence at its edge uncut; so a common
passage of 51 words, wherever it begins and ends, holds a whole common span: one begins in
its first 16 words, and ends within LONG + WORDS words. Spans are compared by two hashes of
their words, of 64 and 32 bits (ASCII case and all punctuation aside), over the whole corpus:
the first occurrence, by doc_id and then by position, stays; the sentences that any other
occurrence covers are removed.

The corpus is read twice: for the spans' hashes, and to cut the texts. Which of the longer
hashes occur more than once is a count combined before its shuffle; only spans with such
hashes go on, and both hashes decide among them. Of the tables written on the way only the
list of spans to remove is left.

Defined results: a null text stays null and counts as empty; a text without a whole span
loses nothing; a null doc_id comes last; rows equal in doc_id and text are one document
(both keep what is first in either); an empty table gives an empty result. Columns of the
input other than doc_id and text pass through removed(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textops

RUN, WORDS = 2, 20
LONG, CUT = 12, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[*b".!?;\n\r"]] = True
_MULTIPLIER, _OTHER = 0xBEA225F9EB34556D, 0xD6E8FEB86659FD93


class Sentences(NamedTuple):
    """Of some rows' texts: first and last byte, first word, and row of each sentence; hashes of all words."""

    begin: np.ndarray
    end: np.ndarray
    word: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray


def _least(h: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places among at whose hash is the least, and the last of equal ones, of some CUT words of their sentence (first to end)."""
    span, a, b, own = np.ones(len(at), np.int64), first[at], end[at], h[at]
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, CUT):
        left &= (at - k >= a) & (h[np.maximum(at - k, 0)] >= own)
        right &= (at + k < b) & (h[np.minimum(at + k, len(h) - 1)] > own)
        span += left
        span += right
    return at[span >= CUT]


def sentences(col: pa.Array) -> Sentences:
    buf, offsets = textops.as_bytes(col)
    starts, ends, row = textops.runs(buf, offsets, textops.WORD)
    h = textops.hashes(_LOWER[buf], starts, ends)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, h, buf, offsets)
    stops = np.flatnonzero(_STOP[buf])
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (np.searchsorted(stops, starts[1:]) > np.searchsorted(stops, ends[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    cut = np.zeros(n, bool)
    after = _least(h, np.repeat(first, size), np.repeat(first + size, size), np.flatnonzero(np.repeat(size > LONG, size))) + 1
    cut[after[after < n]] = True
    word = np.flatnonzero(new | cut)
    begin = starts[word]
    end = np.append(begin[1:], len(buf))
    own = row[word]
    last = np.append(own[1:] != own[:-1], True)
    end[last] = offsets[own[last] + 1]
    return Sentences(begin, end, word, own, h, buf, offsets)


def spans(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, first and last sentence (as places in s) of each span."""
    n = len(s.word)
    bounds = np.append(s.word, len(s.hashes))
    at = np.arange(n)
    last = np.maximum(at + RUN - 1, np.searchsorted(bounds, s.word + WORDS) - 1)
    fits = last < n
    at, last = at[fits], last[fits]
    same = s.row[at] == s.row[last]
    at, last = at[same], last[same]
    a, b = s.word[at], bounds[last + 1]
    size = (b - a).astype(np.uint64)
    one, other = (textops.splitmix(textops.range_hashes(s.hashes, m, a, b) + size) for m in (_MULTIPLIER, _OTHER))
    return one, (other >> np.uint64(32)).astype(np.uint32), at, last


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def span_rows(docs: DataFrame) -> DataFrame:
    """h and g (its hashes), doc_id, t (a hash of the text), s and e (first and last sentence) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                s = sentences(texts[a:b])
                h, g, at, last = spans(s)
                row = s.row[at]
                base = np.searchsorted(s.row, row)
                of = pa.array(row)
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h.view(np.int64)),
                    "g": pa.array(g.view(np.int32)),
                    "doc_id": batch.column(0)[a:b].take(of),
                    "t": batch.column(1)[a:b].take(of),
                    "s": pa.array((at - base).astype(np.int32)),
                    "e": pa.array((last - base).astype(np.int32)),
                })

    return store.mapped(docs.select("doc_id", _text_key().alias("t"), "text"), run, "h long, g int, doc_id long, t long, s int, e int")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, t and the (s, e) of the spans to remove, for each document that has any."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "s")
    with store.scratch():
        every = store.written(span_rows(docs), "spans")
        often = store.written(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
        found = store.written(every.join(often, "h"), "found")
        first = store.written(found.groupBy("h", "g").agg(F.min(place).alias("f")), "first")
        later = found.join(first, ["h", "g"]).filter(~place.eqNullSafe(F.col("f")))
        # at most a document's sentences in a row
        cuts = later.groupBy("doc_id", "t").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
        return store.written(cuts, "cuts", keep=True)


def cut(s: Sentences, i: int, drop: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """Row i's bytes without the sentences marked in drop, and the removed stretches in code points."""
    a, b = s.offsets[i], s.offsets[i + 1]
    lo, hi = np.searchsorted(s.row, i), np.searchsorted(s.row, i, side="right")
    points = np.concatenate([[0], np.cumsum((s.buf[a:b] & 0xC0) != 0x80)])
    kept, gone, at = [], [], a
    edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
    for x, y in edges.reshape(-1, 2):
        start, end = s.begin[lo + x], s.end[lo + y - 1]
        kept.append(s.buf[at:start].tobytes())
        gone.append((int(points[start - a]), int(points[end - a])))
        at = end
    assert len(drop) == hi - lo
    return b"".join([*kept, s.buf[at:b].tobytes()]), gone


def removed(docs: DataFrame, report: bool = False) -> DataFrame:
    """The documents with repeated spans cut from their texts; n_chars, if there, follows.

    report: instead doc_id, n_sentences, n_removed, removed (start:end in code points) and text.
    """
    other = repeated(docs).select(F.col("doc_id").alias("c_id"), F.col("t").alias("c_t"), F.expr("transform(cuts, c -> c.s)").alias("__s"), F.expr("transform(cuts, c -> c.e)").alias("__e"))
    names = ["doc_id", "text"] if report else docs.columns
    rows = docs.select(names).withColumn("__t", _text_key()).join(other, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("__t") == F.col("c_t")), "left").select(*names, "__s", "__e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                part = batch.slice(a, b - a)
                s = sentences(texts[a:b])
                counts = np.bincount(s.row, minlength=b - a)
                first, last = (part.column(part.schema.get_field_index(c)) for c in ("__s", "__e"))
                clean, n_gone, gone = part.column(at).to_pylist(), [0] * (b - a), [""] * (b - a)
                for i in np.flatnonzero(np.asarray(first.is_valid())).tolist():
                    mark = np.zeros(counts[i] + 1, np.int32)
                    np.add.at(mark, np.asarray(first[i].values), 1)
                    np.add.at(mark, np.asarray(last[i].values) + 1, -1)
                    drop = np.cumsum(mark[:-1]) > 0
                    raw, ranges = cut(s, i, drop)
                    clean[i], n_gone[i], gone[i] = raw.decode(), int(drop.sum()), ",".join(f"{x}:{y}" for x, y in ranges)
                if report:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(gone, pa.string()), pa.array(clean, pa.string())], names=["doc_id", "n_sentences", "n_removed", "removed", "text"])
                else:
                    yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type)).select(names)

    if report:
        return store.mapped(rows, run, "doc_id long, n_sentences long, n_removed long, removed string, text string")
    out = store.mapped(rows, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), report=True)
