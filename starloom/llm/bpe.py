"""Op 5. Byte-level BPE by overlapping chunks.

A text is cut into chunks of CHUNK characters, each with an overlap into the next, and every
chunk is pre-tokenised by itself. A match of the pattern depends only on the text after its
start, so once two neighbouring chunks share a pre-token boundary their boundaries agree
from there on: boundaries are stitched there. The text is then cut at one stitched boundary
for each chunk, and the pieces are encoded one by one and concatenated. A chunk that never resynchronises within its overlap (a pre-token
longer than it) is read on from the last true boundary, so results are exact. A text's
chunks are dealt to tasks in parts of LONG characters, which overlap and are stitched alike;
a text of one part is one row. Decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty and has no ids; texts of any length are read
whole; repeated rows give repeated results; an empty table gives an empty result; further
columns do not take part, and give way where they have the name of a column of the result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textops

CHUNK, OVERLAP = 1 << 11, 1 << 7
LONG = 1 << 17


class Coder:
    """The encoder of a file of ranks, and the pattern that finds pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pre_tokens = regex.compile(public_tokenizers.PATTERN).findall


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def boundaries(text: str, start: int = 0) -> Iterator[int]:
    """Ends of the pre-tokens of text from a start that is a boundary."""
    return (m.end() for m in regex.compile(public_tokenizers.PATTERN).finditer(text, start))


def chunk_ends(own: Coder, part: str, final: bool) -> np.ndarray:
    """Boundaries inside a chunk. Without the text's end, the last two ends may depend on what follows."""
    found = own.pre_tokens(part)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    return ends if final else ends[ends < len(part)][:-1]


def stitch(text: str, chunk: int, ends: list[np.ndarray]) -> np.ndarray:
    """All pre-token ends of the text, from each chunk's own ends (relative to the chunk)."""
    true, at = [], 0
    for i, own in enumerate(ends):
        edge, ours = min((i + 1) * chunk, len(text)), own + i * chunk
        if at < edge and at != i * chunk and not _among(ours, at):
            for at in boundaries(text, at):
                true.append(np.array([at]))
                if at >= edge or _among(ours, at):
                    break
        if at < edge:
            later = ours[np.searchsorted(ours, at, side="right") :]
            later = later[: np.searchsorted(later, edge) + 1]
            true.append(later)
            at = int(later[-1]) if len(later) else at
        if at < edge:
            for at in boundaries(text, at):
                true.append(np.array([at]))
                if at >= edge:
                    break
    return np.concatenate(true)


def _among(ends: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(ends, at))
    return i < len(ends) and int(ends[i]) == at


def text_ends(own: Coder, text: str, chunk: int, overlap: int, final: bool = True) -> np.ndarray:
    """The boundaries of a text, or of a part that others follow, chunk by chunk."""
    if len(text) <= chunk:
        return chunk_ends(own, text, final)
    parts = [text[a : a + chunk + overlap] for a in range(0, len(text), chunk)]
    ends = [chunk_ends(own, x, (i + 1) * chunk + overlap >= len(text)) for i, x in enumerate(parts)]
    found = stitch(text, chunk, ends)
    return found if final else found[found < len(text)][:-1]


def cut(text: str, ends: np.ndarray, chunk: int) -> list[str]:
    """The text's pieces: cut at its first pre-token boundary after every chunk's end.

    A boundary after white space does not count: what the pattern makes of white space
    depends on what follows it, and a piece must give the same pre-tokens by itself.
    """
    cuts = [0]
    for edge in range(chunk, len(text), chunk):
        k = int(np.searchsorted(ends, max(edge, cuts[-1] + 1)))
        while k < len(ends) and text[ends[k] - 1].isspace():
            k += 1
        if k < len(ends):
            cuts.append(int(ends[k]))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if a < b]


def encode_pieces(own: Coder, text: str, ends: np.ndarray, chunk: int) -> np.ndarray:
    """Ids of the pieces one after another; a pre-token's ids do not depend on its neighbours."""
    return np.concatenate([np.array(own.encoding.encode_ordinary(x), np.uint32) for x in cut(text, ends, chunk)])


def encode(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of one text, chunk by chunk."""
    own = coder(path)
    if len(text) <= chunk:
        return np.array(own.encoding.encode_ordinary(text), np.uint32)
    return encode_pieces(own, text, text_ends(own, text, chunk, overlap), chunk)


def decode(path: str, ids: np.ndarray) -> bytes:
    return coder(path).encoding.decode_bytes(ids.tolist())


def _digest(path: str, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(path, ids)).hexdigest()


DIGEST = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encoded(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, long: int = LONG, digest: bool = False, keep: bool = False) -> DataFrame:
    """Per document doc_id and its ids (array of int), or with digest the ids' and decoded bytes' digests.

    keep: all columns of docs come along.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = DIGEST if digest else {"ids": "array<int>"}
    names = [c for c in docs.columns if (keep or c == "doc_id") and c.lower() not in made]
    rest = {f"p{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(names)}
    kinds = ", ".join(f"{c} {k}" for c, k in rest.items())
    fields = ", ".join(f"{c} {k}" for c, k in (rest | made).items())

    def result(ids: list[np.ndarray]) -> list[pa.Array]:
        if digest:
            rows = [_digest(path, x) for x in ids]
            return [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, (pa.int64(), pa.string(), pa.string()))]
        return [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                ids = [encode(path, x.as_py(), chunk, overlap) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(rest))), *result(ids)], names=[*rest, *made])

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, finals = batch.column(batch.schema.get_field_index("part")), batch.column(batch.schema.get_field_index("final"))
            for i in range(len(batch)):
                ends = text_ends(coder(path), parts[i].as_py(), chunk, overlap, finals[i].as_py())
                yield batch.slice(i, 1).append_column("ends", pa.array([ends], pa.list_(pa.int64())))

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        parts = table.column("part").to_pylist()
        text = "".join([x[:long] for x in parts[:-1]] + [parts[-1]])
        ends = [np.asarray(x, np.int64) for x in table.column("ends").to_pylist()]
        ids = encode_pieces(coder(path), text, stitch(text, long, ends), chunk)
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in rest), *result([ids])], names=[*rest, *made])

    rows = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(names, rest)), F.coalesce("text", F.lit("")).alias("text"))
    few = store.mapped(rows.filter(F.length("text") <= long), short, fields)
    large = rows.filter(F.length("text") > long).withColumn("row", F.monotonically_increasing_id())
    # the last part is never wholly inside its predecessor's overlap, so there is one for each start before the end
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / long).cast("int"))).alias("k"))
    large = large.select(*rest, "row", "k", F.expr(f"substring(text, k * {long} + 1, {long + overlap})").alias("part"), F.expr(f"(k + 1) * {long} + {overlap} >= length(text)").alias("final"))
    large = store.mapped(large, ends_of, f"{kinds}, row long, k int, part string, final boolean, ends array<long>")
    return few.unionByName(large.groupBy("row").applyInArrow(whole, fields)).toDF(*names, *made)


def decoded(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """The inverse: doc_id and the raw bytes that its ids stand for."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None else decode(path, np.asarray(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return store.mapped(encoded_docs.select("doc_id", "ids"), run, f"doc_id {encoded_docs.schema['doc_id'].dataType.simpleString()}, bytes binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
