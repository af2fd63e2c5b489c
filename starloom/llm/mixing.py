"""Op 7. Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a keyed hash into blocks; the order of that hash is
the source's permutation. A source's target in words becomes a quota of blocks: whole
passes over all its blocks, then the first blocks of one more pass, the last of them only
as far as the target reaches (and the last document of that block by its first words). The
quotas of all sources are split among the output shards by a binary tree: every node draws
from the multivariate hypergeometric distribution how many blocks of each source go left.
A leaf owns a range of each source's draws, disjoint from all others, and its rows are
shuffled within the shard. A draw that no leaf owns is not taken, in taken() as in mixed().

What the driver holds: one row for each source (more than MAX_SOURCES raise an error) and
at most BLOCKS + one for each source block totals; both are checked bounds, whatever the
input's size. Of the block that a target ends in, sizes are added up in the permutation's
order (rows alike in id and size as one); the rest of the work is row by row.

Defined results: a null text has no words; a null source is a source of its own, last in
order; a source without words has target 0; repeated rows count each (those at a target's
end share what is left of it evenly, a remainder is not taken); an empty table gives an
empty result. Reruns agree: draws depend on doc_id and the seed alone. Columns of the input
may have any names; the mix's own are named so that they clash with none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import store, textops

WEIGHTS, TOTAL, CAP = (3, 1, 2), 1.5, 2.0
BLOCKS, MAX_SOURCES = 1 << 16, 10_000
SHARD_WORDS, MIN_SHARDS, MAX_SHARDS = 16_000_000, 8, 1024


def counts(col: pa.Array) -> np.ndarray:
    """Words of each text: runs of bytes other than ASCII white space."""
    buf, offsets = textops.as_bytes(col)
    starts, _, _ = textops.runs(buf, offsets, textops.SOLID)
    return np.diff(np.searchsorted(starts, offsets))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            sizes = [counts(texts[a:b]) for a, b in textops.slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], names=["doc_id", "source", "size"])

    return store.mapped(docs.select("doc_id", "source", "text"), run, "doc_id long, source string, size long")


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Each source's target: its share by weight, at most CAP times its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), TOTAL * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in order if s in free and weight[s] * unit > CAP * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in full:
            out[s] = CAP * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Offsets, sources x (shards + 1): where each shard's range of each source's draws begins."""
    out = np.zeros((len(quotas), shards), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[:, a] = q
            continue
        mid = (a + b) // 2
        take = int(q.sum()) * (mid - a) // (b - a)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if q.sum() else q
        todo += [(mid, b, q - left), (a, mid, left)]
    return np.concatenate([np.zeros((len(quotas), 1), np.int64), np.cumsum(out, axis=1)], axis=1)


class Plan(NamedTuple):
    """By source, nulls last: size, target, blocks, passes, edge block; where the last pass ends; the leaves' ranges of draws."""

    order: list[str | None]
    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    passes: np.ndarray
    edge: np.ndarray
    ends: list[tuple[float, int, int] | None]  # u, doc_id and size of the document that the target cuts
    part: np.ndarray  # its words
    offsets: np.ndarray
    shards: int


class Draws(NamedTuple):
    """Row, number of the copy, words taken and shard of each draw."""

    row: np.ndarray
    copy: np.ndarray
    words: np.ndarray
    shard: np.ndarray


_NO_ID = np.iinfo(np.int64).min


def _place(seed: int) -> Column:
    """A row's place in its source's permutation, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))


def plan(sizes: DataFrame, seed: int = 11, shards: int | None = None) -> Plan:
    """What each source gives: from the sizes of all documents (doc_id, source, size)."""
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {r["source"]: r["size"] for r in found}
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    whole, target = sum(size.values()), targets(size)
    rows = {r["source"]: r["n"] for r in found}
    blocks = [max(1, min(rows[s], BLOCKS * size[s] // max(1, whole))) for s in order]
    split = spark.createDataFrame(list(zip(order, range(len(order)), blocks)), "p_source string, p_index int, p_blocks long")
    placed = sizes.join(F.broadcast(split), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("p_u", _place(seed))
    placed = placed.withColumn("p_block", F.floor(F.col("p_u") * F.col("p_blocks")))
    held = [np.zeros(n, np.int64) for n in blocks]
    for r in placed.groupBy("p_index", "p_block").agg(F.sum("size").alias("words")).toLocalIterator():
        held[r["p_index"]][r["p_block"]] = r["words"]
    passes, edge, left = (np.zeros(len(order), np.int64) for _ in range(3))
    for i, s in enumerate(order):
        passes[i], rest = divmod(int(round(target[s])), size[s]) if size[s] else (0, 0)
        ends = np.cumsum(held[i])
        edge[i] = np.searchsorted(ends, rest) if rest else 0
        left[i] = rest - (ends[edge[i] - 1] if edge[i] else 0)
    cuts: list[tuple[float, int, int] | None] = [None] * len(order)
    part = np.zeros(len(order), np.int64)
    for i, u, doc, n, words in _cut_rows(placed, edge, left):
        cuts[i], part[i] = (u, doc, n), words
    quotas = passes * blocks + edge + (left > 0)
    shards = shards or min(MAX_SHARDS, max(MIN_SHARDS, int(TOTAL * whole) // SHARD_WORDS))
    return Plan(order, np.array([size[s] for s in order], np.int64), np.array([target[s] for s in order]), np.array(blocks, np.int64), passes, edge, cuts, part, split_quotas(quotas, shards, seed), shards)


def _cut_rows(placed: DataFrame, edge: np.ndarray, left: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """For each source with a partial pass: index, u, doc_id and size of the document its target cuts, and the words left for it."""
    ends = [(int(i), int(edge[i]), int(left[i])) for i in np.flatnonzero(left)]
    if not ends:
        return []
    last = placed.sparkSession.createDataFrame(ends, "e_index int, e_block long, e_left long")
    rows = placed.join(F.broadcast(last), (F.col("p_index") == F.col("e_index")) & (F.col("p_block") == F.col("e_block")))
    rows = rows.groupBy("e_index", "e_left", "p_u", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "size").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("size") * F.col("n")).over(W.Window.partitionBy("e_index").orderBy("p_u", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, 0))
    rows = rows.withColumn("before", upto - F.col("size") * F.col("n")).filter((F.col("before") < F.col("e_left")) & (F.col("before") + F.col("size") * F.col("n") >= F.col("e_left")))
    return [(r["e_index"], r["p_u"], r["doc_id"], r["size"], (r["e_left"] - r["before"]) // r["n"]) for r in rows.collect()]  # one a source


def draws(made: Plan, source: np.ndarray, u: np.ndarray, doc_id: np.ndarray, size: np.ndarray) -> Draws:
    """What the shards draw of some rows; source: index in the plan, doc_id: _NO_ID where null."""
    block = (u * made.blocks[source]).astype(np.int64)
    passes, edge = made.passes[source], made.edge[source]
    part = np.where(block < edge, size, 0)
    for i in np.flatnonzero(block == edge).tolist():
        end, mine = made.ends[source[i]], (u[i], doc_id[i], size[i])
        if end is not None and mine <= end:
            part[i] = made.part[source[i]] if mine == end else size[i]
    times = passes + 1
    row = np.repeat(np.arange(len(size)), times)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    words = np.where(copy < passes[row], size[row], part[row])
    draw = copy * made.blocks[source[row]] + block[row]
    shard = np.full(len(row), -1, np.int64)
    for s in np.unique(source).tolist():
        mine = source[row] == s
        shard[mine] = np.searchsorted(made.offsets[s], draw[mine], side="right") - 1
    keep = (shard >= 0) & (shard < made.shards) & ((words > 0) | ((size[row] == 0) & (copy < passes[row])))
    return Draws(row[keep], copy[keep], words[keep], shard[keep])


def _indexes(made: Plan, col: pa.Array) -> np.ndarray:
    at = {s: i for i, s in enumerate(made.order)}
    return np.array([at[s] for s in col.to_pylist()], np.int64)


def _ids(col: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(col, _NO_ID), np.int64)


def taken(docs: DataFrame, seed: int = 11) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix's shards draw of it."""
    sizes = store.written(sized(docs), "mix-sizes")
    sent = docs.sparkSession.sparkContext.broadcast(plan(sizes, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            source, size = _indexes(made, batch.column(1)), np.asarray(batch.column(2))
            got = draws(made, source, np.asarray(batch.column(3)), _ids(batch.column(0)), size)
            words = np.bincount(got.row, weights=got.words, minlength=len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made.size[source]), pa.array(made.target[source]), pa.array(words), batch.column(1)], names=["doc_id", "size", "source_size", "target", "taken", "source"])

    return store.mapped(sizes.select("doc_id", "source", "size", _place(seed).alias("u")), run, "doc_id long, size long, source_size long, target double, taken long, source string")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    raw = text.encode()
    _, ends, _ = textops.runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), textops.SOLID)
    return text if n >= len(ends) else raw[: ends[n - 1]].decode() if n > 0 else ""


def mix_columns(names: list[str]) -> list[str]:
    """Names for copy, words, shard and position that clash with none of the given ones."""
    given, mark = {c.lower() for c in names}, "mix"
    while any(f"{mark}_{c}" in given for c in ("copy", "words", "shard", "position")):
        mark = "_" + mark
    return [f"{mark}_{c}" for c in ("copy", "words", "shard", "position")]


def mixed(docs: DataFrame, seed: int = 11, shards: int | None = None) -> DataFrame:
    """The mix itself: the columns of docs for each copy taken, with mix_columns().

    A document that the target cuts is cut in its text (and n_chars follows, if there). Rows
    are dealt by shard and by position within it, and sorted so in each partition.
    """
    names = docs.columns
    kinds = [f.dataType.simpleString() for f in docs.schema]
    own = mix_columns(names)
    sizes = store.written(sized(docs), "mix-sizes")
    made = plan(sizes, seed, shards)
    sent = docs.sparkSession.sparkContext.broadcast(made)
    text, source, doc, chars = (names.index(c) if c in names else None for c in ("text", "source", "doc_id", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            for a, b in textops.slices(texts):
                part, size = batch.slice(a, b - a), counts(texts[a:b])
                got = draws(sent.value, _indexes(sent.value, part.column(source)), np.asarray(part.column(len(names))), _ids(part.column(doc)), size)
                columns = part.take(pa.array(got.row)).columns[: len(names)]
                cut = np.flatnonzero(got.words < size[got.row]).tolist()
                if cut:
                    clean = columns[text].to_pylist()
                    for i in cut:
                        clean[i] = first_words(clean[i], int(got.words[i]))
                    columns[text] = pa.array(clean, columns[text].type)
                    if chars is not None:
                        n_chars = columns[chars].to_pylist()
                        for i in cut:
                            n_chars[i] = len(clean[i])
                        columns[chars] = pa.array(n_chars, columns[chars].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got.copy), pa.array(got.words), pa.array(got.shard)], names=[f"c{i}" for i in range(len(names))] + ["k", "w", "s"])

    fields = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "k long, w long, s long"])
    placed = docs.select(*(F.col(f"`{c}`") for c in names), _place(seed)).toDF(*(f"c{i}" for i in range(len(names))), "u")
    rows = store.mapped(placed, run, fields)
    rows = rows.withColumn("p", F.xxhash64(f"c{doc}", f"c{text}", "k", F.lit(seed + 1))).toDF(*names, *own)
    parts = max(made.shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, own[2], F.pmod(own[3], F.lit(max(4, parts // made.shards)))).sortWithinPartitions(own[2], own[3])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
