"""Op 3. Exact top-k inner products by no-random-access aggregation of sorted lists.

Vectors stay where they are; each task takes its own in blocks. In a block every dimension
has a list of its vectors by component. A query reads all lists in step, from the end that
its own component favours, and knows for every vector an upper bound (what has been read of
it, and the place it reads at for the rest) and a lower bound (what has been read, and the
list's far end for the rest). A vector is out once its upper bound is below the k-th best
lower bound of the block, or the k-th best score of the blocks before. A query stops reading
when no more than RESOLVE x k vectors are left; their scores are then resolved. Queries whose
depth is the same read together: their bounds are products of matrices, of the vectors as
far as they have been met.

The queries are a stated set against all rows. They go to the tasks in broadcasts of at most
QUERY_BYTES, one pass over the vectors for each. A task returns k rows a query, and these
are merged by a ranking that keeps k rows before it shuffles.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part; a product of two lengths is that over the shorter, as in ORACLE (the shorter ones
are filled up with zeros to the longest of the table); a null id takes no part; equal scores
rank by smaller id; repeated rows of an id count once each as candidates, but never for the
query of their own id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import store

SCALE, EVERY, K = 256, 50, 5
#: Vectors of the first block of a task (which has no scores to beat yet) and of the others; queries that read together.
FIRST, BLOCK, TOGETHER = 1 << 8, 1 << 11, 1 << 8
#: Steps in which a list is read, and how many times k vectors are left to resolve.
STEPS, RESOLVE = 8, 16
QUERY_BYTES = 1 << 24
#: Vectors a task should have where there are few: smaller tables are dealt over all cores.
FEW = 1 << 14


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and integer components of the vectors that take part."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
    rows = rows.filter(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("id", F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


class Lists:
    """The sorted lists of one block of vectors: by dimension, read from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.values, self.ordered = ids, vectors, np.sort(vectors, axis=0)

    def bounds(self, depth: int, queries: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Upper and, if asked for, lower bounds (queries x vectors at) with `depth` entries of each list read."""
        n, met = len(self.ids), self.values[at]
        top, low = self.ordered[n - depth], self.ordered[depth - 1]
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        # an entry that has not been read is no better than the place that is read, and no worse than the list's end
        upper = plus @ np.maximum(met, top).T + minus @ np.minimum(met, low).T
        if not lower:
            return upper, None
        return upper, plus @ np.where(met >= top, met, self.ordered[0]).T + minus @ np.where(met <= low, met, self.ordered[-1]).T

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, slack: float = 0.0) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the vectors that are left when it stops reading, and the depth at which it does.

        least: the score that the k-th best of other blocks has, -inf if there are fewer.
        """
        n = len(self.ids)
        left: list[np.ndarray] = [np.flatnonzero(self.ids != i) for i in own]
        stop, reading, bar = np.zeros(len(queries), np.int64), np.ones(len(queries), bool), least.astype(np.float64).copy()
        for step in range(1, STEPS + 1):
            for i in np.flatnonzero(reading).tolist():
                reading[i] = len(left[i]) > RESOLVE * k
            open_ = np.flatnonzero(reading)
            if not len(open_):
                break
            depth = max(1, n * step // STEPS)
            stop[open_] = depth
            some = np.zeros(n, bool)
            for i in open_:
                some[left[i]] = True
            at = np.flatnonzero(some)
            first = bool((least[open_] == -np.inf).any())
            upper, lower = self.bounds(depth, queries[open_], at, first)
            for j, i in enumerate(open_.tolist()):
                mine = np.searchsorted(at, left[i])
                if first and len(mine) >= k:
                    bar[i] = max(bar[i], np.partition(lower[j, mine], len(mine) - k)[len(mine) - k])
                left[i] = left[i][upper[j, mine] >= bar[i] - slack]
        return left, stop


class Best:
    """The k best vectors that a task has found for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = ids, vectors, k
        self.ids = [np.zeros(0, np.int64) for _ in ids]
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.read, self.held = np.zeros(len(ids), np.int64), 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Searches a block of integer vectors."""
        self.held += len(ids)
        most = float(vectors.shape[1]) * float(np.abs(self.queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
        # sums of integers below 2**24 are exact in 32 bits, and below 2**53 in 64
        kind = np.float32 if most < 1 << 24 else np.float64
        lists, queries = Lists(ids, vectors.astype(kind)), self.queries.astype(kind)
        for a in range(0, len(queries), TOGETHER):
            z = a + TOGETHER
            left, stop = lists.search(queries[a:z], self.query_ids[a:z], self.k, self.least[a:z], 0.0 if most < 1 << 53 else most * 2.0**-48)
            self.read[a:z] += stop
            for i, at in enumerate(left, a):
                self._keep(i, ids[at], vectors[at] @ self.queries[i])

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[i] = scores[order[-1]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def topk(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for each row where is_query (a Column of id_col) holds.

    report: instead query_id, how many list entries it has read, and how many there are, over all dimensions.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = scaled(vectors, id_col, vector_col)
    if vectors.count() < cores * FEW:
        rows = rows.repartition(cores)
    rows = store.written(rows, "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    asked = rows.filter(is_query(F.col("id")))
    passes = max(1, -(-asked.count() * width * 8 // QUERY_BYTES))
    asked = store.written(asked.withColumn("pass", F.pmod(F.monotonically_increasing_id(), F.lit(passes))), "queries")
    found = reduce(DataFrame.unionByName, (_one_pass(rows, asked.filter(F.col("pass") == p), width, k) for p in range(passes)))
    if report:
        return found.groupBy("query_id").agg((F.sum("read") * width).alias("read"), (F.sum("held") * width).alias("held"))
    rank = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.filter("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(rows: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """Each task's best for the queries asked (QUERY_BYTES at most); a first row for each query holds what it has read."""
    given = asked.select("id", "v").orderBy("id").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((np.asarray(given.column("id").combine_chunks(), np.int64), _matrix(given.column("v").combine_chunks(), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(*sent.value, k), [], FIRST
        if not len(best.query_ids):
            return
        for batch in batches:
            for a in range(0, len(batch), FIRST):
                held.append(batch.slice(a, FIRST))
                if sum(map(len, held)) >= size:
                    _add(best, held, width)
                    held, size = [], BLOCK
        if held:
            _add(best, held, width)
        n = len(best.query_ids)
        sizes = [len(x) for x in best.ids]
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(best.query_ids), none, none, pa.array(best.read), pa.array(np.full(n, best.held))], names=["query_id", "vec_id", "score", "read", "held"])
        zero = pa.array(np.zeros(sum(sizes), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.query_ids, sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores)), zero, zero], names=["query_id", "vec_id", "score", "read", "held"])

    return store.mapped(rows, run, "query_id long, vec_id long, score long, read long, held long")


def _add(best: Best, held: list[pa.RecordBatch], width: int) -> None:
    block = pa.Table.from_batches(held).combine_chunks()
    if len(block):
        best.add(np.asarray(block.column("id").combine_chunks(), np.int64), _matrix(block.column("v").combine_chunks(), width))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % EVERY == 0)


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
