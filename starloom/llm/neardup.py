"""Op 2. Near-duplicates by ProbMinHash, banding and verification.

A text's shingles are runs of five lower-cased words (all words of a shorter text), each
weighted by how often it occurs. A Poisson process of the shingle's weight gives it arrival
times at random registers; a register keeps its earliest arrival, and a shingle stops once
its next arrival is later than every register's. Two texts agree in a register with their
probability Jaccard similarity (for texts without repeated shingles: the Jaccard one).

Equal texts are one node from the start. Nodes meet in buckets of BANDS x ROWS registers.
A bucket of up to SMALL nodes gives all its pairs; in a larger one, every node meets the
bucket's most central nodes (those that share most buckets with others, one from each of
HUBS classes of nodes). Pairs whose signatures agree well enough are verified on their
whole shingle sets, and the connected components of verified links are the classes. Where
the members of a larger bucket are then not all in one component, every member outside the
bucket's largest one meets all members of other components, block against block, so that
the classes are those of all pairs of all buckets. A bucket that mixes many classes takes
signature comparisons up to the square of its size; only the pairs that agree are rows.

Hot groups: bucket sizes and hubs are aggregates combined before their shuffle; joins by
bucket, hub or text are sort-merge joins of two exchanged sides, which Spark splits where
skewed; they are asked for by name, so that the plan is the same at every size. Nothing about single documents comes to the driver.

Defined results: a null text counts as empty; texts without words are alike only if equal;
a null doc_id is a row like others and never a class id unless its whole class has none;
repeated rows fall in one class; an empty table gives an empty result; further columns do
not take part. class_id is the least doc_id of the class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, store, textops

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
SMALL, HUBS = 16, 3
#: Members of a mixed bucket in one block.
BLOCK = 512
#: Estimates of pairs at LEAST fall below this once in about 30,000 pairs.
SURE_BELOW = LEAST - 4 * (LEAST * (1 - LEAST) / REGISTERS) ** 0.5


def shingles(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct shingle hashes, ascending, and their counts."""
    tokens, first = textops.words(col)
    grams, at = textops.ngrams(tokens, first, WORDS)
    return [np.unique(grams[a:b], return_counts=True) for a, b in zip(at, at[1:])]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The register winners, rows x REGISTERS; zeros for an empty set."""
    n = len(sets)
    h = np.concatenate([x for x, _ in sets] or [np.zeros(0, np.uint64)])
    w = np.concatenate([c for _, c in sets] or [np.zeros(0)]).astype(np.float64)
    row = np.repeat(np.arange(n), [len(x) for x, _ in sets])
    least, won = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    time, bound, j = np.zeros(len(h)), np.full(n, np.inf), 0
    while len(h):
        u = textops.splitmix(h + np.uint64((j * 0xD1342543DE82EF95) % (1 << 64)))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w
        on = time <= bound[row]
        h, w, row, time, u = h[on], w[on], row[on], time[on], u[on]
        at = row * REGISTERS + (((textops.splitmix(u) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, at, time)
        first = time == least[at]
        won[at[first]] = h[first]
        left = np.unique(row)
        bound[left] = least.reshape(n, -1)[left].max(axis=1)
        j += 1
    return won.reshape(n, REGISTERS)


def band_keys(won: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = won.reshape(len(won), BANDS, ROWS)
    out = np.zeros((len(won), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = textops.splitmix(out ^ parts[:, :, k])
    return out.view(np.int64)


def similarity(x: np.ndarray, cx: np.ndarray | None, y: np.ndarray, cy: np.ndarray | None) -> float:
    """Probability Jaccard similarity of two sets of ascending hashes with counts (None: all 1)."""
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if cx is None and cy is None:
        return len(i) / (len(x) + len(y) - len(i))
    cx = np.ones(len(x)) if cx is None else cx.astype(np.float64)
    cy = np.ones(len(y)) if cy is None else cy.astype(np.float64)
    one, other = np.delete(cx, i).sum(), np.delete(cy, j).sum()
    both, times = np.unique(np.stack([cx[i], cy[j]]), axis=1, return_counts=True)
    total = 0.0
    for (a, b), n in zip(both.T, times):
        # the shared part of the sum over all shingles, by distinct pair of counts
        shared = (np.maximum(both[0] / a, both[1] / b) * times).sum()
        total += n / (shared + one / a + other / b)
    return float(total)


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                part = texts[a:b]
                sets = shingles(part)
                won = signatures(sets)
                brief = (textops.splitmix(won.ravel()) >> np.uint64(48)).astype(np.uint16).reshape(won.shape)
                keys = band_keys(won)
                some = [len(x) > 0 for x, _ in sets]
                nodes = [hashlib.md5(x.as_buffer()).digest() for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(nodes, pa.binary()), pa.array([x.tobytes() for x in brief], pa.binary()), pa.array([k if s else [] for k, s in zip(keys, some)], pa.list_(pa.int64()))], names=["doc_id", "node", "sig", "bands"])

    return store.mapped(docs.select("doc_id", "text"), run, "doc_id long, node binary, sig binary, bands array<long>")


def _node() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _sets(docs: DataFrame) -> DataFrame:
    """node, and its shingles as 32-bit hashes with counts (empty where all are 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts):
                own, counts = [], []
                for x, c in shingles(texts[a:b]):
                    short, first = np.unique((x >> np.uint64(32)).astype(np.uint32), return_index=True)
                    own.append(short.tobytes())
                    counts.append(b"" if c.max(initial=1) == 1 else c[first].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(own, pa.binary()), pa.array(counts, pa.binary())], names=["node", "x", "c"])

    return store.mapped(docs.select("node", "text"), run, "node binary, x binary, c binary")


def _joined(pairs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Pairs with the values of both ends, as name_a and name_b."""
    for end in "ab":
        pairs = pairs.join(values.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in names)).hint("merge"), end)
    return pairs


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= SURE_BELOW))


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("x_a", "c_a", "x_b", "c_b")]
            good = []
            for row in zip(*cols):
                x, cx, y, cy = (np.frombuffer(v.as_buffer(), np.uint32) for v in row)
                good.append(similarity(x, cx if len(cx) else None, y, cy if len(cy) else None) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First pairs (a, b), a < b, of nodes (node, bands) that share a bucket, as the module describes; the members (key, node) of larger buckets."""
    in_bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = store.written(in_bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = store.written(in_bands.join(shared.hint("merge"), "key"), "members")
    few = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("v"))  # at most SMALL nodes
    few = few.select(F.explode(F.expr("flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> named_struct('a', x, 'b', y))))")).alias("p")).select("p.a", "p.b")
    central = store.written(members.groupBy("node").agg(F.sum("n").alias("reach"), F.max("n").alias("most")).filter(F.col("most") > SMALL).select("node", "reach"), "reach")
    large = store.written(members.filter(F.col("n") > SMALL).join(central.hint("merge"), "node").select("key", "node", "reach"), "large")
    kind = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(HUBS))
    hubs = store.written(large.groupBy("key").agg(*(F.max(F.when(kind == j, F.struct("reach", "node"))).alias(f"h{j}") for j in range(HUBS))), "hubs")
    met = large.join(hubs.hint("merge"), "key").select("node", F.explode(F.array(*(F.col(f"h{j}.node") for j in range(HUBS)))).alias("hub")).filter("hub IS NOT NULL AND hub <> node")
    pairs = few.unionByName(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
    return store.written(pairs.distinct(), "pairs"), large.select("key", "node")


def _across(least: float):
    """Links (a, b) between components of one bucket, one for each two that need it, of rows with left and rows without."""

    def run(key: tuple, members: pa.Table) -> pa.Table:
        left = np.asarray(members.column("left").to_numpy(zero_copy_only=False), bool)
        names, kind = np.unique(np.array([x.hex() for x in members.column("component").to_pylist()]), return_inverse=True)
        won = np.frombuffer(b"".join(members.column("sig").to_pylist()), np.uint16).reshape(len(left), -1)
        bands = members.column("bands").combine_chunks().flatten().to_numpy().reshape(len(left), -1)
        band = int(np.argmax(bands[0] == key[0].as_py()))
        sets = [tuple(np.frombuffer(v.as_buffer(), np.uint32) for v in row) for row in zip(members.column("x"), members.column("c"))]
        # what has been linked here counts as one
        root, others, links = np.arange(len(names)), np.flatnonzero(~left), []
        for i in np.flatnonzero(left).tolist():
            far = others[root[kind[others]] != root[kind[i]]]
            far = far[(won[far] == won[i]).mean(axis=1) >= SURE_BELOW]
            # nodes that share an earlier band meet there
            far = far[~(bands[far, :band] == bands[i, :band]).any(axis=1)]
            for j in far.tolist():
                one, other = root[kind[i]], root[kind[j]]
                (x, cx), (y, cy) = sets[i], sets[j]
                if one != other and similarity(x, cx if len(cx) else None, y, cy if len(cy) else None) >= least:
                    links.append((bytes.fromhex(names[kind[i]]), bytes.fromhex(names[kind[j]])))
                    root[root == other] = one
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


def _mixed(docs: DataFrame, large: DataFrame, nodes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """node, component for all nodes of larger buckets (key, node) whose components in found are linked across a bucket."""
    own = store.written(large.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "bucket-components")
    parts = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).filter("n > top.n")
    mixed = mixed.select(F.col("key").alias("m_key"), F.col("top.component").alias("top"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("rest"))
    members = store.written(own.join(mixed.hint("merge"), F.col("key") == F.col("m_key")).select("key", "node", "component", "top", "blocks", "rest"), "mixed")
    sets = _wanted_sets(docs, nodes, members.select("node").distinct())
    members = members.join(nodes.select("node", "sig", "bands").hint("merge"), "node").join(sets.hint("merge"), "node")
    place = lambda of: F.pmod(F.xxhash64("node", F.lit(9)), F.col(of)).cast("long")
    upto = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), (F.col(of) - 1).cast("long")))
    carried = ("key", "component", "sig", "bands", "x", "c")
    few = members.filter("component <> top").select(*carried, place("rest").alias("bx"), upto("blocks").alias("by"), F.lit(True).alias("left"))
    every = members.select(*carried, upto("rest").alias("bx"), place("blocks").alias("by"), F.lit(False).alias("left"))
    return few.unionByName(every).groupBy("key", "bx", "by").applyInArrow(_across(least), "a binary, b binary").distinct()


def _wanted_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, x, c: the shingle sets of the wanted nodes, each from one of the documents that have its text."""
    some = store.written(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted").select(F.col("node").alias("w_node"), F.col("doc_id").alias("w_id"))
    texts = docs.select("doc_id", "text").withColumn("node", _node()).join(some.hint("merge"), (F.col("node") == F.col("w_node")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    return store.written(_sets(texts).dropDuplicates(["node"]), "sets")


def _links(docs: DataFrame, nodes: DataFrame, close: DataFrame, least: float) -> DataFrame:
    """The pairs of close whose shingle sets are alike."""
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    sets = _wanted_sets(docs, nodes, ends)
    return store.written(store.mapped(_joined(close, sets, ["x", "c"]), _verified(least), "a binary, b binary"), "links")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Every row's doc_id, node (digest of its text), class_id, class_size and component (a node of its class)."""
    with store.scratch():
        rows = store.written(_features(docs), "features")
        nodes = store.written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "nodes")
        pairs, large = candidates(nodes)
        close = store.written(store.mapped(_joined(pairs, nodes, ["sig"]), _alike, "a binary, b binary"), "close")
        links = _links(docs, nodes, close, least)
        found = graph.components(links)
        own = rows.select("doc_id", "node").join(found.hint("merge"), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
        if not large.isEmpty():
            across = store.written(_mixed(docs, large, nodes, found, least), "across")
            if not across.isEmpty():
                joined = graph.components(across).select(F.col("node").alias("old"), F.col("component").alias("new"))
                own = own.join(joined.hint("merge"), F.col("component") == F.col("old"), "left").select("doc_id", "node", F.coalesce("new", "component").alias("component"))
        own = store.written(own, "own", keep=True)
        named = store.written(own.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes", keep=True)
    return own.join(named.hint("merge"), "component").select("doc_id", "node", "class_id", "class_size", "component")


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each class, with the columns of docs: the one with the least doc_id."""
    with store.scratch():
        kept = store.written(classes(docs, least).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))), "kept", keep=True)
    ids = kept.groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.first("class_id").alias("c"))
    repeated = ids.filter(F.col("n") > 1).limit(1).count() or kept.groupBy("component").count().filter("count > 1").limit(1).count()
    out = docs.withColumn("__node", _node()).join(kept.select(F.col("doc_id").alias("k_id"), F.col("node").alias("k_node")).distinct().hint("merge"), (F.col("__node") == F.col("k_node")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    if repeated:  # equal ids within a class: any one of its rows
        one = kept.groupBy("component").agg(F.min("node").alias("m_node")).select("m_node")
        out = out.join(one, F.col("__node") == F.col("m_node"), "left_semi").dropDuplicates(["doc_id", "__node"])
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
