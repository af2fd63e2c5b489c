"""Where operators cut lineage, and how they run Python over Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

from starloom.shared import shared_dir

#: Bytes of an Arrow batch that goes to Python, where the session does not say.
BATCH_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end the tables that were written in it, but for those written with keep."""
    _scratch.append([])
    try:
        yield
    finally:
        removed(*_scratch.pop())


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; keep: until the scratch around this one ends."""
    path = f"{shared_dir(df.sparkSession)}/starloom/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._written_to = path
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(out)
    return out


def removed(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that written() returned, once nothing reads them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame) -> DataFrame:
    """df; its session bounds Arrow batches by bytes from now on, if it does not yet."""
    if df.sparkSession.conf.get(_BYTES, None) is None:
        df.sparkSession.conf.set(_BYTES, str(BATCH_BYTES))
    return df


def _rest() -> None:
    """Gives freed memory back, as workers wait for their next task for a minute."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow over batches of bounded bytes; a task leaves no memory behind in its worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _rest()

    return bounded(df).mapInArrow(whole, schema)
