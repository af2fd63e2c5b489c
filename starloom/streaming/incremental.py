"""Statement files as a stream: bounded steps over files as they arrive.

Classification, filters, maps and rendering are row by row, so the batch functions work on
a stream unchanged. Progress is kept in the query's checkpoint; a step that fails is run
again on the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.schema import IDENTITY
from starloom.sinks.render import render
from starloom.sources.lines import parsed


def stream_lines(spark: SparkSession, folder: str, most_bytes: int | None = None, most_files: int | None = None) -> DataFrame:
    """Lines of the files in a folder; a step reads files of about so many bytes, or so many files."""
    reader = spark.readStream.format("text")
    if most_bytes:
        reader = reader.option("maxBytesPerTrigger", str(most_bytes))
    if most_files:
        reader = reader.option("maxFilesPerTrigger", str(most_files))
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("_file"))


def stream_classified(spark: SparkSession, folder: str, dataset: str | None = None, **options) -> DataFrame:
    return parsed(stream_lines(spark, folder, **options), dataset=dataset)


def distinct_since(df: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Each statement once within the delay; state older than it is dropped."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(IDENTITY))


def write_stream(df: DataFrame, folder: str, checkpoint: str, fmt: str = "n-triples", raw: bool = True, compression: str = "none", until_done: bool = True) -> StreamingQuery:
    """Statements of a stream as text files; until_done: all that is there now, in bounded steps, then stop."""
    writer = render(df, fmt, raw).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).option("compression", compression)
    return (writer.trigger(availableNow=True) if until_done else writer).start()
