"""Files by Hadoop path: listing, filtering by name, deletion, ordered concatenation."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Suffixes that Spark's readers decompress by name.
CODECS = {"gz": "gzip", "bz2": "bzip2"}


def codec(name: str) -> str:
    """The codec that a file name's last suffix asks for, or `none`."""
    return CODECS.get(name.rsplit(".", 1)[-1], "none")


def dataset_path(base_dir: str, dataset: str, suffix: str) -> str:
    """Where a dataset's file lies: base directory, name and suffix."""
    return f"{base_dir.rstrip('/')}/{dataset}{suffix}"


def output_name(dataset: str, suffix: str) -> str:
    """File name of an output dataset: underscores become hyphens."""
    return f"{dataset.replace('_', '-')}.{suffix.lstrip('.')}"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str, pattern: str | None = None) -> list[str]:
    """Names in a folder that match a regular expression as a whole; without one, all. Sorted."""
    fs, p = _fs(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in found if pattern is None or re.fullmatch(pattern, n))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or a whole folder; False if there was none."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def required(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def concatenate(spark: SparkSession, parts: list[str], target: str) -> None:
    """Bytes of the parts one after another in one file.

    Members of gzip and bzip2 files read as one file, so compressed parts need no rewriting.
    """
    fs, out = _fs(spark, target)
    conf = spark._jsc.hadoopConfiguration()
    stream = fs.create(out, True)
    try:
        for part in parts:
            pfs, p = _fs(spark, part)
            source = pfs.open(p)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
            finally:
                source.close()
    finally:
        stream.close()


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames source to target, of one file system, in place of what may be there."""
    fs, out = _fs(spark, target)
    fs.delete(out, False)
    if not fs.rename(_fs(spark, source)[1], out):
        raise OSError(f"{source} could not be renamed to {target}")


def copy(spark: SparkSession, source: str, target: str) -> None:
    concatenate(spark, [source], target)
