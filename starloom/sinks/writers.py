"""Writers of statement text: folders of part files, single files, several outputs, splits by predicate."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.namespaces import Namespaces
from starloom.operators.filters import condition
from starloom.shared import materialised
from starloom.sources import paths

from .render import footer, header, render


class Sink(Protocol):
    """What a job writes its statements to."""

    def write(self, df: DataFrame) -> None: ...


@dataclass(frozen=True)
class PartsSink:
    """A folder of part files."""

    folder: str
    fmt: str = "n-triples"
    compression: str = "none"
    raw: bool = False
    mode: str = "error"

    def write(self, df: DataFrame) -> None:
        write_parts(df, self.folder, self.fmt, self.compression, self.raw, self.mode)


@dataclass(frozen=True)
class FileSink:
    """One file, written anew or appended to."""

    path: str
    fmt: str = "n-triples"
    raw: bool = False
    append: bool = False

    def write(self, df: DataFrame) -> None:
        write_file(df, self.path, self.fmt, self.raw, append=self.append)


@dataclass(frozen=True)
class FilteredSink:
    """The statements that meet a condition, to another sink."""

    sink: Sink
    condition: Column

    def write(self, df: DataFrame) -> None:
        self.sink.write(df.filter(self.condition))


@dataclass(frozen=True)
class SinkGroup:
    """Several sinks, one after another; statements are computed once."""

    sinks: tuple[Sink, ...]

    def write(self, df: DataFrame) -> None:
        kept = materialised(df, "outputs")
        for sink in self.sinks:
            sink.write(kept)


def write_parts(df: DataFrame, folder: str, fmt: str = "n-triples", compression: str = "none", raw: bool = False, mode: str = "error") -> None:
    """A folder of part files, one for each partition, in order."""
    render(df, fmt, raw).write.mode(mode).option("compression", compression).text(folder)


def write_file(df: DataFrame, path: str, fmt: str = "n-triples", raw: bool = False, head: str | None = None, foot: str | None = None, append: bool = False) -> None:
    """One file, with header and footer; the codec follows the name.

    append: after what the file holds, if it is there; for formats of lines, as the header and
    footer of each part stay where they are.

    Parts are rendered and compressed by all tasks, then joined by bytes in their order:
    members of gzip and bzip2 files read as one.
    """
    spark, kind = df.sparkSession, paths.codec(path)
    temp = f"{path}.parts-{uuid.uuid4().hex}"
    top, end = head or header(fmt), foot or footer(fmt)

    def line(text: str | None, name: str) -> list[str]:
        if text is None:
            return []
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("compression", kind).text(f"{temp}/{name}")
        return _parts(df, f"{temp}/{name}")

    try:
        write_parts(df, f"{temp}/body", fmt, kind, raw)
        parts = [*line(top, "head"), *_parts(df, f"{temp}/body"), *line(end, "foot")]
        if append and paths.exists(spark, path):
            paths.concatenate(spark, [path, *parts], f"{temp}/joined")
            paths.replace(spark, f"{temp}/joined", path)
        else:
            paths.concatenate(spark, parts, path)
    finally:
        paths.delete(spark, temp)


def _parts(df: DataFrame, folder: str) -> list[str]:
    return [f"{folder}/{n}" for n in paths.names(df.sparkSession, folder, r"part-.*")]


def write_all(df: DataFrame, base_dir: str, datasets: Iterable[str], formats: Mapping[str, str], single: bool = False, **constraints) -> list[str]:
    """Every dataset in every format (suffix to format); statements are computed once.

    One dataset takes all statements, several take those of their name each. Returns the paths.
    """
    names, sinks, out = list(datasets), [], []
    for name in names:
        for suffix, fmt in formats.items():
            path = f"{base_dir.rstrip('/')}/{paths.output_name(name, suffix)}"
            sink = FileSink(path, fmt) if single else PartsSink(path, fmt, paths.codec(suffix))
            out.append(path)
            sinks.append(FilteredSink(sink, F.col("dataset") == name) if len(names) > 1 else sink)
    SinkGroup(tuple(sinks)).write(df.filter(condition(**constraints)))
    return out


def split_names(df: DataFrame, explicit: Mapping[str, Iterable[str]] | None = None, namespaces: Namespaces | None = None, default: bool = True) -> DataFrame:
    """df with `dataset`: the name whose predicates hold the statement's, or else prefix-localname.

    Without default, statements of no named predicate are left out.
    """
    named: Column = F.lit(None).cast("string")
    for name, predicates in (explicit or {}).items():
        named = F.coalesce(named, F.when(F.col("predicate").isin(list(predicates)), name))
    if not default:
        return df.withColumn("dataset", named).filter("dataset IS NOT NULL")
    split = (namespaces or Namespaces()).split(df, "predicate")
    return split.withColumn("dataset", F.coalesce(named, F.concat_ws("-", "ns_prefix", "local_name"))).select(*df.columns, *([] if "dataset" in df.columns else ["dataset"]))


def write_split(df: DataFrame, base_dir: str, formats: Mapping[str, str], explicit: Mapping[str, Iterable[str]] | None = None, namespaces: Namespaces | None = None, default: bool = True, raw: bool = True) -> None:
    """A folder for each format with one for each dataset name in it.

    Rows are rebalanced by dataset, so that small datasets get one file and large ones as
    many as their size asks for.
    """
    named = materialised(split_names(df, explicit, namespaces, default), "split") if len(formats) > 1 else split_names(df, explicit, namespaces, default)
    for suffix, fmt in formats.items():
        lines = render(named, fmt, raw, keep=("dataset",)).hint("rebalance", "dataset")
        lines.write.partitionBy("dataset").option("compression", paths.codec(suffix)).text(f"{base_dir.rstrip('/')}/{suffix.lstrip('.')}")

