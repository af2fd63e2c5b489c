"""Whole jobs, each driven by settings: sort, traverse, split, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.functions.namespaces import Namespaces
from starloom.operators import groups, maps, merges, sorts, star
from starloom.schema import Target, key_name
from starloom.shared import materialised
from starloom.sinks.writers import write_file, write_split
from starloom.sources import headers, paths
from starloom.sources.lines import read_statements
from starloom.sources.settings import Settings


def _inputs(spark: SparkSession, settings: Settings) -> dict[str, str]:
    suffix = settings.string("suffix", default="")
    return {d: paths.required(spark, paths.dataset_path(settings.base_dir, d, suffix)) for d in settings.datasets}


def sort_job(spark: SparkSession, settings: Settings, target: Target | str = Target.SUBJECT) -> list[str]:
    """Every input dataset sorted, as <name>-sorted<suffix>, with header and footer."""
    out = []
    fmt = settings.format() or "turtle-quads"
    suffix = settings.string("output-suffix") or settings.string("suffix", default="")
    for name, path in _inputs(spark, settings).items():
        read = read_statements(spark, path, dataset=name)
        df, size = sorts.sort_by(read, target), read.count()
        to = paths.dataset_path(settings.base_dir, f"{name}-sorted", suffix)
        head = headers.header_line(name, size, fmt, traits=(f"{key_name(target)}-sorted",))
        terse = fmt.startswith(("n-", "turtle-"))
        write_file(df, to, fmt, raw=True, head=head if terse else None, foot=headers.footer_line() if terse else None)
        out.append(to)
    return out


def traverse_job(spark: SparkSession, settings: Settings, job: maps.GroupJob) -> str:
    """A group job over the merge of the primary input with the others, written to `output`."""
    suffix = settings.string("suffix", default="")
    lead = paths.dataset_path(settings.base_dir, settings.string("primary-input-dataset", required=True), suffix)
    read = lambda p: read_statements(spark, paths.required(spark, p))
    result = job.run(read(lead), *(read(p) for p in _inputs(spark, settings).values()))
    to = f"{settings.base_dir.rstrip('/')}/{settings.string('output', required=True)}"
    write_file(result, to, settings.format() or next(iter(settings.formats().values()), "n-triples"), raw=True)
    return to


def split_job(spark: SparkSession, settings: Settings, predicates: dict[str, list[str]] | None = None, target_dir: str | None = None) -> None:
    """Every input dataset by predicate, in all formats."""
    formats = settings.formats() or {"nt": "n-triples"}
    df = read_statements(spark, list(_inputs(spark, settings).values()))
    write_split(df, target_dir or settings.base_dir, formats, predicates, Namespaces(settings.mapping("prefix-map")))


def load_job(spark: SparkSession, settings: Settings, rules: star.StarRules | None = None, target: str | None = None) -> DataFrame:
    """Entity documents of the lead dataset and all others, optionally written as Parquet.

    `redirects` and `disambiguations` name further datasets, which are links.
    """
    suffix = settings.string("suffix", default="")
    at = lambda d: read_statements(spark, paths.required(spark, paths.dataset_path(settings.base_dir, d, suffix)))
    lead = at(settings.string("primary-input-dataset", required=True))
    rows = merges.merge_lead(lead, *(at(d) for d in settings.datasets))
    links = {k: at(settings.string(k)) if settings.string(k) else None for k in ("redirects", "disambiguations")}
    docs = star.entity_documents(rows, rules, **links)
    if target:
        docs.write.parquet(target)
        return spark.read.parquet(target)
    return docs


def check_sorted(spark: SparkSession, path: str, target: Target | str = Target.SUBJECT) -> DataFrame:
    """For each file how many keys are less than the one before."""
    rows = materialised(read_statements(spark, path).select(key_name(target), "_file", "_block", "_seq"), "check-sorted")
    return groups.descents(rows, key_name(target))
