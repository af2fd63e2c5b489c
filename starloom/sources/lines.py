"""Line-oriented statement files: N-Triples and N-Quads text, plain, gzip or bzip2."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.schema import FIELDS, LANG_STRING, ORIGIN, XSD_STRING

#: One statement. Groups: subject, predicate, <object, @language, ^^<datatype, <context, "literal".
#: Possessive quantifiers keep the matcher iterative however long a literal is. Optional groups
#: keep their first mark, so that an absent one and an empty value differ; none but the last
#: can hold the > at which the fields are cut apart again.
GRAMMAR = r"""(?s)\A[ \t]*<([^>]*+)>[ \t]*<([^>]*+)>[ \t]*(?:(<[^>]*+)>|("[^"\\]*+(?:\\.[^"\\]*+)*+")(?:(@[a-z][a-z0-9-]*+)|(\^\^<[^>]*+)>)?)[ \t]*(?:(<[^>]*+)>)?[ \t]*\.[ \t]*\z"""
_FIELDS_OF = ">$1>$2>$3>$5>$6>$7>$4"
COMMENT, STATEMENT_LINE, REJECT, BLANK = "comment", "statement", "reject", "blank"


def _groups(line: Column) -> Column:
    """An empty string and the groups, literal last, of a statement; something else for other lines.

    The grammar is matched once. What it rewrites begins with >, which no line does that gets here.
    """
    begins = F.left(line, F.lit(1)).isin(" ", "\t", "<")
    return F.when(begins, F.split(F.regexp_replace(line, F.lit(GRAMMAR), F.lit(_FIELDS_OF)), ">", 8))


def parsed(lines: DataFrame, column: str = "value", dataset: str | None = None) -> DataFrame:
    """Every line with `line_class` and the statement's fields, null where it is none.

    A line is blank (empty), a comment (# in its first place), a statement or a reject.
    Literals keep their escapes. A null line is blank. Further columns of `lines` come along
    unless a statement's field has the same name; the line itself is in `line`.
    """
    rest = [c for c in lines.columns if c != column and c not in FIELDS and c not in ("line", "line_class", "_s", "_g")]
    cut = lines.select(F.col(column).alias("line"), *rest).withColumn("_s", _groups(F.col("line")))
    cut = cut.withColumn("_g", F.when(F.get("_s", F.lit(0)) == "", F.col("_s"))).drop("_s")
    subject, predicate, value, language, datatype, context, literal = (F.get("_g", F.lit(k)) for k in range(1, 8))

    def after(x: Column, marks: int) -> Column:
        return F.when(x != "", F.substring(x, F.lit(marks + 1), F.length(x)))

    fields = {
        "dataset": F.when(F.col("_g").isNotNull(), F.lit(dataset).cast("string")),
        "subject": subject,
        "predicate": predicate,
        "value": F.coalesce(after(value, 1), F.substring(literal, F.lit(2), F.length(literal) - 2)),
        "datatype": F.when(value == "", F.coalesce(after(datatype, 3), F.when(language != "", LANG_STRING).otherwise(XSD_STRING))),
        "language": after(language, 1),
        "context": after(context, 1),
    }
    kind = F.when(F.coalesce(F.col("line") == "", F.lit(True)), BLANK).when(F.startswith("line", F.lit("#")), COMMENT).when(F.col("_g").isNotNull(), STATEMENT_LINE).otherwise(REJECT)
    return cut.select(*(fields[c].alias(c) for c in FIELDS), *rest, "line", kind.alias("line_class"))


def read_lines(spark: SparkSession, paths: str | Iterable[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Lines with their origin. Codecs follow the file name; multi-member gzip and bzip2 are read whole.

    Origin columns are set by the scan; write the table before anything that could run the
    scan again with other splits.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    text = reader.text(paths if isinstance(paths, str) else list(paths))
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))


def read_classified(spark: SparkSession, paths: str | Iterable[str], dataset: str | None = None, **options) -> DataFrame:
    """All lines of the files, classified and parsed."""
    return parsed(read_lines(spark, paths, **options), dataset=dataset)


def statements(classified: DataFrame) -> DataFrame:
    """The statements among classified lines."""
    return classified.filter(F.col("line_class") == STATEMENT_LINE).drop("line", "line_class")


def severity(message: Column, error: Column) -> Column:
    """exception with an error, warning with a message alone, info with neither."""
    return F.when(error.isNotNull(), "exception").when(message.isNotNull(), "warning").otherwise("info")


def log_records(df: DataFrame, message: Column, error: Column | None = None) -> DataFrame:
    """df with its rows' message, error (null unless given) and severity."""
    error = F.lit(None).cast("string") if error is None else error
    return df.withColumns({"message": message, "error": error}).withColumn("severity", severity(F.col("message"), F.col("error")))


def rejects(classified: DataFrame) -> DataFrame:
    """The lines that are neither statement, comment nor empty, with a reason and severity."""
    body = F.col("line")
    reason = F.when(F.trim(body) == "", "white space only").when(~F.rtrim(body).endswith("."), "no final dot").when(F.startswith(F.ltrim(body), F.lit("_:")), "blank node").otherwise("no match of the grammar")
    origin = [c for c in ORIGIN if c in classified.columns]
    return classified.filter(F.col("line_class") == REJECT).select("line", reason.alias("reason"), severity(reason, F.lit(None)).alias("severity"), *origin)


def comments(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("line_class") == COMMENT).select("line", *(c for c in ORIGIN if c in classified.columns))


def read_statements(spark: SparkSession, paths: str | Iterable[str], dataset: str | None = None, **options) -> DataFrame:
    """The statements of the files; comments, empty lines and rejects are left out."""
    return statements(read_classified(spark, paths, dataset, **options))


def line_counts(classified: DataFrame, tag: str | None = None) -> DataFrame:
    """Per class of line (and tag, if a column is named): how many, and the error rate among statements and rejects."""
    keys = [tag] if tag else []
    n = {k: F.count_if(F.col("line_class") == k) for k in (STATEMENT_LINE, REJECT, COMMENT, BLANK)}
    out = classified.groupBy(*keys).agg(n[STATEMENT_LINE].alias("successes"), n[REJECT].alias("failures"), n[COMMENT].alias("comments"), n[BLANK].alias("blanks"))
    tried = F.col("successes") + F.col("failures")
    return out.withColumn("error_rate", F.when(tried > 0, F.col("failures") / tried).otherwise(F.lit(0.0)))


def observed(classified: DataFrame, name: str) -> DataFrame:
    """classified, counting its lines as it is read; the counts are in the query's observed metrics under `name`."""
    return classified.observe(name, F.count_if(F.col("line_class") == STATEMENT_LINE).alias("successes"), F.count_if(F.col("line_class") == REJECT).alias("failures"))
