import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from starloom.schema import LANG_STRING, XSD_STRING, has_object_predicate
from starloom.sources import headers, lines, paths

STATEMENTS = {
    "<a:s> <a:p> <a:o> .": ("a:s", "a:p", "a:o", None, None, None),
    '<a:s><a:p>"x\\"y"@en.': ("a:s", "a:p", 'x\\"y', LANG_STRING, "en", None),
    '<a:s> <a:p> "" <g:g> . ': ("a:s", "a:p", "", XSD_STRING, None, "g:g"),
    '<a:s> <a:p> "v"^^<d:t> .': ("a:s", "a:p", "v", "d:t", None, None),
    "<> <> <>.": ("", "", "", None, None, None),
    '<a:s> <a:p> "x"@en-gb <> .': ("a:s", "a:p", "x", LANG_STRING, "en-gb", ""),
    '<a:s> <a:p> "x"^^<> .': ("a:s", "a:p", "x", "", None, None),
    '\t<s> <p> "a > b >> \x01 c" <g> .': ("s", "p", "a > b >> \x01 c", XSD_STRING, None, "g"),
    "<$1> <p\\\\> <$0> .": ("$1", "p\\\\", "$0", None, None, None),
    '<s> <p> "' + 'x\\"' * 400_000 + '" .': ("s", "p", 'x\\"' * 400_000, XSD_STRING, None, None),
}
REJECTS = ["_:b <a:p> <a:o> .", '<a:s> <a:p> "x"', '<a:s> <a:p> "x"@EN .', "<a:s> <a:p> <o>@en .", '<a:s> <a:p> "x" # c', "<a:s> <a:p> <a:o> .\u0085", "  # c", " ", ">a>b>c>d>e>f>g", "<s> <p> <o> . .", '<s> <p> "' + "y" * 1_200_000, "plain"]


def test_grammar(spark):
    rows = [(s,) for s in [*STATEMENTS, *REJECTS, "# c", "", None]]
    got = {r["line"]: r for r in lines.parsed(spark.createDataFrame(rows, "value string")).collect()}
    for line, want in STATEMENTS.items():
        r = got[line]
        assert r["line_class"] == "statement" and tuple(r[c] for c in ("subject", "predicate", "value", "datatype", "language", "context")) == want, line[:80]
    for line in REJECTS:
        assert got[line]["line_class"] == "reject" and got[line]["subject"] is None and got[line]["datatype"] is None, line[:80]
    assert (got["# c"]["line_class"], got[""]["line_class"], got[None]["line_class"]) == ("comment", "blank", "blank")


def test_files_codecs_and_order(spark, tmp_path):
    body = b"# head\n<a:s> <a:p> <a:o> .\nbad\n\n"
    (tmp_path / "a.nt").write_bytes(body)
    (tmp_path / "b.nt.gz").write_bytes(gzip.compress(body) + gzip.compress(b"<a:s> <a:p> <a:q> .\r\n"))
    (tmp_path / "c.nt.bz2").write_bytes(bz2.compress(body) + bz2.compress(b"<a:s> <a:p> <a:r> .\n"))
    (tmp_path / "d.txt").write_bytes(b"<x> <x> <x> .")
    found = lines.read_classified(spark, str(tmp_path), dataset="d", glob="*.nt*")
    assert sorted(r["value"] for r in lines.statements(found).collect()) == ["a:o", "a:o", "a:o", "a:q", "a:r"]
    assert [r["dataset"] for r in lines.statements(found).limit(1).collect()] == ["d"]
    assert {(r["line"], r["reason"]) for r in lines.rejects(found).collect()} == {("bad", "no final dot")}
    assert lines.comments(found).count() == 3
    r = lines.line_counts(found).first()
    assert (r["successes"], r["failures"], r["comments"], r["blanks"]) == (5, 3, 3, 3) and r["error_rate"] == 3 / 8
    assert paths.names(spark, str(tmp_path), r".*\.gz") == ["b.nt.gz"] and len(paths.glob(spark, f"{tmp_path}/*.nt*")) == 3


def test_empty_file_and_block_order(spark, tmp_path):
    (tmp_path / "e.nt").write_bytes(b"")
    assert lines.read_statements(spark, str(tmp_path / "e.nt")).count() == 0
    for name, n in (("a", 100), ("b", 900), ("c", 350)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i:04d}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = lines.read_lines(spark, str(tmp_path), glob="*.txt").orderBy("_file", "_block", "_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in rows] == [f"{f}{i:04d}" for f, n in (("a", 100), ("b", 900), ("c", 350)) for i in range(n)]


def test_headers(spark):
    line = headers.header_line("labels_en", 12, "turtle-quads", traits=("subject-sorted", "distinct"))
    rows = [("f", 0, 1, line), ("f", 0, 2, "# dataset:x   size:1   serialization:n   started:2020-01-01T00:00:00Z   traits:"), ("g", 0, 0, "# none"), ("f", 0, 3, headers.footer_line())]
    got = headers.headers(spark.createDataFrame(rows, "_file string, _block long, _seq long, line string")).collect()
    assert len(got) == 1 and (got[0]["dataset"], got[0]["size"], got[0]["serialization"], got[0]["traits"]) == ("labels_en", 12, "turtle-quads", ["subject-sorted", "distinct"]) and got[0]["started"]


@pytest.mark.parametrize("value,datatype,language,want", [("http://a/b", None, None, True), ("rel", None, None, False), ("http://a", "x", None, False), ("a b", None, None, False)])
def test_object_predicate(spark, value, datatype, language, want):
    df = spark.createDataFrame([(value, datatype, language)], "value string, datatype string, language string")
    assert df.filter(has_object_predicate()).count() == int(want)


def test_observed_counts(spark):
    from pyspark.sql import Observation

    watch = Observation("lines")
    df = lines.parsed(spark.createDataFrame([("<a> <b> <c> .",), ("x",)], "value string"))
    df.observe(watch, F.count_if(F.col("line_class") == "reject").alias("failures")).collect()
    assert watch.get["failures"] == 1 and lines.observed(df, "o").count() == 2
