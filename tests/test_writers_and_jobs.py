import bz2
import gzip
import json

import pytest

import __spark_entry__ as entry
from starloom.operators import maps
from starloom.plans import catalogue, jobs
from starloom.schema import LANG_STRING, XSD_STRING
from starloom.sinks import writers
from starloom.sinks.render import REGISTRY, render
from starloom.sources.lines import read_statements
from starloom.sources.settings import Settings, parse_languages, parse_properties, parse_range, parse_version
from starloom.streaming import incremental

COLS = "dataset string, subject string, predicate string, value string, datatype string, language string, context string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("d", "http://x/s", "http://x/p", "v", LANG_STRING, "en", None), ("d", "http://x/s", "http://x/p", 'q"<&', XSD_STRING, None, "http://x/g"), ("e", "a b", "rel", "http://x/o", None, None, None), ("e", "http://x/t", "http://y/r", "1", "http://x/int", None, None)], COLS)


def text(df, fmt):
    return {r["s"]: r["value"] for r in render(df.selectExpr("*", "concat(subject, value) s"), fmt, keep=("s",)).collect()}


def test_formats(df):
    for fmt in ("n-triples", "turtle-triples", "n-quads"):
        assert text(df, fmt)["http://x/sv"] == '<http://x/s> <http://x/p> "v"@en .'
    assert text(df, "n-quads")['http://x/sq"<&'] == '<http://x/s> <http://x/p> "q\\"<&" <http://x/g> .'
    assert text(df, "n-triples")["http://x/t1"] == '<http://x/t> <http://y/r> "1"^^<http://x/int> .'
    assert text(df, "n-triples")["a bhttp://x/o"] == "# # <BAD URI: malformed: a b> <BAD URI: not absolute: rel> <http://x/o> ."
    assert text(df, "rdf-json")["http://x/sv"] == '{"http:\\/\\/x\\/s" : { "http:\\/\\/x\\/p": [ { "value" : "v", "type" : "literal", "lang" : "en" } ]  } },'
    assert text(df, "trix-quads")['http://x/sq"<&'].split("\n") == ["  <graph>", "    <uri>http://x/g</uri>", "    <triple>", "      <uri>http://x/s</uri>", "      <uri>http://x/p</uri>", f'      <typedLiteral datatype="{XSD_STRING}">q&quot;&lt;&amp;</typedLiteral>', "    </triple>", "  </graph>"]
    assert text(df, "trix-triples")["http://x/sv"].split("\n")[4] == '      <plainLiteral xml:lang="en">v</plainLiteral>'
    with pytest.raises(ValueError):
        render(df, "n3")


def test_files(spark, df, tmp_path):
    good = df.filter("subject <> 'a b'").repartition(3)
    for name, opened in (("a.nq", open), ("a.nq.gz", gzip.open), ("a.nq.bz2", bz2.open)):
        writers.write_file(good, f"{tmp_path}/{name}", "n-quads")
        got = opened(f"{tmp_path}/{name}", "rt").read().splitlines()
        assert got[0].startswith("# started") and got[-1].startswith("# completed") and len(got) == 5
        back = read_statements(spark, f"{tmp_path}/{name}")
        assert {(r["subject"], r["value"], r["context"]) for r in back.collect()} == {(r["subject"], r["value"].replace('"', '\\"'), r["context"]) for r in good.collect()}
    out = writers.write_all(df, str(tmp_path / "all"), ["d", "e"], {"nt": "n-triples", "trix": "trix-triples"})
    assert sorted(p.rsplit("/", 1)[1] for p in out) == ["d.nt", "d.trix", "e.nt", "e.trix"] and spark.read.text(f"{tmp_path}/all/d.nt").count() == 2
    writers.write_split(df.filter("subject <> 'a b'").drop("dataset"), str(tmp_path / "split"), {"nt": "n-triples", "nq.gz": "n-quads"}, raw=False)
    split = spark.read.text(f"{tmp_path}/split/nt")
    assert {r["dataset"]: r["count"] for r in split.groupBy("dataset").count().collect()} == {"uns1-p": 2, "uns2-r": 1}


def test_settings(spark, tmp_path):
    (tmp_path / "job.properties").write_text("# c\nbase-dir=/d\ninput-datasets = a, b\\\n ,c a\nformat.ttl.bz2=turtle-triples;uri\nsuffix=.ttl.bz2\nprefix-map=x->http://x/;y->http://y/\nu=\\u00e9\n")
    s = Settings.load(spark, str(tmp_path / "job.properties"), {"base-dir": "/z", "tag": "t"})
    assert (s.base_dir, s.datasets, s.format(), s.string("tag"), s.string("u")) == ("/d", ["a", "b", "c"], "turtle-triples", "t", "é")
    assert s.mapping("prefix-map") == {"x": "http://x/", "y": "http://y/"} and s.strings("none") == [] and s.value("none", int) is None
    (tmp_path / "job.json").write_text(json.dumps({"n": 3}))
    assert Settings.load(spark, str(tmp_path / "job.json")).value("n", int) == 3
    assert parse_range("3-") == (3, 2**31 - 1) and parse_range("-") == (0, 2**31 - 1) and parse_range("x") is None
    assert parse_version(" 2016-10 ") == "2016-10" and parse_languages(["en", "!de", "de"]) == (["en"], ["de"])
    for bad in (lambda: parse_range("5-3"), lambda: parse_version("x2016-10"), lambda: Settings({"format.a": "zzz"}).formats()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        s.string("none", required=True)
    assert parse_properties("a : b\nc d\n!x\n") == {"a": "b", "c": "d"}


def test_jobs(spark, tmp_path):
    (tmp_path / "one.nt").write_text('<http://x/c> <http://x/p> "3" .\nbad\n<http://x/a> <http://x/p> "a\\"1" .\n<http://x/b> <http://x/q> <http://x/a> .\n')
    (tmp_path / "two.nt").write_text('<http://x/a> <http://x/p> "2" .\n<http://x/z> <http://x/p> "9" .\n')
    base = {"base-dir": str(tmp_path), "suffix": ".nt", "format.nt": "n-triples"}
    (to,) = jobs.sort_job(spark, Settings(base | {"input-datasets": "one"}))
    got = open(to).read().splitlines()
    assert got[0].startswith("# dataset:one") and got[-1].startswith("#sorting") and got[1:-1] == ['<http://x/a> <http://x/p> "a\\"1" .', "<http://x/b> <http://x/q> <http://x/a> .", '<http://x/c> <http://x/p> "3" .']
    assert [r["descents"] for r in jobs.check_sorted(spark, to).collect()] == [0]
    assert [r["descents"] for r in jobs.check_sorted(spark, str(tmp_path / "one.nt")).collect()] == [1]
    merged = jobs.traverse_job(spark, Settings(base | {"primary-input-dataset": "one", "input-datasets": "two", "output": "out.nt"}), maps.GroupJob())
    assert read_statements(spark, merged).count() == 4
    jobs.split_job(spark, Settings(base | {"input-datasets": "one,two", "prefix-map": "ex->http://x/"}), target_dir=str(tmp_path / "s"))
    assert {r["dataset"]: r["count"] for r in spark.read.text(f"{tmp_path}/s/nt").groupBy("dataset").count().collect()} == {"ex-p": 4, "ex-q": 1}
    docs = jobs.load_job(spark, Settings(base | {"primary-input-dataset": "one", "input-datasets": "two"}), target=str(tmp_path / "docs"))
    assert docs.count() == 3
    with pytest.raises(FileNotFoundError):
        jobs.sort_job(spark, Settings(base | {"input-datasets": "none"}))


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.nt").write_text(f"<http://x/{i}> <http://x/p> <http://x/o> .\n# c\nbad\n")
    rows = incremental.stream_classified(spark, str(folder), most_files=1)
    good = rows.filter("line_class = 'statement'")
    for extra in (3, 4):
        incremental.write_stream(good, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        assert read_statements(spark, str(tmp_path / "out")).count() == extra
        (folder / "f3.nt").write_text("<http://x/3> <http://x/p> <http://x/o> .\n")


def test_entry_and_catalogue(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.ORACLES) == set(catalogue.QUERIES)
    df = entry.entry(spark)
    assert df.columns == ["line"] and df.count() == 650 and set(REGISTRY) >= {"n-quads"}
