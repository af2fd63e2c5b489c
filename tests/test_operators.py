import random
import re

import pytest
from pyspark.sql import functions as F

from starloom.operators import documents, filters, groups, maps, merges, search, sets, sorts, star
from starloom.plans import tables
from starloom.schema import FIELDS, STATEMENT, XSD_STRING, conform, statement


def quads(spark, rows):
    """Statements from (subject, predicate, value, context) rows, with their place."""
    data = [(i, None, s, p, v, None, None, c) for i, (s, p, v, c) in enumerate(rows)]
    return spark.createDataFrame(data, "_seq long, dataset string, subject string, predicate string, value string, datatype string, language string, context string")


@pytest.fixture(scope="module")
def six(spark):
    return quads(spark, [("a", "p", "1", None), ("b", "p", "2", "g"), ("a", "p", "1", "h"), ("c", "q", "3", None)])


def test_filters(six):
    ids = lambda **k: sorted(r["_seq"] for r in filters.matching(six, **k).collect())
    assert ids() == ids(subject=" , ") == [0, 1, 2, 3] and ids(subject="a, c") == [0, 2, 3]
    assert ids(graph=["g"]) == [0, 1, 3] and ids(predicate="q", value=["3"]) == [3] and ids(dataset="d") == []
    assert filters.among(six, six.filter("_seq = 1").select("subject"), "subject").count() == 1
    assert filters.among(six, six.filter("_seq = 1").select("subject"), "subject", negate=True).count() == 3


def test_sets(six):
    assert sorted(r["_seq"] for r in sets.distinct(six).collect()) == [0, 1, 3]
    batched = six.withColumn("b", F.floor(F.col("_seq") / 2))
    assert sorted(r["_seq"] for r in sets.distinct(batched, within=("b",)).collect()) == [0, 1, 2, 3]
    assert sets.distinct(six.limit(0)).count() == 0 and sets.union(six, six.drop("_seq")).count() == 8


def test_groups_and_merges(spark, six):
    other = quads(spark, [("a", "p", "9", None), ("d", "p", "9", None), ("c", "p", "8", None)])
    lead = merges.group_sizes(merges.tagged(six, other), 2, lead_only=True)
    assert sorted(map(tuple, lead.collect())) == [("a", 2, 1), ("b", 1, 0), ("c", 1, 1)]
    every = merges.group_sizes(merges.merge_all(six, other), 2)
    assert sorted(r["key"] for r in every.collect()) == ["a", "b", "c", "d"]
    rows = merges.merge_lead(six, other)
    assert sorted((r["_source"], r["subject"]) for r in rows.collect()) == [(0, "a"), (0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "c")]
    lists = {r["key"]: [s["value"] for s in r["statements"]] for r in merges.grouped(rows, lead_only=True).collect()}
    assert lists == {"a": ["1", "1", "9"], "b": ["2"], "c": ["3", "8"]}
    graphs = {r["key"]: r["n"] for r in groups.groups(six, "graph").collect()}
    assert graphs == {None: 2, "g": 1, "h": 1}
    assert groups.group_of(six, "graph", None).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_descents(spark, seed):
    rng = random.Random(seed)
    rows = [(f, b, s, rng.choice(["a", "b", None])) for f in "xy" for b in range(6) for s in range(rng.choice([1, 2, 9]))]
    df = spark.createDataFrame(rows, "_file string, _block long, _seq long, k string").repartition(5)
    want, falls = [], {}
    for f in "xy":
        keys, run = [k for g, _, _, k in rows if g == f], 0
        order = [("" if k is None else "1" + k) for k in keys]
        falls[f] = sum(b < a for a, b in zip(order, order[1:]))
        for i, k in enumerate(keys):
            run += i == 0 or keys[i - 1] != k
            want.append((f, run, k))
    got = [(r["_file"], r["run"], r["k"]) for r in groups.runs(df, "k").orderBy("_file", "_block", "_seq").collect()]
    assert got == want
    assert {r["_file"]: r["descents"] for r in groups.descents(df, "k").collect()} == falls
    assert groups.run_groups(df, "k").count() == len({w[:2] for w in want})


def test_sorts(spark, six):
    values = ["b", None, "", "a", "ab", "\U0001f600", "\uffff", "Z_", "Z/", "é"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    ranked = sorts.numbered(df, ["v"]).collect()
    assert [r["v"] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(values, key=lambda v: (v is not None, v or ""))
    assert sorted(r["rank"] for r in ranked) == list(range(1, 11))
    assert [r["subject"] for r in sorts.sort_by(six, "value").collect()] == ["a", "a", "b", "c"]
    assert sorts.first_rows(six, ["value", "_seq"], 2).count() == 2 and sorts.numbered(six.limit(0), ["value"]).count() == 0


def test_maps(spark, six):
    both = [statement(F.col("value"), "inv", F.col("subject")), F.when(F.col("predicate") == "q", statement(F.col("subject"), "is", F.lit("q"), XSD_STRING))]
    assert maps.map_statements(six, both).count() == 5
    upper = maps.map_batches(six.select(*FIELDS), lambda f: f.assign(subject=f["subject"].str.upper()))
    assert {r["subject"] for r in upper.collect()} == {"A", "B", "C"}
    last = maps.map_groups(six, "subject", lambda f: f.tail(1)[list(FIELDS)])
    assert {(r["subject"], r["context"]) for r in last.collect()} == {("a", "h"), ("b", "g"), ("c", None)}
    assert maps.GroupJob().run(six, six.filter("subject = 'c'")).count() == 5
    with pytest.raises(ValueError):
        maps.changed(six, nope=F.lit(1))
    assert conform(six.select("subject", "predicate", "value"), "d").columns == list(FIELDS) and len(STATEMENT) == 7


def test_star(spark):
    base, onto = "http://x/resource/", "http://x/ontology/"
    rows = [("A_b", star.LABEL, "Category:A"), ("A_b", star.LABEL, "Second"), ("A_b", onto + "otherName", "Second"), ("A_b", star.COMMENT, "c1"), ("A_b", star.COMMENT, "c2"), ("A_b", star.RANK, "1.5"), ("A_b", star.SAME_AS, "http://y/Z_%C3%A9"), ("A_b", star.EXACT_MATCH, "http://y/Z_%C3%A9"), ("File:x", star.LABEL, "f"), ("R", star.LABEL, "r"), ("B", star.RANK, "x")]
    df = quads(spark, [(base + s, p, v, None) for s, p, v in rows]).withColumn("_source", F.lit(0))
    redirects = quads(spark, [(base + "R", "to", base + "A_b", None)])
    docs = {r["title"]: r for r in star.entity_documents(df, star.StarRules(base, onto), redirects=redirects).collect()}
    a = docs["A b"]
    assert set(docs) == {"A b", "B"} and (a["label"], a["comment"], a["pagerank"], a["alt_label"]) == ("A", "c1", 1.5, ["Second"])
    assert (a["same_as_uri"], a["same_as_text"], a["redirects_uri"], a["redirects_text"]) == (["http://y/Z_%C3%A9"], ["Z é"], [base + "R"], ["R"])
    assert a["dynamic"] == {"alt_label_0": "Second", "same_as_text_0": "Z é", "redirects_text_0": "R"}
    assert docs["B"]["label"] is None and docs["B"]["pagerank"] is None and docs["B"]["redirects_uri"] is None


def test_documents(spark):
    schema = documents.DocumentSchema.from_xml('<schema><fields><field name="id" type="string" required="true"/><field name="n" type="int"/><field name="t" type="string" multiValued="true"/><dynamicField name="*_s" type="string"/></fields></schema>')
    assert schema.field("id").required and schema.field("a_s").dynamic and schema.field("zzz") is None and schema.names() == ["id", "n", "t", "*_s"]
    df = spark.createDataFrame([("1", 1, "x"), ("2", 2, "y" * 40_000), ("3", None, None)], "id string, n int, t string")
    got = {r["id"]: r["t"] for r in documents.checked(df, schema).collect()}
    assert got == {"1": ["x"], "2": None, "3": None}
    for bad in (df.withColumn("zzz", F.lit(1)), df.withColumn("n", F.array("n")), df.drop("id")):
        with pytest.raises(documents.DocumentError):
            documents.checked(bad, schema)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(documents.delete_ids(df, ["1", None])) == ["2", "3"] and ids(documents.delete_ids(df, [])) == ids(documents.delete_ids(df, None)) == ["1", "2", "3"]
    assert ids(documents.delete_where(df, F.col("n") > 1)) == ["1", "3"] and documents.delete_all(df).count() == 0
    new = spark.createDataFrame([("2", 20, "z"), ("4", 40, "w")], df.schema)
    assert {r["id"]: r["n"] for r in documents.upsert(df, new).collect()} == {"1": 1, "2": 20, "3": None, "4": 40}


def test_search(spark):
    texts = spark.createDataFrame([(1, "New York City and York"), (2, "the new york"), (3, None), (4, "")], "id long, text string")
    labels = spark.createDataFrame([("ny", "New York"), ("nyc", "new york city"), ("y", "York"), ("yk", "york"), ("cc", "City and")], "id string, label string")
    tags = lambda o: sorted((r["id"], r["start_offset"], r["end_offset"], r["match_text"]) for r in search.tag(texts, labels, overlap=o).collect())
    assert tags("ALL") == [(1, 0, 8, "New York"), (1, 0, 13, "New York City"), (1, 4, 8, "York"), (1, 9, 17, "City and"), (1, 18, 22, "York"), (2, 4, 12, "new york"), (2, 8, 12, "york")]
    assert tags("NO_SUB") == [(1, 0, 13, "New York City"), (1, 9, 17, "City and"), (1, 18, 22, "York"), (2, 4, 12, "new york")]
    assert tags("LONGEST_DOMINANT_RIGHT") == [(1, 0, 13, "New York City"), (1, 18, 22, "York"), (2, 4, 12, "new york")]
    assert search.resolved([(0, 4), (3, 7), (6, 10)], "LONGEST_DOMINANT_RIGHT") == [(0, 4), (6, 10)]
    assert [r["ids"] for r in search.tag(texts, labels).filter("id = 2 AND start_offset = 8").collect()] == [["y", "yk"]]
    scores = {r["id"]: r["score"] for r in search.bm25(texts, ["York", "city", "a b"]).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2] > 0
    assert search.bm25(texts, []).count() == 0
    assert [r["id"] for r in search.find(texts, search.contains_words("text", "YORK the")).collect()] == [2]


@pytest.mark.parametrize("sent", [search.SENT_BYTES, 0])
def test_tags_of_texts_with_one_id(spark, monkeypatch, sent):
    """Each text's matches and overlaps are its own, with the dictionary sent and joined."""
    monkeypatch.setattr(search, "SENT_BYTES", sent)
    texts = spark.createDataFrame([(1, "a big cat, a big cat"), (1, "the dog"), (None, "a cat"), (2, None)], "id long, text string").repartition(3)
    labels = spark.createDataFrame([("c", "Cat"), ("b", "big-cat"), ("d", "dog"), ("n", None)], "id string, label string")
    tags = lambda **k: sorted((r["id"] or 0, r["start_offset"], r["match_text"], *r["ids"]) for r in search.tag(texts, labels, **k).collect())
    assert tags() == [(0, 2, "cat", "c"), (1, 2, "big cat", "b"), (1, 4, "dog", "d"), (1, 6, "cat", "c"), (1, 13, "big cat", "b"), (1, 17, "cat", "c")]
    assert tags(overlap="NO_SUB") == [(0, 2, "cat", "c"), (1, 2, "big cat", "b"), (1, 4, "dog", "d"), (1, 13, "big cat", "b")]
    assert tags(overlap="LONGEST_DOMINANT_RIGHT", most=1) == [(0, 2, "cat", "c"), (1, 2, "big cat", "b"), (1, 4, "dog", "d")]


def test_lookup_with_repeated_rows(spark):
    notes = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a", "b", "a"]), (2, ["z"]), (3, None), (None, ["b"])], "start long, ids array<string>").repartition(4)
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long").repartition(3)
    got = merges.lookup(notes, docs)
    assert got.columns == ["start", "ids", "documents"]
    rows = sorted(((r["start"] or 0), None if r["documents"] is None else [d["n"] for d in r["documents"]]) for r in got.collect())
    assert rows == [(0, [2]), (1, [1, 2]), (1, [1, 2]), (2, None), (3, None)]


def test_merge_lead_sorts_by_a_number(spark):
    """Sides are sorted by one number, not by texts that begin alike; null, doubled and foreign keys as before."""
    lead = spark.createDataFrame([("http://x/1",), (None,), ("http://x/1",), ("",)], "subject string")
    other = spark.createDataFrame([("http://x/1", 1), (None, 2), ("http://x/2", 3), ("", 4), ("http://x/1", 5), (None, 6)], "subject string, n int")
    given = [(lead, other), (lead.filter("subject IS NOT NULL").fillna("-"), other.fillna("-"))]
    for (a, b), want in zip(given, ([1, 2, 4, 5, 6], [1, 4, 5])):
        out = merges.merge_lead(a, b.hint("merge"))
        keys = re.findall(r"SortMergeJoin \[(.*?)\], \[", out._jdf.queryExecution().executedPlan().toString())
        assert len(keys) == 1 and re.fullmatch(r"xxhash64\([^,]*, 42\)", keys[0])
        assert sorted(r["n"] for r in out.filter("_source = 1").collect()) == want
    numbers = merges.merge_lead(spark.range(3).withColumnRenamed("id", "subject"), spark.createDataFrame([(1,), (7,)], "subject int"))
    assert sorted(r["subject"] for r in numbers.filter("_source = 1").collect()) == [1]


def test_statements_make_what_is_asked(spark):
    """Counting statements makes no values."""
    made = tables.statements(spark, "/root/testdata/sf0.001", "lineitem")
    plan = made.groupBy("subject").count()._jdf.queryExecution().executedPlan().toString()
    assert "returnflag" in plan and "decimal(18,2)" not in plan and "ns#l_quantity" not in plan
