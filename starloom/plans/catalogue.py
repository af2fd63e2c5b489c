"""Registered queries of the statement engine, one for each operator, with independent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.functions import uris
from starloom.functions.namespaces import Namespaces
from starloom.operators import documents, filters, groups, maps, merges, search, sets, sorts, star
from starloom.schema import FIELDS, LANG_STRING, XSD_STRING, has_object_predicate, statement, typed_object
from starloom.shared import shared_dir
from starloom.sinks.render import render
from starloom.sinks.writers import FileSink, SinkGroup, split_names, write_file
from starloom.sources import headers
from starloom.sources.lines import line_counts, log_records, parsed, read_statements, rejects
from starloom.sources.lines import statements as good_lines

from .tables import BASE, NS, XSD, iri, statements, statements_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_FIVE = "subject, predicate, value, datatype, language"
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("subject", "predicate", "value", "datatype", "language"))


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nations as N-Triples text, parsed back, sorted and rendered again."""
    lines = render(statements(spark, sf_dir, "customer", "nation"))
    return render(sorts.sort_by(good_lines(parsed(lines))), raw=True, name="line")


def _origin(df: DataFrame) -> DataFrame:
    return df.withColumns({"_file": F.lit("f"), "_block": F.lit(0).cast("long"), "_seq": F.monotonically_increasing_id()})


# --- sources and rendering --------------------------------------------------------------------


@query(f"SELECT subject, predicate, value, datatype, language, context FROM ({statements_sql('customer', 'nation')})")
def parse_roundtrip(spark, sf_dir):
    lines = render(statements(spark, sf_dir, "customer", "nation"))
    return good_lines(parsed(lines)).drop("dataset")


_CLASSED = """
SELECT '# ' || c_name AS line FROM customer UNION ALL SELECT '' FROM nation UNION ALL
SELECT '<http://ex.org/document/' || doc_id || '> <http://ex.org/ns#text> "' || replace(replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '" .' FROM documents UNION ALL
SELECT coalesce(split_part(text, chr(10), 1), '') || ' .' FROM documents"""


def _classed_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = F.concat(F.lit("<http://ex.org/document/"), F.col("doc_id").cast("string"), F.lit('> <http://ex.org/ns#text> "'), tx.escape_turtle(F.coalesce("text", F.lit(""))), F.lit('" .'))
    first = F.concat(F.coalesce(F.split("text", "\n", 2)[0], F.lit("")), F.lit(" ."))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("# "), "c_name").alias("value")).unionAll(table(spark, sf_dir, "nation").select(F.lit(""))).unionAll(docs.select(F.explode(F.array(good, first))))


@query(f"SELECT CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '#') THEN 'comment' WHEN starts_with(line, '<http://ex.org/document/') THEN 'statement' ELSE 'reject' END AS line_class, count(*) AS n FROM ({_CLASSED}) GROUP BY 1")
def parse_rejects(spark, sf_dir):
    return parsed(_classed_lines(spark, sf_dir)).groupBy("line_class").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (starts_with(line, '<http://ex.org/document/')) AS successes, count(*) FILTER (NOT starts_with(line, '<http://ex.org/document/') AND NOT starts_with(line, '#') AND line <> '') AS failures, count(*) FILTER (starts_with(line, '#')) AS comments, count(*) FILTER (line = '') AS blanks FROM ({_CLASSED})")
def line_status(spark, sf_dir):
    return line_counts(parsed(_classed_lines(spark, sf_dir))).drop("error_rate")


@query(
    f"""SELECT CASE WHEN NOT ends_with(rtrim(line, ' '), '.') THEN 'no final dot' WHEN trim(line, ' ') = '.' OR NOT starts_with(ltrim(line, ' '), '_:') THEN 'no match of the grammar' ELSE 'blank node' END AS reason, 'warning' AS severity, count(*) AS n
FROM ({_CLASSED}) WHERE NOT starts_with(line, '<http://ex.org/document/') AND NOT starts_with(line, '#') AND line <> '' GROUP BY 1"""
)
def reject_reasons(spark, sf_dir):
    return rejects(parsed(_classed_lines(spark, sf_dir))).groupBy("reason", "severity").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS message, CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error,
CASE WHEN o_orderstatus = 'F' THEN 'exception' WHEN o_orderpriority = '1-URGENT' THEN 'warning' ELSE 'info' END AS severity FROM orders"""
)
def log_severity(spark, sf_dir):
    urgent, failed = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderstatus") == "F", "failed")
    return log_records(table(spark, sf_dir, "orders"), urgent, failed).select("o_orderkey", "message", "error", "severity")


@query("SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def literal_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(statement(iri("document", "doc_id"), NS + "text", F.coalesce("text", F.lit("")), XSD_STRING).alias("s")).select("s.*")
    back = good_lines(parsed(render(docs, "turtle-quads"))).withColumn("text", tx.unescape_turtle("value"))
    return back.select(F.substring_index("subject", "/", -1).cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), tx.md5_hex("text").alias("digest"))


def _render_sql(line: str, *tables: str) -> str:
    return f"SELECT subject, predicate, {line} AS line FROM ({statements_sql(*tables)})"


_TERSE = "'<' || subject || '> <' || predicate || '> ' || CASE WHEN datatype IS NULL THEN '<' || value || '>' WHEN datatype = '{xsd}string' THEN '\"' || value || '\"' ELSE '\"' || value || '\"^^<' || datatype || '>' END || ' '".replace("{xsd}", XSD)


@query(_render_sql(_TERSE + " || '.'", "nation", "region", "part"))
def render_ntriples(spark, sf_dir):
    return render(statements(spark, sf_dir, "nation", "region", "part"), "n-triples", keep=("subject", "predicate"), name="line")


@query(_render_sql(_TERSE + " || '<http://ex.org/graph/' || dataset || '> .'", "nation", "supplier"))
def render_nquads(spark, sf_dir):
    df = statements(spark, sf_dir, "nation", "supplier")
    return render(maps.changed(df, context=F.concat(F.lit("http://ex.org/graph/"), "dataset")), "n-quads", keep=("subject", "predicate"), name="line")


_TRIX = "'  <graph>' || chr(10) || '    <triple>' || chr(10) || '      <uri>' || subject || '</uri>' || chr(10) || '      <uri>' || predicate || '</uri>' || chr(10) || CASE WHEN datatype IS NULL THEN '      <uri>' || value || '</uri>' ELSE '      <typedLiteral datatype=\"' || datatype || '\">' || value || '</typedLiteral>' END || chr(10) || '    </triple>' || chr(10) || '  </graph>'"


@query(_render_sql(_TRIX, "nation", "region"))
def render_trix(spark, sf_dir):
    return render(statements(spark, sf_dir, "nation", "region"), "trix-triples", keep=("subject", "predicate"), name="line")


def _with_languages(spark, sf_dir) -> DataFrame:
    """Nations and suppliers in graphs, the names of nations as texts in a language."""
    df = statements(spark, sf_dir, "nation", "supplier")
    named = F.col("predicate") == NS + "n_name"
    return maps.changed(
        df,
        datatype=F.when(named, LANG_STRING).otherwise(F.col("datatype")),
        language=F.when(named, "en"),
        context=F.concat(F.lit("http://ex.org/graph/"), "dataset"),
    )


_LANGUAGES_SQL = f"SELECT subject, predicate, value, CASE WHEN predicate = '{NS}n_name' THEN '{LANG_STRING}' ELSE datatype END AS datatype, CASE WHEN predicate = '{NS}n_name' THEN 'en' END AS language, 'http://ex.org/graph/' || dataset AS context FROM ({statements_sql('nation', 'supplier')})"
_TRIX_QUAD = _TRIX.replace("ELSE '      <typed", f"WHEN datatype = '{LANG_STRING}' THEN '      <plainLiteral xml:lang=\"en\">' || value || '</plainLiteral>' ELSE '      <typed")
_TRIX_QUAD = _TRIX_QUAD.replace("'    <triple>'", "'    <uri>' || context || '</uri>' || chr(10) || '    <triple>'")


@query(f"SELECT subject, predicate, {_TRIX_QUAD} AS line FROM ({_LANGUAGES_SQL})")
def render_trix_quads(spark, sf_dir):
    return render(_with_languages(spark, sf_dir), "trix-quads", keep=("subject", "predicate"), name="line")


_TERSE_QUAD = "'<' || subject || '> <' || predicate || '> ' || CASE WHEN datatype IS NULL THEN '<' || value || '> ' WHEN language IS NOT NULL THEN '\"' || value || '\"@' || language || ' ' WHEN datatype = '{xsd}string' THEN '\"' || value || '\" ' ELSE '\"' || value || '\"^^<' || datatype || '> ' END || '<' || context || '> .'".replace("{xsd}", XSD)


@query(f"SELECT subject, predicate, {_TERSE_QUAD} AS line FROM ({_LANGUAGES_SQL})")
def render_languages(spark, sf_dir):
    return render(_with_languages(spark, sf_dir), "n-quads", keep=("subject", "predicate"), name="line")


_J = lambda x: f"'\"' || replace({x}, '/', '\\/') || '\"'"
_JSON = f"'{{' || {_J('subject')} || ' : {{ ' || {_J('predicate')} || CASE WHEN datatype IS NULL THEN ' : [ {{ \"value\" : ' || {_J('value')} || ', \"type\" : \"uri\" }} ]' ELSE ': [ {{ \"value\" : ' || {_J('value')} || ', \"type\" : \"literal\", \"datatype\" : ' || {_J('datatype')} || ' }} ] ' END || ' }} }},'"


@query(_render_sql(_JSON, "nation", "region"))
def render_rdfjson(spark, sf_dir):
    return render(statements(spark, sf_dir, "nation", "region"), "rdf-json", keep=("subject", "predicate"), name="line")


@query("SELECT n_name AS name, lower(n_name) || '_set' AS dataset, n_nationkey::BIGINT AS size, 'n-triples' AS serialization, 2::BIGINT AS n_traits FROM nation")
def header_fields(spark, sf_dir):
    line = F.concat(F.lit("# dataset:"), F.lower("n_name"), F.lit("_set   size:"), F.col("n_nationkey").cast("string"), F.lit("   serialization:n-triples   started:2024-01-02T03:04:05Z   traits:subject-sorted,distinct,"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), headers.header_fields(line).alias("h")).select("name", "h.dataset", "h.size", "h.serialization", F.size("h.traits").cast("long").alias("n_traits"))


# --- filters and maps -------------------------------------------------------------------------


@query(f"SELECT {_FIVE} FROM ({statements_sql('orders')}) WHERE predicate IN ('{NS}o_orderstatus', '{NS}o_orderpriority') AND value IN ('F', '1-URGENT')")
def filter_terms(spark, sf_dir):
    return filters.matching(statements(spark, sf_dir, "orders"), predicate=f"{NS}o_orderstatus, {NS}o_orderpriority", value=["F", "1-URGENT"]).drop("dataset", "context")


@query(f"SELECT subject, predicate, value, CASE WHEN predicate = '{NS}o_custkey' THEN NULL ELSE 'http://ex.org/graph/' || right(subject, 1) END AS context FROM ({statements_sql('orders')}) WHERE predicate = '{NS}o_custkey' OR right(subject, 1) IN ('1', '7')")
def filter_graph_null_pass(spark, sf_dir):
    df = maps.changed(statements(spark, sf_dir, "orders"), context=F.when(F.col("predicate") != NS + "o_custkey", F.concat(F.lit("http://ex.org/graph/"), F.right("subject", F.lit(1)))))
    return filters.matching(df, graph=["http://ex.org/graph/1", "http://ex.org/graph/7"]).select("subject", "predicate", "value", "context")


@query(f"SELECT dataset, count(*) AS n FROM ({statements_sql('nation', 'region', 'supplier')}) WHERE dataset = 'nation' GROUP BY dataset")
def filter_dataset(spark, sf_dir):
    return filters.matching(statements(spark, sf_dir, "nation", "region", "supplier"), dataset="nation").groupBy("dataset").agg(F.count("*").alias("n"))


@query(f"SELECT subject, predicate FROM ({statements_sql('supplier', 'part')}) WHERE datatype IS NULL")
def object_predicates(spark, sf_dir):
    return statements(spark, sf_dir, "supplier", "part").filter(has_object_predicate()).select("subject", "predicate")


@query(f"SELECT subject, predicate, CASE WHEN datatype IS NULL THEN 'iri' ELSE 'literal' END AS kind, value, datatype, language FROM ({_LANGUAGES_SQL})")
def typed_objects(spark, sf_dir):
    return _with_languages(spark, sf_dir).select("subject", "predicate", typed_object().alias("o")).select("subject", "predicate", "o.*")


@query("""SELECT 'http://ex.org/orders/' || o_orderkey AS subject, 'http://ex.org/ns#placed_by' AS predicate, 'http://ex.org/customer/' || o_custkey AS value FROM orders
UNION ALL SELECT 'http://ex.org/customer/' || o_custkey, 'http://ex.org/ns#placed', 'http://ex.org/orders/' || o_orderkey FROM orders""")
def map_statements(spark, sf_dir):
    df = statements(spark, sf_dir, "orders")
    link = F.col("predicate") == NS + "o_custkey"
    both = [F.when(link, statement(F.col("subject"), NS + "placed_by", F.col("value"))), F.when(link, statement(F.col("value"), NS + "placed", F.col("subject")))]
    return maps.map_statements(df, both).select("subject", "predicate", "value")


@query("SELECT 'http://ex.org/nation/' || n_nationkey AS subject, 'http://ex.org/ns#summary' AS predicate, count(c_custkey) || ' customers' AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def map_groups(spark, sf_dir):
    lead = statements(spark, sf_dir, "nation")
    links = statements(spark, sf_dir, "customer").filter(F.col("predicate") == NS + "c_nationkey").select(F.col("value").alias("subject"), "predicate", F.col("subject").alias("value"))

    def summary(pdf):
        first = {c: None for c in FIELDS} | {"subject": pdf["subject"].iloc[0], "predicate": NS + "summary", "value": f"{int((pdf['_source'] == 1).sum())} customers", "datatype": XSD_STRING}
        return type(pdf)([first], columns=list(FIELDS))

    rows = merges.merge_lead(lead, links.select(*(F.col(c) if c in links.columns else F.lit(None).cast("string").alias(c) for c in FIELDS)))
    return maps.map_groups(rows, "subject", summary).select("subject", "predicate", "value")


@query(
    """SELECT 'http://ex.org/nation/' || coalesce(n_nationkey, c_nationkey) AS subject, count(DISTINCT c_custkey) || ' of ' || count(DISTINCT s_suppkey) AS value
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE c_custkey IS NOT NULL OR s_suppkey IS NOT NULL GROUP BY coalesce(n_nationkey, c_nationkey)"""
)
def map_kway_groups(spark, sf_dir):
    """A function over the groups of a full merge: customers and suppliers by nation."""

    def links(name: str, key: str) -> DataFrame:
        df = statements(spark, sf_dir, name).filter(F.col("predicate") == NS + key)
        return maps.changed(df, subject=F.col("value"), value=F.col("subject"))

    def counted(pdf):
        n = [int((pdf["_source"] == i).sum()) for i in (0, 1)]
        first = {c: None for c in FIELDS} | {"subject": pdf["subject"].iloc[0], "predicate": NS + "counts", "value": f"{n[0]} of {n[1]}", "datatype": XSD_STRING}
        return type(pdf)([first], columns=list(FIELDS))

    rows = merges.merge_all(links("customer", "c_nationkey"), links("supplier", "s_nationkey"))
    return maps.map_groups(rows, "subject", counted).select("subject", "value")


# --- sorts, groups, merges, sets --------------------------------------------------------------


@query(f"SELECT {_FIVE}, row_number() OVER (ORDER BY subject, predicate, value, datatype NULLS FIRST) AS rank FROM ({statements_sql('customer', 'supplier')})")
def sort_subject_rank(spark, sf_dir):
    return sorts.numbered(statements(spark, sf_dir, "customer", "supplier").drop("dataset", "context"), ["subject", "predicate", "value", "datatype"])


@query(f"SELECT {_FIVE}, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({statements_sql('nation', 'part', 'region')})")
def sort_full_rank(spark, sf_dir):
    return sorts.numbered(sorts.sort_fully(statements(spark, sf_dir, "nation", "part", "region").drop("dataset", "context")), list(sorts.IDENTITY))


@query(f"SELECT value, subject, row_number() OVER (ORDER BY value, subject, predicate) AS rank FROM ({statements_sql('part')})")
def sort_value_rank(spark, sf_dir):
    return sorts.numbered(statements(spark, sf_dir, "part").select("value", "subject", "predicate"), ["value", "subject", "predicate"]).drop("predicate")


@query("SELECT f.n_nationkey AS a, t.n_nationkey AS b, CASE WHEN f.n_name = t.n_name THEN 0 WHEN f.n_name < t.n_name THEN -1 ELSE 1 END AS c FROM nation f JOIN nation t ON f.n_regionkey = t.n_regionkey")
def compare_keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    f, t = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return f.join(t, "n_regionkey").select("a", "b", sorts.compare(F.col("x"), F.col("y")).alias("c"))


@query("SELECT 'http://ex.org/orders/' || l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def group_sorted_size(spark, sf_dir):
    return groups.sizes(filters.matching(statements(spark, sf_dir, "lineitem"), predicate=NS + "l_orderkey"), "value")


@query(f"SELECT predicate AS key, count(*) AS n, string_agg(subject, ',' ORDER BY subject) AS subjects FROM ({statements_sql('nation', 'region')}) GROUP BY predicate")
def group_lists(spark, sf_dir):
    rows = statements(spark, sf_dir, "nation", "region").drop("context")
    return groups.groups(rows, "predicate").select("key", "n", F.array_join(F.array_sort(F.transform("statements", lambda s: s["subject"])), ",").alias("subjects"))


@query(f"SELECT {_FIVE} FROM ({statements_sql('supplier')}) WHERE subject = 'http://ex.org/supplier/7'")
def group_one(spark, sf_dir):
    return groups.group_of(statements(spark, sf_dir, "supplier"), "subject", "http://ex.org/supplier/7").drop("dataset", "context")


_RUNS = """
WITH m AS (SELECT ts, event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT event_type, sum(fresh) OVER (ORDER BY ts, event_id) AS run FROM m)
SELECT 1 AS log, CAST(run AS BIGINT) AS run, min(event_type) AS key, count(*) AS n FROM r GROUP BY run"""


@query(_RUNS)
def group_runs(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.date_trunc("HOUR", "ts").alias("hour"), F.lit(1).alias("log"))
    return groups.run_groups(log, "event_type", ("ts", "event_id"), ("log", "hour"), ("log",))


@query("WITH m AS (SELECT event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events) SELECT 1 AS log, CAST(count(*) FILTER (event_type < p) AS BIGINT) AS descents FROM m")
def order_descents(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.date_trunc("HOUR", "ts").alias("hour"), F.lit(1).alias("log"))
    return groups.descents(log, "event_type", ("ts", "event_id"), ("log", "hour"), ("log",))


@query(f"SELECT substr(subject, {len(BASE) + 11}, 1) AS next, count(*) AS n FROM ({statements_sql('customer')}) GROUP BY 1")
def prefix_histogram(spark, sf_dir):
    return groups.next_characters(statements(spark, sf_dir, "customer"), "subject", f"{BASE}/customer/")


@query(f"WITH b AS (SELECT predicate AS p, count(*) AS n FROM ({statements_sql('customer', 'nation', 'part')}) GROUP BY 1) SELECT count(*) AS buckets, CAST(sum(n) AS BIGINT) AS n_rows, avg(n) AS mean_size, (SELECT p FROM b ORDER BY n DESC, p LIMIT 1) AS largest, max(n) AS largest_size FROM b")
def bucket_statistics(spark, sf_dir):
    return groups.bucket_statistics(statements(spark, sf_dir, "customer", "nation", "part"), "predicate")


def _order_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, the statements of their lines under the orders' subjects, and customers, whose subjects orders have not."""
    lines = statements(spark, sf_dir, "lineitem")
    order = F.substring_index(F.substring("subject", len(f"{BASE}/lineitem/") + 1, 1 << 30), "/", 1)
    lines = maps.changed(lines, subject=F.concat(F.lit(f"{BASE}/orders/"), order))
    return statements(spark, sf_dir, "orders"), lines, statements(spark, sf_dir, "customer")


_ORDER_SOURCES = f"""s AS (SELECT 0 AS i, subject AS key FROM ({statements_sql('orders')})
UNION ALL SELECT 1, '{BASE}/orders/' || split_part(subject, '/', 5) FROM ({statements_sql('lineitem')})
UNION ALL SELECT 2, subject FROM ({statements_sql('customer')}))"""
_ORDER_COUNTS = "SELECT key, count(*) FILTER (i = 0) AS n0, count(*) FILTER (i = 1) AS n1, count(*) FILTER (i = 2) AS n2 FROM s GROUP BY key"


@query(f"WITH {_ORDER_SOURCES} SELECT * FROM ({_ORDER_COUNTS}) WHERE n0 > 0")
def merge_lead(spark, sf_dir):
    return merges.group_sizes(merges.tagged(*_order_sources(spark, sf_dir)), 3, lead_only=True)


@query(f"WITH {_ORDER_SOURCES} SELECT CAST(i AS INT) AS _source, count(*) AS n FROM s WHERE key IN (SELECT key FROM s WHERE i = 0) GROUP BY i")
def merge_lead_rows(spark, sf_dir):
    return merges.merge_lead(*_order_sources(spark, sf_dir)).groupBy("_source").agg(F.count("*").alias("n"))


@query(f"WITH {_ORDER_SOURCES} {_ORDER_COUNTS}")
def merge_kway(spark, sf_dir):
    return merges.group_sizes(merges.merge_all(*_order_sources(spark, sf_dir)), 3)


@query("SELECT DISTINCT 'http://ex.org/user/' || user_id AS subject, 'http://ex.org/ns#did' AS predicate, event_type AS value FROM events")
def dedup_global(spark, sf_dir):
    return sets.distinct(_did(spark, sf_dir), ("_seq",)).select("subject", "predicate", "value")


def _did(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(statement(iri("user", "user_id"), NS + "did", F.col("event_type"), XSD_STRING).alias("s"), F.col("event_id").alias("_seq"), F.floor(F.col("event_id") / 100).alias("batch")).select("s.*", "_seq", "batch")


@query("SELECT event_id // 100 AS batch, 'http://ex.org/user/' || user_id AS subject, event_type AS value, min(event_id) AS first_id FROM events GROUP BY ALL")
def dedup_batch(spark, sf_dir):
    return sets.distinct(_did(spark, sf_dir), ("_seq",), within=("batch",)).select("batch", "subject", "value", F.col("_seq").alias("first_id"))


@query(f"SELECT dataset, count(*) AS n FROM ({statements_sql('nation', 'region')} UNION ALL {statements_sql('region')}) GROUP BY dataset")
def union_all(spark, sf_dir):
    return sets.union(statements(spark, sf_dir, "nation", "region"), statements(spark, sf_dir, "region")).groupBy("dataset").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN predicate IN ('{NS}p_name', '{NS}s_name') THEN 'names' ELSE 'uns1-' || substr(predicate, {len(NS) + 1}) END AS dataset, count(*) AS n FROM ({statements_sql('part', 'supplier')}) GROUP BY 1")
def split_by_predicate(spark, sf_dir):
    df = statements(spark, sf_dir, "part", "supplier").drop("dataset")
    return split_names(df, {"names": [NS + "p_name", NS + "s_name"]}).groupBy("dataset").agg(F.count("*").alias("n"))


# --- entity documents -------------------------------------------------------------------------


def _star_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = lambda i, pred, value, dt=XSD_STRING: F.struct(F.lit(i).cast("long").alias("_seq"), statement(iri("part", "p_partkey"), pred, value, dt).alias("s"))
    made = F.array(s(0, star.LABEL, F.col("p_name")), s(1, star.LABEL, F.concat("p_brand", F.lit(" "), "p_name")), s(2, star.TYPE, F.concat(F.lit(f"{BASE}/type/"), "p_type"), None), s(3, star.COMMENT, F.concat(F.lit("size "), F.col("p_size").cast("string"))), s(4, star.RANK, F.col("p_size").cast("string"), XSD + "integer"), s(5, star.SUBJECT, F.concat(F.lit(f"{BASE}/Category:"), F.replace("p_brand", F.lit("#"), F.lit("_"))), None), s(6, star.NICK, F.col("p_name")))
    return p.select(F.explode(made).alias("r")).select("r._seq", "r.s.*").withColumn("_source", F.lit(0))


@query(f"""SELECT '{BASE}/part/' || p_partkey AS id, CAST(p_partkey AS VARCHAR) AS title, p_name AS label, 'size ' || p_size AS comment, CAST(p_size AS DOUBLE) AS pagerank,
'{BASE}/type/' || p_type AS types, p_brand || ' ' || p_name || '|' || p_name AS alt_labels, replace(replace(p_brand, '#', '_'), '_', ' ') AS subjects FROM part""")
def star_entity(spark, sf_dir):
    docs = star.entity_documents(_star_rows(spark, sf_dir), star.StarRules(resource_base=f"{BASE}/part/", ontology_base=f"{BASE}/ontology/"))
    return docs.select("id", "title", "label", "comment", F.col("pagerank").cast("double").alias("pagerank"), F.array_join("type_uri", "|").alias("types"), F.array_join("alt_label", "|").alias("alt_labels"), F.array_join("subjects_text", "|").alias("subjects"))


def _links(spark, sf_dir) -> DataFrame:
    """Customers as redirects to their nations."""
    return filters.matching(statements(spark, sf_dir, "customer"), predicate=NS + "c_nationkey")


@query("SELECT 'http://ex.org/nation/' || n_nationkey AS id, string_agg('http://ex.org/customer/' || c_custkey, ',' ORDER BY 'http://ex.org/customer/' || c_custkey) AS redirects FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def attach_redirect(spark, sf_dir):
    entities = table(spark, sf_dir, "nation").select(iri("nation", "n_nationkey").alias("id"))
    return merges.attach(entities, _links(spark, sf_dir), "redirects").select("id", F.array_join("redirects", ",").alias("redirects"))


@query("SELECT 'http://ex.org/customer/' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_redirect(spark, sf_dir):
    """Customers without an urgent order."""
    entities = table(spark, sf_dir, "customer").select(iri("customer", "c_custkey").alias("id"))
    links = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(iri("customer", "o_custkey").alias("subject"))
    return merges.drop_linked(entities, links)


def _suppliers(spark, sf_dir, condition: str = "true", suffix: str = "") -> DataFrame:
    return table(spark, sf_dir, "supplier").filter(condition).select(F.col("s_suppkey").cast("string").alias("id"), F.concat("s_name", F.lit(suffix)).alias("name"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_acctbal >= 5000
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name || ' new' FROM supplier WHERE s_acctbal < 5000""")
def upsert_docs(spark, sf_dir):
    """Suppliers of a balance of 2500 or more are stored; those of less than 5000 come anew, some of them for the first time."""
    stored = _suppliers(spark, sf_dir, "s_acctbal >= 2500")
    return documents.upsert(stored, _suppliers(spark, sf_dir, "s_acctbal < 5000", " new"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_acctbal >= 0 AND NOT contains(s_name, '7')")
def delete_docs(spark, sf_dir):
    """Suppliers without debt whose name holds no 7."""
    docs = documents.delete_ids(_suppliers(spark, sf_dir), _suppliers(spark, sf_dir, "s_acctbal < 0").select("id"))
    return documents.delete_where(docs, F.contains("name", F.lit("7")))


@query("SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, sum(strlen(text)) <= 32766 AS kept FROM conversations GROUP BY conv_id")
def field_size(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("text"))
    schema = documents.DocumentSchema([documents.Field("conv_id", "long"), documents.Field("text", "string", multi_valued=True)])
    return docs.select("conv_id", documents.field_bytes(F.col("text")).alias("n_bytes")).join(documents.checked(docs, schema).select("conv_id", F.col("text").isNotNull().alias("kept")), "conv_id")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_children, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS children FROM region")
def child_documents(spark, sf_dir):
    parents = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"))
    children = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("parent"))
    out = documents.with_children(parents, children, "parent")
    return out.select("id", F.size("children").cast("long").alias("n_children"), F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("children"))


@query("SELECT 'http://ex.org/nation/' || n_nationkey AS start, 'http://ex.org/region/' || n_regionkey AS id, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
def annotation_lookup(spark, sf_dir):
    notes = table(spark, sf_dir, "nation").select(iri("nation", "n_nationkey").alias("start"), F.array(iri("region", "n_regionkey")).alias("ids"))
    docs = table(spark, sf_dir, "region").select(iri("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return merges.lookup(notes, docs).select("start", F.explode("documents").alias("d")).select("start", "d.id", "d.name")


# --- search -----------------------------------------------------------------------------------

_TERMS = ("the", "une", "der")
_BM25 = " + ".join(f"CASE WHEN t{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END" for i in range(3))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\W+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS len, {', '.join(f"len(list_filter(t, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(sorted(_TERMS)))} FROM w),
s AS (SELECT count(*) AS n, avg(len) AS mean, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(3))} FROM c)
SELECT doc_id AS id, round({_BM25}, 6) AS score FROM c, s WHERE t0 + t1 + t2 > 0""")
def bm25(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), _TERMS, "doc_id").select("id", F.round("score", 6).alias("score"))


@query("SELECT page_id AS id FROM pages WHERE contains(html, '<title>') AND contains(url, '/fr/') ORDER BY page_id LIMIT 10000")
def find_documents(spark, sf_dir):
    return search.find(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html"), F.contains("html", F.lit("<title>")), [F.contains("url", F.lit("/fr/"))]).select("id")


@query("""WITH d AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z0-9_]+')) AS label FROM benchmark),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'))) AS word FROM documents)
SELECT doc_id, word AS label, count(*) AS n FROM w JOIN d ON word = label WHERE label <> '' GROUP BY 1, 2""")
def tag_entities(spark, sf_dir):
    dictionary = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract("text", "[A-Za-z0-9_]+", 0).alias("label"))
    tags = search.tag(table(spark, sf_dir, "documents"), dictionary, "doc_id", most=1 << 30)
    return tags.groupBy(F.col("id").alias("doc_id"), F.lower("match_text").alias("label")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT lower(array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1, 3), ' ')) AS label FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS words FROM documents)),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS phrase FROM w)
SELECT doc_id, label, count(*) AS n FROM g JOIN d ON phrase = label GROUP BY 1, 2""")
def tag_phrases(spark, sf_dir):
    """Labels of three words, as they begin the benchmark's texts."""
    words = F.slice(F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda w: w != ""), 1, 3)
    dictionary = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_join(words, " ").alias("label"))
    tags = search.tag(table(spark, sf_dir, "documents"), dictionary, "doc_id", most=1 << 30)
    return tags.groupBy(F.col("id").alias("doc_id"), search.phrase("match_text").alias("label")).agg(F.count("*").alias("n"))


# --- files ------------------------------------------------------------------------------------


def _through_file(spark, sf_dir, fmt: str, suffix: str, *names: str) -> DataFrame:
    """Statements written to one file and read back."""
    path = f"{shared_dir(spark)}/starloom-core/{uuid.uuid4().hex}.{suffix}"
    write_file(statements(spark, sf_dir, *names), path, fmt)
    return read_statements(spark, path).select("subject", "predicate", "value", "datatype")


@query(f"SELECT subject, predicate, value, datatype FROM ({statements_sql('customer')})")
def file_ntriples_gzip(spark, sf_dir):
    return _through_file(spark, sf_dir, "n-triples", "nt.gz", "customer")


@query(f"SELECT subject, predicate, value, datatype FROM ({statements_sql('part', 'supplier')})")
def file_nquads_bzip2(spark, sf_dir):
    return _through_file(spark, sf_dir, "n-quads", "nq.bz2", "part", "supplier")


@query(f"SELECT subject, predicate, value, datatype FROM ({statements_sql('supplier', 'customer')})")
def file_append(spark, sf_dir):
    """Two writes to one compressed file, the second after what the first left."""
    path = f"{shared_dir(spark)}/starloom-core/{uuid.uuid4().hex}.nt.gz"
    for name in ("supplier", "customer"):
        FileSink(path, append=True).write(statements(spark, sf_dir, name))
    return read_statements(spark, path).select("subject", "predicate", "value", "datatype")


@query(f"SELECT format, subject, predicate, value, datatype FROM ({statements_sql('nation', 'supplier')}), (VALUES ('nt'), ('nq')) AS f(format)")
def sink_group(spark, sf_dir):
    """The same statements to two sinks, each read back."""
    at = {k: f"{shared_dir(spark)}/starloom-core/{uuid.uuid4().hex}.{k}.bz2" for k in ("nt", "nq")}
    sinks = SinkGroup((FileSink(at["nt"], "n-triples"), FileSink(at["nq"], "n-quads")))
    sinks.write(statements(spark, sf_dir, "nation", "supplier"))
    read = [read_statements(spark, path).withColumn("format", F.lit(k)) for k, path in at.items()]
    return read[0].unionByName(read[1]).select("format", "subject", "predicate", "value", "datatype")


# --- scalar functions -------------------------------------------------------------------------


def _function(name: str, source: str, key: str, make: Callable[[], Column], sql: str) -> None:
    """A query of one function over a table's column: key and out."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(F.col(key), make().alias("out"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS out FROM {source}")(run)


_function("fn_md5", "documents", "doc_id", lambda: tx.md5_hex("text"), "md5(text)")
_function("fn_hex", "lineitem", "l_orderkey", lambda: tx.to_hex(F.col("l_partkey") * 7919, 6), "right(lpad(printf('%X', l_partkey * 7919), 16, '0'), 6)")
_function("fn_from_hex", "part", "p_partkey", lambda: tx.from_hex(tx.to_hex(F.col("p_partkey") * -9_999_991, 8)), "CAST(((p_partkey * -9999991) + 2147483648) % 4294967296 - 2147483648 + CASE WHEN ((p_partkey * -9999991) + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END AS INTEGER)")
_function("fn_pretty_millis", "events", "event_id", lambda: tx.pretty_millis(F.col("event_id") * 7001), "lpad(CAST(event_id * 7001 // 60000 AS VARCHAR), CAST(greatest(2, length(CAST(event_id * 7001 // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(event_id * 7001 % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id * 7001 % 1000 AS VARCHAR), 3, '0') || 's'")
_function("fn_format_timestamp", "events", "event_id", lambda: tx.format_timestamp(F.col("event_id") * 86_399_017), "strftime(make_timestamp(event_id * 86399017 * 1000), '%Y-%m-%dT%H:%M:%SZ')")
_function("fn_parse_timestamp", "events", "event_id", lambda: tx.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "epoch_ms(date_trunc('second', ts))")
_function("fn_clean_space", "documents", "doc_id", lambda: tx.clean_space(F.replace("text", F.lit("."), F.lit("__"))), "trim(regexp_replace(replace(replace(text, '.', '__'), '_', ' '), ' +', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))")
_function("fn_wiki_encode", "pages", "page_id", lambda: tx.wiki_encode(F.concat(F.lit("_"), F.replace("url", F.lit("/"), F.lit(" ")), F.lit("#%"))), "regexp_replace('_' || replace(replace(replace(replace(url, '/', '_'), '#', '%23'), '?', '%3F'), '[', '%5B') || '%23%25', '^_+|(_)_+', '\\1', 'g')")
_function("fn_encode_component", "pages", "page_id", lambda: tx.encode_component("url"), "replace(url_encode(url), '%7E', '~')")
_function("fn_decode_uri", "pages", "page_id", lambda: uris.decode_uri(F.url_encode("url")), "url")
_function("fn_decode_iri", "pages", "page_id", lambda: uris.decode_iri(F.replace("url", F.lit("/"), F.lit("%2F"))), "url")
_function("fn_xml", "pages", "page_id", lambda: tx.escape_xml("html"), "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
_function("fn_json", "pages", "page_id", lambda: tx.escape_json("html"), "replace(replace(replace(replace(replace(replace(html, '\\', '\\\\'), '\"', '\\\"'), '/', '\\/'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')")
_function("fn_turtle", "documents", "doc_id", lambda: tx.escape_turtle("text"), "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')")
_function("fn_turtle_ascii", "documents", "doc_id", lambda: F.length(tx.escape_turtle("text", turtle=False)).cast("long"), "length(text) + 5 * (len(regexp_extract_all(text, '[^ -~\\n\\r\\t]'))) + len(regexp_extract_all(text, '[\\\\\\\\\"\\n\\r\\t]'))")
_function("fn_unescape", "documents", "doc_id", lambda: tx.unescape_turtle(tx.escape_turtle("text", turtle=False)), "text")
_function("fn_longest_prefix", "customer", "c_custkey", lambda: tx.longest_prefix(F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string")), F.concat(F.lit("Customer#"), (F.col("c_custkey") + 9).cast("string"))), "'Customer#' || array_to_string(list_filter(list_transform(range(1, length(CAST(c_custkey AS VARCHAR)) + 1), lambda i: CASE WHEN left(CAST(c_custkey AS VARCHAR), CAST(i AS INT)) = left(CAST(c_custkey + 9 AS VARCHAR), CAST(i AS INT)) THEN substr(CAST(c_custkey AS VARCHAR), CAST(i AS INT), 1) END), lambda x: x IS NOT NULL), '')")
_function("fn_camel_case", "part", "p_partkey", lambda: tx.camel_case("p_name"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), '')")
_function("fn_capitalize", "part", "p_partkey", lambda: tx.capitalize("p_name"), "upper(left(p_name, 1)) || substr(p_name, 2)")
_function("fn_uncapitalize", "part", "p_partkey", lambda: tx.uncapitalize("p_brand"), "lower(left(p_brand, 1)) || substr(p_brand, 2)")
_function("fn_replace_chars", "part", "p_partkey", lambda: tx.replace_chars("p_name", "aeiou", "AE"), "translate(p_name, 'aeiou', 'AE')")
_function("fn_escape_chars", "part", "p_partkey", lambda: tx.escape_chars("p_brand"), "replace(p_brand, '#', '%23')")
_function("fn_trim_split", "part", "p_partkey", lambda: F.array_join(tx.trim_split(F.concat(F.lit(" , "), "p_name", F.lit(",,"), "p_type")), "|"), "replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|')")
_function("fn_remove_emphasis", "part", "p_partkey", lambda: tx.remove_emphasis(F.concat(F.lit("'''"), "p_name", F.lit("''' ''"), "p_type", F.lit("'' '''''x'''''"))), "p_name || ' ' || p_type || ' x'")
_function("fn_int_literal", "part", "p_partkey", lambda: tx.int_literal(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("p_name")), "CASE WHEN p_size % 2 = 0 THEN p_size END")
_function("fn_boolean_literal", "part", "p_partkey", lambda: tx.boolean_literal(F.when(F.col("p_size") % 3 == 0, "TRUE").when(F.col("p_size") % 3 == 1, "false").otherwise("yes")), "CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_function("fn_known_scheme", "pages", "page_id", lambda: uris.has_known_scheme(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("x"), "url"))), "page_id % 2 = 0")
_function("fn_clean_link", "pages", "page_id", lambda: uris.clean_link(F.replace("url", F.lit(".com/"), F.lit(".com/a/../"))), "url")
_function("fn_relativize", "pages", "page_id", lambda: uris.relativize(F.regexp_extract("url", r"\Ahttps?://[^/]*", 0), "url"), "regexp_replace(url, '^https?://[^/]*/', '')")
_function("fn_create_uri", "pages", "page_id", lambda: uris.create_uri(F.url_encode("url")), "url")
_function("fn_resource_uri", "customer", "c_custkey", lambda: uris.resource_uri(F.concat(F.lit(f"{BASE}/resource/"), F.replace("c_name", F.lit("#"), F.lit(" 100% ")), F.lit("%2341")), f"{BASE}/resource/"), f"'{BASE}/resource/' || replace(c_name, '#', '_100%25_') || '%2341'")
_function("fn_uri_to_iri", "customer", "c_custkey", lambda: uris.uri_to_iri(F.concat(F.lit(f"{BASE}/resource/%C3%89"), F.col("c_custkey").cast("string")), f"{BASE}/resource/"), f"'{BASE}/resource/É' || c_custkey")
_function("fn_wiki_decode", "customer", "c_custkey", lambda: uris.wiki_decode(F.concat(F.lit("_%C3%89mile__Zola_"), F.col("c_custkey").cast("string"))), "'Émile Zola ' || c_custkey")
_function("fn_full_iri", "part", "p_partkey", lambda: Namespaces().full_iri(F.concat(F.element_at(F.array(F.lit("foaf:"), F.lit("nope:"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")), "p_name"), NS), f"CASE p_partkey % 3 WHEN 0 THEN 'http://xmlns.com/foaf/0.1/' WHEN 1 THEN '{NS}nope:' ELSE '{NS}' END || replace(p_name, ' ', '%20')")
_function("fn_validated", "part", "p_partkey", lambda: Namespaces().validated(F.element_at(F.array(F.lit("foaf:a"), F.lit("schema:a"), F.lit("nope:a")), (F.col("p_partkey") % 3 + 1).cast("int"))), "p_partkey % 3 = 0")
