"""Relational tables as statements, in Spark and as the SQL that says the same.

A row of a table is a subject; each of its other columns gives one statement, a foreign key
an IRI and anything else a typed literal. Null values give no statement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.schema import FIELDS
from starloom.shared import spread

BASE, NS = "http://ex.org", "http://ex.org/ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: Key expression and columns of each table: `iri:<table>`, string, integer or decimal.
TABLES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "region": (("r_regionkey",), {"r_name": "string"}),
    "nation": (("n_nationkey",), {"n_name": "string", "n_regionkey": "iri:region"}),
    "customer": (("c_custkey",), {"c_name": "string", "c_nationkey": "iri:nation", "c_acctbal": "decimal", "c_mktsegment": "string"}),
    "supplier": (("s_suppkey",), {"s_name": "string", "s_nationkey": "iri:nation", "s_acctbal": "decimal"}),
    "part": (("p_partkey",), {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "decimal"}),
    "orders": (("o_orderkey",), {"o_custkey": "iri:customer", "o_orderstatus": "string", "o_totalprice": "decimal", "o_orderpriority": "string"}),
    "lineitem": (("l_orderkey", "l_linenumber"), {"l_orderkey": "iri:orders", "l_partkey": "iri:part", "l_suppkey": "iri:supplier", "l_quantity": "decimal", "l_returnflag": "string"}),
    "events": (("event_id",), {"user_id": "iri:user", "event_type": "string", "value": "decimal"}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores where it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def iri(name: str, *keys: str | Column) -> Column:
    cols = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.concat(F.lit(f"{BASE}/{name}/"), F.concat_ws("/", *cols))


def statements(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The statements of the tables, with the table's name as dataset.

    A row is multiplied by the numbers of its columns that are not null; predicates and values
    follow from the number, so that what a plan does not ask for is never made.
    """
    out = None
    for name in names:
        keys, cols = TABLES[name]
        present = [F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(cols)]
        rows = table(spark, sf_dir, name).select(iri(name, *keys).alias("subject"), *cols)
        rows = rows.select("subject", *cols, F.explode(F.array(*present)).alias("_i")).filter("_i IS NOT NULL")

        def chosen(parts: list[Column]) -> Column:
            return reduce(lambda c, p: c.when(F.col("_i") == p[0], p[1]), enumerate(parts[1:], 1), F.when(F.col("_i") == 0, parts[0]))

        values = [iri(kind[4:], c) if kind.startswith("iri:") else (F.col(c).cast("decimal(18,2)") if kind == "decimal" else F.col(c)).cast("string") for c, kind in cols.items()]
        datatypes = [F.lit(None if kind.startswith("iri:") else XSD + kind).cast("string") for kind in cols.values()]
        fields = {"dataset": F.lit(name), "subject": F.col("subject"), "predicate": chosen([F.lit(NS + c) for c in cols]), "value": chosen(values), "datatype": chosen(datatypes)}
        one = rows.select(*(fields.get(c, F.lit(None).cast("string")).alias(c) for c in FIELDS))
        out = one if out is None else out.unionByName(one)
    return out


def statements_sql(*names: str) -> str:
    """The same as SQL: a union over tables and columns."""
    parts = []
    for name in names:
        keys, cols = TABLES[name]
        subject = f"'{BASE}/{name}/' || " + " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        for c, kind in cols.items():
            if kind.startswith("iri:"):
                value, datatype = f"'{BASE}/{kind[4:]}/' || CAST({c} AS VARCHAR)", "CAST(NULL AS VARCHAR)"
            else:
                inner = f"CAST({c} AS DECIMAL(18,2))" if kind == "decimal" else c
                value, datatype = f"CAST({inner} AS VARCHAR)", f"'{XSD}{kind}'"
            parts.append(f"SELECT '{name}' AS dataset, {subject} AS subject, '{NS}{c}' AS predicate, {value} AS value, {datatype} AS datatype, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS VARCHAR) AS context FROM {name} WHERE {c} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)
