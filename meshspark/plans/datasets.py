"""Graphs derived from the order tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import Graph

LEAD = """SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
  l_quantity AS q FROM lineitem"""
#: name -> (vertices, edges) over the tables.
SQL = {
    "g_part": ("SELECT p_partkey AS id FROM part", f"SELECT src, dst, CAST(min(q) AS BIGINT) AS w FROM ({LEAD}) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst"),
    "g_frag": ("SELECT p_partkey AS id FROM part", f"SELECT src, dst, CAST(min(q) AS BIGINT) AS w FROM ({LEAD}) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst HAVING min(q) >= 48"),
    # neighbours in id order, but for jumps: deep searches that mostly stay near
    "g_next": (
        "SELECT o_orderkey AS id FROM orders",
        """SELECT o_orderkey AS src, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey + 1 ELSE (o_orderkey * 7919 + 13) % (SELECT count(*) FROM orders) END AS dst,
  CAST(floor(o_totalprice) AS BIGINT) % 50 + 1 AS w FROM orders WHERE (o_orderpriority <> '1-URGENT' AND o_orderkey + 1 < (SELECT count(*) FROM orders)) OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
    ),
    "g_sc": (
        "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT c_custkey + (SELECT count(*) FROM supplier) FROM customer",
        "SELECT l_suppkey AS src, o_custkey + (SELECT count(*) FROM supplier) AS dst, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    ),
}


def load(spark: SparkSession, sf_dir: str, name: str, saved: bool = True) -> Graph:
    """The named graph, ``saved`` to the shared folder where many supersteps read it, else as a plan over the tables."""
    made = {}
    for table in ("part", "supplier", "customer", "orders", "lineitem"):
        made[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    v, e = (spark.sql(_named(q, made), **{t: df for t, df in made.items() if f"{{{t}}}" in _named(q, made)}) for q in SQL[name])
    return Graph(v, e).saved() if saved else Graph(v, e)


def _named(sql: str, tables: dict) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (part|supplier|customer|orders|lineitem)\b", r"\1 {\2}", sql)
