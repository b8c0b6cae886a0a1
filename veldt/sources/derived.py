"""Graphs derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.graph import Graph
from veldt.sources.tables import table

SUPPLIER_BASE = 1_000_000


def parts_seq(spark: SparkSession, d: str) -> Graph:
    """Parts, with an edge between consecutive large lines of an order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").filter("l_quantity >= 45").select("l_partkey", F.lead("l_partkey").over(w).alias("next"))
    edges = lines.filter("next IS NOT NULL AND l_partkey <> next").select(F.col("l_partkey").alias("src"), F.col("next").alias("dst")).distinct()
    return Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id")), edges)


def trade(spark: SparkSession, d: str, dense: bool = False) -> Graph:
    """Customers and suppliers, with an edge per pair that traded; sparse: large, discounted lines only."""
    lines = table(spark, d, "lineitem")
    if not dense:
        lines = lines.filter("l_quantity >= 49 AND l_discount >= 0.08")
    pairs = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = pairs.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst")).distinct()
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("id")))
    return Graph(ids, edges)


def event_chain(spark: SparkSession, d: str) -> Graph:
    """Events, each with an edge to the same user's next one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select("event_id", F.lead("event_id").over(w).alias("next"))
    return Graph(events.select(F.col("event_id").alias("id")), events.filter("next IS NOT NULL").select(F.col("event_id").alias("src"), F.col("next").alias("dst")))


def links(spark: SparkSession, d: str) -> Graph:
    """The edges table as a graph: every row with both ends is an edge, every end and vertex id a vertex."""
    edges = table(spark, d, "edges").filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "weight", "relation")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    ids = ends.union(table(spark, d, "vertices").filter("id IS NOT NULL").select("id")).distinct()
    return Graph(ids, edges)
