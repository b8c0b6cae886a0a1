"""Graphs from files, results to files, and bucketed tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.graph import Graph

FORMATS = ("parquet", "csv", "json")


def read_data(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A table in one of :data:`FORMATS`; CSV has a header, JSON a record per line.

    Give a ``schema`` for CSV and JSON at scale: inferring one reads the files twice.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def read_graph(
    spark: SparkSession,
    vertices: str,
    edges: str,
    fmt: str = "parquet",
    *,
    id_col: str = "id",
    src_col: str = "src",
    dst_col: str = "dst",
    weighted: bool = False,
    weight_col: str = "weight",
    symmetrize: bool = False,
    vertex_schema: T.StructType | str | None = None,
    edge_schema: T.StructType | str | None = None,
) -> Graph:
    """A graph of the mapped key columns, with the weight under its own name where ``weighted``.

    With schemas, CSV and JSON files are not read to infer any.

    Text formats infer 32-bit integers for small ids: keys of CSV are widened, other types are checked.
    """

    def key(df: DataFrame, column: str, name: str):
        narrow = fmt == "csv" and df.schema[column].dataType == T.IntegerType()
        return (F.col(column).cast("long") if narrow else F.col(column)).alias(name)

    v, e = read_data(spark, vertices, fmt, vertex_schema), read_data(spark, edges, fmt, edge_schema)
    more = [F.col(weight_col)] if weighted else []
    graph = Graph(v.select(key(v, id_col, "id")), e.select(key(e, src_col, "src"), key(e, dst_col, "dst"), *more))
    return graph.symmetrize() if symmetrize else graph


def write_result(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a result as parquet."""
    df.write.mode(mode).parquet(path)


def read_delimited_graph(spark: SparkSession, vertices: str, edges: str, weighted: bool = False) -> Graph:
    """A graph from space-delimited files without header: ids, and sources with destinations [and weights]."""
    fields = "src long, dst long" + (", weights double" if weighted else "")
    v = spark.read.csv(vertices, sep=" ", header=False, schema="id long")
    return Graph(v, spark.read.csv(edges, sep=" ", header=False, schema=fields))


def parse_properties(text: str) -> dict[str, str]:
    """``key = value`` lines; empty lines and those that start with # are skipped."""
    lines = (x.strip() for x in text.splitlines())
    pairs = (re.split(r"\s*=\s*", x, maxsplit=1) for x in lines if x and not x.startswith("#"))
    return {p[0]: p[1] for p in pairs if len(p) == 2}


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Save as a table hash-partitioned and sorted by ``key``; joins and aggregates by it need no exchange."""
    # one file per bucket: rows of a bucket meet in one task first
    df.repartition(buckets, F.col(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files directly in a folder, by any Hadoop file system; none where it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []
