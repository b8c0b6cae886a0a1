"""Sources, sinks, derived graphs and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from veldt.cli import main, size_in_bytes
from veldt.graph import GraphSchemaError
from veldt.sources.graphs import list_files, parse_properties, read_data, read_delimited_graph, read_graph, write_bucketed, write_result


@pytest.fixture
def files(tmp_path):
    (tmp_path / "v.csv").write_text("key,name\n1,a\n2,b\n3,c\n")
    (tmp_path / "e.csv").write_text("from,to,w\n1,2,0.5\n2,3,1.5\n")
    (tmp_path / "v.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in (1, 2, 3)))
    (tmp_path / "e.json").write_text("".join(json.dumps({"src": a, "dst": b}) + "\n" for a, b in ((1, 2), (2, 3))))
    return tmp_path


def test_csv_with_mapped_columns(spark, files):
    g = read_graph(spark, f"{files}/v.csv", f"{files}/e.csv", "csv", id_col="key", src_col="from", dst_col="to", weighted=True, weight_col="w", symmetrize=True)
    assert g.vertices.columns == ["id"] and g.edges.columns == ["src", "dst", "w"] and g.num_edges() == 4


def test_json_and_parquet(spark, files):
    g = read_graph(spark, f"{files}/v.json", f"{files}/e.json", "json")
    assert g.num_nodes() == 3 and g.edges.columns == ["src", "dst"]
    write_result(g.vertices, f"{files}/pv")
    write_result(g.edges, f"{files}/pe")
    assert read_graph(spark, f"{files}/pv", f"{files}/pe").num_edges() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        write_result(g.edges, f"{files}/pe")
    narrow = g.vertices.select(F.col("id").cast("int").alias("id"))
    write_result(narrow, f"{files}/narrow")
    with pytest.raises(GraphSchemaError):
        read_graph(spark, f"{files}/narrow", f"{files}/pe")
    with pytest.raises(ValueError, match="format"):
        read_data(spark, "x", "xml")


def test_delimited_and_properties(spark, tmp_path):
    (tmp_path / "v").write_text("1\n2\n")
    (tmp_path / "e").write_text("1 2 0.5\n")
    g = read_delimited_graph(spark, f"{tmp_path}/v", f"{tmp_path}/e", weighted=True)
    assert [tuple(r) for r in g.edges.collect()] == [(1, 2, 0.5)] and g.num_nodes() == 2
    assert parse_properties("# c\na = 1\n\nb.c= x = y\n") == {"a": "1", "b.c": "x = y"}


def test_bucketed_tables_join_without_exchange(spark):
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = write_bucketed(spark.range(100).withColumn("x", F.col("id") * 2), "bucketed_a", "id", 3)
        b = write_bucketed(spark.range(50).withColumn("y", F.col("id") * 3), "bucketed_b", "id", 3)
        joined = a.join(b, "id")
        assert joined.count() == 50
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_a")
        spark.sql("DROP TABLE IF EXISTS bucketed_b")


def test_list_files(spark, files):
    assert len(list_files(spark, str(files))) == 4 and list_files(spark, f"{files}/none") == []


@pytest.mark.parametrize(("text", "want"), [("4G", 4 << 30), ("512mb", 512 << 20), ("1GiB", 1 << 30), ("7m", 7 << 20)])
def test_sizes(text, want):
    assert size_in_bytes(text) == want


@pytest.mark.parametrize("text", ["4", "G", "4T", "-1G", ""])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        size_in_bytes(text)


@pytest.mark.parametrize(("argv", "columns"), [(["page-rank", "--max-iter", "2", "--tol", "0"], ["id", "pagerank"]), (["shortest-path", "--landmark", "1"], ["id", "dist_1"]), (["kcore"], ["id", "kcore"])])
def test_command_line(spark, files, argv, columns):
    out = f"{files}/out"
    common = ["--vertices", f"{files}/v.json", "--edges", f"{files}/e.json", "--format", "json", "--output", out]
    assert main([argv[0], *common, *argv[1:]], spark) == 0
    assert spark.read.parquet(out).columns == columns and spark.read.parquet(out).count() == 3
