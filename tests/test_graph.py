"""Graph operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from veldt import Graph, GraphSchemaError
from veldt.graph import simple_arcs

HUB = [(1, i) for i in range(2, 11)] + [(2, 3), (2, 4), (2, 5), (2, 6), (3, 5), (3, 6), (3, 7), (4, 6), (4, 7), (4, 8), (5, 6), (5, 7), (5, 8), (6, 7), (6, 9), (7, 8), (7, 10), (8, 9), (8, 10), (9, 10), (10, 1)]
SQUARE = [(1, 2), (1, 3), (2, 4), (3, 4)]


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_counts(graph):
    g = graph(range(1, 11), HUB)
    assert g.num_nodes() == 10 and g.num_edges() == len(HUB)


def test_degrees(graph):
    g = graph(range(1, 11), HUB)
    ins, outs = as_dict(g.in_degrees()), as_dict(g.out_degrees())
    for i in range(1, 11):
        assert ins.get(i, 0) == sum(d == i for _, d in HUB)
        assert outs.get(i, 0) == sum(s == i for s, _ in HUB)


def test_zero_degrees(graph):
    g = graph([1, 2, 3, 4], SQUARE)
    assert as_dict(g.in_degrees(True)) == {1: 0, 2: 1, 3: 1, 4: 2}
    assert as_dict(g.out_degrees(True)) == {1: 2, 2: 1, 3: 1, 4: 0}
    assert as_dict(g.in_degrees()) == {2: 1, 3: 1, 4: 2}


def test_degrees_of_dangling_null_and_parallel_edges(graph):
    g = graph([1, 2], [(1, 2), (1, 2), (None, 2), (1, 9), (2, None)])
    assert as_dict(g.in_degrees()) == {2: 2, 9: 1, None: 1}
    assert as_dict(g.in_degrees(True)) == {1: 0, 2: 2}


def test_symmetrize_doubles(graph):
    g = graph(range(1, 11), [(*e, "x") for e in HUB], "tag string").symmetrize()
    assert g.num_edges() == 2 * len(HUB) and g.edges.columns == ["src", "dst", "tag"]
    assert as_dict(g.in_degrees()) == as_dict(g.out_degrees())


def test_symmetrize_doubles_self_loops(graph):
    assert graph([1], [(1, 1)]).symmetrize().num_edges() == 2


def test_simple_arcs(graph):
    e = graph([1, 2, 3], [(1, 2), (1, 2), (2, 1), (3, 3), (2, 3)]).edges
    assert sorted(map(tuple, simple_arcs(e).collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert simple_arcs(e, distinct=False).count() == 8


def test_triplets(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id long, attr string")
    e = spark.createDataFrame([(1, 2, "x"), (2, 9, "y")], "src long, dst long, attr string")
    t = Graph(v, e).triplets()
    assert t.columns == ["src_vertex", "edge", "dst_vertex"]
    rows = {r.edge.attr: r for r in t.collect()}
    assert rows["x"].src_vertex.attr == "a" and rows["x"].dst_vertex.attr == "b"
    assert rows["y"].dst_vertex is None and rows["y"].src_vertex.id == 2


@pytest.mark.parametrize("column", ["id", "src", "dst"])
def test_keys_must_be_long(spark, column):
    v, e = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    narrow = lambda df: df.withColumn(column, F.col(column).cast("int"))
    with pytest.raises(GraphSchemaError, match="Int64.*LongType"):
        Graph(narrow(v) if column == "id" else v, e if column == "id" else narrow(e))
    with pytest.raises(GraphSchemaError, match="Int64"):
        Graph(v.drop(column) if column == "id" else v, e if column == "id" else e.drop(column))
