"""The property graph: a pair of DataFrames and the operators on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, SRC, DST = "id", "src", "dst"
SRC_VERTEX, EDGE, DST_VERTEX = "src_vertex", "edge", "dst_vertex"


class GraphSchemaError(ValueError):
    """A key column is missing or is not a 64-bit integer."""


def _need_long(df: DataFrame, column: str, table: str) -> None:
    found = {f.name: f.dataType for f in df.schema}.get(column)
    if found is None:
        raise GraphSchemaError(f"{table} need a column {column} of type Int64 (LongType)")
    if found != T.LongType():
        raise GraphSchemaError(f"{table}.{column} must be Int64 (LongType), not {found.simpleString()}")


def simple_arcs(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """(src, dst) in both directions without self-loops; repeats are dropped where ``distinct``."""
    # one scan: a union of both directions would read the edges twice
    pair = F.array(F.struct(F.col(SRC).alias(SRC), F.col(DST).alias(DST)), F.struct(F.col(DST).alias(SRC), F.col(SRC).alias(DST)))
    both = edges.filter(F.col(SRC) != F.col(DST)).select(F.explode(pair).alias("arc")).select("arc.*")
    return both.distinct() if distinct else both


class Graph:
    """An immutable, lazy pair of a vertex table (``id``) and a table of directed edges (``src``, ``dst``).

    Keys must be exactly 64-bit integers. Any further columns pass through; parallel edges, self-loops and
    edges to unknown vertices are legal.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        _need_long(vertices, ID, "vertices")
        _need_long(edges, SRC, "edges")
        _need_long(edges, DST, "edges")
        self._vertices, self._edges = vertices, edges

    @property
    def vertices(self) -> DataFrame:
        return self._vertices

    @property
    def edges(self) -> DataFrame:
        return self._edges

    @property
    def spark(self):
        return self._vertices.sparkSession

    def num_nodes(self) -> int:
        return self._vertices.count()

    def num_edges(self) -> int:
        return self._edges.count()

    def _degrees(self, end: str, other: str, name: str, include_zero: bool) -> DataFrame:
        counted = self._edges.groupBy(F.col(end).alias(ID)).agg(F.count(other).alias(name))
        if not include_zero:
            return counted
        return self._vertices.select(ID).join(counted, ID, "left").select(ID, F.coalesce(name, F.lit(0).cast("long")).alias(name))

    def in_degrees(self, include_zero: bool = False) -> DataFrame:
        """(id, in_degree): edges with a non-null source per destination.

        With ``include_zero`` a row for every vertex and for no other id.
        """
        return self._degrees(DST, SRC, "in_degree", include_zero)

    def out_degrees(self, include_zero: bool = False) -> DataFrame:
        """(id, out_degree), the mirror of :meth:`in_degrees`."""
        return self._degrees(SRC, DST, "out_degree", include_zero)

    def symmetrize(self) -> Graph:
        """Every edge and its reverse with the same attributes; nothing is deduplicated."""
        swap = {SRC: DST, DST: SRC}
        back = self._edges.select(*(F.col(swap.get(c, c)).alias(c) for c in self._edges.columns))
        return Graph(self._vertices, self._edges.union(back))

    def triplets(self) -> DataFrame:
        """(src_vertex, edge, dst_vertex) structs, a row per edge; unknown ends give a null struct."""
        v = self._vertices
        whole = F.struct(*(F.col(c) for c in v.columns))
        one = v.select(F.col(ID).alias("__from"), whole.alias(SRC_VERTEX))
        two = v.select(F.col(ID).alias("__to"), whole.alias(DST_VERTEX))
        e = self._edges.select(F.struct(*(F.col(c) for c in self._edges.columns)).alias(EDGE))
        return e.join(one, F.col("edge.src") == F.col("__from"), "left").join(two, F.col("edge.dst") == F.col("__to"), "left").select(SRC_VERTEX, EDGE, DST_VERTEX)

    def vertex_program(self):
        """A builder for a synchronous vertex program."""
        from veldt.plans.vertex_program import VertexProgram

        return VertexProgram(self)

    pregel = vertex_program

    def pagerank(self):
        from veldt.operators.pagerank import PageRank

        return PageRank(self)

    def shortest_paths(self, landmarks: list[int]):
        from veldt.operators.shortest_paths import ShortestPaths

        return ShortestPaths(self, landmarks)

    def k_core(self):
        from veldt.operators.k_core import KCore

        return KCore(self)

    def hyperanf(self):
        from veldt.operators.hyperanf import HyperANF

        return HyperANF(self)

    def label_propagation(self):
        from veldt.operators.label_propagation import LabelPropagation

        return LabelPropagation(self)

    classical_lp = label_propagation

    def connected_components(self):
        from veldt.operators.components import ConnectedComponents

        return ConnectedComponents(self)

    def maximal_independent_set(self):
        from veldt.operators.independent_set import MaximalIndependentSet

        return MaximalIndependentSet(self)
