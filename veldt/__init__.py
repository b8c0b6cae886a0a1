"""A PySpark-native graph analytics engine with operators for large, dirty tables.

>>> from veldt import Graph
>>> g = Graph(vertices, edges)
>>> ranks = g.pagerank().max_iter(10).run().df
"""

from veldt.graph import DST, EDGE, ID, SRC, SRC_VERTEX, DST_VERTEX, Graph, GraphSchemaError
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, dst, edge, msg, src

__all__ = ["DST", "DST_VERTEX", "EDGE", "Graph", "GraphSchemaError", "ID", "MessageDirection", "ProgramResult", "SRC", "SRC_VERTEX", "VertexProgram", "dst", "edge", "msg", "src"]
