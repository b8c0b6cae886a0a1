"""Core numbers by repeated h-indices of neighbour estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions.reducers import h_index_by_id
from veldt.graph import Graph, simple_arcs
from veldt.plans.materialize import Scratch
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, msg, src


class KCore:
    """(id, kcore) of the simple undirected graph; isolated vertices have 0. ``max_iter`` 0 converges."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self._max_iter, self._hub_rows = 0, None

    def max_iter(self, n: int) -> KCore:
        self._max_iter = n
        return self

    def hub_rows(self, n: int) -> KCore:
        self._hub_rows = n
        return self

    def run(self) -> ProgramResult:
        # read for the degrees and for the program: written once
        scratch = Scratch(self.graph.spark, "k-core")
        arcs = scratch.write(simple_arcs(self.graph.edges.select("src", "dst")), "arcs")
        degrees = Graph(self.graph.vertices.select("id"), arcs).out_degrees(include_zero=True)
        new = F.coalesce(msg(), F.lit(0))
        program = (
            VertexProgram(Graph(degrees, arcs))
            .hub_rows(self._hub_rows)
            .skip_dest_state()
            .add_vertex_column("kcore", F.col("out_degree").cast("int"), new)
            .add_message(src("kcore"), MessageDirection.SRC_TO_DST)
            .reduce_messages(h_index_by_id("__vp_msg_msg"))
            .with_vertex_voting("active", F.col("kcore") != new)
        )
        if self._max_iter:
            program.max_iterations(self._max_iter)
        result = program.run()
        scratch.purge()
        return result
