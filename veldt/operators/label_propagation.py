"""Synchronous label propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions.reducers import mode_by_id
from veldt.graph import Graph, simple_arcs
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, msg, src


class LabelPropagation:
    """(id, community) after exactly ``max_iter`` rounds of taking the most frequent neighbour label.

    Ties take the smallest label, vertices without messages keep theirs. Bidirectional by default: without
    self-loops, reverses added, not deduplicated, so that a mutual edge counts twice. Otherwise edges
    are used as given.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._max_iter, self._both, self._hub_rows = 10, True, None

    def max_iter(self, n: int) -> LabelPropagation:
        self._max_iter = n
        return self

    def bidirectional(self, both: bool = True) -> LabelPropagation:
        self._both = both
        return self

    def hub_rows(self, n: int) -> LabelPropagation:
        self._hub_rows = n
        return self

    def run(self) -> ProgramResult:
        ends = self.graph.edges.select("src", "dst")
        return (
            VertexProgram(Graph(self.graph.vertices.select("id"), simple_arcs(ends, distinct=False) if self._both else ends))
            .hub_rows(self._hub_rows)
            .skip_dest_state()
            .max_iterations(self._max_iter)
            .add_vertex_column("community", F.col("id"), F.coalesce(msg(), F.col("community")))
            .add_message(src("community"), MessageDirection.SRC_TO_DST)
            .reduce_messages(mode_by_id("__vp_msg_msg"))
            .run()
        )
