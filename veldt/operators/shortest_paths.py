"""Hop distances from, or to, landmarks by breadth-first frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veldt.graph import Graph
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, msg, src

# fixed value: the distance of what cannot be reached
UNREACHABLE = 2**31 - 1


class ShortestPaths:
    """(id, dist_<landmark>...), landmarks ascending and each once; unreachable is 2147483647.

    Distances follow the edges from the landmark; ``to_landmarks`` those towards it. Only vertices whose
    distances improved send; the run ends when none did. All landmarks travel in one message row.
    """

    def __init__(self, graph: Graph, landmarks: list[int]):
        if not landmarks:
            raise ValueError("shortest paths need landmarks: there would be no messages")
        self.graph = graph
        self.landmarks = sorted(set(landmarks))
        self._to, self._cap, self._hub_rows = False, None, None

    def to_landmarks(self, to: bool = True) -> ShortestPaths:
        self._to = to
        return self

    def max_iterations(self, n: int) -> ShortestPaths:
        self._cap = n
        return self

    def hub_rows(self, n: int) -> ShortestPaths:
        self._hub_rows = n
        return self

    def run(self) -> ProgramResult:
        ends = self.graph.edges.select("src", "dst")
        if self._to:
            ends = ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        far = F.lit(UNREACHABLE)
        program = VertexProgram(Graph(self.graph.vertices.select("id"), ends)).hub_rows(self._hub_rows).skip_dest_state().fuse_messages()
        better = []
        for x in self.landmarks:
            name = f"dist_{x}"
            got = F.coalesce(msg(name), far)
            better.append(got < F.col(name))
            program.add_vertex_column(name, F.when(F.col("id") == x, F.lit(0)).otherwise(far), F.least(F.col(name), got))
            program.add_named_message(name, F.when(src(name) < far, src(name) + 1).otherwise(far), MessageDirection.SRC_TO_DST)
            program.add_named_aggregate_expr(name, F.min(msg(name)))
        improved = reduce(lambda a, b: a | b, better)
        program.with_participation_column("improved", F.col("id").isin(self.landmarks), improved).with_vertex_voting("active", improved)
        if self._cap is not None:
            program.max_iterations(self._cap)
        return program.run()
