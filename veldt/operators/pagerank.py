"""PageRank in incremental form: only vertices whose rank still changes send."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.graph import Graph
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, msg, src


class PageRank:
    """(id, pagerank), normalised to sum 1. ``max_iter`` 0 runs until no change exceeds ``tol``.

    ``tol`` prunes senders in either mode; ``tol(0)`` gives the textbook iteration. Ranks of vertices
    without out-edges are not redistributed while iterating. An empty graph gives an empty result.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._max_iter, self._reset, self._tol, self._hub_rows = 0, 0.15, 0.01, None

    def max_iter(self, n: int) -> PageRank:
        self._max_iter = n
        return self

    def reset_prob(self, p: float) -> PageRank:
        self._reset = p
        return self

    def tol(self, tol: float) -> PageRank:
        self._tol = tol
        return self

    def hub_rows(self, n: int) -> PageRank:
        self._hub_rows = n
        return self

    def run(self) -> ProgramResult:
        start = F.lit(float(self._reset))
        delta = F.lit(1.0 - self._reset) * F.coalesce(msg(), F.lit(0.0))
        changing = delta > F.lit(float(self._tol))
        program = (
            VertexProgram(Graph(self.graph.out_degrees(include_zero=True), self.graph.edges))
            .hub_rows(self._hub_rows)
            .skip_dest_state()
            .add_vertex_column("out_degree", F.col("out_degree"), F.col("out_degree"))
            .add_vertex_column("pagerank", start, F.col("pagerank") + delta)
            .add_vertex_column("pagerank_delta", start, delta)
            .with_participation_column("sends", F.lit(True), changing)
            .add_message(F.try_divide(src("pagerank_delta"), src("out_degree")), MessageDirection.SRC_TO_DST)
            .add_aggregate_expr(F.sum(msg()))
        )
        if self._max_iter:
            program.max_iterations(self._max_iter)
        else:
            program.with_vertex_voting("active", changing)
        result = program.run()
        total = result.df.agg(F.sum("pagerank").alias("total"))
        ranks = result.df.crossJoin(F.broadcast(total)).select("id", (F.col("pagerank") / F.col("total")).alias("pagerank"))  # one row
        return ProgramResult(ranks, result.iterations)
