"""Sizes of neighbourhoods within a number of hops, estimated with HyperLogLog sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions.reducers import hll_estimate, hll_long, hll_union, hll_union_agg
from veldt.graph import Graph, simple_arcs
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, msg, src


class HyperANF:
    """(id, neighborhood_size): how many vertices reach this one within ``n_hops``, itself included.

    ``directed(False)`` counts along the simple undirected graph. Only vertices whose sketch changed send.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._hops, self._lg_k, self._directed, self._hub_rows = 2, 12, True, None

    def n_hops(self, n: int) -> HyperANF:
        self._hops = n
        return self

    def lg_k(self, lg_k: int) -> HyperANF:
        if not 4 <= lg_k <= 21:
            raise ValueError("lg_k must be from 4 to 21")
        self._lg_k = lg_k
        return self

    def directed(self, directed: bool) -> HyperANF:
        self._directed = directed
        return self

    def hub_rows(self, n: int) -> HyperANF:
        self._hub_rows = n
        return self

    def run(self) -> ProgramResult:
        ends = self.graph.edges.select("src", "dst")
        start = hll_long(self.graph.vertices.select("id"), "id", self._lg_k, "ball")
        merged = F.coalesce(hll_union(F.col("ball"), msg()), F.col("ball"))
        result = (
            VertexProgram(Graph(start, ends if self._directed else simple_arcs(ends)))
            .hub_rows(self._hub_rows)
            .skip_dest_state()
            .max_iterations(self._hops)
            .add_vertex_column("ball", F.col("ball"), merged)
            .with_participation_column("changed", F.lit(True), merged != F.col("ball"))
            .add_message(src("ball"), MessageDirection.SRC_TO_DST)
            .add_aggregate_expr(hll_union_agg(msg()))
            .run()
        )
        return ProgramResult(result.df.select("id", hll_estimate(F.col("ball")).alias("neighborhood_size")), result.iterations)
