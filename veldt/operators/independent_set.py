"""Maximal independent set by randomised nomination with adapting probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldt.graph import Graph, simple_arcs
from veldt.plans.vertex_program import MessageDirection, ProgramResult, VertexProgram, msg, src

_ACTIVE, _JOINING, _MEMBER, _OUT = range(4)


class MaximalIndependentSet:
    """(id) of the set's members. Isolated vertices belong to it; edges to unknown vertices do not count.

    A vertex nominates itself with probability p, starting at one half; p halves where the neighbours'
    sum reaches two and doubles otherwise, up to one half. A nominee without a nominated neighbour joins, and
    tells its neighbours with the next round's messages, which leave. Nomination hashes (id, round, seed):
    repeated tasks agree. A round is one superstep; only active and joining vertices send.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._seed, self._cap, self._hub_rows = 42, 1000, None

    def seed(self, seed: int) -> MaximalIndependentSet:
        self._seed = seed
        return self

    def max_iterations(self, n: int) -> MaximalIndependentSet:
        self._cap = n
        return self

    def hub_rows(self, n: int) -> MaximalIndependentSet:
        self._hub_rows = n
        return self

    def _nominates(self, number: Column, p: Column) -> Column:
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(self._seed), number, "id"), 11).cast("double") / F.lit(float(2**53))
        return chance <= p

    def run(self) -> ProgramResult:
        status, p, number, half = F.col("status"), F.col("p"), F.col("number"), F.lit(0.5)
        near = F.coalesce(msg("near"), F.lit(0.0))  # the active neighbours' sum
        hit, rival = (F.coalesce(msg(n), F.lit(False)) for n in ("hit", "rival"))
        joins = (near == 0) | (F.col("nominated") & ~rival)
        judged = F.when(status == _JOINING, _MEMBER).when(status != _ACTIVE, status).when(hit, _OUT).when(joins, _JOINING).otherwise(_ACTIVE)
        adapted = F.when(near >= 2, p / 2).otherwise(F.least(p * 2, half))
        active = src("status") == _ACTIVE
        vertices = self.graph.vertices.select("id").distinct()
        result = (
            VertexProgram(Graph(vertices, simple_arcs(self.graph.edges.select("src", "dst"))))
            .hub_rows(self._hub_rows)
            .skip_dest_state()
            .fuse_messages()
            .max_iterations(self._cap)
            .add_vertex_column("status", F.lit(_ACTIVE), judged)
            .add_vertex_column("p", half, adapted)
            .add_vertex_column("number", F.lit(0), number + 1)
            .add_vertex_column("nominated", self._nominates(F.lit(0), half), self._nominates(number + 1, adapted))
            .with_participation_column("sends", F.lit(True), judged.isin(_ACTIVE, _JOINING))
            .with_vertex_voting("active", judged == _ACTIVE)
            .add_named_message("near", F.when(active, src("p")), MessageDirection.SRC_TO_DST)
            .add_named_message("rival", active & src("nominated"), MessageDirection.SRC_TO_DST)
            .add_named_message("hit", src("status") == _JOINING, MessageDirection.SRC_TO_DST)
            .add_named_aggregate_expr("near", F.sum(msg("near")))
            .add_named_aggregate_expr("rival", F.bool_or(msg("rival")))
            .add_named_aggregate_expr("hit", F.bool_or(msg("hit")))
            .run()
        )
        if result.iterations == self._cap and not result.df.filter(status == _ACTIVE).isEmpty():
            raise RuntimeError(f"vertices are undecided after {self._cap} rounds")
        return ProgramResult(result.df.filter(status.isin(_JOINING, _MEMBER)).select("id"), result.iterations)
