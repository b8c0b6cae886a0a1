"""Weakly connected components by randomised contraction.

A round hashes all vertices with a random affine bijection of GF(2^64), maps every vertex to the smallest
hash among itself and its neighbours, and relabels the edges, until none is left. Then the maps are
composed from the last round back; a vertex that a later round no longer holds passes through that
round's bijection, so that labels of different rounds stay comparable. The last edges, few, are one task's work.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.gf64 import affine, affine_column
from veldt.graph import Graph
from veldt.operators.sizing import BROADCAST_ROWS, broadcast_if_small
from veldt.plans.materialize import Scratch
from veldt.plans.remainders import REMAINDER, component_labels, in_one_task
from veldt.plans.vertex_program import ProgramResult


@dataclass(frozen=True)
class _Round:
    """Its map of vertices to representatives, its bijection x -> a x + b, and how many vertices it has at most."""

    reps: DataFrame
    a: int
    b: int
    vertices: int


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nearest(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(v, rep): the smallest hash among a vertex and its neighbours, in one pass over the edges."""
    hashed = edges.withColumns({"hs": affine_column(a, F.col("src"), b), "hd": affine_column(a, F.col("dst"), b)})
    low = F.least("hs", "hd")
    both = F.array(*(F.struct(F.col(end).alias("v"), low.alias("rep")) for end in ("src", "dst")))
    return hashed.select(F.explode(both).alias("x")).groupBy(F.col("x.v").alias("v")).agg(F.min("x.rep").alias("rep"))


def _relabelled(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """The distinct edges between representatives."""
    one = reps.select(F.col("v").alias("src"), F.col("rep").alias("rs"))
    two = reps.select(F.col("v").alias("dst"), F.col("rep").alias("rd"))
    pair = edges.join(one, "src").join(two, "dst").filter("rs <> rd")
    return pair.select(F.least("rs", "rd").alias("src"), F.greatest("rs", "rd").alias("dst")).distinct()


class ConnectedComponents:
    """(id, component) of every vertex.

    component is the group's smallest vertex id, or with ``use_labels(False)`` some number common to the
    group. Edges with ends that are no vertices connect as well. iterations counts contraction rounds.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._seed, self._labels, self._remainder = 42, True, REMAINDER

    def seed(self, seed: int) -> ConnectedComponents:
        self._seed = seed
        return self

    def use_labels(self, use: bool = True) -> ConnectedComponents:
        self._labels = use
        return self

    def remainder(self, links: int) -> ConnectedComponents:
        """So many edges that are left are solved in one task; 0: none, every round is a distributed one."""
        self._remainder = links
        return self

    def run(self) -> ProgramResult:
        spark = self.graph.spark
        scratch = Scratch(spark, "components")
        draw = random.Random(self._seed)
        # self-loops and repeats of the first round vanish in its relabelling
        edges = scratch.write(self.graph.edges.select("src", "dst").filter("src <> dst"), "edges-0")
        rounds: list[_Round] = []
        while left := edges.count():  # from the files' footers
            k = len(rounds)
            if left <= self._remainder:
                # as a round whose bijection is the identity
                solved = in_one_task(edges, component_labels, "v long, rep long")
                rounds.append(_Round(scratch.write(solved, f"reps-{k}"), 1, 0, 2 * left))
                break
            a, b = (_signed(x) for x in (draw.randrange(1, 1 << 64), draw.randrange(1 << 64)))
            reps = scratch.write(_nearest(edges, a, b), f"reps-{k}")
            nearer = scratch.write(_relabelled(edges, reps), f"edges-{k + 1}")
            scratch.drop(f"edges-{k}")
            edges = nearer
            rounds.append(_Round(reps, a, b, 2 * left))  # at most so many vertices have edges
        scratch.drop(f"edges-{len(rounds)}")
        scratch.drop(f"edges-{len(rounds) - 1}")

        ids = self.graph.vertices.select("id")
        if not rounds:
            return ProgramResult(ids.select("id", F.col("id").alias("component")), 0)
        last = self._composed(scratch, rounds)
        found = ids.join(last.select(F.col("v").alias("id"), "rep"), "id", "left").select("id", F.coalesce("rep", "id").alias("component"), F.col("rep").isNull().alias("alone"))
        if not self._labels:
            return ProgramResult(found.select("id", "component"), len(rounds))
        found = scratch.write(found, "found")
        grouped = found.filter(~F.col("alone"))
        labels = scratch.write(grouped.groupBy("component").agg(F.min("id").alias("label")), "labels")
        for k in range(len(rounds)):
            scratch.drop(f"reps-{k}")
            scratch.drop(f"back-{k}")
        named = grouped.join(broadcast_if_small(labels), "component").select("id", F.col("label").alias("component"))
        return ProgramResult(named.union(found.filter("alone").select("id", F.col("id").alias("component"))), len(rounds))

    @staticmethod
    def _composed(scratch: Scratch, rounds: list[_Round]) -> DataFrame:
        """(v, rep): the last round's label of every vertex of the first.

        Going back, ``scale`` and ``shift`` are the map through which a label goes that the later rounds do not hold.
        """
        latest = rounds[-1].reps
        scale, shift = 1, 0
        for k in range(len(rounds) - 2, -1, -1):
            after = rounds[k + 1]
            scale, shift = affine(scale, after.a, 0), affine(scale, after.b, shift)
            known = latest.select(F.col("v").alias("rep"), F.col("rep").alias("last"))
            if after.vertices <= BROADCAST_ROWS:
                known = F.broadcast(known)
            passed = affine_column(scale, F.col("rep"), shift)
            latest = scratch.write(rounds[k].reps.join(known, "rep", "left").select("v", F.coalesce("last", passed).alias("rep")), f"back-{k}")
        return latest
