"""Consolidating pairwise matches into groups by low-diameter decomposition.

One level: every vertex draws an exponentially distributed head start. Clusters grow hop by hop from
vertices whose start time has come and that no cluster has reached; of several clusters that arrive
at once the one with the smaller fraction of its start time wins. After ``steps`` hops every vertex
belongs to a cluster of small radius. Clusters become the vertices of the next level, distinct links
between them its edges. Levels end when no link is left; then the assignments are composed from the
last level back, each with the smallest original id carried along.

Growth is a vertex program: links lie partitioned by their end once a level, and a hop moves the
frontier's messages only, one (cluster, fraction) pair each, reduced before the shuffle; hubs are
set apart by the program. Contraction and composition plan adaptively. The last levels, of a few
thousand links, grow by the same rule within one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.graph import Graph
from veldt.operators.sizing import BROADCAST_ROWS
from veldt.plans.materialize import Scratch
from veldt.plans.remainders import in_one_task
from veldt.plans.vertex_program import MessageDirection, VertexProgram, msg, src

#: So many links are one task's work.
LAST_LINKS = 5_000


@dataclass(frozen=True)
class _Level:
    """(id, low, center) of its vertices, the smallest low of each center, and the number of centers."""

    members: DataFrame
    lows: DataFrame
    clusters: int


def _distinct_links(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _head_start(level: int, steps: int, rate: float, seed: int) -> tuple[Column, Column]:
    """When a vertex may start its own cluster, as a hop number, and the fraction that decides between clusters."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "id"), 11).cast("double") + 1) / F.lit(float(2**53))
    shift = -F.log(uniform) / F.lit(rate)
    return F.greatest(F.lit(0), F.lit(steps) - F.floor(shift)).cast("int"), F.xxhash64(F.lit(seed + 1), F.lit(level), "id")


def _grow(links: DataFrame, vertices: DataFrame, level: int, steps: int, rate: float, seed: int, hub_rows: int | None) -> DataFrame:
    """(id, low, center): the cluster of each vertex."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    arcs = links.select(F.explode(ends).alias("arc")).select("arc.*")
    start, frac = _head_start(level, steps, rate, seed)
    at_once = F.col("start") == 0
    hop, free = F.col("hop") + 1, F.col("center").isNull()
    own = F.when(F.col("start") <= hop, F.col("frac"))
    by_news = msg("mark").isNotNull() & (own.isNull() | (msg("mark") < own))
    reached = free & (by_news | own.isNotNull())
    return (
        VertexProgram(Graph(vertices, arcs))
        .hub_rows(hub_rows)
        .skip_dest_state()
        .fuse_messages()
        .max_iterations(steps)
        .add_vertex_column("low", F.col("low"), F.col("low"))
        .add_vertex_column("hop", F.lit(0), hop)
        .add_vertex_column("start", start, F.col("start"))
        .add_vertex_column("frac", frac, F.col("frac"))
        .add_vertex_column("center", F.when(at_once, F.col("id")), F.when(~free, F.col("center")).when(by_news, msg("center")).when(own.isNotNull(), F.col("id")))
        .add_vertex_column("mark", F.when(at_once, F.col("frac")), F.when(~free, F.col("mark")).when(by_news, msg("mark")).when(own.isNotNull(), F.col("frac")))
        .with_participation_column("front", at_once, reached)
        .add_named_message("center", src("center"), MessageDirection.SRC_TO_DST)
        .add_named_message("mark", src("mark"), MessageDirection.SRC_TO_DST)
        .add_named_aggregate_expr("center", F.min_by(msg("center"), msg("mark")))
        .add_named_aggregate_expr("mark", F.min(msg("mark")))
        .run()
        .df.select("id", "low", "center")
    )


def grow_clusters(vertices: int, x: np.ndarray, y: np.ndarray, steps: int, rate: float, draw: np.random.Generator) -> np.ndarray:
    """The center of every vertex after ``steps`` hops; ``x`` and ``y`` are the arcs in both directions."""
    start = np.maximum(0, steps - np.floor(draw.exponential(1 / rate, vertices))).astype(np.int64)
    rank = draw.permutation(vertices)
    of_rank = np.argsort(rank)
    unreached = vertices
    mark = np.where(start == 0, rank, unreached)
    front = start == 0
    for hop in range(1, steps + 1):
        news = np.full(vertices, unreached)
        moving = front[x]
        np.minimum.at(news, y[moving], mark[x[moving]])
        np.minimum(news, np.where(start <= hop, rank, unreached), out=news)
        front = (mark == unreached) & (news < unreached)
        mark[front] = news[front]
    return of_rank[mark]


def decompose(a: np.ndarray, b: np.ndarray, steps: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, center) of every end, levels repeated until no link is left: a center is one of its group's ids."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at, np.concatenate([at[len(a) :], at[: len(a)]])
    group, center, draw = np.arange(len(ids)), np.arange(len(ids)), np.random.default_rng(seed)
    while len(x):
        found, to = np.unique(grow_clusters(len(center), x, y, steps, rate, draw), return_inverse=True)
        group, center = to[group], center[found]
        pairs = np.unique(to[x] * len(found) + to[y])
        x, y = pairs // len(found), pairs % len(found)
        x, y = x[x != y], y[x != y]
    return ids, ids[center[group]]


def link_groups(
    pairs: DataFrame,
    left: str = "src",
    right: str = "dst",
    steps: int = 5,
    rate: float = 0.3,
    seed: int = 42,
    max_levels: int = 200,
    last_links: int = LAST_LINKS,
    hub_rows: int | None = None,
) -> DataFrame:
    """(id, component) of every id that is linked with another one; component is its group's smallest id.

    Direction, repeats, self-loops and other columns do not matter. Defined results: pairs with a
    null end link nothing; an id linked only with itself, or with nothing, has no row; an empty
    table gives an empty result. ``steps`` bounds the cluster radius of a level; levels of at most
    ``last_links`` links are decomposed within one task, with 0 none is.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    ends = pairs.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    links = scratch.write(_distinct_links(ends), "links-0")
    vertices = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("low", F.col("id"))
    levels: list[_Level] = []
    while left_over := links.count():  # from the files' footers
        level = len(levels)
        if level == max_levels:
            raise RuntimeError(f"links are left after {max_levels} levels")
        last = left_over <= last_links
        if last:
            solved = in_one_task(links, lambda a, b: decompose(a, b, steps, rate, seed), "id long, center long")
            grown = vertices.join(solved, "id").select("id", "low", "center")
        else:
            grown = _grow(links, vertices, level, steps, rate, seed, hub_rows)
        members = scratch.write(grown, f"members-{level}")
        lows = scratch.write(members.groupBy("center").agg(F.min("low").alias("low")), f"lows-{level}")
        levels.append(_Level(members, lows, lows.count()))
        if last:
            break
        to = members.select("id", "center")
        one, two = (to.select(F.col("id").alias(end), F.col("center").alias("c" + end)) for end in ("a", "b"))
        between = links.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        nearer = scratch.write(_distinct_links(between), f"links-{level + 1}")
        scratch.drop(f"links-{level}")
        links = nearer
        linked = links.select(F.explode(F.array("a", "b")).alias("center")).distinct()
        vertices = lows.join(linked, "center", "left_semi").select(F.col("center").alias("id"), "low")
    if not levels:
        return vertices.select("id", F.col("low").alias("component"))
    scratch.drop(f"links-{len(levels)}")
    scratch.drop(f"links-{len(levels) - 1}")

    found: DataFrame | None = None  # (id, component) of the level after
    for level in range(len(levels) - 1, -1, -1):
        members, lows, clusters = levels[level].members, levels[level].lows, levels[level].clusters
        if found is None:
            to = lows.select("center", F.col("low").alias("component"))
        else:
            later = found.select(F.col("id").alias("center"), "component")
            to = lows.join(later, "center", "left").select("center", F.coalesce("component", "low").alias("component"))
        # a group may hold a third of all rows: its side is broadcast where few, else split by AQE
        side = F.broadcast(to) if clusters <= BROADCAST_ROWS else to
        found = members.join(side, "center").select("id", "component")
        if level:
            found = scratch.write(found, f"found-{level}")
    return found


def group_sizes(groups: DataFrame) -> DataFrame:
    """(size, groups): how many groups have how many members."""
    return groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
