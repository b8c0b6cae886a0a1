"""Synchronous vertex programs: messages, aggregation, simultaneous update, voting.

Edges are cached by column, partitioned and sorted by source, and so is the state by id, so that a superstep
is one job with one exchange, that of the messages, which are combined before it. The loop plans in a
session of its own.

A hub, an id that holds more edges than a few partitions' share, has no place in such a partition: its
edges stay where they were read and meet the hubs' states by a broadcast, of as many rows at most as there
are partitions. Hubs are found in a sample of the edges; that choice is one of the plan, results are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.graph import DST, ID, SRC, Graph
from veldt.plans.materialize import Generations, Scratch, keep, loop_partitions, rebound, shared_dir, static_session, validate_output

_SRC, _DST, _EDGE, _MSG = "__vp_src_", "__vp_dst_", "__vp_edge_", "__vp_msg_"


class MessageDirection(Enum):
    SRC_TO_DST = "src_to_dst"
    DST_TO_SRC = "dst_to_src"
    BIDIRECTIONAL = "bidirectional"


#: The ends of an edge that a message goes to.
_ENDS = {MessageDirection.SRC_TO_DST: (DST,), MessageDirection.DST_TO_SRC: (SRC,), MessageDirection.BIDIRECTIONAL: (DST, SRC)}


def src(column: str) -> Column:
    """A state column of the edge's source, in messages."""
    return F.col(_SRC + column)


def dst(column: str) -> Column:
    """A state column of the edge's destination, in messages."""
    return F.col(_DST + column)


def edge(column: str) -> Column:
    """An edge column, in messages."""
    return F.col(_EDGE + column)


def msg(name: str = "msg") -> Column:
    """A message, in aggregates; an aggregate, in updates."""
    return F.col(_MSG + name)


#: A hub holds at least so many edges, and at least four times a partition's share.
HUB_ROWS = 100_000
#: Edges in the sample that hubs are looked for in.
HUB_SAMPLE = 2_000_000


def find_hubs(edges: DataFrame, column: str, rows: int, partitions: int, least: int | None = None) -> list[int]:
    """Ids that hold more than four partitions' share of ``edges``, judged by a sample; at most as many as partitions."""
    bound = max(HUB_ROWS if least is None else least, 4 * rows // partitions if least is None else 1)
    if rows <= bound:
        return []
    share = min(1.0, HUB_SAMPLE / rows)
    drawn = edges.sample(share, seed=42) if share < 1 else edges
    counts = drawn.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col(column).isNotNull() & (F.col("n") >= 0.5 * bound * share))
    return [r[0] for r in counts.orderBy(F.desc("n"), column).limit(partitions).select(column).collect()]


@dataclass(frozen=True)
class LaidEdges:
    """Edges in the layout of a loop: those of light sources partitioned by source, those of hubs as they were read."""

    light: DataFrame
    hub: DataFrame | None = None
    hubs: tuple[int, ...] = ()
    target_hubs: tuple[int, ...] = ()
    partitions: int = 1


@dataclass(frozen=True)
class ProgramResult:
    df: DataFrame
    iterations: int


@dataclass(frozen=True)
class _Message:
    name: str
    value: Column
    direction: MessageDirection


class VertexProgram:
    """Builder and loop. Every method returns the builder; :meth:`run` gives the result.

    Semantics: edges with an unknown end send nothing, messages to unknown ids are dropped; parallel edges
    send a message each; updates see the old state and the aggregated messages, which are null where
    none arrived; vertex attributes that are not declared as columns are left out of the result, whose
    columns are ``id`` and then the declared ones.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._cap: int | None = None
        self._dest_state = True
        self._columns: list[tuple[str, Column, Column]] = []
        self._edge_columns: list[str] = []
        self._voting: tuple[str, Column] | None = None
        self._participation: tuple[str, Column, Column] | None = None
        self._messages: list[_Message] = []
        self._aggregates: list[tuple[str, Column]] = []
        self._reducer: Callable[[DataFrame], DataFrame] | None = None
        self._fuse = False
        self._duplicates = False
        self._hub_rows: int | None = None
        self._folder: str | None = None

    def max_iterations(self, n: int) -> VertexProgram:
        """At most ``n`` supersteps; 0 only evaluates the initial state."""
        self._cap = n
        return self

    def skip_dest_state(self) -> VertexProgram:
        """Messages do not read the destination's state: one join less per superstep."""
        self._dest_state = False
        return self

    def hub_rows(self, n: int | None) -> VertexProgram:
        """An id with so many edges is a hub, whatever a partition's share is; None: see :func:`find_hubs`."""
        self._hub_rows = n
        return self

    def checkpoint_dir(self, path: str) -> VertexProgram:
        """Write the tables of the run under this shared folder instead of the session's; cuts of lineage stay in the session's."""
        self._folder = path
        return self

    def with_vertex_voting(self, column: str, condition: Column) -> VertexProgram:
        """Stop once ``condition``, evaluated with the updates, holds for no vertex; null counts as false."""
        self._voting = (column, condition)
        return self

    def with_participation_column(self, column: str, initial: Column, update: Column) -> VertexProgram:
        """Only participating vertices send; with destination state an edge sends if either end participates."""
        self._participation = (column, initial, update)
        return self

    def add_vertex_column(self, name: str, initial: Column, update: Column) -> VertexProgram:
        """A state column. Initial values may read columns declared before; updates are simultaneous."""
        self._columns.append((name, initial, update))
        return self

    def add_edge_column(self, name: str) -> VertexProgram:
        self._edge_columns.append(name)
        return self

    def add_message(self, value: Column, direction: MessageDirection) -> VertexProgram:
        return self.add_named_message("msg", value, direction)

    def add_named_message(self, name: str, value: Column, direction: MessageDirection) -> VertexProgram:
        self._messages.append(_Message(name, value, direction))
        return self

    def add_aggregate_expr(self, value: Column) -> VertexProgram:
        return self.add_named_aggregate_expr("msg", value)

    def add_named_aggregate_expr(self, name: str, value: Column) -> VertexProgram:
        self._aggregates.append((name, value))
        return self

    def reduce_messages(self, reducer: Callable[[DataFrame], DataFrame]) -> VertexProgram:
        """Instead of aggregates: a function from (id, messages) to one row per id with the same columns.

        It should aggregate by (id, message) first: messages to hubs are combined before that shuffle; those
        to other ids are shuffled once, by id.
        """
        self._reducer = reducer
        return self

    def fuse_messages(self) -> VertexProgram:
        """Send messages of one direction as one row; for aggregates that skip nulls."""
        self._fuse = True
        return self

    def allow_duplicates(self) -> VertexProgram:
        """Accept a program without aggregate, where a state row repeats for every message it receives."""
        self._duplicates = True
        return self

    # -- the loop

    def _validate(self) -> None:
        if not self._messages:
            raise ValueError("a vertex program needs messages")
        if not self._aggregates and self._reducer is None:
            if len(self._messages) > 1:
                raise ValueError("several messages need aggregates")
            if not self._duplicates:
                raise ValueError("without an aggregate state rows would repeat; see allow_duplicates")

    def _sent(self, triplets: DataFrame) -> DataFrame:
        """(id, messages...) from one pass over the triplets."""
        rows: dict[object, list[_Message]] = {}
        for k, m in enumerate(self._messages):
            for end in _ENDS[m.direction]:
                rows.setdefault(end if self._fuse else (end, k), []).append(m)
        names = list(dict.fromkeys(m.name for m in self._messages))
        first = {n: next(m.value for m in self._messages if m.name == n) for n in names}
        kinds = {f.name: f.dataType for f in triplets.select(*(v.alias(n) for n, v in first.items())).schema}

        def row(key: object, sent: list[_Message]) -> list[Column]:
            end = key if isinstance(key, str) else key[0]
            given = {m.name: m.value for m in sent}
            return [edge(end).alias(ID), *(given.get(n, F.lit(None)).cast(kinds[n]).alias(_MSG + n) for n in names)]

        if len(rows) == 1:
            ((key, sent),) = rows.items()
            return triplets.select(*row(key, sent))
        each = F.array(*(F.struct(*row(key, sent)) for key, sent in rows.items()))
        return triplets.select(F.explode(each).alias("m")).select("m.*")

    def _triplets(self, state: DataFrame, edges: LaidEdges) -> DataFrame:
        part = self._participation[0] if self._participation else None
        senders = state.filter(F.col(part)) if part and not self._dest_state else state
        one = senders.select(*(F.col(c).alias(_SRC + c) for c in state.columns))
        source = edge(SRC) == F.col(_SRC + ID)
        met = [edges.light.join(one, source)]
        if edges.hub is not None:
            met.append(edges.hub.join(F.broadcast(one.filter(F.col(_SRC + ID).isin(*edges.hubs))), source))
        if not self._dest_state:
            return met[0] if len(met) == 1 else met[0].union(met[1])
        two = state.select(*(F.col(c).alias(_DST + c) for c in state.columns))
        target = edge(DST) == F.col(_DST + ID)
        out = []
        for rows in met:
            if not edges.target_hubs:
                out.append(rows.join(two, target))
                continue
            hot = edge(DST).isin(*edges.target_hubs)
            out.append(rows.filter(~hot).join(two, target))
            out.append(rows.filter(hot).join(F.broadcast(two.filter(F.col(_DST + ID).isin(*edges.target_hubs))), target))
        triplets = out[0]
        for more in out[1:]:
            triplets = triplets.unionByName(more)
        return triplets.filter(src(part) | dst(part)) if part else triplets

    def _superstep(self, state: DataFrame, edges: LaidEdges) -> DataFrame:
        part = self._participation[0] if self._participation else None
        triplets = self._triplets(state, edges)
        sent = self._sent(triplets)
        hot = None
        if self._reducer is not None:
            to_hub = F.col(ID).isin(*edges.target_hubs) if edges.target_hubs else F.lit(False)
            received = self._reducer(sent.filter(~to_hub).repartition(edges.partitions, ID))
            hot = self._reducer(sent.filter(to_hub)) if edges.target_hubs else None
        elif self._aggregates:
            received = sent.groupBy(ID).agg(*(v.alias(_MSG + n) for n, v in self._aggregates))
        else:
            received = sent
        updated = [F.col(ID), *(u.alias(n) for n, _, u in self._columns)]
        if self._voting:
            updated.append(self._voting[1].alias(self._voting[0]))
        if self._participation:
            updated.append(F.coalesce(self._participation[2], F.lit(False)).alias(part))
        met = state.join(received, ID, "left")
        if hot is not None:
            names = [c for c in hot.columns if c != ID]
            few = F.broadcast(hot.select(ID, *(F.col(c).alias("__hot_" + c) for c in names)))  # a row per hub
            met = met.join(few, ID, "left").withColumns({c: F.coalesce("__hot_" + c, c) for c in names})
        return met.select(*updated)

    def run(self, debug: bool = False, output: str | None = None) -> ProgramResult:
        """Run to the end. ``debug`` keeps the voting and participation columns in the result.

        With ``output`` the result is written there as parquet, and read from there; the folder must not
        overlap that of the intermediates.
        """
        self._validate()
        spark = self.graph.spark
        if output is not None:
            validate_output(output, self._folder or shared_dir(spark))
        names = [n for n, _, _ in self._columns]
        state = self.graph.vertices
        for n, initial, _ in self._columns:
            state = state.withColumn(n, initial)
        flags = []
        if self._voting:
            state, flags = state.withColumn(self._voting[0], F.lit(True)), [self._voting[0]]
        if self._participation:
            state, flags = state.withColumn(self._participation[0], self._participation[1]), [*flags, self._participation[0]]
        kept = [SRC, DST, *(c for c in self._edge_columns if c not in (SRC, DST))]
        edges = self.graph.edges.select(*(F.col(c).alias(_EDGE + c) for c in kept))
        wanted = [ID, *names, *(flags if debug else ())]
        if self._cap == 0:
            return ProgramResult(state.select(*(list(dict.fromkeys([*self.graph.vertices.columns, *names, *flags])) if debug else wanted)), 0)
        state = state.select(ID, *names, *flags)

        scratch = Scratch(spark, "vertex-program", self._folder)
        edges = scratch.write(edges, "edges")
        rows = edges.count()  # from the files' footers
        partitions = loop_partitions(spark, rows)
        own = static_session(spark, partitions)
        states, cached = Generations(own), []
        try:
            laid = self._lay(rebound(edges, own), rows, partitions, cached)
            state, _ = states.push(rebound(state, own).repartition(partitions, ID).sortWithinPartitions(ID))
            vote = F.count_if(self._voting[0]) if self._voting else F.count(F.lit(1))
            done = 0
            while self._cap is None or done < self._cap:
                state, votes = states.push(self._superstep(state, laid), vote)
                done += 1
                if self._voting and not votes[0]:
                    break
            result = rebound(state.select(*wanted), spark)
            if output is None:
                result = scratch.write(result, "result")
            else:
                result.write.parquet(output)
                result = spark.read.schema(result.schema).parquet(output)
        finally:
            for df in cached:
                df.unpersist()
            states.release()
            scratch.drop("edges")
        return ProgramResult(result, done)

    def _lay(self, edges: DataFrame, rows: int, partitions: int, cached: list[DataFrame]) -> LaidEdges:
        """The edges, cached in their layout; what is to be released is put into ``cached``."""
        by = _EDGE + SRC
        hubs = find_hubs(edges, by, rows, partitions, self._hub_rows)
        ends = {_EDGE + DST} if self._dest_state else set()
        if self._reducer is not None:
            ends |= {_EDGE + end for m in self._messages for end in _ENDS[m.direction]}
        targets = {x for end in sorted(ends) for x in (hubs if end == by else find_hubs(edges, end, rows, partitions, self._hub_rows))}
        light, hub = (edges.filter(~F.col(by).isin(*hubs)), edges.filter(F.col(by).isin(*hubs))) if hubs else (edges, None)
        # lost blocks come back from the written table
        light = light.repartition(partitions, by).sortWithinPartitions(by)
        cached += [light, *([hub] if hubs else [])]
        return LaidEdges(keep(light), keep(hub) if hubs else None, tuple(hubs), tuple(sorted(targets)), partitions)
