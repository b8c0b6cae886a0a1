"""The vertex-program engine: semantics, with and without hubs, and its physical plan."""

import pytest
from pyspark.sql import functions as F

from veldt import MessageDirection, VertexProgram, dst, edge, msg, src
from veldt.plans.materialize import Generations, Scratch, StateStore, intermediates, keep, rebound, shared_dir, static_session, validate_output
from veldt.plans.vertex_program import LaidEdges, find_hubs

HUBS = [None, 1]  # none at this size; every id
OUT, BACK, BOTH = MessageDirection.SRC_TO_DST, MessageDirection.DST_TO_SRC, MessageDirection.BIDIRECTIONAL


def values(df, column):
    return {r.id: r[column] for r in df.collect()}


@pytest.mark.parametrize("hubs", HUBS)
@pytest.mark.parametrize("direction", [OUT, BACK])
def test_chain_votes_to_halt(graph, hubs, direction):
    first = 1 if direction == OUT else 4
    sent = src("v") if direction == OUT else dst("v")
    p = graph([1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)]).vertex_program().hub_rows(hubs)
    new = F.greatest(F.col("v"), F.coalesce(msg(), F.lit(0)))
    r = p.add_vertex_column("v", F.when(F.col("id") == first, 1).otherwise(0), new).with_vertex_voting("active", F.col("v") != new).add_message(sent, direction).add_aggregate_expr(F.max(msg())).run()
    assert r.iterations == 4 and set(values(r.df, "v").values()) == {1} and r.df.columns == ["id", "v"]


def test_self_loop_and_no_edges(graph):
    def run(g):
        return g.vertex_program().max_iterations(1).add_vertex_column("v", F.lit(0).cast("long"), msg()).add_message(F.lit(1), OUT).add_aggregate_expr(F.sum(msg())).run().df

    assert values(run(graph([1], [(1, 1)])), "v") == {1: 1}
    assert values(run(graph([1, 2], [])), "v") == {1: None, 2: None}


@pytest.mark.parametrize("fuse", [False, True])
def test_named_messages_and_aggregates(graph, fuse):
    p = graph([1, 2, 3], [(1, 2), (1, 3)]).vertex_program().max_iterations(1)
    if fuse:
        p.fuse_messages()
    zero = F.lit(0).cast("long")
    for name, value in (("a", 1), ("b", 10)):
        p.add_vertex_column("v" + name, zero, F.coalesce(msg(name), zero)).add_named_message(name, F.lit(value), OUT).add_named_aggregate_expr(name, F.sum(msg(name)))
    df = p.run().df
    assert values(df, "va") == {1: 0, 2: 1, 3: 1} and values(df, "vb") == {1: 0, 2: 10, 3: 10}


@pytest.mark.parametrize("hubs", HUBS)
def test_ring_of_many_supersteps(graph, hubs):
    n = 100
    ring = [(i, (i + 1) % n) for i in range(n)] + [((i + 1) % n, i) for i in range(n)]
    p = graph(range(n), ring).vertex_program().hub_rows(hubs).max_iterations(40 if hubs is None else 3)
    zero = F.lit(0).cast("long")
    r = p.add_vertex_column("v", zero, F.col("v") + F.coalesce(msg(), zero)).add_message(F.lit(1), BOTH).add_aggregate_expr(F.sum(msg())).run()
    assert r.iterations == (40 if hubs is None else 3)
    assert set(values(r.df, "v").values()) == {4 * r.iterations}


def test_bidirectional_reads_both_states(graph):
    p = graph([1, 2, 3], [(1, 2), (2, 3)]).vertex_program().max_iterations(1)
    r = p.add_vertex_column("v", F.col("id"), msg()).add_message(src("v") * 10 + dst("v"), BOTH).add_aggregate_expr(F.max(msg())).run()
    assert values(r.df, "v") == {1: 12, 2: 23, 3: 23}


def test_edge_columns_parallel_and_dangling_edges(graph):
    g = graph([1, 2], [(1, 2, 0.5), (1, 2, 1.5), (1, 9, 7.0), (9, 2, 7.0)], "weight double")
    r = g.vertex_program().max_iterations(1).add_edge_column("weight").add_vertex_column("v", F.lit(0.0), msg()).add_message(edge("weight"), OUT).add_aggregate_expr(F.sum(msg())).run()
    assert values(r.df, "v") == {1: None, 2: 2.0}


def test_updates_are_simultaneous_and_initial_values_sequential(graph):
    p = graph([1], [(1, 1)]).vertex_program().max_iterations(1)
    r = p.add_vertex_column("a", F.lit(1), F.col("b")).add_vertex_column("b", F.col("a") + 1, F.col("a")).add_message(F.lit(1), OUT).add_aggregate_expr(F.sum(msg())).run()
    assert [tuple(x) for x in r.df.collect()] == [(1, 2, 1)]


@pytest.mark.parametrize("skip", [True, False])
def test_participation(graph, skip):
    """Only vertex 1 takes part at first; with destination state an edge sends if either end does."""
    p = graph([1, 2, 3], [(1, 2), (2, 3), (3, 1)]).vertex_program().max_iterations(1)
    if skip:
        p.skip_dest_state()
    zero = F.lit(0).cast("long")
    r = p.add_vertex_column("n", zero, F.coalesce(msg(), zero)).with_participation_column("on", F.col("id") == 1, F.lit(False)).add_message(F.lit(1), OUT).add_aggregate_expr(F.sum(msg())).run()
    assert values(r.df, "n") == ({1: 0, 2: 1, 3: 0} if skip else {1: 1, 2: 1, 3: 0})


def test_zero_supersteps_and_debug_columns(graph):
    def build():
        return graph([1, 2], [(1, 2)]).vertex_program().add_vertex_column("v", F.lit(5), msg()).with_vertex_voting("active", F.lit(False)).add_message(F.lit(1), OUT).add_aggregate_expr(F.sum(msg()))

    r = build().max_iterations(0).run()
    assert r.iterations == 0 and values(r.df, "v") == {1: 5, 2: 5}
    assert build().max_iterations(0).run(debug=True).df.columns == ["id", "v", "active"]
    assert build().max_iterations(3).run(debug=True).df.columns == ["id", "v", "active"]


def test_undeclared_attributes_disappear(spark):
    from veldt import Graph

    v = spark.createDataFrame([(1, "x")], "id long, name string")
    e = spark.createDataFrame([(1, 1)], "src long, dst long")
    r = Graph(v, e).vertex_program().max_iterations(1).add_vertex_column("v", F.lit(0), F.lit(1)).add_message(F.lit(1), OUT).add_aggregate_expr(F.sum(msg())).run()
    assert r.df.columns == ["id", "v"]


def test_validation(graph):
    g = graph([1], [])
    with pytest.raises(ValueError, match="messages"):
        VertexProgram(g).run()
    with pytest.raises(ValueError, match="aggregates"):
        VertexProgram(g).add_named_message("a", F.lit(1), OUT).add_named_message("b", F.lit(1), OUT).run()
    with pytest.raises(ValueError, match="repeat"):
        VertexProgram(g).add_message(F.lit(1), OUT).run()


def test_duplicates_where_allowed(graph):
    r = graph([1, 2], [(1, 2), (1, 2)]).vertex_program().allow_duplicates().max_iterations(1).add_vertex_column("v", F.lit(0), msg()).add_message(F.lit(7), OUT).run()
    assert sorted(tuple(x) for x in r.df.collect() if x.id == 2) == [(2, 7), (2, 7)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _maximum(g):
    return VertexProgram(g).skip_dest_state().add_vertex_column("v", F.col("id"), F.greatest("v", F.coalesce(msg(), F.col("v")))).add_message(src("v"), OUT).add_aggregate_expr(F.max(msg()))


def test_superstep_has_one_exchange(spark, graph):
    """State and edges stay where they are; only messages move."""
    g = graph(range(50), [(i, (i * 7 + 3) % 50) for i in range(50)])
    own = static_session(spark, 2)
    p, cached, states = _maximum(g), [], Generations(own, cut_every=2)
    edges = p._lay(rebound(g.edges.select(F.col("src").alias("__vp_edge_src"), F.col("dst").alias("__vp_edge_dst")), own), 50, 2, cached)
    state, _ = states.push(rebound(g.vertices, own).withColumn("v", F.col("id")).repartition(2, "id").sortWithinPartitions("id"))
    for _ in range(5):  # cached generations and cuts alike
        step = p._superstep(state, edges)
        assert plan_of(step).count("Exchange") == 1 and plan_of(step).count("SortMergeJoin") == 2
        state, _ = states.push(step)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    states.release()
    assert edges.hub is None and len(cached) == 1


def test_hub_edges_meet_a_broadcast_state(spark, graph):
    """A source with 4 % of the edges is no light key: its edges are not shuffled to one task."""
    edges = [(0, i) for i in range(1, 41)] + [(i % 500, (i * 7 + 3) % 500) for i in range(1, 960)]
    g = graph(range(500), edges)
    e = g.edges.select(F.col("src").alias("__vp_edge_src"), F.col("dst").alias("__vp_edge_dst"))
    assert find_hubs(e, "__vp_edge_src", 1000, 8, 40) == [0]
    own = static_session(spark, 8)
    p, cached, states = _maximum(g).hub_rows(40), [], Generations(own)
    laid = p._lay(rebound(e, own), 1000, 8, cached)
    assert isinstance(laid, LaidEdges) and laid.hubs == (0,) and laid.hub.count() == 41 and laid.light.filter("__vp_edge_src = 0").isEmpty()
    state, _ = states.push(rebound(g.vertices, own).withColumn("v", F.col("id")).repartition(8, "id").sortWithinPartitions("id"))
    plan = plan_of(p._superstep(state, laid))
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("Exchange hashpartitioning") == 1
    states.release()


@pytest.mark.parametrize("skip", [True, False])
def test_hubs_give_the_same_result(graph, skip):
    edges = [(0, i) for i in range(1, 30)] + [(i, 0) for i in range(10, 60)] + [(i, i + 1) for i in range(60)]

    def run(n):
        p = graph(range(62), edges).vertex_program().max_iterations(3).hub_rows(n)
        if skip:
            p.skip_dest_state()
        sent = src("v") if skip else src("v") + dst("v")
        return values(p.add_vertex_column("v", F.col("id"), F.coalesce(msg(), F.lit(0).cast("long"))).add_message(sent, OUT if skip else BOTH).add_aggregate_expr(F.sum(msg())).run().df, "v")

    assert run(None) == run(20) == run(1)


def test_scalar_over_aggregate(graph):
    p = graph([1, 2, 3], [(1, 3), (2, 3), (3, 1)]).vertex_program().max_iterations(1).skip_dest_state()
    r = p.add_vertex_column("n", F.lit(0), F.coalesce(msg(), F.lit(-1))).add_message(src("id"), OUT).add_aggregate_expr(F.size(F.collect_list(msg())) * 10)
    assert values(r.run().df, "n") == {1: 10, 2: -1, 3: 20}


def test_intermediates_are_deleted(spark, graph):
    import pathlib

    root = pathlib.Path(shared_dir(spark).replace("file://", "")) / "veldt"
    before = set(root.iterdir()) if root.exists() else set()
    with intermediates():
        assert values(_maximum(graph([1, 2], [(2, 1)])).max_iterations(7).run().df, "v") == {1: 2, 2: 2}
        assert graph([1, 2], [(2, 1)]).connected_components().run().df.count() == 2
        assert len(set(root.iterdir()) - before) == 2
    assert set(root.iterdir()) == before


def test_checkpoint_folder_and_output_of_a_program(spark, graph, tmp_path):
    kept, out = f"file://{tmp_path}/kept", f"file://{tmp_path}/out"
    p = _maximum(graph([1, 2], [(2, 1)])).max_iterations(1).checkpoint_dir(kept)
    assert values(p.run(output=out).df, "v") == {1: 2, 2: 2} and values(spark.read.parquet(out), "v") == {1: 2, 2: 2}
    assert list((tmp_path / "kept" / "veldt").iterdir())
    with pytest.raises(ValueError, match="overlap"):
        p.run(output=f"{kept}/result")


def test_failing_superstep_releases_the_cache(spark, graph):
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    p = graph([1], [(1, 1)]).vertex_program().max_iterations(2).add_vertex_column("v", F.lit(1), F.raise_error(F.lit("no"))).add_message(F.lit(1), OUT).add_aggregate_expr(F.sum(msg()))
    with pytest.raises(Exception, match="no"):
        p.run()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_store_retention(spark):
    s = StateStore(spark)
    df = spark.range(10)
    for _ in range(4):
        s.push(df)
    s.evict(1)
    assert len(s) == 3
    s.remove_last(1)
    s.evict_all_but_latest(1)
    assert len(s) == 1
    s.evict(5)
    s.evict(1)
    assert len(s) == 0


def test_output_must_not_overlap_checkpoints():
    validate_output("file:///a/out", "/a/kept")
    for out, kept in (("/a/b", "/a"), ("/a", "/a/b"), ("/a/", "file:///a")):
        with pytest.raises(ValueError, match="overlap"):
            validate_output(out, kept)
