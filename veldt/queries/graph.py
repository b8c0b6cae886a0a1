"""Queries of the graph operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.gf64 import affine_column
from veldt.functions.reducers import h_index, hll_estimate, hll_union, hll_union_agg, mode_min
from veldt.graph import Graph, simple_arcs
from veldt.plans.vertex_program import MessageDirection, dst, msg, src
from veldt.sources.derived import event_chain, links, parts_seq, trade
from veldt.sources.tables import table

LANDMARKS = (7, 94)
#: of the whole edges table: one that reaches much of it, and a hub that much of it reaches
LINKS_LANDMARKS = (501, 39)
Source = Callable[[SparkSession, str], Graph]
A, B = 0x1234567890ABCDEF, 0x0FEDCBA987654321


def num_nodes(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return spark.createDataFrame([(graph(spark, d).num_nodes(),)], "nodes long")


def num_edges(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return spark.createDataFrame([(graph(spark, d).num_edges(),)], "edges long")


def in_degrees(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).in_degrees()


def in_degrees_zero(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).in_degrees(include_zero=True)


def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).out_degrees()


def out_degrees_zero(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).out_degrees(include_zero=True)


def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).symmetrize().edges.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("n"))


def symmetrize_simple(spark: SparkSession, d: str) -> DataFrame:
    return simple_arcs(links(spark, d).edges.select("src", "dst"))


def triplets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select("src", "dst", "relation")
    v = table(spark, d, "vertices").filter("id IS NOT NULL").groupBy("id").agg(F.min("name").alias("name"))
    t = Graph(v, e).triplets()
    return t.groupBy(F.col("src_vertex.name").alias("src_name"), F.col("edge.relation").alias("relation"), F.col("dst_vertex").isNull().alias("dangling")).agg(F.count(F.lit(1)).alias("n"))


def vertex_program_in_degree(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    p = graph(spark, d).vertex_program().max_iterations(1).skip_dest_state()
    return p.add_vertex_column("degree", F.lit(0).cast("long"), F.coalesce(msg(), F.lit(0).cast("long"))).add_message(F.lit(1), MessageDirection.SRC_TO_DST).add_aggregate_expr(F.sum(msg())).run().df


def vertex_program_out_degree(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    p = graph(spark, d).vertex_program().max_iterations(1)
    return p.add_vertex_column("degree", F.lit(0).cast("long"), F.coalesce(msg(), F.lit(0).cast("long"))).add_message(F.lit(1), MessageDirection.DST_TO_SRC).add_aggregate_expr(F.sum(msg())).run().df


def vertex_program_named_messages(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    p = graph(spark, d).vertex_program().max_iterations(1)
    zero = F.lit(0).cast("long")
    return (
        p.add_vertex_column("key", F.col("id"), F.col("key"))
        .add_vertex_column("largest_source", zero, msg("from"))
        .add_vertex_column("smallest_target", zero, msg("to"))
        .add_vertex_column("messages", zero, F.coalesce(msg("all"), zero))
        .add_named_message("from", src("key"), MessageDirection.SRC_TO_DST)
        .add_named_message("to", dst("key"), MessageDirection.DST_TO_SRC)
        .add_named_aggregate_expr("from", F.max(msg("from")))
        .add_named_aggregate_expr("to", F.min(msg("to")))
        .add_named_aggregate_expr("all", F.count(F.lit(1)))
        .run()
        .df
    )


def vertex_program_bidirectional(spark: SparkSession, d: str, graph: Source = trade) -> DataFrame:
    p = graph(spark, d).vertex_program().max_iterations(2)
    one = F.lit(1).cast("long")
    return p.add_vertex_column("walks", one, F.coalesce(msg(), F.lit(0).cast("long"))).add_message(src("walks") + dst("walks"), MessageDirection.BIDIRECTIONAL).add_aggregate_expr(F.sum(msg())).run().df


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("pagerank", 9).alias("pagerank"))


def pagerank_fixed(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return _ranked(graph(spark, d).pagerank().max_iter(10).tol(0.0).run().df)


def pagerank_pruned(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return _ranked(graph(spark, d).pagerank().max_iter(8).tol(0.01).run().df)


def pagerank_converged(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return _ranked(graph(spark, d).pagerank().tol(0.01).run().df)


def shortest_paths(spark: SparkSession, d: str, graph: Source = parts_seq, landmarks: tuple[int, ...] = LANDMARKS) -> DataFrame:
    return graph(spark, d).shortest_paths(list(landmarks)).run().df


def shortest_paths_to(spark: SparkSession, d: str, graph: Source = parts_seq, landmarks: tuple[int, ...] = LANDMARKS) -> DataFrame:
    return graph(spark, d).shortest_paths(list(landmarks)).to_landmarks().run().df


def kcore(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).k_core().run().df


def kcore_dense(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d, dense=True).k_core().run().df


def label_propagation(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).label_propagation().max_iter(5).run().df


def label_propagation_directed(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).label_propagation().bidirectional(False).max_iter(4).run().df


def wcc(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).connected_components().run().df


def wcc_chains(spark: SparkSession, d: str) -> DataFrame:
    return event_chain(spark, d).connected_components().run().df


def wcc_partition(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    x = graph(spark, d).connected_components().use_labels(False).run().df
    return x.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def hyperanf_hops2(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).hyperanf().n_hops(2).run().df


def hyperanf_undirected(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    return graph(spark, d).hyperanf().n_hops(1).directed(False).run().df


def mis_invariants(spark: SparkSession, d: str, graph: Source = parts_seq) -> DataFrame:
    """Members linked with each other, and vertices that are neither members nor linked with one: none."""
    g = graph(spark, d)
    members = g.maximal_independent_set().run().df
    arcs = simple_arcs(g.edges)
    a = members.select(F.col("id").alias("src"))
    b = members.select(F.col("id").alias("dst"))
    clash = arcs.join(a, "src", "left_semi").join(b, "dst", "left_semi").agg(F.count(F.lit(1)).alias("not_independent"))
    near = arcs.join(b, "dst", "left_semi").select(F.col("src").alias("id")).union(members)
    bare = g.vertices.join(near, "id", "left_anti").agg(F.count(F.lit(1)).alias("not_maximal"))
    return clash.crossJoin(F.broadcast(bare))  # a row each


def gf64_affine(spark: SparkSession, d: str) -> DataFrame:
    """h(x) is linear over bits: h(x) ^ h(y) ^ h(0) = h(x ^ y), and the map of a = 1 only adds b."""
    k = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    x, y = F.col("o_orderkey"), F.col("o_custkey")
    h = lambda c: affine_column(A, c, B)
    linear = h(x).bitwiseXOR(h(y)).bitwiseXOR(h(F.lit(0).cast("long"))) == h(x.bitwiseXOR(y))
    return k.select("o_orderkey", affine_column(1, x, B).alias("added"), affine_column(2, x, 0).alias("doubled"), linear.alias("linear"))


def h_index_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(h_index(F.collect_list(F.col("l_quantity").cast("int"))).alias("h"))


def mode_supplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(mode_min(F.col("l_suppkey")).alias("supplier"))


def hll_parts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers per part, estimated from the union of singleton sketches; exact at this size."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    sketches = pairs.groupBy("l_partkey", "l_suppkey").agg(F.hll_sketch_agg("l_suppkey", F.lit(12)).alias("s"))
    return sketches.groupBy("l_partkey").agg(hll_union_agg(F.col("s")).alias("u")).select("l_partkey", hll_estimate(hll_union(F.col("u"), F.col("u"))).alias("suppliers"))


QUERIES = {
    f.__name__: f
    for f in (
        num_nodes, num_edges, in_degrees, in_degrees_zero, out_degrees, out_degrees_zero, symmetrize, symmetrize_simple, triplets,
        vertex_program_in_degree, vertex_program_out_degree, vertex_program_named_messages, vertex_program_bidirectional,
        pagerank_fixed, pagerank_pruned, pagerank_converged, shortest_paths, shortest_paths_to, kcore, kcore_dense,
        label_propagation, label_propagation_directed, wcc, wcc_chains, wcc_partition, hyperanf_hops2, hyperanf_undirected, mis_invariants,
        gf64_affine, h_index_sizes, mode_supplier, hll_parts,
    )
}

#: The operators that above run on graphs of filtered rows, over every row of the edges table.
QUERIES |= {
    f"links_{f.__name__}": partial(f, graph=links)
    for f in (
        num_nodes, num_edges, in_degrees, in_degrees_zero, vertex_program_in_degree, vertex_program_out_degree, vertex_program_named_messages, vertex_program_bidirectional,
        pagerank_fixed, pagerank_pruned, pagerank_converged, kcore, label_propagation, label_propagation_directed, wcc, wcc_partition, hyperanf_hops2, hyperanf_undirected, mis_invariants,
    )
} | {f"links_{f.__name__}": partial(f, graph=links, landmarks=LINKS_LANDMARKS) for f in (shortest_paths, shortest_paths_to)}

_PARTS = """
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_quantity >= 45),
e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1 WHERE a.l_partkey <> b.l_partkey),
v AS MATERIALIZED (SELECT p_partkey AS id FROM part)"""
_TRADE = """
e AS MATERIALIZED (SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {where}),
v AS MATERIALIZED (SELECT c_custkey AS id FROM customer UNION ALL SELECT 1000000 + s_suppkey FROM supplier)"""
_SPARSE, _DENSE = _TRADE.format(where="l_quantity >= 49 AND l_discount >= 0.08"), _TRADE.format(where="true")
_CHAIN = """
e AS MATERIALIZED (SELECT * FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) x WHERE dst IS NOT NULL),
v AS MATERIALIZED (SELECT event_id AS id FROM events)"""
LINKS_SQL = """
e AS MATERIALIZED (SELECT src, dst, weight, relation FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT id FROM vertices WHERE id IS NOT NULL)"""


def _degree(key: str, name: str) -> str:
    return f"SELECT {key} AS id, count(*) AS {name} FROM e GROUP BY {key}"


def _degree_zero(key: str, name: str) -> str:
    return f"SELECT v.id, coalesce(x.n, 0) AS {name} FROM v LEFT JOIN (SELECT {key} AS id, count(*) AS n FROM e GROUP BY {key}) x ON x.id = v.id"


def _pagerank(rounds: int, tol: float, graph: str = _PARTS) -> str:
    return f"""
WITH RECURSIVE {graph},
o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src),
pr(i, id, pr, delta, act) AS (
  SELECT 0, id, CAST(0.15 AS DOUBLE), CAST(0.15 AS DOUBLE), true FROM v
  UNION ALL
  SELECT x.i + 1, x.id, x.pr + 0.85 * coalesce(m.s, 0), 0.85 * coalesce(m.s, 0), 0.85 * coalesce(m.s, 0) > {tol}
  FROM pr x LEFT JOIN (SELECT e.dst, sum(y.delta / o.n) AS s FROM pr y JOIN e ON e.src = y.id JOIN o ON o.src = y.id WHERE y.act GROUP BY e.dst) m ON m.dst = x.id
  WHERE x.i < {rounds})
SELECT id, round(pr / (SELECT sum(pr) FROM pr WHERE i = {rounds}), 9) AS pagerank FROM pr WHERE i = {rounds}"""


def _paths(reverse: bool) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    out = [f"WITH RECURSIVE {_PARTS}"]
    for x in LANDMARKS:
        out.append(f"b{x}(id, d) AS (SELECT id, 0 FROM v WHERE id = {x} UNION SELECT e.{b}, b{x}.d + 1 FROM b{x} JOIN e ON e.{a} = b{x}.id JOIN v ON v.id = e.{b} WHERE b{x}.d < 60)")
        out.append(f"m{x} AS (SELECT id, min(d) AS d FROM b{x} GROUP BY id)")
    joins = " ".join(f"LEFT JOIN m{x} ON m{x}.id = v.id" for x in LANDMARKS)
    columns = ", ".join(f"CAST(coalesce(m{x}.d, 2147483647) AS INTEGER) AS dist_{x}" for x in LANDMARKS)
    return ",\n".join(out) + f"\nSELECT v.id, {columns} FROM v {joins}"


def _kcore(graph: str, rounds: int) -> str:
    out = [f"WITH {graph}", "s AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)", "k0 AS MATERIALIZED (SELECT v.id, coalesce(x.n, 0) AS k FROM v LEFT JOIN (SELECT src, count(*) AS n FROM s GROUP BY src) x ON x.src = v.id)"]
    for i in range(rounds):
        ranked = f"SELECT s.dst AS id, q.k, row_number() OVER (PARTITION BY s.dst ORDER BY q.k DESC) AS rn FROM s JOIN k{i} q ON q.id = s.src"
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT v.id, coalesce(x.h, 0) AS k FROM v LEFT JOIN (SELECT id, count(*) AS h FROM ({ranked}) y WHERE k >= rn GROUP BY id) x ON x.id = v.id)")
    return ",\n".join(out) + f"\nSELECT id, CAST(k AS INTEGER) AS kcore FROM k{rounds}"


def _labels(rounds: int, both: bool, graph: str = _PARTS) -> str:
    arcs = "SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst" if both else "SELECT src, dst FROM e"
    out = [f"WITH {graph}", f"s AS MATERIALIZED ({arcs})", "l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"]
    for i in range(rounds):
        counts = f"SELECT s.dst AS id, q.label, count(*) AS n FROM s JOIN l{i} q ON q.id = s.src GROUP BY s.dst, q.label"
        best = f"SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM ({counts}) c"
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT q.id, coalesce(b.label, q.label) AS label FROM l{i} q LEFT JOIN (SELECT * FROM ({best}) x WHERE rn = 1) b ON b.id = q.id)")
    return ",\n".join(out) + f"\nSELECT id, label AS community FROM l{rounds}"


_COMPONENTS = """s AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach(id, label) AS (SELECT id, id FROM v UNION SELECT s.dst, reach.label FROM reach JOIN s ON s.src = reach.id WHERE reach.label < s.dst),
c AS (SELECT v.id, min(reach.label) AS component FROM v JOIN reach ON reach.id = v.id GROUP BY v.id)"""
#: a chain's component is its user's smallest event
_CHAINS = "SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS component FROM events"

SQL = {
    "num_nodes": f"WITH {_PARTS} SELECT count(*) AS nodes FROM v",
    "num_edges": f"WITH {_PARTS} SELECT count(*) AS edges FROM e",
    "in_degrees": f"WITH {_PARTS} " + _degree("dst", "in_degree"),
    "in_degrees_zero": f"WITH {_PARTS} " + _degree_zero("dst", "in_degree"),
    "out_degrees": f"WITH {LINKS_SQL} " + _degree("src", "out_degree"),
    "out_degrees_zero": f"WITH {LINKS_SQL} " + _degree_zero("src", "out_degree"),
    "symmetrize": f"WITH {LINKS_SQL} SELECT src, dst, relation, count(*) AS n FROM (SELECT src, dst, relation FROM e UNION ALL SELECT dst, src, relation FROM e) x GROUP BY src, dst, relation",
    "symmetrize_simple": f"WITH {LINKS_SQL} SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst",
    "triplets": """WITH n AS (SELECT id, min(name) AS name FROM vertices WHERE id IS NOT NULL GROUP BY id)
SELECT a.name AS src_name, edges.relation, b.id IS NULL AS dangling, count(*) AS n FROM edges LEFT JOIN n a ON a.id = edges.src LEFT JOIN n b ON b.id = edges.dst GROUP BY a.name, edges.relation, b.id IS NULL""",
    "vertex_program_in_degree": f"WITH {_PARTS} " + _degree_zero("dst", "degree"),
    "vertex_program_out_degree": f"WITH {_PARTS} " + _degree_zero("src", "degree"),
    "vertex_program_named_messages": f"""WITH {_PARTS}
SELECT v.id, v.id AS key, i.m AS largest_source, o.m AS smallest_target, coalesce(i.n, 0) + coalesce(o.n, 0) AS messages FROM v
LEFT JOIN (SELECT dst, max(src) AS m, count(*) AS n FROM e GROUP BY dst) i ON i.dst = v.id LEFT JOIN (SELECT src, min(dst) AS m, count(*) AS n FROM e GROUP BY src) o ON o.src = v.id""",
    "vertex_program_bidirectional": f"""WITH {_SPARSE},
s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
w1 AS MATERIALIZED (SELECT v.id, 2 * coalesce(x.n, 0) AS w FROM v LEFT JOIN (SELECT src, count(*) AS n FROM s GROUP BY src) x ON x.src = v.id)
SELECT v.id, CAST(coalesce(x.w, 0) AS BIGINT) AS walks FROM v LEFT JOIN (SELECT s.src, sum(a.w + b.w) AS w FROM s JOIN w1 a ON a.id = s.src JOIN w1 b ON b.id = s.dst GROUP BY s.src) x ON x.src = v.id""",
    "pagerank_fixed": _pagerank(10, 0.0),
    "pagerank_pruned": _pagerank(8, 0.01),
    "pagerank_converged": _pagerank(40, 0.01),
    "shortest_paths": _paths(False),
    "shortest_paths_to": _paths(True),
    "kcore": _kcore(_PARTS, 20),
    "kcore_dense": _kcore(_DENSE, 12),
    "label_propagation": _labels(5, True),
    "label_propagation_directed": _labels(4, False),
    "wcc": f"WITH RECURSIVE {_PARTS}, {_COMPONENTS} SELECT id, component FROM c",
    "wcc_chains": _CHAINS,
    "wcc_partition": f"WITH RECURSIVE {_PARTS}, {_COMPONENTS} SELECT size, count(*) AS components FROM (SELECT component, count(*) AS size FROM c GROUP BY component) x GROUP BY size",
    "hyperanf_hops2": f"""WITH {_PARTS}, b AS (SELECT id, id AS o FROM v UNION SELECT dst, src FROM e UNION SELECT y.dst, x.src FROM e x JOIN e y ON y.src = x.dst)
SELECT id, CAST(count(DISTINCT o) AS DOUBLE) AS neighborhood_size FROM b GROUP BY id""",
    "hyperanf_undirected": f"""WITH {_PARTS}, b AS (SELECT id, id AS o FROM v UNION SELECT dst, src FROM e UNION SELECT src, dst FROM e)
SELECT id, CAST(count(DISTINCT o) AS DOUBLE) AS neighborhood_size FROM b GROUP BY id""",
    "mis_invariants": "SELECT 0 AS not_independent, 0 AS not_maximal",
    "gf64_affine": f"SELECT o_orderkey, xor(o_orderkey, CAST({B} AS BIGINT)) AS added, 2 * o_orderkey AS doubled, true AS linear FROM orders",
    "h_index_sizes": """SELECT o.l_orderkey, CAST(coalesce(x.h, 0) AS INTEGER) AS h FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN
(SELECT l_orderkey, count(*) AS h FROM (SELECT l_orderkey, CAST(floor(l_quantity) AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rn FROM lineitem) y WHERE q >= rn GROUP BY l_orderkey) x ON x.l_orderkey = o.l_orderkey""",
    "mode_supplier": """SELECT l_partkey, l_suppkey AS supplier FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rn
FROM lineitem GROUP BY l_partkey, l_suppkey) x WHERE rn = 1""",
    "hll_parts": "SELECT l_partkey, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS suppliers FROM lineitem GROUP BY l_partkey",
}
# the same over the whole edges table; paths, components, k-core and neighbourhoods are out of reach there
SQL |= {
    f"links_{name}": SQL[name].replace(_PARTS, LINKS_SQL)
    for name in ("num_nodes", "num_edges", "in_degrees", "in_degrees_zero", "vertex_program_in_degree", "vertex_program_out_degree", "vertex_program_named_messages", "mis_invariants")
} | {
    "links_vertex_program_bidirectional": SQL["vertex_program_bidirectional"].replace(_SPARSE, LINKS_SQL),
    "links_pagerank_fixed": _pagerank(10, 0.0, LINKS_SQL),
    "links_pagerank_pruned": _pagerank(8, 0.01, LINKS_SQL),
    "links_label_propagation": _labels(5, True, LINKS_SQL),
    "links_label_propagation_directed": _labels(4, False, LINKS_SQL),
}
