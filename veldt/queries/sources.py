"""Queries of sources, sinks, the command line and the keeping of intermediates, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.cli import main, size_in_bytes
from veldt.functions.gf64 import affine_column
from veldt.graph import Graph
from veldt.plans.materialize import Scratch, StateStore, delete_path, validate_output
from veldt.plans.vertex_program import MessageDirection, edge, msg, src
from veldt.queries.graph import LINKS_SQL
from veldt.queries.graph import SQL as _GRAPH_SQL
from veldt.sources.derived import links
from veldt.sources.graphs import list_files, parse_properties, read_delimited_graph, read_graph, write_bucketed, write_result
from veldt.sources.tables import table

_SIZES = ("1g", "2GB", "3gib", "4m", "5MB", "6mib")
_PROPERTIES = "# a graph\ngraph.name = small\n\ngraph.directed=true\n graph.bfs.source-vertex = 1 \nnot a pair\n"


def _finite(df: DataFrame) -> DataFrame:
    """(src, dst, weight): extreme weights that are no numbers have no common text form and become null."""
    w = F.col("weight")
    return df.select("src", "dst", F.when(~F.isnan(w) & (F.abs(w) < F.lit(float("inf"))), w).alias("weight"))


def _round_trip(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """Vertices and edges under other column names to ``fmt`` and back, weighted and symmetrised."""
    scratch = Scratch(spark, fmt)
    g = links(spark, d)
    v, e = f"{scratch.root}/v", f"{scratch.root}/e"
    edges = _finite(g.edges).select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("weight").alias("cost"))
    for df, path in ((g.vertices.select(F.col("id").alias("node")), v), (edges, e)):
        writer = df.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
    schemas = {} if fmt == "parquet" else {"vertex_schema": "node long", "edge_schema": "from long, to long, cost double"}
    back = read_graph(spark, v, e, fmt, id_col="node", src_col="from", dst_col="to", weighted=True, weight_col="cost", symmetrize=True, **schemas)
    return back.edges.groupBy("src", "dst", F.col("cost").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def source_parquet(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "parquet")


def source_csv(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "csv")


def source_json(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "json")


def source_delimited(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "delimited")
    g = links(spark, d)
    v, e = f"{scratch.root}/v", f"{scratch.root}/e"
    g.vertices.write.csv(v, sep=" ")
    _finite(g.edges).write.csv(e, sep=" ")
    return read_delimited_graph(spark, v, e, weighted=True).edges.groupBy("src", "dst", F.col("weights").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def source_in_memory(spark: SparkSession, d: str) -> DataFrame:
    """A graph of rows given in the program."""
    g = Graph(spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "src long, dst long"))
    return g.out_degrees(include_zero=True)


def source_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Edges hash-partitioned and sorted by source, counted by it."""
    name = f"veldt_links_{uuid.uuid4().hex}"
    bucketed = write_bucketed(links(spark, d).edges.select("src", "dst"), name, "src", 8)
    counted = Scratch(spark, "bucketed").write(bucketed.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("out_degree")), "counted")
    spark.sql(f"DROP TABLE {name}")
    return counted


def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """Whether a written result has files, and how many are left once it is deleted."""
    path = f"{Scratch(spark, 'listing').root}/result"
    write_result(links(spark, d).vertices, path)
    some = any(f.endswith(".parquet") for f in list_files(spark, path))
    delete_path(spark, path)
    return spark.createDataFrame([(some, len(list_files(spark, path)))], "written boolean, remaining int")


def source_properties(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(parse_properties(_PROPERTIES).items()), "name string, value string")


def state_retention(spark: SparkSession, d: str) -> DataFrame:
    """Generations kept after each step, and the rows of the one that stays."""
    store, kept, ids = StateStore(spark), [], links(spark, d).vertices
    for k in range(4):
        latest = store.push(ids.withColumn("generation", F.lit(k)))
    kept.append(len(store))
    store.evict(1)
    kept.append(len(store))
    store.evict_all_but_latest(1)
    kept.append(len(store))
    out = Scratch(spark, "retention").write(latest.groupBy("generation").agg(F.count(F.lit(1)).alias("n")), "latest")
    store.remove_last()
    kept.append(len(store))
    store.purge()
    return out.select("generation", "n", F.lit(",".join(map(str, kept))).alias("kept"))


def size_parser(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s, size_in_bytes(s)) for s in _SIZES], "size string, bytes long")


def output_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether an output folder is refused beside, within and around the checkpoints' folder."""

    def refused(output: str) -> bool:
        try:
            validate_output(output, "/a/kept")
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(p, refused(p)) for p in ("/a/out", "/a/kept/out", "/a")], "output string, refused boolean")


def cli_page_rank(spark: SparkSession, d: str) -> DataFrame:
    """The command line on parquet files of the whole edges table."""
    root, g = Scratch(spark, "cli").root, links(spark, d)
    g.vertices.write.parquet(f"{root}/v")
    g.edges.select("src", "dst").write.parquet(f"{root}/e")
    # the output lies beside the engine's own folder
    out = root.replace("/veldt/", "/veldt-out/")
    argv = ["page-rank", "--vertices", f"{root}/v", "--edges", f"{root}/e", "--output", out, "--max-iter", "10", "--tol", "0", "--no-output-check"]
    main(argv, spark)
    found = Scratch(spark, "cli-result").write(spark.read.parquet(out).select("id", F.round("pagerank", 9).alias("pagerank")), "found")
    delete_path(spark, out)
    return found


def vertex_program_edge_column(spark: SparkSession, d: str) -> DataFrame:
    """The largest finite weight of a vertex's in-edges."""
    g = links(spark, d)
    g = Graph(g.vertices, _finite(g.edges))
    p = g.vertex_program().max_iterations(1).skip_dest_state().add_edge_column("weight")
    return p.add_vertex_column("heaviest", F.lit(None).cast("double"), msg()).add_message(edge("weight"), MessageDirection.SRC_TO_DST).add_aggregate_expr(F.max(msg())).run().df


def vertex_program_either_end(spark: SparkSession, d: str) -> DataFrame:
    """In-edges with an even id at either end."""
    p = links(spark, d).vertex_program().max_iterations(1)
    zero = F.lit(0).cast("long")
    p.add_vertex_column("n", zero, F.coalesce(msg(), zero)).with_participation_column("even", F.col("id") % 2 == 0, F.lit(True))
    return p.add_message(F.lit(1), MessageDirection.SRC_TO_DST).add_aggregate_expr(F.sum(msg())).run().df


def vertex_program_scalar(spark: SparkSession, d: str) -> DataFrame:
    """A scalar over two aggregates of the messages."""
    p = links(spark, d).vertex_program().max_iterations(1).skip_dest_state()
    p.add_vertex_column("v", F.lit(0).cast("long"), F.coalesce(msg(), F.lit(-1).cast("long")))
    return p.add_message(src("id"), MessageDirection.SRC_TO_DST).add_aggregate_expr(F.max(msg()) - F.min(msg()) + 2 * F.count(msg())).run().df


def gf64_product(spark: SparkSession, d: str) -> DataFrame:
    """37 x in the field, of x that reach the highest bits, so that the product is reduced."""
    k = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    x = F.shiftleft("o_orderkey", 41).bitwiseXOR(F.shiftleft("o_custkey", 53)).bitwiseXOR(F.col("o_orderkey"))
    return k.select("o_orderkey", x.alias("x"), affine_column(37, x, 0).alias("product"))


QUERIES = {
    f.__name__: f
    for f in (
        source_parquet, source_csv, source_json, source_delimited, source_in_memory, source_bucketed, source_listing, source_properties,
        state_retention, size_parser, output_checks, cli_page_rank,
        vertex_program_edge_column, vertex_program_either_end, vertex_program_scalar, gf64_product,
    )
}

_E = f"WITH {LINKS_SQL}, f AS (SELECT src, dst, CASE WHEN NOT isnan(weight) AND NOT isinf(weight) THEN weight END AS weight FROM e)"
_BOTH = _E + " SELECT src, dst, weight, count(*) AS n FROM (SELECT src, dst, weight FROM f UNION ALL SELECT dst, src, weight FROM f) x GROUP BY src, dst, weight"
_TWO64, _TWO63 = 2**64, 2**63


def _doubled(x: str, times: int) -> str:
    """x times 2 in the field, repeatedly, of unsigned numbers held in 128 bits."""
    for _ in range(times):
        x = f"xor(({x}) * 2 % {_TWO64}::HUGEINT, CASE WHEN ({x}) >= {_TWO63}::HUGEINT THEN 27::HUGEINT ELSE 0::HUGEINT END)"
    return x


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= {_TWO63}::HUGEINT THEN {x} - {_TWO64}::HUGEINT ELSE {x} END AS BIGINT)"


SQL = {
    "source_parquet": _BOTH,
    "source_csv": _BOTH,
    "source_json": _BOTH,
    "source_delimited": _E + " SELECT src, dst, weight, count(*) AS n FROM f GROUP BY src, dst, weight",
    "source_in_memory": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(3 AS BIGINT)), (2, 0), (3, 0)) x(id, out_degree)",
    "source_bucketed": f"WITH {LINKS_SQL} SELECT src AS id, count(*) AS out_degree FROM e GROUP BY src",
    "source_listing": "SELECT true AS written, CAST(0 AS INTEGER) AS remaining",
    "source_properties": "SELECT * FROM (VALUES ('graph.name', 'small'), ('graph.directed', 'true'), ('graph.bfs.source-vertex', '1')) x(name, value)",
    "state_retention": f"WITH {LINKS_SQL} SELECT CAST(3 AS INTEGER) AS generation, count(*) AS n, '4,3,1,0' AS kept FROM v",
    "size_parser": "SELECT * FROM (VALUES ('1g', CAST(1073741824 AS BIGINT)), ('2GB', 2147483648), ('3gib', 3221225472), ('4m', 4194304), ('5MB', 5242880), ('6mib', 6291456)) x(size, bytes)",
    "output_checks": "SELECT * FROM (VALUES ('/a/out', false), ('/a/kept/out', true), ('/a', true)) x(output, refused)",
    "cli_page_rank": _GRAPH_SQL["links_pagerank_fixed"],
    "vertex_program_edge_column": _E + " SELECT v.id, x.w AS heaviest FROM v LEFT JOIN (SELECT dst, max(weight) AS w FROM f GROUP BY dst) x ON x.dst = v.id",
    "vertex_program_either_end": f"WITH {LINKS_SQL} SELECT v.id, coalesce(x.n, 0) AS n FROM v LEFT JOIN (SELECT dst, count(*) AS n FROM e WHERE src % 2 = 0 OR dst % 2 = 0 GROUP BY dst) x ON x.dst = v.id",
    "vertex_program_scalar": f"WITH {LINKS_SQL} SELECT v.id, coalesce(x.v, -1) AS v FROM v LEFT JOIN (SELECT dst, max(src) - min(src) + 2 * count(*) AS v FROM e GROUP BY dst) x ON x.dst = v.id",
    "gf64_product": f"""
WITH u AS (SELECT o_orderkey, xor(xor(o_orderkey::HUGEINT * {2**41} % {_TWO64}::HUGEINT, o_custkey::HUGEINT * {2**53} % {_TWO64}::HUGEINT), o_orderkey::HUGEINT) AS x FROM orders),
p AS (SELECT o_orderkey, x, xor(xor({_doubled("x", 2)}, x), {_doubled("x", 5)}) AS y FROM u)
SELECT o_orderkey, {_signed("x")} AS x, {_signed("y")} AS product FROM p""",
}
