"""Command line: ``python -m veldt ALGORITHM --vertices V --edges E --output O``.

Options that size the run may also come from the environment (VELDT_MAX_MEMORY, VELDT_WORKERS,
VELDT_CHECKPOINT_DIR); a flag wins, then the environment, then the default.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from veldt.plans.materialize import shared_dir, validate_output
from veldt.sources.graphs import FORMATS, read_graph, write_result


def size_in_bytes(text: str) -> int:
    """``<digits><unit>`` with the unit g, gb, gib, m, mb or mib; the unit is needed."""
    found = re.fullmatch(r"(\d+)(g|gb|gib|m|mb|mib)", text.strip().lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) << (30 if found[2][0] == "g" else 20)


def _parser() -> argparse.ArgumentParser:
    env = os.environ.get
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--vertices", required=True)
    common.add_argument("--edges", required=True)
    common.add_argument("--output", required=True)
    common.add_argument("--format", choices=FORMATS, default="parquet")
    common.add_argument("--id-col-name", default="id")
    common.add_argument("--src-col-name", default="src")
    common.add_argument("--dst-col-name", default="dst")
    common.add_argument("--vertex-schema", help="columns and types, say 'id long'; without it text formats are read twice")
    common.add_argument("--edge-schema", help="columns and types, say 'src long, dst long'")
    common.add_argument("--no-output-check", action="store_true", help="allow an output folder beside intermediates")
    common.add_argument("--symmetrize", action="store_true")
    common.add_argument("--weighted", action="store_true")
    common.add_argument("--weight-col-name", default="weight")
    common.add_argument("--max-memory", default=env("VELDT_MAX_MEMORY", "4G"), help="driver memory of a local session")
    common.add_argument("--num-workers", type=int, default=int(env("VELDT_WORKERS", "2")), help="cores of a local session")
    common.add_argument("--checkpoint-dir", default=env("VELDT_CHECKPOINT_DIR"))
    p = argparse.ArgumentParser(prog="veldt", description=__doc__)
    sub = p.add_subparsers(dest="algorithm", required=True)
    add = lambda name: sub.add_parser(name, parents=[common])
    x = add("page-rank")
    x.add_argument("--max-iter", type=int, default=0)
    x.add_argument("--reset-prob", type=float, default=0.15)
    x.add_argument("--tol", type=float, required=True)
    x = add("wcc")
    x.add_argument("--seed", type=int, required=True)
    x.add_argument("--raw-labels", action="store_true")
    x = add("mis")
    x.add_argument("--seed", type=int, default=42)
    add("kcore").add_argument("--max-iter", type=int, default=0)
    x = add("hyperanf")
    x.add_argument("--n-hops", type=int, required=True)
    x.add_argument("--lg-k", type=int, default=12)
    x.add_argument("--undirected", action="store_true")
    x = add("shortest-path")
    x.add_argument("--landmark", type=int, action="append", required=True)
    x.add_argument("--to-landmarks", action="store_true")
    x.add_argument("--max-iter", type=int)
    x = add("classical-lp")
    x.add_argument("--max-iter", type=int, default=10)
    x.add_argument("--as-given", action="store_true", help="use edges in their direction only")
    return p


def _run(graph, a):
    if a.algorithm == "page-rank":
        return graph.pagerank().max_iter(a.max_iter).reset_prob(a.reset_prob).tol(a.tol).run()
    if a.algorithm == "wcc":
        return graph.connected_components().seed(a.seed).use_labels(not a.raw_labels).run()
    if a.algorithm == "mis":
        return graph.maximal_independent_set().seed(a.seed).run()
    if a.algorithm == "kcore":
        return graph.k_core().max_iter(a.max_iter).run()
    if a.algorithm == "hyperanf":
        return graph.hyperanf().n_hops(a.n_hops).lg_k(a.lg_k).directed(not a.undirected).run()
    if a.algorithm == "shortest-path":
        paths = graph.shortest_paths(a.landmark).to_landmarks(a.to_landmarks)
        return (paths if a.max_iter is None else paths.max_iterations(a.max_iter)).run()
    return graph.label_propagation().bidirectional(not a.as_given).max_iter(a.max_iter).run()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName(f"veldt {a.algorithm}")
        if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
            builder = builder.master(f"local[{a.num_workers}]").config("spark.driver.memory", f"{size_in_bytes(a.max_memory) >> 20}m")
        if a.checkpoint_dir:
            builder = builder.config("spark.checkpoint.dir", a.checkpoint_dir)
        spark = builder.getOrCreate()
    if not a.no_output_check:
        validate_output(a.output, shared_dir(spark))
    graph = read_graph(
        spark,
        a.vertices,
        a.edges,
        a.format,
        id_col=a.id_col_name,
        src_col=a.src_col_name,
        dst_col=a.dst_col_name,
        weighted=a.weighted,
        weight_col=a.weight_col_name,
        symmetrize=a.symmetrize,
        vertex_schema=a.vertex_schema,
        edge_schema=a.edge_schema,
    )
    result = _run(graph, a)
    write_result(result.df, a.output)
    print(f"{a.algorithm}: {result.iterations} iterations, written to {a.output}", file=sys.stderr)
    return 0
