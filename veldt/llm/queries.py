"""Queries of the training-data operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.groups import group_sizes, link_groups
from veldt.llm.kmv import cube_sets, cube_sketches, distinct_counts, distinct_cube, mark_known, merge_groups
from veldt.llm.leaks import leak_report, leaked_passages, windows_in
from veldt.llm.mixture import mix_sources, mixture_shares
from veldt.llm.sentences import split_sentences, unit_faults
from veldt.llm.topn import top_n
from veldt.operators.sizing import broadcast_if_small
from veldt.plans.materialize import Scratch
from veldt.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "ranks"), "community", "id", "pagerank").select("community", "id")


def p2_heavy_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same with groups from 200 rows on as heavy, and with ranks."""
    return top_n(table(spark, d, "ranks"), "community", "id", "pagerank", heavy_rows=200).select("community", "id", "rank")


def p4_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").withColumn("day", F.to_date("ts"))
    return distinct_cube(e, ["day", "relation", "feed"], ("src", "dst"), table(spark, d, "vertices"))


def p4_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """The counts of :func:`p4_distinct_counts` for sets below k ids, which are exact."""
    x = p4_distinct_counts(spark, d).filter("what IN ('src', 'dst', 'union') AND estimate > 0 AND lower = upper")
    return x.select("by", F.date_format("day", "yyyy-MM-dd").alias("day"), "relation", "feed", "what", "scope", "estimate")


def p4_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable partial results of every day, relation and feed; with k values at most and the known ones."""
    e = table(spark, d, "edges").withColumn("day", F.to_date("ts"))
    dims = ["day", "relation", "feed"]
    return cube_sketches(e, dims, ("src", "dst"), table(spark, d, "vertices"), 4096, [tuple(dims)]).drop("by")


def p4_month_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids per month and relation, merged from stored sketches of days; the groups that are exact."""
    stored = Scratch(spark, "daily").write(p4_sketches(spark, d), "sketches")
    dims = ["month", "relation"]
    merged = merge_groups(stored.withColumn("month", F.date_format("day", "yyyy-MM")), dims, ("src", "dst"), 4096)
    counts = distinct_counts(merged.withColumn("by", F.lit("month,relation")), dims, ("src", "dst"), 4096)
    return counts.filter("what IN ('src', 'dst', 'union') AND estimate > 0 AND lower = upper").select(*dims, "what", "scope", "estimate")


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of all counts by relation and feed: how many are estimates, and whether nine in ten bounds hold the exact number.

    Exact numbers are what sketches are to avoid; those of every day as well would take many times the input.
    """
    dims, sides = ["relation", "feed"], ("src", "dst")
    e, parents = table(spark, d, "edges").select(*dims, *sides), table(spark, d, "vertices")
    found = distinct_cube(e, dims, sides, parents).filter("what IN ('src', 'dst', 'union') AND lower < upper")
    found = Scratch(spark, "estimates").write(found.drop("estimate"), "estimates")
    # every id once per relation, feed and side; known is a property of the id
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("what"), F.col(s).alias("id"), F.col(f"known_{s}").alias("known")) for s in sides)))
    once = mark_known(e, sides, parents).select(*dims, each.alias("x")).select(*dims, "x.*").filter("id IS NOT NULL").distinct()
    null = {c: F.lit(None).cast(once.schema[c].dataType) for c in dims}
    sets = F.array(*(F.struct(F.lit(",".join(s)).alias("by"), *((F.col(c) if c in s else null[c]).alias(c) for c in dims)) for s in cube_sets(dims)))
    rows = once.select("id", "known", F.explode(F.array(F.col("what"), F.lit("union"))).alias("what"), sets.alias("sets"))
    rows = rows.select("id", "known", "what", F.explode("sets").alias("g")).select("g.*", "what", "id", "known")
    group = ["by", *dims, "what"]

    def same(one: str, two: str) -> Column:
        return reduce(lambda a, b: a & b, (F.col(f"{one}{c}").eqNullSafe(F.col(f"{two}{c}")) for c in group))

    wanted = found.select(*(F.col(c).alias(f"__{c}") for c in group)).distinct()
    ids = rows.join(broadcast_if_small(wanted), same("", "__"), "left_semi").groupBy(*group, "id").agg(F.bool_or("known").alias("known"))
    exact = ids.groupBy(*group).agg(F.count(F.lit(1)).alias("all"), F.count_if("known").alias("known"))
    judged = exact.join(found.select(*(F.col(c).alias(f"__{c}") for c in group), "scope", "lower", "upper"), same("", "__"))
    n = F.when(F.col("scope") == "all", F.col("all")).otherwise(F.col("known"))
    within = F.avg(n.between(F.col("lower"), F.col("upper")).cast("double"))
    return judged.agg(F.count(F.lit(1)).alias("estimates"), F.coalesce(within >= 0.9, F.lit(True)).alias("bounds_hold"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return link_groups(table(spark, d, "edges").filter("relation = 'same_as'"))


def p6_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return group_sizes(p6_found(spark, d))


def _leaks(spark: SparkSession, d: str, edited: bool) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=edited)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, edited=False).filter("contains").select("doc_id", "item_id")


def p7_edited_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item, in order, exactly or edited.

    Not found are copies with units added at most places; see :func:`leaked_passages`.
    """
    return _leaks(spark, d, edited=True).filter("contains OR similarity >= 0.5")


def p7_item_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(p7_edited_copies(spark, d))


def p7_against_windows(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of :func:`p7_found` without a common window, and common windows that it lacks: none.

    A common window is looked for by brute force: all windows of an item as strings in a set.
    """
    items = table(spark, d, "eval_items").select("item_id", "text", "lang").collect()  # a fixed number of test items
    exact = windows_in(table(spark, d, "documents"), [(r.item_id, r.text, r.lang) for r in items])
    found = p7_found(spark, d)
    wrong = found.join(exact, ["doc_id", "item_id"], "left_anti").agg(F.count(F.lit(1)).alias("wrong"))
    missed = exact.join(found, ["doc_id", "item_id"], "left_anti").agg(F.count(F.lit(1)).alias("missed"))
    return wrong.crossJoin(F.broadcast(missed))  # a row each


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(*mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a target and documents whose reached share is within 0.005, and sources used beyond their limit."""
    x = p8_shares(spark, d)
    met = F.count_if((F.col("target_share") > 0) & (F.col("tokens") > 0) & (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.005))
    return x.agg(met.alias("targets_met"), F.count_if(F.col("most_repeats") > F.col("max_repeats")).alias("over_limit"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a visible character outside of all units, with overlapping or unordered units, or with one that has outer white space: none."""
    docs = table(spark, d, "documents")
    units = p9_found(spark, d)
    spans = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at"))).alias("spans"))  # of one text
    checked = unit_faults(docs.select("doc_id", "text").join(spans, "doc_id", "left"))
    return checked.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("uncovered", "overlapping", "outer_space")))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_heavy_groups, p4_distinct_counts, p4_exact_groups, p4_sketches, p4_month_counts,
        p4_bounds, p6_found, p6_group_sizes, p7_found, p7_edited_copies, p7_item_report,
        p7_against_windows, p8_mix, p8_shares, p8_limits, p9_found, p9_invariants,
    )
}

_GROUPS = """
WITH RECURSIVE arcs AS (
  SELECT DISTINCT src AS a, dst AS b FROM edges WHERE relation = 'same_as' AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst
  UNION SELECT dst, src FROM edges WHERE relation = 'same_as' AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
reach(id, label) AS (
  SELECT DISTINCT a, a FROM arcs
  UNION SELECT arcs.b, reach.label FROM reach JOIN arcs ON reach.id = arcs.a WHERE reach.label < arcs.b),
groups AS (SELECT id, min(label) AS component FROM reach GROUP BY id)
"""

_DIMS = ("day", "relation", "feed")
_COUNTS = """
WITH x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, relation, feed, 'src' AS what, src AS id FROM edges UNION ALL SELECT strftime(ts, '%Y-%m-%d'), relation, feed, 'dst', dst FROM edges),
y AS (SELECT * FROM x UNION ALL SELECT day, relation, feed, 'union', id FROM x),
z AS (SELECT *, 'all' AS scope FROM y WHERE id IS NOT NULL UNION ALL SELECT *, 'known' FROM y WHERE id IN (SELECT id FROM vertices))
"""


def _grouped(dims: tuple[str, ...]) -> str:
    columns = ", ".join(c if c in dims else f"CAST(NULL AS VARCHAR) AS {c}" for c in _DIMS)
    keys = ", ".join((*dims, "what", "scope"))
    return f"""SELECT '{",".join(dims)}' AS "by", {columns}, what, scope, CAST(count(DISTINCT id) AS DOUBLE) AS estimate FROM z GROUP BY {keys} HAVING count(DISTINCT id) < 4096"""


_TOP = """
SELECT * FROM (
  SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY score DESC, id) AS r
  FROM (SELECT community, id, max(pagerank) AS score FROM ranks
        WHERE community IS NOT NULL AND id IS NOT NULL AND NOT isnan(pagerank) AND NOT isinf(pagerank) GROUP BY community, id) b) x
WHERE r <= 10"""
_EVERY = " UNION ALL ".join(map(_grouped, cube_sets(["relation", "feed"]))).replace("< 4096", ">= 4096")

SQL = {
    "p7_against_windows": "SELECT 0 AS wrong, 0 AS missed",
    "p8_limits": """
SELECT count(*) AS targets_met, 0 AS over_limit FROM mix_targets
WHERE target_share > 0 AND max_repeats > 0 AND lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents WHERE length(trim(text)) > 0)""",
    "p9_invariants": "SELECT 0 AS uncovered, 0 AS overlapping, 0 AS outer_space",
    "p4_bounds": _COUNTS + f"SELECT count(*) AS estimates, true AS bounds_hold FROM ({_EVERY}) g",
    "p4_month_counts": _COUNTS
    + "SELECT substr(day, 1, 7) AS month, relation, what, scope, CAST(count(DISTINCT id) AS DOUBLE) AS estimate FROM z GROUP BY substr(day, 1, 7), relation, what, scope HAVING count(DISTINCT id) < 4096",
    "p4_exact_groups": _COUNTS + " UNION ALL ".join(map(_grouped, cube_sets(list(_DIMS)))),
    "p2_found": f"SELECT community, id FROM ({_TOP}) t",
    "p2_heavy_groups": f"SELECT community, id, CAST(r AS INTEGER) AS rank FROM ({_TOP}) t",
    "p6_found": _GROUPS + "SELECT id, component FROM groups",
    "p6_group_sizes": _GROUPS + "SELECT size, count(*) AS groups FROM (SELECT component, count(*) AS size FROM groups GROUP BY component) s GROUP BY size",
}
