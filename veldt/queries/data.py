"""Queries of the data-quality operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators.delimited import DelimitedRecords
from veldt.operators.orphans import References, orphan_references, orphans_by_period
from veldt.operators.skew import degree_profile, heavy_hitters
from veldt.sources.tables import table


def _records(spark: SparkSession, d: str) -> DelimitedRecords:
    return DelimitedRecords(table(spark, d, "raw_edges"), "body", ("line_id",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).rejects()


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).valid()


def p1_rejects_by_batch(spark: SparkSession, d: str) -> DataFrame:
    x = DelimitedRecords(table(spark, d, "raw_edges"), "body", ("batch",)).records
    return x.groupBy("batch", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("records"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "vertices"),
        [
            References(table(spark, d, "edges"), "edges", "edge_id", ("src", "dst"), "loaded_at"),
            References(table(spark, d, "ranks"), "ranks", "id", ("id",), "scored_at"),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters(table(spark, d, "edges"), ["src", "dst"], 0.01).select("side", "id")


def p5_vertex_profile(spark: SparkSession, d: str) -> DataFrame:
    x = degree_profile(table(spark, d, "edges"))
    return x.withColumn("weight_sum", F.round("weight_sum", 4))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_rejects_by_batch, p3_found, p3_orphans_by_period, p5_found, p5_vertex_profile)}

_FIELD = r'[ \t]*(?:"((?:[^"]|"")*)"|([^",]*))[ \t]*'
_RAW = rf"""
WITH b AS (SELECT line_id, batch, regexp_replace(coalesce(body, ''), '\r$', '') AS body FROM raw_edges),
q AS (SELECT *, regexp_full_match(body, '(?:{_FIELD})(?:,{_FIELD})*') AS quoted,
             regexp_full_match(body, '{_FIELD},{_FIELD},{_FIELD},{_FIELD}') AS four FROM b),
f AS (SELECT *, {", ".join(f"CASE WHEN four THEN trim(coalesce(regexp_extract(body, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', {2 * k + 1}), '') || coalesce(regexp_extract(body, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', {2 * k + 2}), ''), ' ' || chr(9)) END AS f{k}" for k in range(4))} FROM q),
r AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT four THEN 'columns'
    WHEN NOT regexp_full_match(f0, '[+-]?[0-9]+') OR TRY_CAST(regexp_replace(f0, '^[+]', '') AS BIGINT) IS NULL THEN 'src'
    WHEN NOT regexp_full_match(f1, '[+-]?[0-9]+') OR TRY_CAST(regexp_replace(f1, '^[+]', '') AS BIGINT) IS NULL THEN 'dst'
    WHEN f2 <> '' AND (NOT regexp_full_match(f2, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
        OR coalesce(isinf(TRY_CAST(regexp_replace(f2, '^[+]', '') AS DOUBLE)), true)) THEN 'weight' END AS reason FROM f)
"""
_ORPHANS = """
WITH refs AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_key, 'src' AS ref_field, src AS id, loaded_at AS t FROM edges WHERE src IS NOT NULL
  UNION ALL SELECT 'edges', edge_id, 'dst', dst, loaded_at FROM edges WHERE dst IS NOT NULL
  UNION ALL SELECT 'ranks', id, 'id', id, scored_at FROM ranks WHERE id IS NOT NULL),
seen AS (
  SELECT r.ref_table, r.ref_key, r.ref_field, r.t, count(v.id) AS versions,
    count(CASE WHEN v.loaded_at <= r.t THEN 1 END) AS loaded,
    count(CASE WHEN v.loaded_at <= r.t AND (v.deleted_at IS NULL OR v.deleted_at > r.t) THEN 1 END) AS alive
  FROM (SELECT DISTINCT * FROM refs) r LEFT JOIN vertices v ON v.id = r.id GROUP BY r.ref_table, r.ref_key, r.ref_field, r.t, r.id),
orphans AS (
  SELECT DISTINCT ref_table, ref_key, ref_field, CASE WHEN versions = 0 THEN 'missing' WHEN loaded = 0 THEN 'late' ELSE 'deleted' END AS cause,
    strftime(t, '%Y-%m') AS period FROM seen WHERE alive = 0)
"""
_FINITE = "CASE WHEN NOT isnan(weight) AND NOT isinf(weight) THEN weight END"

SQL = {
    "p1_found": _RAW + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_loaded": _RAW
    + "SELECT line_id, CAST(regexp_replace(f0, '^[+]', '') AS BIGINT) AS src, CAST(regexp_replace(f1, '^[+]', '') AS BIGINT) AS dst, CASE WHEN f2 <> '' THEN CAST(regexp_replace(f2, '^[+]', '') AS DOUBLE) END AS weight, replace(f3, '\"\"', '\"') AS label FROM r WHERE reason IS NULL",
    "p1_rejects_by_batch": _RAW + "SELECT batch, coalesce(reason, 'valid') AS outcome, count(*) AS records FROM r GROUP BY batch, coalesce(reason, 'valid')",
    "p3_found": _ORPHANS + "SELECT * FROM orphans",
    "p3_orphans_by_period": _ORPHANS + "SELECT ref_table, ref_field, cause, period, count(*) AS orphans FROM orphans GROUP BY ref_table, ref_field, cause, period",
    "p5_found": """SELECT side, id FROM (SELECT 'src' AS side, src AS id FROM edges UNION ALL SELECT 'dst', dst FROM edges) x
WHERE id IS NOT NULL GROUP BY side, id HAVING count(*) * 100 >= (SELECT count(*) FROM edges)""",
    "p5_vertex_profile": f"""
SELECT 'src' AS side, src AS id, count(*) AS degree, count({_FINITE}) AS weighted, round(sum({_FINITE}), 4) AS weight_sum, count(DISTINCT dst) AS neighbours FROM edges WHERE src IS NOT NULL GROUP BY src
UNION ALL
SELECT 'dst', dst, count(*), count({_FINITE}), round(sum({_FINITE}), 4), count(DISTINCT src) FROM edges WHERE dst IS NOT NULL GROUP BY dst""",
}
