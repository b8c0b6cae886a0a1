"""Top N items within every group, heavy groups apart from light ones.

Exact row counts per group decide. Light groups take one shuffle by group, in which both the best
score per item and an ordinary ranking window are evaluated. Heavy groups are reduced to the best
score per item in a shuffle by (group, item), then range-partitioned and sorted by (group, score,
item) over all tasks; the range is the salt: each keeps its first N rows of a group, and a last
window ranks at most N rows per group and range. Both results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.operators.sizing import broadcast_if_small
from veldt.plans.materialize import Scratch


def _best(df: DataFrame) -> DataFrame:
    return df.groupBy("grp", "item").agg(F.max("score").alias("score"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, heavy_rows: int = 50_000) -> DataFrame:
    """(group, item, score, rank): each group's ``n`` items of highest score, ties by the smaller item.

    An item's score in a group is its highest there. Defined results: rows with a null group or
    item or a null or non-finite score are left out; -0.0 equals 0.0; repeated rows count once;
    groups of fewer than ``n`` items give all of them; other columns are not read; an empty table
    gives an empty result. A group of at least ``heavy_rows`` rows is heavy: so heavy groups are at
    most rows / heavy_rows, and are broadcast behind a check of their number.
    """
    s: Column = df[score].cast("double")
    rows = df.select(df[group].alias("grp"), df[item].alias("item"), F.when(s == 0, F.lit(0.0)).otherwise(s).alias("score")).filter(
        F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))
    )
    order = [F.desc("score"), F.asc("item")]
    rank = F.row_number().over(W.partitionBy("grp").orderBy(*order))
    heavy = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= heavy_rows).select("grp")
    # counted once: both paths and the size check read it
    heavy = broadcast_if_small(Scratch(df.sparkSession, "top-n").write(heavy, "heavy"))

    # one exchange: a shuffle by group also clusters (group, item)
    light = _best(rows.join(heavy, "grp", "left_anti").repartition("grp")).withColumn("rank", rank).filter(F.col("rank") <= n)

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = _best(rows.join(heavy, "grp", "left_semi")).repartitionByRange(parts, "grp", *order).withColumn("salt", F.spark_partition_id())
    within = F.row_number().over(W.partitionBy("grp", "salt").orderBy(*order))
    hot = ranged.withColumn("r", within).filter(F.col("r") <= n).drop("r", "salt").withColumn("rank", rank).filter(F.col("rank") <= n)
    return light.unionByName(hot).select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
