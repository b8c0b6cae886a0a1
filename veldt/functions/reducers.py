"""Reducers of neighbour values and sketches, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def h_index(values: Column) -> Column:
    """The largest h with at least h elements >= h; nulls and negatives do not count, null gives 0."""
    ordered = F.sort_array(values, asc=False)
    return F.coalesce(F.size(F.filter(F.transform(ordered, lambda x, i: x >= i + 1), lambda b: b)), F.lit(0))


def mode_min(value: Column) -> Column:
    """The most frequent value, of equally frequent ones the smallest; nulls skipped, none gives null."""
    return F.mode(value, True)


def h_index_by_id(name: str) -> Callable[[DataFrame], DataFrame]:
    """Reducer (id, name) -> (id, name) with the h-index per id, from counts per distinct value.

    A hub's messages meet as one row per distinct value, never as one list.
    """

    def reduce(sent: DataFrame) -> DataFrame:
        counts = sent.filter(F.col(name).isNotNull()).groupBy("id", name).agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(W.partitionBy("id").orderBy(F.desc(name)).rowsBetween(W.unboundedPreceding, W.currentRow))
        h = F.least(F.greatest(F.col(name), F.lit(0)).cast("long"), above)
        return counts.select("id", h.alias("h")).groupBy("id").agg(F.max("h").cast("int").alias(name))

    return reduce


def mode_by_id(name: str) -> Callable[[DataFrame], DataFrame]:
    """Reducer (id, name) -> (id, name) with the mode per id, smallest on ties, from counts per value."""

    def reduce(sent: DataFrame) -> DataFrame:
        counts = sent.filter(F.col(name).isNotNull()).groupBy("id", name).agg(F.count(F.lit(1)).alias("n"))
        # not(x) turns the order of all 64-bit integers without overflow
        best = F.max(F.struct("n", F.bitwise_not(F.col(name)).alias("turned")))
        return counts.groupBy("id").agg(best.alias("best")).select("id", F.bitwise_not("best.turned").alias(name))

    return reduce


def hll_long(df: DataFrame, key: str, lg_k: int, name: str = "sketch") -> DataFrame:
    """(key, name): the singleton sketch of every distinct non-null key; lg_k from 4 to 21."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.hll_sketch_agg(key, F.lit(lg_k)).alias(name))


def hll_union(a: Column, b: Column) -> Column:
    """Union of two sketches; null if either is null."""
    return F.hll_union(a, b)


def hll_union_agg(sketch: Column) -> Column:
    """Union over rows, nulls skipped."""
    return F.hll_union_agg(sketch)


def hll_estimate(sketch: Column) -> Column:
    """The estimated number of distinct values as a double; null gives null."""
    return F.hll_sketch_estimate(sketch).cast("double")
