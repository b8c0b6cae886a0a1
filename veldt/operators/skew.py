"""Per-key results when a few keys hold most rows.

Heavy hitters are found with a mergeable frequency sketch, counted exactly, and processed on their
own path: their rows are picked by a broadcast join and aggregated in two steps, so that no task
holds a heavy key alone. All other keys take one ordinary shuffle; the results are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _trim(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge repeated keys and cut to ``counters`` by subtracting the next largest count from all."""
    found, back = np.unique(keys, return_inverse=True)
    sums = np.bincount(back, weights=counts).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    if len(found) > counters:
        sums = sums - np.partition(sums, len(sums) - counters - 1)[len(sums) - counters - 1]
        found, sums = found[sums > 0], sums[sums > 0]
    return found, sums


def frequency_sketch(df: DataFrame, columns: list[str], counters: int) -> DataFrame:
    """(side, id, at_least): merged counters of every column, undercounting by at most rows / (counters + 1).

    Every task keeps ``counters`` counters per column; equal keys of all tasks are added up. Any
    value that more than rows / (counters + 1) rows hold is present. Nulls are not counted.
    """
    names = list(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {c: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in names}
        waiting: dict[str, list[np.ndarray]] = {c: [] for c in names}
        rows = 0

        def fold() -> None:
            for c in names:
                if waiting[c]:
                    values = np.concatenate(waiting[c])
                    waiting[c].clear()
                    kept[c] = _trim(np.concatenate([kept[c][0], values]), np.concatenate([kept[c][1], np.ones(len(values), np.int64)]), counters)

        for batch in batches:
            for k, c in enumerate(names):
                waiting[c].append(batch.column(k).drop_null().to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= 500_000:
                fold()
                rows = 0
        fold()
        for c in names:
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(kept[c][0]), pa.string()), pa.array(kept[c][0]), pa.array(kept[c][1])], names=["side", "id", "at_least"])

    made = df.select(*(df[c].cast("long").alias(c) for c in names)).mapInArrow(scan, "side string, id long, at_least long")
    return made.groupBy("side", "id").agg(F.sum("at_least").alias("at_least"))


def _candidates(df: DataFrame, columns: list[str], share: float, total: int) -> DataFrame:
    """(side, id): every value that at least ``share`` of the ``total`` rows hold, and few others.

    The sketch keeps 4 / share counters; so there are at most 4 / (3 share) candidates per column, which are
    collected to become a broadcast side.
    """
    counters = max(1, int(4 / share))
    floor = share * total - total / (counters + 1)
    rows = frequency_sketch(df, columns, counters).filter(F.col("at_least") >= floor).select("side", "id").collect()
    return df.sparkSession.createDataFrame([(r.side, r.id) for r in rows], "side string, id long")


def heavy_hitters(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """(side, id, n): the non-null values that at least ``share`` of all rows hold, with exact counts.

    The sketch misses none; the exact count of its candidates decides. An empty table has none;
    repeated rows count each; other columns are not read.
    """
    total = df.count()
    found = _candidates(df, columns, share, total)
    each = F.array(*(F.struct(F.lit(c).alias("side"), df[c].cast("long").alias("id")) for c in columns))
    counted = df.select(F.explode(each).alias("x")).select("x.*").join(F.broadcast(found), ["side", "id"]).groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= F.lit(share * total))


def degree_profile(df: DataFrame, ends: tuple[str, str] = ("src", "dst"), weight: str = "weight", heavy_share: float = 0.001) -> DataFrame:
    """(side, id, degree, weighted, weight_sum, neighbours) of every id on either side.

    degree counts rows, ``weighted`` the rows of a finite weight and weight_sum adds those (null
    where there are none), neighbours counts distinct non-null other ends. Rows of both sides come
    from one scan. Light keys take one shuffle, by (side, key), in which neighbours and keys are
    aggregated; heavy ones, about ``heavy_share`` of all rows or more, are combined by (side, key,
    neighbour) before theirs. Null ids have no row; repeated rows count each time; an empty table
    gives none.
    """
    heavy = F.broadcast(_candidates(df, list(ends), heavy_share, df.count()))
    w = df[weight].cast("double")
    finite = F.when(w.isNotNull() & ~F.isnan(w) & (F.abs(w) < F.lit(float("inf"))), w)
    one, two = (df[c].cast("long") for c in ends)
    each = F.array(*(F.struct(F.lit(s).alias("side"), a.alias("id"), b.alias("nbr")) for s, a, b in zip(ends, (one, two), (two, one), strict=True)))
    rows = df.select(finite.alias("w"), F.explode(each).alias("x")).select("x.*", "w").filter("id IS NOT NULL")

    def profile(picked: DataFrame) -> DataFrame:
        near = picked.groupBy("side", "id", "nbr").agg(F.count(F.lit(1)).alias("degree"), F.count("w").alias("weighted"), F.sum("w").alias("weight_sum"))
        whole = (F.sum(c).alias(c) for c in ("degree", "weighted", "weight_sum"))
        return near.groupBy("side", "id").agg(*whole, F.count("nbr").alias("neighbours"))

    light = rows.join(heavy, ["side", "id"], "left_anti").repartition("side", "id")
    return profile(light).union(profile(rows.join(heavy, ["side", "id"], "left_semi")))
