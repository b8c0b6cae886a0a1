"""References to records that do not exist, are deleted, or arrive later.

1. Parent keys are compressed, per block of the key space, into contiguous runs (start, end).
2. References are reduced, map side first, to one row per distinct key with the earliest and the
   latest reference time and their number. So a key that a third of all rows hold is one row here.
3. Per block, distinct keys are as-of matched to the preceding run start: a window over at most two
   rows per key of the block, hence of bounded size. Keys beyond the run's end are missing.
4. Keys that exist are compared with two of their lifetimes over [earliest, latest]: the first that is
   still open, and the ended one that ends last. Only keys that neither covers ("suspects") go on.
5. References to suspects are picked by a join with their ids, broadcast behind a check of their number
   and shuffled beyond; there, keys held by many rows and found sound are left out before the shuffle.
6. References to suspects that exist are as-of matched by (id, time) to the lifetimes that began by then:
   a window with the running maximum of their ends. A key of many references is salted, its lifetimes
   go to every salt; lifetimes are rows throughout, however many a key has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.operators.sizing import BROADCAST_ROWS, small
from veldt.plans.materialize import Scratch


@dataclass(frozen=True)
class References:
    """Columns of ``df`` that refer to parent keys; ``key`` names the referring row, ``at`` its time."""

    df: DataFrame
    table: str
    key: str
    fields: tuple[str, ...]
    at: str

    def rows(self) -> DataFrame:
        """(ref_table, ref_key, ref_field, id, t), a row per non-null reference."""
        d = self.df
        each = F.array(*(F.struct(F.lit(f).alias("ref_field"), d[f].cast("long").alias("id")) for f in self.fields))
        return (
            d.select(F.lit(self.table).alias("ref_table"), d[self.key].alias("ref_key"), d[self.at].alias("t"), F.explode(each).alias("r"))
            .select("ref_table", "ref_key", "r.ref_field", "r.id", "t")
            .filter("id IS NOT NULL")
        )


def contiguous_runs(keys: DataFrame, key: str = "id", block_bits: int = 13) -> DataFrame:
    """Distinct integer keys as runs (block, run_start, run_end); a run ends at its block's end."""
    w = W.partitionBy("block").orderBy("k")
    return (
        keys.filter(F.col(key).isNotNull())
        .select(F.shiftright(key, block_bits).alias("block"), F.col(key).alias("k"))
        .distinct()
        .withColumn("island", F.col("k") - F.row_number().over(w))
        .groupBy("block", "island")
        .agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"))
        .drop("island")
    )


def asof_missing(runs: DataFrame, keys: DataFrame, key: str = "id", block_bits: int = 13) -> DataFrame:
    """``keys`` (distinct) with ``missing``: whether no run holds the key."""
    rest = [c for c in keys.columns if c != key]
    starts = runs.select("block", F.col("run_start").alias(key), F.lit(0).alias("kind"), "run_end")
    asked = keys.withColumns({"block": F.shiftright(key, block_bits), "kind": F.lit(1)})
    w = W.partitionBy("block").orderBy(key, "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        starts.unionByName(asked, allowMissingColumns=True)
        .withColumn("reach", F.last("run_end", ignorenulls=True).over(w))
        .filter("kind = 1")
        .select(key, *rest, F.coalesce(F.col(key) > F.col("reach"), F.lit(True)).alias("missing"))
    )


def orphan_references(
    parents: DataFrame,
    references: list[References],
    *,
    id_col: str = "id",
    loaded: str = "loaded_at",
    deleted: str = "deleted_at",
    block_bits: int = 13,
    salt_rows: int = 500_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Distinct orphan references (ref_table, ref_key, ref_field, cause, period).

    cause: ``missing`` no parent row has the id; ``late`` all its rows are loaded after the
    reference's time t; ``deleted`` some are loaded by t and all those are deleted by t. period is
    the month of t. Defined results: null references are none; a null t can only be ``missing``,
    with a null period; a parent that was never loaded (null) counts as loaded from the start; null
    parent ids are ignored; repeated rows give one row; other columns are never read; empty tables
    give an empty result, or all references as missing.
    """
    spark = parents.sparkSession
    scratch = Scratch(spark, "orphans")
    start = F.timestamp_micros(F.lit(-62135596800000000))
    versions = parents.select(parents[id_col].cast("long").alias("id"), F.coalesce(parents[loaded], start.cast(parents.schema[loaded].dataType)).alias("from"), parents[deleted].alias("until")).filter("id IS NOT NULL")

    every = reduce(DataFrame.union, [r.rows() for r in references])
    keys = every.groupBy("id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    matched = asof_missing(contiguous_runs(versions, "id", block_bits), keys, "id", block_bits)
    ended = F.when(F.col("until").isNotNull(), F.struct("until", "from"))
    lives = versions.groupBy("id").agg(F.min(F.when(F.col("until").isNull(), F.col("from"))).alias("forever"), F.max(ended).alias("latest"))
    # safe: one lifetime covers all of the key's references
    covered = F.coalesce(F.col("forever") <= F.col("t0"), F.lit(False)) | F.coalesce((F.col("latest.from") <= F.col("t0")) & (F.col("latest.until") > F.col("t1")), F.lit(False))
    judged = matched.join(lives, "id", "left").select("id", "n", "missing", (F.col("missing") | (F.col("t0").isNotNull() & ~covered)).alias("suspect"))
    # with the suspects the sound keys that many rows hold
    kept = scratch.write(judged.filter(F.col("suspect") | (F.col("n") >= salt_rows)), "suspects")
    salts = F.ceil(F.col("n") / F.lit(salt_rows)).cast("int")
    suspects = kept.filter("suspect").select("id", "missing", salts.alias("salts"))

    few = small(suspects, broadcast_rows)
    side = F.broadcast(suspects) if few else suspects
    # at most rows / salt_rows keys; at this number of suspects they are few beside them
    sound = F.broadcast(kept.filter(~F.col("suspect")).select("id")) if not few and small(kept.filter(~F.col("suspect")), broadcast_rows) else None
    picked = []
    for r in references:
        rows = r.rows()
        picked.append((rows if sound is None else rows.join(sound, "id", "left_anti")).join(side, "id"))
    names = ("ref_table", "ref_key", "ref_field")
    refs = scratch.write(reduce(DataFrame.unionByName, picked), "references")

    # the end of what never ends
    far = F.timestamp_micros(F.lit(253402300799999999)).cast(parents.schema[deleted].dataType)
    begun = versions.join(side.filter(~F.col("missing")), "id").select(
        "id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("from").alias("t"), F.coalesce("until", far).alias("until"), F.lit(0).alias("kind")
    )
    salt = F.pmod(F.xxhash64("ref_key", "t"), F.col("salts")).cast("int")
    asked = refs.filter(~F.col("missing") & F.col("t").isNotNull()).select("id", salt.alias("salt"), "t", F.lit(1).alias("kind"), *names)
    so_far = W.partitionBy("id", "salt").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    matched = begun.unionByName(asked, allowMissingColumns=True).withColumn("until", F.max("until").over(so_far)).filter("kind = 1")
    cause = F.when(F.col("until").isNull(), "late").when(F.col("until") <= F.col("t"), "deleted")
    found = matched.select(*names, cause.alias("cause"), "t").filter("cause IS NOT NULL")
    missing = refs.filter("missing").select(*names, F.lit("missing").alias("cause"), "t")
    return missing.union(found).select(*names, "cause", F.date_format("t", "yyyy-MM").alias("period")).distinct()


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """The report: orphan references per table, field, cause and month."""
    return orphans.groupBy("ref_table", "ref_field", "cause", "period").agg(F.count(F.lit(1)).alias("orphans"))
