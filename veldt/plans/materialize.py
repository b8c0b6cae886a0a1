"""Lineage cuts that survive the loss of an executor.

Two forms, both in the folder that ``spark.checkpoint.dir`` names:

* :class:`Scratch` writes parquet and reads it back. Compact and column-pruned; the default for
  everything whose partitioning is not needed again.
* :class:`StateStore` keeps iterative state hash-partitioned and sorted by a key through
  ``DataFrame.checkpoint()``, so that the next superstep's join needs neither exchange nor sort.

:class:`Generations` caches the generations of a loop by column between cuts: a lost block comes back
from the generations since the last cut. ``localCheckpoint`` is never used: its blocks live on single
executors.

What an operator needs no more it drops itself; what its result reads lives until the session ends, or
until the end of a ``with intermediates():`` block.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import deque
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCOPES: list[list[Scratch]] = []
_LOCAL: list[str] = []


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or spark.sparkContext.getConf().get(key)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir``. Where that is unset a temporary folder is made, which is
    only allowed on a local master, as in tests; elsewhere it is an error.
    """
    named = _setting(spark, "spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="veldt-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        named = _LOCAL[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
        _until_exit(spark, spark.sparkContext.getCheckpointDir())
    return named.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through the Hadoop file system that serves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _until_exit(spark: SparkSession, path: str) -> None:
    """Make the folder, which its file system deletes when the driver's JVM ends, also after a failure."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)


@contextmanager
def intermediates():
    """Delete at the end of the block all tables that operators wrote within it, also those results read."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.purge()


class Scratch:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None):
        self.spark = spark
        self.root = f"{(folder or shared_dir(spark)).rstrip('/')}/veldt/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._count = 0
        _until_exit(spark, self.root)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        df.write.parquet(path)
        self._paths[name] = path
        # the schema is given, so that no job runs to infer it
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self._paths.pop(name, None):
            delete_path(self.spark, path)

    def purge(self) -> None:
        self._paths.clear()
        delete_path(self.spark, self.root)


def own_session(spark: SparkSession, **settings: object) -> SparkSession:
    """A session on the same context and cache with settings of its own; nobody else's plans change.

    Setting names have ``__`` for dots after ``spark.sql.``.
    """
    made = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in settings.items():
        made.conf.set("spark.sql." + name.replace("__", "."), str(value))
    return made


def static_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session for loops: no adaptive execution, which would give up the partitioning of kept frames, nor
    broadcasts of kept state, whose joins need no exchange anyway."""
    return own_session(spark, adaptive__enabled="false", shuffle__partitions=partitions, autoBroadcastJoinThreshold=-1)


def _of_plan(spark: SparkSession, plan: object) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def rebound(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same frame, planned under the settings of ``spark``."""
    return df if df.sparkSession is spark else _of_plan(spark, df._jdf.queryExecution().analyzed())


def loop_partitions(spark: SparkSession, rows: int, per_partition: int = 200_000) -> int:
    """Partitions of loop state: one per core, more for many rows, up to the session's shuffle partitions."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, -(-rows // per_partition))))


def _leaf(spark: SparkSession, output: object, rdd: object, partitioning: object, ordering: object) -> DataFrame:
    """A frame that reads ``rdd``, without a size estimate.

    A join's estimate is the product of its sides', so over supersteps an inherited number gains digits
    exponentially and planning never ends.
    """
    jvm = spark._jvm
    none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(output, rdd, partitioning, ordering, False, none, spark._jsparkSession, none, none)
    return _of_plan(spark, plan)


def keep(df: DataFrame) -> DataFrame:
    """Cache ``df`` by column on its first use; the returned frame has its partitioning and order, but a plan of one node.

    Its lineage stays: lost blocks are computed again. Release it with ``df.unpersist()``.
    """
    df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    plan = _of_plan(spark, df._jdf.queryExecution().analyzed())._jdf.queryExecution().executedPlan()
    return _leaf(spark, plan.output(), plan.execute(), plan.outputPartitioning(), plan.outputOrdering())


class Generations:
    """The latest generation of loop state: cached, and cut from its lineage by a checkpoint every ``cut_every`` ones."""

    def __init__(self, spark: SparkSession, cut_every: int = 8):
        shared_dir(spark)
        self.spark, self.cut_every = spark, cut_every
        self._cached: DataFrame | None = None
        self._cut: DataFrame | None = None
        self._count = 0

    def push(self, df: DataFrame, *wanted: Column) -> tuple[DataFrame, object]:
        """(frame of the new generation, row of the aggregates ``wanted`` over it); one job."""
        frame = keep(df)
        try:
            row = frame.agg(*(wanted or (F.count(F.lit(1)),))).first()
        except Exception:
            df.unpersist()
            raise
        if self._cached is not None:
            self._cached.unpersist()
        self._cached = df
        self._count += 1
        if self._count % self.cut_every == 0:
            before, self._cut = self._cut, _fresh_statistics(frame.checkpoint(eager=True))
            _delete_checkpoint(before)
            df.unpersist()
            self._cached, frame = None, self._cut
        return frame, row

    def release(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
        _delete_checkpoint(self._cut)
        self._cached = self._cut = None


def _delete_checkpoint(df: DataFrame | None) -> None:
    if df is None:
        return
    try:
        files = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if files.isDefined():
            delete_path(df.sparkSession, files.get())
    except Exception:  # noqa: BLE001 - a leftover file must not end the run
        pass


def _fresh_statistics(df: DataFrame) -> DataFrame:
    """The same checkpointed frame without the size estimate inherited from its plan; partitioning and order are kept."""
    plan = df._jdf.queryExecution().analyzed()
    return _leaf(df.sparkSession, plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering())


class StateStore:
    """Generations of iterative state, first in first out, partitioned and sorted by ``key``."""

    def __init__(self, spark: SparkSession, key: str = "id", partitions: int | None = None):
        shared_dir(spark)
        self.spark = spark
        self.key = key
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._kept: deque[DataFrame] = deque()

    def __len__(self) -> int:
        return len(self._kept)

    def push(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Partition and sort by ``key``, write, and return the frame that reads it."""
        key = key or self.key
        laid = df.repartition(self.partitions, F.col(key)).sortWithinPartitions(key)
        kept = _fresh_statistics(laid.checkpoint(eager=True))
        self._kept.append(kept)
        return kept

    def evict(self, n: int = 1) -> None:
        """Delete the ``n`` oldest generations; fewer where there are fewer."""
        for _ in range(min(n, len(self._kept))):
            _delete_checkpoint(self._kept.popleft())

    def evict_all_but_latest(self, n: int = 1) -> None:
        self.evict(max(0, len(self._kept) - n))

    def remove_last(self, n: int = 1) -> None:
        for _ in range(min(n, len(self._kept))):
            _delete_checkpoint(self._kept.pop())

    def purge(self) -> None:
        self.evict(len(self._kept))


def validate_output(output: str, checkpoint: str) -> None:
    """Refuse an output folder that holds the checkpoints or lies within them."""
    out, kept = (x.replace("file://", "", 1).rstrip("/") + "/" for x in (output, checkpoint))
    if out.startswith(kept) or kept.startswith(out):
        raise ValueError(f"output {output} and checkpoint folder {checkpoint} overlap")
