"""Session helpers: the folder every executor shares, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and the master is local (tests) one of our own is
    set: on a cluster, a machine's own folder would hide each executor's files from the others."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="skein-")
    return base.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared one."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


@contextmanager
def scratch_dropped(spark: SparkSession):
    """Folders of scratch() named inside are deleted at the end: for a result that is written inside, elsewhere."""
    first = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[first:]:
            remove(spark, path)
        del _MADE[first:]


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a query are deleted when the query has ended: for writes, whose result is read back
    from files and never from shuffles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a table that a task of a long stage takes, about: a read's mappings pass some seven hash tables and sorts there,
#: which keep a few hundred MB at this number.
ROWS_A_TASK = 1 << 17
_PARTS, _ADVISED, _SPLIT = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's, or more where a task would get more than ROWS_A_TASK."""
    return max(int(spark.conf.get(_PARTS)), -(-rows // ROWS_A_TASK))


@contextmanager
def split(spark: SparkSession):
    """Inside, scans read 16 MB of a file at most: what groups the rows that it reads, or deals them to so many partitions
    that Spark sorts them first, holds them in memory."""
    before = spark.conf.get(_SPLIT)
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > 16 << 20:
        spark.conf.set(_SPLIT, "16m")
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)


@contextmanager
def parted(spark: SparkSession, rows: int):
    """Inside, shuffles go to tasks_for(rows) partitions and scans are split(), so that a task's memory doesn't grow with the
    input. For tables that are written inside; where the session's own number does, shuffles don't change."""
    n, before = tasks_for(spark, rows), {k: spark.conf.get(k) for k in (_PARTS, _ADVISED)}
    if n > int(before[_PARTS]):
        spark.conf.set(_PARTS, n)
        spark.conf.set(_ADVISED, "8m")  # partitions aren't merged into what the session thinks fit for short stages
    try:
        with split(spark):
            yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends at files that survive lost executors."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, by: str) -> DataFrame:
    """Rows in the order of by, over tasks whose number follows the rows'. They are stored first, so that what they are made
    of runs once, not again for the count and for the ranges."""
    spark = rows.sparkSession
    with split(spark):
        stored = saved(rows, scratch(spark, "rows"))
    return stored.repartitionByRange(tasks_for(spark, stored.count()), by).sortWithinPartitions(by)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skein-src-"), "skein_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
