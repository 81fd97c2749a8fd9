"""Tables in the folder that driver and executors share, which cut the lineage of iterative work."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is not set, as in tests, a session whose executors are the driver's own threads gets a temporary
    one; any other session is refused, because no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif context.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="strandframe-")
            context.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{_scratch.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All tables stashed inside go at its end, and so do the shuffle files of work that nothing refers to any more."""
    path = fresh_path(spark, "scratch")
    before = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(before)
        discard(spark, path)
        gc.collect()  # a frame that Python still holds holds its shuffle files
        spark._jvm.System.gc()


def stash(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; the table read again, and its path."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame, name: str, first: int, *order: Column | str) -> DataFrame:
    """``rows`` with their place in an order, from ``first`` on.

    They are sorted in ranges, and a range's first place follows from the sizes of those before it, one number each;
    no task sees all rows.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    held, _ = stash(placed, "numbered")
    before, base = first, []
    for r in held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("low")).orderBy("_part").collect():
        base.append((r._part, before - r.low))
        before += r.n
    offsets = spark.createDataFrame(base or [(0, 0)], "_part int, _base long")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")
