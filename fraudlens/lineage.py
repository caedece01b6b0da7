"""Cutting lineage in the shared folder that the session names, so that a lost executor costs nothing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    A folder is only made up where the session names none and driver and
    executors are one process, as in tests; a cluster must name one.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path below the checkpoint folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the checkpoint folder and read back: smaller than a checkpoint, and read by column."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shrink(spark: SparkSession) -> None:
    """Has the executors' JVMs collect garbage, so that they give back the heap that they don't need now.

    Else an executor keeps as much as its largest stage so far made it take,
    which its later Python workers then lack.  There is a task for each core,
    so each idle executor gets some.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def release(spark: SparkSession) -> None:
    """Collects garbage here and in the driver's JVM, so that Spark's cleaner deletes shuffle files that no plan needs any more; then the executors shrink.

    What one round lets go of is only found by the next, and the cleaner works beside it.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
    shrink(spark)
