"""Reading the Parquet tables, and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this process has written to the shared folder; results may read them until release().
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, one is made here, in local mode alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder: on a cluster it has to be one that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="metrolith-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return _unsized(df.checkpoint(eager=True))


def _unsized(df: DataFrame) -> DataFrame:
    """A checkpoint without the estimate of its size, which Spark takes from the plan that it was made by.

    A join's estimate is the product of its sides', so over the rounds of a loop the number doubles its digits with each
    join, until it alone fills the driver. Without it, the default for tables of unknown size holds.
    """
    jvm, r = df.sparkSession._jvm, df._jdf.queryExecution().analyzed()
    session, none = df._jdf.sparkSession(), jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(r.output(), r.rdd(), r.outputPartitioning(), r.outputOrdering(), r.isStreaming(), none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what stored() has written so far, once the results that read it are written themselves; the number of tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)
