"""Cutting lineage in a place that outlives an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local session that names none, as in tests, gets a new temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; a folder of one machine would be lost to the others")
        named = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """Into how many parts rows are divided before a step whose work isn't in proportion to their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores; a table of many files or splits is left as it is.

    Only the names of the files and the planner's estimate of the size are looked at, nothing is run: a scan has a
    split for every ``spark.sql.files.openCostInBytes`` as long as there are idle cores, so what has fewer is small
    and cheap to divide.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    if files >= cores:
        return df
    cost = 4 << 20
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size + files * cost >= cores * cost else df.repartition(cores)
