"""Shared folder for intermediate tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, one below the session's warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


def work_root(spark: SparkSession) -> str:
    """The one folder that holds all intermediate tables of this session."""
    return f"{shared_dir(spark)}/runloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's folder (never reused, never cleared here)."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session; lazy results that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, for results used several times."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` whose readers have all been written themselves."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.work_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now; it waits for the driver's collector else."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
