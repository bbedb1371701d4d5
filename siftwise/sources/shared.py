"""Rows that are fixed once, in a folder that all machines of a cluster see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. On one machine an unset one becomes a temporary folder; on a cluster that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            at = f"file://{tempfile.mkdtemp()}"
        spark.sparkContext.setCheckpointDir(at)
    return at or spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept: what follows reads the kept rows, also after a lost executor.

    Model stages are settled before they are used twice, since computing them again would repeat paid
    calls and could give other answers.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def fresh_folder(spark: SparkSession) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """A folder that has been read goes, in any store that Spark writes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df computed once and written to path, without a copy of the plan that made it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
