"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may go without
    one and gets a folder of this machine, which no other machine would see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows, read from the shared checkpoint folder, so that neither a lost
    executor nor a second use computes them again.

    ``tidy`` frees what they were made of at once: Spark removes shuffle files
    that nothing refers to any more only when the driver happens to collect its
    garbage, which a long chain of large steps cannot wait for."""
    checkpoint_folder(df.sparkSession)
    out = df.checkpoint()
    del df
    if tidy:
        gc.collect()
        out.sparkSession._jvm.System.gc()
    return out


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows, written as Parquet into the shared folder (or to ``path``) and read from there: as
    safe as a checkpoint, and a later use reads only the columns it needs."""
    path = path or shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
