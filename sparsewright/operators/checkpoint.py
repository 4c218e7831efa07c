"""Snapshots of a model under `epoch=<n>` folders, and written tables that cut a loop's lineage.

Between Spark stages nothing is in flight, so the three protocols of snapshotting (stop everything, record
what is in flight, stop sending only) give one and the same snapshot here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PROTOCOLS = ("none", "sync", "async", "vs")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset and all runs in one process, a folder made here.

    On a cluster a folder of one machine would lose the others' rows, so there the setting is needed.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: plans and estimates stay small over many rounds."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of a DataFrame that `cut` returned and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def save(factors: DataFrame, folder: str, epoch: int, protocol: str = "sync") -> None:
    """Write the tagged factor table of an epoch; its _SUCCESS file marks it as complete."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"protocol is one of {PROTOCOLS}")
    if protocol != "none":
        factors.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def load(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/epoch={epoch}")
