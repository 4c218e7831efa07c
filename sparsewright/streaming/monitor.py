"""The per-column error monitor as a stateful stream: each column's latest error and number of reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checkpoint import shared_folder

OUT = "col long, at long, error double, reports long"


def _update(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, error, n = state.get if state.exists else (-1, 0.0, 0)
    for b in batches:
        n += len(b)
        k = b["at"].idxmax()
        if b["at"][k] > at:
            at, error = int(b["at"][k]), float(b["error"][k])
    state.update((at, error, n))
    yield pd.DataFrame({"col": [key[0]], "at": [at], "error": [error], "reports": [n]})


def column_errors(reports: DataFrame) -> DataFrame:
    """A stream of (col, at, error) to the updated (col, at, error, reports) of every batch."""
    return reports.groupBy("col").applyInPandasWithState(_update, OUT, "at long, error double, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """Feeds the table at `path` through the stream until it is used up; the last state of every column."""
    folder = f"{shared_folder(spark)}/monitor-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder's files; a single file is taken by its name
    parent, name = path.rsplit("/", 1)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile()
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent) if is_file else spark.readStream.schema(schema).parquet(path)
    reports = source.select(F.col("user_id").alias("col"), F.col("event_id").alias("at"), F.col("value").alias("error"))
    out = f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = column_errors(reports).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    stream.awaitTermination()
    return spark.read.parquet(out).groupBy("col").agg(F.max_by("error", "reports").alias("error"), F.max("reports").alias("reports"))
