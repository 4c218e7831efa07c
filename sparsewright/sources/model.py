"""Ratings and models as folders of Parquet tables with a row of parameters that names their type and version.

`save_data` writes ratings with their dimensions, `save_model` factors with biases, the rating mean, the
training's parameters and, where ids were renamed, both id maps.  A reader checks type and version first.
`view` tells what a folder holds without reading its tables.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix as M

# What the parameters' row says of a folder.
DATA, MODEL, VERSION = "data", "model", 1


def _put(spark: SparkSession, folder: str, kind: str, params: dict) -> None:
    row = [(kind, VERSION, json.dumps(params, sort_keys=True))]
    spark.createDataFrame(row, "type string, version int, params string").coalesce(1).write.parquet(f"{folder}/params")


def params_of(spark: SparkSession, folder: str, kind: str | None = None) -> dict:
    """The parameters, with `type`; another type than `kind`, or another version, is an error."""
    row = spark.read.parquet(f"{folder}/params").first()
    if kind and row["type"] != kind:
        raise ValueError(f"{folder} holds a {row['type']}, not a {kind}")
    if row["version"] != VERSION:
        raise ValueError(f"{folder} has version {row['version']}; this reads version {VERSION}")
    return {"type": row["type"], **json.loads(row["params"])}


def save_data(t: DataFrame, folder: str) -> None:
    """Ratings (row, col, value) with their dimensions, number and mean."""
    t.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")).write.parquet(f"{folder}/ratings")
    _put(t.sparkSession, folder, DATA, M.dimensions(t.sparkSession.read.parquet(f"{folder}/ratings")).first().asDict())


def load_data(spark: SparkSession, folder: str) -> DataFrame:
    params_of(spark, folder, DATA)
    return spark.read.parquet(f"{folder}/ratings")


class Model(NamedTuple):
    """rows, cols: (id, vec, b), the bias null without biases; ids: (id, idx) maps or None."""

    rows: DataFrame
    cols: DataFrame
    params: dict
    row_ids: DataFrame | None = None
    col_ids: DataFrame | None = None


def from_factors(factors: DataFrame, biased: bool = False, row_ids: DataFrame | None = None, col_ids: DataFrame | None = None, **params) -> Model:
    """A model of a trainer's factors (kind, id, vec); with `biased` the last place of a vector is its bias."""
    vec, b = (F.slice("vec", 1, F.size("vec") - 1), F.element_at("vec", -1)) if biased else (F.col("vec"), F.lit(None).cast("double"))
    side = lambda kind: factors.filter(F.col("kind") == kind).select("id", vec.alias("vec"), b.alias("b"))
    return Model(side("row"), side("col"), {"biased": biased, **params}, row_ids, col_ids)


def save_model(model: Model, folder: str) -> None:
    spark = model.rows.sparkSession
    for name, table in (("row_factors", model.rows), ("col_factors", model.cols), ("row_ids", model.row_ids), ("col_ids", model.col_ids)):
        if table is not None:
            table.write.parquet(f"{folder}/{name}")
    _put(spark, folder, MODEL, {**model.params, "renamed": model.row_ids is not None})


def load_model(spark: SparkSession, folder: str) -> Model:
    params = params_of(spark, folder, MODEL)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    ids = (read("row_ids"), read("col_ids")) if params["renamed"] else (None, None)
    return Model(read("row_factors"), read("col_factors"), params, *ids)


def predict(model: Model, t: DataFrame) -> DataFrame:
    """t (row, col, ..) with `pred`; ids of a renamed model are the original ones.  Unknown ids have no row."""
    from ..functions import predict as formula

    r, c = model.rows, model.cols
    if model.row_ids is not None:
        back = lambda side, ids: side.withColumnRenamed("id", "idx").join(ids, "idx").drop("idx")
        r, c = back(r, model.row_ids), back(c, model.col_ids)
    r = r.select(F.col("id").alias("row"), F.col("vec").alias("__w"), F.col("b").alias("__bu"))
    c = c.select(F.col("id").alias("col"), F.col("vec").alias("__h"), F.col("b").alias("__bi"))
    biased = model.params.get("biased")
    mean = F.lit(float(model.params.get("mean") or 0.0))
    pred = formula(F.col("__w"), F.col("__h"), mean, F.col("__bu") if biased else None, F.col("__bi") if biased else None)
    return t.join(c, "col").join(r, "row").withColumn("pred", pred).drop("__w", "__h", "__bu", "__bi")


def view(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value) of what the folder holds, by its type."""
    found = params_of(spark, folder)
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(found.items())], "name string, value string")
