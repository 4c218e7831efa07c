"""Scoring and error aggregates of factor models (row, vec), (col, vec) over ratings (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dot, predict, squared_norm


def scored(t: DataFrame, rows: DataFrame, cols: DataFrame, mean: Column | None = None, biases: bool = False) -> DataFrame:
    """Ratings with `pred` and `e` = pred - value; two many-to-one joins, Spark broadcasts a small side.

    Factor tables with `biases` carry a column `b` each.
    """
    r = rows.select("row", F.col("vec").alias("__w"), *([F.col("b").alias("__bu")] if biases else []))
    c = cols.select("col", F.col("vec").alias("__h"), *([F.col("b").alias("__bi")] if biases else []))
    pred = predict(F.col("__w"), F.col("__h"), mean, F.col("__bu") if biases else None, F.col("__bi") if biases else None)
    return t.join(c, "col").join(r, "row").withColumn("pred", pred).withColumn("e", F.col("pred") - F.col("value")).drop("__w", "__h", "__bu", "__bi")


def sse(s: DataFrame, *by: str) -> DataFrame:
    return s.groupBy(*by).agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.count(F.lit(1)).alias("n"))


def rmse(s: DataFrame, *by: str) -> DataFrame:
    return sse(s, *by).withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))


def regulariser(t: DataFrame, factors: DataFrame, key: str, lam: float) -> DataFrame:
    """lam * sum of degree times squared norm over one side."""
    counts = t.groupBy(key).agg(F.count(F.lit(1)).alias("nnz"))
    return counts.join(factors, key).agg((lam * F.sum(F.col("nnz") * squared_norm(F.col("vec")))).alias("reg"))


def objective(t: DataFrame, rows: DataFrame, cols: DataFrame, lam_row: float, lam_col: float) -> DataFrame:
    """One row: loss, reg, obj."""
    loss = scored(t, rows, cols).agg(F.sum(F.col("e") * F.col("e")).alias("loss"))
    reg = regulariser(t, rows, "row", lam_row).union(regulariser(t, cols, "col", lam_col)).agg(F.sum("reg").alias("reg"))
    return loss.join(F.broadcast(reg)).withColumn("obj", F.col("loss") + F.col("reg"))


def norms(v: DataFrame, a: str, b: str) -> DataFrame:
    return v.withColumn("dot", dot(F.col(a), F.col(b))).withColumn("norm", F.sqrt(squared_norm(F.col(a))))
