"""Text forms of matrices, models and tables, as expressions over a column `value` of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fields(lines: DataFrame, pattern: str):
    return F.split(F.trim("value"), pattern)


def one_based(lines: DataFrame) -> DataFrame:
    """`i j v` lines with ids from 1."""
    f = _fields(lines, r"\s+")
    return lines.filter(F.size(f) == 3).select((f[0].cast("int") - 1).alias("row"), (f[1].cast("int") - 1).alias("col"), f[2].cast("double").alias("value"))


def meta(lines: DataFrame) -> DataFrame:
    """The meta file: `m n`, then `nnz name` of the training and of the test file."""
    words = F.split(F.regexp_replace(F.array_join(F.collect_list("value"), " "), r"\s+", " "), " ")
    return lines.coalesce(1).agg(words.alias("w")).select(*(F.col("w")[k].cast("long" if k in (0, 1, 2, 4) else "string").alias(n) for k, n in enumerate(("nrows", "ncols", "train_nnz", "train", "test_nnz", "test"))))


def tsv_triples(lines: DataFrame) -> DataFrame:
    """`user <tab> item <tab> value` with string ids."""
    f = F.split("value", "\t")
    return lines.filter(F.size(f) >= 3).select(f[0].alias("user"), f[1].alias("item"), f[2].cast("double").alias("value"))


def zero_based(lines: DataFrame) -> DataFrame:
    """`uid iid rate` with ids from 0, single precision."""
    f = _fields(lines, r"\s+")
    return lines.filter(F.size(f) == 3).select(f[0].cast("int").alias("row"), f[1].cast("int").alias("col"), f[2].cast("float").alias("value"))


def factor_lines(factors: DataFrame, key: str, kind: str) -> DataFrame:
    """`row,<id>,v...` or `column,<id>,v...`."""
    return factors.select(F.concat_ws(",", F.lit(kind), F.col(key).cast("string"), F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x)), ",")).alias("value"))


def degree_lines(freq: DataFrame) -> DataFrame:
    return freq.select(F.concat_ws(",", F.col("degree").cast("string"), F.col("freq").cast("string")).alias("value"))


def degrees_of(lines: DataFrame) -> DataFrame:
    f = F.split("value", ",")
    return lines.select(f[0].cast("long").alias("degree"), f[1].cast("long").alias("freq"))


def log_rows(lines: DataFrame) -> DataFrame:
    """rmse.csv: time, rmse, diff, update."""
    f = F.split("value", ",")
    return lines.filter("value <> ''").select(f[0].cast("double").alias("time"), f[1].cast("double").alias("rmse"), f[2].cast("double").alias("diff"), f[3].cast("long").alias("update"))


def checkpoint_rows(lines: DataFrame) -> DataFrame:
    """cp.csv: columns 1 and 2 (time, cost); an empty file is an empty table."""
    f = F.split("value", ",")
    return lines.filter("value <> ''").select(f[1].cast("double").alias("time"), f[2].cast("double").alias("cost"))


def prediction_lines(scored: DataFrame) -> DataFrame:
    """One `%f` per test row; `n` is its place in the input, by which a sink orders."""
    return scored.select("n", F.format_string("%f", "pred").alias("value"))
