"""Sparse matrices as triplets (row, col, value): keys, degrees, blocks, views and products.

Every function takes and returns DataFrames lazily.  Ids are 0-based integers; a missing cell is unobserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import cut


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `idx`, the place of a row in the order of the columns `order`, from 0.

    The rows are dealt into ranges and written once with the number of their range; places come from the
    ranges' counts and from within the ranges, so only one row per range meets in one task.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = dealt.withColumn("__own", own).join(counts.select("__range", before.alias("__before")), "__range")
    return placed.withColumn("idx", F.col("__before") + F.col("__own") - 1).drop("__range", "__own", "__before")


def id_map(ids: DataFrame, shuffled: bool = False) -> DataFrame:
    """(id, idx): dense 0-based numbers of the distinct ids, by id, or by the MD5 of the id if `shuffled`."""
    distinct = ids.select(F.col(ids.columns[0]).alias("id")).distinct().filter("id is not null")
    if shuffled:
        return numbered(distinct.withColumn("order", F.md5(F.col("id").cast("string"))), "order", "id").select("id", "idx")
    return numbered(distinct, "id")


def encode(triples: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(user, item, value) with string ids to (row, col, value) by two id maps."""
    return (
        triples.join(rows.select(F.col("id").alias("user"), F.col("idx").alias("row")), "user")
        .join(cols.select(F.col("id").alias("item"), F.col("idx").alias("col")), "item")
        .select("row", "col", "value")
    )


def sum_duplicates(t: DataFrame) -> DataFrame:
    return t.groupBy("row", "col").agg(F.sum("value").alias("value"))


def dimensions(t: DataFrame) -> DataFrame:
    return t.agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"), F.count(F.lit(1)).alias("nnz"), F.avg("value").alias("mean"))


def dense_ids(t: DataFrame, key: str) -> DataFrame:
    """0 .. max id, one row each, in as many partitions as the session's default parallelism."""
    top = t.agg(F.max(key)).first()[0]
    return t.sparkSession.range(0 if top is None else int(top) + 1).select(F.col("id").alias(key))


def degrees(t: DataFrame, key: str) -> DataFrame:
    """(key, nnz) over the dense id range, zeros included."""
    return dense_ids(t, key).join(t.groupBy(F.col(key).cast("long").alias(key)).agg(F.count(F.lit(1)).alias("nnz")), key, "left").select(key, F.coalesce("nnz", F.lit(0)).alias("nnz"))


def offsets(counts: DataFrame, key: str, n: str = "nnz", bucket: int = 1024) -> DataFrame:
    """Adds `offset`, the exclusive prefix sum of `n` by `key`: within buckets of ids, then over bucket totals."""
    keyed = counts.withColumn("__b", F.floor(F.col(key) / bucket))
    totals = keyed.groupBy("__b").agg(F.sum(n).alias("__n"))
    back = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__b", F.coalesce(F.sum("__n").over(back), F.lit(0)).alias("__before"))
    here = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("__here", F.coalesce(F.sum(n).over(here), F.lit(0))).join(totals, "__b").withColumn("offset", F.col("__before") + F.col("__here")).drop("__b", "__here", "__before")


def remove_bias(t: DataFrame, bias: float | DataFrame | None = None) -> DataFrame:
    """Subtract a constant, by default the mean (one broadcast row)."""
    if bias is None:
        bias = t.agg(F.avg("value").alias("bias"))
    if isinstance(bias, DataFrame):
        return t.join(F.broadcast(bias)).select("row", "col", (F.col("value") - F.col("bias")).alias("value"))
    return t if bias == 0 else t.withColumn("value", F.col("value") - bias)


def transpose(t: DataFrame) -> DataFrame:
    return t.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def part_size(n: int, parts: int) -> int:
    return -(-n // parts)


def row_parts(t: DataFrame, size: int) -> DataFrame:
    """`part` = row div size and `local` = the row's place in its part."""
    return t.withColumn("part", F.floor(F.col("row") / size)).withColumn("local", F.col("row") - F.floor(F.col("row") / size) * size)


def block_ids(t: DataFrame, row_size: int, col_size: int) -> DataFrame:
    return t.withColumn("block_row", F.floor(F.col("row") / row_size)).withColumn("block_col", F.floor(F.col("col") / col_size))


def extents(spark, n: int, blocks: int) -> DataFrame:
    """(block, start, size): equal blocks of n div blocks ids, the last takes the remainder."""
    step = n // blocks
    return spark.range(blocks).select(
        F.col("id").alias("block"), (F.col("id") * step).alias("start"), F.when(F.col("id") == blocks - 1, n - F.col("id") * step).otherwise(step).alias("size")
    )


def csc(t: DataFrame) -> DataFrame:
    """Per (part, col): the rows in order and their values."""
    cells = F.sort_array(F.collect_list(F.struct("row", "value")))
    return t.groupBy("part", "col").agg(cells.alias("c")).select("part", "col", F.col("c.row").alias("rows"), F.col("c.value").alias("vals"))


def row_subset(t: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (row), repeats kept: the listed rows, renumbered by their place in sorted order."""
    placed = numbered(rows.select("row"), "row").withColumnRenamed("idx", "new")
    return t.join(placed, "row").select(F.col("new").alias("row"), "col", "value")


def rectangle(t: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells in the half-open ranges, ids from 0."""
    inside = F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1)
    return t.filter(inside).withColumn("row", F.col("row") - rows[0]).withColumn("col", F.col("col") - cols[0])


def permute(t: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Rename ids by permutation tables (id, idx)."""
    for key, table in (("row", rows), ("col", cols)):
        if table is not None:
            t = t.join(table.select(F.col("id").alias(key), F.col("idx").alias("__new")), key).withColumn(key, F.col("__new")).drop("__new")
    return t.select("row", "col", "value")


def empty_ids(t: DataFrame, among: DataFrame, key: str) -> DataFrame:
    """Ids of `among`'s dense range that `t` has no entry for."""
    return dense_ids(among, key).join(t.select(F.col(key).cast("long").alias(key)).distinct(), key, "left_anti")


def times_vector(t: DataFrame, x: DataFrame) -> DataFrame:
    """(row, y): sparse matrix times x (col, x); rows without entries give 0."""
    got = t.join(x, "col").groupBy(F.col("row").cast("long").alias("row")).agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    return dense_ids(t, "row").join(got, "row", "left").select("row", F.coalesce("y", F.lit(0.0)).alias("y"))


def times_dense(t: DataFrame, w: DataFrame, a: float = 1.0, h0: DataFrame | None = None) -> DataFrame:
    """(row, t, h): a X W + H0 with W (col, t, w) and H0 (row, t, h0) in long form."""
    got = t.join(w, "col").groupBy(F.col("row").cast("long").alias("row"), "t").agg((F.sum(F.col("value") * F.col("w")) * a).alias("h"))
    if h0 is None:
        return got
    return got.join(h0, ["row", "t"], "full").select("row", "t", (F.coalesce("h", F.lit(0.0)) + F.coalesce("h0", F.lit(0.0))).alias("h"))
