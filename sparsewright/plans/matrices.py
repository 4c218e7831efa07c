"""Queries of keys, degrees, blocks, views, products, orders and unions of sparse matrices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matrix as M
from . import fixtures as X
from .catalogue import query

W = "WITH "


def r6(c, name):
    return F.round(c, 6).alias(name)


def _terms(spark, sf):
    """Words of documents as string-keyed triplets."""
    d = X.table(spark, sf, "documents")
    words = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("user"), F.explode(F.split("text", r"[ \n\t]+")).alias("item"))
    return words.filter("item <> ''").groupBy("user", "item").agg(F.count(F.lit(1)).cast("double").alias("value"))


_TERMS = r"t AS (SELECT 'doc' || doc_id AS u, unnest(regexp_split_to_array(text, '[ \n\t]+')) AS i FROM documents), x AS (SELECT u, i, count(*)::DOUBLE AS v FROM t WHERE i <> '' GROUP BY u, i)"


@query("p1_dictionary_encode", W + _TERMS + """, a AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS r FROM (SELECT DISTINCT u FROM x)),
    b AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS c FROM (SELECT DISTINCT i FROM x)) SELECT r AS "row", c AS col, v AS value FROM x JOIN a USING (u) JOIN b USING (i)""")
def _(spark, sf):
    t = _terms(spark, sf)
    return M.encode(t, M.id_map(t.select("user")), M.id_map(t.select("item")))


@query("p2_shuffled_ids", "SELECT c_custkey AS id, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1 AS idx FROM customer")
def _(spark, sf):
    return M.id_map(X.table(spark, sf, "customer").select("c_custkey"), shuffled=True)


@query("p3_sum_duplicates", W + X.RATINGS + ' SELECT r AS "row", c AS col, v AS value FROM m')
def _(spark, sf):
    return M.sum_duplicates(X.raw(spark, sf))


@query("p4_row_degrees", W + X.RATINGS + ', d AS (SELECT unnest(range(0, (SELECT max(r) + 1 FROM m))) AS r) SELECT r AS "row", count(c) AS nnz FROM d LEFT JOIN m USING (r) GROUP BY r')
def _(spark, sf):
    return M.degrees(X.ratings(spark, sf), "row")


@query("p5_dimensions", W + X.RATINGS + " SELECT max(r) + 1 AS nrows, max(c) + 1 AS ncols, count(*) AS nnz FROM m")
def _(spark, sf):
    return M.dimensions(X.ratings(spark, sf)).drop("mean")


@query("p6_mean", W + X.RATINGS + " SELECT round(avg(v), 6) AS mean FROM m")
def _(spark, sf):
    return M.dimensions(X.ratings(spark, sf)).select(r6("mean", "mean"))


@query("p7_remove_bias", W + X.RATINGS + ' SELECT r AS "row", c AS col, round(v - (SELECT avg(v) FROM m), 6) AS value FROM m')
def _(spark, sf):
    t = X.ratings(spark, sf)
    return M.remove_bias(t).withColumn("value", F.round("value", 6))


@query("p8_row_parts", W + X.RATINGS + ", s AS (SELECT CAST(ceil((max(r) + 1) / 7.0) AS BIGINT) AS z FROM m) SELECT r // z AS part, count(*) AS n, min(r) AS lo, max(r) AS hi FROM m, s GROUP BY 1")
def _(spark, sf):
    t = X.ratings(spark, sf)
    size = M.part_size(t.agg(F.max("row") + 1).first()[0], 7)
    return M.row_parts(t, size).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"))


@query("p9_local_rows", W + X.RATINGS + ' SELECT r // 100 AS part, r - r // 100 * 100 AS local, sum(v) AS value FROM m GROUP BY 1, 2')
def _(spark, sf):
    return M.row_parts(X.ratings(spark, sf), 100).groupBy("part", "local").agg(F.sum("value").alias("value"))


@query("p10_csc", W + X.RATINGS + " SELECT r // 100 AS part, c AS col, list(r ORDER BY r) AS rows, list(v ORDER BY r) AS vals FROM m GROUP BY 1, 2")
def _(spark, sf):
    return M.csc(M.row_parts(X.ratings(spark, sf), 100))


@query("p11_column_offsets", W + X.RATINGS + """, d AS (SELECT unnest(range(0, (SELECT max(c) + 1 FROM m))) AS c), n AS (SELECT c, count(r) AS nnz FROM d LEFT JOIN m USING (c) GROUP BY c)
    SELECT c AS col, nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n""")
def _(spark, sf):
    return M.offsets(M.degrees(X.ratings(spark, sf), "col"), "col")


@query("p12_transpose", W + X.RATINGS + ' SELECT c AS "row", r AS col, v AS value FROM m')
def _(spark, sf):
    return M.transpose(X.ratings(spark, sf))


@query("p13_row_subset", W + X.RATINGS + ", l AS (SELECT c_custkey AS r, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_custkey % 5 = 2) SELECT n AS \"row\", c AS col, v AS value FROM m JOIN l USING (r)")
def _(spark, sf):
    rows = X.table(spark, sf, "customer").filter("c_custkey % 5 = 2").select(F.col("c_custkey").alias("row"))
    return M.row_subset(X.ratings(spark, sf), rows)


@query("p14_rectangle", W + X.RATINGS + ' SELECT r - 10 AS "row", c - 20 AS col, v AS value FROM m WHERE r >= 10 AND r < 60 AND c >= 20 AND c < 150')
def _(spark, sf):
    return M.rectangle(X.ratings(spark, sf), (10, 60), (20, 150))


_PERM = ", pr AS (SELECT r, row_number() OVER (ORDER BY md5(r::VARCHAR), r) - 1 AS i FROM (SELECT DISTINCT r FROM m)), pc AS (SELECT c, row_number() OVER (ORDER BY md5(c::VARCHAR), c) - 1 AS j FROM (SELECT DISTINCT c FROM m))"


@query("p15_permute", W + X.RATINGS + _PERM + ' SELECT DISTINCT i AS "row", j AS col, v AS value FROM m JOIN pr USING (r) JOIN pc USING (c)')
def _(spark, sf):
    t = X.ratings(spark, sf)
    return M.permute(t, M.id_map(t.select("row"), shuffled=True), M.id_map(t.select("col"), shuffled=True)).dropDuplicates()


@query("p16_shuffle_columns", W + X.RATINGS + _PERM + ' SELECT r AS "row", j AS col, v AS value FROM m JOIN pc USING (c)')
def _(spark, sf):
    t = X.ratings(spark, sf)
    return M.permute(t, cols=M.id_map(t.select("col"), shuffled=True))


@query("p17_block_ids", W + X.RATINGS + " SELECT r // 40 AS block_row, c // 50 AS block_col, (r // 40) * 1000 + c // 50 AS block, sum(v) AS value FROM m GROUP BY 1, 2, 3")
def _(spark, sf):
    b = M.block_ids(X.ratings(spark, sf), 40, 50)
    return b.groupBy("block_row", "block_col", (F.col("block_row") * 1000 + F.col("block_col")).alias("block")).agg(F.sum("value").alias("value"))


@query("p18_grid", W + X.RATINGS + ", z AS (SELECT CAST(ceil((max(r) + 1) / 8.0) AS BIGINT) AS a, CAST(ceil((max(c) + 1) / 8.0) AS BIGINT) AS b FROM m) SELECT r // a AS block_row, c // b AS block_col, count(*) AS n FROM m, z GROUP BY 1, 2")
def _(spark, sf):
    t = X.ratings(spark, sf)
    n, m = t.agg(F.max("row") + 1, F.max("col") + 1).first()
    return M.block_ids(t, M.part_size(n, 8), M.part_size(m, 8)).groupBy("block_row", "block_col").agg(F.count(F.lit(1)).alias("n"))


@query("p19_extents", "SELECT i AS block, i * 142 AS start, CASE WHEN i = 6 THEN 1000 - i * 142 ELSE 142 END AS size FROM range(7) t(i)")
def _(spark, sf):
    return M.extents(spark, 1000, 7)


@query("p20_block_histogram", W + X.RATINGS + " SELECT r // 16 AS block_row, c // 16 AS block_col, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, sf):
    return M.block_ids(X.ratings(spark, sf), 16, 16).groupBy("block_row", "block_col").agg(F.count(F.lit(1)).alias("n"))


@query("p21_sort_in_blocks", W + X.RATINGS + ' SELECT r // 64 AS block_row, c // 64 AS block_col, r AS "row", c AS col, row_number() OVER (PARTITION BY r // 64, c // 64 ORDER BY r, c) AS place FROM m')
def _(spark, sf):
    place = F.row_number().over(Window.partitionBy("block_row", "block_col").orderBy("row", "col"))
    return M.block_ids(X.ratings(spark, sf), 64, 64).select("block_row", "block_col", "row", "col", place.cast("long").alias("place"))


@query("p22_redistribute", W + X.RATINGS + " SELECT c AS col, count(*) AS n, sum(v) AS total, 1::BIGINT AS parts FROM m GROUP BY c")
def _(spark, sf):
    """Every column's entries lie in one partition afterwards."""
    t = X.ratings(spark, sf).repartition("col").withColumn("part", F.spark_partition_id())
    own = t.groupBy("col", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return own.groupBy("col").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("parts"))


@query("p23_validation_range", W + X.RAW + ", a AS (SELECT max(r) AS r, max(c) AS c FROM raw WHERE NOT test), b AS (SELECT max(r) AS r, max(c) AS c FROM raw WHERE test) SELECT b.r <= a.r AND b.c <= a.c AS inside FROM a, b")
def _(spark, sf):
    raw = X.raw(spark, sf)
    top = lambda k, t: F.max(F.when(F.col("test") == t, F.col(k)))
    return raw.agg(((top("row", True) <= top("row", False)) & (top("col", True) <= top("col", False))).alias("inside"))


@query("p24_empty_columns", W + X.RAW + ", d AS (SELECT unnest(range(0, (SELECT max(c) + 1 FROM raw))) AS c) SELECT count(*) AS n FROM d WHERE c NOT IN (SELECT c FROM raw WHERE NOT test)")
def _(spark, sf):
    raw = X.raw(spark, sf)
    return M.empty_ids(raw.filter("not test"), raw, "col").agg(F.count(F.lit(1)).alias("n"))


@query("j6_ids_without_entries", W + X.RAW + ', d AS (SELECT unnest(range(0, (SELECT max(c) + 1 FROM raw))) AS c) SELECT c AS col FROM d WHERE c NOT IN (SELECT c FROM raw WHERE test)')
def _(spark, sf):
    raw = X.raw(spark, sf)
    return M.empty_ids(raw.filter("test"), raw, "col")


@query("p25_split", W + X.RAW + " SELECT test, count(*) AS n, sum(v) AS total FROM raw GROUP BY test")
def _(spark, sf):
    return X.raw(spark, sf).groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("p26_column_major", W + X.RATINGS + ' SELECT row_number() OVER (ORDER BY c, r) AS place, r AS "row", c AS col, v AS value FROM m')
def _(spark, sf):
    return M.numbered(X.ratings(spark, sf), "col", "row").select((F.col("idx") + 1).alias("place"), "row", "col", "value")


@query("o1_multi_key_sort", "SELECT row_number() OVER (ORDER BY p_size, p_brand, p_partkey) AS place, p_partkey FROM part")
def _(spark, sf):
    counted = X.table(spark, sf, "part").select("p_size", "p_brand", "p_partkey")
    totals = counted.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("p_size").orderBy("p_brand", "p_partkey"))
    return counted.withColumn("own", own).join(totals.select("p_size", before.alias("b")), "p_size").select((F.col("b") + F.col("own")).alias("place"), "p_partkey")


@query("o2_row_major", W + X.RATINGS + ' SELECT r AS "row", list(c ORDER BY c) AS cols FROM m GROUP BY r')
def _(spark, sf):
    return X.ratings(spark, sf).groupBy("row").agg(F.sort_array(F.collect_list("col")).alias("cols"))


@query("o3_by_block", W + X.RATINGS + ' SELECT r // 64 * 1000 + c // 64 AS block, min(r) AS lo, max(c) AS hi, count(*) AS n FROM m GROUP BY 1')
def _(spark, sf):
    b = M.block_ids(X.ratings(spark, sf), 64, 64).withColumn("block", F.col("block_row") * 1000 + F.col("block_col"))
    return b.sort("block", "row", "col").groupBy("block").agg(F.min("row").alias("lo"), F.max("col").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("o4_first_n", W + X.RATINGS + ' SELECT r AS "row", c AS col, v AS value FROM m WHERE c % 3 = 1 ORDER BY r, c LIMIT 50')
def _(spark, sf):
    return X.ratings(spark, sf).filter("col % 3 = 1").orderBy("row", "col").limit(50)


@query("u1_id_union", W + X.RAW + " SELECT DISTINCT c AS id FROM raw")
def _(spark, sf):
    raw = X.raw(spark, sf)
    return raw.filter("test").select(F.col("col").alias("id")).union(raw.filter("not test").select("col")).distinct()


@query("u2_append_tables", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    c = X.table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    s = X.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("amount"), F.col("s_suppkey").alias("id"), F.lit("s").alias("kind"))
    return c.unionByName(s)


@query("j2_id_lookup", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def _(spark, sf):
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return X.table(spark, sf, "lineitem").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("a8_column_nnz", W + X.RATINGS + " SELECT c AS col, count(*) AS nnz FROM m GROUP BY c")
def _(spark, sf):
    return X.ratings(spark, sf).groupBy("col").agg(F.count(F.lit(1)).alias("nnz"))


@query("a15_matrix_vector", W + X.RATINGS + ', d AS (SELECT unnest(range(0, (SELECT max(r) + 1 FROM m))) AS r) SELECT r AS "row", round(coalesce(sum(v * ((c * 3) % 7 / 7.0::DOUBLE)), 0), 6) AS y FROM d LEFT JOIN m USING (r) GROUP BY r')
def _(spark, sf):
    t = X.ratings(spark, sf)
    x = t.select("col").distinct().withColumn("x", (F.col("col") * 3) % 7 / 7.0)
    return M.times_vector(t, x).withColumn("y", F.round("y", 6))


@query("a15_transposed_vector", W + X.RATINGS + ', d AS (SELECT unnest(range(0, (SELECT max(c) + 1 FROM m))) AS c) SELECT c AS "row", round(coalesce(sum(v * ((r * 3) % 7 / 7.0::DOUBLE)), 0), 6) AS y FROM d LEFT JOIN m USING (c) GROUP BY c')
def _(spark, sf):
    t = M.transpose(X.ratings(spark, sf))
    x = t.select("col").distinct().withColumn("x", (F.col("col") * 3) % 7 / 7.0)
    return M.times_vector(t, x).withColumn("y", F.round("y", 6))


@query("a16_matrix_dense", W + X.RATINGS + ', w AS (SELECT c, t, ((c + t) % 5) / 5.0::DOUBLE AS w FROM (SELECT DISTINCT c FROM m), range(3) g(t)) SELECT r AS "row", CAST(t AS INTEGER) AS t, round(2.0::DOUBLE * sum(v * w) + (r + t) % 4, 6) AS h FROM m JOIN w USING (c) GROUP BY r, t')
def _(spark, sf):
    t = X.ratings(spark, sf)
    w = t.select("col").distinct().select("col", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t")).withColumn("w", (F.col("col") + F.col("t")) % 5 / 5.0)
    h0 = t.select("row").distinct().select("row", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t")).withColumn("h0", ((F.col("row") + F.col("t")) % 4).cast("double"))
    return M.times_dense(t, w, 2.0, h0).withColumn("h", F.round("h", 6))


@query("a12_prepared_columns", W + X.RATINGS + " SELECT count(DISTINCT c) AS n FROM m")
def _(spark, sf):
    return X.ratings(spark, sf).select("col").distinct().agg(F.count(F.lit(1)).alias("n"))
