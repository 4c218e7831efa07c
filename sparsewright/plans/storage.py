"""Queries that write and read the formats."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import functions as S
from ..operators import matrix as M
from ..operators import metrics as E
from ..operators import synth as Y
from ..operators.checkpoint import scratch, shared_folder
from ..sources import binary as B
from ..sources import model as D
from ..sources import text as T
from . import fixtures as X
from .catalogue import query

W = "WITH "
_ALL = W + X.RATINGS + ' SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, v AS value FROM m'


def _folder(spark):
    folder = B.local(f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _written(spark, sf, long):
    t = X.ratings(spark, sf)
    path = f"{_folder(spark)}/train.dat"
    rows, cols = t.agg(F.max("row") + 1, F.max("col") + 1).first()
    B.write(t, path, rows, cols, long)
    return path


@query("s1_binary_read", _ALL)
def _(spark, sf):
    return B.read(spark, _written(spark, sf, True), 5)


@query("s12_long_format_parts", W + X.RATINGS + ", t AS (SELECT max(r) + 1 AS n FROM m) SELECT CAST(1015 AS INTEGER) AS file_id, (SELECT n FROM t) AS nrows, count(*) AS nnz, 20 + 4 * (SELECT n FROM t) + 12 * count(*) AS bytes, sum(v) AS total FROM m")
def _(spark, sf):
    """The long format's header, size and values after many tasks wrote their parts."""
    path = _written(spark, sf, True)
    with open(path, "rb") as f:
        kind = int.from_bytes(f.read(4), "little")
    rows, _, nnz = B.probe(path)
    total = B.read(spark, path, 3).agg(F.sum("value")).first()[0]
    return spark.createDataFrame([(kind, rows, nnz, os.path.getsize(path), total)], "file_id int, nrows long, nnz long, bytes long, total double")


@query("s10_binary_write", _ALL)
def _(spark, sf):
    return B.read_any(spark, "file://" + _written(spark, sf, False))


@query("s8_data_round_trip", W + X.RATINGS + ' SELECT r AS "row", c AS col, v AS value FROM m')
def _(spark, sf):
    D.save_data(X.ratings(spark, sf), folder := scratch(spark))
    return D.load_data(spark, folder)


@query("s22_view_data", W + X.RATINGS + " SELECT unnest(['type', 'nrows', 'ncols', 'nnz']) AS name, unnest(['data', (max(r) + 1)::VARCHAR, (max(c) + 1)::VARCHAR, count(*)::VARCHAR]) AS value FROM m")
def _(spark, sf):
    D.save_data(X.ratings(spark, sf), folder := scratch(spark))
    return D.view(spark, folder).filter("name <> 'mean'")


@query("s22_view_model", "SELECT unnest(['type', 'dim', 'epochs', 'lam_row', 'lam_col', 'lrate', 'biased', 'renamed']) AS name, unnest(['model', '4', '3', '0.05', '0.1', '0.01', 'True', 'False']) AS value")
def _(spark, sf):
    D.save_model(_model(spark, sf), folder := scratch(spark))
    return D.view(spark, folder).filter("name <> 'mean'")


@query("s4_row_slice_read", W + X.RATINGS + ' SELECT CAST(r // 10 AS BIGINT) AS slice, count(*) AS n, sum(v) AS total FROM m GROUP BY 1')
def _(spark, sf):
    return B.read(spark, _written(spark, sf, True), 4).groupBy(F.floor(F.col("row") / 10).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("s3_train_test_pair", W + X.RAW + ", m AS (SELECT test, r, c, sum(v) AS v FROM raw GROUP BY ALL) SELECT test, count(*) AS n, sum(v) AS total FROM m GROUP BY test")
def _(spark, sf):
    folder = _folder(spark)
    rows, cols = X.raw(spark, sf).agg(F.max("row") + 1, F.max("col") + 1).first()
    for name, test in (("train", False), ("test", True)):
        B.write(X.ratings(spark, sf, test), f"{folder}/{name}.dat", rows, cols)
    train, test = B.load_pair(spark, folder)
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return both.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("s2_num_cols", W + X.RATINGS + " SELECT max(r) + 1 AS nrows, max(c) + 1 AS ncols, count(*) AS nnz FROM m")
def _(spark, sf):
    return spark.createDataFrame([B.probe(_written(spark, sf, True))], "nrows long, ncols long, nnz long")


def _lines(spark, sf, shift, sep):
    t = X.ratings(spark, sf)
    return t.select(F.concat_ws(sep, (F.col("row") + shift).cast("string"), (F.col("col") + shift).cast("string"), F.col("value").cast("string")).alias("value"))


@query("s5_text_one_based", _ALL)
def _(spark, sf):
    return T.one_based(_lines(spark, sf, 1, " "))


@query("s5_meta", "SELECT 1500::BIGINT AS nrows, 2000::BIGINT AS ncols, 47900::BIGINT AS train_nnz, 'train.txt' AS train, 12000::BIGINT AS test_nnz, 'test.txt' AS test")
def _(spark, sf):
    return T.meta(spark.range(1).select(F.explode(F.array(*map(F.lit, ("1500 2000", "47900 train.txt", "12000 test.txt")))).alias("value")))


@query("s6_tsv_triples", W + X.RATINGS + ", t AS (SELECT 'u' || r AS u, 'i' || c AS i, v FROM m) SELECT u AS user, i AS item, v AS value FROM t")
def _(spark, sf):
    t = X.ratings(spark, sf)
    return T.tsv_triples(t.select(F.concat_ws("\t", F.concat(F.lit("u"), F.col("row").cast("string")), F.concat(F.lit("i"), F.col("col").cast("string")), F.col("value").cast("string")).alias("value")))


@query("s7_text_zero_based", W + X.RATINGS + " SELECT CAST(max(r) + 1 AS INTEGER) AS nrows, CAST(max(c) + 1 AS INTEGER) AS ncols, count(*) AS nnz, round(avg(v), 6) AS mean FROM m")
def _(spark, sf):
    return M.dimensions(T.zero_based(_lines(spark, sf, 0, " "))).withColumn("mean", F.round("mean", 6))


def _model(spark, sf, renamed=False):
    """The given factors with their last place as bias; ids as they are, or renamed."""
    t = X.ratings(spark, sf)
    factors = X.row_factors(t).select(F.lit("row").alias("kind"), F.col("row").alias("id"), "vec").unionByName(X.col_factors(t).select(F.lit("col").alias("kind"), F.col("col").alias("id"), "vec"))
    ids = {}
    if renamed:
        ids = {"row_ids": M.id_map(t.select("row"), shuffled=True), "col_ids": M.id_map(t.select("col"), shuffled=True)}
        new = ids["row_ids"].withColumn("kind", F.lit("row")).unionByName(ids["col_ids"].withColumn("kind", F.lit("col")))
        factors = factors.join(new, ["kind", "id"]).select("kind", F.col("idx").alias("id"), "vec")
    return D.from_factors(factors, True, **ids, dim=4, epochs=3, lam_row=0.05, lam_col=0.1, lrate=0.01, mean=2.5)


_BIASED = X.DOT.format(a="w[1:3]", b="h[1:3]")


@query("s9_model_round_trip", W + X.RATINGS + ", " + X.given() + f" SELECT r AS \"row\", c AS col, round({_BIASED} + 2.5 + w[4] + h[4], 6) AS pred FROM m JOIN w USING (r) JOIN h USING (c)")
def _(spark, sf):
    """Predictions of a reloaded model: factors, biases, mean and id maps."""
    D.save_model(_model(spark, sf, renamed=True), folder := scratch(spark))
    return D.predict(D.load_model(spark, folder), X.ratings(spark, sf)).select("row", "col", F.round("pred", 6).alias("pred"))


@query("s11_id_map", "SELECT c_name AS id, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM customer")
def _(spark, sf):
    return M.id_map(X.table(spark, sf, "customer").select("c_name"))


@query("s13_factor_lines", W + X.RATINGS + ", " + X.given() + " SELECT 'row,' || r || ',' || array_to_string(list_transform(w, lambda x: printf('%.6f', x)), ',') AS value FROM w UNION ALL SELECT 'column,' || c || ',' || array_to_string(list_transform(h, lambda x: printf('%.6f', x)), ',') FROM h")
def _(spark, sf):
    t = X.ratings(spark, sf)
    return T.factor_lines(X.row_factors(t), "row", "row").union(T.factor_lines(X.col_factors(t), "col", "column"))


@query("s14_snapshot_files", W + X.RATINGS + ", " + X.given() + " SELECT 2 AS epoch, count(*) AS n FROM w UNION ALL SELECT 3, count(*) FROM w")
def _(spark, sf):
    t, folder = X.ratings(spark, sf), f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    for epoch in (2, 3):
        X.row_factors(t).write.parquet(f"{folder}/epoch={epoch}")
    return spark.read.parquet(folder).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


@query("s15_degree_frequency", W + X.RATINGS + ", d AS (SELECT r, count(*) AS degree FROM m GROUP BY r) SELECT degree, count(*) AS freq FROM d GROUP BY 1")
def _(spark, sf):
    d = X.ratings(spark, sf).groupBy("row").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("freq"))
    return T.degrees_of(T.degree_lines(d))


@query("s18_read_logs", W + X.LOG + " SELECT time, rmse, 0.5::DOUBLE AS diff, update FROM rl")
def _(spark, sf):
    r = X.run_log(spark, sf)
    return T.log_rows(r.select(F.concat_ws(",", F.col("time").cast("string"), F.col("rmse").cast("string"), F.lit("0.5"), F.col("update").cast("string")).alias("value")))


@query("s18_read_checkpoints", W + X.LOG + " SELECT time, cost FROM cl")
def _(spark, sf):
    c = X.checkpoint_log(spark, sf)
    return T.checkpoint_rows(c.select(F.concat_ws(",", F.col("n").cast("string"), F.col("time").cast("string"), F.col("cost").cast("string")).alias("value")))


@query("s19_scan_run_files", W + X.LOG + " SELECT ds, nw, ci, ctype, count(*) AS n FROM rl WHERE nw = 8 GROUP BY ALL")
def _(spark, sf):
    """Files named by their runs; the parts come from the file names, the filter on them."""
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    r = X.run_log(spark, sf)
    name = F.format_string("%s-%d-%d-%s-rmse.csv", "ds", "nw", "ci", "ctype")
    r.select(name.alias("run"), F.concat_ws(",", F.col("time").cast("string"), F.col("rmse").cast("string"), F.lit("0"), F.col("update").cast("string")).alias("value")).write.partitionBy("run").text(folder)
    file = F.regexp_extract(F.input_file_name(), r"run=([^/]+)/", 1)
    lines = spark.read.text(folder).select("value", file.alias("file"))
    return lines.select("value", *(c.alias(k) for k, c in S.run_name(F.col("file")).items())).filter("nw = 8").groupBy("ds", "nw", "ci", "ctype").agg(F.count(F.lit(1)).alias("n"))


@query("s20_table_dump_load", "SELECT c_custkey AS id, c_name AS name, printf('%.2f', c_acctbal) AS amount FROM customer")
def _(spark, sf):
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    t = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.format_string("%.2f", "c_acctbal").alias("amount"))
    for half in (0, 1):
        t.filter(F.col("id") % 2 == half).write.mode("append").csv(folder, sep="\t", header=True)
    return spark.read.schema("id long, name string, amount string").csv(folder, sep="\t", header=True)


@query("s21_prediction_lines", W + X.RATINGS + ", " + X.given() + f", p AS (SELECT r * 100000 + c AS n, {X.DOT.format(a='w', b='h')} AS p FROM m JOIN w USING (r) JOIN h USING (c)) SELECT n, printf('%f', p) AS value FROM p")
def _(spark, sf):
    t = X.ratings(spark, sf)
    s = E.scored(t, X.row_factors(t), X.col_factors(t))
    return T.prediction_lines(s.withColumn("n", F.col("row") * 100000 + F.col("col")))


@query("s12_generated_round_trip")
def _(spark, sf):
    """A generated matrix written and read again: the differing cells, none."""
    t = Y.generate(spark, 200, 60, 4).filter("not test").select("row", "col", "value")
    t.write.parquet(made := f"{shared_folder(spark)}/made-{uuid.uuid4().hex}")
    t = spark.read.parquet(made)
    B.write(t, path := f"{_folder(spark)}/train.dat", 200, 60)
    both = t.select(F.col("row").cast("int"), F.col("col").cast("int"), "value").withColumn("n", F.lit(1)).unionByName(B.read(spark, path).withColumn("n", F.lit(-1)))
    return both.groupBy("row", "col", "value").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.abs("n")).alias("different"))
