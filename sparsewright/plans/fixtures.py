"""The matrices, models and logs that queries run on, made from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per order line, with the mark of the 80/20 split."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("row"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    test = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 5 == 0
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select("row", "col", "value", test.alias("test"))


def ratings(spark: SparkSession, sf_dir: str, test: bool | None = None) -> DataFrame:
    """Cells with their values summed: all, the training or the test part."""
    r = raw(spark, sf_dir)
    r = r if test is None else r.filter(F.col("test") == test)
    return r.groupBy("row", "col").agg(F.sum("value").alias("value"))


def tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation by market segment, the mean account balance in thousands."""
    c = table(spark, sf_dir, "customer")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    seg = F.array_position(F.array(*map(F.lit, names)), F.col("c_mktsegment")).cast("int") - 1
    return c.groupBy(F.col("c_nationkey").alias("row"), seg.alias("col")).agg(F.round(F.avg("c_acctbal") / 1000, 4).alias("value"))


def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by event type (by its name's first letters), summed values in tens."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("row"), (F.ascii(F.substring("event_type", 1, 1)) * 256 + F.ascii(F.substring("event_type", 2, 1))).cast("long").alias("col")).agg(
        F.round(F.sum("value") / 10, 4).alias("value")
    )


def row_factors(ids: DataFrame, key: str = "row", k: int = K) -> DataFrame:
    """A given model: (id * 7 + t * 3) % 10 / 20."""
    return ids.select(key).distinct().select(key, F.array(*(((F.col(key) * 7 + t * 3) % 10) / 20.0 for t in range(k))).alias("vec"))


def col_factors(ids: DataFrame, key: str = "col", k: int = K) -> DataFrame:
    """A given model: (id * 5 + t * 2) % 10 / 20."""
    return ids.select(key).distinct().select(key, F.array(*(((F.col(key) * 5 + t * 2) % 10) / 20.0 for t in range(k))).alias("vec"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, nw, ci, ctype, time, rmse, update): a log of twelve runs, rmse falling with noise."""
    e = table(spark, sf_dir, "events")
    run = F.col("user_id") % 12
    t = F.col("event_id").cast("double")
    noise = (F.col("event_id") * 37 % 101) / 1000.0
    return e.select(
        F.concat(F.lit("d"), F.floor(run / 8).cast("string")).alias("ds"), (F.pmod(F.floor(run / 4), F.lit(2)) * 4 + 4).cast("int").alias("nw"), F.lit(10).alias("ci"),
        F.element_at(F.array(*map(F.lit, ("none", "sync", "async", "vs"))), (run % 4 + 1).cast("int")).alias("ctype"), t.alias("time"),
        F.round(0.9 + 10.0 / (1.0 + t / 50.0) + noise, 6).alias("rmse"), (F.col("event_id") * 100).alias("update"),
    )


def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, nw, ci, ctype, n, time, cost): a checkpoint at every tenth event of a run that takes any."""
    r = run_log(spark, sf_dir).filter("ctype <> 'none' and update % 1000 = 0")
    return r.select("ds", "nw", "ci", "ctype", (F.col("update") / 1000).cast("int").alias("n"), "time", F.round((F.col("update") % 7000) / 10000.0 + 0.1, 4).alias("cost"))


#: The same in SQL, to follow WITH.
RAW = """raw AS (SELECT o_custkey AS r, l_partkey AS c, l_quantity AS v, (l_orderkey * 31 + l_linenumber * 17) % 5 = 0 AS test
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = RAW + ", m AS (SELECT r, c, sum(v) AS v FROM raw GROUP BY r, c)"
TRAIN = RAW + ", m AS (SELECT r, c, sum(v) AS v FROM raw WHERE NOT test GROUP BY r, c)"
TINY = """m AS (SELECT c_nationkey AS r, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS c,
    round(avg(c_acctbal) / 1000, 4) AS v FROM customer GROUP BY 1, 2)"""
EVENTS = """m AS (SELECT user_id AS r, ascii(substr(event_type, 1, 1)) * 256 + ascii(substr(event_type, 2, 1)) AS c,
    round(sum(value) / 10, 4) AS v FROM events GROUP BY 1, 2)"""


def given(k: int = K) -> str:
    """w(id), h(id): the given model's vectors as SQL lists; use after a relation m."""
    w = ", ".join(f"((r * 7 + {t * 3}) % 10) / 20.0::DOUBLE" for t in range(k))
    h = ", ".join(f"((c * 5 + {t * 2}) % 10) / 20.0::DOUBLE" for t in range(k))
    return f"w AS (SELECT DISTINCT r, [{w}] AS w FROM m), h AS (SELECT DISTINCT c, [{h}] AS h FROM m)"


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
LOG = """rl AS (SELECT 'd' || (user_id % 12 // 8) AS ds, CAST((user_id % 12 // 4) % 2 * 4 + 4 AS INTEGER) AS nw, 10 AS ci,
    ['none', 'sync', 'async', 'vs'][CAST(user_id % 4 AS INTEGER) + 1] AS ctype, event_id::DOUBLE AS time,
    round(0.9::DOUBLE + 10.0::DOUBLE / (1.0::DOUBLE + event_id::DOUBLE / 50.0::DOUBLE) + (event_id * 37 % 101) / 1000.0::DOUBLE, 6) AS rmse, event_id * 100 AS update FROM events),
  cl AS (SELECT ds, nw, ci, ctype, CAST(update / 1000 AS INTEGER) AS n, time, round((update % 7000) / 10000.0::DOUBLE + 0.1::DOUBLE, 4) AS cost FROM rl WHERE ctype <> 'none' AND update % 1000 = 0)"""
