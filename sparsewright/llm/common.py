"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters that the normalisation of texts maps, and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.  Pure ASCII takes the byte-wise built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def checkpointed(df: DataFrame, slim: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process
    (tests, a laptop) is one made here: on a cluster it would be one machine's own.  The files survive lost executors, unlike a local checkpoint; they go with the folder.
    A `slim` table has ids, keys and numbers only, next to nothing in partitions that are sized for texts: it is
    written by four tasks for each core at most, so that rounds over small tables don't drown in tasks and files.
    A table, not ``DataFrame.checkpoint``: that keeps the optimiser's size estimates, which the joins of
    a loop multiply round by round, while a table is as large as its files.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if slim else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most keys that `join_counted` broadcasts.
HOT_KEYS = 4096


def join_counted(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """left JOIN right on `key`, safe for keys that hold any part of `left`.

    `right` has one row per key, with `n`, the key's rows in `left`; it should be cheap to read twice.
    Keys with at least 1/`HOT_KEYS` of the counted rows, so at most `HOT_KEYS` of them, are broadcast and
    joined where the rows lie; the others are shuffled, and none of them is large.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(2.0, total / HOT_KEYS)
    few, many = right.filter(hot).drop("n"), right.filter(~hot).drop("n")
    at_once = left.join(F.broadcast(few), key)
    return at_once.unionByName(left.join(F.broadcast(few.select(*key)), key, "left_anti").join(many, key, how))


#: Stands for a null id: it comes before all others.
NO_ID = -(1 << 63)


def row_keys(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, tie, row): every row as a struct, so that no column's name matters, and what tells rows apart.

    `tie` is a hash of the text (A-Z lower-cased, null as empty) and of the columns `more`; rows of one id and
    tie are taken for copies of one row.
    """
    tie = F.xxhash64(ascii_lower(F.col(text_col)), *(F.struct(F.col(c)) for c in more))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), tie.alias("tie"), F.struct(*docs.columns).alias("row"))


def rows_of(keyed: DataFrame, chosen: DataFrame, key: list[str], smallest_digest: str | None = None) -> DataFrame:
    """One of `keyed`'s rows (`row_keys`) for each key of `chosen`, its columns unpacked.

    `chosen` has a row for each of `keyed`'s rows of these keys.  Only the rows of keys that it has more than
    once are gathered, by a map-side combined minimum.  The keys are as many as rows stay: they are merged, at
    any size, not broadcast.
    """
    wanted = checkpointed(slim=True, df=chosen.groupBy(*key).agg(F.count(F.lit(1)).alias("times")))
    out = keyed.join(wanted.filter("times = 1").select(*key).hint("merge"), key, "left_semi").select("row")
    if not (several := wanted.filter("times > 1")).isEmpty():
        digest = [F.sha2(ascii_lower(F.col("row")[smallest_digest]), 256)] if smallest_digest else []
        first = F.min_by("row", F.struct(*digest, F.xxhash64("row")))
        out = out.unionByName(keyed.join(several.select(*key), key, "left_semi").groupBy(*key).agg(first.alias("row")).select("row"))
    return out.select("row.*")
