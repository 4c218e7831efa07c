"""Analytics over run logs: (ds, nw, ci, ctype, time, rmse, update) and checkpoints (.., n, time, cost)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ("ds", "nw", "ci", "ctype")
KINDS = ("none", "sync", "async", "vs")


def differences(log: DataFrame) -> DataFrame:
    """Adds `diff`, the change of rmse since the run's previous check; null at the first."""
    w = Window.partitionBy(*RUN).orderBy("time")
    return log.withColumn("diff", F.col("rmse") - F.lag("rmse").over(w))


def prune_heading(log: DataFrame, th: float = 0.005) -> DataFrame:
    """Keeps each run from its last row with diff > 0 or diff / rmse > th on; all of it if there is none."""
    run = Window.partitionBy(*RUN)
    last = F.max(F.when((F.col("diff") > 0) | (F.col("diff") / F.col("rmse") > th), F.col("time"))).over(run)
    return log.withColumn("__last", last).filter(F.col("__last").isNull() | (F.col("time") >= F.col("__last"))).drop("__last")


def ending_rmse(log: DataFrame, *by: str) -> DataFrame:
    """Largest of the runs' last rmse, per group or overall, as `threshold`."""
    last = log.groupBy(*RUN).agg(F.max_by("rmse", "time").alias("r"))
    return last.groupBy(*by).agg(F.max("r").alias("threshold"))


def at_threshold(log: DataFrame) -> DataFrame:
    """`log` with `threshold`: each run's first row with rmse <= threshold, its first row if none qualifies."""
    ok = F.col("rmse") <= F.col("threshold")
    first = F.coalesce(F.min(F.when(ok, F.struct("time", "rmse"))), F.min(F.struct("time", "rmse")))
    return log.groupBy(*RUN).agg(first.alias("f")).select(*RUN, F.col("f.time").alias("time"), F.col("f.rmse").alias("rmse"))


def with_checkpoints(points: DataFrame, checkpoints: DataFrame, before: bool = False) -> DataFrame:
    """Adds `ncp` and `tcost`: checkpoints of the run at or before its point (or strictly before)."""
    c = checkpoints.select(*RUN, F.col("time").alias("ct"), "cost")
    hit = F.col("ct") < F.col("time") if before else F.col("ct") <= F.col("time")
    one = F.when(hit, F.lit(1))
    joined = points.join(c, list(RUN), "left")
    return joined.groupBy(*RUN, "time", "rmse").agg(F.count(one).alias("ncp"), F.coalesce(F.sum(F.when(hit, F.col("cost"))), F.lit(0.0)).alias("tcost"))


def comparison(info: DataFrame) -> DataFrame:
    """One row per (ds, nw, ci): t_*, nc_*, tc_* of the four kinds; 0 where a kind has no run."""
    pick = lambda c, kind: F.coalesce(F.max(F.when(F.col("ctype") == kind, F.col(c))), F.lit(0))
    return info.groupBy("ds", "nw", "ci").agg(
        *(pick("time", k).alias(f"t_{k}") for k in KINDS), *(pick("ncp", k).alias(f"nc_{k}") for k in KINDS[1:]), *(pick("tcost", k).alias(f"tc_{k}") for k in KINDS[1:])
    )


def overhead(table: DataFrame, average: bool = False, relative: bool = False) -> DataFrame:
    """o_sync, o_async, o_vs: extra time, optionally per checkpoint and in percent; null where it would divide by 0."""

    def one(kind: str) -> Column:
        d = F.col(f"t_{kind}") - F.col("t_none")
        d = F.when(F.col(f"nc_{kind}") != 0, d / F.col(f"nc_{kind}")) if average else d
        return F.when(F.col("t_none") != 0, d / F.col("t_none") * 100) if relative else d

    return table.select("ds", "nw", "ci", *(one(k).alias(f"o_{k}") for k in KINDS[1:]))


def scaling(table: DataFrame, value: str) -> DataFrame:
    """Against the smallest number of workers of (ds, ci): `ideal` time and `speedup`."""
    w = Window.partitionBy("ds", "ci").orderBy("nw").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y0, x0 = F.first(value).over(w), F.first("nw").over(w)
    return table.withColumn("ideal", y0 * x0 / F.col("nw")).withColumn("speedup", F.when(F.col(value) != 0, y0 / F.col(value) * x0))


def parse_log(lines: DataFrame) -> DataFrame:
    """Termination-check lines of exactly 15 fields to (time, rmse, diff, update); `lines` has a column value."""
    f = F.split(F.trim("value"), r"\s+")
    strip = lambda k: F.regexp_replace(F.element_at(f, k), "[:,]", "")
    hits = lines.filter(F.col("value").contains("termination check") & (F.size(f) == 15))
    return hits.select(strip(9).cast("double").alias("time"), strip(11).cast("double").alias("rmse"), strip(13).cast("double").alias("diff"), strip(15).cast("long").alias("update"))


def parse_checkpoints(lines: DataFrame) -> DataFrame:
    """Checkpoint-end lines of exactly 12 fields to (n, time, cost)."""
    f = F.split(F.trim("value"), r"\s+")
    strip = lambda k: F.regexp_replace(F.element_at(f, k), "[:,]", "")
    hits = lines.filter(F.col("value").contains("finish checkpoint") & (F.size(f) == 12))
    return hits.select(strip(8).cast("int").alias("n"), strip(10).cast("double").alias("time"), strip(12).cast("double").alias("cost"))


def statistics_block(stats: DataFrame, rmse_digits: int = 10, digits: int = 4) -> DataFrame:
    """Adds `block`, the text that a run reports after a round; the lines on checkpoints only where there are any.

    stats: elapsed, train_time, test_time, train_sse, train_n, test_sse, test_n, updates, failures, sends,
    checkpoints, cp_master, cp_workers, cp_write (seconds), workers.
    """
    r, d, c = f"%.{rmse_digits}f", f"%.{digits}f", F.col
    rmse = lambda side: F.sqrt(c(f"{side}_sse") / c(f"{side}_n"))
    rule = F.lit("=" * 53)
    lines = [
        F.lit("Statistics:"), rule,
        F.format_string(f"elapsed time: {d} total training time: {d} total testing time: {d} current training RMSE: {r}", "elapsed", "train_time", "test_time", rmse("train")),
        F.format_string(f"current test RMSE: {r}", rmse("test")),
        F.format_string(f"detail: train: s={d}, c=%d; test: s={d}, c=%d; u=%d, f=%d, s=%d", "train_sse", "train_n", "test_sse", "test_n", "updates", "failures", "sends"),
        F.when(c("checkpoints") > 0, F.format_string(f"Number of checkpoints: %d Total time by master: {d} by worker: {d} each one: {d}", "checkpoints", "cp_master", "cp_workers", c("cp_master") / c("checkpoints"))),
        F.when(c("checkpoints") > 0, F.format_string(f"Total checkpoint writing time: {d} each one: {d} average on worker: {d}", "cp_write", c("cp_write") / c("checkpoints"), c("cp_write") / c("checkpoints") / c("workers"))),
        rule,
    ]
    return stats.withColumn("block", F.concat_ws("\n", *lines))


def termination(log: DataFrame, min_error: float, stop_rmse: float, min_updates: int) -> DataFrame:
    """Adds `stop`: the change is at most min_error, or rmse at most stop_rmse after min_updates."""
    by_change = F.abs("diff") <= min_error
    by_value = (F.col("rmse") <= stop_rmse) & (F.col("update") >= min_updates)
    return log.withColumn("stop", F.coalesce(by_change, F.lit(False)) | by_value)


def complete_checks(reports: DataFrame, workers: int) -> DataFrame:
    """(check, worker, error, n): rmse of the checks that every worker has reported to."""
    c = reports.groupBy("check").agg(F.count_distinct("worker").alias("w"), F.sum("error").alias("e"), F.sum("n").alias("n"))
    return c.filter(F.col("w") == workers).select("check", F.sqrt(F.col("e") / F.col("n")).alias("rmse"))
