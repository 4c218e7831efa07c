"""Queries over run logs: parsing, windows, thresholds, comparison tables, recovery and experiment grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as S
from ..operators import runlog as L
from . import fixtures as X
from .catalogue import query

W = "WITH " + X.LOG
RUN = "ds, nw, ci, ctype"
_WIN = f"PARTITION BY {RUN} ORDER BY time"
_DIFF = f", d AS (SELECT *, rmse - lag(rmse) OVER ({_WIN}) AS diff FROM rl)"


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("w0_difference", W + _DIFF + f" SELECT {RUN}, time, round(diff, 6) AS diff FROM d")
def _(spark, sf):
    return L.differences(X.run_log(spark, sf)).select(*L.RUN, "time", r6("diff", "diff"))


@query("w2_objective_difference", "SELECT user_id, event_id, round(lag(value) OVER w - value, 6) AS gain FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return X.table(spark, sf, "events").select("user_id", "event_id", r6(F.lag("value").over(w) - F.col("value"), "gain"))


@query("w3_round_length", W + f" SELECT {RUN}, time, round(coalesce(time - lag(time) OVER ({_WIN}), time), 6) AS length FROM rl")
def _(spark, sf):
    w = Window.partitionBy(*L.RUN).orderBy("time")
    return X.run_log(spark, sf).select(*L.RUN, "time", r6(F.coalesce(F.col("time") - F.lag("time").over(w), F.col("time")), "length"))


_PRUNED = _DIFF + f", q AS (SELECT *, max(CASE WHEN diff > 0 OR diff / rmse > 0.005 THEN time END) OVER (PARTITION BY {RUN}) AS p FROM d)"


@query("w4_prune_heading", W + _PRUNED + f" SELECT {RUN}, time, rmse FROM q WHERE p IS NULL OR time >= p")
def _(spark, sf):
    return L.prune_heading(L.differences(X.run_log(spark, sf))).select(*L.RUN, "time", "rmse")


_TH = ", th AS (SELECT max(r) AS threshold FROM (SELECT arg_max(rmse, time) AS r FROM rl GROUP BY ALL))".replace("GROUP BY ALL", f"GROUP BY {RUN}")
_AT = _TH + f""", a AS (SELECT {RUN}, coalesce(min(CASE WHEN rmse <= threshold THEN time END), min(time)) AS time FROM rl, th GROUP BY {RUN}),
    pt AS (SELECT rl.* FROM rl JOIN a USING ({RUN}, time))"""
_INFO = _AT + f""", info AS (SELECT pt.ds, pt.nw, pt.ci, pt.ctype, pt.time, pt.rmse, count(cl.time) AS ncp, coalesce(sum(cl.cost), 0.0::DOUBLE) AS tcost
    FROM pt LEFT JOIN cl ON pt.ds = cl.ds AND pt.nw = cl.nw AND pt.ci = cl.ci AND pt.ctype = cl.ctype AND cl.time <= pt.time GROUP BY ALL)"""


def _at(spark, sf, *by):
    log = X.run_log(spark, sf)
    th = L.ending_rmse(log, *by)
    return L.at_threshold(log.join(th, list(by)) if by else log.join(F.broadcast(th)))  # without keys it is one row


def _info(spark, sf):
    return L.with_checkpoints(_at(spark, sf), X.checkpoint_log(spark, sf))


@query("w5_first_at_threshold", W + _AT + f" SELECT {RUN}, time, rmse FROM pt")
def _(spark, sf):
    return _at(spark, sf)


@query("w6_cumulative_time", W + f" SELECT {RUN}, n, round(sum(cost) OVER ({_WIN} ROWS UNBOUNDED PRECEDING), 6) AS spent FROM cl")
def _(spark, sf):
    w = Window.partitionBy(*L.RUN).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return X.checkpoint_log(spark, sf).select(*L.RUN, "n", r6(F.sum("cost").over(w), "spent"))


@query("w7_prefix_sums", "SELECT user_id, event_id, CAST(coalesce(sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return X.table(spark, sf, "events").select("user_id", "event_id", F.coalesce(F.sum(F.col("event_id") % 10).over(w), F.lit(0)).alias("before"))


_CMP = _INFO + ", cmp AS (SELECT ds, nw, ci, " + ", ".join(
    [f"coalesce(max(CASE WHEN ctype = '{k}' THEN time END), 0) AS t_{k}" for k in L.KINDS]
    + [f"coalesce(max(CASE WHEN ctype = '{k}' THEN ncp END), 0) AS nc_{k}" for k in L.KINDS[1:]]
    + [f"coalesce(max(CASE WHEN ctype = '{k}' THEN tcost END), 0) AS tc_{k}" for k in L.KINDS[1:]]
) + " FROM info GROUP BY ds, nw, ci)"
_CMP_OUT = "ds, nw, ci, " + ", ".join([f"t_{k}" for k in L.KINDS] + [f"nc_{k}" for k in L.KINDS[1:]] + [f"round(tc_{k}, 6) AS tc_{k}" for k in L.KINDS[1:]])


def _cmp(spark, sf):
    return L.comparison(_info(spark, sf))


@query("j3_checkpoints_until", W + _INFO + f" SELECT {RUN}, ncp, round(tcost, 6) AS tcost FROM info")
def _(spark, sf):
    return _info(spark, sf).select(*L.RUN, "ncp", r6("tcost", "tcost"))


@query("x1_point_at_threshold", W + _INFO + f" SELECT {RUN}, time, rmse, ncp, round(tcost, 6) AS tcost FROM info")
def _(spark, sf):
    return _info(spark, sf).withColumn("tcost", F.round("tcost", 6))


@query("x1_strictly_before", W + _AT + f" SELECT pt.ds, pt.nw, pt.ci, pt.ctype, count(cl.time) AS ncp FROM pt LEFT JOIN cl ON pt.ds = cl.ds AND pt.nw = cl.nw AND pt.ci = cl.ci AND pt.ctype = cl.ctype AND cl.time < pt.time GROUP BY ALL")
def _(spark, sf):
    return L.with_checkpoints(_at(spark, sf), X.checkpoint_log(spark, sf), before=True).select(*L.RUN, "ncp")


@query("a14_ending_rmse", W + _TH + " SELECT threshold FROM th")
def _(spark, sf):
    return L.ending_rmse(X.run_log(spark, sf))


@query("x2_threshold_per_group", W + f" SELECT ds, nw, ci, max(r) AS threshold FROM (SELECT {RUN}, arg_max(rmse, time) AS r FROM rl GROUP BY {RUN}) GROUP BY ds, nw, ci")
def _(spark, sf):
    return L.ending_rmse(X.run_log(spark, sf), "ds", "nw", "ci")


@query("x2_constant_threshold", W + f", a AS (SELECT {RUN}, coalesce(min(CASE WHEN rmse <= 1.5 THEN time END), min(time)) AS time FROM rl GROUP BY {RUN}) SELECT * FROM a")
def _(spark, sf):
    return L.at_threshold(X.run_log(spark, sf).withColumn("threshold", F.lit(1.5))).drop("rmse")


@query("x3_comparison_table", W + _CMP + f" SELECT {_CMP_OUT} FROM cmp")
def _(spark, sf):
    t = _cmp(spark, sf)
    return t.select(*(F.round(c, 6).alias(c) if c[:3] == "tc_" else F.col(c) for c in t.columns))


@query("j4_combined_runs", W + _AT + " SELECT ds, nw, ci, coalesce(max(CASE WHEN ctype = 'none' THEN time END), 0) AS t_none, coalesce(max(CASE WHEN ctype = 'vs' THEN time END), 0) AS t_vs FROM pt GROUP BY ds, nw, ci")
def _(spark, sf):
    p = _at(spark, sf).groupBy("ds", "nw", "ci").pivot("ctype", list(L.KINDS)).agg(F.max("time"))
    return p.select("ds", "nw", "ci", F.coalesce("none", F.lit(0.0)).alias("t_none"), F.coalesce("vs", F.lit(0.0)).alias("t_vs"))


def _o(kind, average, relative):
    d = f"(t_{kind} - t_none)"
    d = f"CASE WHEN nc_{kind} <> 0 THEN {d} / nc_{kind} END" if average else d
    return f"round(CASE WHEN t_none <> 0 THEN ({d}) / t_none * 100 END, 6)" if relative else f"round({d}, 6)"


for _avg in (False, True):
    for _rel in (False, True):
        _name = "x4_overhead" + "_average" * _avg + "_relative" * _rel

        @query(_name, W + _CMP + " SELECT ds, nw, ci, " + ", ".join(f"{_o(k, _avg, _rel)} AS o_{k}" for k in L.KINDS[1:]) + " FROM cmp")
        def _(spark, sf, a=_avg, r=_rel):
            t = L.overhead(_cmp(spark, sf), a, r)
            return t.select("ds", "nw", "ci", *(r6(c, c) for c in t.columns[3:]))


@query("x5_overhead_mean_std", W + _CMP + " SELECT ds, " + ", ".join(f"round(avg(t_{k} - t_none), 6) AS mean_{k}, round(stddev_pop(t_{k} - t_none), 6) AS std_{k}" for k in L.KINDS[1:]) + " FROM cmp GROUP BY ds")
def _(spark, sf):
    o = L.overhead(_cmp(spark, sf))
    return o.groupBy("ds").agg(*(r6(f(f"o_{k}"), f"{n}_{k}") for k in L.KINDS[1:] for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


@query("a13_mean_std", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def _(spark, sf):
    return X.table(spark, sf, "events").groupBy("event_type").agg(r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "std"))


_SCALE = W.replace("{", "{{").replace("}", "}}") + _CMP + " SELECT ds, nw, ci, round(first_value(t_{k}) OVER w * first_value(nw) OVER w / nw, 6) AS ideal, round(CASE WHEN t_{k} <> 0 THEN first_value(t_{k}) OVER w / t_{k} * first_value(nw) OVER w END, 6) AS speedup FROM cmp WINDOW w AS (PARTITION BY ds, ci ORDER BY nw)"


@query("w8_scale_out", _SCALE.format(k="vs"))
def _(spark, sf):
    return L.scaling(_cmp(spark, sf), "t_vs").select("ds", "nw", "ci", r6("ideal", "ideal"), r6("speedup", "speedup"))


@query("x6_scaling", " UNION ALL ".join(f"(SELECT '{k}' AS kind, * FROM ({_SCALE.format(k=k)}))" for k in L.KINDS))
def _(spark, sf):
    """The curves of all four kinds of run."""
    curves = [L.scaling(_cmp(spark, sf), f"t_{k}").select(F.lit(k).alias("kind"), "ds", "nw", "ci", r6("ideal", "ideal"), r6("speedup", "speedup")) for k in L.KINDS]
    return curves[0].unionByName(curves[1]).unionByName(curves[2]).unionByName(curves[3])


@query("x6_scaling_fit", W + _CMP + " SELECT round(regr_slope(ln(t_none), ln(nw)), 6) AS a, round(regr_intercept(ln(t_none), ln(nw)), 6) AS b FROM cmp WHERE t_none > 0")
def _(spark, sf):
    x, y = F.ln("nw"), F.ln("t_none")
    return _cmp(spark, sf).filter("t_none > 0").agg(r6(F.regr_slope(y, x), "a"), r6(F.regr_intercept(y, x), "b"))


@query("x7_selection", W + f" SELECT {RUN}, count(*) AS n FROM rl WHERE ds = 'd0' AND nw = 8 AND ci = 10 GROUP BY {RUN}")
def _(spark, sf):
    return X.run_log(spark, sf).filter("ds = 'd0' and nw = 8 and ci = 10").groupBy(*L.RUN).agg(F.count(F.lit(1)).alias("n"))


_POINTS = "p AS (SELECT i / 20.0::DOUBLE AS x FROM range(21) t(i)), r AS (SELECT (c_custkey % 20) / 20.0::DOUBLE + (c_custkey % 3) / 1000.0::DOUBLE AS e, c_acctbal AS t FROM customer)"


@query("j5_match_formatted", f"WITH {_POINTS} SELECT x, round(sum(t), 4) AS total, count(*) AS n FROM p JOIN r ON printf('%.2f', x) = printf('%.2f', e) GROUP BY x")
def _(spark, sf):
    p = spark.range(21).select((F.col("id") / 20.0).alias("x")).withColumn("k", F.format_string("%.2f", "x"))
    r = X.table(spark, sf, "customer").select(((F.col("c_custkey") % 20) / 20.0 + (F.col("c_custkey") % 3) / 1000.0).alias("e"), F.col("c_acctbal").alias("t"))
    return r.withColumn("k", F.format_string("%.2f", "e")).join(p, "k").groupBy("x").agg(F.round(F.sum("t"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("x8_recovery_table", f"WITH {_POINTS}, q AS (SELECT x, CAST(trunc(50.0::DOUBLE * x / 4) AS INTEGER) AS a, CAST(trunc(50.0::DOUBLE * (1 - x) / 4) AS INTEGER) AS b FROM p), s AS (SELECT printf('%.2f', e) AS k, round(sum(t), 4) AS measured FROM r GROUP BY 1) SELECT x, round(3 + 50 * x + a * 0.2::DOUBLE + 53 - a * 4 + b * 0.2::DOUBLE + 2, 6) AS model, measured FROM q JOIN s ON printf('%.2f', x) = k")
def _(spark, sf):
    p = spark.range(21).select((F.col("id") / 20.0).alias("x")).withColumn("k", F.format_string("%.2f", "x"))
    e = (F.col("c_custkey") % 20) / 20.0 + (F.col("c_custkey") % 3) / 1000.0
    s = X.table(spark, sf, "customer").groupBy(F.format_string("%.2f", e).alias("k")).agg(F.round(F.sum("c_acctbal"), 4).alias("measured"))
    return p.join(s, "k").select("x", r6(S.recovery_time(3.0, 50.0, 2.0, 0.2, 4.0, F.col("x")), "model"), "measured")


@query("x9_error_bars", W + _CMP + " SELECT ds, nw, ci, " + ", ".join(f"round(('0x' || substr(md5('{k}:' || ds || ':' || nw || ':' || ci), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 0.1::DOUBLE * t_{k}, 6) AS e_{k}" for k in L.KINDS) + " FROM cmp")
def _(spark, sf):
    draw = lambda k: S.md5_unit(F.lit(k), F.col("ds"), F.col("nw").cast("string"), F.col("ci").cast("string"))
    return _cmp(spark, sf).select("ds", "nw", "ci", *(r6(draw(k) * 0.1 * F.col(f"t_{k}"), f"e_{k}") for k in L.KINDS))


@query("x10_datasets", W + " SELECT ds, count(*) AS n, min(time) AS first, max(time) AS last FROM rl GROUP BY ds")
def _(spark, sf):
    return X.run_log(spark, sf).groupBy("ds").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("x11_experiment_grid", """WITH g AS (SELECT ds, rk, th, lam, k, printf('%s-%d-%d-%d', ds, rk, th, k) AS task, list_transform([500, 1000, 2000], lambda t: t / (rk * th)::DOUBLE) AS timeouts,
    row_number() OVER (ORDER BY ds, rk, th, lam, k) - 1 AS n FROM (VALUES ('netflix'), ('yahoo')) a(ds), (VALUES (1), (2), (4)) b(rk), (VALUES (2), (4)) c(th), (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) d(lam), (VALUES (10), (100)) e(k))
    SELECT ds, rk, th, lam, k, task, timeouts, n // 4 AS block FROM g""")
def _(spark, sf):
    each = lambda name, *v: F.explode(F.array(*map(F.lit, v))).alias(name)
    g = spark.range(1).select(each("ds", "netflix", "yahoo"))
    for name, v in (("rk", (1, 2, 4)), ("th", (2, 4)), ("lam", (0.05, 0.1)), ("k", (10, 100))):
        g = g.select("*", each(name, *v))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ds", "rk", "th", "lam", "k")) - 1
    scaled = F.transform(F.array(F.lit(500), F.lit(1000), F.lit(2000)), lambda t: t / (F.col("rk") * F.col("th")).cast("double"))
    return g.select("ds", "rk", "th", "lam", "k", F.format_string("%s-%d-%d-%d", "ds", "rk", "th", "k").alias("task"), scaled.alias("timeouts"), F.floor(n / 4).alias("block"))


def _lines(spark, sf):
    e = X.table(spark, sf, "events")
    check = F.format_string("I0718 09:05:53.123456 123 monitor] M: termination check at %.2f: RMSE: %.4f, difference: %.5f, update: %d", F.col("event_id").cast("double"), F.col("value") / 100, F.col("value") / 1000 - 0.2, F.col("event_id") * 10)
    end = F.format_string("I0718 09:05:53.123456 123 monitor] M: finish checkpoint %d at %.1f duration: %.4f", F.col("event_id"), F.col("event_id").cast("double"), F.col("value") / 100)
    return e.select(F.when(F.col("event_id") % 3 == 0, check).when(F.col("event_id") % 3 == 1, end).otherwise(F.lit("I0718 something else that is termination check")).alias("value"))


@query("s17_parse_log", "SELECT event_id::DOUBLE AS time, printf('%.4f', value / 100)::DOUBLE AS rmse, printf('%.5f', value / 1000 - 0.2::DOUBLE)::DOUBLE AS diff, event_id * 10 AS update FROM events WHERE event_id % 3 = 0")
def _(spark, sf):
    return L.parse_log(_lines(spark, sf))


@query("s17_parse_checkpoints", "SELECT CAST(event_id AS INTEGER) AS n, event_id::DOUBLE AS time, printf('%.4f', value / 100)::DOUBLE AS cost FROM events WHERE event_id % 3 = 1")
def _(spark, sf):
    return L.parse_checkpoints(_lines(spark, sf))


_STATS = "count(*) AS u, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END)::BIGINT AS f, sum(value) AS sse, max(event_id)::DOUBLE AS t"


@query("s16_statistics_block", f"""WITH g AS (SELECT event_type, {_STATS} FROM events GROUP BY 1)
    SELECT event_type, 'Statistics:' || chr(10) || repeat('=', 53) || chr(10) || printf('elapsed time: %.6f total training time: %.6f total testing time: %.6f current training RMSE: %.6f', t, t, t / 4, sqrt(sse / u)) || chr(10)
      || printf('current test RMSE: %.6f', sqrt(sse / 2 / u)) || chr(10) || printf('detail: train: s=%.6f, c=%d; test: s=%.6f, c=%d; u=%d, f=%d, s=%d', sse, u, sse / 2, u, u, f, u + f) || chr(10)
      || CASE WHEN f > 0 THEN printf('Number of checkpoints: %d Total time by master: %.6f by worker: %.6f each one: %.6f', f, t / 2, t, t / 2 / f) || chr(10)
         || printf('Total checkpoint writing time: %.6f each one: %.6f average on worker: %.6f', t / 8, t / 8 / f, t / 8 / f / 4) || chr(10) ELSE '' END || repeat('=', 53) AS block FROM g""")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("u"), F.sum(F.when(F.col("value") < 10, 1).otherwise(0)).cast("long").alias("f"), F.sum("value").alias("sse"), F.max("event_id").cast("double").alias("t"))
    stats = g.select(
        "event_type", F.col("t").alias("elapsed"), F.col("t").alias("train_time"), (F.col("t") / 4).alias("test_time"), F.col("sse").alias("train_sse"), F.col("u").alias("train_n"),
        (F.col("sse") / 2).alias("test_sse"), F.col("u").alias("test_n"), F.col("u").alias("updates"), F.col("f").alias("failures"), (F.col("u") + F.col("f")).alias("sends"),
        F.col("f").alias("checkpoints"), (F.col("t") / 2).alias("cp_master"), F.col("t").alias("cp_workers"), (F.col("t") / 8).alias("cp_write"), F.lit(4).alias("workers"),
    )
    return L.statistics_block(stats, 6, 6).select("event_type", "block")


@query("t14_termination", W + _DIFF + f" SELECT {RUN}, time, coalesce(abs(diff) <= 0.01, false) OR (rmse <= 1.2 AND update >= 20000) AS stop FROM d")
def _(spark, sf):
    return L.termination(L.differences(X.run_log(spark, sf)), 0.01, 1.2, 20000).select(*L.RUN, "time", "stop")


@query("w9_complete_checks", "WITH r AS (SELECT event_id // 40 AS k, user_id % 8 AS w, value AS e FROM events), c AS (SELECT k, count(DISTINCT w) AS w, sum(e) AS e, count(*) AS n FROM r GROUP BY k) SELECT k AS \"check\", round(sqrt(e / n), 6) AS rmse FROM c WHERE w = 8")
def _(spark, sf):
    r = X.table(spark, sf, "events").select(F.floor(F.col("event_id") / 40).alias("check"), (F.col("user_id") % 8).alias("worker"), F.col("value").alias("error"), F.lit(1).alias("n"))
    return L.complete_checks(r, 8).withColumn("rmse", F.round("rmse", 6))


@query("w1_column_error", "WITH l AS (SELECT event_id // 1000 AS period, user_id, value, row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id DESC) AS n FROM events) SELECT period, round(sum(value), 6) AS error, count(*) AS columns FROM l WHERE n = 1 GROUP BY period")
def _(spark, sf):
    e = X.table(spark, sf, "events").withColumn("period", F.floor(F.col("event_id") / 1000))
    last = e.groupBy("period", "user_id").agg(F.max_by("value", "event_id").alias("v"))
    return last.groupBy("period").agg(r6(F.sum("v"), "error"), F.count(F.lit(1)).alias("columns"))
