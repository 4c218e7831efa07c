"""Queries of the iterative trainers, their schedules, the generator, snapshots and the monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scaled_round
from ..operators import ccd as C
from ..operators import checkpoint as P
from ..operators import sgd as G
from ..operators import synth as Y
from ..streaming import monitor
from . import fixtures as X
from .catalogue import query

W = "WITH "
K = 3


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- rank-one coordinate descent ---------------------------------------------------------------------

_U0 = ", u0 AS (SELECT DISTINCT r, ((r * 7) % 10 + 1) / 20.0::DOUBLE AS u FROM m)"
_V1 = _U0 + ", v1 AS (SELECT c, sum(u * v) / (0.1::DOUBLE * count(*) + sum(u * u)) AS x FROM m JOIN u0 USING (r) GROUP BY c)"
_U1 = _V1 + ", u1 AS (SELECT r, sum(x * v) / (0.1::DOUBLE * count(*) + sum(x * x)) AS y FROM m JOIN v1 USING (c) GROUP BY r)"
_R1 = _U1 + ", r1 AS (SELECT m.r, m.c, v - x * y AS e FROM m JOIN v1 USING (c) JOIN u1 USING (r))"


def _u0(t):
    return t.select("row").distinct().withColumn("x", ((F.col("row") * 7) % 10 + 1) / 20.0)


def _steps(spark, sf):
    t = X.ratings(spark, sf).withColumn("r", F.col("value"))
    v1 = C.half_step(t, _u0(t), "col", "row", 0.1)
    return t, v1, C.half_step(t, v1, "row", "col", 0.1)


@query("t5_half_step", W + X.RATINGS + _V1 + " SELECT c AS col, round(x, 9) AS x FROM v1")
def _(spark, sf):
    return _steps(spark, sf)[1].select("col", F.round("x", 9).alias("x"))


@query("t5_rank_step", W + X.RATINGS + _U1 + ' SELECT r AS "row", round(y, 6) AS x FROM u1')
def _(spark, sf):
    return _steps(spark, sf)[2].select("row", r6("x", "x"))


@query("t16_residual", W + X.RATINGS + _R1 + ' SELECT r AS "row", c AS col, round(e, 6) AS residual FROM r1')
def _(spark, sf):
    t, v, u = _steps(spark, sf)
    return C.shift(t, u, v, -1).select("row", "col", r6("r", "residual"))


@query("a3_incremental_rmse", W + X.RATINGS + _R1 + " SELECT round(sqrt(sum(e * e) / count(*)), 6) AS rmse FROM r1")
def _(spark, sf):
    t, v, u = _steps(spark, sf)
    return C.shift(t, u, v, -1).agg(r6(F.sqrt(F.sum(F.col("r") * F.col("r")) / F.count(F.lit(1))), "rmse"))


@query("a3_add_back_old_rank", W + X.RATINGS + _R1 + " SELECT round(sqrt(sum(pow(e + u * x, 2)) / count(*)), 6) AS rmse FROM r1 JOIN u0 USING (r) JOIN v1 USING (c)")
def _(spark, sf):
    t, v, u = _steps(spark, sf)
    return C.shift(C.shift(t, u, v, -1), _u0(t), v, 1).agg(r6(F.sqrt(F.sum(F.col("r") * F.col("r")) / F.count(F.lit(1))), "rmse"))


@query("t7_nonnegative", W + X.RATINGS + ", n AS (SELECT r, c, v - 25 AS v FROM m), u0 AS (SELECT DISTINCT r, ((r * 7) % 10 + 1) / 20.0::DOUBLE AS u FROM m) SELECT c AS col, round(greatest(0, sum(u * v) / (0.1::DOUBLE * count(*) + sum(u * u))), 6) AS x FROM n JOIN u0 USING (r) GROUP BY c")
def _(spark, sf):
    t = X.ratings(spark, sf).withColumn("r", F.col("value") - 25)
    return C.half_step(t, _u0(t), "col", "row", 0.1, nonneg=True).select("col", r6("x", "x"))


@query("t8_function_decrease", W + X.RATINGS + ", n AS (SELECT r, c, v - 25 AS v FROM m), u0 AS (SELECT DISTINCT r, ((r * 7) % 10 + 1) / 20.0::DOUBLE AS u FROM m), s AS (SELECT c, sum(u * v) AS g, 0.1::DOUBLE * count(*) + sum(u * u) AS h, (c % 4) / 4.0::DOUBLE AS o FROM n JOIN u0 USING (r) GROUP BY c) SELECT c AS col, round(CASE WHEN g / h < 0 THEN -2 * g * o + h * o * o ELSE h * (o - g / h) * (o - g / h) END, 9) AS fundec FROM s")
def _(spark, sf):
    t = X.ratings(spark, sf).withColumn("r", F.col("value") - 25)
    old = t.select("col").distinct().withColumn("x", F.col("col") % 4 / 4.0)
    return C.decrease(t, _u0(t), old, "col", "row", 0.1, nonneg=True).select("col", F.round("fundec", 9).alias("fundec"))


_TWO = """, u0 AS (SELECT DISTINCT r, ((r * 7) % 10 + 1) / 20.0::DOUBLE AS a, ((r * 7 + 3) % 10 + 1) / 20.0::DOUBLE AS b FROM m),
 v1 AS (SELECT c, sum(a * v) / (0.1::DOUBLE * count(*) + sum(a * a)) AS x FROM m JOIN u0 USING (r) GROUP BY c),
 u1 AS (SELECT r, sum(x * v) / (0.1::DOUBLE * count(*) + sum(x * x)) AS y FROM m JOIN v1 USING (c) GROUP BY r),
 r1 AS (SELECT m.r, m.c, v - x * y AS v FROM m JOIN v1 USING (c) JOIN u1 USING (r)),
 v2 AS (SELECT c, sum(b * v) / (0.1::DOUBLE * count(*) + sum(b * b)) AS x FROM r1 JOIN u0 USING (r) GROUP BY c),
 u2 AS (SELECT r, sum(x * v) / (0.1::DOUBLE * count(*) + sum(x * x)) AS y FROM r1 JOIN v2 USING (c) GROUP BY r)"""


def _ccd(spark, sf, outer=1, inner=1, **options):
    t = X.event_matrix(spark, sf)
    init = t.select("row").distinct().select("row", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).withColumn("x", ((F.col("row") * 7 + F.col("t") * 3) % 10 + 1) / 20.0)
    return C.train(t, 2, 0.1, outer, inner, init, **options)


@query("t5_two_ranks", W + X.EVENTS + _TWO + " SELECT r AS id, 0 AS t, round(y, 6) AS x FROM u1 UNION ALL SELECT r, 1, round(y, 6) FROM u2")
def _(spark, sf):
    return _ccd(spark, sf)[0].select("id", "t", r6("x", "x"))


@query("t8_early_stop")
def _(spark, sf):
    """Two passes of up to four inner steps, which end once a decrease is under a third of the largest."""
    rows, cols, _ = _ccd(spark, sf, 2, 4, eps=0.3, nonneg=True)
    return rows.withColumn("kind", F.lit("row")).unionByName(cols.withColumn("kind", F.lit("col")))


@query("t5_objective_log")
def _(spark, sf):
    return spark.createDataFrame(_ccd(spark, sf, 2, 2)[2], "outer int, rank int, loss double")


# --- stochastic gradient descent ---------------------------------------------------------------------


def _start(t, k=K, biased=False):
    tail = [F.lit(0.0)] if biased else []
    r = t.select(F.col("row").alias("id")).distinct().select(F.lit("row").alias("kind"), "id", F.array(*(((F.col("id") * 7 + j * 3) % 10) / 20.0 for j in range(k)), *tail).alias("vec"))
    c = t.select(F.col("col").alias("id")).distinct().select(F.lit("col").alias("kind"), "id", F.array(*(((F.col("id") * 5 + j * 2) % 10) / 20.0 for j in range(k)), *tail).alias("vec"))
    return r.unionByName(c)


def _sequential(order: str, step: str, lam: str = "0.05::DOUBLE", biased: bool = False, epochs: int = 1, result: str | None = None) -> str:
    """The sequential rule as a recursive query: one rating a step, W and H as nested lists, e the epoch.

    With `biased` the last place of a vector is its bias: its partner on the other side is 1.
    """
    tail = ", 0.0::DOUBLE" * biased
    w = ", ".join(f"((i * 7 + {j * 3}) % 10) / 20.0::DOUBLE" for j in range(K)) + tail
    h = ", ".join(f"((i * 5 + {j * 2}) % 10) / 20.0::DOUBLE" for j in range(K)) + tail
    pred = f"list_sum(list_transform(list_zip(s.w[t.i + 1][1:{K}], s.h[t.j + 1][1:{K}]), lambda z: z[1] * z[2]))"
    if biased:
        pred += f" + s.w[t.i + 1][{K + 1}] + s.h[t.j + 1][{K + 1}] + t.mean"
    other = lambda v: f"CASE WHEN y > {K} THEN 1 ELSE {v}[y] END"
    result = result or """SELECT 'row' AS kind, i AS id, list_transform(w[i + 1], lambda x: round(x, 6)) AS vec FROM z, range(25) g(i)
    UNION ALL SELECT 'col', i, list_transform(h[i + 1], lambda x: round(x, 6)) FROM z, range(5) g(i)"""
    return f"""WITH RECURSIVE {X.TINY}, t AS (SELECT row_number() OVER (ORDER BY e, {order}) AS n, e, r AS i, c AS j, v, (SELECT avg(v) FROM m) AS mean FROM m, range(1, {epochs + 1}) q(e)),
    s AS (SELECT 0::BIGINT AS n, 0::BIGINT AS e, (SELECT list([{w}] ORDER BY i) FROM range(25) g(i)) AS w, (SELECT list([{h}] ORDER BY i) FROM range(5) g(i)) AS h
      UNION ALL SELECT n, e, list_transform(w, lambda p, x: CASE WHEN x = i + 1 THEN list_transform(p, lambda a, y: a - {step} * (d * ({other("h[j + 1]")}) + {lam} * a)) ELSE p END),
                          list_transform(h, lambda q, x: CASE WHEN x = j + 1 THEN list_transform(q, lambda b, y: b - {step} * (d * ({other("w[i + 1]")}) + {lam} * b)) ELSE q END)
      FROM (SELECT t.n, t.e, t.i, t.j, s.w, s.h, {pred} - t.v AS d FROM s JOIN t ON t.n = s.n + 1) q),
    z AS (SELECT w, h FROM s ORDER BY n DESC LIMIT 1)
    {result}"""


def _rounded(f):
    return f.select("kind", "id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("t1_column_sweeps", _sequential("c, r", "(1.5::DOUBLE * 0.02 / (1 + 0.1::DOUBLE * 1))"))
def _(spark, sf):
    t = X.tiny(spark, sf)
    return _rounded(G.train(t, _start(t), 1, 1, 0.02, 0.1)[0])


@query("t11_reverse_order", _sequential("c DESC, r DESC", "0.02::DOUBLE"))
def _(spark, sf):
    t = X.tiny(spark, sf)
    return _rounded(G.train(t, _start(t), 1, 1, 0.02, reverse=True, bold=(0.5, 1.05))[0])


# one stratum after the other, parts of a stratum share neither rows nor columns: the order below is theirs
@query("t3_stratified", _sequential("((c % 2) - (r % 2) + 2) % 2, r % 2, c, r", "(1.5::DOUBLE * 0.02 / (1 + 0.1::DOUBLE * 1))"))
def _(spark, sf):
    t = X.tiny(spark, sf)
    return _rounded(G.train(t, _start(t), 2, 1, 0.02, 0.1)[0])


@query("t4_two_phase_blocks", _sequential("((c % 4) // 2 - (r % 2) + 2) % 2, (c % 4) % 2, r % 2, c, r", "(1.5::DOUBLE * 0.02 / (1 + 0.1::DOUBLE * 1))"))
def _(spark, sf):
    t = X.tiny(spark, sf)
    return _rounded(G.train(t, _start(t), 2, 1, 0.02, 0.1, halves=2)[0])


def _scaled(spark, sf, test=False):
    return X.ratings(spark, sf, test).withColumn("value", F.col("value") / 10)


def _written(spark, sf, test=False):
    """The same, joined and summed once for all that trainers read it for."""
    return P.cut(_scaled(spark, sf, test))


def _parts(t, cells: int = 100_000) -> int:
    """Parts that grow with the ratings: about `cells` of them each, two at least."""
    return max(2, -(-t.count() // cells))


@query("t3_rmse_per_epoch")
def _(spark, sf):
    t = _written(spark, sf)
    log = G.train(t, G.start(t, 8), 4, 2, 0.01, strategy="wor", test=_written(spark, sf, True))[1]
    return spark.createDataFrame([(x.epoch, x.step, x.rmse, x.test_rmse) for x in log], "epoch int, step double, rmse double, test_rmse double")


@query("t6_least_visited_biased", _sequential("r % 2, c % 2, c, r", "0.02::DOUBLE", biased=True))
def _(spark, sf):
    """Two parts and one worker: the scheduler hands out the four blocks in turn."""
    t = X.tiny(spark, sf)
    mean = t.agg(F.avg("value")).first()[0]
    return _rounded(G.train(t, _start(t, K, True), 2, 1, 0.02, strategy="least", seed=1, biased=True, mean=mean, bold=(0.5, 1.0))[0])


@query("t6_biased_ratings")
def _(spark, sf):
    t = _written(spark, sf)
    return G.train(t, G.start(t, K, biased=True), _parts(t) + 1, 2, 0.01, strategy="least", biased=True, mean=t.agg(F.avg("value")).first()[0], bold=(0.5, 1.0))[0]


_PRED = f"list_sum(list_transform(list_zip(w[r + 1][1:{K}], h[c + 1][1:{K}]), lambda z: z[1] * z[2]))"


@query("t13_rounds", _sequential("c, r", "(1.5::DOUBLE * 0.02 / (1 + 0.1::DOUBLE * pow(e, 1.5)))", epochs=3, result=f""", y AS (SELECT e, w, h FROM s WHERE e > 0 AND n = (SELECT count(*) FROM m) * e)
    SELECT CAST(e AS INTEGER) AS round, round(sqrt(avg(pow({_PRED} - v, 2))), 6) AS rmse, round(sqrt(avg(CASE WHEN c = 2 THEN pow({_PRED} - v, 2) END)), 6) AS test_rmse FROM y, m GROUP BY e"""))
def _(spark, sf):
    """Three rounds; after each the error on the ratings, and on a test table (those of one column)."""
    t = X.tiny(spark, sf)
    log = G.train(t, _start(t), 1, 3, 0.02, 0.1, test=t.filter("col = 2"))[1]
    return spark.createDataFrame([(x.epoch, round(x.rmse, 6), round(x.test_rmse, 6)) for x in log], "round int, rmse double, test_rmse double")


@query("t13_rounds_ratings")
def _(spark, sf):
    t = _written(spark, sf)
    log = G.train(t, G.start(t, K), _parts(t), 3, 0.01, 0.1, test=_written(spark, sf, True))[1]
    return spark.createDataFrame(log, "round int, step double, loss double, rmse double, test_rmse double")


@query("t14_stopped_training")
def _(spark, sf):
    """Training that ends once an epoch changes the training error by at most 2 %."""
    t = _written(spark, sf)
    log = G.train(t, G.start(t, K), _parts(t), 12, 0.02, 0.5, min_error=0.02)[1]
    return spark.createDataFrame(log, "round int, step double, loss double, rmse double, test_rmse double")


@query("t12_seeded_start", W + X.RATINGS + """, x AS (SELECT DISTINCT 'row' AS kind, r AS id FROM m UNION ALL SELECT DISTINCT 'col', c FROM m)
    SELECT kind, id, list_transform(range(4), lambda k: round(('0x' || substr(md5('7:' || kind || ':' || id || ':' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE / 2.0::DOUBLE, 12)) AS vec FROM x""")
def _(spark, sf):
    f = G.start(X.ratings(spark, sf), 4, 7)
    return f.select("kind", "id", F.transform("vec", lambda x: scaled_round(x, 12)).alias("vec"))


# the trainers above that SQL follows on the tiny matrix, on the ratings


def _on_ratings(spark, sf, *args, **options):
    t = _written(spark, sf)
    return G.train(t, _start(t), _parts(t), 1, 0.02, *args, **options)[0]


@query("t1_column_sweeps_ratings")
def _(spark, sf):
    return _on_ratings(spark, sf, 0.1)


@query("t3_stratified_ratings")
def _(spark, sf):
    return _on_ratings(spark, sf, 0.1, strategy="wor")


@query("t4_two_phase_blocks_ratings")
def _(spark, sf):
    return _on_ratings(spark, sf, 0.1, halves=2)


@query("t11_reverse_order_ratings")
def _(spark, sf):
    return _on_ratings(spark, sf, reverse=True, bold=(0.5, 1.05))


@query("t10_cyclic_strata", "SELECT CAST(e AS INTEGER) AS epoch, CAST(s AS INTEGER) AS sub, CAST(p AS INTEGER) AS part, CAST((p + s) % 4 AS INTEGER) AS block FROM range(1, 4) a(e), range(4) b(s), range(4) c(p)")
def _(spark, sf):
    return G.schedule(spark, 4, 3)


@query("t10_latin_square", "SELECT CAST(e AS INTEGER) AS epoch, CAST(p AS INTEGER) AS part, 6::BIGINT AS blocks FROM range(1, 6) a(e), range(6) b(p)")
def _(spark, sf):
    return G.schedule(spark, 6, 5, "wor").groupBy("epoch", "part").agg(F.count_distinct("block").alias("blocks"))


@query("t2_token_routes", """WITH t AS (SELECT k AS token, CAST(q AS INTEGER) AS hop, CAST((k + q) % 3 AS INTEGER) AS rank FROM range(40) a(k), range(3) b(q)),
    o AS (SELECT t.*, CAST(x AS INTEGER) AS thread, row_number() OVER (PARTITION BY token, hop ORDER BY md5('12345:thread:' || token || ':' || hop || ':' || x)) - 1 AS place FROM t, range(4) c(x))
    SELECT token, hop, rank, CAST(place + 4 * again AS INTEGER) AS place, thread FROM o, range(2) d(again)""")
def _(spark, sf):
    return G.token_routes(spark, 40, 3, 4, reuse=2)


@query("t2_random_routes", """WITH o AS (SELECT k AS token, x AS rank, row_number() OVER (PARTITION BY k ORDER BY md5('12345:rank:' || k || ':' || x)) - 1 AS hop FROM range(40) a(k), range(3) b(x))
    SELECT token, CAST(hop AS INTEGER) AS hop, CAST(rank AS INTEGER) AS rank, 4::BIGINT AS visits FROM o""")
def _(spark, sf):
    return G.token_routes(spark, 40, 3, 4, ring=False).groupBy("token", "hop", "rank").agg(F.count_distinct("thread").alias("visits"))


@query("o5_least_visited_block", """WITH RECURSIVE s AS (SELECT 0 AS n, [0 for _ in range(16)] AS visits, []::BIGINT[] AS busy, NULL::BIGINT AS job
      UNION ALL SELECT n + 1, list_transform(visits, lambda x, k: CASE WHEN k = pick + 1 THEN x + 1 ELSE x END), list_append(held, pick), pick
      FROM (SELECT n, visits, held, list_min(list_transform(list_filter(range(16), lambda b: len(list_filter(held, lambda k: k // 4 = b // 4 OR k % 4 = b % 4)) = 0), lambda b: visits[b + 1] * 100 + b)) % 100 AS pick
            FROM (SELECT n, visits, CASE WHEN n % 3 = 0 THEN []::BIGINT[] ELSE busy END AS held FROM s WHERE n < 45) q) p)
    SELECT CAST((n - 1) // 3 AS INTEGER) AS wave, CAST(job // 4 AS INTEGER) AS part, CAST(job % 4 AS INTEGER) AS block, CAST(visits[job + 1] AS INTEGER) AS visit FROM s WHERE n > 0""")
def _(spark, sf):
    """Four by four blocks, three workers, fifteen waves: what the scheduler hands out."""
    scheduler, rows = G.Scheduler(4), []
    for wave in range(15):
        for _ in range(3):
            part, block = scheduler.take()
            rows.append((wave, part, block, int(scheduler.visits[part * 4 + block])))
        scheduler.free()
    return spark.createDataFrame(rows, "wave int, part int, block int, visit int")


@query("t9_bold_driver", "WITH l AS (SELECT user_id AS run, event_id AS time, value AS obj, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) SELECT run, time, round(0.01::DOUBLE * exp(sum(ln(CASE WHEN old IS NULL THEN 1.0::DOUBLE WHEN obj > old THEN 0.5::DOUBLE ELSE 1.05::DOUBLE END)) OVER (PARTITION BY run ORDER BY time)), 9) AS rate FROM l")
def _(spark, sf):
    log = X.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("time"), F.col("value").alias("obj"))
    return G.bold_rates(log, 0.01).select("run", "time", F.round("rate", 9).alias("rate"))


# --- snapshots ---------------------------------------------------------------------------------------


def _resumed(spark, t, parts, protocol):
    """Factors after three epochs in one run, and after one epoch, a snapshot by `protocol` and two resumed ones: those that differ."""
    folder = P.scratch(spark)
    straight = G.train(t, _start(t), parts, 3, 0.02, 0.1, strategy="wor")[0]
    G.train(t, _start(t), parts, 1, 0.02, 0.1, strategy="wor", folder=folder, protocol=protocol)
    then = G.train(t, _start(t), parts, 3, 0.02, 0.1, strategy="wor", folder=folder, interval=9, resume=1)[0]
    return _different(straight, then)


def _different(a, b):
    same = a.withColumnRenamed("vec", "a").join(b.withColumnRenamed("vec", "b"), ["kind", "id"])
    return same.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("different"))


_SIDES = "SELECT 'row' AS kind, count(DISTINCT r) AS n FROM m UNION ALL SELECT 'col', count(DISTINCT c) FROM m"
_SAME = "WITH {m} SELECT kind, n, 0::BIGINT AS different FROM (" + _SIDES + ")"


@query("c1_sync_snapshot", _SAME.format(m=X.TRAIN))
def _(spark, sf):
    t = _written(spark, sf)
    return _resumed(spark, t, _parts(t), "sync")


@query("c2_async_snapshot", _SAME.format(m=X.TINY))
def _(spark, sf):
    return _resumed(spark, X.tiny(spark, sf), 2, "async")


@query("c3_vs_snapshot", _SAME.format(m=X.TINY))
def _(spark, sf):
    return _resumed(spark, X.tiny(spark, sf), 3, "vs")


@query("c4_periodic_snapshot", "WITH " + X.TINY + ", k AS (" + _SIDES + ") SELECT CAST(e AS INTEGER) AS epoch, kind, n FROM k, (VALUES (2), (4)) v(e)")
def _(spark, sf):
    """Every second of five epochs is saved."""
    t, folder = X.tiny(spark, sf), P.scratch(spark)
    G.train(t, _start(t), 2, 5, 0.02, 0.1, folder=folder, interval=2)
    return spark.read.parquet(folder).groupBy("epoch", "kind").agg(F.count_distinct("id").alias("n"))


@query("c5_resume", _SAME.format(m=X.TINY))
def _(spark, sf):
    """The scheduler's, too, goes on after a snapshot as if nothing had been between."""
    t, folder = X.tiny(spark, sf), P.scratch(spark)
    straight = G.train(t, _start(t, K, True), 3, 4, 0.02, 0.1, strategy="least", biased=True, folder=folder, interval=2)[0]
    return _different(straight, G.train(t, _start(t, K, True), 3, 4, 0.02, 0.1, strategy="least", biased=True, folder=folder, interval=9, resume=2)[0])


# --- generator ---------------------------------------------------------------------------------------


_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _rows_of(ncols: int, name: str) -> str:
    """SQL: the frequencies of row degrees."""
    u = lambda which: _UNIT.format(f"'12345:{which}:' || i || ':' || k")
    return f"""{name}_d AS (SELECT i, k, CAST(trunc(20 + 5 * sqrt(-2 * ln(1 - {u("a")})) * cos(2 * 3.141592653589793::DOUBLE * {u("b")})) AS BIGINT) AS x FROM range({ncols + 1}) a(i), range(64) b(k)),
    {name} AS (SELECT i AS degree, coalesce(arg_min(x, k) FILTER (WHERE x >= 0 AND x < {ncols}), {min(20, ncols - 1)}) AS freq FROM {name}_d GROUP BY i)"""


def _cols_of(nrows: int, name: str) -> str:
    u = _UNIT.format("'12345:c:' || i || ':' || k")
    return f"""{name}_d AS (SELECT i, k, CAST(trunc(pow(1 - {u}, 1 / (1 - 2.2::DOUBLE))) AS BIGINT) AS x FROM range({nrows + 1}) a(i), range(64) b(k)),
    {name} AS (SELECT i AS degree, coalesce(arg_min(x, k) FILTER (WHERE x <= {nrows}), 1) AS freq FROM {name}_d GROUP BY i)"""


def _sampled(freq: str, n: int, seed: int, name: str) -> str:
    """SQL: n degrees drawn by their frequencies."""
    return f"""{name}_c AS (SELECT degree, freq, sum(freq) OVER (ORDER BY degree) - freq AS lo, sum(freq) OVER (ORDER BY degree) AS hi FROM {freq} WHERE freq > 0),
    {name}_x AS (SELECT i AS id, CAST(floor({_UNIT.format(f"'{seed}:' || i")} * (SELECT sum(freq) FROM {freq})) AS BIGINT) AS x FROM range({n}) a(i)),
    {name} AS (SELECT id, degree FROM {name}_x JOIN {name}_c ON x >= lo AND x < hi)"""


@query("g1_degree_frequencies", W + _rows_of(200, "a") + ", " + _cols_of(300, "b") + " SELECT 'row' AS side, degree, freq FROM a UNION ALL SELECT 'col', degree, freq FROM b")
def _(spark, sf):
    return Y.row_degree_frequencies(spark, 200).withColumn("side", F.lit("row")).unionByName(Y.col_degree_frequencies(spark, 300).withColumn("side", F.lit("col")))


@query("g2_sample_degrees", W + _rows_of(200, "a") + ", " + _sampled("a", 1000, 7, "s") + " SELECT id, degree FROM s")
def _(spark, sf):
    return Y.sample_degrees(Y.row_degree_frequencies(spark, 200), 1000, 7)


@query("g3_popular_columns", "SELECT i AS \"row\", i % 9 AS n, i % 9 AS different FROM range(200) t(i) WHERE i % 9 > 0")
def _(spark, sf):
    """Every row's cells, all different, however uneven the weights."""
    rows = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 9).alias("degree"))
    cells = Y.sample_cells(rows, spark.range(100).select(F.col("id").alias("col"), F.when(F.col("id") == 3, 1_000_000).otherwise(F.col("id") + 1).alias("weight")), 3)
    return cells.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("col").alias("different"))


@query("g4_noisy_values")
def _(spark, sf):
    """What the values hold besides the products of the factors: its mean and spread."""
    return Y.generate(spark, 300, 80).withColumn("noise", F.col("value") - Y.product(20)).agg(F.count(F.lit(1)).alias("cells"), F.avg("noise").alias("mean"), F.stddev_pop("noise").alias("spread"))


@query("g5_generate", W + _rows_of(80, "a") + ", " + _sampled("a", 300, 12346, "s") + """, k AS (SELECT id, least(degree * 5 // 4, 80) AS m FROM s)
    SELECT id AS "row", CAST(floor(m * 0.8::DOUBLE) AS BIGINT) AS train, m - CAST(floor(m * 0.8::DOUBLE) AS BIGINT) AS test FROM k WHERE m > 0""")
def _(spark, sf):
    """The generated matrix: training and test cells of every row."""
    return Y.generate(spark, 300, 80).groupBy("row").agg(F.sum((~F.col("test")).cast("long")).alias("train"), F.sum(F.col("test").cast("long")).alias("test"))


# --- monitor -----------------------------------------------------------------------------------------


@query("w1_streaming_monitor", "SELECT user_id AS col, arg_max(value, event_id) AS error, count(*) AS reports FROM events GROUP BY 1")
def _(spark, sf):
    return monitor.run_to_end(spark, f"{sf}/events.parquet")
