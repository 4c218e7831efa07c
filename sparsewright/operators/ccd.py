"""Rank-one coordinate descent on a residual table, DataFrame operations only.

The residual (row, col, value, r) lives in Parquet-backed checkpoints: each rank step reads it once per half
step, and the table that it replaces is deleted.  A half step joins the other side's coordinate and sums per key: map-side combined, so a popular row
or column is one partial sum per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut, forget


def half_step(res: DataFrame, other: DataFrame, key: str, other_key: str, lam: float, nonneg: bool = False) -> DataFrame:
    """(key, x): sum(u r) / (lam nnz + sum(u^2)) over the residual with the rank added back."""
    x = F.sum(F.col("u") * F.col("r")) / (lam * F.count(F.lit(1)) + F.sum(F.col("u") * F.col("u")))
    x = F.greatest(x, F.lit(0.0)) if nonneg else x
    return res.join(other.select(other_key, F.col("x").alias("u")), other_key).groupBy(key).agg(x.alias("x"))


def decrease(res: DataFrame, other: DataFrame, old: DataFrame, key: str, other_key: str, lam: float, nonneg: bool = False) -> DataFrame:
    """Per key new x and the function decrease h (old - new)^2, or -2 g old + h old^2 where clamped to 0."""
    sums = res.join(other.select(other_key, F.col("x").alias("u")), other_key).groupBy(key).agg(
        F.sum(F.col("u") * F.col("r")).alias("g"), (lam * F.count(F.lit(1)) + F.sum(F.col("u") * F.col("u"))).alias("h")
    )
    raw = F.col("g") / F.col("h")
    new = F.greatest(raw, F.lit(0.0)) if nonneg else raw
    out = sums.join(old.select(key, F.col("x").alias("old")), key, "left").withColumn("old", F.coalesce("old", F.lit(0.0))).withColumn("x", new)
    free = F.col("h") * (F.col("old") - F.col("x")) * (F.col("old") - F.col("x"))
    clamped = -2 * F.col("g") * F.col("old") + F.col("h") * F.col("old") * F.col("old")
    return out.withColumn("fundec", F.when(raw < 0, clamped).otherwise(free) if nonneg else free).select(key, "x", "fundec")


def shift(res: DataFrame, u: DataFrame, v: DataFrame, sign: int) -> DataFrame:
    """r + sign * u_row v_col; missing coordinates count as 0."""
    a = res.join(u.select("row", F.col("x").alias("__u")), "row", "left").join(v.select("col", F.col("x").alias("__v")), "col", "left")
    return a.withColumn("r", F.col("r") + sign * F.coalesce(F.col("__u") * F.col("__v"), F.lit(0.0))).drop("__u", "__v")


def train(t: DataFrame, k: int, lam: float, outer: int, inner: int, init: DataFrame, nonneg: bool = False, eps: float | None = None, quit_after: int = 5):
    """Returns (rows, cols, log): long factors (id, t, x) and per rank step the objective's loss.

    init: (row, t, x) start of the row side; the column side starts at 0.  With `eps`, a rank's inner loop
    stops once its decrease is below eps times the largest one, the very first decrease left out, and a
    pass over the ranks ends after `quit_after` ranks that stopped at once.
    """
    res = cut(t.withColumn("r", F.col("value")))
    u = {j: cut(init.filter(F.col("t") == j).select("row", "x")) for j in range(k)}
    v: dict[int, DataFrame | None] = {j: None for j in range(k)}
    log, most, seen = [], 0.0, 0

    def moved(sign: int, j: int) -> DataFrame:
        """The residual with rank j added or taken away; the table before it goes."""
        new = cut(shift(res, u[j], v[j], sign))
        forget(res)
        return new

    for o in range(outer):
        early = 0
        for j in range(k):
            if early >= quit_after:
                break
            if v[j] is not None:
                res = moved(1, j)
            for i in range(inner):
                start = v[j] if v[j] is not None else res.select("col").distinct().withColumn("x", F.lit(0.0))
                new_v = cut(decrease(res, u[j], start, "col", "row", lam, nonneg))
                new_u = cut(decrease(res, new_v, u[j], "row", "col", lam, nonneg))
                gain = sum((d.agg(F.sum("fundec")).first()[0] or 0.0) for d in (new_v, new_u))
                for old in (u[j], v[j]):
                    if old is not None:
                        forget(old)
                u[j], v[j] = new_u, new_v
                if eps is not None and gain < most * eps:
                    early += i == 0
                    break
                if seen:
                    most = max(most, gain)
                seen += 1
            res = moved(-1, j)
            log.append((o, j, res.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0))
    long = lambda side, key: _union(d.select(F.col(key).alias("id"), F.lit(j).alias("t"), "x") for j, d in side.items() if d is not None)
    return long(u, "row"), long(v, "col"), log


def _union(parts) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
