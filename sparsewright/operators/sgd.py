"""Stratified stochastic gradient descent: schedule tables and one grouped pandas fold.

Rows are pinned to parts, columns to blocks.  In a sub-epoch every part owns another block, so no two parts
share a row or a column and each part can be swept on its own, in order, exactly as the sequential rule
says.  One cogrouped fold per sub-epoch runs all parts; factors are one tagged table (kind, id, group, vec),
written after each sub-epoch, and the table before it is deleted.  Ratings are written once by (part, block):
a sub-epoch reads its own cells only, an epoch reads each once.  A part and a block must fit one task:
choose `parts` accordingly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from copy import copy
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dot, md5_unit
from . import peers
from .checkpoint import cut, forget, load, save, scratch

STRATEGIES = ("cyclic", "wor", "semi", "wr")
#: Epochs before a training RMSE that is small enough ends a run.
SETTLED = 8
#: Jobs of a schedule (part, block) that one stage of peers is sent.
PLANNED = 4_000_000


def strata(parts: int, epoch: int, strategy: str = "cyclic", seed: int = 12345) -> list[list[int]]:
    """For each sub-epoch the block that each part owns: a permutation; all but `wr` form a Latin square."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    rng = np.random.default_rng([seed, epoch])
    if strategy == "wr":
        return [rng.permutation(parts).tolist() for _ in range(parts)]
    turn = np.arange(parts)
    if strategy == "cyclic":
        return [((turn + s) % parts).tolist() for s in range(parts)]
    if strategy == "semi":
        first = int(rng.integers(parts))
        return [((turn + s + first) % parts).tolist() for s in range(parts)]
    rows, offsets = rng.permutation(parts), rng.permutation(parts)
    return [((rows + o) % parts).tolist() for o in offsets]


#: Jobs that the scheduler looks at before it drops all that are blocked.
LOOK = 64


class Scheduler:
    """Hands out the least visited block whose row part and column block are free; of equals the first in `order`."""

    def __init__(self, parts: int, seed: int | None = None):
        self.parts, self.visits, self.order = parts, np.zeros(parts * parts, np.int64), np.arange(parts * parts)
        self.busy_rows, self.busy_cols = np.zeros(parts, bool), np.zeros(parts, bool)
        self.rng = None if seed is None else np.random.default_rng(seed)
        self.queue: np.ndarray | None = None

    def _free(self, jobs: np.ndarray) -> np.ndarray:
        return ~self.busy_rows[jobs // self.parts] & ~self.busy_cols[jobs % self.parts]

    def take(self) -> tuple[int, int] | None:
        """(part, block), which are busy until `free`; None if every block is blocked."""
        if self.queue is None:  # until `free`, a block whose visits change is busy
            self.queue = self.order[np.argsort(self.visits[self.order], kind="stable")]
            self.queue = self.queue[self._free(self.queue)]
        while len(self.queue):
            ready = self._free(self.queue[:LOOK])
            k = int(ready.argmax())
            if ready[k]:
                job, self.queue = int(self.queue[k]), self.queue[k + 1 :]
                self.visits[job] += 1
                self.busy_rows[job // self.parts] = self.busy_cols[job % self.parts] = True
                return job // self.parts, job % self.parts
            self.queue = self.queue[LOOK:]
            self.queue = self.queue[self._free(self.queue)]
        return None

    def free(self) -> None:
        self.busy_rows[:] = self.busy_cols[:] = False
        self.queue = None

    def mix(self) -> None:
        """Another order of equals, as between rounds."""
        if self.rng is not None:
            self.order = self.rng.permutation(self.order)
            self.queue = None


def least_visited(parts: int, workers: int, epochs: int, seed: int | None = None) -> Iterator[list[list[int | None]]]:
    """For each epoch its sub-epochs: the block that each part gets from the scheduler, None for an idle part.

    `workers` jobs run at once; an epoch ends after parts * parts jobs.
    """
    scheduler = Scheduler(parts, seed)
    for _ in range(epochs):
        waves, left = [], parts * parts
        while left:
            owned: list[int | None] = [None] * parts
            for _ in range(min(workers, left)):
                if (job := scheduler.take()) is None:
                    break
                owned[job[0]] = job[1]
            scheduler.free()
            left -= sum(b is not None for b in owned)
            waves.append(owned)
        scheduler.mix()
        yield waves


def schedule(spark: SparkSession, parts: int, epochs: int, strategy: str = "cyclic", seed: int = 12345, halves: int = 1) -> DataFrame:
    """(epoch, sub, part, block); with `halves` = 2 each block is visited in two phases (a finer schedule)."""
    rows = [
        (e, s * halves + h, p, b * halves + h)
        for e in range(1, epochs + 1) for s, owned in enumerate(strata(parts, e, strategy, seed)) for h in range(halves) for p, b in enumerate(owned)
    ]
    return spark.createDataFrame(rows, "epoch int, sub int, part int, block int")


def token_routes(spark: SparkSession, tokens: int, ranks: int, threads: int, reuse: int = 1, seed: int = 12345, ring: bool = True) -> DataFrame:
    """(token, hop, rank, place, thread): the way of every column token through all ranks once.

    At a rank a token visits the threads in a random order of its own, `reuse` times over; then it goes to
    the next rank of a ring, or to the next of its own random order of the ranks.
    """
    each = spark.range(tokens).select(F.col("id").alias("token"), F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("hop"))
    by = lambda *keys: F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)))
    ordered = lambda n, name, *keys: F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.struct(by(F.lit(name), *keys, x.cast("string")).alias("o"), x.alias("x")))), lambda s: s["x"])
    rank = F.pmod(F.col("token") + F.col("hop"), F.lit(ranks)).cast("int") if ring else F.element_at(ordered(ranks, "rank", "token"), F.col("hop") + 1)
    threaded = each.withColumn("rank", rank).withColumn("perm", ordered(threads, "thread", "token", "hop"))
    return threaded.select("token", "hop", "rank", F.posexplode(F.flatten(F.array_repeat("perm", reuse))).alias("place", "thread"))


#: Starts of factors: uniform in [0, 1 / sqrt(dim)), and in [0, 0.1).
STARTS = {"scaled": lambda dim: 1.0 / math.sqrt(dim), "small": lambda dim: 0.1}


def start(t: DataFrame, dim: int, seed: int = 12345, kind: str = "scaled", biased: bool = False) -> DataFrame:
    """(kind, id, vec): seeded random factors for every row and column of `t`, zero biases behind if `biased`.

    A number depends on (seed, side, id, place) only, so it is the same however the table is dealt.
    """
    if kind not in STARTS:
        raise ValueError(f"kind is one of {tuple(STARTS)}")
    side = lambda key: t.select(F.lit(key).alias("kind"), F.col(key).cast("long").alias("id")).distinct()
    draw = lambda x: md5_unit(F.lit(str(seed)), F.col("kind"), F.col("id").cast("string"), x.cast("string")) * STARTS[kind](dim)
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw)
    return side("row").unionByName(side("col")).withColumn("vec", F.concat(vec, F.array(F.lit(0.0))) if biased else vec)


def levels(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Ratings in the order of a sequential sweep, dealt into runs without a repeated row or column.

    A rating comes one run after the last before it that shares its row or its column: sweeping run by run,
    each at once, is the sequential sweep.
    """
    if not len(i):
        return []
    rows, cols, at = [0] * (int(i.max()) + 1), [0] * (int(j.max()) + 1), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        n = rows[a] if rows[a] > cols[b] else cols[b]
        at.append(n)
        rows[a] = cols[b] = n + 1
    at = np.array(at)
    order = np.argsort(at, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(at[order])) + 1)


def sweep(w: np.ndarray, h: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, step: float, lam: float) -> None:
    """The sequential rule, in place: e = <w, h> - v; both sides step at once."""
    for run in levels(i, j):
        a, b = i[run], j[run]
        p, q = w[a], h[b]
        e = (np.einsum("nk,nk->n", p, q) - v[run])[:, None]
        w[a], h[b] = p - step * (e * q + lam * p), q - step * (e * p + lam * q)


def sweep_biased(w, h, i, j, v, step, lam_p, lam_q, mean=0.0) -> None:
    """The rule with biases, kept in the last column of each side: e = v - prediction; biases shrink with the factors' penalties."""
    k = w.shape[1] - 1
    for run in levels(i, j):
        a, b = i[run], j[run]
        p, q = w[a], h[b]
        e = (v[run] - np.einsum("nk,nk->n", p[:, :k], q[:, :k]) - mean - p[:, k] - q[:, k])[:, None]
        one = np.ones_like(e)
        w[a] = (1 - step * lam_p) * p + step * e * np.hstack([q[:, :k], one])
        h[b] = (1 - step * lam_q) * q + step * e * np.hstack([p[:, :k], one])


SCHEMA = "kind string, id long, grp int, vec array<double>"


def _fold(step: float, lam: float, reverse: bool, biased: bool, mean: float):
    def fold(ratings: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
        if len(ratings) and len(factors):
            r, c = factors[factors.kind == "row"], factors[factors.kind == "col"]
            w, h = (np.array(x.vec.tolist(), float).reshape(len(x), -1) for x in (r, c))
            t = ratings.sort_values(["col", "row"], ascending=not reverse)
            i, j = pd.Index(r.id).get_indexer(t.row), pd.Index(c.id).get_indexer(t.col)
            (sweep_biased if biased else sweep)(w, h, i, j, t.value.to_numpy(float), step, *((lam, lam, mean) if biased else (lam,)))
            factors = pd.concat([r.assign(vec=list(w)), c.assign(vec=list(h))])
        return factors[["kind", "id", "grp", "vec"]]

    return fold


def _swept(lam: float, biased: bool, mean: float, step: float) -> Callable:
    """The rule for `peers`: (w, h, i, j, v), in place."""
    return partial(sweep_biased, step=step, lam_p=lam, lam_q=lam, mean=mean) if biased else partial(sweep, step=step, lam=lam)


class Cells:
    """Ratings written by (part, block), each cell a folder that is read on its own."""

    SCHEMA = "row long, col long, value double, part int, block int"

    def __init__(self, t: DataFrame, parts: int, blocks: int):
        group = lambda key, n: F.pmod(F.col(key), F.lit(n)).cast("int")
        rows = t.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), group("row", parts).alias("part"), group("col", blocks).alias("block"))
        self.spark, self.path = t.sparkSession, scratch(t.sparkSession)
        rows.repartition("part", "block").write.partitionBy("part", "block").parquet(self.path)
        whole = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        counts = whole.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per cell of the schedule
        self.held = {(r["part"], r["block"]): r["n"] for r in counts}
        self.n, self.whole = sum(self.held.values()), whole

    def of(self, owned: list[int | None]) -> DataFrame:
        """The ratings of one sub-epoch."""
        folders = [f"{self.path}/part={p}/block={b}" for p, b in enumerate(owned) if (p, b) in self.held]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*folders)


def sub_epoch(mine: DataFrame, factors: DataFrame, owned: list[int | None], step: float, lam: float, reverse: bool = False, biased: bool = False, mean: float = 0.0) -> DataFrame:
    """mine: ratings (row, col, value, part, block) of the owned blocks, factors (kind, id, grp, vec): one stratum."""
    owner = {b: p for p, b in enumerate(owned) if b is not None}
    part_of = F.try_element_at(F.array(*(F.lit(owner.get(b, -1 - b)) for b in range(max(owner, default=0) + 1))), F.col("grp") + 1)
    tagged = factors.withColumn("part", F.when(F.col("kind") == "row", F.col("grp")).otherwise(F.coalesce(part_of, -1 - F.col("grp"))))
    return mine.groupBy("part").cogroup(tagged.groupBy("part")).applyInPandas(_fold(step, lam, reverse, biased, mean), SCHEMA)


class Round(NamedTuple):
    """What is known after an epoch; `test_rmse` is null without a test table."""

    epoch: int
    step: float
    loss: float
    rmse: float
    test_rmse: float | None


def train(t: DataFrame, factors: DataFrame, parts: int, epochs: int, lrate: float, drate: float = 0.0, lam: float = 0.05, strategy: str = "cyclic", seed: int = 12345, reverse: bool = False,
          bold: tuple[float, float] | None = None, biased: bool = False, mean: float = 0.0, halves: int = 1, reuse: int = 1, folder: str | None = None, interval: int = 1, resume: int | None = None,
          test: DataFrame | None = None, min_error: float | None = None, stop_rmse: float | None = None, settled: int = SETTLED, protocol: str = "sync"):
    """(factors, log): factors (kind, id, vec) start the training; log has a `Round` for each epoch.

    The step of epoch c is 1.5 lrate / (1 + drate c^1.5): each (part, column) pair is met once an epoch, so
    visits count epochs (`reuse` times each).  `bold` = (decay, growth) replaces that by the bold driver on
    the objective.  `strategy` is one of `STRATEGIES`, or "least": parts - 1 workers that take the least
    visited free blocks.  With `folder`, every `interval`-th epoch is saved by `protocol`; `resume` starts
    after a saved one.  `test` (row, col, value) is scored after each epoch.  Training ends early once the
    training RMSE changes by at most `min_error`, or is at most `stop_rmse` after `settled` epochs.
    """
    spark = t.sparkSession
    blocks = parts * halves
    if strategy != "least":
        strata(parts, 1, strategy, seed)  # an unknown one ends here
    elif halves != 1:
        raise ValueError("the scheduler takes whole blocks")
    ratings = cut(t.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")))
    n = ratings.count()
    together = peers.workers(spark, parts, n)
    if not together:
        cells = Cells(ratings, parts, blocks)
        forget(ratings)
        ratings = cells.whole
    group = F.when(F.col("kind") == "row", F.pmod(F.col("id"), F.lit(parts))).otherwise(F.pmod(F.col("id"), F.lit(blocks))).cast("int")
    now = load(spark, folder, resume) if resume is not None else factors
    now = table = cut(now.withColumn("grp", group).select("kind", F.col("id").cast("long").alias("id"), "grp", "vec"))
    log: list[Round] = []
    course = peers.Course(lrate, drate, reuse, bold, min_error, stop_rmse, settled, n)
    chosen = least_visited(parts, max(1, parts - 1), epochs, seed) if strategy == "least" else (strata(parts, e, strategy, seed) for e in range(1, epochs + 1))
    todo = []
    for epoch, subs in enumerate(chosen, 1):
        if epoch <= (resume or 0):
            continue
        finer = [[None if b is None else b * halves + half for b in owned] for owned in subs for half in range(halves)]
        todo.append((epoch, finer))
        saved = bool(folder) and epoch % interval == 0
        if together and not (saved or test is not None or epoch == epochs or len(todo) * parts * blocks >= PLANNED):
            continue
        if together:
            old, table = table, cut(peers.swept(ratings, now, todo, parts, blocks, together, copy(course), partial(_swept, lam, biased, mean), reverse, biased, mean))
            forget(old)
            now = table.filter("kind <> 'log'")
            rounds = [(int(x["vec"][0]), *x["vec"][1:]) for x in table.filter("kind = 'log'").orderBy("id").collect()]
        else:
            for again in range(reuse):
                step = course.step(epoch, again)
                for mine in finer:
                    old, now = now, cut(sub_epoch(cells.of(mine), now, mine, step, lam, reverse, biased, mean))
                    forget(old)
            rounds = [(epoch, step, loss_of(ratings, now, biased, mean)[0])]
        todo = []
        for number, step, loss in rounds:
            ended = course.ends(number, loss)
            log.append(Round(number, step, loss, course.rmse, None))
        if test is not None:
            total, held = loss_of(test, now, biased, mean)
            log[-1] = log[-1]._replace(test_rmse=math.sqrt(total / held) if held else None)
        if saved and log[-1].epoch == epoch:
            save(now.drop("grp"), folder, epoch, protocol)
        if ended:
            break
    return now.drop("grp"), log


def loss_of(ratings: DataFrame, factors: DataFrame, biased: bool = False, mean: float = 0.0) -> tuple[float, int]:
    """(sum of squared errors, number) of the ratings whose row and column have factors."""
    side = lambda kind: factors.filter(F.col("kind") == kind)
    r = side("row").select(F.col("id").alias("row"), F.col("vec").alias("w"))
    c = side("col").select(F.col("id").alias("col"), F.col("vec").alias("h"))
    s = ratings.select("row", "col", "value").join(c, "col").join(r, "row")
    if biased:
        k = F.size("w") - 1
        p = dot(F.slice("w", 1, k), F.slice("h", 1, k)) + mean + F.element_at("w", -1) + F.element_at("h", -1)
    else:
        p = dot(F.col("w"), F.col("h"))
    e = p - F.col("value")
    total, n = s.agg(F.sum(e * e), F.count(F.lit(1))).first()
    return total or 0.0, n


def bold_rates(log: DataFrame, start: float, decay: float = 0.5, growth: float = 1.05) -> DataFrame:
    """`log` (run keys.., time, obj): the bold driver's rate after each check, as a running product."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("time")
    factor = F.when(F.lag("obj").over(w).isNull(), 1.0).when(F.col("obj") > F.lag("obj").over(w), decay).otherwise(growth)
    return log.withColumn("f", factor).withColumn("rate", start * F.exp(F.sum(F.ln("f")).over(w))).drop("f")
