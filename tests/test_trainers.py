import os
import time

import numpy as np
import pytest
from oracle import compare, connection
from pyspark.sql import functions as F

from sparsewright.functions import bandwidth, power_law, size_number
from sparsewright.operators import ccd, runlog, sgd, synth
from sparsewright.operators import matrix as M
from sparsewright.operators.checkpoint import shared_folder
from sparsewright.plans import fixtures
from sparsewright.sources import binary, model


def _low_rank(spark, rows=40, cols=25, k=2):
    r = np.random.default_rng(1)
    w, h = r.normal(size=(rows, k)), r.normal(size=(cols, k))
    cells = [(i, j, float(w[i] @ h[j] + 0.01 * r.normal())) for i in range(rows) for j in range(cols) if r.random() < 0.6]
    return spark.createDataFrame(cells, "row long, col long, value double")


def _start(t, k, seed=3, extra=0):
    r = np.random.default_rng(seed)
    ids = [("row", x[0]) for x in t.select("row").distinct().collect()] + [("col", x[0]) for x in t.select("col").distinct().collect()]
    return t.sparkSession.createDataFrame([(kind, i, [*map(float, r.random(k) / k**0.5), *[0.0] * extra]) for kind, i in sorted(ids)], "kind string, id long, vec array<double>")


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("strategy", sgd.STRATEGIES)
def test_strata_are_permutations_and_latin_squares(parts, strategy):
    for epoch in range(1, 6):
        s = sgd.strata(parts, epoch, strategy)
        assert len(s) == parts and all(sorted(x) == list(range(parts)) for x in s)
        if strategy != "wr":
            assert all(sorted(c) == list(range(parts)) for c in zip(*s, strict=True))
        assert s == sgd.strata(parts, epoch, strategy)


@pytest.mark.parametrize("options", [{}, {"strategy": "wor", "reverse": True, "bold": (0.5, 1.05)}, {"halves": 2, "strategy": "wr"}, {"reuse": 2, "strategy": "semi"}])
def test_sgd_fits_a_planted_model(spark, options):
    t = _low_rank(spark)
    factors, log = sgd.train(t, _start(t, 4), 3, 6, 0.05, 0.0, 0.001, **options)
    assert factors.count() == 65 and log[-1][2] < 0.5 * log[0][2]


def test_biased_sgd_learns_biases(spark):
    cells = [(i, j, 3.0 + i / 10 - j / 10) for i in range(20) for j in range(15)]
    t = spark.createDataFrame(cells, "row long, col long, value double")
    _, log = sgd.train(t, _start(t, 2, extra=1), 2, 5, 0.05, lam=0.001, biased=True, mean=3.25, bold=(0.5, 1.0))
    assert log[-1][2] / len(cells) < 0.3


def test_resume_equals_a_straight_run(spark, tmp_path):
    t = _low_rank(spark, 15, 10)
    a, _ = sgd.train(t, _start(t, 3), 2, 4, 0.05, 0.1, strategy="wor")
    sgd.train(t, _start(t, 3), 2, 2, 0.05, 0.1, strategy="wor", folder=f"file://{tmp_path}", interval=2)
    b, _ = sgd.train(t, _start(t, 3), 2, 4, 0.05, 0.1, strategy="wor", folder=f"file://{tmp_path}", interval=9, resume=2)
    assert {(r["kind"], r["id"]): r["vec"] for r in a.collect()} == {(r["kind"], r["id"]): r["vec"] for r in b.collect()}


def test_ccd_objective_never_rises_and_fits(spark):
    t = _low_rank(spark)
    init = t.select("row").distinct().select("row", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).withColumn("x", (F.col("row") % 5 + F.col("t") + 1) / 10.0)
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows, cols, log = ccd.train(t, 2, 0.001, 3, 2, init)
    assert len(set(os.listdir(folder)) - before) == 5  # the residual and both sides of two ranks
    losses = [x[2] for x in log]
    assert all(b <= a * 1.001 for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < 0.2 * losses[0]
    assert rows.count() == 80 and cols.count() == 50
    rows, _, _ = ccd.train(t, 2, 0.001, 1, 3, init, nonneg=True, eps=0.01)
    assert rows.agg(F.min("x")).first()[0] >= 0


def test_binary_files_edge_cases(spark, tmp_path):
    cells = [(0, 3, 1.5), (2, 0, -2.0), (2, 4, 0.25), (6, 1, 9.0)]
    t = spark.createDataFrame(cells, "row int, col int, value double")
    for long in (True, False):
        for parts in (1, 3, 50):
            path = f"{tmp_path}/{long}{parts}.dat"
            binary.write(t, path, 8, 5, long, parts)
            assert binary.probe(path) == (8, 5, 4)
            assert sorted(map(tuple, binary.read(spark, path, parts).collect())) == cells
            assert sorted(map(tuple, binary.read_any(spark, path).collect())) == cells
    binary.write(t.filter("row > 100"), f"{tmp_path}/empty.dat", 0, 0)
    assert binary.read(spark, f"{tmp_path}/empty.dat").count() == 0
    (tmp_path / "bad.dat").write_bytes(b"\0" * 40)
    with pytest.raises(ValueError):
        binary.probe(f"{tmp_path}/bad.dat")


def test_matrix_edge_cases(spark):
    t = spark.createDataFrame([(0, 2, 1.0), (3, 0, 2.0), (3, 0, 5.0)], "row int, col int, value double")
    assert sorted(map(tuple, M.sum_duplicates(t).collect())) == [(0, 2, 1.0), (3, 0, 7.0)]
    assert [r["nnz"] for r in M.degrees(t, "row").orderBy("row").collect()] == [1, 0, 0, 2]
    assert [r["offset"] for r in M.offsets(M.degrees(t, "row"), "row", bucket=2).orderBy("row").collect()] == [0, 1, 1, 1]
    assert M.remove_bias(t, 0) is t
    assert [r["start"] + r["size"] for r in M.extents(spark, 5, 4).orderBy("block").collect()] == [1, 2, 3, 5]
    twice = spark.createDataFrame([(3,), (3,), (0,)], "row int")
    assert sorted(r["row"] for r in M.row_subset(t, twice).collect()) == [0, 1, 1, 2, 2]
    assert M.degrees(t.filter("row > 9"), "row").count() == 0


def test_log_edge_cases(spark):
    log = spark.createDataFrame([("d", 1, 1, "none", float(k), v, k) for k, v in enumerate([3.0, 2.0, 2.5, 1.0])] + [("d", 1, 1, "vs", 0.0, 9.0, 0)], "ds string, nw int, ci int, ctype string, time double, rmse double, update long")
    never = runlog.at_threshold(log.withColumn("threshold", F.lit(0.5))).collect()
    assert sorted((r["ctype"], r["time"]) for r in never) == [("none", 0.0), ("vs", 0.0)]
    pruned = runlog.prune_heading(runlog.differences(log))
    assert sorted((r["ctype"], r["time"]) for r in pruned.collect()) == [("none", 2.0), ("none", 3.0), ("vs", 0.0)]
    empty = spark.createDataFrame([], "ds string, nw int, ci int, ctype string, n int, time double, cost double")
    got = runlog.comparison(runlog.with_checkpoints(runlog.at_threshold(log.withColumn("threshold", F.lit(1.5))), empty)).collect()
    assert [(r["t_none"], r["t_sync"], r["nc_vs"], r["tc_vs"]) for r in got] == [(3.0, 0.0, 0, 0.0)]
    zero = runlog.overhead(runlog.comparison(runlog.with_checkpoints(runlog.at_threshold(log.withColumn("threshold", F.lit(9.5))), empty)), True, True).first()
    assert zero["o_vs"] is None


def test_parsers(spark):
    d = spark.createDataFrame([("10K",), ("inf",), ("5",), ("x",), ("1.5g",), (None,)], "s string")
    assert [r[0] for r in d.select(bandwidth(F.col("s"))).collect()] == [10000.0, float("inf"), None, None, 1.5e9, None]
    assert [r[0] for r in d.select(size_number(F.col("s"))).collect()] == [10000, None, 5, None, None, None]
    with pytest.raises(ValueError):
        power_law(F.col("s"), 0.5, 2.2)


def test_generator(spark):
    t = synth.generate(spark, 400, 100, 5)
    rows = t.collect()
    again = {(r["row"], r["col"], r["test"]): r["value"] for r in synth.generate(spark, 400, 100, 5).repartition(3).collect()}
    assert {(r["row"], r["col"], r["test"]): r["value"] for r in rows} == again and len(again) == len(rows)
    assert 0.1 < np.mean([r["test"] for r in rows]) < 0.3 and all(0 <= r["col"] < 100 for r in rows)
    for x in synth.row_sizes(spark, 400, 100).collect():
        cells = min(5 * x["degree"] // 4, 100)
        assert (x["train"], x["test"]) == (int(0.8 * cells), cells - int(0.8 * cells))
        assert (sum(r["row"] == x["row"] and not r["test"] for r in rows), sum(r["row"] == x["row"] and r["test"] for r in rows)) == (x["train"], x["test"])


@pytest.mark.parametrize(("columns", "degree"), [(60, 50), (60, 90), (4000, 60)])
def test_every_row_has_its_degree_under_skewed_weights(spark, columns, degree):
    rows = spark.range(30).select(F.col("id").alias("row"), F.lit(degree).cast("long").alias("degree"))
    weights = spark.range(columns).select(F.col("id").alias("col"), F.when(F.col("id") == 7, 0).otherwise(F.ceil(1e7 / F.pow(F.col("id") + 1.0, 2.5))).alias("weight"))
    cells = [tuple(r) for r in synth.sample_cells(rows, weights, 5).collect()]
    assert len(set(cells)) == len(cells) and all(c != 7 for _, c in cells)
    assert {r: sum(x == r for x, _ in cells) for r in range(30)} == dict.fromkeys(range(30), min(degree, columns - 1))
    assert sorted(cells) == sorted(tuple(r) for r in synth.sample_cells(rows.repartition(5), weights, 5).collect())
    few = spark.createDataFrame([(0, 0), (1, 1), (2, 5)], "row long, degree long")
    assert sorted(r["row"] for r in synth.sample_cells(few, weights.filter("col = 1"), 5).collect()) == [1, 2]


def test_short_rows_go_on_with_the_same_sampling(spark):
    """Weights 98, 1, 1, two of three cells: (0, 1), (0, 2) about equally often, (1, 2) with 2 * 0.01 / 99 only."""
    rows = spark.range(4000).select(F.col("id").alias("row"), F.lit(2).cast("long").alias("degree"))
    cells = synth.sample_cells(rows, spark.createDataFrame([(0, 98), (1, 1), (2, 1)], "col long, weight long"), 3).collect()
    count = [sum(r["col"] == c for r in cells) for c in range(3)]
    assert len(cells) == 8000 and count[0] > 3980 and abs(count[1] - count[2]) < 260


def test_bold_driver_covers_every_event(spark):
    from sparsewright.plans import catalogue

    sf = "/root/testdata/sf0.01"
    found = catalogue.queries()["t9_bold_driver"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/events.parquet").count() > 2000
    compare(spark, catalogue.queries()["t9_bold_driver"], catalogue.oracle_sql()["t9_bold_driver"], sf)


SF_RATINGS = "/root/testdata/sf0.001"


def _followed(t, start, parts, halves=1, reverse=False, step=0.0, lam=0.05):
    """One epoch of cyclic strata over `t`, cell by cell."""
    vec = {(r["kind"], r["id"]): np.array(r["vec"]) for r in start.collect()}
    cells = sorted(((r["col"], r["row"], r["value"]) for r in t.collect()), reverse=reverse)
    for s in range(parts):
        for half in range(halves):
            for p in range(parts):
                block = (p + s) % parts * halves + half
                for c, r, v in cells:
                    if r % parts == p and c % (parts * halves) == block:
                        w, h = vec["row", r], vec["col", c]
                        e = w @ h - v
                        vec["row", r], vec["col", c] = w - step * (e * h + lam * w), h - step * (e * w + lam * h)
    return vec


def _planned(t, parts, step, order, epochs=1, reverse=False, biased=False, mean=0.0, lam=0.05, start=None):
    """The sequential rule, cell by cell, over sub-epochs (lists of the block that each part owns)."""
    vec = {(r["kind"], r["id"]): np.array(r["vec"]) for r in start.collect()}
    cells = sorted(((r["col"], r["row"], r["value"]) for r in t.collect()), reverse=reverse)
    for owned in order:
        for p, block in enumerate(owned):
            for c, r, v in cells:
                if r % parts == p and c % parts == block:
                    w, h = vec["row", r], vec["col", c]
                    if biased:
                        x, y = np.append(w[:-1], 1.0), np.append(h[:-1], 1.0)
                        e = w[:-1] @ h[:-1] + w[-1] + h[-1] + mean - v
                    else:
                        x, y, e = w, h, w @ h - v
                    vec["row", r], vec["col", c] = w - step * (e * y + lam * w), h - step * (e * x + lam * h)
    return vec


@pytest.mark.parametrize(
    ("name", "options"),
    [("t1_column_sweeps", {}), ("t4_two_phase_blocks", {"halves": 2}), ("t11_reverse_order", {"reverse": True})],
)
def test_trainers_on_the_ratings_follow_the_sequential_rule(spark, name, options):
    from sparsewright.plans import catalogue, training

    t = training._scaled(spark, SF_RATINGS)
    want = _followed(t, training._start(t), training._parts(t), step=0.02 if "reverse" in options else 1.5 * 0.02 / 1.1, **options)
    got = {(r["kind"], r["id"]): r["vec"] for r in catalogue.queries()[f"{name}_ratings"](spark, SF_RATINGS).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    assert all(got[k] == pytest.approx(want[k].tolist(), abs=1e-9) for k in want)


def test_strata_and_scheduler_on_the_ratings_follow_the_sequential_rule(spark):
    from sparsewright.plans import catalogue, training

    t = training._scaled(spark, SF_RATINGS)
    parts = training._parts(t)
    want = _planned(t, parts, 1.5 * 0.02 / 1.1, sgd.strata(parts, 1, "wor"), start=training._start(t))
    got = {(r["kind"], r["id"]): r["vec"] for r in catalogue.queries()["t3_stratified_ratings"](spark, SF_RATINGS).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k].tolist(), abs=1e-9) for k in want)

    mean, start = t.agg(F.avg("value")).first()[0], sgd.start(t, 3, biased=True)
    waves = [w for epoch in sgd.least_visited(3, 2, 1, 5) for w in epoch]
    want = _planned(t, 3, 0.01, waves, biased=True, mean=mean, start=start)
    factors, log = sgd.train(t, start, 3, 1, 0.01, strategy="least", seed=5, biased=True, mean=mean, bold=(0.5, 1.0))
    got = {(r["kind"], r["id"]): r["vec"] for r in factors.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k].tolist(), abs=1e-9) for k in want)
    errors = [(want["row", r["row"]][:-1] @ want["col", r["col"]][:-1] + want["row", r["row"]][-1] + want["col", r["col"]][-1] + mean - r["value"]) ** 2 for r in t.collect()]
    assert log[0].rmse == pytest.approx(np.mean(errors) ** 0.5) and log[0].test_rmse is None


def test_scheduler_spreads_its_visits():
    for parts, workers in ((4, 3), (5, 4), (3, 1)):
        scheduler = sgd.Scheduler(parts, 3)
        for _ in range(40):
            jobs = [scheduler.take() for _ in range(workers)]
            assert None not in jobs and len({p for p, _ in jobs}) == len({b for _, b in jobs}) == workers
            scheduler.free()
            scheduler.mix()
        assert scheduler.visits.max() - scheduler.visits.min() <= 2
    assert [sum(b is not None for w in epoch for b in w) for epoch in sgd.least_visited(3, 2, 4, 1)] == [9] * 4
    full = sgd.Scheduler(1)
    assert full.take() == (0, 0) and full.take() is None


def test_runs_without_repeats_are_the_sequential_sweep():
    r = np.random.default_rng(0)
    for n in (0, 1, 300):
        i, j = r.integers(0, 12, n), r.integers(0, 9, n)
        runs = sgd.levels(i, j)
        assert sorted(k for x in runs for k in x.tolist()) == list(range(n))
        place = {k: m for m, x in enumerate(runs) for k in x.tolist()}
        for x in runs:
            assert len(set(i[x])) == len(set(j[x])) == len(x)
        assert all(place[a] < place[b] for a in range(n) for b in range(a + 1, n) if i[a] == i[b] or j[a] == j[b])


def test_starts_are_seeded_and_bounded(spark):
    t = _low_rank(spark, 15, 10)
    a = {(r["kind"], r["id"]): r["vec"] for r in sgd.start(t, 4, 7).collect()}
    assert a == {(r["kind"], r["id"]): r["vec"] for r in sgd.start(t.repartition(5), 4, 7).collect()} != {(r["kind"], r["id"]): r["vec"] for r in sgd.start(t, 4, 8).collect()}
    numbers = np.array(list(a.values()))
    assert 0 <= numbers.min() and 0.4 < numbers.max() < 0.5 and len(np.unique(numbers)) == numbers.size == 100
    small = sgd.start(t, 4, kind="small", biased=True).collect()
    assert all(max(r["vec"]) < 0.1 and r["vec"][-1] == 0 and len(r["vec"]) == 5 for r in small)
    with pytest.raises(ValueError):
        sgd.start(t, 4, kind="large")


def test_training_stops_by_change_and_by_value(spark):
    t = _low_rank(spark)
    _, log = sgd.train(t, _start(t, 4), 2, 40, 0.05, 0.0, 0.001, min_error=0.01, test=t.filter("row < 9"))
    change = [abs(b.rmse - a.rmse) for a, b in zip(log, log[1:], strict=False)]
    assert 2 <= len(log) < 40 and change[-1] <= 0.01 and all(c > 0.01 for c in change[:-1]) and all(x.test_rmse > 0 for x in log)
    _, log = sgd.train(t, _start(t, 4), 2, 40, 0.05, 0.0, 0.001, stop_rmse=1e9, settled=3)
    assert len(log) == 3
    with pytest.raises(ValueError):
        sgd.train(t, _start(t, 4), 2, 1, 0.05, strategy="none")


def test_a_sub_epoch_reads_its_own_cells_and_tables_go(spark, tmp_path):
    t = _low_rank(spark, 30, 20)
    cells = sgd.Cells(t, 3, 3)
    seen = []
    for owned in sgd.strata(3, 1, "wor"):
        mine = cells.of(owned)
        assert len(mine.inputFiles()) < len(cells.whole.inputFiles()) and mine.filter(F.pmod("col", F.lit(3)) != F.col("block")).isEmpty()
        seen += [tuple(r) for r in mine.select("row", "col").collect()]
    assert sorted(seen) == sorted(tuple(r) for r in t.select("row", "col").collect())
    assert cells.of([None] * 3).isEmpty()
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    sgd.train(t, _start(t, 3), 3, 2, 0.05)
    assert len(set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before) == 2  # the ratings and the last factors


def test_early_stop_follows_the_rule_and_stops(spark):
    from sparsewright.plans import training

    sf = SF_RATINGS
    stopped = {(r["kind"], r["id"], r["t"]): r["x"] for r in _sides(training._ccd(spark, sf, 2, 4, eps=0.3, nonneg=True))}
    free = {(r["kind"], r["id"], r["t"]): r["x"] for r in _sides(training._ccd(spark, sf, 2, 4, nonneg=True))}
    assert stopped.keys() == free.keys() and any(abs(stopped[k] - free[k]) > 1e-6 for k in free)
    want, steps = _ranks(fixtures.event_matrix(spark, sf).collect(), 2, 0.1, 2, 4, 0.3)
    assert steps < 2 * 2 * 4 and all(stopped[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def _sides(trained):
    rows, cols, _ = trained
    return rows.withColumn("kind", F.lit("row")).unionByName(cols.withColumn("kind", F.lit("col"))).collect()


def _ranks(cells, k, lam, outer, inner, eps, quit_after=5):
    """Non-negative rank-one coordinate descent with the early stop, in numpy; factors and inner steps taken."""
    rows, cols = sorted({c["row"] for c in cells}), sorted({c["col"] for c in cells})
    i, j = (np.array([x.index(c[n]) for c in cells]) for x, n in ((rows, "row"), (cols, "col")))
    r = np.array([c["value"] for c in cells])
    u = np.array([[((a * 7 + t * 3) % 10 + 1) / 20 for a in rows] for t in range(k)])
    v, most, seen, steps = np.zeros((k, len(cols))), 0.0, 0, 0

    def half(other, old, key, n):
        g, h = np.bincount(key, other * r, n), lam * np.bincount(key, minlength=n) + np.bincount(key, other * other, n)
        new = np.maximum(g / h, 0)
        return new, float(np.where(g / h < 0, -2 * g * old + h * old * old, h * (old - new) ** 2).sum())

    for o in range(outer):
        early = 0
        for t in range(k):
            if early >= quit_after:
                break
            r = r + u[t][i] * v[t][j] * (o > 0)
            for n in range(inner):
                steps += 1
                v[t], a = half(u[t][i], v[t], j, len(cols))
                u[t], b = half(v[t][j], u[t], i, len(rows))
                if a + b < most * eps:
                    early += n == 0
                    break
                most = max(most, a + b) if seen else most
                seen += 1
            r = r - u[t][i] * v[t][j]
    return {**{("row", a, t): u[t][x] for t in range(k) for x, a in enumerate(rows)}, **{("col", a, t): v[t][x] for t in range(k) for x, a in enumerate(cols)}}, steps


def test_other_trainers_run_on_the_ratings(spark):
    from sparsewright.plans import catalogue, training

    t = training._scaled(spark, SF_RATINGS)
    sides = {kind: t.select(kind).distinct().count() for kind in ("row", "col")}
    biased = catalogue.queries()["t6_biased_ratings"](spark, SF_RATINGS).collect()
    assert {k: sum(r["kind"] == k for r in biased) for k in sides} == sides and all(np.isfinite(r["vec"]).all() for r in biased)
    rounds = catalogue.queries()["t13_rounds_ratings"](spark, SF_RATINGS).orderBy("round").collect()
    assert [r["loss"] for r in rounds] == sorted((r["loss"] for r in rounds), reverse=True) and all(r["test_rmse"] > 0 for r in rounds)
    assert training._parts(spark.range(250_001)) == 3 and training._parts(t) == 2


def test_noise_of_generated_values(spark):
    from sparsewright.plans import catalogue

    (x,) = catalogue.queries()["g4_noisy_values"](spark, SF_RATINGS).collect()
    assert x["cells"] > 10_000 and abs(x["mean"]) < 0.004 and abs(x["spread"] - 0.1) < 0.004


def test_numbers_come_from_ranges_whatever_the_ids(spark):
    n = 20_000
    ids = spark.range(n).select(F.format_string("Customer#%09d", "id").alias("id"))
    numbered = M.numbered(ids.repartition(7), "id")
    assert [r["id"] for r in M.id_map(ids.union(ids)).orderBy("idx").limit(3).collect()] == [f"Customer#{k:09d}" for k in range(3)]
    got = numbered.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx"), F.sum((F.substring("id", 10, 9).cast("long") != F.col("idx")).cast("int"))).first()
    assert tuple(got) == (0, n - 1, n, 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = M.cut(ids.repartitionByRange("id").withColumn("r", F.spark_partition_id())).groupBy("r").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < n / 2
    t = spark.createDataFrame([(5_000_000, 1, 1.0)], "row long, col long, value double")
    assert M.dense_ids(t, "row").rdd.getNumPartitions() > 1 and M.dense_ids(t, "row").count() == 5_000_001
    assert M.numbered(ids.limit(0), "id").count() == 0


def test_binary_ranges_know_what_lies_before_them(spark, tmp_path):
    cells = [(r, c, float(r + c)) for r in range(50) for c in range(r % 7)]
    t = spark.createDataFrame(cells, "row int, col int, value double")
    binary.write(t, f"{tmp_path}/a.dat", 50, 9)
    parts = binary.MatrixReader({"path": f"{tmp_path}/a.dat", "parts": "6"}).partitions()
    assert [(p.before, p.held) for p in parts] == [(sum(r % 7 for r in range(p.first)), sum(r % 7 for r in range(p.first, p.last))) for p in parts]
    assert sorted(map(tuple, binary.read(spark, f"{tmp_path}/a.dat", 6).collect())) == cells


def test_stored_folders_are_checked(spark, tmp_path):
    t = spark.createDataFrame([(0, 1, 2.0), (3, 0, 4.0)], "row long, col long, value double")
    model.save_data(t, f"{tmp_path}/d")
    assert sorted(map(tuple, model.load_data(spark, f"{tmp_path}/d").collect())) == [(0, 1, 2.0), (3, 0, 4.0)]
    assert dict(map(tuple, model.view(spark, f"{tmp_path}/d").collect())) == {"type": "data", "nrows": "4", "ncols": "2", "nnz": "2", "mean": "3.0"}
    with pytest.raises(ValueError, match="holds a data"):
        model.load_model(spark, f"{tmp_path}/d")
    spark.createDataFrame([("data", 9, "{}")], "type string, version int, params string").write.parquet(f"{tmp_path}/e/params")
    with pytest.raises(ValueError, match="version 9"):
        model.load_data(spark, f"{tmp_path}/e")
    factors = spark.createDataFrame([("row", 0, [1.0, 0.5]), ("col", 1, [2.0, 0.25])], "kind string, id long, vec array<double>")
    for biased, want in ((True, 1 * 2 + 0.5 + 0.25 + 3), (False, 1 * 2 + 0.5 * 0.25)):
        model.save_model(model.from_factors(factors, biased, mean=3.0 if biased else 0.0), f"{tmp_path}/m{biased}")
        assert [r["pred"] for r in model.predict(model.load_model(spark, f"{tmp_path}/m{biased}"), t).collect()] == [want]


def test_best_items_of_every_row(spark, monkeypatch):
    from sparsewright.plans import catalogue, fixtures, models

    monkeypatch.setattr(models, "ROW_BLOCK", 40)
    monkeypatch.setattr(models, "COL_BLOCK", 30)
    query, sql = catalogue.queries()["extension_top_items"], catalogue.oracle_sql()["extension_top_items"]
    ids = {r["row"] for r in fixtures.ratings(spark, SF_RATINGS, False).select("row").distinct().collect()}
    assert {r["row"] for r in query(spark, SF_RATINGS).select("row").collect()} == ids and max(ids) > 20
    compare(spark, query, sql, SF_RATINGS)


@pytest.mark.parametrize("options", [{"strategy": "wor", "reverse": True, "bold": (0.5, 1.05)}, {"halves": 2, "strategy": "wr", "reuse": 2}, {"strategy": "least", "biased": True, "mean": 0.1}, {"min_error": 0.01}])
def test_peers_follow_the_sub_epochs_in_one_stage(spark, monkeypatch, options):
    t = _low_rank(spark, 30, 20).withColumn("row", F.col("row") - 7)  # some ids below zero, parts without columns
    start = _start(t, 3, extra=int(options.get("biased", False)))
    written = []
    monkeypatch.setattr(sgd, "cut", lambda df, cut=sgd.cut: written.append(1) or cut(df))
    a, log = sgd.train(t, start, 7, 3, 0.05, 0.1, **options)
    assert len(written) == 3  # the ratings, the first and the last factors, not those of 21 sub-epochs and more
    monkeypatch.setattr(sgd.peers, "HELD", 0)
    b, by_stage = sgd.train(t, start, 7, 3, 0.05, 0.1, **options)
    a, b = ({(r["kind"], r["id"]): r["vec"] for r in f.collect()} for f in (a, b))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)
    assert len(log) == len(by_stage) and all(x[:4] == pytest.approx(y[:4]) for x, y in zip(log, by_stage, strict=True))


def test_ratings_without_factors_are_passed_over(spark):
    t = _low_rank(spark, 12, 9)
    start = _start(t, 3).filter("not (kind = 'row' and id = 4) and not (kind = 'col' and id in (0, 8))")
    some = t.filter("row <> 4 and col not in (0, 8)")
    a, b = ({(r["kind"], r["id"]): r["vec"] for r in sgd.train(x, start, 4, 1, 0.05)[0].collect()} for x in (t, some))
    assert a == b and len(a) == 18
    none, log = sgd.train(t.limit(0), start, 3, 2, 0.05)
    assert none.count() == 18 and [x.loss for x in log] == [0.0, 0.0]


def test_scheduler_of_many_parts_takes_the_least_visited(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(sgd, "LOOK", 3)
    scheduler, visits = sgd.Scheduler(9, 4), np.zeros(81, int)
    for _ in range(60):
        rows, cols = set(), set()
        for _ in range(int(r.integers(1, 11))):
            free = [k for k in scheduler.order.tolist() if k // 9 not in rows and k % 9 not in cols]
            want = min(free, key=lambda k: visits[k]) if free else None
            got = scheduler.take()
            assert got == (None if want is None else (want // 9, want % 9))
            if want is not None:
                visits[want] += 1
                rows.add(want // 9)
                cols.add(want % 9)
        scheduler.free()
        scheduler.mix()
    monkeypatch.undo()
    began = time.process_time()
    (waves,) = sgd.least_visited(200, 199, 1, 1)
    assert sum(b is not None for w in waves for b in w) == 40_000 and time.process_time() - began < 10


def test_starts_round_like_sql_where_the_scaled_number_is_a_half(spark, tmp_path):
    """Ids whose numbers come to a half at the twelfth digit, found among two million."""
    from sparsewright.functions import scaled_round
    from sparsewright.plans import catalogue

    for name in os.listdir(SF_RATINGS):
        if name not in ("orders.parquet", "lineitem.parquet"):
            os.symlink(f"{SF_RATINGS}/{name}", tmp_path / name)
    ids = [334614, 234345, 628164, 846196, 752674, 190327]
    orders = spark.read.parquet(f"{SF_RATINGS}/orders.parquet").limit(1).drop("o_orderkey", "o_custkey")
    keys = spark.createDataFrame([(k, c) for k, c in enumerate(ids)], "o_orderkey long, o_custkey long")
    keys.crossJoin(orders).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.read.parquet(f"{SF_RATINGS}/lineitem.parquet").limit(1).drop("l_orderkey", "l_partkey")
    spark.createDataFrame([(k, k) for k in range(6)], "l_orderkey long, l_partkey long").crossJoin(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    query, sql = catalogue.queries()["t12_seeded_start"], catalogue.oracle_sql()["t12_seeded_start"]
    con = connection(str(tmp_path))
    want = {(k, i): tuple(v) for k, i, v in con.execute(f"SELECT kind, id, vec FROM ({sql})").fetchall()}
    assert {(r["kind"], r["id"]): tuple(r["vec"]) for r in query(spark, str(tmp_path)).collect()} == want and len(want) == 12
    signs = spark.createDataFrame([(-2.5,), (2.5,), (-0.4,), (0.0,), (None,)], "x double").select(scaled_round(F.col("x"), 0)).collect()
    assert [r[0] for r in signs] == [-3.0, 3.0, 0.0, 0.0, None]


def test_best_items_score_each_different_vector_once(spark, monkeypatch):
    from sparsewright.plans import models

    seen = []
    monkeypatch.setattr(models, "_blocks", lambda side, *a, f=models._blocks: seen.append(side.count()) or f(side, *a))
    monkeypatch.setattr(models, "ROW_BLOCK", 2)
    monkeypatch.setattr(models, "COL_BLOCK", 4)
    r = np.random.default_rng(3)
    some = [r.integers(0, 3, 2).astype(float).tolist() for _ in range(40)]
    rows = [(10**9 * k, some[k % 6]) for k in range(30)]
    cols = [(7 * k, some[k % 17]) for k in range(300)]
    side = lambda x, key: spark.createDataFrame(x, f"{key} long, vec array<double>")
    got = sorted(map(tuple, models.best_items(side(rows, "row"), side(cols, "col")).collect()))
    want = []
    for i, w in rows:
        best = sorted((-float(np.dot(w, h)), j) for j, h in cols)[:5]
        want += [(i, j, -p, n) for n, (p, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert seen == [len({tuple(v) for _, v in rows}), 5 * len({tuple(v) for _, v in cols})]
