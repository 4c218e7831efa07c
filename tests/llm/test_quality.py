import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsewright.llm.kernels import raw
from sparsewright.llm.quality import BINS, RATE, STATISTICS, Ensemble, drop_poor, fit, lasso, quality_scores, statistics, train, tree_rules

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_expression_equals_the_model(spark, tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    mine = [(r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert mine and all(got[i]["held_out"] for i, _ in mine)
    assert np.mean([got[i]["predicted"] == q for i, q in mine]) > 0.98
    model = train(docs, labels)
    rows = docs.limit(300).collect()
    want = model.score(statistics(*raw(pa.array([r["text"] for r in rows]))))
    assert np.allclose([got[r["doc_id"]]["score"] for r in rows], want)
    assert all(got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7) for r in rows)


def test_held_out_labels_are_not_used(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train(docs, labels) == train(docs, turned)


def test_statistics_by_hand():
    x = dict(zip(STATISTICS, statistics(*raw(pa.array(["ab ab! AB\nab ab |"])))[0], strict=True))
    assert x["words"] == np.log1p(6) and x["repeats"] == 1 / 6 and x["bangs"] == 1 / 6 and x["bars"] == 1 / 6 and x["upper"] == 2 / 17
    assert x["top"] == 3 / 6 and x["distinct"] == 4 / 6 and x["runs2"] == 0.0
    assert not statistics(*raw(pa.array(["", None]))).any()


def test_rules_are_the_paths_of_plainly_grown_trees():
    """Trees grown by loops over rows and bounds, with the same random choices."""
    r = np.random.default_rng(5)
    x = np.round(r.random((120, 4)), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    rng, n, d = np.random.default_rng(7), 120, 4
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).tolist() for k in range(d)]
    f, want = [math.log((y.sum() + 1) / (n - y.sum() + 1))] * n, []
    for _ in range(3):
        p = [1 / (1 + math.exp(-v)) for v in f]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [max(b * (1 - b), 1e-6) for b in p]
        used = (rng.random(n) < 0.6).tolist()
        pool = rng.permutation(d)[: max(1, d * 2 // 3)].tolist()

        def grow(rows, path, left, g=g, h=h, used=used, pool=pool):
            mine, best, choice = [i for i in rows if used[i]], 1e-3, None
            if left and len(mine) >= 20:
                gain_of = lambda side: sum(g[i] for i in side) ** 2 / (sum(h[i] for i in side) + 1)
                for k in pool:
                    for b in bounds[k]:
                        low, high = [i for i in mine if x[i, k] <= b], [i for i in mine if x[i, k] > b]
                        gain = gain_of(low) + gain_of(high) - gain_of(mine) if min(len(low), len(high)) >= 5 else 0
                        if gain > best + 1e-12:
                            best, choice = gain, (k, b)
            if choice is None:
                step = RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
                for i in rows:
                    f[i] += step
                return
            k, b = choice
            for above in (False, True):
                longer = (*path, (k, above, b))
                want.append(tuple(sorted(longer)))
                grow([i for i in rows if (x[i, k] > b) == above], longer, left - 1)

        grow(list(range(n)), (), 2)
    assert tree_rules(x, y, trees=3, depth=2) == list(dict.fromkeys(want))


def test_lasso_meets_its_optimality_conditions():
    """The gradient of the mean loss is -penalty * sign at weights that are not zero, and smaller elsewhere."""
    r = np.random.default_rng(2)
    z = (r.random((800, 10)) < 0.4).astype(float)
    y = (r.random(800) < 1 / (1 + np.exp(-(1.5 * z[:, 1] - z[:, 4] + 0.2)))).astype(float)
    b, w = lasso(z, y, 0.01, 6000)
    error = [1 / (1 + math.exp(-(b + sum(a * c for a, c in zip(w, row, strict=True))))) - t for row, t in zip(z, y, strict=True)]
    assert abs(sum(error)) / 800 < 1e-6
    for k in range(10):
        slope = sum(e * row[k] for e, row in zip(error, z, strict=True)) / 800
        assert abs(slope + 0.01 * np.sign(w[k])) < 1e-5 if w[k] else abs(slope) <= 0.01 + 1e-9


def test_score_is_the_sum_of_the_rules_that_hold():
    rules = [(((0, True, 0.5),), 2.0), (((0, False, 0.5), (2, True, 0.1)), -3.0), ((), 0.25)]
    x = np.array([[0.6, 0, 0.0], [0.5, 0, 0.2], [0.1, 0, 0.1]])
    for row, want in zip(x, (0.5 + 2 + 0.25, 0.5 - 3 + 0.25, 0.5 + 0.25), strict=True):
        assert Ensemble(0.5, rules).score(row[None, :])[0] == pytest.approx(1 / (1 + math.exp(-want)))


def test_lasso_finds_the_sparse_answer():
    r = np.random.default_rng(0)
    z = (r.random((3000, 12)) < 0.5).astype(float)
    y = (r.random(3000) < 1 / (1 + np.exp(-(2.5 * z[:, 3] - 2.5 * z[:, 7])))).astype(float)
    _, w = lasso(z, y, 0.01)
    assert w[3] > 1 and w[7] < -1 and np.abs(np.delete(w, [3, 7])).max() < 0.2


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2, "fine words", "c"), (2, "fine words", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in quality_scores(docs, one).collect()} == {1}
    assert drop_poor(docs, one).columns == docs.columns and drop_poor(docs, one).count() == 4
    assert quality_scores(docs.filter(F.lit(False)), one).count() == 0
    assert fit(np.zeros((50, len(STATISTICS))), np.array([0.0, 1.0] * 25)).score(np.zeros((1, len(STATISTICS))))[0] == pytest.approx(0.5)
