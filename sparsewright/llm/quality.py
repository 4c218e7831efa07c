"""A quality classifier: a sparse ensemble of rules, compiled into column expressions.

1. Statistics of every text (shares of symbols, capitals, repeated words and word runs, ...), by the
   vectorised kernels.
2. Boosted trees of depth `DEPTH` over binned statistics; every node's path is a rule, a conjunction of
   comparisons.
3. Logistic regression with an L1 penalty over the rules (accelerated proximal gradient): most weights end
   at zero.
4. The rules that are left become one Spark expression over the statistics' columns.

The fit uses at most `SAMPLE` labelled rows, those whose ids have the smallest MD5; everything else sees
all rows.  Labels, language, source and id are no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import grams, mix, raw, release, slices, words

SAMPLE, TREES, DEPTH, BINS, RATE = 6000, 60, 3, 32, 0.2
PENALTY, STEPS = 0.002, 400
THRESHOLD = 0.7
_U = np.uint64

#: The statistics, all but the first three per word or per byte.
STATISTICS = (
    "words", "word_bytes", "wide", "upper", "digits", "marks", "bangs", "symbols", "bars", "stops", "commas", "lines",
    "repeats", "distinct", "top", "runs2", "runs5", "short", "quotes",
)

#: The bytes that each counted class holds.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b"()[]{}<>/\\=+_~^@`", "bangs": b"!?", "symbols": b"#$%&*",
    "bars": b"|", "stops": b".", "commas": b",;:", "lines": b"\n", "quotes": b"\"'-",
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS[list(_v)] = _k


def _distinct(row: np.ndarray, name: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct names and the largest count of one."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort(mix(name ^ mix(row.astype(_U))))  # of a (row, name); its row is looked up again below
    order = np.argsort(mix(name ^ mix(row.astype(_U))), kind="stable")
    row = row[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(head, len(key)))
    most = np.zeros(rows)
    np.maximum.at(most, row[head], count)
    return np.bincount(row[head], minlength=rows).astype(float), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of `STATISTICS` for each text; an empty text has zeros."""
    rows = len(offs) - 1
    w = words(data, offs)
    n_words, n_bytes = w.counts.astype(float), np.diff(offs).astype(float)
    per_word, per_byte = 1.0 / np.maximum(n_words, 1), 1.0 / np.maximum(n_bytes, 1)
    owner = np.repeat(np.arange(rows), np.diff(offs))
    kinds = len(_CLASSES) + 1
    counts = np.bincount(owner * kinds + _CLASS[data], minlength=rows * kinds).reshape(rows, kinds)
    by = {k: counts[:, i] for i, k in enumerate(_CLASSES)}
    wide = np.bincount(owner[data >= 0xC0], minlength=rows)
    same = np.bincount(w.row[1:][(w.name[1:] == w.name[:-1]) & (w.row[1:] == w.row[:-1])], minlength=rows) if len(w.row) > 1 else np.zeros(rows)
    distinct, most = _distinct(w.row, w.name, rows)
    runs = []
    for k in (2, 5):
        g = grams(w.name, k)
        inside = w.row[: len(g)] == w.row[k - 1 :] if len(g) else np.zeros(0, bool)
        row = w.row[: len(g)][inside]
        single, _ = _distinct(row, g[inside], rows)
        total = np.bincount(row, minlength=rows)
        runs.append(1.0 - single / np.maximum(total, 1) * (total > 0) - (total == 0))
    length = w.end - w.start
    columns = {
        "words": np.log1p(n_words), "word_bytes": np.bincount(w.row, length, rows) * per_word, "wide": wide * per_byte, "upper": by["upper"] * per_byte,
        "lines": by["lines"] * per_word, "repeats": same * per_word, "distinct": distinct * per_word, "top": most * per_word,
        "runs2": runs[0], "runs5": runs[1], "short": np.bincount(w.row[length <= 3], minlength=rows) * per_word,
    }
    for k in ("digits", "marks", "bangs", "symbols", "bars", "stops", "commas", "quotes"):
        columns[k] = by[k] * per_word
    return np.column_stack([columns[k] for k in STATISTICS])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, <statistic>, ...): every row of `docs` as a struct, so that no column's name matters, and its statistics."""
    where = docs.columns.index(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = StructType([rows.schema["row"], *(StructField(k, DoubleType()) for k in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).flatten()[where]], ["row", "text"])
            for part in slices(texts, "text"):
                x = statistics(*raw(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, x.T)], names=["row", *STATISTICS])
        release()

    return rows.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): value > bound, or value <= bound


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, bound in rule:
                c = F.col(STATISTICS[k])
                test = test & (c > float(bound) if above else c <= float(bound))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in rule:
        out &= x[:, k] > bound if above else x[:, k] <= bound
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The distinct paths to all nodes of boosted regression trees for the logistic loss."""
    rng = np.random.default_rng(7)
    n, d = x.shape
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
    binned = np.column_stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds)])  # bin <= i: value <= bounds[i]
    f = np.full(n, np.log((y.sum() + 1) / (n - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        used = rng.random(n) < 0.6
        pool = rng.permutation(d)[: max(1, d * 2 // 3)]

        def grow(here: np.ndarray, path: Rule, left: int, g=g, h=h, used=used, pool=pool) -> None:
            sample = here[used[here]]
            best = (1e-3, None)
            if left and len(sample) >= 20:
                gs, hs = g[sample], h[sample]
                whole = gs.sum() ** 2 / (hs.sum() + 1)
                for k in pool:
                    m = len(bounds[k]) + 1
                    b = binned[sample, k]
                    cg, ch = np.cumsum(np.bincount(b, gs, m))[:-1], np.cumsum(np.bincount(b, hs, m))[:-1]
                    cn = np.cumsum(np.bincount(b, minlength=m))[:-1]
                    if not len(cg):
                        continue
                    gain = cg**2 / (ch + 1) + (gs.sum() - cg) ** 2 / (hs.sum() - ch + 1) - whole
                    gain[(cn < 5) | (len(sample) - cn < 5)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (int(k), i))
            if best[1] is None:
                f[here] += RATE * g[here].sum() / (h[here].sum() + 1)
                return
            k, i = best[1]
            side = binned[here, k] <= i
            for above, mine in ((False, here[side]), (True, here[~side])):
                longer = (*path, (k, above, float(bounds[k][i])))
                rules[tuple(sorted(longer))] = None
                grow(mine, longer, left - 1)

        grow(np.arange(n), (), depth)
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with penalty * |weights|, by accelerated proximal gradient."""
    n, d = z.shape
    size = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    w = v = np.zeros(d)
    b = c = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    t = 1.0
    for _ in range(steps):
        r = 1.0 / (1.0 + np.exp(-(z @ v + c))) - y
        new = v - size * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = c - size * float(r.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Without rows, or with one class only, the score is the smoothed share of label 1."""
    if len(set(y.tolist())) < 2:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    rules = tree_rules(x, y)
    z = np.column_stack([holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(x), 0))
    if not rules:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    b, w = lasso(z, y)
    return Ensemble(float(b), [(r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-4])


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """Fit on at most `sample` labelled, not held out rows.  Several labels of an id count as their mean."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).alias("y")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_statistics(texts.join(F.broadcast(chosen), "id")).select("row.id", "row.y", *STATISTICS).orderBy("id", *STATISTICS).collect()
    x = np.array([[r[k] for k in STATISTICS] for r in rows]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["y"] for r in rows], float))


def scored(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """(row, score) of every row of `docs`."""
    return with_statistics(docs, text_col).select("row", model.column().alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, `held_out`, `score` (0 to 1, higher: label 1 likelier), `predicted`.

    Null texts are empty and have a score too.  Repeated rows score alike; a null id is not held out.
    Without labels the score is 1/2.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    out = scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select("row.id", "score")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns, whatever their names.

    Repeated rows stay or go together.  Without labels, or with those of one class only, nothing tells good
    texts from poor ones, and every row stays.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    if not model.rules:
        return docs
    return scored(docs, model, text_col).filter(F.col("score") >= threshold).select("row.*")
