import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from brute import jaccard, log_jaccard, near_classes, probability_jaccard, shingle_bag
from pyspark.sql import functions as F

from sparsewright.llm import near_dedup
from sparsewright.llm.components import components
from sparsewright.llm.kernels import raw
from sparsewright.llm.near_dedup import likeness, near_duplicates, prob_minhash, weighted_shingles


def _same_classes(found, wanted):
    groups = {}
    for i, c in found.items():
        groups.setdefault(c, set()).add(i)
    other = {}
    for i, c in wanted.items():
        other.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def _bags(*texts):
    import pyarrow as pa

    first, shingle, weight = weighted_shingles(*raw(pa.array(texts)))
    return first, shingle, weight


def test_likeness_and_signature_agree_with_brute_force():
    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(6)]
    for _ in range(30):
        a = " ".join(r.choice(vocabulary) for _ in range(60))
        b = a.split()
        for _ in range(r.randrange(12)):
            b[r.randrange(len(b))] = r.choice(vocabulary)
        b = " ".join(b)
        first, s, w = _bags(a, b)
        got = likeness(s[: first[1]], w[: first[1]], s[first[1] :], w[first[1] :])
        want = probability_jaccard(shingle_bag(a), shingle_bag(b))
        assert got == pytest.approx(want)
        logs = 1 + np.log(w)
        assert likeness(s[: first[1]], logs[: first[1]], s[first[1] :], logs[first[1] :]) == pytest.approx(log_jaccard(shingle_bag(a), shingle_bag(b)))
        kept = prob_minhash(first, s, w, 4096)
        assert np.mean(kept[0] == kept[1]) == pytest.approx(want, abs=0.05)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 500)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 500: 500}


def test_equals_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    _same_classes(found, near_classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_chains_hot_groups_and_edge_cases(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    rows, i = [], 0
    for _ in range(80):  # copies of copies drift away
        rows.append((i, " ".join(base), "x"))
        i += 1
        if i % 3:
            base = list(base)
            base[r.randrange(200)] = f"n{i}"
    shared = [f"s{k}" for k in range(60)]  # alike, but under the threshold
    for _ in range(25):
        rows.append((i, " ".join(shared + [f"o{i}_{k}" for k in range(20)]), "y"))
        i += 1
    rows += [(900, None, "z"), (901, "", "z"), (902, "one two", None), (903, "ONE  two", None), (904, "one two three", "z"), (905, " \n ", "z")]
    rows += [(906, "e " * 400 + "f", "z"), (907, "e " * 401, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    out = near_duplicates(docs).collect()
    _same_classes({x["doc_id"]: x["class_id"] for x in out}, near_classes([x[:2] for x in rows]))
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) for x in out)
    for weighting, like in (("counts", probability_jaccard), ("set", jaccard)):
        counted = near_duplicates(docs.filter("doc_id >= 80"), weighting=weighting).collect()
        _same_classes({x["doc_id"]: x["class_id"] for x in counted}, near_classes([x[:2] for x in rows if x[0] >= 80], like=like))
    assert near_duplicates(docs.filter(F.lit(False))).count() == 0
    long = " ".join(f"l{k}" for k in range(60_000))
    long = spark.createDataFrame([(1, long), (2, long + " and more"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_duplicates(long).collect()) == [(1, 1), (2, 1), (3, 3)]
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(odd).collect()), key=str) == [(1, 1, True), (1, 1, True), (None, 1, False)]


def test_one_id_with_several_texts_is_one_document(spark):
    rows = [(None, f"n{k} text") for k in range(4)] + [(1, "a"), (1, "a"), (5, "x"), (5, "y"), (7, "y")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    x_first = hashlib.sha256(b"x").digest() < hashlib.sha256(b"y").digest()
    assert Counter((r["doc_id"], r["class_id"]) for r in out) == Counter([(None, None)] * 4 + [(1, 1)] * 2 + [(5, 5 if x_first else 7)] * 2 + [(7, 7)])


@pytest.mark.parametrize("weighting", ["set", "counts", "log"])
def test_pairs_at_exactly_the_threshold_are_linked(spark, weighting):
    """12 of 15, 48 of 60 and 80 of 100 shingles shared; 79 of 101 are too few."""
    pairs = [([f"a{k}" for k in range(16)], [f"a{k}" for k in range(16)] + ["x", "y", "z"])]
    pairs.append(([f"b{k}" for k in range(52)], [f"b{k}" for k in range(52)] + [f"x{k}" for k in range(12)]))
    whole = [f"c{k}" for k in range(94)]
    for name, places in (("d", (20, 60)), ("e", (20, 60, 93))):
        base = [f"{name}{w}" for w in whole]
        pairs.append((base, [f"n{k}" if k in places else w for k, w in enumerate(base)]))
    rows = [(2 * i + j, " ".join(words)) for i, pair in enumerate(pairs) for j, words in enumerate(pair)]
    sizes = [(len(a & b), len(a | b)) for a, b in ((shingle_bag(x).keys(), shingle_bag(y).keys()) for (_, x), (_, y) in zip(rows[::2], rows[1::2], strict=True))]
    assert sizes == [(12, 15), (48, 60), (80, 100), (79, 101)]
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighting=weighting).collect()}
    assert [found[2 * i] == found[2 * i + 1] for i in range(4)] == [True, True, True, False]


def test_a_block_counts_shared_shingles_within_bounded_memory(monkeypatch):
    """Heads and members that share nearly all shingles: 128 x 96 x 1000 hits in the index, a bounded run of them at once."""
    r = np.random.default_rng(5)
    common = np.sort(r.integers(0, 1 << 63, 1200, dtype=np.uint64))
    text = lambda: (np.sort(r.choice(common, 1000, replace=False)), 1.0 + r.random(1000))
    heads, members = [(k, k, *text()) for k in range(128)], [text() for _ in range(96)]
    index, component = near_dedup._index([h[2:] for h in heads]), np.arange(1000, 1096)
    near_dedup.likeness(*members[0], *members[1])
    tracemalloc.start()
    found = near_dedup._within(heads, index, members, component, 0.62)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    want = [(h, m) for m in range(96) for h in range(128) if near_dedup.likeness(*heads[h][2:], *members[m]) >= 0.62]
    assert found == want and 0 < len(want) < 96 * 128
    monkeypatch.setattr(near_dedup, "HITS", 100)
    assert near_dedup._within(heads, index, members[:3], component[:3], 0.62) == [x for x in want if x[1] < 3]
