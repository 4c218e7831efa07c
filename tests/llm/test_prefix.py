import itertools
import random

import pytest
from brute import jaccard, log_jaccard, probability_jaccard, shingle_bag

from sparsewright.llm.near_dedup import prefix_buckets


@pytest.mark.parametrize(("weighting", "like"), [("set", jaccard), ("log", log_jaccard), ("counts", probability_jaccard)])
def test_alike_texts_meet_in_a_prefix_shingle(spark, weighting, like):
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for i in range(60):
        words = list(base[: r.choice([80, 80, 75, 60])])
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"n{i}_{r.randrange(99)}"
        texts.append((i, " ".join(words + [f"line {i % 3} of words again"] * r.choice([0, 1, 4]))))
    met = {}
    for x in prefix_buckets(spark.createDataFrame(texts, "id long, text string"), 0.8, weighting).collect():
        met.setdefault(x["key"], set()).add(x["id"])
    together = {p for ids in met.values() for p in itertools.combinations(sorted(ids), 2)}
    alike = {(a, b) for (a, s), (b, t) in itertools.combinations(texts, 2) if like(shingle_bag(s), shingle_bag(t)) >= 0.8}
    assert alike and alike <= together
