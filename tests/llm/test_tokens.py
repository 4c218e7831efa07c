import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewright.llm.segmentation import MARK, decode, sample_segmentations, sample_texts, vocabulary
from sparsewright.llm.token_counts import count_tokens, default_model, load, split_text, splits_at_spaces

PATH = default_model()


def test_split_counts_add_up(spark):
    assert splits_at_spaces(PATH)
    model = load(PATH)
    for x in ["a  b   c ", "  ", "▁ a ▁b", "a " * 50, " x" * 50 + " ", "x  " * 40, "naïve <s> 中文 " * 20]:
        for limit in (1, 3, 20):
            assert sum(map(len, model.encode(split_text(x, limit)))) == len(model.encode(x)), x


def test_counts_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, piece_chars=500, call_bytes=2000).collect()}
    model = load(PATH)
    for r in docs.collect():
        n = len(model.encode(r["text"]))
        assert found[r["doc_id"]] == (len(r["text"].encode()), n, n > 4096)
    odd = spark.createDataFrame([(None, None, 1), (2, "", 1), (2, "", 1), (3, "x " * 60000, 1)], "doc_id long, text string, n_tokens int")
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in count_tokens(odd).collect()) == [(0, 0)] * 3 + [(120000, len(model.encode("x " * 60000)))]
    assert count_tokens(odd.filter(F.lit(False))).count() == 0


def _every(text, v):
    """{ids: log probability} of all segmentations, by recursion."""
    s, model, out = MARK + text.replace(" ", MARK), load(PATH), []
    tab = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    def go(i, ids, w):
        if i == len(s):
            out.append((ids, w))
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in tab:
                go(j, (*ids, tab[s[i:j]]), w + v.weight[tab[s[i:j]]])
            elif j == i + 1:
                b = s[i:j].encode()
                go(j, (*ids, *(int(v.byte_id[x]) for x in b)), w + len(b) * v.byte_weight)

    go(0, (), 0.0)
    z = np.logaddexp.reduce([w for _, w in out])
    return {i: w - z for i, w in out}


@pytest.mark.parametrize("text", ["the cat", "a  b", "\n", "héé", "of thes", "€ x"])
def test_samples_follow_the_distribution_without_replacement(text):
    v, n = vocabulary(PATH, 1.0), 3000
    every = _every(text, v)
    found = sample_texts([text] * n, np.arange(n), v, 3, 1)
    second = Counter()
    for rows in found:
        assert len({tuple(x[0]) for x in rows}) == len(rows) == min(3, len(every))
        assert [x[2] for x in rows] == sorted((x[2] for x in rows), reverse=True)
        for ids, log_p, _, _ in rows:
            assert every[tuple(ids.tolist())] == pytest.approx(log_p, abs=1e-6)
            assert decode(ids, v) == text
        if len(rows) > 1:
            second[tuple(rows[1][0].tolist())] += 1
    first = Counter(tuple(rows[0][0].tolist()) for rows in found)
    assert all(abs(first[i] / n - math.exp(p)) < 0.03 for i, p in every.items())
    want = Counter()
    for i, p in every.items():
        for j, q in every.items():
            if i != j and p < -1e-9:
                want[j] += math.exp(p + q) / -math.expm1(p)
    assert all(abs(second[j] / n - w) < 0.03 for j, w in want.items())
    # inclusion scores weigh the samples to the whole
    assert np.mean([sum(math.exp(x[1]) / x[3] for x in rows) for rows in found]) == pytest.approx(1.0, abs=0.05)


def test_round_trip_on_the_small_table_whatever_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    a = key(sample_segmentations(docs.repartition(1)))
    assert a == key(sample_segmentations(docs.repartition(7)))
    assert all(r[-1] for r in a) and len(a) == 2 * docs.count()


def test_edge_cases(spark):
    rows = [(None, None), (1, ""), (2, " "), (3, "a▁b"), (4, "\x00\U0001f600"), (4, "\x00\U0001f600"), (5, "w" * 3000), (6, "x " * 30000)]
    out = sample_segmentations(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rank int"), with_ids=True).collect()
    assert all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] and 0 < r["inclusion"] <= 1 for r in out)
    assert Counter(r["doc_id"] for r in out)[None] == 1


def test_query_and_last_stage_return_ids_and_decoded_texts(spark):
    import corpus_pipeline

    from sparsewright.llm.queries import op9_sentencepiece

    sf = "/root/testdata/sf0.001"
    docs, v = spark.read.parquet(f"{sf}/documents.parquet"), vocabulary(PATH, 1.0)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for out in (op9_sentencepiece(spark, sf), corpus_pipeline.pieces(spark, docs, sf)):
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == text.keys()
        for r in rows:
            ids = np.array(r["ids"], np.int32)
            assert len(ids) == r["n_pieces"] and hashlib.sha256(ids.tobytes()).hexdigest() == r["ids_sha256"]
            assert r["decoded"] == decode(ids, v) == text[r["doc_id"]].replace(MARK, " ")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert {(r["doc_id"], len(r["ids"]), r["decoded"]) for r in sample_segmentations(odd, k=1).collect() if r["doc_id"] < 3} == {(1, 0, ""), (2, 0, "")}


def test_samples_do_not_depend_on_slices_and_hold_little(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from sparsewright.llm import segmentation

    words = [f"w{k * 7919 % 4001}" for k in range(4001)]
    texts = [" ".join(words[(k * 37 + j * (k % 11 + 1)) % 4001] for j in range(1500)) for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.array(range(400))], ["id", "text", "key"])
    assert len("".join(texts)) > 3_000_000
    run = segmentation._sample(segmentation.default_model(), segmentation.ALPHA, segmentation.K, segmentation.SEED, True)
    rows = lambda: sorted(x for out in run([batch]) for x in zip(*(out.column(c).to_pylist() for c in ("id", "rank", "ids_sha256", "log_prob")), strict=True))
    next(iter(run([batch.slice(0, 1)])))
    tracemalloc.start()
    for _ in run([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    found = rows()
    monkeypatch.setattr(segmentation, "SLICE", 200_000)
    assert rows() == found and len(found) == 800
