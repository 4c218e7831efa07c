from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from brute import _lower, near_classes
from pyspark.sql import functions as F

from sparsewright.llm.kernels import raw
from sparsewright.llm.mixing import mix
from sparsewright.llm.quality import statistics, train
from sparsewright.llm.segmentation import sample_texts, vocabulary
from sparsewright.llm.token_counts import default_model

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = train(docs, labels)
    score = dict(zip(rows, model.score(statistics(*raw(pa.array([r["text"] for r in rows.values()])))), strict=True))
    left = {i for i in rows if score[i] >= 0.7}

    step = corpus_pipeline.checkpointed(corpus_pipeline.quality(spark, docs, SF))
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == left

    last = {}
    for i in left:
        last[_lower(rows[i]["text"])] = max(i, last.get(_lower(rows[i]["text"]), i))
    step = corpus_pipeline.checkpointed(corpus_pipeline.exact(spark, step, SF))
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == set(last.values())

    classes = near_classes([(i, rows[i]["text"]) for i in last.values()])
    step = corpus_pipeline.checkpointed(corpus_pipeline.near(spark, step, SF))
    kept = [r["doc_id"] for r in step.collect()]
    assert step.columns == docs.columns and sorted(classes[i] for i in kept) == sorted(set(classes.values()))

    copies = {r["doc_id"]: r["copies"] for r in mix(step).collect()}
    step = corpus_pipeline.checkpointed(corpus_pipeline.mix(spark, step, SF))
    assert step.columns == docs.columns and Counter(r["doc_id"] for r in step.collect()) == {i: n for i, n in copies.items() if n}

    out = corpus_pipeline.pieces(spark, step, SF).collect()
    assert len(out) == sum(copies.values()) * 2 and all(r["round_trip"] for r in out)
    some = next(i for i in copies if copies[i])
    key = docs.filter(F.col("doc_id") == some).select(F.xxhash64("doc_id")).first()[0]
    want = sample_texts([rows[some]["text"]], np.array([key]), vocabulary(default_model(), 1.0), 2, 17)[0]
    assert {r["log_prob"] for r in out if r["doc_id"] == some} == {x[1] for x in want}

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out))


def test_empty_and_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "one two three", "en", "s", 13), (2, "one two three", "en", "s", 13)], docs.schema)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        ids[name] = sorted((r["doc_id"] for r in out.collect()), key=str)
        assert name == "pieces" or out.columns == odd.columns
    model = train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids["quality"] == ([1, 2, 2, None] if not model.rules else ids["quality"])
    # of the two empty texts the larger id stays, and one of the repeated rows
    assert ids["exact"] == ids["near"] == [1, 2]
    # texts without words are never taken; three words stand for all of source s, up to three times
    assert set(ids["mix"]) == {2} and 1 <= len(ids["mix"]) <= 6
    assert set(ids["pieces"]) == {1, 2, None}


CLASH = "id tie row digest text_ source kept keep_id words draw bucket ahead copies times score rules n __id __copies __words __score __kept label".split()


def _with_clashes(spark, rows):
    """Rows (doc_id, text, source) with many more columns, named as the operators' own."""
    names = [c for c in CLASH if c != "source"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, *(f"{c}{k % 2}" for c in names)) for k, r in enumerate(rows)], schema)


def test_rows_are_selected_by_row_whatever_the_columns(spark):
    from sparsewright.llm.exact_dedup import drop_exact_copies
    from sparsewright.llm.mixing import mixed_rows
    from sparsewright.llm.near_dedup import drop_near_copies
    from sparsewright.llm.quality import drop_poor

    rows = [(1, "a", "s"), (1, "a", "s"), (5, "x", "s"), (5, "y", "s"), (7, "Y", "t"), (None, None, None), (None, "", None), (8, "", "t")]
    docs = _with_clashes(spark, rows)
    for out in (drop_exact_copies(docs), drop_near_copies(docs)):
        assert out.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"], r["tie"][:3]) for r in drop_exact_copies(docs).collect())
    assert kept == [(1, "a", "tie"), (5, "x", "tie"), (7, "Y", "tie"), (8, "", "tie")]
    # an id with several texts is one document, compared by one of them: 5 by x or by y
    near = sorted((r["doc_id"], r["text"]) for r in drop_near_copies(docs).collect())
    assert near in ([(1, "a"), (5, "x"), (7, "Y"), (8, "")], [(1, "a"), (7, "Y"), (8, "")])

    words = [(i, " ".join(f"w{i}_{k}" for k in range(5 + i)), "ab"[i % 2]) for i in range(40)]
    words += words[:3] + [(3, "another text of id three", "b"), (None, "no id", "a"), (50, None, "a"), (51, "", None)]
    docs = _with_clashes(spark, words)
    drawn = mix(docs)
    total = Counter()
    for r in drawn.collect():
        total[(r["doc_id"], r["size"])] += r["copies"]
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], len(r["text"].split())) for r in out.collect()) == {k: n for k, n in total.items() if n}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert drop_poor(docs, none).columns == docs.columns and drop_poor(docs, none).count() == len(words)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = drop_poor(docs, labels)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_very_long_texts_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"word{k % 5000} and" for k in range(120_000))
    docs = docs.limit(30).unionByName(spark.createDataFrame([(10**6, long, "en", "x", len(long)), (10**6 + 1, long + " end", "en", "x", len(long) + 4), (10**6 + 2, long, "en", "x", len(long))], docs.schema))
    step = corpus_pipeline.checkpointed(corpus_pipeline.exact(spark, docs, str(tmp_path)))
    assert {r["doc_id"] for r in step.select("doc_id").collect() if r["doc_id"] >= 10**6} == {10**6 + 1, 10**6 + 2}
    step = corpus_pipeline.checkpointed(corpus_pipeline.near(spark, step, str(tmp_path)))
    assert [r["doc_id"] for r in step.select("doc_id").collect() if r["doc_id"] >= 10**6] == [10**6 + 1]
    scores = corpus_pipeline.quality(spark, step, str(tmp_path))
    assert scores.columns == docs.columns
    out = corpus_pipeline.pieces(spark, step.filter("doc_id >= 1000000"), str(tmp_path)).collect()
    assert len(out) == 2 and all(r["round_trip"] and r["n_pieces"] > 240_000 for r in out)
