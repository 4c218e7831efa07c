import os
import random
import subprocess
import sys

import pytest
from brute import repeats_removed
from pyspark.sql import functions as F

from sparsewright.llm.substring_dedup import remove_repeats


def _check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, row int").repartition(3)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs, **options).collect()}
    assert found == repeats_removed([r[:2] for r in rows], options.get("depth", 20))


def test_equals_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs).collect()}
    assert found == repeats_removed([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_equals_brute_force_when_every_group_is_dealt_into_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs, group=2).collect()}
    assert found == repeats_removed([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_it_can_be_the_first_call_of_a_session(tmp_path):
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from sparsewright.llm.substring_dedup import remove_repeats
text = " ".join(f"b{k}" for k in range(25))
print(sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")).collect()))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "[(1, 0), (2, 25)]", done.stderr[-2000:]


def test_texts_of_one_id_are_texts_of_their_own(spark):
    a, b = " ".join(f"b{k}" for k in range(25)), " ".join(f"c{k}" for k in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (1, "new " + a), (2, b), (2, a + " end")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect())
    # of id 1 the text whose hash is smaller keeps the words that both have
    assert got in ([(1, 25, 0), (1, 26, 25), (1, 30, 0), (2, 26, 25), (2, 30, 30)], [(1, 25, 25), (1, 26, 0), (1, 30, 0), (2, 26, 25), (2, 30, 30)])


def test_hot_groups_go_on_with_longer_prefixes(spark):
    r = random.Random(3)
    shared = [f"s{k}" for k in range(30)]
    rows = []
    for i in range(60):
        own = [f"w{r.randrange(40)}" for _ in range(r.randrange(50))]
        cut = r.randrange(len(own) + 1)
        rows.append((i * 3 % 61, " ".join(own[:cut] + shared + own[cut:]), "x", 1))
    _check(spark, rows, group=8)
    _check(spark, rows, group=2)
    with pytest.raises(ValueError):
        _check(spark, rows, group=1)
    _check(spark, rows, group=3, depth=9, anchor=3)


def test_nulls_empty_texts_copies_and_runs_of_one_word(spark):
    long = " ".join(f"a{k % 7}" for k in range(3000))
    rows = [(None, "x " * 30, "c", 1), (1, None, "c", 1), (2, "", None, None), (3, "x " * 45, "c", 1), (4, long, "c", 1), (5, long, "c", 2), (6, "\t\n " + long + " end", "c", 3), (-7, "y " * 19, "d", 0), (8, "é " * 25, "d", 0)]
    _check(spark, rows)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"b{k}" for k in range(25))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 25)]
    assert remove_repeats(docs.filter(F.lit(False))).count() == 0
