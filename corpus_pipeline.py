"""From raw documents to sampled token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next stage gets as docs, written
and read again.  All but the last return the columns of documents:

1. quality: documents that the classifier rejects go (learnt from the labels in sf_dir).
2. exact: of equal texts, the document with the largest id stays.
3. near: one document of each class of near duplicates stays.
4. mix: documents are repeated or left out so that the sources' words come near their target weights.
5. pieces: every remaining row's sampled segmentations (a document that the mix repeats has its rows
   repeated).

Null and empty texts, repeated rows, ties and empty tables have the results that the operators state; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsewright.llm.common import checkpointed, table
from sparsewright.llm.exact_dedup import drop_exact_copies
from sparsewright.llm.mixing import mixed_rows
from sparsewright.llm.near_dedup import drop_near_copies
from sparsewright.llm.quality import drop_poor
from sparsewright.llm.segmentation import sample_segmentations


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_poor(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_segmentations(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pieces", pieces)]

#: The classifier and the samples are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
