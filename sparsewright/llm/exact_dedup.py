"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

1. Every text gets the SHA-256 of its normalised form (A-Z lower-cased, null counts as empty).  Only
   (id, digest) rows go on, written once to the shared checkpoint folder.
2. A Misra-Gries summary (Spark's ``freqItems``: counters that are decremented together, built per
   partition and merged) names at most `counters` digests; it misses none that holds more than
   1/`counters` of the rows.
3. A second, map-side combined count over the few candidates verifies them.  The winners, at most
   `counters` rows whatever the input, are broadcast: rows of hot digests are decided where they lie.
4. All other digests take an ordinary hash shuffle; no group there exceeds 1/`counters` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, ascii_lower, checkpointed, row_keys, rows_of

COUNTERS = 256


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text), 256)


def hot_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep, size) of the verified heavy hitters of `rows` (id, digest): at most `counters` rows."""
    total = rows.count()
    keyed = rows.select("id", "digest", F.xxhash64("digest").alias("key"))
    named = keyed.stat.freqItems(["key"], 1.0 / counters).select(F.explode("key_freqItems").alias("key"))
    counted = keyed.join(F.broadcast(named), "key").groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    return counted.filter((F.col("size") * counters >= total) & (F.col("size") > 1))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row, written once: all else reads these rows, not the texts."""
    return checkpointed(docs.select(F.col(id_col).alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest")))


def grouped(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Adds `keep_id`, the largest id of the rows (id, digest) of one digest, and their number `group_size`."""
    hot = checkpointed(hot_digests(rows, counters), slim=True)
    rest = rows.join(F.broadcast(hot), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    decided = rows.join(F.broadcast(hot), "digest").unionByName(rest.join(groups, "digest"))
    return decided.select("id", "digest", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs`: its id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Of equal texts the row with the largest id stays.  Null text equals the empty text.  Rows that
    repeat an id and its text share one decision.  A null id never beats another id; texts that only
    rows without an id hold have a null `keep_id`, and those rows stay.  An empty table gives an empty
    result.  Other columns of `docs` are not read, whatever their names.
    """
    return grouped(digests(docs, id_col, text_col), counters).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each text (A-Z lower-cased, null equals empty), with all its columns.

    It is the row with the largest id; where several rows have that id and text, the one with the smallest
    hash of all its columns.  Columns of any name may be there.
    """
    keyed = row_keys(docs, id_col, text_col)
    rows = checkpointed(keyed.select("id", F.unhex(text_digest(F.col("row")[text_col])).alias("digest"), "tie"))
    groups = grouped(rows.select("id", "digest"))
    kept = groups.filter("id = keep_id").select("id", "digest").distinct()
    return rows_of(keyed, rows.join(kept, ["id", "digest"], "left_semi").select("id", "tie"), ["id", "tie"])
