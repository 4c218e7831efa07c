"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sizes are words.  A source's target is its weight's share of all sizes; no target exceeds `max_epochs`
times its source's size, and what is cut off goes to the others by weight.  That process ends where
target = min(cap, level * weight): with the sources ordered by cap / weight, a prefix is clamped, and the
level is what the prefix leaves, over the other weights.  One window over the (few) source totals finds it.

A source's target / size is a number of epochs: every document is taken that many whole times, and a
seeded part of the documents once more.  That part is a prefix of the documents in the order of a hash,
up to the word where the fraction ends; the document across that word is taken if most of it lies
before it.  Prefix sums are taken per (source, hash bucket), so that a source with a third of all rows is
spread over `BUCKETS` groups; only bucket totals meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, row_keys

SEED = "mix-1"
BUCKETS = 1024
MAX_EPOCHS = 3
#: The weights that sources take in turn, in the order of their names by code point, null last.
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`totals`: one row per source (src, missing, size).  Adds weight and target.

    Its windows are over one row per source, after the rows have been summed.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy("missing", "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    cap = F.col("size") * max_epochs
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(cap / F.col("weight"), "missing", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    marked = totals.withColumn("weight", weight).withColumn("left", left).withColumn("open", open_weight)
    # clamped while the level that the sources before leave, left / open, is above cap / weight
    marked = marked.withColumn("clamped", F.col("left") * F.col("weight") > cap * F.col("open"))
    level = F.min(F.when(~F.col("clamped"), F.struct((cap / F.col("weight")).alias("at"), "missing", "src", "left", "open"))).over(every)
    target = F.when(F.col("clamped"), cap.cast("double")).otherwise((F.col("weight") * level["left"]).cast("double") / level["open"])
    return marked.withColumn("target", target).select("src", "missing", "size", "weight", "target")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: its id, `size`, `source_size`, `target`, `taken` (words) and `copies`.

    The same input and seed give the same result.  A null source is a source of its own, the last; a
    null or empty text has size 0 and is never taken.  Rows that repeat an id are separate documents.
    A null id takes part with a hash of its own.  An empty table, or one without words, takes nothing.
    The columns `also` are kept; where rows have one id and size they decide the order.
    """
    named = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("missing"),
        n_words(F.col(text_col)).alias("words"),
        F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12).alias("draw"),
        *also,
    )
    keys = ("src", "missing", "bucket")
    # one exchange serves both the bucket totals and the running sums
    rows = named.withColumn("bucket", F.pmod(F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"), F.lit(BUCKETS))).repartition(*keys)
    buckets = rows.groupBy(*keys).agg(F.sum("words").alias("held"))
    sources = Window.partitionBy("src", "missing")
    before = F.coalesce(F.sum("held").over(sources.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("before", before)
    plan = targets(buckets.groupBy("src", "missing").agg(F.sum("held").alias("size")), weights, max_epochs)
    plan = plan.withColumnRenamed("size", "source_size").drop("weight")
    offsets = buckets.drop("held").join(plan, ["src", "missing"])
    within = Window.partitionBy(*keys).orderBy("draw", "id", "words", *also).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("words").over(within), F.lit(0))).join(offsets, list(keys))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs)
    part = (F.col("target") - whole * F.col("source_size"))
    extra = (F.col("before") + F.col("ahead") + F.col("words") / F.lit(2.0) < part).cast("long")
    copies = F.when(F.col("words") > 0, whole + extra).otherwise(F.lit(0)).cast("long")
    return placed.select(
        F.col("id").alias(id_col), F.col("words").alias("size"), "source_size", "target",
        (copies * F.col("words")).alias("taken"), copies.alias("copies"), *also,
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as often as `mix` takes it, with all their columns.

    Rows that `mix` takes 0 times are those that the weights leave out.  Rows are told apart by id, text and
    source: of rows that agree in these, the one with the smallest hash of all its columns stands for all.
    Columns of any name may be there.
    """
    keyed = row_keys(docs, id_col, text_col, text_col, source_col)
    rows = keyed.select("id", "tie", F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"))
    drawn = rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "tie", "text", "source")
    taken = mix(drawn, id_col="id", text_col="text", source_col="source", also=("tie",), **options)
    taken = taken.groupBy(F.coalesce("id", F.lit(NO_ID)).alias("id"), "tie").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("times"))
    taken = checkpointed(taken.filter("copies > 0"))
    out = keyed.join(taken.filter("times = 1").hint("merge"), ["id", "tie"]).select("row", "copies")  # as many as rows that stay
    if not (several := taken.filter("times > 1")).isEmpty():
        first = keyed.join(several, ["id", "tie"]).groupBy("id", "tie").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("copies").alias("copies"))
        out = out.unionByName(first.select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
