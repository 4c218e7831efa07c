"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases into longer ones, and so on.  Where a phrase ends
depends only on a few symbols around, so equal substrings are parsed alike but for their rims, whatever
stands before them.  One level:

1. Runs of one symbol become one symbol named by it and the run's length, so neighbours differ.
2. Deterministic coin tossing: a symbol's label is 2 i + b, where i is the lowest bit in which it differs
   from its left neighbour and b its own bit there.  Neighbouring labels differ again, and a few rounds
   leave fewer than eight labels.
3. A phrase starts at every label larger than both its neighbours' (and at a text's start).  With so few
   labels such a place comes every few symbols.
4. A phrase is named by a hash of its symbols' names: equal phrases have equal names everywhere.

A fingerprint is the `SIZE` smallest hashes of the set of phrase names of the levels from `FIRST_LEVEL` on
(and of the whole text where there is none).  The likeness of two fingerprints estimates the share of the
two sets' phrases that are common: 2 J / (1 + J), with J read from the smallest hashes of their union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .kernels import mix, release

SIZE, FIRST_LEVEL = 64, 2
SLICE = 3 << 20
_U = np.uint64


def _labels(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Coin tossing, `head`: places without a left neighbour."""
    rounds = {1: 3, 8: 4}[x.dtype.itemsize]
    for _ in range(rounds):
        diff = np.empty_like(x)
        diff[0] = 0
        np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
        diff[head] = 0
        low = diff & (~diff + x.dtype.type(1))
        bit = np.bitwise_count(low - x.dtype.type(1)).astype(np.uint8)  # the lowest bit's place
        own = ((x & low) != 0).view(np.uint8)
        x = bit * np.uint8(2) + own
        x[head] = own[head] = 0
        # a head's label may meet its right neighbour's: phrase starts there are forced anyway
    return x


def parse(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels 1, 2, ... of all texts: (row, name) of every phrase.  A text is parsed until it is one phrase."""
    rows = np.arange(len(offs) - 1)
    row = np.repeat(rows, np.diff(offs))
    symbol, levels = data, []
    while len(symbol):
        n = len(symbol)
        head = np.empty(n, bool)
        head[0] = True
        head[1:] = row[1:] != row[:-1]
        alone = head & np.append(head[1:], True)  # texts that are one symbol are done
        symbol, row, head, n = symbol[~alone], row[~alone], head[~alone], n - int(alone.sum())
        if not n:
            break
        run = head.copy()
        run[1:] |= symbol[1:] != symbol[:-1]
        at = np.flatnonzero(run)
        length = np.diff(np.append(at, n))
        base, row, head = symbol[at], row[at], head[at]
        name = mix(base.astype(_U) + _U(0x51ED270B7A1F4D1B) * length.astype(_U))
        label = _labels(base if base.dtype == np.uint8 else name, np.flatnonzero(head))
        start = head.copy()
        if len(label) > 2:
            start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~head[2:]
        # a phrase of one symbol at a text's start joins the next
        alone = np.flatnonzero(head[:-1] & start[1:] & ~head[1:]) + 1
        start[alone] = False
        at = np.flatnonzero(start)
        place = np.arange(len(name)) - np.repeat(at, np.diff(np.append(at, len(name))))
        folded = mix(name + mix(place.astype(_U) + _U(7)))
        symbol, row = mix(np.add.reduceat(folded, at)), row[at]
        levels.append((row, symbol))
    return levels


def fingerprints(texts: list[bytes], size: int = SIZE, first_level: int = FIRST_LEVEL) -> list[np.ndarray]:
    """Sorted smallest hashes of each text's phrases; of the whole text where it has no phrase so high."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    levels = parse(np.frombuffer(b"".join(texts), np.uint8), offs)[first_level - 1 :]
    row = np.concatenate([r for r, _ in levels] or [np.zeros(0, np.int64)])
    name = np.concatenate([mix(s + _U(k)) for k, (_, s) in enumerate(levels)] or [np.zeros(0, _U)])
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (name[1:] != name[:-1])) if len(row) else np.zeros(0, bool)
    row, name = row[keep], name[keep]
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for r, t in enumerate(texts):
        own = name[cut[r] : min(cut[r] + size, cut[r + 1])]
        out.append(own if len(own) else np.frombuffer(hashlib.sha256(t).digest()[:8], ">u8").astype(_U))
    return out


def to_text(print_: np.ndarray) -> str:
    return print_.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(_U)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common phrases of two sorted fingerprints, 0 to 1; 1 for equal ones."""
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    common = int(np.isin(both, union, assume_unique=True).sum())
    return 2.0 * common / (len(union) + common)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups by falling (group, order): each text is followed by the next document's.

    A row with `extra` is the first of the group that follows; it only ends its group.
    """
    before = None  # id, text, print, group of the document that waits for the next one's text

    def emit(waiting: list, following: list) -> pa.RecordBatch:
        edits = []
        for (_, text, _, _), (_, nxt, _, _) in zip(waiting, following, strict=True):
            half = len(text) // 2
            edits.append((text[: len(text) - half] + nxt[:half]).encode("utf-8", "surrogatepass"))
        prints = fingerprints(edits)
        columns = [
            [w[0] for w in waiting], [len(w[1]) for w in waiting], [hashlib.sha256(e).hexdigest() for e in edits], [to_text(w[2]) for w in waiting],
            [to_text(p) for p in prints], [likeness(w[2], p) for w, p in zip(waiting, prints, strict=True)], [likeness(w[2], f[2]) for w, f in zip(waiting, following, strict=True)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

    def work(rows: list, texts: list[str]) -> pa.RecordBatch:
        nonlocal before
        prints = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
        waiting, following = [], []
        for (group, id_, extra), text, own in zip(rows, texts, prints, strict=True):
            this = (id_, text, own, group)
            if before is not None and before[3] == group:
                waiting.append(before)
                following.append(this)
            before = None if extra else this
        return emit(waiting, following)

    for batch in batches:
        rows, texts, held = [], [], 0
        keys = list(zip(batch.column("group").to_pylist(), batch.column("id").to_pylist(), batch.column("extra").to_pylist(), strict=True))
        for key, text in zip(keys, batch.column("text"), strict=True):
            rows.append(key)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= SLICE:
                yield work(rows, texts)
                rows, texts, held = [], [], 0
        if rows:
            yield work(rows, texts)
    release()


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, `n_chars`, the digest of its edited text, both fingerprints, and the
    likeness of its fingerprint to the edited text's and to the next document's.

    Documents are in the order of falling id; after the last comes the first.  The edited text has its last
    floor(n / 2) code points replaced by the first as many of the next document's text, or all of it.  Null
    texts are empty.  Null ids come last; rows that repeat an id follow one another in the order of their
    texts' digests.  A single document is its own next one.  An empty table gives no rows.

    Neighbours meet without a global sort of the texts: the ids and digests alone are dealt into ranges, of
    which there are `groups` (by default four for each shuffle partition, so more for more data).  The first
    row of each range is a cut; the texts are dealt by the cuts into groups of neighbours, and a row that is
    a cut is also sent to the group before it.  Rows of one id can lie in several groups.
    """
    low, spark = -(1 << 63), docs.sparkSession
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.select(F.bitwise_not("id").alias("place"), F.sha2("text", 256).alias("tie"), "text")  # rises as the id falls
    ranges = named.select("place", "tie").repartitionByRange(groups or 4 * shuffle_partitions(spark), "place", "tie").withColumn("range", F.spark_partition_id())
    first = ranges.groupBy("range").agg(F.min(F.struct("place", "tie")).alias("f")).select("f.*").collect()  # a row per range
    cuts = sorted({(r["place"], r["tie"]) for r in first})
    if not cuts:
        return spark.createDataFrame([], _SCHEMA).withColumnRenamed("id", id_col)
    into = named.select("place", "tie", "text", F.explode(_groups(cuts)("place", "tie")).alias("group"))
    own = into.select(F.abs("group").alias("group"), F.bitwise_not("place").alias("id"), "place", "tie", "text", (F.col("group") < 0).alias("extra"))
    rows = own.repartition("group").sortWithinPartitions("group", "extra", "place", "tie")
    out = rows.select("group", "id", "extra", "text").mapInArrow(_edited, _SCHEMA)
    return out.withColumn("id", F.when(F.col("id") != low, F.col("id"))).withColumnRenamed("id", id_col)


def _groups(cuts: list[tuple[int, str]]):
    """The groups of a row: the number, from 1, of the last cut up to it, and for a cut the group before, negative."""
    places, ties = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts])

    @F.pandas_udf("array<long>")
    def found(place: pd.Series, tie: pd.Series) -> pd.Series:
        at = place.to_numpy()
        lo, hi = np.searchsorted(places, at, "left"), np.searchsorted(places, at, "right")
        group, cut = hi.copy(), np.zeros(len(at), bool)
        own = np.flatnonzero(hi > lo)  # ids that are some cut's: the digests decide
        for a, z in set(zip(lo[own].tolist(), hi[own].tolist(), strict=True)):
            mine = own[lo[own] == a]
            mine_tie = tie.to_numpy()[mine].astype(ties.dtype)
            group[mine] = a + np.searchsorted(ties[a:z], mine_tie, "right")
            cut[mine] = group[mine] > a + np.searchsorted(ties[a:z], mine_tie, "left")
        before = np.where(group > 1, group - 1, len(cuts))  # the first group's cut ends the last group
        return pd.Series([[g, -b] if c else [g] for g, b, c in zip(group.tolist(), before.tolist(), cut.tolist(), strict=True)])

    return found
