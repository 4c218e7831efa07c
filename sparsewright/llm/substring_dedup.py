"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at every word.  Only those whose first `DEPTH` words occur again matter, so:

1. Sampling that agrees with itself: every window of `DEPTH` words designates one of its runs of
   `ANCHOR` words, the one with the smallest name (the leftmost of equals).  Equal windows designate the
   same run at the same offset.  Names are counted per run; about one run in eight words takes part.
   Windows whose run occurs once cannot repeat and go no further.
2. Prefix partitioning: the other suffixes are grouped by that run, a prefix of the part of the suffix
   that leads the group.  One record holds all suffixes of one occurrence of a run.  A run with more than
   `GROUP` records is dealt into as many parts as make each of them fit.
3. In a task the suffixes of whole groups become a tree top-down: a node is split by its suffixes' next
   words, those alone in their node are leaves and leave.  Nodes that reach `DEPTH` words with two or
   more suffixes are the deep internal nodes: windows that occur again.  All but the first occurrence in
   each, by (id, position), are marked.
4. Of a run that was dealt into parts, what a part's trees did not mark (the first of each deep node, and
   the leaves) goes on with a longer prefix: the suffixes designate longer runs, and at last all their
   `DEPTH` words.  Again those whose prefix occurs once leave, the others are grouped and grown.  A
   prefix of full length is one node, of which each part leaves one suffix, so the rounds end when every
   group fits one part.

Whole texts that are exactly equal are handled before: only the copy with the smallest id enters; the
others repeat it from their first word to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_counted, shuffle_partitions
from .kernels import Words, binary_column, grams, mix, pieces, raw, release, slices, sliding_first_min, words

DEPTH, ANCHOR = 20, 6
#: Records in a group that one task takes; a record holds at most 15 suffixes.
GROUP = 2000
#: Stands for a null id: it comes before all others.
NO_ID = -(1 << 63)
_U = np.uint64


def windows(name: np.ndarray, row: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word where the designated run starts, its name) of every window inside a row."""
    n = len(name) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    run = grams(name, anchor)
    at = sliding_first_min(run, depth - anchor + 1)
    start = np.flatnonzero(row[:n] == row[depth - 1 :])
    return start, at[start], run[at[start]]


def _runs(depth: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(*raw(part.column("text")))
                _, at, name = windows(w.name, w.row, depth, anchor)
                new = np.diff(at, prepend=-1) != 0
                row, name = w.row[at[new]], name[new]
                order = np.lexsort((name, row))
                row, name = row[order], name[order]
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (name[1:] != name[:-1]))) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(row)))
                at = pa.array(row[head])
                yield pa.RecordBatch.from_arrays([pa.array(name[head].view(np.int64)), part.column("id").take(at), part.column("tie").take(at), pa.array(times)], ["run", "id", "tie", "times"])
        release()

    return run


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column; nulls count as empty."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.repeat(np.arange(len(column)), np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)), column.flatten().to_numpy(zero_copy_only=False)


_RECORD = "key long, salt int, salts int, id long, tie long, start long, lead long, content binary"
_NAMES = ["key", "salt", "salts", "id", "tie", "start", "lead", "content"]


def _suffixes(depth: int, anchor: int):
    """Records: the consecutive windows that designate one run, with the names of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(*raw(part.column("text")))
                start, at, name = windows(w.name, w.row, depth, anchor)
                new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(at)))
                s, a, key = start[new], at[new], name[new]
                row, value = _listed(part.column("runs"))
                parts = _listed(part.column("salts"))[1]
                asked = mix(value.astype(np.int64).view(_U) ^ mix(row.astype(_U)))
                order = np.argsort(asked)
                asked, parts = asked[order], parts[order]
                own = mix(key ^ mix(w.row[s].astype(_U)))
                place = np.minimum(np.searchsorted(asked, own), max(0, len(asked) - 1))
                mine = np.flatnonzero(asked[place] == own) if len(asked) else np.zeros(0, np.int64)
                s, a, key, salts, length = s[mine], a[mine], key[mine], parts[place[mine]] if len(asked) else np.zeros(0, np.int32), count[mine] + depth - 1
                yield _records(key, salts, part, w.row[s], s - w.first[w.row[s]], a - s, binary_column(pieces(w.name, s, length), length))
        release()

    return run


def _records(key: np.ndarray, salts: np.ndarray, part: pa.RecordBatch, row: np.ndarray, start: np.ndarray, lead: np.ndarray, content: pa.Array) -> pa.RecordBatch:
    ids, tie = (part.column(n).to_numpy(zero_copy_only=False)[row] for n in ("id", "tie"))
    salt = (mix(mix(ids.view(_U) ^ mix(tie.view(_U))) + start.astype(_U)) >> _U(1)).astype(np.int64) % np.maximum(salts, 1)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(ids), pa.array(tie), pa.array(start), pa.array(lead), content], _NAMES)


def deep_nodes(key: np.ndarray, ids: np.ndarray, tie: np.ndarray, start: np.ndarray, lead: np.ndarray, content: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Bit j of a record's result: the window that starts at its j-th word has an earlier equal.

    Grows the subtrees of all records' keys at once.  A root is (key, offset of the run in the window).
    """
    bits = np.zeros(len(key), np.int64)
    if not len(key):
        return bits
    _, content = np.unique(content, return_inverse=True)
    content = content.astype(_U)
    many = lengths - depth + 1
    base = np.cumsum(lengths) - lengths
    record = np.repeat(np.arange(len(key)), many)
    j = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
    where = base[record] + j
    node = np.unique(key, return_inverse=True)[1][record] * (depth + 1) + (lead[record] - j)
    for d in range(depth):
        edge = (node.astype(_U) << _U(32)) | content[where + d]
        order = np.argsort(edge, kind="stable")
        edge = edge[order]
        new = np.append(True, edge[1:] != edge[:-1]) if len(edge) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True) if len(edge) else new
        order, node = order[~alone], (np.cumsum(new) - 1)[~alone]
        record, j, where = record[order], j[order], where[order]
        if not len(record):
            return bits
    at = start[record] + j
    order = np.lexsort((at, tie[record], ids[record], node))
    node, record, j, at = node[order], record[order], j[order], at[order]
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    first = np.repeat(head, np.diff(np.append(head, len(node))))
    later = (ids[record] != ids[record[first]]) | (tie[record] != tie[record[first]]) | (at != at[first])
    np.bitwise_or.at(bits, record[later], np.left_shift(1, j[later]))
    return bits


_MARK = "id long, tie long, start long, bits long, open long, content binary"


def _subtrees(depth: int):
    """Batches come sorted by (key, salt); a group that a batch's end cuts waits for the rest of it.

    One row per record with something to tell: the windows that are marked, and, where the key has other
    parts, those that are still open, with the record's words.
    """

    def grow(table: pa.Table) -> pa.RecordBatch:
        data, offs = raw(table.column("content"))
        get = lambda n: table.column(n).to_numpy()
        lengths, salts = np.diff(offs) // 8, get("salts")
        key = mix(get("key").view(_U) + mix(get("salt").astype(_U)))
        bits = deep_nodes(key, get("id"), get("tie"), get("start"), get("lead"), np.frombuffer(data.tobytes(), _U), lengths, depth)
        open_ = np.where(salts > 1, (np.left_shift(1, lengths - depth + 1) - 1) & ~bits, 0)
        on = np.flatnonzero((bits != 0) | (open_ != 0))
        kept = np.where(open_[on] != 0, lengths[on], 0)
        content = binary_column(pieces(np.frombuffer(data.tobytes(), _U), offs[:-1][on] // 8, kept), kept)
        return pa.RecordBatch.from_arrays([*(pa.array(x[on]) for x in (get("id"), get("tie"), get("start"), bits, open_)), content], ["id", "tie", "start", "bits", "open", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, salts = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            cut += int(np.searchsorted(salts[cut:], salts[-1]))
            if cut or (held and (held[-1].column("key")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (keys[0], salts[0])):
                yield grow(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield grow(pa.Table.from_batches(held))
        release()

    return run


def _longer(depth: int, anchor: int):
    """The open windows of records as records of their own, by the longer runs that they designate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                data, offs = raw(part.column("content"))
                name, first = np.frombuffer(data.tobytes(), _U), offs // 8
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                start, at, key = windows(name, row, depth, anchor)
                j = start - first[row[start]]
                on = np.flatnonzero(part.column("open").to_numpy()[row[start]] >> j & 1 == 1)
                start, at, key, j = start[on], at[on], key[on], j[on]
                new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (np.diff(start) != 1))) if len(at) else np.zeros(0, np.int64)
                length = np.diff(np.append(new, len(at))) + depth - 1
                s, a, of = start[new], at[new], row[start[new]]
                content = binary_column(pieces(name, s, length), length)
                yield _records(key[new], np.ones(len(s), np.int32), part, of, part.column("start").to_numpy()[of] + j[new], a - s, content)

    return run


def _digest(depth: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = raw(part.column("text"))
                w = words(data, offs)
                change = np.zeros(len(w.name) + depth + 1, np.int32)
                row, start = _listed(part.column("starts"))
                _, bits = _listed(part.column("bits"))
                for j in range(depth):
                    at = w.first[row] + start + j
                    at = at[(bits >> j) & 1 == 1]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + depth, -1)
                gone = np.cumsum(change)[: len(w.name)] > 0
                counts = w.counts
                leads = part.column("lead").is_valid().to_numpy(zero_copy_only=False)
                gone |= (~leads & (counts >= depth))[w.row]
                removed = np.bincount(w.row[gone], minlength=part.num_rows)
                buffer, texts = data.tobytes(), []
                for r in range(part.num_rows):
                    here = buffer[offs[r] : offs[r + 1]].split()
                    if removed[r]:
                        here = compress(here, (~gone[w.first[r] : w.first[r + 1]]).tolist())
                    texts.append(b" ".join(here))
                columns = [part.column("id"), pa.array(counts), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array([t.decode() for t in texts])], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return run


def _grown(records: DataFrame, depth: int) -> DataFrame:
    n = shuffle_partitions(records.sparkSession)
    return checkpointed(records.repartition(n, "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_subtrees(depth), _MARK))


def _parts(n: Column, group: int) -> Column:
    return F.ceil(n / group).cast("int").alias("salts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, anchor: int = ANCHOR, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: id, `n_words`, `n_removed`, `kept_sha256`, and `kept_text` on demand.

    A word goes if a window of `depth` (at most 64) words covers it whose words also start earlier: in a
    text with a smaller id, or before in the same text.  Rows that repeat an id and its text are one text
    and share its result; different texts of one id are texts of their own, in the order of their hashes.
    A null id comes before all others; a null text is empty.  Texts shorter than `depth` words keep every
    word.  An empty table gives an empty result.  Other columns of `docs` are not read.
    """
    if group < 2:
        raise ValueError("a group holds two records at least: parts of one would leave all of them open")
    n, both = shuffle_partitions(docs.sparkSession), ["id", "tie"]
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.select("id", F.xxhash64("text").alias("tie"), "text")
    texts = named.repartition(n, *both)
    leads = named.select(*both, F.unhex(F.sha2("text", 256)).alias("h")).groupBy("h").agg(F.min(F.struct(*both)).alias("f"))
    leads = checkpointed(leads.select("f.*").distinct().withColumn("lead", F.lit(True)))
    single = texts.join(leads, both).select(*both, "text")

    runs = checkpointed(single.mapInArrow(_runs(depth, anchor), "run long, id long, tie long, times long"))
    total = checkpointed(runs.groupBy("run").agg(F.sum("times").alias("n")).filter("n > 1"))
    again = join_counted(runs.select("run", *both), total.select("run", "n", _parts(F.col("n"), group)), ["run"])
    wanted = again.groupBy(*both).agg(F.collect_list(F.struct("run", "salts")).alias("w")).select(*both, F.col("w.run").alias("runs"), F.col("w.salts").alias("salts"))
    records = single.join(wanted, both).select(*both, "text", "runs", "salts").mapInArrow(_suffixes(depth, anchor), _RECORD)
    marks, longer = [_grown(records, depth)], anchor
    while not (left := marks[-1].filter("open != 0")).isEmpty():
        longer = (longer + depth + 1) // 2 if len(marks) < 2 else depth
        found = checkpointed(left.mapInArrow(_longer(depth, longer), _RECORD).drop("salt", "salts"))
        counts = checkpointed(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "n", _parts(F.col("n"), group)))
        salt = F.pmod(F.xxhash64(*both, "start"), F.col("salts")).cast("int").alias("salt")
        marks.append(_grown(join_counted(found, counts, ["key"]).select("key", salt, "salts", *both, "start", "lead", "content"), depth))

    marked = reduce(DataFrame.unionByName, (m.filter("bits != 0").select(*both, "start", "bits") for m in marks))
    marked = marked.groupBy(*both).agg(F.collect_list(F.struct("start", "bits")).alias("m")).select(*both, F.col("m.start").alias("starts"), F.col("m.bits").alias("bits"))
    judged = texts.join(leads, both, "left").join(marked, both, "left").select("id", "text", "lead", "starts", "bits")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = judged.mapInArrow(_digest(depth, with_text), schema)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
