"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts are weighted sets of five-word shingles (A-Z lower-cased; a text of fewer words is one shingle).
A shingle that occurs n times in a text weighs 1 + ln(n) (`weighting` "log"): a line that a text repeats
counts for more, but does not drown the rest.  "counts" weighs by n, "set" by 1.  Likeness is the
probability Jaccard index of the weights, J(x, y) = sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i).

1. Equal texts are collapsed first, so copies cost one row each.
2. ProbMinHash: a shingle of weight w sends points of a Poisson process of rate w to the registers, each
   register at most once (in a seeded permutation of the registers, with the gaps of the order
   statistics of exponentials).  A register keeps the shingle whose point came first.  A shingle stops
   as soon as its next point lies behind every register's best: most stop after one or two points.  Two
   texts agree in a register with the probability that is their likeness.
3. Banding: `BANDS` bands of `ROWS` registers; a pair at 0.8 shares no bucket with probability
   2e-4, one at 0.85 with 1e-6.
4. Verification without all pairs: the leader of a bucket is compared, exactly, with its members.
   1 - likeness is a metric, so once members A within 0.2 of the leader are linked to it, only members B at
   distance d <= 0.4 can still be linked to such an A, and only to those at d - 0.2 or more; all else
   leaves the bucket, and a bucket that lies in one component by then is done.
   What is still open lies in groups where many texts are close to 0.8.  There 512 leaders of every bucket
   are compared with the members of other components, block against block: the shares of weight that two
   texts have in common come from an inverted index for all pairs of a block at once, and only links come
   out, no pairs.  Larger buckets go on with 2048 leaders, and so on.  A pair of a bucket is passed over only
   where it cannot be a link or is in one component already.
   Before that, texts that cannot be a link of any other leave the large buckets.  With a and b the shares of
   two texts' weights that lie on what both hold, J <= 1 / (1/a + 1/b - 1) (each summand is at most that of a
   positively homogeneous concave function, so their sum is at most its value at the sums).  So texts that
   reach `similarity` share a shingle among the first ones of each, up to where less than a share of
   `similarity` is left, in any order of shingles that all texts use.  With frequent shingles last, a text
   that has much of its own has only shingles of its own there, however many texts share the rest of it.
5. Links become classes by `components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, join_counted, row_keys, rows_of
from .components import components
from .exact_dedup import digests, grouped, text_digest
from .kernels import grams, mix, raw, release, slices, words

SHINGLE, SIMILARITY = 5, 0.8
#: Rounding that a test of likeness allows for.
SLACK = 1e-9
REGISTERS, BANDS, ROWS = 256, 36, 7
#: Members of one leader that one group of rows compares.
SALT_ROWS = 256
#: Leaders of a bucket in the first round of blocks, four times as many in each that follows; how many of them
#: a task holds, and how many members it compares with them.
LEADERS, BLOCK, MEMBERS = 512, 128, 1024
#: Shared shingles of a block's pairs that a task counts at once.
HITS = 1 << 20
#: The texts that tell frequent shingles (any choice gives the same links), and how many of these are told.
TELLERS, FREQUENT = 512, 1 << 16
WEIGHTING = "log"
_U = np.uint64


def weighted_shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle of each row and the end, distinct shingles sorted within rows, their counts)."""
    w = words(data, offs, lower=True)
    g = grams(w.name, size)
    whole = w.row[: len(g)] == w.row[size - 1 :] if len(g) else np.zeros(0, bool)
    row, g = w.row[: len(g)][whole], g[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        name = np.zeros(len(short), _U)
        for j in range(size - 1):
            has = w.counts[short] > j
            name[has] = mix(name[has] + w.name[w.first[short[has]] + j])
        row, g = np.append(row, short), np.append(g, name)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    counts = np.diff(np.append(head, len(g)))
    return np.searchsorted(row[head], np.arange(len(offs))), g[head], counts


def prob_minhash(first: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The shingle that each of `m` (a power of two) registers of each row keeps; rows without one keep 0."""
    rows = len(first) - 1
    best, kept = np.full(rows * m, np.inf), np.zeros(rows * m, _U)
    row = np.repeat(np.arange(rows), np.diff(first))
    seed = mix(shingle ^ _U(0x5851F42D4C957F2D))
    step = (seed >> _U(40)).astype(np.int64) | 1
    base = (seed >> _U(8)).astype(np.int64)
    scale, time, name = 1.0 / weight, np.zeros(len(row)), shingle
    for t in range(m):
        u = (mix(seed + _U((t + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53
        time = time - np.log1p(-u) * scale * (m / (m - t))
        slot = row * m + ((base + t * step) & (m - 1))
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        kept[slot[won]] = name[won]
        on = time < best.reshape(rows, m).max(axis=1)[row]
        if not on.any():
            break
        row, seed, step, base, scale, time, name = row[on], seed[on], step[on], base[on], scale[on], time[on], name[on]
    return kept.reshape(rows, m)


def likeness(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets, by sorting the weight ratios; of sets, the ratio of two counts."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(ia) / (len(a) + len(b) - len(ia))
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = float(wa.sum()) - np.cumsum(x)  # of a: all with a larger ratio, and what only a has
    below = float(wb.sum() - y.sum()) + np.cumsum(y)  # of b: all with no larger ratio, and what only b has
    return float(np.sum(1.0 / (above / x + below / y)))


def _weights(counts: np.ndarray, weighting: str) -> np.ndarray:
    if weighting not in ("log", "counts", "set"):
        raise ValueError("weighting is 'log', 'counts' or 'set'")
    return 1.0 + np.log(counts) if weighting == "log" else counts.astype(np.float64) if weighting == "counts" else np.ones(len(counts))


def _signatures(weighting: str):
    return lambda batches: _sign(batches, weighting)


def _sign(batches: Iterator[pa.RecordBatch], weighting: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            first, shingle, weight = weighted_shingles(*raw(part.column("text")))
            weight = _weights(weight, weighting)
            kept = prob_minhash(first, shingle, weight)
            keys = np.zeros((part.num_rows, BANDS), _U)
            for b in range(BANDS):
                key = np.full(part.num_rows, b + 1, _U)
                for r in range(ROWS):
                    key = mix(key ^ kept[:, b * ROWS + r])
                keys[:, b] = key
            has = np.diff(first) > 0
            offs = np.append(0, np.cumsum(has * BANDS)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[has].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), bands], ["id", "bands"])
    release()


def _comparing(weighting: str):
    return lambda batches: _compare(batches, weighting)


def _compare(batches: Iterator[pa.RecordBatch], weighting: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, salt, role): a leader's text comes before those of its members."""
    head, mine = None, None
    for batch in batches:
        for part in slices(batch, "text"):
            first, shingle, weight = weighted_shingles(*raw(part.column("text")))
            weight = _weights(weight, weighting)
            leader, salt, role, ids = (part.column(n).to_pylist() for n in ("leader", "salt", "role", "id"))
            out = []
            for r in range(part.num_rows):
                own = shingle[first[r] : first[r + 1]], weight[first[r] : first[r + 1]]
                if role[r] == 0:
                    head, mine = (leader[r], salt[r]), own
                elif head == (leader[r], salt[r]):
                    out.append((leader[r], ids[r], likeness(*mine, *own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["leader", "id", "likeness"])
    release()


def compare_with_leaders(pairs: DataFrame, texts: DataFrame, weighting: str = WEIGHTING) -> DataFrame:
    """pairs (leader, id), texts (id, text) -> (leader, id, likeness), exact, over whole texts.

    A leader's text is sent once for every `SALT_ROWS` members, not with each pair.
    """
    groups = checkpointed(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), slim=True)
    salts = groups.select("leader", F.ceil(F.col("n") / SALT_ROWS).alias("salts"), "n")
    salted = join_counted(pairs, salts, ["leader"])
    members = salted.select("leader", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), "id").join(texts, "id")
    heads = salts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("leader").alias("id"))
    rows = heads.join(texts, "id").unionByName(members)
    return rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role").mapInArrow(_comparing(weighting), "leader long, id long, likeness double")


def _index(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, share of the text's weight), sorted by shingle."""
    shingle = np.concatenate([s for s, _ in texts])
    own = np.repeat(np.arange(len(texts)), [len(s) for s, _ in texts])
    share = np.concatenate([w / w.sum() for _, w in texts])
    order = np.argsort(shingle, kind="stable")
    return shingle[order], own[order], share[order]


def _block(similarity: float, weighting: str):
    """Rows sorted by (key, block, part, role): the texts of a block of leaders, then the members' of a part.

    The shares that two texts have in common come from the leaders' inverted index, for all pairs at once;
    they bound the likeness.  Pairs within the bound are compared exactly.  Only links come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, index = None, [], None
        for batch in batches:
            for part in slices(batch, "text"):
                first, shingle, counts = weighted_shingles(*raw(part.column("text")))
                weight = _weights(counts, weighting)
                keys = np.column_stack([part.column(n).to_numpy() for n in ("key", "block", "part")])
                role, ids, component = (part.column(n).to_numpy() for n in ("role", "id", "component"))
                own = [(shingle[a:z], weight[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
                cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1) | (role[1:] != role[:-1])))
                leader, member = [], []
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), part.num_rows], strict=True):
                    if group != (here := tuple(keys[a].tolist())):
                        group, heads, index = here, [], None
                    if role[a] == 0:
                        heads += [(int(ids[r]), int(component[r]), *own[r]) for r in range(a, z)]
                        continue
                    if not heads:
                        continue
                    index = index or _index([h[2:] for h in heads])
                    for h, r in _within(heads, index, own[a:z], component[a:z], similarity):
                        leader.append(heads[h][0])
                        member.append(int(ids[a + r]))
                yield pa.RecordBatch.from_arrays([pa.array(leader, pa.int64()), pa.array(member, pa.int64())], ["leader", "id"])
        release()

    return run


def _within(heads: list, index: tuple, members: list, component: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(head, member) of the pairs of different components whose likeness is at least `similarity`."""
    shingle, text, share = index
    mine, of, own = _index(members)
    start = np.searchsorted(shingle, mine, "left")
    times = np.searchsorted(shingle, mine, "right") - start
    size = len(members) * len(heads)
    a, b = np.zeros(size), np.zeros(size)
    ends = np.cumsum(times)
    lo = 0
    while lo < len(times):  # HITS of the index at a time, however many members share a shingle with all heads
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - times[lo] + HITS, "right")))
        n = times[lo:hi]
        at = np.arange(int(n.sum())) + np.repeat(start[lo:hi] - (np.cumsum(n) - n), n)
        pair = np.repeat(of[lo:hi], n) * len(heads) + text[at]
        a += np.bincount(pair, share[at], size)
        b += np.bincount(pair, np.repeat(own[lo:hi], n), size)
        lo = hi
    apart = (component[:, None] != np.array([h[1] for h in heads])[None, :]).ravel()
    near = np.flatnonzero(apart & (a > 0))
    near = near[1 / a[near] + 1 / b[near] <= 1 + 1 / similarity + SLACK]
    out = []
    for p in near.tolist():
        m, h = divmod(p, len(heads))
        if likeness(*heads[h][2:], *members[m]) >= similarity - SLACK:
            out.append((h, m))
    return out


def compare_blocks(buckets: DataFrame, texts: DataFrame, leaders: int, similarity: float, weighting: str) -> tuple[DataFrame, DataFrame]:
    """buckets (key, id, component, n) -> links (leader, id) of `leaders` members of each bucket and its members
    of other components, and these leaders (key, id).  n: the bucket's size.

    Every member's text is sent once for each block of leaders, every leader's once for each part of members.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id"), "id"))
    some = buckets.withColumn("rank", rank).filter(F.col("rank") <= leaders)
    some = checkpointed(some.select("key", "id", "component", "n", F.floor((F.col("rank") - 1) / BLOCK).cast("int").alias("block")), slim=True)
    parts, blocks = F.ceil(F.col("n") / MEMBERS).cast("int"), F.ceil(F.least(F.col("n"), F.lit(leaders)) / BLOCK).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = buckets.select("key", upto(blocks).alias("block"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(1).alias("role"), "id", "component")
    heads = some.select("key", "block", upto(parts).alias("part"), F.lit(0).alias("role"), "id", "component")
    rows = heads.unionByName(members).join(texts, "id").select("key", "block", "part", "role", "id", "component", "text")
    dealt = rows.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "role")
    return checkpointed(dealt.mapInArrow(_block(similarity, weighting), "leader long, id long")), some.select("key", "id")


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            _, shingle, _ = weighted_shingles(*raw(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64))], ["key"])


def _prefixes(common: np.ndarray, times: np.ndarray, similarity: float, weighting: str):
    """Each text's prefix shingles; `common`, sorted, come last, by `times`.  (key, id, room): the share of
    the text's weight that lies on its shingles from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                first, shingle, counts = weighted_shingles(*raw(part.column("text")))
                at = np.minimum(np.searchsorted(common, shingle), max(0, len(common) - 1))
                rank = np.where(common[at] == shingle, times[at], 0) if len(common) else np.zeros(len(shingle), np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                order = np.lexsort((shingle, rank, row))
                sums = np.append(0.0, np.cumsum(_weights(counts, weighting)[order]))
                room = (sums[first[row + 1]] - sums[:-1]) / (sums[first[row + 1]] - sums[first[row]])
                on = room >= similarity - SLACK
                columns = [shingle[order][on].view(np.int64), part.column("id").to_numpy(zero_copy_only=False)[row[on]], room[on]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "id", "room"])
        release()

    return run


def prefix_buckets(texts: DataFrame, similarity: float, weighting: str = WEIGHTING) -> DataFrame:
    """(key, id): the shingles by which texts (id, text) of a likeness of `similarity` must meet, if shared.

    Texts meet at the first shingle that they share, so all that they share is in the `room` from there on.
    1 / room + 1 / room' is at most 1 + 1 / `similarity` then; a text whose room is too small even beside
    the largest one that has the shingle does not meet any there.
    """
    tellers = texts.orderBy(F.xxhash64("id"), "id").limit(TELLERS).select("text")
    counted = tellers.mapInArrow(_each_shingle, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    told = {r["key"] & (1 << 64) - 1: r["n"] for r in counted.orderBy(F.col("n").desc(), "key").limit(FREQUENT).collect()}
    common = np.array(sorted(told), _U)
    times = np.array([told[int(k)] for k in common], np.int64)
    met = checkpointed(texts.select("id", "text").mapInArrow(_prefixes(common, times, similarity, weighting), "key long, id long, room double"))
    most = checkpointed(met.groupBy("key").agg(F.max("room").alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1"), slim=True)
    return join_counted(met, most, ["key"]).filter(1 / F.col("room") + 1 / F.col("most") <= 1 + 1 / similarity + SLACK).select("key", "id")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, id) -> (key, id, component, n) of the buckets, of n members, with more than one component."""
    named = checkpointed(members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), slim=True)
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    several = checkpointed(several.select("key", "n", F.col("n").alias("members")), slim=True)
    return checkpointed(join_counted(named, several, ["key"]).withColumnRenamed("members", "n"), slim=True)


def linked(buckets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, weighting: str = WEIGHTING) -> DataFrame:
    """buckets (key, id), those with several ids; texts (id, text) of these ids -> (id, component).

    Every pair of a bucket whose likeness is at least `similarity` is in one component, ids without a link
    are in none.
    """
    reach = 1.0 - similarity
    order = F.xxhash64("id")  # alike in all buckets, so that they share leaders and with them pairs
    alike = F.col("likeness") >= similarity - SLACK
    pair = (F.col("leader").alias("a"), F.col("id").alias("b"))

    led = checkpointed(buckets.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id"))["id"].alias("leader"), F.count(F.lit(1)).alias("n")), slim=True)
    tried = checkpointed(join_counted(buckets, led, ["key"]).filter("id != leader"), slim=True)
    judged = checkpointed(compare_with_leaders(tried.select("leader", "id").distinct(), texts, weighting))
    found = judged.filter(alike).select(*pair)
    far = tried.join(judged, ["leader", "id"]).withColumn("d", 1.0 - F.col("likeness"))
    edge = checkpointed(far.groupBy("key").agg(F.min(F.when(~alike, F.col("d"))).alias("edge"), F.count(F.lit(1)).alias("n")).filter("edge is not null"), slim=True)
    left = join_counted(far.select("key", "id", "likeness", "d"), edge, ["key"])
    left = left.filter(~alike | (F.col("d") >= F.col("edge") - reach - SLACK)).select("key", "id")
    labels = checkpointed(components(found), slim=True)
    leaders, filtered, buckets = LEADERS, False, _open(left, labels)
    while not buckets.isEmpty():
        fresh, done = compare_blocks(buckets, texts, leaders, similarity, weighting)
        if not fresh.isEmpty():
            labels = checkpointed(components(fresh.select(*pair).union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))), slim=True)
        leaders, buckets = 4 * leaders, _open(buckets.select("key", "id").join(done, ["key", "id"], "left_anti"), labels)
        if not filtered and not buckets.isEmpty():
            some = checkpointed(texts.join(buckets.select("id").distinct(), "id"))
            able = checkpointed(prefix_buckets(some, similarity, weighting).select("id").distinct(), slim=True)
            filtered, buckets = True, _open(buckets.select("key", "id").join(able, "id"), labels)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weighting: str = WEIGHTING) -> DataFrame:
    """One row per row of `docs`: its id, `class_id` and `kept`; a class keeps the document that names it.

    Equal texts (A-Z lower-cased) share a class, and so do texts of a likeness of at least `similarity`,
    directly or by way of others.  Null texts are empty; empty texts equal each other and nothing else.
    A text without words is near only its equals.  Rows that share an id are one document, kept or dropped
    together; of different texts of an id the one with the smallest digest is compared.  Null ids count as
    one id.  An empty table gives no rows.
    """
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes, rows, single = _classes(named, similarity, weighting)
    if single:
        out = classes
    else:  # an id may hold any part of the rows
        sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        out = join_counted(rows.select("id"), checkpointed(classes.distinct().join(sizes, "id")), ["id"])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("id").alias(id_col), real("class_id").alias("class_id"), (F.col("id") == F.col("class_id")).alias("kept"))


def _classes(named: DataFrame, similarity: float, weighting: str) -> tuple[DataFrame, DataFrame, bool]:
    """named (id, text) -> (id, class_id) of every row, the rows' digests, and whether no id has several texts."""
    rows = digests(named, "id", "text")
    odd = checkpointed(rows.groupBy("id").agg(F.min("digest").alias("chosen"), F.max("digest").alias("other")).filter("chosen < other").select("id", "chosen"), slim=True)
    single = odd.isEmpty()
    if not single:
        keep = F.col("chosen").isNull() | (F.col("chosen") == F.col("digest"))
        counted = checkpointed(rows.join(odd, "id", "left").filter(keep).drop("chosen"))
        named = named.join(odd, "id", "left").withColumn("digest", F.unhex(text_digest(F.col("text")))).filter(keep).select("id", "text")
    copies = checkpointed(grouped(rows if single else counted).select("id", "keep_id", "group_size"), slim=True)
    leads = checkpointed(copies.filter("id = keep_id").groupBy(F.col("id").alias("keep_id")).agg(F.max("group_size").alias("n")), slim=True)
    first = leads.select(F.col("keep_id").alias("id"))
    marks = named.mapInArrow(_signatures(weighting), "id long, bands array<long>").join(first, "id", "left_semi").dropDuplicates(["id"])
    banded = checkpointed(marks.select("id", F.explode("bands").alias("key")), slim=True)
    shared = checkpointed(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), slim=True)
    buckets = checkpointed(join_counted(banded, shared, ["key"]), slim=True)
    if buckets.isEmpty():
        return copies.select("id", F.col("keep_id").alias("class_id")), rows, single
    texts = checkpointed(named.join(buckets.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))
    labels = linked(buckets, texts, similarity, weighting)
    labels = checkpointed(labels.select(F.col("id").alias("keep_id"), "component").join(leads, "keep_id"), slim=True)
    named_by = join_counted(copies.select("id", "keep_id"), labels, ["keep_id"], "left")
    return named_by.select("id", F.coalesce("component", "keep_id").alias("class_id")), rows, single


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weighting: str = WEIGHTING) -> DataFrame:
    """One row of `docs` for each class of `near_duplicates`, with all its columns.

    It is a row of the document that names the class.  Where several rows have its id, one whose text is the
    one compared stays (of these the one with the smallest hash of all its columns).  Rows are told apart by
    id and text, so columns of any name may be there.
    """
    keyed = row_keys(docs, id_col, text_col)
    rows = keyed.select("id", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"))
    classes, every, _ = _classes(rows, similarity, weighting)
    chosen = checkpointed(classes.filter("id = class_id").select("id").distinct())
    return rows_of(keyed, every.select("id").join(chosen, "id", "left_semi"), ["id"], smallest_digest=text_col)
