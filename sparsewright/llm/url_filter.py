"""URL rules tested by a Bloom filter cascade, in DataFrame operations only and without joins.

A rule is (verdict, host, path prefix).  A url has few keys that a rule could equal: the last 1..n
labels of its host, joined with the prefixes of its path whose lengths occur among the rules.  The set
of all such keys of the corpus is the universe U.

For a listed set R, level 1 is a Bloom filter of R.  The keys of U that pass it though not in R are
encoded in level 2, the members of R that pass level 2 in level 3, and so on until a level makes no
mistake.  A key is listed if the first level that rejects it is an even one.  This is exact over U.

Size: level 1 gets a false positive rate of |R| / (sqrt(2) |U|), so the mistakes number about |R| / sqrt(2)
whatever U is, and each later level a rate of 1/2.  All levels together take about |R| 1.44 log2(2 |U|/|R|)
bits, which go into the plan as literals; `MAX_LISTED` bounds |R|.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Bits that a byte of a level's literal holds: seven, so that every byte is an ASCII character.
BITS = 7
MAX_LISTED = 100_000
#: The rules of the query: verdict, host, path prefix.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The keys of a url that some rule could equal, longest first."""
    labels = range(1, 1 + max((h.count(".") + 1 for _, h, _ in rules), default=0))
    lengths = sorted({len(p) for _, _, p in rules})
    keys = [F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n))) for k in labels for n in lengths]
    if not keys:
        return F.array().cast("array<string>")
    found = F.array_distinct(F.array_compact(F.array(*keys)))
    return F.array_sort(found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))


class Level:
    """One Bloom filter: `bits` set positions among `size`, tested by `hashes` seeded hashes."""

    def __init__(self, number: int, count: int, rate: float):
        self.number = number
        self.size = max(8, math.ceil(count * math.log(1 / rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(count, 1) * math.log(2)))
        self.bits = b""

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number), F.lit(i), key), F.lit(self.size)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """`keys`: one column, key.  Collects set positions: at most `hashes` for each encoded key."""
        taken = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("p")).distinct().collect()
        held = bytearray(self.size // BITS + 1)
        for (p,) in taken:
            held[p // BITS] |= 1 << p % BITS
        self.bits = bytes(held)
        return self

    def has(self, key: Column) -> Column:
        bits, test = F.lit(self.bits), F.lit(True)
        for p in self.positions(key):
            byte = F.ascii(F.substring(bits, F.floor(p / BITS).cast("int") + 1, F.lit(1)).cast("string"))
            test = test & (F.getbit(byte, F.pmod(p, F.lit(BITS)).cast("int")) == 1)
        return test


def _listed(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")).alias("key"))


def cascade(universe: DataFrame, listed: Sequence[str]) -> list[Level]:
    """The levels that tell `listed` from every other key of `universe` (one column, key; repeats allowed).

    An empty list has no level; an empty universe has one.  Null keys are in no set.  At most four mistakes
    for each listed key, and a thousand, come to the driver.
    """
    listed = sorted(set(listed))
    if len(listed) > MAX_LISTED:
        raise ValueError(f"at most {MAX_LISTED} listed keys")
    if not listed:
        return []
    spark = universe.sparkSession
    seen = universe.select(F.approx_count_distinct("key")).first()[0]
    rate, most = min(0.5, len(listed) / (math.sqrt(2) * max(1, seen))), 4 * len(listed) + 1000
    while True:  # `seen` is an estimate: a level that lets too many pass is built again, with fewer mistakes
        levels = [Level(1, len(listed), rate).fill(_listed(spark, listed))]
        mistaken = universe.filter(~F.col("key").isin(*listed) & levels[0].has(F.col("key"))).distinct()
        wrong = [r[0] for r in mistaken.limit(most + 1).collect()]
        if len(wrong) <= most:
            break
        rate /= 8
    inside, others = listed, wrong
    while others:
        levels.append(level := Level(len(levels) + 1, len(others), 0.5).fill(_listed(spark, others)))
        inside, others = others, [r[0] for r in _listed(spark, inside).filter(level.has(F.col("key"))).collect()]
    return levels


def in_cascade(levels: Sequence[Level]) -> Callable[[Column], Column]:
    """A test of a key column against the cascade."""

    def test(key: Column) -> Column:
        found = F.lit(False)
        for level in reversed(levels):
            found = level.has(key) & ~found
        return found

    return test


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """The `keep` columns of every row with `host`, `path`, `rule` and `verdict`.

    The longest fitting rule decides; where an allow and a block rule are equal, block wins.  Without a
    rule `rule` is null and the verdict is `default`: the url is on no list.  A null url, or one without
    ``://``, has empty host and path.  Repeated rows are judged alike; an empty table gives no rows.
    """
    split = pages.select(*keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    keyed = split.withColumn("__keys", rule_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("__keys").alias("key"))
    first = {}
    for kind in ("block", "allow"):
        levels = cascade(universe, [h + p for k, h, p in rules if k == kind])
        first[kind] = F.try_element_at(F.filter("__keys", in_cascade(levels)), F.lit(1))
    judged = keyed.withColumn("__block", first["block"]).withColumn("__allow", first["allow"])
    blocked = F.col("__block").isNotNull() & (F.col("__allow").isNull() | (F.length("__block") >= F.length("__allow")))
    return judged.select(
        *keep, "host", "path",
        F.when(blocked, F.col("__block")).otherwise(F.col("__allow")).alias("rule"),
        F.when(blocked, F.lit("block")).when(F.col("__allow").isNotNull(), F.lit("allow")).otherwise(F.lit(default)).alias("verdict"),
    )
