"""Synthetic low-rank data: degree distributions, popular columns drawn without replacement, noisy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dot, md5_unit, power_law
from .checkpoint import cut
from .matrix import offsets


#: Draws of a number that has to lie in a range.
TURNS = 64


def unit(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the seed and keys only, not on partitions or retries.

    `md5_unit` has the same property and is used for degrees, which are few: any SQL engine can follow it.
    """
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.ln(unit(seed, F.lit(1), *keys))) * F.cos(2 * 3.141592653589793 * unit(seed, F.lit(2), *keys))


def row_degree_frequencies(spark: SparkSession, ncols: int, seed: int = 12345) -> DataFrame:
    """(degree, freq), degree 0..ncols: freq is a whole number of N(20, 5), drawn again until it is in [0, ncols)."""
    u = lambda which, turn: md5_unit(F.lit(str(seed)), F.lit(which), F.col("id").cast("string"), turn.cast("string"))
    draw = lambda turn: (20 + 5 * F.sqrt(-2 * F.ln(1 - u("a", turn))) * F.cos(2 * 3.141592653589793 * u("b", turn))).cast("long")
    return _drawn(spark, ncols, draw, lambda x: (x >= 0) & (x < ncols), 20)


def _drawn(spark: SparkSession, top: int, draw, fits, default: int) -> DataFrame:
    """(degree, freq) for 0..top: the first of `TURNS` draws that fits, else the allowed number next to `default`."""
    some = F.filter(F.transform(F.sequence(F.lit(0), F.lit(TURNS - 1)), draw), fits)
    freq = F.coalesce(F.try_element_at(some, F.lit(1)), F.lit(max(0, min(default, top - 1))).cast("long"))
    return spark.range(top + 1).select(F.col("id").alias("degree"), freq.alias("freq"))


def col_degree_frequencies(spark: SparkSession, nrows: int, seed: int = 12345) -> DataFrame:
    """(degree, freq), degree 0..nrows: freq is a whole number of the power law (1, 2.2), drawn again until it is at most nrows."""
    draw = lambda turn: power_law(md5_unit(F.lit(str(seed)), F.lit("c"), F.col("id").cast("string"), turn.cast("string")), 1.0, 2.2).cast("long")
    return _drawn(spark, nrows, draw, lambda x: x <= nrows, 1)


def sample_degrees(freq: DataFrame, n: int, seed: int, width: int = 1024) -> DataFrame:
    """(id, degree) for ids 0..n-1, degrees drawn by their frequencies.

    The range join on cumulative weights goes by buckets of `width` weight units, an equi-join.
    """
    cum = offsets(freq.filter("freq > 0"), "degree", "freq")
    total = cum.agg(F.max(F.col("offset") + F.col("freq"))).first()[0] or 0
    if not total:
        return freq.sparkSession.range(n).select("id", F.lit(0).cast("long").alias("degree"))
    spans = cum.select("degree", "freq", "offset", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("freq") - 1) / width))).alias("b"))
    draws = freq.sparkSession.range(n).withColumn("x", F.floor(md5_unit(F.lit(str(seed)), F.col("id").cast("string")) * total)).withColumn("b", F.floor(F.col("x") / width))
    hit = (F.col("x") >= F.col("offset")) & (F.col("x") < F.col("offset") + F.col("freq"))
    return draws.join(spans, "b").filter(hit).select("id", "degree")


def sample_cells(rows: DataFrame, popularity: DataFrame, seed: int) -> DataFrame:
    """rows (row, degree), popularity (col, weight): each row's `degree` columns drawn without replacement.

    Successive sampling: draws with replacement by weight, by a bucketed lookup, of which repeats go and the
    first `degree` distinct ones stay.  Rows that fall short draw on, twice as often each round, until their
    draws outnumber the columns.  What a row then lacks comes from its columns not drawn yet, those with the
    smallest -ln(u) / weight, which continues the same sampling.  A row has min(degree, columns of positive
    weight) cells.
    """
    weights = popularity.select(F.col("col").alias("degree"), F.col("weight").cast("long").alias("freq"))
    cum = offsets(weights.filter("freq > 0"), "degree", "freq")
    total, columns = cum.agg(F.max(F.col("offset") + F.col("freq")), F.count(F.lit(1))).first()
    if not total:
        return rows.select("row", F.lit(0).cast("long").alias("col")).limit(0)
    width = max(1, total // 4096)
    spans = cum.select(F.col("degree").alias("col"), "freq", "offset", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("freq") - 1) / width))).alias("b"))
    hit = (F.col("x") >= F.col("offset")) & (F.col("x") < F.col("offset") + F.col("freq"))
    wanted = rows.select("row", F.least(F.col("degree").cast("long"), F.lit(columns)).alias("degree")).filter("degree > 0")
    open_, found, done, start, end = wanted, None, [], F.lit(0).cast("long"), F.col("degree") * 4 + 8
    while True:
        many = open_.select("row", "degree", F.explode(F.sequence(start, end)).alias("turn"))
        draws = many.withColumn("x", F.floor(unit(seed, F.col("row"), F.col("turn")) * total)).withColumn("b", F.floor(F.col("x") / width))
        drawn = draws.join(spans, "b").filter(hit).select("row", "col", "degree", "turn")
        every = drawn if found is None else found.unionByName(drawn)
        distinct = every.groupBy("row", "col", "degree").agg(F.min("turn").alias("turn"))
        sets = cut(distinct.groupBy("row", "degree").agg(F.sort_array(F.collect_list(F.struct("turn", "col"))).alias("c")))
        done.append(sets.filter(F.size("c") >= F.col("degree")).select("row", F.explode(F.slice("c", 1, F.col("degree").cast("int"))).alias("c")).select("row", F.col("c.col").alias("col")))
        short = sets.filter(F.size("c") < F.col("degree"))
        found = short.select("row", "degree", F.explode("c").alias("c")).select("row", F.col("c.col").alias("col"), "degree", F.col("c.turn").alias("turn"))
        turns = short.agg(F.max("degree")).first()[0]
        if turns is None:
            break
        start, end = end + 1, end * 2
        if (turns * 4 + 8) * 2 ** len(done) > columns:
            lacking = short.select("row", (F.col("degree") - F.size("c")).alias("lacks"), F.transform("c", lambda x: x["col"]).alias("has"))
            key = -F.ln(unit(seed, F.lit(-1), F.col("row"), F.col("col"))) / F.col("freq")
            rest = lacking.crossJoin(weights.filter("freq > 0").select(F.col("degree").alias("col"), "freq")).filter(~F.array_contains("has", F.col("col")))
            place = F.row_number().over(Window.partitionBy("row").orderBy(key, "col"))
            done += [found.select("row", "col"), rest.withColumn("place", place).filter("place <= lacks").select("row", "col")]
            break
        open_ = short.select("row", "degree")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def row_sizes(spark: SparkSession, nrows: int, ncols: int, seed: int = 12345) -> DataFrame:
    """(row, degree, train, test): the drawn degree of each row and the cells that it gets."""
    drawn = sample_degrees(row_degree_frequencies(spark, ncols, seed), nrows, seed + 1).select(F.col("id").alias("row"), "degree")
    cells = F.least(F.floor(F.col("degree") * 5 / 4), F.lit(ncols))
    return drawn.withColumn("train", F.floor(cells * 0.8)).withColumn("test", cells - F.floor(cells * 0.8))


def product(dim: int, seed: int = 12345) -> Column:
    """<w, h> of a cell's row and column, whose factors are N(0, 1)."""
    vec = lambda key, s: F.array(*(normal(s, F.col(key), F.lit(t)) for t in range(dim)))
    return dot(vec("row", seed + 5), vec("col", seed + 6))


def generate(spark: SparkSession, nrows: int, ncols: int, dim: int = 20, seed: int = 12345, noise: float = 0.1) -> DataFrame:
    """(row, col, value, test): training and test cells drawn independently, values <w, h> + noise N(0, 1).

    A row of drawn degree d has m = min(5 d div 4, ncols) cells, of these floor(0.8 m) for training and the
    rest for the test; a cell may be in both.
    """
    degree = row_sizes(spark, nrows, ncols, seed)
    popular = sample_degrees(col_degree_frequencies(spark, nrows, seed), ncols, seed + 2).select(F.col("id").alias("col"), (F.col("degree") + 1).alias("weight"))
    parts = []
    for test, d in ((False, "train"), (True, "test")):
        parts.append(sample_cells(degree.select("row", F.col(d).alias("degree")), popular, seed + 3 + test).withColumn("test", F.lit(test)))
    cells = parts[0].unionByName(parts[1])
    value = product(dim, seed) + noise * normal(seed + 7, F.col("row"), F.col("col"), F.col("test"))
    return cells.withColumn("value", value).select("row", "col", "value", "test")
