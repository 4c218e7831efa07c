"""Column expressions: vectors, step sizes, parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaled_round(x: Column, places: int) -> Column:
    """`x` times a power of ten to the nearest whole number, halves away from zero, and back, all in doubles.

    SQL engines that keep doubles round so; `F.round` goes by the shortest decimal form, which differs
    where the product comes to a half.  For numbers below 2^53 once they are scaled.
    """
    y = F.abs(x) * float(10**places)
    whole = F.floor(y)
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1).otherwise(0)).cast("double") / float(10**places)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def predict(p: Column, q: Column, mean: Column | None = None, user_bias: Column | None = None, item_bias: Column | None = None) -> Column:
    out = dot(p, q)
    for term in (mean, user_bias, item_bias):
        out = out if term is None else out + term
    return out


def step_size(lrate: float, drate: float, visits: Column) -> Column:
    """1.5 lrate / (1 + drate visits^1.5), visits counted from 1."""
    return F.lit(1.5 * lrate) / (1 + drate * F.pow(visits.cast("double"), F.lit(1.5)))


def bandwidth(text: Column) -> Column:
    """Bytes per second: `inf`, or a number with suffix k, m or g (powers of ten); null if shorter than two characters or malformed."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^([0-9]+\.?[0-9]*)([kmg]?)$", 1)
    suffix = F.regexp_extract(low, r"^([0-9]+\.?[0-9]*)([kmg]?)$", 2)
    scale = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "g", 1e9).otherwise(1.0)
    return F.when(F.length(low) < 2, None).when(low == "inf", F.lit(float("inf"))).when(number != "", number.cast("double") * scale)


def size_number(text: Column) -> Column:
    """12, 5k, 3m as a number."""
    digits = F.regexp_extract(F.lower(text), r"^(\d+)([km]?)$", 1)
    suffix = F.regexp_extract(F.lower(text), r"^(\d+)([km]?)$", 2)
    return F.when(digits != "", digits.cast("long") * F.when(suffix == "k", 1000).when(suffix == "m", 1000000).otherwise(1))


def run_name(text: Column) -> dict[str, Column]:
    """Parts of `dataset-workers-interval-checkpoint` names; null where a name has another form."""
    form = r"^(.+)-(\d+)-(\d+)-(none|sync|async|vs)"
    part = lambda k: F.when(text.rlike(form), F.regexp_extract(text, form, k))
    return {"ds": part(1), "nw": part(2).cast("int"), "ci": part(3).cast("int"), "ctype": part(4)}


def is_one_of(text: Column, *names: str) -> Column:
    return F.lower(text).isin(*names)


def checkpoint_name(job: Column, epoch: Column, part: Column) -> Column:
    return F.format_string("cp-t%d-e%d-p%d", job, epoch, part)


def transmission_delay(nbyte: Column, ratio: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(0.0), nbyte / ratio - elapsed)


def batch_size(cpm: Column, ncols: Column, ranks: Column) -> Column:
    """max(1, min(cpm, ncols / ranks / 4)), integer division."""
    return F.greatest(F.lit(1), F.least(cpm, F.floor(F.floor(ncols / ranks) / 4)))


def min_updated(ncols: Column, portion: float) -> Column:
    return F.greatest(F.lit(1), F.floor(ncols * portion))


def recovery_time(setup: float, work: float, output: float, cost: float, interval: float, progress: Column, scratch: bool = False) -> Column:
    """Time of a run that fails once a share `progress` of its work is done, and is run again.

    A run sets up, works, and writes its output; a checkpoint every `interval` of work takes `cost`.  The
    second run goes on from the last checkpoint; from `scratch` there are no checkpoints and it does all.
    """
    lost = setup + work * progress
    if scratch:
        return lost + setup + work + output
    saved = F.floor(work * progress / interval)  # checkpoints before the failure
    more = F.floor(work * (1 - progress) / interval)  # and in the time that the rest takes from there on
    return lost + setup + (work - saved * interval) + output + (saved + more) * cost


def md5_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons: 52 bits, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def power_law(u: Column, xmin: float, alpha: float) -> Column:
    """A draw of the power law's inverse distribution function."""
    if xmin < 1 or alpha <= 1:
        raise ValueError("xmin >= 1 and alpha > 1")
    return F.lit(xmin) * F.pow(1 - u, F.lit(1 / (1 - alpha)))
