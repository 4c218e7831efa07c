"""Commands: ``spark-submit -m sparsewright.cli train|predict|convert|generate|view`` or ``python -m sparsewright.cli``.

``train`` fits factors to a stored ratings folder, ``predict`` scores a table with a stored model, ``convert``
turns tab separated triples with string ids into training and test folders with id maps, ``generate`` makes a
synthetic pair, ``view`` tells what a folder holds.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ccd, sgd, synth
from .operators import matrix as M
from .operators.checkpoint import PROTOCOLS
from .sources import model as D
from .sources import text as T


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparsewright")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="fit factors to a ratings folder")
    t.add_argument("input")
    t.add_argument("output")
    t.add_argument("--solver", choices=("sgd", "ccd"), default="sgd")
    t.add_argument("--test")
    t.add_argument("--dim", type=int, default=100)
    t.add_argument("--parts", type=int, default=4)
    t.add_argument("--epochs", type=int, default=10)
    t.add_argument("--lrate", type=float, default=0.001)
    t.add_argument("--drate", type=float, default=0.1)
    t.add_argument("--reg", type=float, default=1.0)
    t.add_argument("--seed", type=int, default=12345)
    t.add_argument("--strategy", choices=(*sgd.STRATEGIES, "least"), default="wor")
    t.add_argument("--start", choices=tuple(sgd.STARTS), default="scaled")
    t.add_argument("--reuse", type=int, default=1)
    t.add_argument("--biased", action="store_true")
    t.add_argument("--bold", nargs=2, type=float, metavar=("DECAY", "GROWTH"))
    t.add_argument("--min-error", type=float)
    t.add_argument("--stop-rmse", type=float)
    t.add_argument("--inner", type=int, default=1)
    t.add_argument("--eps", type=float)
    t.add_argument("--nonneg", action="store_true")
    t.add_argument("--cptype", type=str.lower, default="none")
    t.add_argument("--cpinterval", type=int, default=0)
    t.add_argument("--cppath")
    t.add_argument("--recover", type=int, default=-1)
    q = sub.add_parser("predict", help="score a ratings folder with a model")
    for name in ("model", "input", "output"):
        q.add_argument(name)
    c = sub.add_parser("convert", help="tab separated user, item, value to folders and id maps")
    for name in ("train", "test", "output"):
        c.add_argument(name)
    g = sub.add_parser("generate", help="a synthetic training and test folder")
    g.add_argument("output")
    g.add_argument("--rows", type=int, required=True)
    g.add_argument("--cols", type=int, required=True)
    g.add_argument("--dim", type=int, default=20)
    g.add_argument("--seed", type=int, default=12345)
    sub.add_parser("view", help="what a folder holds").add_argument("folder")
    return p


def checked(options: argparse.Namespace) -> argparse.Namespace:
    """The options, if they fit together; else a ValueError that says what does not."""
    if options.command != "train":
        return options
    if options.cptype not in PROTOCOLS:
        raise ValueError(f"cptype is one of {', '.join(PROTOCOLS)}")
    if options.cptype != "none" and (options.cpinterval <= 0 or not options.cppath):
        raise ValueError("a cptype needs a positive cpinterval and a cppath")
    if options.recover >= 0 and not options.cppath:
        raise ValueError("recover needs a cppath")
    if min(options.dim, options.parts, options.epochs, options.reuse, options.inner) < 1:
        raise ValueError("dim, parts, epochs, reuse and inner are positive")
    if options.solver == "ccd" and (options.biased or options.cptype != "none"):
        raise ValueError("ccd has neither biases nor checkpoints")
    return options


def train(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Writes the model and returns the log."""
    t = D.load_data(spark, o.input)
    mean = float(D.params_of(spark, o.input)["mean"] or 0.0) if o.biased else 0.0
    known = {"dim": o.dim, "epochs": o.epochs, "lam_row": o.reg, "lam_col": o.reg, "lrate": o.lrate, "mean": mean}
    if o.solver == "ccd":
        first = sgd.start(t, o.dim, o.seed, o.start).filter("kind = 'row'").select(F.col("id").alias("row"), F.posexplode("vec").alias("t", "x"))
        rows, cols, log = ccd.train(t, o.dim, o.reg, o.epochs, o.inner, first, o.nonneg, o.eps)
        long = rows.withColumn("kind", F.lit("row")).unionByName(cols.withColumn("kind", F.lit("col")))
        factors = long.groupBy("kind", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("vec"))
        lines = spark.createDataFrame(log, "epoch int, rank int, loss double")
    else:
        folder = o.cppath if o.cptype != "none" or o.recover >= 0 else None
        factors, log = sgd.train(
            t, sgd.start(t, o.dim, o.seed, o.start, o.biased), o.parts, o.epochs, o.lrate, o.drate, o.reg, o.strategy, o.seed, bold=tuple(o.bold) if o.bold else None, biased=o.biased, mean=mean,
            reuse=o.reuse, folder=folder, interval=o.cpinterval or o.epochs + 1, resume=o.recover if o.recover >= 0 else None, test=D.load_data(spark, o.test) if o.test else None,
            min_error=o.min_error, stop_rmse=o.stop_rmse, protocol=o.cptype,
        )
        lines = spark.createDataFrame(log, "epoch int, step double, loss double, rmse double, test_rmse double")
    D.save_model(D.from_factors(factors, o.biased, **known), o.output)
    return lines


def convert(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    both = {k: T.tsv_triples(spark.read.text(getattr(o, k))) for k in ("train", "test")}
    every = both["train"].unionByName(both["test"])
    rows, cols = M.id_map(every.select("user")), M.id_map(every.select("item"))
    for k, t in both.items():
        D.save_data(M.sum_duplicates(M.encode(t, rows, cols)), f"{o.output}/{k}")
    for k, ids in (("user_ids", rows), ("item_ids", cols)):
        ids.write.parquet(f"{o.output}/{k}")
    return D.view(spark, f"{o.output}/train")


def generate(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    t = synth.generate(spark, o.rows, o.cols, o.dim, o.seed)
    t = M.cut(t)
    for k, test in (("train", False), ("test", True)):
        D.save_data(t.filter(F.col("test") == test), f"{o.output}/{k}")
    return D.view(spark, f"{o.output}/train")


def predict(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    scored = D.predict(D.load_model(spark, o.model), D.load_data(spark, o.input))
    scored.write.parquet(o.output)
    out = spark.read.parquet(o.output)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("pred") - F.col("value")) * (F.col("pred") - F.col("value")))).alias("rmse"))


def main(args: list[str], spark: SparkSession | None = None) -> DataFrame:
    options = checked(parser().parse_args(args))
    spark = spark or SparkSession.builder.appName("sparsewright").getOrCreate()
    if options.command == "view":
        return D.view(spark, options.folder)
    return {"train": train, "predict": predict, "convert": convert, "generate": generate}[options.command](spark, options)


if __name__ == "__main__":
    main(sys.argv[1:]).show(1000, False)
