"""The binary matrix format as a Spark data source, ``format("matrix")``.

Little-endian: int32 file id (1211216 regular, 1015 long); int32 rows, int32 columns; nnz as int32 (regular)
or int64 (long); int32 entries per row; int32 column of every entry, row by row; float64 values.

A read splits the rows into ranges of about equal size; the counts before each range are summed once, where
the ranges are made, and each task reads its range's counts, columns and values by offset, nothing else.  A write lays the file out first (counts per row are known to the driver by
an aggregate of one row per part), then every task writes its own rows at their offsets: no single writer.
Paths are those of a file system that all executors mount; `read_any` reads files of any store that Spark
reads, each as a whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
REGULAR, LONG = 1211216, 1015
SCHEMA = "row int, col int, value double"


def local(path: str) -> str:
    """The mounted path of a file: url."""
    return path.removeprefix("file://").removeprefix("file:")


def header(data: bytes) -> tuple[int, int, int, int]:
    """(rows, columns, nnz, bytes of the header) from a file's first 20 bytes."""
    kind, rows, cols = struct.unpack("<iii", data[:12])
    if kind == REGULAR:
        return rows, cols, struct.unpack("<i", data[12:16])[0], 16
    if kind == LONG:
        return rows, cols, struct.unpack("<q", data[12:20])[0], 20
    raise ValueError(f"not a matrix file: id {kind}")


def probe(path: str) -> tuple[int, int, int]:
    """(rows, columns, nnz), reading the header only."""
    with open(local(path), "rb") as f:
        return header(f.read(20))[:3]


class Rows(InputPartition):
    """A range of rows, the entries before it and those in it."""

    def __init__(self, first: int, last: int, before: int, held: int):
        super().__init__((first, last))
        self.first, self.last, self.before, self.held = first, last, before, held


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.parts = int(options.get("parts", 8))

    def partitions(self) -> list[Rows]:
        """The counts are read here once, a piece at a time; a task gets the sum of those before it."""
        with open(self.path, "rb") as f:
            rows, _, _, at = header(f.read(20))
        step, before, out = max(1, -(-rows // max(1, self.parts))), 0, []
        for a in range(0, rows, step):
            z = min(a + step, rows)
            held = sum(int(np.fromfile(self.path, "<i4", min(1 << 20, z - k), offset=at + 4 * k).sum(dtype=np.int64)) for k in range(a, z, 1 << 20))
            out.append(Rows(a, z, before, held))
            before += held
        return out or [Rows(0, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator:
        import pyarrow as pa

        with open(self.path, "rb") as f:
            rows, _, nnz, at = header(f.read(20))
        mine = np.fromfile(self.path, "<i4", part.last - part.first, offset=at + 4 * part.first)
        n, before, base = part.held, part.before, at + 4 * rows
        cols = np.fromfile(self.path, "<i4", n, offset=base + 4 * before)
        values = np.fromfile(self.path, "<f8", n, offset=base + 4 * nnz + 8 * before)
        row = np.repeat(np.arange(part.first, part.last, dtype=np.int32), mine)
        for a in range(0, n, 1 << 16):
            z = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(row[a:z]), pa.array(cols[a:z]), pa.array(values[a:z])], ["row", "col", "value"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options)


def read(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("parts", parts).load(path)


def load_pair(spark: SparkSession, folder: str, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """The training and test matrices of a folder, by their fixed names."""
    return read(spark, f"{folder}/train.dat", parts), read(spark, f"{folder}/test.dat", parts)


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, _, nnz, at = header(content[:20])
    counts = np.frombuffer(content, "<i4", rows, at)
    cols = np.frombuffer(content, "<i4", nnz, at + 4 * rows)
    return np.repeat(np.arange(rows, dtype=np.int32), counts), cols, np.frombuffer(content, "<f8", nnz, at + 4 * rows + 4 * nnz)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Matrix files of any store, one task per file (a file of at most 2 GB)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for content in b["content"]:
                r, c, v = parse(bytes(content))
                yield pd.DataFrame({"row": r, "col": c, "value": v})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def write(t: DataFrame, path: str, rows: int, cols: int, long: bool = True, parts: int = 8) -> None:
    """Write unique cells of 0-based ids.  Empty rows are written too; an empty matrix is a header."""
    path, size = local(path), max(1, -(-rows // parts))
    part = F.floor(F.col("row") / size).cast("int")
    tagged = t.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")).withColumn("part", part)
    held = dict(map(tuple, tagged.groupBy("part").agg(F.count(F.lit(1))).collect()))  # one row per part
    nnz = sum(held.values())
    if not long and nnz >= 1 << 31:
        raise ValueError("too many entries for the regular format")
    head = struct.pack("<iii", LONG if long else REGULAR, rows, cols) + struct.pack("<q" if long else "<i", nnz)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * rows + 12 * nnz)
    before, at = {}, 0
    for p in sorted(held):
        before[p], at = at, at + held[p]
    base = len(head)

    def put(pdf):
        import pandas as pd

        p = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["row", "col"])
        first, last = p * size, min((p + 1) * size, rows)
        counts = np.bincount(pdf["row"] - first, minlength=last - first).astype("<i4")
        with open(path, "r+b") as f:
            for offset, data in ((base + 4 * first, counts), (base + 4 * rows + 4 * before[p], pdf["col"].to_numpy("<i4")), (base + 4 * rows + 4 * nnz + 8 * before[p], pdf["value"].to_numpy("<f8"))):
                f.seek(offset)
                f.write(data.tobytes())
            f.flush()
            os.fsync(f.fileno())
        return pd.DataFrame({"n": [len(pdf)]})

    tagged.groupBy("part").applyInPandas(put, "n long").agg(F.sum("n")).collect()
