"""Binary point and label files.

Points: int32 N, int32 d, then N x d float64, row-major, native order. Labels: int32 N, then N int64; true labels also as
``.npy``. Files are read and written by ranges of rows, each task at its own offset, so they have to lie in a folder that
all nodes share under one path. A task that runs twice writes the same bytes twice.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.operators.partition import rank_by
from cairn.plans.ship import ship

HEADER = 8
#: Rows that a task reads at once.
STEP = 65_536


def header(path: str) -> tuple[int, int]:
    """N and d; raises ``ValueError`` if the file's length does not fit them."""
    with open(path, "rb") as f:
        head = f.read(HEADER)
    n, d = struct.unpack("=ii", head) if len(head) == HEADER else (-1, 0)
    if n < 0 or d <= 0 or os.path.getsize(path) != HEADER + 8 * n * d:
        raise ValueError(f"{path} is no point file")
    return n, d


def labels_header(path: str) -> tuple[int, int]:
    """Bytes before the labels, and their number."""
    with open(path, "rb") as f:
        head = f.read(4)
    n = struct.unpack("=i", head)[0] if len(head) == 4 else -1
    if n < 0 or os.path.getsize(path) != 4 + 8 * n:
        raise ValueError(f"{path} is no label file")
    return 4, n


def npy_header(path: str) -> tuple[int, int]:
    """Bytes before the labels of an ``.npy`` file of one row of int64, and their number."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        at = f.tell()
    if kind != np.dtype(np.int64) or len(shape) != 1 or os.path.getsize(path) != at + 8 * shape[0]:
        raise ValueError(f"{path} is no row of int64")
    return at, shape[0]


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class BinReader(DataSourceReader):
    def __init__(self, path: str, rows: int, kind: str):
        self.path, self.rows, self.kind = path, rows, kind
        if kind == "points":
            self.at, (self.n, self.d) = HEADER, header(path)
        else:
            (self.at, self.n), self.d = {"labels": labels_header, "npy": npy_header}[kind](path), 1

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.rows, self.n)) for a in range(0, self.n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(self.at + 8 * self.d * partition.start)
            for a in range(partition.start, partition.stop, STEP):
                n = min(STEP, partition.stop - a)
                raw, ids = f.read(8 * self.d * n), pa.array(np.arange(a, a + n))
                if self.kind == "points":
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.d), pa.array(np.frombuffer(raw)))
                    yield pa.RecordBatch.from_arrays([ids, lists], ["id", "coords"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(raw, np.int64))], ["id", "label"])


class PointsBin(DataSource):
    """``spark.read.format("points_bin").load(path)``: (id, coords), or (id, label) with ``kind`` labels or npy as an
    option; ``rows`` of a task as another."""

    @classmethod
    def name(cls) -> str:
        return "points_bin"

    def schema(self) -> str:
        return "id bigint, coords array<double>" if self.options.get("kind", "points") == "points" else "id bigint, label bigint"

    def reader(self, schema) -> BinReader:
        return BinReader(self.options["path"], int(self.options.get("rows", "1000000")), self.options.get("kind", "points"))


def _read(spark: SparkSession, path: str, rows: int, kind: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PointsBin)
    return spark.read.format("points_bin").option("rows", str(rows)).option("kind", kind).load(path)


def read_points(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    return _read(spark, path, rows, "points")


def read_labels(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """(id, label), id by place."""
    return _read(spark, path, rows, "labels")


def read_npy(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    return _read(spark, path, rows, "npy")


def _write(rows: DataFrame, value: str, path: str, head: bytes, n: int, width: int) -> None:
    """Write the values of ``rows`` (id, value), of ``width`` bytes each, in the order of ``id`` after ``head``."""
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + n * width)
    at = len(head)

    def run(batches):
        done = 0
        with open(path, "r+b") as f:
            for b in batches:
                place, column = b.column(0).to_numpy(), b.column(1)
                flat = (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)
                raw = flat.astype(flat.dtype.newbyteorder("=")).tobytes()
                heads = np.flatnonzero(np.append(True, np.diff(place) != 1))
                for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(place)]):
                    f.seek(at + int(place[i]) * width)
                    f.write(raw[i * width : j * width])
                done += len(place)
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    ship(rows.sparkSession)
    placed = rank_by(rows.select("id", value), ["id"], "place").select(F.col("place").cast("long").alias("place"), value)
    written = placed.sortWithinPartitions("place").mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n
    if (written or 0) != n:
        raise OSError(f"{written} of {n} rows were written to {path}")


def write_points(pts: DataFrame, path: str, coords: str = "coords") -> None:
    size = pts.agg(F.count("*").alias("n"), F.min(F.size(coords)).alias("low"), F.max(F.size(coords)).alias("high")).first()
    if size.low != size.high:
        raise ValueError("points of different dimensions")
    d = size.high or 1
    _write(pts, coords, path, struct.pack("=ii", size.n, d), size.n, 8 * d)


def write_labels(labels: DataFrame, path: str) -> None:
    n = labels.count()
    _write(labels.select("id", F.col("label").cast("long").alias("label")), "label", path, struct.pack("=i", n), n, 8)


def write_npy(labels: DataFrame, path: str) -> None:
    """``label`` in the order of ``id`` as a NumPy file."""
    n, head = labels.count(), io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<i8", "fortran_order": False, "shape": (n,)})
    _write(labels.select("id", F.col("label").cast("long").alias("label")), "label", path, head.getvalue(), n, 8)
