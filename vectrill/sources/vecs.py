"""Vector files: fvecs, ivecs and bvecs.

A record is a 32-bit little-endian dimension and that many values of 4 bytes (float, int) or 1 byte (bvecs). All
records of a file have the same dimension. The reader is a Python data source: a file is cut into ranges of whole
records, one partition each; ``id`` is the record's number within its file, plus those of the files before.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = {"fvecs": ("<f4", "array<float>"), "ivecs": ("<i4", "array<int>"), "bvecs": ("u1", "array<int>")}
BATCH = 10_000


def _kind(options: dict, path: str) -> str:
    kind = options.get("kind") or os.path.splitext(path.rstrip("/"))[1].lstrip(".")
    if kind not in KINDS:
        raise ValueError(f"no kind of vector file: {kind!r}; there are {', '.join(KINDS)}")
    return kind


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "*vecs"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def _record(path: str, kind: str) -> tuple[int, int, int]:
    """(dimension, bytes of a record, records)."""
    with open(path, "rb") as f:
        head = f.read(4)
    if not head:
        return 0, 4, 0
    d = struct.unpack("<i", head)[0]
    size = 4 + d * np.dtype(KINDS[kind][0]).itemsize
    total = os.path.getsize(path)
    if d <= 0 or total % size:
        raise ValueError(f"{path} is not a {kind} file of {d} dimensions")
    return d, size, total // size


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    start_id: int

    def __init__(self, path: str, first: int, count: int, start_id: int):
        self.path, self.first, self.count, self.start_id = path, first, count, start_id


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        per, out, start = int(self.options.get("rowsPerPartition", 1_000_000)), [], 0
        for f in _files(path):
            _, _, n = _record(f, _kind(self.options, f))
            out += [Range(f, a, min(per, n - a), start) for a in range(0, n, per)]
            start += n
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        kind = _kind(self.options, part.path)
        dtype = np.dtype(KINDS[kind][0])
        d, size, _ = _record(part.path, kind)
        value = pa.float32() if kind == "fvecs" else pa.int32()
        with open(part.path, "rb") as f:
            f.seek(part.first * size)
            for a in range(0, part.count, BATCH):
                n = min(BATCH, part.count - a)
                raw = np.frombuffer(f.read(n * size), np.uint8).reshape(n, size)[:, 4:]
                x = np.ascontiguousarray(raw).view(dtype).reshape(n * d)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x).cast(value))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + part.start_id + part.first + a), vec], names=["id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    attempt: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.options = options
        self.column = schema.fieldNames().index("vec")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        target = self.options["path"]
        kind = self.options.get("kind", "fvecs")
        dtype = np.dtype(KINDS[kind][0])
        os.makedirs(target, exist_ok=True)
        name = os.path.join(target, f"part-{TaskContext.get().partitionId():05d}.{kind}")
        attempt = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"  # tries of one task don't share a file
        with open(attempt, "wb") as f:
            for batch in batches:
                column = batch.column(self.column)
                if not len(column):
                    continue
                x = column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)
                head = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8).reshape(len(x), 4)
                f.write(np.concatenate([head, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)], axis=1).tobytes())
        return Written(name, attempt)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.attempt, m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.attempt):
                os.remove(m.attempt)


class VecsSource(DataSource):
    """``spark.read.format("vecs").load(path)``; options ``kind`` and ``rowsPerPartition``. The path is a shared file system's."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        path = self.options["path"]
        kind = _kind(self.options, _files(path)[0])
        return f"id bigint, vec {KINDS[kind][1]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecsSource)


def read(spark: SparkSession, path: str, kind: str | None = None, rows_per_partition: int = 1_000_000) -> DataFrame:
    register(spark)
    reader = spark.read.format("vecs").option("rowsPerPartition", rows_per_partition)
    return (reader.option("kind", kind) if kind else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "fvecs") -> None:
    """Files part-*.<kind> in a folder; the column ``vec`` is written, in the order of partitions."""
    register(df.sparkSession)
    df.select("vec").write.format("vecs").option("kind", kind).mode("append").save(path)
