"""Exchanges of packed numpy arrays.

A shuffle of one row a token costs far more than the token itself.  The
operators here shuffle *blobs* instead: each Arrow batch is split by target
part and every part's arrays travel as one binary cell.  The parts are grouped
by Spark (``groupBy("part").applyInArrow``), so lost executors only cost their
own tasks.  The number of parts follows spark.sql.shuffle.partitions, which
a deployment sizes with its input.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUB_BATCH_BYTES = 1 << 20


def parts_of(spark: SparkSession, times: float = 1.0, least: int = 4) -> int:
    """Parts for an exchange: a multiple of the session's shuffle partitions."""
    return max(least, round(times * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def trim() -> None:
    """Give memory that the allocators hold unused back, so that a long-lived worker stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose arrays are given back when it ends: its worker is idle from then on, but stays."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return ended


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about limit bytes of the named column; a longer row stands alone, whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(ends):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        trim()


def split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by part, bounds of each part in it)."""
    kind = np.uint16 if parts <= 65536 else np.int64
    order = np.argsort(part.astype(kind), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))))


class Gather:
    """Arrays collected over sub-batches until about limit entries are there, so that blobs don't get too small."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.parts.append(arrays)
        self.size += len(arrays[0])
        return self.size >= self.limit

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(a) for a in zip(*self.parts)]
        self.parts, self.size = [], 0
        return out


def rows(schema: pa.Schema, values: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*values), schema)] if values else [pa.array([], type=f.type) for f in schema], schema=schema)


def pack_ids(ids: np.ndarray) -> bytes:
    """64-bit ids as differences; runs of near ids compress to almost nothing in the shuffle."""
    return np.diff(ids.astype(np.int64), prepend=np.int64(0)).tobytes()


def unpack_ids(cell: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(cell, dtype=np.int64))


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    """The low width bytes of each 64-bit key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(cell: bytes, width: int) -> np.ndarray:
    small = np.frombuffer(cell, dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(small), 8), dtype=np.uint8)
    wide[:, :width] = small
    return wide.view("<u8").reshape(-1)


def planes(values: np.ndarray) -> bytes:
    """32-bit counts as four byte planes: the high ones are mostly zeros, which the shuffle's compression drops."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(cell: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cell, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)


def by_part(df: DataFrame, reduce: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        out = reduce(table)
        trim()
        return out

    return df.groupBy("part").applyInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster sets it.

    Where it is unset a local session (tests) gets a folder under the working
    directory; on a cluster, where that would be each machine's own, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_CUT: list[tuple[str, str]] = []


def new_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/verbena-{uuid.uuid4().hex}"
    if not _CUT:
        atexit.register(_clean)
    _CUT.append((spark.sparkContext.applicationId, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    """The intermediate tables of a session that is still there; a session that ended first keeps its folder, which the cluster cleans."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark._jsc is None or spark._jsc.sc().isStopped():
        return
    for owner, path in _CUT:
        if owner == spark.sparkContext.applicationId:
            _remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """The frame materialised in the shared folder, its lineage cut.

    It is written as a Parquet table, which is columnar and compressed, and
    read again; the loss of an executor can't lose it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._verbena_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of cut() that nothing reads any more."""
    _remove(df.sparkSession, df._verbena_path)


def usable(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as bigint and the named columns, of the rows where none of them is null."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c) for c in columns])
    for c in ("doc_id", *columns):
        out = out.where(F.col(c).isNotNull())
    return out


def send(spark: SparkSession, value):
    """Broadcast a value whose class executors need not have; take it with received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)
