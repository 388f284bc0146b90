"""Operator 5: exact top-k search over binary codes by incremental multi-index hashing.

The code of a vector has one bit for each component, set where it is positive.
Every row is a query; its k nearest other rows by Hamming distance come back,
ties by vec_id, exactly.

A shard of at most shard_codes codes is indexed m times, once for each of m
segments of about log2(n) bits.  For a query the segments are probed in turn at
radius 0, then 1, and so on.  When segments 0 to j are done at radius r and the
others at r - 1, every code within distance m r + j has been seen (otherwise all
its segments would differ by more), so the search of a query ends as soon as its
k-th verified distance is at most that.  A code is verified once: where a
segment finds it that an earlier probe must have found, it is passed over.
Queries whose search has ended leave the batch.

With several shards each one answers for itself and the k best answers are merged.

Result: vec_id, rank (from 1), neighbour_id, distance.

Defined cases: rows with a null vec_id or embedding take no part; a null or NaN
component gives bit 0; vectors of different length are separate collections; rows
that repeat a vec_id count once, with the smallest code; a query with fewer than k
other rows gets them all; an empty embedding has no neighbours; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import cut, parts_of, ragged

TOP, SHARD_CODES, GROUP_QUERIES = 10, 1 << 20, 1 << 20
RESULT = "vec_id bigint, neighbour_id bigint, distance int"


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        if isinstance(column, pa.ListArray) and column.offset:
            column = pa.concat_arrays([column])
        dims = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
        flat = np.nan_to_num(np.asarray(pa.compute.fill_null(column.flatten(), 0.0), dtype=np.float64)) > 0
        ends = np.cumsum(dims)
        codes = [None] * len(dims)
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            bits = flat[ragged(ends[own] - d, np.full(len(own), d))].reshape(len(own), d)
            for r, code in zip(own, np.packbits(bits, axis=1)):
                codes[r] = code.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims.astype(np.int32)), pa.array(codes, pa.binary())], names=["vec_id", "dims", "code"])


def segments(codes: np.ndarray, dims: int, m: int) -> list[tuple[np.ndarray, int]]:
    """(values, bits) of m segments of packed codes."""
    bits = np.unpackbits(codes, axis=1)[:, :dims]
    edges = np.linspace(0, dims, m + 1).round().astype(int)
    return [((bits[:, a:b].astype(np.int64) << np.arange(b - a - 1, -1, -1)).sum(axis=1), b - a) for a, b in zip(edges[:-1], edges[1:])]


class Index:
    """m inverted tables over packed codes (n, bytes)."""

    def __init__(self, codes: np.ndarray, dims: int):
        n = len(codes)
        width = int(np.clip(np.log2(max(2, n)), 4, 16))
        self.dims, self.m = dims, max(1, -(-dims // width))
        self.wide = self._words(codes)
        self.parts = segments(codes, dims, self.m)
        self.tables = []
        for value, bits in self.parts:
            self.tables.append((np.argsort(value, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << bits))))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _words(codes: np.ndarray) -> np.ndarray:
        pad = -codes.shape[1] % 8
        return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, pad)))).view(np.uint64)

    def mask(self, bits: int, radius: int) -> np.ndarray:
        if (bits, radius) not in self.masks:
            self.masks[bits, radius] = np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], dtype=np.int64)
        return self.masks[bits, radius]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): all codes within each query's k-th distance; own is each query's code here or -1."""
        wide, parts = self._words(queries), segments(queries, self.dims, self.m)
        counts = np.zeros((len(queries), self.dims + 1), dtype=np.int64)
        active = np.arange(len(queries))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for radius in range(max(b for _, b in parts) + 1):
            for j, (order, bounds) in enumerate(self.tables):
                bits = parts[j][1]
                if radius <= bits:
                    masks = self.mask(bits, radius)
                    # at most about chunk probes or candidates at a time
                    expected = max(1.0, len(order) / (1 << bits)) * len(masks)
                    step = max(1, int(chunk / expected))
                    for lo in range(0, len(active), step):
                        q = active[lo : lo + step]
                        probe = (parts[j][0][q][:, None] ^ masks[None, :]).reshape(-1)
                        many = bounds[probe + 1] - bounds[probe]
                        code = order[ragged(bounds[probe], many)]
                        query = np.repeat(np.repeat(q, len(masks)), many)
                        keep = code != own[query]
                        for i in range(self.m):
                            if i != j:
                                apart = np.bitwise_count(self.parts[i][0][code] ^ parts[i][0][query])
                                keep &= apart > radius - (i > j)
                        code, query = code[keep], query[keep]
                        distance = np.bitwise_count(self.wide[code] ^ wide[query]).sum(axis=1).astype(np.int64)
                        place = np.searchsorted(q, query)
                        counts[q] += np.bincount(place * (self.dims + 1) + distance, minlength=len(q) * (self.dims + 1)).reshape(len(q), -1)
                        near = distance <= self._bound(counts[q], k)[place]
                        found.append((query[near], code[near], distance[near]))
                covered = self.m * radius + j
                active = active[self._bound(counts[active], k) > covered]
            if not len(active):
                break
        if not found:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        query, code, distance = (np.concatenate(c) for c in zip(*found))
        near = distance <= self._bound(counts, k)[query]
        return query[near], code[near], distance[near]

    def _bound(self, counts: np.ndarray, k: int) -> np.ndarray:
        """The k-th verified distance of each query, dims + 1 while there are fewer than k."""
        full = counts.cumsum(axis=1) >= k
        return np.where(full.any(axis=1), full.argmax(axis=1), self.dims + 1)


def _answer(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.int32())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dims = left["dims"][0].as_py()
        shape = lambda cells: np.frombuffer(b"".join(cells), dtype=np.uint8).reshape(len(cells), -1)
        base = np.frombuffer(left["ids"][0].as_py(), dtype=np.int64)
        index = Index(np.frombuffer(left["codes"][0].as_py(), dtype=np.uint8).reshape(len(base), -1), dims)
        ids = np.asarray(right["vec_id"])
        codes = shape(right["code"].to_pylist())
        at = np.minimum(np.searchsorted(base, ids), len(base) - 1)
        own = np.where(base[at] == ids, at, -1)
        out = []
        for lo in range(0, len(ids), 2048):
            query, code, distance = index.search(codes[lo : lo + 2048], own[lo : lo + 2048], k)
            order = np.lexsort((base[code], distance, query))
            query, code, distance = query[order], code[order], distance[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            top = place < k
            out.append(pa.table([ids[lo + query[top]], base[code[top]], distance[top].astype(np.int32)], schema=schema))
        return pa.concat_tables(out)

    return run


def _shard(table: pa.Table) -> pa.Table:
    ids = np.asarray(table["vec_id"])
    order = np.argsort(ids)
    codes = table["code"].to_pylist()
    return pa.table({"dims": pa.array([table["dims"][0].as_py()], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "codes": pa.array([b"".join(codes[i] for i in order)], pa.binary())})


def top_k(vectors: DataFrame, k: int = TOP, shard_codes: int = SHARD_CODES, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The k nearest other rows of every row (see the module)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    codes = cut(rows.mapInArrow(_codes, "vec_id bigint, dims int, code binary").groupBy("vec_id").agg(F.min(F.struct("dims", "code")).alias("c")).select("vec_id", "c.dims", "c.code"))
    n = codes.count()
    shards = max(1, -(-n // shard_codes))
    # a shard's packed codes are copied to the groups of queries and indexed in each, so there are no more groups than keep the cluster busy
    groups = max(-(-n // group_queries), -(-2 * parts_of(spark) // shards))
    base = codes.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("dims", "shard").applyInArrow(_shard, "dims int, shard bigint, ids binary, codes binary")
    base = base.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = codes.select(F.col("dims").alias("d"), "vec_id", "code", F.pmod(F.hash("vec_id"), F.lit(groups)).alias("h")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    found = base.groupBy("dims", "shard", "g").cogroup(asked.groupBy("d", "s", "h")).applyInArrow(_answer(k), RESULT)
    order = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")
