"""Candidate pairs, their verification and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_part, cut, drop, pack_ids, ragged, rows, split, trim, trimmed, unpack_ids
from .textops import mix64

_BLOB = pa.schema([("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
#: A place where two blocks meet has up to BLOCK * BLOCK pairs, about 170 bytes each while they are checked.
BLOCK, AT_ONCE = 1024, 1 << 18
#: Small clusters share a block of about so many pairs: a block costs about a millisecond by itself.
SHARED = 4096
#: Memory is given back after a block of so many bytes; most are far smaller, and it takes a while.
TRIM_BYTES = 1 << 20
#: A side is broadcast only while its cells of 64 bits, list items included, are at most so many (16 MB).
BROADCAST_CELLS = 2_000_000


def small(df: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
    """df, marked for broadcast while its columns and the items of its lists stay below the bound."""
    cells = F.lit(len(df.columns))
    for name in lists:
        cells = cells + F.size(name)
    total = df.agg(F.sum(cells.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_CELLS else df


def pairs_of_runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of every two members of the runs [start, start + count)."""
    left_n = counts - 1
    i = ragged(starts, np.maximum(left_n, 0))
    remain = np.repeat(starts + counts - 1, np.maximum(left_n, 0)) - i
    j = ragged(i + 1, remain)
    return np.repeat(i, remain), j


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal keys in a sorted array."""
    if len(keys) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return start, np.diff(np.append(start, len(keys)))


def unique_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (x, y) with x < y, sorted."""
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    keep = lo != hi
    lo, hi = lo[keep], hi[keep]
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    first = np.ones(len(lo), dtype=bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[first], hi[first]


def pair_blobs(x: np.ndarray, y: np.ndarray, parts: int) -> pa.RecordBatch:
    """Pairs as blobs for distinct_pairs, split by their smaller id."""
    x, y = unique_pairs(x, y)
    order, bounds = split((mix64(x) % np.uint64(parts)).astype(np.int64), parts)
    x, y = x[order], y[order]
    return rows(_BLOB, [(p, pack_ids(x[a:b]), pack_ids(y[a:b])) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a])


def distinct_pairs(blobs: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of a frame of pair blobs."""

    def reduce(table: pa.Table) -> pa.Table:
        x = np.concatenate([unpack_ids(c.as_py()) for c in table["a"]])
        y = np.concatenate([unpack_ids(c.as_py()) for c in table["b"]])
        return pa.table(dict(zip("xy", unique_pairs(x, y))))

    return by_part(blobs, reduce, "x bigint, y bigint")


def verify(pairs: DataFrame, items: DataFrame, sets: Callable[[pa.Table], list[np.ndarray]], accept: Callable, schema: str, connect: bool = False, carry: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Verify candidate pairs exactly, moving each item about once a cluster.

    pairs: (x, y), a table of cut().  items: (id, ...), of which sets() makes the sorted distinct
    64-bit members of each row.  accept(table, i, j, overlap, sizes) gives a mask
    and the columns of the result; the items' columns named in carry come along as
    <name>_x and <name>_y.  Every pair is checked; with connect, those
    whose items are already connected in their block are skipped, which leaves
    the components as they are.  With weight, a column of the items, pairs don't leave
    their block: the result are rows (x, x, links), the sum of the weights of the
    partners of x in the block, and (x, y, 0), a spanning forest of its pairs.

    An item's label is its smallest candidate partner, so the members of a
    cluster nearly all carry one label and meet in one block.  Labels with many
    members are cut into salted blocks of about BLOCK items, and a pair is
    checked where its two blocks meet.  The other labels share blocks, by hash, and so
    do the places where these meet, so that there is not a block for each small cluster.
    """
    shared = -(-pairs.count() // SHARED) or 1
    both = pairs.select(F.col("x").alias("id"), F.col("y").alias("o")).union(pairs.select(F.col("y"), F.col("x")))
    label = both.groupBy("id").agg(F.least(F.min("o"), F.col("id")).alias("label"))
    count = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    label = cut(label.join(count, "label").select("id", F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("label"), F.lit(shared))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("cuts")))).alias("block")))
    label = small(label)
    meeting = F.xxhash64(F.least("bx", "by"), F.greatest("bx", "by"))
    meeting = F.when(F.col("bx").between(0, shared - 1) & F.col("by").between(0, shared - 1), -1 - F.pmod(meeting, F.lit(shared))).otherwise(meeting)
    placed = (
        pairs.join(label.select(F.col("id").alias("x"), F.col("block").alias("bx")), "x")
        .join(label.select(F.col("id").alias("y"), F.col("block").alias("by")), "y")
        .select(F.when(F.col("bx") == F.col("by"), F.col("bx")).otherwise(meeting).alias("block"), "x", "y")
    )
    placed = cut(placed)
    needed = placed.select(F.col("block").alias("at"), F.explode(F.array("x", "y")).alias("id")).distinct()
    # where the places are few, the items go to their blocks straight, without a shuffle of their own
    shipped = items.join(small(cut(needed)), "id").select("at", *items.columns)

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.asarray(right["id"])
        members = sets(right)
        sizes = np.array([len(m) for m in members], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        codes = np.unique(np.concatenate(members) if len(members) else np.zeros(0, np.uint64), return_inverse=True)[1].reshape(-1)
        order = np.argsort(ids)
        i = order[np.searchsorted(ids[order], np.asarray(left["x"]))]
        j = order[np.searchsorted(ids[order], np.asarray(left["y"]))]
        by_left = np.argsort(i, kind="stable")
        i, j = i[by_left], j[by_left]
        overlap = np.zeros(len(i), dtype=np.int64)
        mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
        root = list(range(len(ids)))

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        keep = np.ones(len(i), dtype=bool)
        for start, length in zip(*run_bounds(i)):
            own = codes[ends[i[start]] : ends[i[start] + 1]]
            mark[own] = True
            work = np.cumsum(sizes[j[start : start + length]])
            lo = 0
            while lo < length:  # about so many members of partners at a time
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + AT_ONCE, side="right")))
                k = np.arange(start + lo, start + hi)
                if connect:
                    here = find(int(i[start]))
                    k = np.array([n for n, to in zip(k.tolist(), j[k].tolist()) if find(to) != here], dtype=np.int64)
                    keep[start + lo : start + hi] = False
                    keep[k] = True
                    if not len(k):
                        lo = hi
                        continue
                many = sizes[j[k]]
                there = np.concatenate(([0], np.cumsum(mark[codes[ragged(ends[j[k]], many)]])))
                to = np.cumsum(many)
                overlap[k] = there[to] - there[to - many]
                if connect and len(k):
                    for n in k[accept(right, i[k], j[k], overlap[k], sizes)[0]].tolist():
                        root[find(int(i[n]))] = find(int(j[n]))
                lo = hi
            mark[own] = False
        i, j, overlap = i[keep], j[keep], overlap[keep]
        good, columns = accept(right, i, j, overlap, sizes)
        i, j = i[good], j[good]
        if weight:
            w = np.asarray(right[weight]).astype(np.float64)
            links = np.bincount(i, weights=w[j], minlength=len(ids)) + np.bincount(j, weights=w[i], minlength=len(ids))
            some = np.flatnonzero(links)
            leaf, to = forest(ids[i], ids[j])
            return pa.table({"x": np.concatenate((ids[some], leaf)), "y": np.concatenate((ids[some], to)), "links": np.concatenate((links[some].astype(np.int64), np.zeros(len(leaf), dtype=np.int64)))})
        out = {"x": ids[i], "y": ids[j]} | {k: v[good] for k, v in columns.items()}
        for c in carry:
            out |= {f"{c}_x": right[c].take(pa.array(i)), f"{c}_y": right[c].take(pa.array(j))}
        return pa.table(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = check(left, right)
        if left.nbytes + right.nbytes > TRIM_BYTES:
            trim()
        return out

    return placed.groupBy("block").cogroup(shipped.groupBy("at")).applyInArrow(run, schema)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, root) of a star for each component of the edges, the root being the smallest id."""
    names, code = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = code[: len(x)], code[len(x) :]
    root = np.arange(len(names))
    while len(a):  # hook the larger root below the smaller one, then halve the paths
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    leaf = np.flatnonzero(root != np.arange(len(names)))
    return names[leaf], names[root[leaf]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's edges, a piece at a time -> a star for each component of the piece."""
    for batch in batches:
        leaf, root = forest(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(root, pa.int64())], names=["x", "y"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components (id, root) of the edges (x, y), the root being the smallest id.

    A union-find of each piece of a partition first turns its edges into stars.
    Rounds of large-star and small-star then bring the stars together until nothing
    changes.  A node's least neighbour is a min, which is combined before the
    shuffle, and comes back by a join, which AQE cuts where a node has many
    neighbours; no row holds a node's neighbours.  Each round is written to the
    shared folder, and the one before deleted.  The number of rounds
    grows with the logarithm of the size; rounds is a safeguard that raises.
    """
    edges = edges.select("x", "y").where(F.col("x") != F.col("y"))
    edges = cut(edges.mapInArrow(trimmed(_forest), "x bigint, y bigint"))
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where(F.col("x") != F.col("y")).union(least.select("x", F.col("m").alias("y")))
        after = cut(small.distinct())
        now = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first()
        drop(edges)
        edges = after
        if now == before:
            return edges.select(F.col("x").alias("id"), F.col("y").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
