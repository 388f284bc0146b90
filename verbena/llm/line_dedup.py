"""Operator 8: fuzzy line deduplication by MinHash.

A line is what stands between newlines.  Lines are compared in lower case with
white space at both ends removed; blank lines take no part and always stay.

1. Signatures: the 8-character shingles of a line (a shorter line is one
   shingle) are hashed once; the hash picks one of 64 bins and each bin keeps its
   minimum (one-permutation MinHash).  Empty bins borrow from the next filled
   bin at a hashed offset, so short lines have whole signatures too.
2. Banding: 12 bands of 5 bins (4 bins are spare).  Lines that agree on a band are candidates; at
   the threshold 0.75 a pair is found with probability 0.96, at 0.85 with 0.9995.
3. Candidates are verified by the exact Jaccard similarity of their shingles.
4. Distributed union-find joins verified pairs; exact copies are one line from
   the start.
5. Of each component the first occurrence, by (doc_id, line number), stays; all
   other occurrences go, within a document too.

Defined cases: rows with a null doc_id or text stay as they are; an empty text
stays; ties are settled by doc_id and line number; of rows that repeat a doc_id
a line number dropped in one is dropped in all; further columns are carried
along untouched; an empty table gives no rows.  A document that loses all its
non-blank lines goes.  Lines count as exact copies when their 64-bit hashes agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import Gather, by_part, cut, parts_of, ragged, rows, split, sub_batches, trimmed, usable
from .pairs import components, distinct_pairs, pair_blobs, pairs_of_runs, run_bounds, small, verify
from .textops import code_points, lower, mix64, span_hashes

SHINGLE, BANDS, ROWS, THRESHOLD = 8, 12, 5, 0.75
BINS = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case, start, end, row, line number) of the lines that aren't blank; ends are trimmed."""
    points, offsets = code_points(lower(column))
    breaks = np.flatnonzero(points == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((offsets[1:], breaks)))
    row = np.arange(len(start)) - np.searchsorted(breaks, start)
    number = np.arange(len(start)) - np.searchsorted(row, row)
    black = np.flatnonzero(~((points == 32) | ((points >= 9) & (points <= 13))))
    a, b = np.searchsorted(black, start), np.searchsorted(black, end)
    full = b > a
    if not full.any():
        z = np.zeros(0, dtype=np.int64)
        return points, z, z, z, z
    return points, black[a[full]], black[b[full] - 1] + 1, row[full], number[full]


def shingles(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of every 8-character shingle of the spans, a shorter span being one; starts ascend."""
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = points.astype(np.uint64)
    for width, base in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93), (4, 0xBF58476D1CE4E5B9)):
        if len(h) <= width:
            h = h[:0]
            break
        h = h[:-width] * np.uint64(base) + h[width:]
    length = end - start
    whole = np.flatnonzero(length >= SHINGLE)
    count = length[whole] - SHINGLE + 1
    value, line = h[ragged(start[whole], count)], np.repeat(whole, count)
    short = np.flatnonzero(length < SHINGLE)
    if len(short):
        value = np.concatenate((value, span_hashes(points, start[short], end[short])))
        line = np.concatenate((line, short))
    return mix64(value), line


def signatures(hashes: np.ndarray, line: np.ndarray, lines: int, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of each line, empty bins filled from others."""
    out = np.full(lines * bins, _EMPTY, dtype=np.uint64)
    place = (hashes >> np.uint64(58)).astype(np.int64)
    place += line * bins
    np.minimum.at(out, place, hashes)
    out = out.reshape(lines, bins)
    places = np.arange(bins, dtype=np.uint64)
    base, step = out.copy(), 0
    r, c = np.nonzero(base == _EMPTY)
    while len(r):
        step += 1
        if step <= 32:  # a hashed walk over the bins, the same for every line
            source = (mix64(places * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) % np.uint64(bins)).astype(np.int64)[c]
        else:
            source = (c + step) % bins
        found = base[r, source]
        out[r, c] = found
        still = found == _EMPTY
        r, c = r[still], c[still]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, height: int = ROWS) -> np.ndarray:
    """One key for each line and band."""
    keys = np.zeros((len(signature), bands), dtype=np.uint64)
    for r in range(height):
        keys = keys * np.uint64(0xD6E8FEB86659FD93) + mix64(signature[:, r * bands : (r + 1) * bands])
    return mix64(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def line_ids(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 63-bit id of each line's text."""
    return (span_hashes(points, start, end) >> np.uint64(1)).astype(np.int64)


def _bands(parts: int, flush: int = 500_000):
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def blobs(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order, bounds = split((keys % np.uint64(parts)).astype(np.int64), parts)
        keys, ids = keys[order] >> np.uint64(8), ids[order]
        return rows(schema, [(p, keys[a:b].tobytes(), ids[a:b].tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gather(flush)
        for batch in sub_batches(batches, "text"):
            points, start, end, _, _ = lines_of(batch.column("text"))
            ids, first = np.unique(line_ids(points, start, end), return_index=True)
            order = np.argsort(first)
            ids, start, end = ids[order], start[first[order]], end[first[order]]
            keys = band_keys(signatures(*shingles(points, start, end), len(ids)))
            if held.add(keys.reshape(-1), np.repeat(ids, keys.shape[1])):
                yield blobs(*held.take())
        if held.size:
            yield blobs(*held.take())

    return run


def _band_pairs(parts: int, chunk: int = 2_000_000):
    def reduce(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(c.as_py(), dtype=np.uint64) for c in table["keys"]])
        ids = np.concatenate([np.frombuffer(c.as_py(), dtype=np.int64) for c in table["ids"]])
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        start, count = run_bounds(keys)
        start, count = start[count > 1], count[count > 1]
        work, lo, out = np.cumsum(count * (count - 1) // 2), 0, []
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + chunk, side="right")))
            i, j = pairs_of_runs(start[lo:hi], count[lo:hi])
            out.append(pair_blobs(ids[i], ids[j], parts))
            lo = hi
        if not out:
            out.append(pair_blobs(ids[:0], ids[:0], parts))
        return pa.Table.from_batches(out)

    return reduce


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        points, start, end, row, number = lines_of(batch.column("text"))
        columns = [pa.array(line_ids(points, start, end)), pa.array(np.asarray(batch.column("doc_id"))[row]), pa.array(number.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["line", "doc_id", "number"])


def _texts(wanted):
    """(id, text) of each distinct line of a batch; with wanted, of those in a broadcast sorted array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else np.frombuffer(wanted.value, dtype=np.int64)
        for batch in sub_batches(batches, "text"):
            points, start, end, _, _ = lines_of(batch.column("text"))
            ids, first = np.unique(line_ids(points, start, end), return_index=True)
            if keep is not None:
                there = np.isin(ids, keep[np.searchsorted(keep, ids[0]) :], assume_unique=True) if len(ids) else np.zeros(0, dtype=bool)
                ids, first = ids[there], first[there]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([points[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(start[first], end[first])], pa.string())], names=["id", "line"])

    return run


def _sets(table: pa.Table) -> list[np.ndarray]:
    points, offsets = code_points(table["line"].combine_chunks())
    hashes, line = shingles(points, offsets[:-1], offsets[1:])
    order = np.lexsort((hashes, line))
    hashes, line = hashes[order], line[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    hashes, line = hashes[new], line[new]
    bounds = np.searchsorted(line, np.arange(len(offsets)))
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _accept(threshold: float):
    def accept(_table, i, j, overlap, sizes):
        return overlap >= threshold * (sizes[i] + sizes[j] - overlap) - 1e-9, {}

    return accept


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD, broadcast_lines: int = 2_000_000) -> DataFrame:
    """(id, root): the lines of components with more than one distinct line."""
    spark = docs.sparkSession
    texts = usable(docs, "text")
    parts = parts_of(spark)
    bands = texts.select("text").mapInArrow(trimmed(_bands(parts)), "part int, keys binary, ids binary")
    pairs = cut(distinct_pairs(by_part(bands, _band_pairs(parts), "part int, a binary, b binary")))
    active = cut(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    if active.count() <= broadcast_lines:
        wanted = spark.sparkContext.broadcast(np.sort(active.toPandas()["id"].to_numpy(dtype=np.int64)).tobytes())
        items = texts.select("text").mapInArrow(trimmed(_texts(wanted)), "id bigint, line string")
    else:
        items = texts.select("text").mapInArrow(trimmed(_texts(None)), "id bigint, line string").join(active, "id", "left_semi")
    items = items.groupBy("id").agg(F.min("line").alias("line"))
    # written first: in one task with it, the forest of components would take a second Python worker, which an executor keeps
    return components(cut(verify(pairs, items, _sets, _accept(threshold), "x bigint, y bigint", connect=True)))


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, numbers): the line numbers, from 0, that deduplication takes out of each document."""
    roots = similar_lines(docs, threshold)
    texts = usable(docs, "text")
    lines = texts.mapInArrow(trimmed(_occurrences), "line bigint, doc_id bigint, number int")
    # occurrences by component; most lines are their own
    lines = lines.join(roots.withColumnRenamed("id", "line"), "line", "left").select(F.coalesce("root", "line").alias("root"), "doc_id", "number")
    lines = lines.withColumn("o", F.struct("doc_id", "number")).select("root", "o")
    first = lines.groupBy("root").agg(F.min("o").alias("first"), F.max("o").alias("last")).where(F.col("first") != F.col("last")).drop("last")
    spread = lines.join(first, "root").where(F.col("o") != F.col("first"))
    return spread.groupBy(F.col("o.doc_id").alias("doc_id")).agg(F.sort_array(F.collect_set("o.number")).alias("numbers"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one line of each component kept (see the module).

    Columns and their order stay; n_chars, where there is one, is counted anew
    for the documents that change.  The table of dropped lines is broadcast only
    while its cells are few enough; beyond, the join shuffles.
    """
    doc, numbers, lines, new = (f"__{k}_{uuid.uuid4().hex}" for k in ("doc", "numbers", "lines", "text"))
    drops = cut(dropped_lines(docs, threshold)).select(F.col("doc_id").alias(doc), F.col("numbers").alias(numbers))
    drops = small(drops, (numbers,))
    joined = docs.join(drops, docs["doc_id"].cast("bigint") == drops[doc], "left")
    changed = F.col(numbers).isNotNull() & F.col("text").isNotNull()
    # a column of its own, so that the lambda doesn't split the text for each line
    joined = joined.withColumn(lines, F.when(changed, F.split("text", "\n", -1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers)), lambda i: F.get(lines, i))
    # a generator makes the new text once, and no text where nothing is left; a filter would make it again
    blank = lambda t: F.length(F.trim(F.regexp_replace(t, "[\\t\\n\\x0B\\f\\r]", " "))) == 0
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))
    joined = joined.withColumn(new, F.explode(F.filter(F.array(text), lambda t: ~(changed & blank(t)))))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col(new).alias("text"))
        elif c == "n_chars":
            out.append(F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)
