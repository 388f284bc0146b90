"""Operator 9: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of a whole text, all counted on bytes and words in one pass: length,
shares of letters, capitals, digits, white space and symbols, word and line
lengths, repetition of words and lines, and the share of words that end in a
sentence mark, hold a symbol or stand in capitals.

Training takes a bounded sample of the labelled documents (max_rows, chosen by
the hash of doc_id), bins each statistic into at most 64 histogram bins by its
quantiles, and boosts depth-wise trees on the logistic loss with second-order
gains.  Scoring flattens all trees into arrays (feature, threshold, left, right,
value) and moves every document down all trees at once with numpy.

A document is rejected when its probability of good quality is below min_good.

Defined cases: a null text has the statistics of an empty one; a null doc_id is
scored like any other; labels other than 0 and 1, and null ones, don't train; a
doc_id with several labels trains with their largest; repeated rows are scored
one by one; with no labels, or of one class only, the score is the share of good
labels, 1 without any; further columns are ignored (or carried along by the
filter); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import received, send, sub_batches, trimmed
from .textops import mix64, span_hashes, spans, string_bytes

MAX_ROWS, TREES, DEPTH, BINS, RATE, MIN_GOOD = 20_000, 80, 5, 64, 0.15, 0.5
STATISTICS = (
    "bytes", "words", "lines", "letters", "capitals", "digits", "white", "symbols", "points", "high",
    "word_bytes", "line_bytes", "unique_words", "top_word", "unique_lines", "ended_words", "symbol_words", "capital_words", "long_words", "single_words", "bar_words",
)

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 symbol
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[128:] = 6
_BLACK = _CLASS != 4


def _per_row(offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repetition(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the commonest) of each row."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    mixed = mix64(keys ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(mixed)
    mixed, row = mixed[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
    count = np.diff(np.append(first, len(mixed)))
    top = np.zeros(n)
    np.maximum.at(top, row[first], count)
    return np.bincount(row[first], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, as rows in the order of STATISTICS."""
    raw, offsets = string_bytes(column)
    n = len(column)
    size = np.diff(offsets).astype(float)
    kind = _CLASS[raw]
    share = {k: _per_row(offsets, kind == k) / np.maximum(1, size) for k in range(7)}
    start, end, row = spans(raw, offsets, _BLACK)
    words = np.bincount(row, minlength=n).astype(float)
    w = np.maximum(1, words)
    length = end - start
    symbols = np.concatenate(([0], np.cumsum(kind == 0, dtype=np.int64)))
    capitals = np.concatenate(([0], np.cumsum(kind == 2, dtype=np.int64)))
    small = np.concatenate(([0], np.cumsum(kind == 1, dtype=np.int64)))
    last = raw[end - 1] if len(end) else raw[:0]
    of_words = lambda mask: np.bincount(row[mask], minlength=n) / w
    not_break = np.ones(256, dtype=bool)
    not_break[10] = False
    lstart, lend, lrow = spans(raw, offsets, not_break)
    lines = np.bincount(lrow, minlength=n).astype(float)
    distinct_words, top_word = _repetition(span_hashes(raw, start, end), row, n)
    distinct_lines, _ = _repetition(span_hashes(raw, lstart, lend), lrow, n)
    out = {
        "bytes": np.log1p(size), "words": np.log1p(words), "lines": np.log1p(lines),
        "letters": share[1], "capitals": share[2], "digits": share[3], "white": share[4], "symbols": share[0], "points": share[5], "high": share[6],
        "word_bytes": np.bincount(row, weights=length, minlength=n) / w, "line_bytes": np.log1p(size / np.maximum(1, lines)),
        "unique_words": distinct_words / w, "top_word": top_word / w, "unique_lines": distinct_lines / np.maximum(1, lines),
        "ended_words": of_words((last == 46) | (last == 33) | (last == 63)),
        "symbol_words": of_words(symbols[end] - symbols[start] > 0),
        "capital_words": of_words((capitals[end] - capitals[start] > 1) & (small[end] == small[start])),
        "long_words": of_words(length > 20), "single_words": of_words(length == 1), "bar_words": of_words((length == 1) & (last == 124)),
    }
    return np.stack([out[k] for k in STATISTICS], axis=1)


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        at = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boost histogram trees on 0/1 labels."""
    empty = [np.zeros(0, dtype=np.int64)] * 4
    if len(y) == 0 or y.min() == y.max():
        base = 30.0 if len(y) == 0 or y.min() == 1 else -30.0
        return Forest(empty[0], np.zeros(0), *empty[1:3], np.zeros(0), empty[3], base, 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(0.0)
        left.append(len(left))
        right.append(len(right))
        value.append(0.0)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for at, own in level:
                gs, hs = g[own].sum(), h[own].sum()
                split = None
                if d < depth and hs >= 2 * least / 4:
                    cells = flat[own].ravel()
                    gh = np.bincount(cells, weights=np.repeat(g[own], x.shape[1]), minlength=bins * x.shape[1]).reshape(x.shape[1], bins).cumsum(axis=1)
                    hh = np.bincount(cells, weights=np.repeat(h[own], x.shape[1]), minlength=bins * x.shape[1]).reshape(x.shape[1], bins).cumsum(axis=1)
                    gain = gh**2 / (hh + ridge) + (gs - gh) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                    gain[(hh < least / 4) | (hs - hh < least / 4)] = -1
                    for f, e in enumerate(edges):
                        gain[f, len(e) :] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6:
                        split = f, b
                if split is None:
                    value[at] = -rate * gs / (hs + ridge)
                    score[own] += value[at]
                    continue
                f, b = split
                feature[at], threshold[at], left[at], right[at] = int(f), float(edges[f][b]), node(), node()
                goes = binned[own, f] <= b
                below += [(left[at], own[goes]), (right[at], own[~goes])]
            level = below
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on at most max_rows labelled documents."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id IS NOT NULL AND good IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"))
    n = marks.count()
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    if n > max_rows:
        marks = marks.where(place < int((1 << 30) * max_rows / n))
    # the sample is bounded by max_rows (but for the luck of the hash), so it is broadcast at any size
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").select("doc_id", "good", "text")
    got = sample.mapInArrow(_statistics_of, "doc_id bigint, good int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable").head(max_rows)
    x = np.array([np.frombuffer(c) for c in got["x"]]).reshape(-1, len(STATISTICS))
    return fit(x, got["good"].to_numpy(dtype=float))


def _score(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(forest)
        for batch in sub_batches(batches, "text"):
            p = own.probability(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "good"])

    return run


def score(docs: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD, forest: Forest | None = None) -> DataFrame:
    """(doc_id, good, kept): the probability of good quality and the decision, for every document."""
    forest = send(docs.sparkSession, forest or train(docs, labels))
    scored = docs.select("doc_id", "text").mapInArrow(_score(forest), f"doc_id {dict(docs.dtypes)['doc_id']}, good double")
    return scored.withColumn("kept", F.col("good") >= min_good)


def _keep(forest, min_good: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(forest)
        for batch in sub_batches(batches, "text"):
            yield batch.filter(pa.array(own.probability(statistics(batch.column("text"))) >= min_good))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD, forest: Forest | None = None) -> DataFrame:
    """The documents that aren't rejected, columns as they are."""
    forest = send(docs.sparkSession, forest or train(docs, labels))
    return docs.mapInArrow(trimmed(_keep(forest, min_good)), docs.schema)
