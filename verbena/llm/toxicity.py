"""Operator 2: toxicity by class-conditional Kneser-Ney models.

The unit is the character inside a word (lower case; what isn't a letter is a
boundary), so that inflected and compounded forms of a toxic stem share their
evidence.  Grams have up to 4 characters and don't reach back over a word's start.

Counts: every document of the corpus gives gram counts; those of labelled
documents also count for their class (toxic or ordinary), but for a tenth of the
ordinary ones, by hash, which is held out for calibration; every toxic label counts.

Models: each class has an interpolated Kneser-Ney model of the highest order with
its own counts.  What a class hasn't seen, or only rarely, backs off to lower
orders that both classes share: Kneser-Ney continuation counts (in how many left
contexts a gram occurs) of the whole corpus.

Score: the difference of the length-normalised log-likelihoods, toxic minus
ordinary.  Where neither class has seen a gram the shared probability cancels and
only the back-off weights remain, so a table of one number for each seen gram and
each context scores any text.  Scores of short texts are drawn to the centre
(n / (n + 50) for n characters).  The held-out ordinary documents give the centre of
each language and the threshold: the 0.993 quantile of their centred scores.

The table is broadcast while the corpus has at most max_grams distinct grams.  Beyond,
the same numbers are computed as a table partitioned by context, and the documents'
grams are sent to its parts, which return each document's share of the sum.

Result: doc_id, lang, score (centred), toxic, for every document.

Defined cases: a null text scores like an empty one, 0 before centring; a null
doc_id is scored but can't be labelled; a doc_id with several labels takes the
largest; a language without held-out ordinary documents (null included) is centred
at the pooled centre; without labels of both classes every score is 0 and nothing is
toxic; repeated rows count and score one by one; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import Gather, cut, parts_of, received, rows, send, split, sub_batches, trim
from .textops import code_points, lower, mix64

ORDER, DISCOUNT, QUANTILE, HELD_OUT, SHRINK, MAX_GRAMS, BROADCAST_LABELS = 4, 1.0, 0.993, 10, 50, 4_000_000, 4_000_000
_BITS = 10


def _alphabet() -> np.ndarray:
    """10-bit number of each code point below 0x3000: 0 never, 1 for a boundary, others for letters."""
    out = np.ones(0x3000, dtype=np.uint64)
    for p in range(0x3000):
        if chr(p).isalpha():
            out[p] = 2 + p % ((1 << _BITS) - 2)
    return out


def grams_of(column: pa.Array, alphabet: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed gram, row) of each letter and each word end; the newest character is in the low bits."""
    points, offsets = code_points(lower(column))
    ids = np.where(points < len(alphabet), alphabet[np.minimum(points, len(alphabet) - 1)], 2 + points % ((1 << _BITS) - 2)).astype(np.uint64)
    n = len(ids)
    if not n:
        return ids, np.zeros(0, dtype=np.int64)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    is_start = np.zeros(n, dtype=bool)
    is_start[starts] = True
    letter = ids > 1
    after = np.concatenate(([False], letter[:-1])) & ~is_start  # the character before is a letter of the row
    keep = letter | after
    place = np.arange(n)
    # characters of the word so far, this one included
    word = np.maximum.accumulate(np.where(letter & ~after, place, 0))
    seen = place - word + 1
    gram = ids.copy()
    for j in range(1, order):
        step = ids[: n - j] << np.uint64(_BITS * j)
        part = np.zeros(n, dtype=np.uint64)
        part[j:] = step
        # one place beyond the word's first letter stands the boundary before it
        part[seen == j] = np.uint64(1) << np.uint64(_BITS * j)
        part[seen < j] = 0
        gram |= part
    row = np.searchsorted(offsets, place[keep], side="right") - 1
    return gram[keep], row


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    names, at = np.unique(keys, return_inverse=True)
    return names, *[np.bincount(at, weights=v, minlength=len(names)).astype(np.int64) for v in values]


def _count(alphabet, order: int, flush: int = 1_000_000):
    names = ["gram", "toxic", "ordinary"]

    def out(held: Gather) -> pa.RecordBatch:
        gram, toxic, ordinary = _sum_by(*held.take())
        return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(toxic), pa.array(ordinary)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gather(flush)
        for batch in sub_batches(batches, "text"):
            gram, row = grams_of(batch.column("text"), alphabet, order)
            if not len(gram):
                continue
            label = np.asarray(batch.column("label"))[row]
            # one sort: the label rides in the two bits above the grams' 60
            key, count = np.unique(gram | (label.astype(np.uint64) << np.uint64(62)), return_counts=True)
            kind = (key >> np.uint64(62)).astype(np.int64)
            if held.add(key & np.uint64((1 << 62) - 1), np.where(kind == 1, count, 0), np.where(kind == 0, count, 0)):
                yield out(held)
        if held.size:
            yield out(held)

    return run


class Scores:
    """Log ratios by gram and by context, in an open hash table."""

    def __init__(self, order: int, grams: np.ndarray, ratios: np.ndarray, contexts: np.ndarray, defaults: np.ndarray):
        self.order = order
        self.tables = [self._table(grams, ratios), self._table(contexts, defaults)]

    @staticmethod
    def _table(keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        slots, held = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits, dtype=np.float32)
        place = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        todo = np.arange(len(keys))
        while len(todo):
            free = slots[place[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slots[place[todo[free]]] = keys[todo[free]]
            mine = slots[place[todo]] == keys[todo]
            held[place[todo[mine]]] = values[todo[mine]]
            todo = todo[~mine]
            place[todo] = (place[todo] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        return bits, slots, held

    @staticmethod
    def _find(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, slots, held = table
        place = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        value, found = np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        todo = np.arange(len(keys))
        while len(todo):
            there = slots[place]
            hit = there == keys[todo]
            value[todo[hit]], found[todo[hit]] = held[place[hit]], True
            on = ~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, place = todo[on], (place[on] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        return value, found

    def values(self, gram: np.ndarray) -> np.ndarray:
        """The log ratio of each gram, of its context where the gram is new."""
        value, found = self._find(self.tables[0], gram)
        lost = np.flatnonzero(~found)
        if len(lost):
            value[lost] = self._find(self.tables[1], gram[lost] >> np.uint64(_BITS))[0]
        return value

    def score(self, column: pa.Array, alphabet: np.ndarray) -> np.ndarray:
        gram, row = grams_of(column, alphabet, self.order)
        value = self.values(gram)
        n = np.bincount(row, minlength=len(column))
        return np.bincount(row, weights=value, minlength=len(column)) / (n + SHRINK)


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, below: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each gram, contexts, their back-off weights) over the probabilities one order below."""
    contexts, at = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
    total = np.bincount(at, weights=counts)
    back = np.bincount(at, weights=np.minimum(counts, discount))
    weight = np.where(total > 0, back / np.maximum(total, 1), 1.0)
    return np.where(total[at] > 0, np.maximum(counts - discount, 0) / np.maximum(total[at], 1) + weight[at] * below, below), contexts, weight


def train(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, discount: float = DISCOUNT) -> Scores:
    """The scores of the two class models over shared lower orders."""
    suffix = lambda k: grams & np.uint64((1 << (_BITS * k)) - 1)
    below = {0: np.full(1, 1 / 64)}
    keys, p = np.zeros(1, dtype=np.uint64), below[0]
    for k in range(1, order):
        own, left = np.unique(np.unique(suffix(k + 1)) & np.uint64((1 << (_BITS * k)) - 1), return_counts=True)
        base = p[np.searchsorted(keys, own & np.uint64((1 << (_BITS * (k - 1))) - 1))] if k > 1 else np.full(len(own), p[0])
        q, _, _ = _kneser_ney(own, left, base, 0.75)
        keys, p = own, q
    base = p[np.searchsorted(keys, suffix(order - 1))] if order > 1 else np.full(len(grams), p[0])
    out = []
    for counts in (toxic, ordinary):
        q, contexts, weight = _kneser_ney(grams, counts, base, discount)
        out.append((np.log(q), np.log(np.maximum(weight, 1e-9))))
    ratio, default = out[0][0] - out[1][0], out[0][1] - out[1][1]
    return Scores(order, grams, ratio.astype(np.float32), contexts, default.astype(np.float32))


def counted(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary) over the corpus."""
    marked = _marked(docs, labels).select("text", F.when(F.col("held") | F.col("toxic").isNull(), 2).otherwise(F.col("toxic")).cast("int").alias("label"))
    parts = marked.mapInArrow(_count(_alphabet(), order), "gram bigint, toxic bigint, ordinary bigint")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with toxic (null without a label) and held (is it a held-out ordinary document?)."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id IS NOT NULL AND toxic IN (0, 1)").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    return own.join(marks, own["doc_id"] == marks["__id"], "left").drop("__id").withColumn("held", F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(HELD_OUT)) == 0).withColumn("held", F.col("held") & F.col("toxic").eqNullSafe(F.lit(0)))


def _score(model, alphabet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = received(model)
        for batch in sub_batches(batches, "text"):
            s = scores.score(batch.column("text"), alphabet) if scores else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(s, pa.float64())], names=["doc_id", "lang", "score"])

    return run


def model_of(table: DataFrame, order: int = ORDER) -> Scores | None:
    """Train on the counts; None without labels of both classes."""
    got = table.toArrow()
    grams, toxic, ordinary = (np.asarray(got[c].combine_chunks()) for c in ("gram", "toxic", "ordinary"))
    if not len(grams) or not toxic.any() or not ordinary.any():
        return None
    at = np.argsort(grams)
    return train(grams[at].astype(np.uint64), toxic[at], ordinary[at], order)


def ratios(table: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(context, gram, value): what train() computes, as a table; the row of a context itself has a null gram."""
    suffix = lambda k: F.col("gram").bitwiseAND(F.lit((1 << (_BITS * k)) - 1))
    context = F.shiftrightunsigned("gram", _BITS)

    def mixed(count: str, total: str, back: str, d: float):
        return F.when(F.col(total) > 0, F.greatest(F.col(count) - d, F.lit(0.0)) / F.col(total) + F.col(back) / F.col(total) * F.col("below")).otherwise(F.col("below"))

    lower_order = None
    for k in range(1, order):
        own = table.select(suffix(k + 1).alias("gram")).distinct().groupBy(suffix(k).alias("gram")).agg(F.count(F.lit(1)).alias("n")).withColumn("context", context)
        total = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.least("n", F.lit(0.75))).alias("back"))
        own = own.join(total, "context")
        own = own.withColumn("below", F.lit(1 / 64)) if k == 1 else own.withColumn("suffix", suffix(k - 1)).join(lower_order, "suffix")
        lower_order = cut(own.select(F.col("gram").alias("suffix"), mixed("n", "total", "back", 0.75).alias("below")))
    classes = ("toxic", "ordinary")
    full = table.withColumn("context", context)
    sums = cut(full.groupBy("context").agg(*[x for c in classes for x in (F.sum(c).alias(f"{c}_total"), F.sum(F.least(F.col(c), F.lit(discount))).alias(f"{c}_back"))]))
    full = full.join(sums, "context")
    full = full.withColumn("below", F.lit(1 / 64)) if order == 1 else full.withColumn("suffix", suffix(order - 1)).join(lower_order, "suffix")
    value = [F.log(mixed(c, f"{c}_total", f"{c}_back", discount)) for c in classes]
    weight = [F.log(F.greatest(F.when(F.col(f"{c}_total") > 0, F.col(f"{c}_back") / F.col(f"{c}_total")).otherwise(1.0), F.lit(1e-9))) for c in classes]
    return full.select("context", "gram", (value[0] - value[1]).alias("value")).union(sums.select("context", F.lit(None).cast("bigint"), weight[0] - weight[1]))


_ASKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("size", pa.int32()), ("grams", pa.binary()), ("rows", pa.binary()), ("times", pa.binary()), ("texts", pa.binary())])
_SHARES = pa.schema([("batch", pa.int64()), ("sums", pa.binary()), ("texts", pa.binary())])


def _asked(alphabet, order: int, parts: int):
    """The distinct grams of each row, by the part of their context; ids, languages and sizes of a sub-batch go with one of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(sub_batches(batches, "text"), task):
            gram, row = grams_of(batch.column("text"), alphabet, order)
            n = np.bincount(row, minlength=batch.num_rows)
            texts = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(n)], names=["doc_id", "lang", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as writer:
                writer.write_batch(texts)
            yield rows(_ASKED, [(number % parts, number, batch.num_rows, None, None, None, sink.getvalue().to_pybytes())])
            at = np.lexsort((gram, row))
            gram, row = gram[at], row[at]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(gram)))
            gram, row = gram[first], row[first]
            by, bounds = split((mix64(gram >> np.uint64(_BITS)) % np.uint64(parts)).astype(np.int64), parts)
            yield rows(_ASKED, [(p, number, batch.num_rows, gram[o].tobytes(), row[o].astype(np.uint32).tobytes(), times[o].astype(np.uint32).tobytes(), None) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a for o in [by[a:b]]])

    return run


def _shares(left: pa.Table, right: pa.Table) -> pa.Table:
    """One part: what its grams add to the sums of each sub-batch's rows."""
    known, of, value = right["gram"], np.asarray(right["context"]).astype(np.uint64), np.asarray(right["value"]).astype(np.float32)
    own = np.asarray(known.is_valid())
    gram = np.asarray(known.drop_null()).astype(np.uint64)
    scores = Scores(0, gram, value[own], of[~own], value[~own])
    out = []
    for r in left.to_pylist():
        if r["texts"] is not None:
            out.append((r["batch"], None, r["texts"]))
            continue
        asked = np.frombuffer(r["grams"], dtype=np.uint64)
        got = scores.values(asked) * np.frombuffer(r["times"], dtype=np.uint32)
        out.append((r["batch"], np.bincount(np.frombuffer(r["rows"], dtype=np.uint32), weights=got, minlength=r["size"]).tobytes(), None))
    trim()
    return pa.Table.from_batches([rows(_SHARES, out)])


def _sums(table: pa.Table) -> pa.Table:
    texts = pa.ipc.open_stream(next(x for x in table["texts"].to_pylist() if x is not None)).read_all()
    total = np.zeros(texts.num_rows)
    for cell in table["sums"].to_pylist():
        if cell is not None:
            total += np.frombuffer(cell, dtype=np.float64)
    return pa.table({"doc_id": texts["doc_id"], "lang": texts["lang"], "score": pa.array(total / (np.asarray(texts["n"]) + SHRINK), pa.float64())})


def _score_by_parts(own: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, score) by the partitioned table of ratios."""
    parts = parts_of(own.sparkSession)
    alphabet = _alphabet()
    asked = own.mapInArrow(_asked(alphabet, order, parts), "part int, batch bigint, size int, grams binary, rows binary, times binary, texts binary")
    placed = ratios(table, order).mapInArrow(_placed(parts), "at int, context bigint, gram bigint, value double")
    shares = asked.groupBy("part").cogroup(placed.groupBy("at")).applyInArrow(_shares, "batch bigint, sums binary, texts binary")
    return shares.groupBy("batch").applyInArrow(_sums, "doc_id bigint, lang string, score double")


def _placed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = mix64(np.asarray(b.column("context")).astype(np.uint64)) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], names=["at", *b.schema.names])

    return run


def detect(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, lang, score, toxic) of every document (see the module)."""
    table = cut(counted(docs, labels, order))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    n, toxic, ordinary = table.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("ordinary")).first()
    fitted = bool(toxic and ordinary)
    if fitted and n > max_grams:
        scored = cut(_score_by_parts(own, table, order))
    else:
        model = model_of(table, order) if fitted else None
        scored = cut(own.mapInArrow(_score(send(docs.sparkSession, model), _alphabet()), "doc_id bigint, lang string, score double"))
    if not fitted:
        return scored.withColumn("toxic", F.lit(False))
    held = _marked(scored.withColumn("text", F.col("score")), labels).where("held").select("lang", F.col("text").alias("s"))
    pooled = held.agg(F.percentile_approx("s", 0.5, 10_000)).first()[0] or 0.0
    # one row a language; few, but their number is the data's, so the planner picks the join
    centre = held.groupBy("lang").agg(F.percentile_approx("s", 0.5, 10_000).alias("centre"))
    centred = lambda df, x: df.join(centre.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn(x, F.col(x) - F.coalesce("centre", F.lit(pooled))).drop("__lang", "centre")
    threshold = centred(held, "s").agg(F.percentile_approx("s", quantile, 10_000)).first()[0]
    out = centred(scored, "score")
    return out.select("doc_id", "lang", "score", (F.col("score") > F.lit(float("inf") if threshold is None else threshold)).alias("toxic"))
