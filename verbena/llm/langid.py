"""Operator 6: language identification by word-first backoff.

Training takes up to per_language labelled documents of each language (a bounded
sample, chosen by the hash of doc_id).  The executors count the words (runs of
letters, in lower case) of each language; the driver gets the summed table and counts
the character n-grams of 1 to 5 characters inside them.  A word is known when the
sample has it twice; n-grams are counted in all words.

Scoring looks each word up first: a known word adds its smoothed log frequency
in every language.  An unseen word backs off to its character n-grams of the
longest length, from 5 down to 1, of which any is known, and adds their mean log
frequency; a word without known n-grams adds nothing.  A document's score of a
language is the mean over its scored words; the best language wins (ties go to
the first in alphabetical order) and the margin is its lead over the second.

A document is rejected (lang_id "und") when no word can be scored or the margin
is below min_margin.

Defined cases: a null doc_id is scored like any other; a null, empty or wordless
text is "und" with margin 0; rows without a label, or with a blank one, don't
train; repeated rows are scored one by one; further columns are ignored (or
carried along by the filter); with no labelled row at all everything is "und";
an empty table gives no rows.  Whole texts are scored, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import ragged, received, send, sub_batches, trimmed
from .textops import lower, span_hashes, spans, string_bytes

PER_LANGUAGE, LONGEST, MIN_MARGIN = 400, 5, 0.05
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Table:
    """Log frequencies by key: one row for each sorted key, one column for each language."""

    keys: np.ndarray
    logs: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, label: np.ndarray, weight: np.ndarray, languages: int, smooth: float) -> Table:
        names, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at * languages + label, weights=weight, minlength=len(names) * languages).reshape(-1, languages)
        total = counts.sum(axis=0) + smooth * (len(names) + 1)
        return Table(names, np.log((counts + smooth) / total).astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of the words of each row."""
    raw, offsets = string_bytes(lower(column))
    return raw, *spans(raw, offsets, _LETTER)


def char_ngrams(raw: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every k-character gram of the words; shorter words have none."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    count = np.maximum(0, last - first - k + 1)
    word = np.repeat(np.arange(len(start)), count)
    i = ragged(first, count)
    edge = np.append(at, len(raw))
    return span_hashes(raw, edge[i], edge[i + k]), word


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def word_scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores by language, scored) of words in ascending order of place."""
        scores = np.zeros((len(keys), len(self.languages)), dtype=np.float32)
        found = self.words.find(keys)
        known = found >= 0
        scores[known] = self.words.logs[found[known]]
        todo = np.flatnonzero(~known)
        for k in range(LONGEST, 0, -1):
            if not len(todo):
                break
            grams, word = char_ngrams(raw, start[todo], end[todo], k)
            found = self.grams[k].find(grams)
            word, found = word[found >= 0], found[found >= 0]
            if not len(word):
                continue
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(word)))
            sums = np.add.reduceat(self.grams[k].logs[found], first, axis=0)
            scores[todo[word[first]]] = sums / count[:, None]
            known[todo[word[first]]] = True
            todo = todo[~known[todo]]
        return scores, known

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean scores by language, scored words) of each row, and the number of its words."""
        raw, start, end, row = letters(column)
        n, m = len(column), len(self.languages)
        if not len(start) or not m:
            return np.zeros((n, m)), np.zeros(n, dtype=np.int64), np.bincount(row, minlength=n)
        keys = span_hashes(raw, start, end)
        names, first, which = np.unique(keys, return_index=True, return_inverse=True)
        order = np.argsort(first)
        scores, known = np.empty((len(names), m), dtype=np.float32), np.empty(len(names), dtype=bool)
        scores[order], known[order] = self.word_scores(raw, start[first[order]], end[first[order]], names[order])
        out = np.empty((n, m))
        weight = known[which]
        for c in range(m):
            out[:, c] = np.bincount(row, weights=scores[which, c], minlength=n)
        scored = np.bincount(row[weight], minlength=n)
        return out / np.maximum(1, scored)[:, None], scored, np.bincount(row, minlength=n)

    def classify(self, column: pa.Array, min_margin: float = MIN_MARGIN) -> tuple[list[str], np.ndarray]:
        """(language or "und", margin) of each row."""
        scores, scored, _ = self.score(column)
        if not len(self.languages):
            return ["und"] * len(column), np.zeros(len(column))
        best = scores.argmax(axis=1)
        if len(self.languages) > 1:
            top = np.sort(scores, axis=1)
            margin = top[:, -1] - top[:, -2]
        else:
            margin = np.full(len(scored), np.inf)
        margin = np.where(scored > 0, margin, 0.0)
        good = (scored > 0) & (margin >= min_margin)
        return [self.languages[b] if g else "und" for b, g in zip(best, good)], np.where(np.isinf(margin), 99.0, margin)


def fit(texts: pa.Array, labels: list[str]) -> Model:
    """The model of labelled texts."""
    languages = sorted(set(labels))
    if not languages:
        bare = Table(np.zeros(0, dtype=np.uint64), np.zeros((0, 0), dtype=np.float32))
        return Model([], bare, {k: bare for k in range(1, LONGEST + 1)})
    code = np.array([languages.index(x) for x in labels], dtype=np.int64)
    raw, start, end, row = letters(texts)
    m = len(languages)
    keys = span_hashes(raw, start, end)
    names, first, which = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first)  # the distinct words in ascending order of place
    start, end, names = start[first[order]], end[first[order]], names[order]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    counts = np.bincount(place[which] * m + code[row], minlength=len(names) * m).reshape(-1, m)
    return _model(languages, raw, start, end, names, counts)


def _model(languages: list[str], raw: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray, counts: np.ndarray) -> Model:
    """The model of distinct words in ascending order of place, and their counts by language."""
    m = len(languages)

    def table(hashes: np.ndarray, word: np.ndarray, smooth: float) -> Table:
        at, label = np.nonzero(counts[word])
        return Table.of(hashes[at], label, counts[word[at], label], m, smooth)

    common = np.flatnonzero(counts.sum(axis=1) >= 2)
    words = table(names[common], common, 0.1)
    grams = {k: table(*char_ngrams(raw, start, end, k), 0.5) for k in range(1, LONGEST + 1)}
    return Model(languages, words, grams)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each sub-batch."""
    for batch in sub_batches(batches, "text"):
        raw, start, end, row = letters(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        own, names = np.asarray(lang.indices)[row], lang.dictionary.to_pylist()
        keys = span_hashes(raw, start, end)
        for c, name in enumerate(names):
            mine = np.flatnonzero(own == c)
            _, first, n = np.unique(keys[mine], return_index=True, return_counts=True)
            at = mine[first]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([raw[a:b].tobytes().decode() for a, b in zip(start[at], end[at])], pa.string()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most per_language labelled documents of each language."""
    labelled = docs.select("doc_id", "lang", "text").where("trim(lang) <> '' AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit(pa.array([], pa.string()), [])
    # a little over the expected number, cut to the bound by the same hash
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.3 * per_language / n + 20 / n))) for k, n in sorted(counts.items())])
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30))
    sample = labelled.where(place < share * (1 << 30)).withColumn("place", place)
    first = Window.partitionBy("lang").orderBy("place", F.coalesce("doc_id", F.lit(0)), "text")
    sample = sample.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("lang", "text")
    table = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(counts)
    distinct = pa.compute.unique(table["word"].combine_chunks())
    word = np.asarray(pa.compute.index_in(table["word"].combine_chunks(), distinct), dtype=np.int64)
    code = np.asarray(pa.compute.index_in(table["lang"].combine_chunks(), pa.array(languages, pa.string())), dtype=np.int64)
    raw, start, end, _ = letters(distinct)
    m = len(languages)
    by = np.bincount(word * m + code, weights=np.asarray(table["n"]), minlength=len(distinct) * m).astype(np.int64).reshape(-1, m)
    return _model(languages, raw, start, end, span_hashes(raw, start, end), by)


def _classify(model, min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(model)
        for batch in sub_batches(batches, "text"):
            languages, margin = own.classify(batch.column("text"), min_margin)
            keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in keep], pa.array(languages, pa.string()), pa.array(margin, pa.float64())], names=[*[n for n, _ in keep], "lang_id", "margin"])

    return run


def identify(docs: DataFrame, model: Model | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang, lang_id, margin) of every document; the model's size is set by its training sample's bound."""
    model = send(docs.sparkSession, model or train(docs))
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "lang", "text").mapInArrow(_classify(model, min_margin), f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, lang_id string, margin double")


def _keep(model, min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(model)
        for batch in sub_batches(batches, "text"):
            languages, _ = own.classify(batch.column("text"), min_margin)
            yield batch.filter(pa.array([x != "und" for x in languages], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that aren't rejected, columns as they are."""
    model = send(docs.sparkSession, model or train(docs))
    return docs.mapInArrow(trimmed(_keep(model, min_margin)), docs.schema)
