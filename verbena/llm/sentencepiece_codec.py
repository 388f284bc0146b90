"""Operator 10: SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of a model holds a white-space marker after another character (and
the model normalises nothing but spaces), a text can be cut at the start of every
run of markers without changing its segmentation.  A chunk is such a marked word.

1. Each batch of texts sends its distinct chunks to hash parts, a part's chunks in
   one cell, and the places of its words in them, as numbers, to its own group.
2. A part meets each distinct chunk of the corpus, segments it once, the first time,
   and answers each batch with the ids of the batch's chunks.
3. A batch's answers meet its places: ids are joined back by position, from flat arrays.

So a distinct marked word of the corpus is segmented once.  Texts are split by Arrow;
only distinct words become Python strings.  A model whose pieces cross markers is
detected and segments whole texts.

Decoding goes from ids to bytes by flat tables: the bytes of all pieces are gathered
by position, markers become spaces and the first marker of a text is dropped.

Result: encode_decode() gives doc_id, ids, n_ids, decoded; decode() adds the text of a
column of ids.

Defined cases: a null text has null ids and a null decoding; an empty text has no ids;
a null doc_id stays; repeated rows are encoded one by one; a marker character (U+2581)
in a text reads as a space, as in the library; further columns are ignored by
encode_decode() and kept by decode(); an empty table gives no rows.  Of given ids, a null list
decodes to null, a null id to nothing, an id outside the vocabulary like the unknown piece,
and bytes that aren't UTF-8 to U+FFFD.  The model file's path is a parameter; its
bytes (one file, of fixed size) are broadcast.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .blobs import parts_of, planes, ragged, received, rows, send, split, sub_batches, trim, unplanes
from .textops import span_hashes, string_bytes

BATCH_BYTES = 8 << 20
MARK = "▁"


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits(sp) -> bool:
    """Can texts be cut before every run of markers?"""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sp.serialized_model_proto())
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
    return plain and not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def chunks_of(column: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct chunks, without their first marker; the place of each word in them; each row's number of words)."""
    texts = pc.fill_null(column, "")
    marked = pc.replace_substring(texts, MARK, " ")
    odd = np.asarray(pc.or_(pc.match_substring(marked, "  "), pc.or_(pc.starts_with(marked, " "), pc.ends_with(marked, " "))).to_numpy(zero_copy_only=False), dtype=bool)
    lists = pc.split_pattern(marked, " ")
    if odd.any():  # runs of spaces: a chunk takes all markers before it
        rows_ = lists.to_pylist()
        for i in np.flatnonzero(odd):
            rows_[i] = [x[1:] for x in re.findall(" +[^ ]+| +$", " " + marked[i].as_py())]
        lists = pa.array(rows_, pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    which = np.asarray(words.indices).astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
    empty = np.asarray(pc.equal(texts, "").to_numpy(zero_copy_only=False), dtype=bool)
    if empty.any():  # an empty text has no chunk
        which, sizes = which[~np.repeat(empty, sizes)], np.where(empty, 0, sizes)
    return words.dictionary, which, sizes


def joined(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray, sizes: np.ndarray, missing: pa.Array) -> pa.ListArray:
    """A list of ids for each text: the ids of its chunks, in order."""
    ids = flat[ragged(starts[which], counts[which])]
    ends = np.concatenate(([0], np.cumsum(counts[which])))[np.concatenate(([0], np.cumsum(sizes)))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=missing)


class Encoder:
    """Chunks and their ids, as flat arrays; made counts segmentations.  With max_chunks, encode() empties a larger table."""

    def __init__(self, sp, max_chunks: int | None = None):
        self.sp, self.max_chunks, self.by_chunk, self.made = sp, max_chunks, splits(sp), 0
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.counts = array("i"), array("q"), array("q")

    def chunks(self, words: list[str]) -> np.ndarray:
        """The place of each chunk in the table."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        self.made += len(new)
        for lo in range(0, len(new), 10_000):
            for w, ids in zip(new[lo : lo + 10_000], self.sp.encode(new[lo : lo + 10_000], num_threads=1)):
                if not w:
                    ids = [self.sp.piece_to_id(MARK)]  # a lone marker, which the library leaves out for an empty text
                self.place[w] = len(self.starts)
                self.starts.append(len(self.flat))
                self.counts.append(len(ids))
                self.flat.extend(ids)
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))

    def table(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the chunks at these places."""
        counts = np.array(np.frombuffer(self.counts, dtype=np.int64)[places] if len(places) else [], dtype=np.int64)
        starts = np.array(np.frombuffer(self.starts, dtype=np.int64)[places] if len(places) else [], dtype=np.int64)
        return np.array(np.frombuffer(self.flat, dtype=np.int32)[ragged(starts, counts)] if len(self.flat) else [], dtype=np.int32), counts

    def encode(self, column: pa.Array) -> pa.Array:
        """A list of ids for each text."""
        if not self.by_chunk:
            return pa.array([None if t is None else self.sp.encode(t, num_threads=1) for t in column.to_pylist()], pa.list_(pa.int32()))
        if self.max_chunks is not None and len(self.place) > self.max_chunks:
            self.clear()
        words, which, sizes = chunks_of(column)
        flat, counts = self.table(self.chunks(words.to_pylist()))
        return joined(flat, np.cumsum(counts) - counts, counts, which, sizes, pc.is_null(column))


class Decoder:
    """The bytes of all pieces, as flat arrays."""

    def __init__(self, sp):
        pieces = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                pieces.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                pieces.append(b"")
            elif sp.is_unknown(i):
                pieces.append(" ⁇ ".encode())
            else:
                pieces.append(piece.replace(MARK, " ").encode())
        self.unknown, self.size = sp.unk_id(), len(pieces)
        self.counts = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64)
        cells = ids.flatten()
        if cells.null_count:
            there = np.asarray(pc.is_valid(cells))
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
            cells = cells.drop_null()
        flat = np.asarray(cells).astype(np.int64)
        flat = np.where((flat >= 0) & (flat < self.size), flat, self.unknown)
        out = self.bytes[ragged(self.starts[flat], self.counts[flat])]
        row = np.repeat(np.arange(len(sizes)), sizes)
        length = np.bincount(row, weights=self.counts[flat], minlength=len(sizes)).astype(np.int64)
        ends = np.cumsum(length)
        begin = ends - length
        lead = begin[(length > 0)]
        lead = lead[out[lead] == 32]  # the marker put before every text
        keep = np.ones(len(out), dtype=bool)
        keep[lead] = False
        total = np.concatenate(([0], np.cumsum(keep)))
        offsets = np.concatenate(([0], total[ends])).astype(np.int64)
        data = out[keep].tobytes()
        try:
            data.decode()
            text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
            text.validate(full=True)
        except (UnicodeDecodeError, pa.ArrowInvalid):
            text = pa.array([data[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string())
        text = text.cast(pa.string())
        missing = pc.is_null(ids)
        return pc.if_else(missing, pa.scalar(None, pa.string()), text)


_ASKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("seal", pa.binary()), ("chunks", pa.binary())])
_PLACES = pa.schema([("batch", pa.int64()), ("seal", pa.binary()), ("which", pa.binary()), ("texts", pa.binary())])
_ANSWERS = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("seal", pa.binary()), ("made", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary())])
_ANSWERS_DDL = "batch bigint, part int, seal binary, made bigint, counts binary, ids binary"


def _small(cell: bytes) -> bytes:
    """A cell compressed, as the shuffle's own compression is light: its size, then Zstandard."""
    return len(cell).to_bytes(8, "big") + pa.compress(cell, codec="zstd", asbytes=True)


def _large(cell: bytes) -> bytes:
    return pa.decompress(cell[8:], int.from_bytes(cell[:8], "big"), codec="zstd", asbytes=True)


def _asked(parts: int, places: bool):
    """Texts -> each batch's distinct chunks by part or, with places, its doc_ids, sizes and words' places in the chunks.

    The two are made by passes of their own, so that the places, which are most of the bytes,
    are shuffled once.  A batch's seal is a digest of its chunks, by which _join() makes sure
    that both passes saw the same batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(sub_batches(batches, "text", BATCH_BYTES), task):
            words, which, sizes = chunks_of(batch.column("text"))
            rank = np.asarray(pc.sort_indices(words)).astype(np.int64)
            raw, offsets = string_bytes(words)
            part = (span_hashes(raw, offsets[:-1], offsets[1:]) % np.uint64(parts)).astype(np.int64)
            by, bounds = split(part[rank], parts)
            by = rank[by]  # by part, in alphabetical order, which compresses best
            seal = hashlib.md5(raw.tobytes() + offsets.tobytes()).digest()
            if places:
                place = np.empty(len(by), dtype=np.int64)
                place[by] = np.arange(len(by))
                texts = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int32)), pc.is_null(batch.column("text"))], names=["doc_id", "sizes", "missing"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, texts.schema) as writer:
                    writer.write_batch(texts)
                yield rows(_PLACES, [(number, seal, _small(planes(place[which])), _small(sink.getvalue().to_pybytes()))])
            else:
                words = words.take(pa.array(by)).to_pylist()
                yield rows(_ASKED, [(p, number, seal, _small(MARK.join(words[a:b]).encode())) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a])

    return run


def _segment(model):
    """One part's chunks -> the ids of each batch's chunks; a chunk is segmented when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(processor(received(model)))
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                made = encoder.made
                ids, counts = encoder.table(encoder.chunks(_large(r["chunks"]).decode().split(MARK)))
                out.append((r["batch"], r["part"], r["seal"], encoder.made - made, _small(planes(counts)), _small(planes(ids))))
            yield rows(_ANSWERS, out)
        trim()

    return run


def _join(model):
    """A batch's answers -> its documents with their ids and what these decode to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        decoder = Decoder(processor(received(model)))
        own, cells = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["part"])
        if any(r["seal"] != own["seal"] for r in cells):
            raise RuntimeError("the texts changed between two passes; write them first")
        texts = pa.ipc.open_stream(_large(own["texts"])).read_all()
        cat = lambda k: np.concatenate([np.zeros(0, dtype=np.int64), *(unplanes(_large(r[k])).astype(np.int64) for r in cells)])
        counts = cat("counts")
        ids = joined(cat("ids"), np.cumsum(counts) - counts, counts, unplanes(_large(own["which"])).astype(np.int64), np.asarray(texts["sizes"]).astype(np.int64), texts["missing"].combine_chunks())
        out = pa.table({"doc_id": texts["doc_id"], "ids": ids, "n_ids": pc.list_value_length(ids), "decoded": decoder.decode(ids)})
        trim()
        return out

    return run


def _whole(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(received(model))
        encoder, decoder = Encoder(sp), Decoder(sp)
        for batch in sub_batches(batches, "text"):
            ids = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pc.list_value_length(ids), decoder.decode(ids)], names=["doc_id", "ids", "n_ids", "decoded"])

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def chunk_answers(docs: DataFrame, model) -> DataFrame:
    """The parts' answers to all batches; made sums to the number of distinct chunks."""
    asked = _own(docs).mapInArrow(_asked(parts_of(docs.sparkSession), False), "part int, batch bigint, seal binary, chunks binary")
    return asked.groupBy("part").applyInArrow(_segment(model), _ANSWERS_DDL)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_ids, decoded) of every document."""
    with open(model_path, "rb") as f:
        content = f.read()
    model = send(docs.sparkSession, content)
    result = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, n_ids int, decoded string"
    if not splits(processor(content)):
        return _own(docs).mapInArrow(_whole(model), result)
    places = _own(docs).mapInArrow(_asked(parts_of(docs.sparkSession), True), "batch bigint, seal binary, which binary, texts binary")
    return places.groupBy("batch").cogroup(chunk_answers(docs, model).groupBy("batch")).applyInArrow(_join(model), result)


def decode(rows_: DataFrame, model_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The frame with the text of its column of ids."""
    with open(model_path, "rb") as f:
        model = send(rows_.sparkSession, f.read())

    @arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(processor(received(model)))
        for column in batches:
            yield decoder.decode(column.cast(pa.list_(pa.int64())))

    return rows_.withColumn(to, texts(F.col(ids).cast("array<bigint>")))
