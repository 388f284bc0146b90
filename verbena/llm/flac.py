"""Operator 7: FLAC media columns.

decode() reads a FLAC stream: STREAMINFO, then frames with either block strategy,
all channel assignments (independent, left/side, right/side, mid/side), subframes of
all four kinds (constant, verbatim, fixed and linear prediction of order 1 to 32),
wasted bits, and Rice residuals of both codings with escaped partitions.  The header's
CRC-8, the frame's CRC-16 and the stream's MD5 are verified.  Each frame becomes one
PCM block with the number of its first sample, so a seek to a sample is a search by
first_sample.

A stream is read through a window of a few frames, so that decoding holds the stream
itself and about WINDOW bytes' bits, whatever its length; blocks leave as they are
decoded.  The residual's places in the bit stream come from one pass that jumps from
stop bit to stop bit; quotients and remainders are then gathered with numpy, and fixed
predictors are undone by repeated sums.

write_blocks() stores the blocks in the order of (id, first_sample) with the sample
after each, in small row groups; seek_file() reads only the row groups whose statistics
admit the sample.

encode() writes such streams from PCM (the tables hold no audio): it tries constant,
fixed 0 to 4, a least-squares linear predictor, and verbatim, and takes the cheapest,
with one Rice parameter for each of up to 8 partitions.

Defined cases: a null id stays; a null stream gives no block; a stream that isn't
FLAC, is cut short, or fails a checksum gives one row with its error and no samples
after the last sound frame (which are given); a stream without frames gives no block;
repeated rows decode one by one; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import operator
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import trim

BLOCK, RATE = 128, 16_000
#: Bytes of a stream whose bits are held at a time; bytes of PCM in a batch of blocks.
WINDOW, BATCH_BYTES = 1 << 16, 4 << 20
RESULT = "id bigint, block int, first_sample bigint, samples int, channels int, sample_rate int, bits int, pcm binary, error string"


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes, table: list[int]) -> int:
    c = 0
    for b in data:
        c = table[c ^ b]
    return c


def crc16(data: bytes, table: list[int]) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


class Bits:
    """Bits of a byte string, read by numpy through a window of it."""

    def __init__(self, data: bytes, start: int = 0, window: int = 1 << 16):
        self.whole, self.window = data, window
        self.open(start)

    def open(self, start: int) -> None:
        """Put the window at this byte."""
        self.start = start
        self.data = self.whole[start : start + self.window]
        self.last = start + len(self.data) == len(self.whole)
        self.bits = np.unpackbits(np.frombuffer(self.data, dtype=np.uint8))
        self.end = n = len(self.bits)
        self.at = 0
        nxt = np.where(self.bits, np.arange(n, dtype=np.int32), np.int32(n))
        self.next_one = array("i", np.minimum.accumulate(nxt[::-1])[::-1].tobytes())

    def place(self) -> int:
        """The byte of the whole string at which the next bit stands."""
        return self.start + self.at // 8

    def take(self, count: int) -> int:
        if self.at + count > self.end:
            raise EOFError("the stream ends inside a frame")
        value = int.from_bytes(self.data[self.at // 8 : (self.at + count + 7) // 8], "big")
        value >>= -(self.at + count) % 8
        self.at += count
        return value & ((1 << count) - 1)

    def signed(self, count: int) -> int:
        v = self.take(count)
        return v - (1 << count) if count and v >> (count - 1) else v

    def unary(self) -> int:
        stop = self.next_one[self.at] if self.at < self.end else self.end
        if stop >= self.end:
            raise EOFError("the stream ends inside a frame")
        q = stop - self.at
        self.at = stop + 1
        return q

    def gather(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Unsigned numbers of width bits at the places."""
        out = np.zeros(len(starts), dtype=np.int64)
        for b in range(width):
            out = (out << 1) | self.bits[starts + b]
        return out

    def rice(self, count: int, k: int) -> np.ndarray:
        """count Rice numbers of parameter k, unfolded to signed ones."""
        nxt, at, end, stops = self.next_one, self.at, self.end, []
        step = 1 + k
        for _ in range(count):
            if at >= end:
                raise EOFError("the stream ends inside a frame")
            q = nxt[at]
            stops.append(q)
            at = q + step
        if at > end:
            raise EOFError("the stream ends inside a frame")
        stop = np.array(stops, dtype=np.int64)
        begin = np.concatenate(([self.at], stop[:-1] + step)) if count else stop
        value = ((stop - begin) << k) | self.gather(stop + 1, k) if count else stop
        self.at = at
        return (value >> 1) ^ -(value & 1)

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _residual(bits: Bits, size: int, order: int) -> np.ndarray:
    coding = bits.take(2)
    if coding > 1:
        raise ValueError("reserved residual coding")
    width = 4 + coding
    parts = 1 << bits.take(4)
    if size % parts or size // parts < order:
        raise ValueError("the partitions don't fit the block")
    out = []
    for p in range(parts):
        count = size // parts - (order if p == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            starts = bits.at + raw * np.arange(count)
            if bits.at + raw * count > bits.end:
                raise EOFError("the stream ends inside a frame")
            v = bits.gather(starts, raw)
            out.append(v - ((v >> (raw - 1)) << raw) if raw else v)
            bits.at += raw * count
        else:
            out.append(bits.rice(count, k))
    return np.concatenate(out)


def _fixed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undo the fixed predictor of order len(warm) by repeated sums."""
    order = len(warm)
    heads = [warm]
    for _ in range(order):
        heads.append(np.diff(heads[-1]))
    x = residual
    for d in range(order - 1, -1, -1):
        # differences of order d: their last known value, then the sums
        x = np.cumsum(np.concatenate((heads[d][-1:], x)))[1:]
    return np.concatenate((warm, x))


def _linear(warm: list[int], coefficients: list[int], shift: int, residual: np.ndarray) -> np.ndarray:
    out = list(warm)
    back = coefficients[::-1]
    for n, r in enumerate(residual.tolist()):
        out.append(r + (sum(map(operator.mul, back, out[n:])) >> shift))
    return np.array(out, dtype=np.int64)


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe begins with a 1")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), dtype=np.int64)
    elif kind == 1:
        if bits.at + depth * size > bits.end:
            raise EOFError("the stream ends inside a frame")
        v = bits.gather(bits.at + depth * np.arange(size), depth)
        out = v - ((v >> (depth - 1)) << depth)
        bits.at += depth * size
    elif 8 <= kind <= 12:
        warm = np.array([bits.signed(depth) for _ in range(kind - 8)], dtype=np.int64)
        out = _fixed(warm, _residual(bits, size, kind - 8))
    elif kind >= 32:
        order = kind - 31
        warm = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        coefficients = [bits.signed(precision) for _ in range(order)]
        out = _linear(warm, coefficients, shift, _residual(bits, size, order))
    else:
        raise ValueError("reserved subframe")
    return out << wasted


def _coded_number(bits: Bits) -> int:
    first = bits.take(8)
    if first < 0x80:
        return first
    more = 7 - (first ^ 0xFF).bit_length()
    value = first & ((1 << (6 - more)) - 1) if more < 6 else 0
    for _ in range(more):
        value = (value << 6) | (bits.take(8) & 0x3F)
    return value


def _frame(bits: Bits, depth: int, block_size: int, tables: tuple) -> tuple[int, np.ndarray, int]:
    """(first sample, PCM (samples, channels), bits a sample) of the frame at the place."""
    begin = bits.at // 8
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame at its place")
    variable = bits.take(1)
    size_code, rate_code, mode, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    number = _coded_number(bits)
    size = {1: 192, 6: None, 7: None}.get(size_code, 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8) if size_code >= 8 else 0)
    if size_code in (6, 7):
        size = bits.take(8 if size_code == 6 else 16) + 1
    if not size:
        raise ValueError("reserved block size")
    if rate_code in (12, 13, 14):
        bits.take(8 if rate_code == 12 else 16)
    head = bits.data[begin : bits.at // 8]
    if bits.take(8) != crc8(head, tables[0]):
        raise ValueError("the header fails its CRC-8")
    own = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth_code]
    if mode < 8:
        sides = [_subframe(bits, size, own) for _ in range(mode + 1)]
    elif mode <= 10:
        a, b = _subframe(bits, size, own + (mode == 9)), _subframe(bits, size, own + (mode in (8, 10)))
        if mode == 8:
            sides = [a, a - b]
        elif mode == 9:
            sides = [a + b, b]
        else:
            mid = (a << 1) | (b & 1)
            sides = [(mid + b) >> 1, (mid - b) >> 1]
    else:
        raise ValueError("reserved channel assignment")
    bits.align()
    body = bits.data[begin : bits.at // 8]
    if bits.take(16) != crc16(body, tables[1]):
        raise ValueError("the frame fails its CRC-16")
    return (number if variable else number * block_size), np.stack(sides, axis=1), own


def frames(data: bytes, tables: tuple, window: int = WINDOW) -> Iterator[tuple]:
    """(first sample, PCM, rate, bits, None) of each frame as it is decoded, and (None, None, None, None, error) if the stream is damaged."""
    failed = lambda why: (None, None, None, None, why)
    if data[:4] != b"fLaC":
        yield failed("not a FLAC stream")
        return
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            yield failed("the stream ends inside its metadata")
            return
        last, kind, size = bool(data[at] >> 7), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        yield failed("no STREAMINFO")
        return
    block_size = int.from_bytes(info[:2], "big")
    packed = int.from_bytes(info[10:18], "big")
    rate, depth, total = packed >> 44, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
    bits, position, digest = Bits(data, at, window), 0, hashlib.md5()
    while bits.place() < len(data):
        begin = bits.place()
        try:
            first, pcm, own = _frame(bits, depth, block_size, tables)
        except (ValueError, EOFError, KeyError, IndexError) as e:
            if not bits.last:  # the frame may go on beyond the window: move it there, or make it larger
                if bits.start == begin:
                    bits.window *= 2
                bits.open(begin)
                continue
            yield failed(str(e) or "damaged")
            return
        digest.update(pack_pcm(pcm, -(-own // 8)))
        position += len(pcm)
        yield first, pcm, rate, own, None
    if total and position != total:
        yield failed("the stream ends early")
    elif any(info[18:34]) and digest.digest() != info[18:34]:
        yield failed("the samples fail the stream's MD5")


def decode(data: bytes, tables: tuple, window: int = WINDOW) -> tuple[list[tuple], str | None]:
    """(blocks of (first sample, PCM (samples, channels), rate, bits), error) of a stream."""
    got = list(frames(data, tables, window))
    error = got.pop()[4] if got and got[-1][4] else None
    return [f[:4] for f in got], error


def pack_pcm(pcm: np.ndarray, width: int) -> bytes:
    """Interleaved little-endian samples of width bytes."""
    return np.ascontiguousarray(pcm.astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


class _Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, count: int) -> None:
        self.value = (self.value << count) | (value & ((1 << count) - 1))
        self.size += count

    def put_bits(self, bits: np.ndarray) -> None:
        pad = -len(bits) % 8
        if len(bits):
            self.put(int.from_bytes(np.packbits(np.concatenate((np.zeros(pad, np.uint8), bits))).tobytes(), "big"), len(bits))

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")


def _rice_bits(residual: np.ndarray, order: int, size: int) -> np.ndarray | None:
    """The residual section: Rice partitions, each with its best parameter."""
    u = (residual << 1) ^ (residual >> 63)
    power = 3 if size % 8 == 0 and size // 8 > order else 0
    head = _Writer()
    head.put(0, 2)
    head.put(power, 4)
    out, lo = [_as_bits(head)], 0
    for p in range(1 << power):
        count = (size >> power) - (order if p == 0 else 0)
        part = u[lo : lo + count]
        lo += count
        costs = [int((part >> k).sum()) + count * (k + 1) for k in range(15)]
        k = int(np.argmin(costs))
        if costs[k] > 64 * max(1, count):
            return None
        w = _Writer()
        w.put(k, 4)
        q = part >> k
        ends = np.cumsum(q + 1 + k)
        bits = np.zeros(int(ends[-1]) if count else 0, dtype=np.uint8)
        stop = ends - k - 1
        bits[stop] = 1
        for b in range(k):
            bits[stop + 1 + b] = (part >> (k - 1 - b)) & 1
        out += [_as_bits(w), bits]
    return np.concatenate(out)


def _as_bits(w: _Writer) -> np.ndarray:
    return np.unpackbits(np.frombuffer(w.bytes(), dtype=np.uint8))[: w.size]


def _number_bits(values, depth: int) -> np.ndarray:
    v = np.asarray(values, dtype=np.int64)
    return ((v[:, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1)


def _encode_subframe(x: np.ndarray, depth: int, linear: int) -> np.ndarray:
    size = len(x)
    head = lambda kind: np.array([0, *((kind >> b) & 1 for b in range(5, -1, -1)), 0], dtype=np.uint8)
    if (x == x[0]).all():
        return np.concatenate((head(0), _number_bits(x[:1], depth)))
    tries = [np.concatenate((head(1), _number_bits(x, depth)))]
    diff, best = x, None
    for order in range(min(5, size)):
        total = int(np.abs(diff).sum())
        if best is None or total < best[0]:
            best = (total, order, diff)
        diff = np.diff(diff)
    body = _rice_bits(best[2], best[1], size)
    if body is not None:
        tries.append(np.concatenate((head(8 + best[1]), _number_bits(x[: best[1]], depth), body)))
    if linear and size > 4 * linear:
        rows = np.stack([x[linear - 1 - j : size - 1 - j] for j in range(linear)], axis=1).astype(float)
        solved = np.linalg.lstsq(rows, x[linear:].astype(float), rcond=None)[0]
        shift = 10
        c = np.clip(np.round(solved * (1 << shift)), -8192, 8191).astype(np.int64)
        guess = (rows.astype(np.int64) * c).sum(axis=1) >> shift
        body = _rice_bits(x[linear:] - guess, linear, size)
        if body is not None:
            w = _Writer()
            w.put(13, 4)  # coefficients of 14 bits
            w.put(shift, 5)
            tries.append(np.concatenate((head(31 + linear), _number_bits(x[:linear], depth), _as_bits(w), _number_bits(c, 14), body)))
    return min(tries, key=len)


def encode(pcm: np.ndarray, tables: tuple, rate: int = RATE, depth: int = 16, block: int = BLOCK, linear: int = 4) -> bytes:
    """A FLAC stream of PCM (samples, channels); two channels are coded mid/side where that is shorter."""
    n, channels = pcm.shape
    info = block.to_bytes(2, "big") * 2 + bytes(6) + ((rate << 44) | ((channels - 1) << 41) | ((depth - 1) << 36) | n).to_bytes(8, "big") + hashlib.md5(pack_pcm(pcm, -(-depth // 8))).digest()
    out = [b"fLaC", b"\x80" + len(info).to_bytes(3, "big"), info]
    for number, lo in enumerate(range(0, n, block)):
        x = pcm[lo : lo + block].astype(np.int64)
        mode, sides = channels - 1, [_encode_subframe(x[:, c], depth, linear) for c in range(channels)]
        if channels == 2:
            mid, side = (x[:, 0] + x[:, 1]) >> 1, x[:, 0] - x[:, 1]
            other = [_encode_subframe(mid, depth, linear), _encode_subframe(side, depth + 1, linear)]
            if sum(map(len, other)) < sum(map(len, sides)):
                mode, sides = 10, other
        w = _Writer()
        w.put(0x7FFC, 15)
        w.put(0, 1)
        w.put(7, 4)
        w.put(0, 4)
        w.put(mode, 4)
        w.put(0, 4)
        w.put(int.from_bytes(_utf8(number), "big"), 8 * len(_utf8(number)))
        w.put(len(x) - 1, 16)
        head = w.bytes()
        w.put(crc8(head, tables[0]), 8)
        w.put_bits(np.concatenate(sides))
        body = w.bytes()
        out += [body, crc16(body, tables[1]).to_bytes(2, "big")]
    return b"".join(out)


def _utf8(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    tail = []
    lead = 0x3F
    while v > lead:
        tail.append(0x80 | (v & 0x3F))
        v >>= 6
        lead >>= 1
    return bytes([(~(lead * 2 + 1) & 0xFF) | v, *reversed(tail)])


def _decode(tables: tuple):
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for b, (first, pcm, rate, bits, error) in enumerate(frames(data, tables) if data is not None else ()):
                    if error:
                        out.append((key, b, None, 0, None, None, None, None, error))
                    else:
                        out.append((key, b, first, len(pcm), pcm.shape[1], rate, bits, pack_pcm(pcm, -(-bits // 8)), None))
                        held += len(out[-1][7]) + 200
                    if held >= BATCH_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
            trim()
        yield batch_of(out)

    return run


def decode_column(media: DataFrame, id: str = "id", stream: str = "flac") -> DataFrame:
    """PCM blocks of a column of FLAC streams (see the module)."""
    return media.select(F.col(id).cast("bigint").alias("id"), F.col(stream).alias("flac")).mapInArrow(_decode((_CRC8, _CRC16)), RESULT)


def seek(blocks: DataFrame, sample: int) -> DataFrame:
    """The block of each stream that holds a sample, with the sample's place in it."""
    return blocks.where((F.col("first_sample") <= sample) & (F.lit(sample) < F.col("first_sample") + F.col("samples"))).withColumn("place", F.lit(sample) - F.col("first_sample"))


def write_blocks(blocks: DataFrame, path: str, row_group: int = 1 << 20) -> None:
    """The sound blocks as Parquet in the order of (id, first_sample), with end_sample, in row groups of about row_group bytes."""
    sound = blocks.where("error IS NULL").withColumn("end_sample", F.col("first_sample") + F.col("samples"))
    sorted_ = sound.repartitionByRange("id", "first_sample").sortWithinPartitions("id", "first_sample")
    sorted_.write.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", 10).parquet(path)


def seek_file(spark: SparkSession, path: str, id: int, sample: int) -> DataFrame:
    """The block of a stream that holds a sample, from a table of write_blocks(); both bounds reach the scan as pushed filters."""
    found = spark.read.parquet(path).where((F.col("id") == id) & (F.col("first_sample") <= sample) & (F.col("end_sample") > sample))
    return found.withColumn("place", F.lit(sample) - F.col("first_sample"))


def signal(vector: np.ndarray, samples: int = 256) -> np.ndarray:
    """A two-channel 16-bit clip of a vector: its components as amplitudes of partials."""
    t = np.arange(samples)[:, None]
    k = np.arange(1, len(vector) + 1)[None, :]
    left = (np.sin(2 * np.pi * k * t / samples) * vector).sum(axis=1)
    right = (np.cos(2 * np.pi * k * t / samples) * vector).sum(axis=1)
    return np.clip(np.round(np.stack((left, right), axis=1) * 4000), -32768, 32767).astype(np.int64)


def _synthesise(tables: tuple, block: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = sorted((r["vec_id"] or 0, np.nan_to_num(np.array(r["embedding"], dtype=float)).tolist()) for r in table.to_pylist() if r["embedding"] is not None)
        clip = encode(np.concatenate([signal(np.array(v)) for _, v in vectors]), tables, block=block) if vectors else None
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "flac": pa.array([clip], pa.binary())})

    return run


def media_of(vectors: DataFrame, per_clip: int = 1, block: int = BLOCK) -> DataFrame:
    """(id, flac): a media column synthesised from vectors, as the tables hold no audio.

    A clip is the sound of per_clip vectors, whose vec_id divided by per_clip is its id, in
    the order of vec_id; null vectors are left out, and a clip of null vectors only is null.
    """
    own = vectors.select(F.floor(F.col("vec_id") / per_clip).cast("bigint").alias("id"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return own.groupBy("id").applyInArrow(_synthesise((_CRC8, _CRC16), block), "id bigint, flac binary")
