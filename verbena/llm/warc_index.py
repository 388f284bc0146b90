"""Operator 3: WARC captures with a two-level index.

Building: pages are range-partitioned and sorted by reversed-host URL key, and each
partition writes one WARC file, a gzip member a record, and one index file: the
sorted key lines in compressed blocks of block_lines lines.  The sparse directory has
one row a block (first key, place, length); above it stands one row a file with its
first and last key.  Files go to the shared folder under names no other attempt
uses, so a lost task leaves nothing that a directory row names.

Lookup: a binary search over the files' first and last keys sends each key to the files
that may hold it (the table of files is sent along while it is small, joined else), one
group a file, which AQE doesn't merge; there a binary
search over the sparse directory gives the blocks, each is read by range and
decompressed once, a second binary search finds the lines, and each record is read by
range from its WARC file, decompressed and checked against its SHA-1.

The key is the host without "www.", reversed at the dots and joined by commas, ")",
and path and query; scheme, user, port and fragment don't count, case counts after the
host only.  "https://www.Example.com/a?b=1#c" gives "com,example)/a?b=1".

Defined cases: rows with a null url or html take no part, a null page_id stays; an
empty html is a record of length 0; control characters of a url stand in the record's
header as %XX, while the index keeps the url as it is (backslashes escape tabs and line
feeds there); a url without a host has the key ")" and its
path; captures of one key are all found, by page_id; repeated rows are captures of
their own; further columns are ignored; an empty table gives an empty index and no
rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blobs import cut, new_path, parts_of, received, send, trim

#: The table of files travels to the executors while its keys take at most so many bytes.
BLOCK_LINES, FILE_BYTES = 512, 64 << 20
_BLOCKS = "file string, warc string, block int, first_key string, last_key string, offset bigint, length bigint, lines int"
_FOUND = "url_key string, page_id bigint, url string, html string, block int"


def url_key(url: Column) -> Column:
    """The reversed-host key of a URL."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    tail = F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"^www\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail))


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(url: str, page_id, html: str) -> tuple[bytes, str]:
    """(WARC response record, SHA-1 of its payload)."""
    payload = html.encode()
    digest = hashlib.sha1(payload).hexdigest()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n", digest


def payload_of(raw: bytes) -> bytes:
    """The payload of a record, checked against its digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    if "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return payload


def _write(folder: str, block_lines: int):
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, warc, index = uuid.uuid4().hex, None, None
        lines: list[str] = []
        keys: list[str] = []
        directory: list[tuple] = []
        at = place = 0

        def flush() -> None:
            nonlocal place
            if lines:
                block = _gzip("\n".join(lines).encode())
                index.write(block)
                directory.append((f"{name}.cdx", f"{name}.warc.gz", len(directory), keys[0], keys[-1], place, len(block), len(lines)))
                place += len(block)
                lines.clear()
                keys.clear()

        for batch in batches:
            if batch.num_rows and warc is None:
                system.create_dir(root, recursive=True)
                warc, index = system.open_output_stream(f"{root}/{name}.warc.gz", compression=None), system.open_output_stream(f"{root}/{name}.cdx", compression=None)
            for key, page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                raw, _ = record(url, page, html)
                raw = _gzip(raw)
                warc.write(raw)
                lines.append("\t".join((_escaped(key), "" if page is None else str(page), _escaped(url), str(at), str(len(raw)))))
                keys.append(key)
                at += len(raw)
                if len(lines) == block_lines:
                    flush()
        if warc is not None:
            flush()
            warc.close()
            index.close()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in directory], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=names)

    return run


def build(pages: DataFrame, block_lines: int = BLOCK_LINES, folder: str | None = None) -> tuple[DataFrame, str]:
    """(sparse directory, folder) of an index over all pages."""
    spark = pages.sparkSession
    folder = folder or new_path(spark)
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    rows = pages.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html").where("url IS NOT NULL AND html IS NOT NULL")
    rows = rows.repartitionByRange(parts_of(spark), "url_key").sortWithinPartitions("url_key", "page_id", "url")
    return cut(rows.mapInArrow(_write(folder, block_lines), _BLOCKS)), folder


def _escaped(x: str) -> str:
    """Without tabs and line feeds."""
    return x.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _plain(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), x) if "\\" in x else x


def _find(folder: str):
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("block", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        system, root = fs.FileSystem.from_uri(folder)
        blocks = sorted(left.to_pylist(), key=lambda b: b["block"])
        # keys sort by code point here as they do by bytes in Spark
        first, last = [b["first_key"] for b in blocks], [b["last_key"] for b in blocks]
        out: list[tuple] = []
        held, lines, keys = -1, [], []
        with system.open_input_file(f"{root}/{blocks[0]['file']}") as index, system.open_input_file(f"{root}/{blocks[0]['warc']}") as warc:
            for key in sorted(set(right["url_key"].to_pylist())):
                b = max(0, bisect.bisect_left(first, key) - 1)  # the key may begin at the end of the block before
                while b < len(blocks) and last[b] < key:
                    b += 1
                while b < len(blocks) and first[b] <= key:
                    if held != b:
                        text = zlib.decompress(index.read_at(blocks[b]["length"], blocks[b]["offset"]), 31).decode()
                        lines = [x.split("\t") for x in text.split("\n")]
                        keys = [_plain(x[0]) for x in lines]
                        held = b
                    for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                        _, page, url, at, size = lines[i]
                        out.append((key, int(page) if page else None, _plain(url), payload_of(warc.read_at(int(size), int(at))).decode(), blocks[b]["block"]))
                    b += 1
        trim()
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def lookup(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """(url_key, page_id, url, html, block) of all captures of the keys (a frame with url_key)."""
    spark = directory.sparkSession
    files = cut(directory.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")))
    asked = keys.select("url_key").where("url_key IS NOT NULL").distinct()
    size = files.agg(F.sum(F.length("low") + F.length("high") + 64)).first()[0] or 0
    if size <= FILE_BYTES:
        table = sorted((r.low, r.high, r.file) for r in files.collect())
        asked = asked.mapInArrow(_placed(send(spark, tuple(zip(*table)))), "in_file string, url_key string")
    else:
        asked = asked.join(files, (F.col("url_key") >= F.col("low")) & (F.col("url_key") <= F.col("high"))).select(F.col("file").alias("in_file"), "url_key")
    parts = parts_of(spark)
    return directory.repartition(parts, "file").groupBy("file").cogroup(asked.repartition(parts, "in_file").groupBy("in_file")).applyInArrow(_find(folder), _FOUND)


def _placed(sent):
    """Keys -> (file that may hold the key, key): files are ranges in the order of keys, so their last keys ascend too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = received(sent)
        low, high, file = table or ((), (), ())
        for batch in batches:
            names, asked = [], []
            for key in batch.column(0).to_pylist():
                k = bisect.bisect_left(high, key)
                while k < len(low) and low[k] <= key:
                    names.append(file[k])
                    asked.append(key)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(asked, pa.string())], names=["in_file", "url_key"])

    return run


def captures(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Build the index over pages and look every page's key up: (url_key, page_id, captures, html_md5, html_chars)."""
    directory, folder = build(pages, block_lines)
    found = lookup(directory, folder, pages.select(url_key(F.col("url")).alias("url_key")))
    number = F.count(F.lit(1)).over(Window.partitionBy("url_key"))
    return found.select("url_key", "page_id", number.alias("captures"), F.md5(F.encode("html", "UTF-8")).alias("html_md5"), F.length("html").cast("bigint").alias("html_chars"))
