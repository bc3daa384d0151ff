"""A splittable source of XML dumps in many bz2 streams: spark.read.format("multistream_dump").

A multistream dump is bz2 streams, one behind the other, each of some pages. A stream begins at a whole byte with a mark
of ten bytes, so a task that is given a range of bytes finds the streams that begin in it, without an index file. A page
belongs to the range in which the stream begins that holds its first character; a task reads on into the next streams to
its page's end, so pages may cross streams. A file of one stream is one task's work; a plain XML file is not for this source.

Options: path (any file system that pyarrow opens); bytes (of compressed data a task, 8 MB if not given); start and end
(only streams that begin in these bytes: what makes an interrupted read go on, see `ingest.index_dump`). Columns are
those of schemas.DUMP_PAGE. Pages that are no XML are left out.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heronry import schemas

TASK_BYTES, READ_BYTES, ROWS_AT_ONCE = 8_000_000, 1_000_000, 500
#: How a bz2 stream begins (a level, then the first block's mark), and how a page does.
STREAM = re.compile(rb"BZh[1-9]\x31\x41\x59\x26\x53\x59")
MARK = 10
PAGE, PAGE_END = re.compile(rb"<page[\s>]"), b"</page>"


def opened(path: str):
    """A seekable file of any file system that pyarrow knows, and its size."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def first_stream(file, start: int, end: int) -> int | None:
    """Where the first stream begins that begins in these bytes."""
    at, kept = start, b""
    while at < end + MARK - 1:
        file.seek(at)
        data = file.read(min(READ_BYTES, end + MARK - 1 - at))
        if not data:
            return None
        found = STREAM.search(kept + data)
        if found:
            return at - len(kept) + found.start()
        at, kept = at + len(data), (kept + data)[-(MARK - 1) :]
    return None


def streams(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(where the stream begins, a part of its text) from the stream at `at` to the end of the file."""
    file.seek(at)
    data, read = b"", at
    while True:
        begin, inner = read - len(data), bz2.BZ2Decompressor()
        while not inner.eof:
            if not data:
                data = file.read(READ_BYTES)
                read += len(data)
                if not data:
                    return
            text = inner.decompress(data)
            data = inner.unused_data if inner.eof else b""
            yield begin, text
        if not data:
            data = file.read(READ_BYTES)
            read += len(data)
        if not data.startswith(b"BZh"):
            return


def pages(file, start: int, end: int) -> Iterator[bytes]:
    """The pages whose first character stands in a stream that begins in these bytes."""
    at = first_stream(file, start, end)
    if at is None:
        return
    held, foreign = b"", False  # what is not yet a whole page; whether later streams are another range's
    for begin, text in streams(file, at):
        if begin >= end and not foreign:
            foreign = True
            found = PAGE.search(held)
            # The last page may be open, or its tag's first letters may be this range's last ones.
            open_at = found.start() if found else next((len(held) - n for n in range(min(5, len(held)), 0, -1) if b"<page"[:n] == held[-n:]), None)
            if open_at is None:
                return
            held = held[open_at:]
        held += text
        while True:
            found = PAGE.search(held)
            close = held.find(PAGE_END, found.start()) if found else -1
            if foreign and (not found or found.start() > 0) and len(held) >= 6:
                return  # what looked like a page's beginning was none
            if close < 0:
                held = held[found.start() :] if found else held[-5:]
                break
            yield held[found.start() : close + len(PAGE_END)]
            if foreign:
                return
            held = held[close + len(PAGE_END) :]


def row(page: bytes) -> tuple | None:
    """A page's columns, None where it is no XML."""
    try:
        root = ElementTree.fromstring(page)
    except ElementTree.ParseError:
        return None
    told = lambda name: None if (text := root.findtext(name)) is None else text.strip()
    redirect, text = root.find("redirect"), root.find("revision/text")
    return told("title"), told("ns"), told("id"), None if redirect is None else {"_title": redirect.get("title")}, {"text": {"_VALUE": None if text is None else text.text}}


@dataclass
class Bytes(InputPartition):
    start: int
    end: int


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("bytes", TASK_BYTES))
        self.start, self.end = int(options.get("start", 0)), options.get("end")

    def partitions(self):
        file, size = opened(self.path)
        file.close()
        end = min(size, int(self.end)) if self.end is not None else size
        return [Bytes(at, min(at + self.each, end)) for at in range(self.start, end, self.each)] or [Bytes(0, 0)]

    def read(self, partition: Bytes):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.string(), pa.struct([("_title", pa.string())]), pa.struct([("text", pa.struct([("_VALUE", pa.string())]))])]
        names = ["title", "ns", "id", "redirect", "revision"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        file, _ = opened(self.path)
        rows = []
        with file:
            for page in pages(file, partition.start, partition.end):
                if (found := row(page)) is not None:
                    rows.append(found)
                if len(rows) >= ROWS_AT_ONCE:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class MultistreamDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream_dump"

    def schema(self) -> str:
        return schemas.DUMP_PAGE

    def reader(self, schema) -> DataSourceReader:
        return DumpReader(dict(self.options))


def dump_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """The pages of a dump (schemas.DUMP_PAGE); options as above."""
    spark.dataSource.register(MultistreamDump)
    return spark.read.format("multistream_dump").options(path=path, **options).load()
