"""Data sources one can name in spark.read.format: pages, wave and records of files of any size, and a sink for pages.

    formats.register(spark)
    spark.read.format("pages").load("hdfs://.../streams")
    pages.write.format("pages").mode("append").save("/data/out")
    spark.sql("SELECT r.* FROM f, LATERAL packet_records(f.content) AS r")

A file of pages or samples is cut into ranges of bytes that are read by tasks of their own. A range of pages belongs to
whom its capture patterns lie in; a task finds its place by reading from one longest page before its range, so that
every cut gives the rows that one reader of the whole file gives. Records have no mark to find one by, so a file of them
is one task; many files are many. The sink writes below _temporary and moves files to their names on commit.

A file whose name ends in .zst and that is in zstd's seekable format (frames that stand alone, and a table of their sizes at
the end) is read as what it decompresses to: places and ranges are those of its bytes before compression, and a task
decompresses the frames its range lies in. The sink writes such files with compression "zstd"; `zstd -d` reads them too.

Paths are those that pyarrow.fs opens (local, hdfs, s3, gs), since Python sources can't use Spark's own readers;
sources.files reads what only these open.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.functions import udtf

from ..operators import container as c
from . import files

PAGE_SCHEMA = "path string, offset long, flags int, granule long, serial long, sequence long, segments array<int>, body binary, error string"
WAVE_SCHEMA = "path string, position long, channels int, rate int, samples array<short>, error string"
RECORD_SCHEMA = files.RECORD_SCHEMA
SPLIT_BYTES = 64 << 20
#: Head, table and body of the longest page.
MOST_PAGE = 27 + 255 + 255 * 255
#: Frames of samples in a row; rows in a batch, and bytes of their bodies.
BLOCK_FRAMES, BATCH_ROWS, BATCH_BYTES = 4096, 256, 4 << 20

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<short>": pa.list_(pa.int16())}


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pfs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pfs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of one file; names that begin with _ or . are left out."""
    fs, inner = opened(path)
    info = fs.get_file_info(inner)
    if info.type == pfs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    root = path.rstrip("/")
    found = [(i.path[len(inner.rstrip("/")) + 1 :], i.size) for i in fs.get_file_info(pfs.FileSelector(inner, recursive=True)) if i.is_file]
    return sorted((f"{root}/{name}", size) for name, size in found if not any(part[0] in "_." for part in name.split("/")))


@dataclass
class Range(InputPartition):
    """Bytes begin to end of a file, end exclusive."""

    path: str
    begin: int
    end: int
    size: int


#: zstd's seekable format: marks before and after the table of frames, and bytes of a frame before compression.
SKIPPABLE, SEEKABLE, FRAME_BYTES = 0x184D2A5E, 0x8F92EAB1, 1 << 20


class _Frames:
    """The bytes that a file of frames decompresses to, as _Window reads files; the last frame read is held."""

    def __init__(self, file, sizes: list[tuple[int, int]]):
        self.file, self.sizes = file, sizes
        self.places, self.begins = ([0, *itertools.accumulate(x[i] for x in sizes)] for i in (0, 1))
        self.at, self.data = -1, b""

    def frame(self, i: int) -> bytes:
        if i != self.at:
            n, raw = self.sizes[i]
            self.at, self.data = i, pa.decompress(self.file.read_at(n, self.places[i]), raw, codec="zstd", asbytes=True)
        return self.data

    def read_at(self, n: int, at: int) -> bytes:
        end, parts = min(at + n, self.begins[-1]), []
        i = bisect.bisect_right(self.begins, at) - 1
        while at < end:
            parts.append(self.frame(i)[at - self.begins[i] : end - self.begins[i]])
            at, i = self.begins[i + 1], i + 1
        return b"".join(parts)


class _FramesWriter:
    """Writes bytes to a stream as frames of FRAME_BYTES; close ends it with their table."""

    def __init__(self, stream):
        self.stream, self.held, self.n, self.sizes = stream, [], 0, []

    def write(self, data: bytes) -> None:
        self.held.append(data)
        self.n += len(data)
        if self.n >= FRAME_BYTES:
            data = b"".join(self.held)
            whole = len(data) // FRAME_BYTES * FRAME_BYTES
            for at in range(0, whole, FRAME_BYTES):
                self.frame(data[at : at + FRAME_BYTES])
            self.held, self.n = [data[whole:]], len(data) - whole

    def frame(self, data: bytes) -> None:
        packed = pa.compress(data, codec="zstd", asbytes=True)
        self.stream.write(packed)
        self.sizes.append((len(packed), len(data)))

    def close(self) -> None:
        if self.n:
            self.frame(b"".join(self.held))
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def plain(path: str, file) -> tuple:
    """(file, bytes) as rows are read from it: decompressed if it is in zstd's seekable format, else as it is."""
    size = file.size()
    if path.endswith(".zst") and size >= 17:
        count, flags, mark = struct.unpack("<IBI", file.read_at(9, size - 9))
        entry = 12 if flags & 128 else 8  # with a checksum for each frame, or without
        n = 8 + entry * count + 9
        if mark == SEEKABLE and n <= size and struct.unpack("<II", file.read_at(8, size - n)) == (SKIPPABLE, n - 8):
            table = file.read_at(entry * count, size - n + 8)
            sizes = [struct.unpack_from("<II", table, entry * i) for i in range(count)]
            return _Frames(file, sizes), sum(raw for _, raw in sizes)
    return file, size


class _RangeReader(DataSourceReader):
    """Reads files by ranges; rows(range, file) of a subclass gives tuples in the order of schema."""

    schema, splits = "", True

    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        if self.split_bytes < 1:
            raise ValueError("splitBytes must be positive")

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path):
            if path.endswith(".zst"):
                fs, inner = opened(path)
                with fs.open_input_file(inner) as file:
                    size = plain(path, file)[1]
            step = self.split_bytes if self.splits else max(size, 1)
            out += [Range(path, at, min(at + step, size), size) for at in range(0, size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fields = [(n, _ARROW[t]) for n, t in (f.split(" ") for f in self.schema.split(", "))]
        table = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
        if not part.path:
            yield table([])
            return
        fs, inner = opened(part.path)
        with fs.open_input_file(inner) as file:
            rows: list[tuple] = []
            held = 0
            for row in self.rows(part, plain(part.path, file)[0]):
                rows.append((part.path, *row))
                held += sum(len(x) for x in row if isinstance(x, bytes))
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)


class _Window:
    """Bytes of a file by position, read ahead in steps, so that a page costs no call of its own."""

    STEP = 1 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, begin: int, n: int) -> bytes:
        n = min(n, self.size - begin)
        if begin < self.at or begin + n > self.at + len(self.data):
            self.at, self.data = begin, self.file.read_at(min(max(n, self.STEP), self.size - begin), begin)
        return self.data[begin - self.at : begin - self.at + n]

    def find(self, pattern: bytes, begin: int, end: int) -> int:
        """The first place of pattern from begin on, starting before end; -1 if there is none."""
        while begin < end:
            data = self.get(begin, self.STEP)
            found = data.find(pattern)
            if found >= 0:
                return begin + found if begin + found < end else -1
            if len(data) < len(pattern) or begin + len(data) >= self.size:
                return -1
            begin += len(data) - len(pattern) + 1
        return -1


def page_at(window: _Window, at: int) -> tuple[tuple, int]:
    """(flags, granule, serial, sequence, segments, body, error) of the page at a place of a file, and where it ends."""
    head = window.get(at, 27)
    if len(head) < 27 or head[:4] != b"OggS" or head[4]:
        return (None,) * 6 + ("not a page" if head[:4] != b"OggS" else "unexpected end" if len(head) < 27 else "unknown version",), at
    flags, granule, serial, sequence, crc, count = struct.unpack("<BqIIIB", head[5:])
    segments = window.get(at + 27, count)
    end = at + 27 + count + sum(segments)
    data = window.get(at, end - at)
    error = "no segments" if not count else "unexpected end" if len(segments) < count or end > window.size else None
    if error is None and c.checksum(data[:22] + bytes(4) + data[26:]) != crc:
        error = "bad checksum"
    return (flags, granule, serial, sequence, [*segments], data[27 + count :], error), end


class _PagesReader(_RangeReader):
    schema = PAGE_SCHEMA

    def rows(self, part: Range, file) -> Iterator[tuple]:
        window = _Window(file, part.size)
        at = max(0, part.begin - MOST_PAGE)
        sure = at == 0  # whether a page is expected here, or searched for
        while at < part.end:
            page, end = page_at(window, at)
            if page[-1] is None:
                if at >= part.begin:
                    yield at, *page
                at, sure = end, True
                continue
            if sure and at >= part.begin:
                yield at, *page
            sure = False
            found = window.find(b"OggS", at + 1, part.end)
            at = part.end if found < 0 else found


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _PagesWriter(DataSourceArrowWriter):
    """Pages (stream, page, content), each stream's in order and in one task, to a file for each task."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite = (options.get("path") or "").rstrip("/"), overwrite
        self.compression = options.get("compression", "none")
        if self.compression not in ("none", "zstd"):
            raise ValueError("compression is none or zstd")
        if not self.path:
            raise ValueError("a path is needed")
        if [f.name for f in schema] != ["stream", "page", "content"]:
            raise ValueError("pages are written from the columns stream, page, content")
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        folder, name = f"{root}/_temporary/{self.job}", f"part-{uuid.uuid4().hex}.ogg" + (".zst" if self.compression == "zstd" else "")
        seen, last, file = set(), None, None
        try:
            for batch in batches:
                for stream, page, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if last is None or stream != last[0]:
                        if stream in seen or page != 0:
                            raise ValueError(f"pages of stream {stream} don't come in order from 0")
                        seen.add(stream)
                    elif page != last[1] + 1:
                        raise ValueError(f"pages of stream {stream} don't come in order from 0")
                    last = stream, page
                    if file is None:
                        fs.create_dir(folder, recursive=True)
                        file = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        file = _FramesWriter(file) if self.compression == "zstd" else file
                    file.write(content)
        finally:
            if file is not None:
                file.close()
        return Written([name] if file is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        before = [i.path for i in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True)) if i.is_file] if self.overwrite else []
        fs.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.files):
            fs.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        for path in before:
            fs.delete_file(path)
        self._cleared(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*opened(self.path))

    def _cleared(self, fs: pfs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type != pfs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary/{self.job}")
        if not fs.get_file_info(pfs.FileSelector(f"{root}/_temporary", allow_not_found=True)) and fs.get_file_info(f"{root}/_temporary").type != pfs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


class PagesSource(DataSource):
    """Pages of container files, by offset; error tells why no sound page is where one is expected. Reading goes on at the next sound page.

    Options: splitBytes, the bytes of a range; compression of what is written, none (the default) or zstd. Writing takes what
    sources.files.pages gives, a stream's pages in one task.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> _PagesReader:
        return _PagesReader(self.options)

    def writer(self, schema, overwrite: bool) -> _PagesWriter:
        return _PagesWriter(self.options, schema, overwrite)


class _WaveReader(_RangeReader):
    schema = WAVE_SCHEMA

    def rows(self, part: Range, file) -> Iterator[tuple]:
        error, channels, rate, data_at, known = self.header(_Window(file, part.size))
        if error:
            if part.begin == 0:
                yield None, channels, rate, None, error
            return
        frame = 2 * channels
        n = min(part.size - data_at, part.size if known is None else known) // frame
        # a frame belongs to the range in which it begins
        first, last = (min(n, max(0, -(-(x - data_at) // frame))) for x in (part.begin, part.end))
        for at in range(first, last, BLOCK_FRAMES):
            count = min(BLOCK_FRAMES, last - at)
            data = file.read_at(count * frame, data_at + at * frame)
            yield at, channels, rate, memoryview(data).cast("h").tolist(), None
        if part.end == part.size and known is not None and known > part.size - data_at:
            yield n, channels, rate, None, "unexpected end"

    @staticmethod
    def header(window: _Window) -> tuple:
        """(error, channels, rate, place of the data, its declared bytes): chunks are walked, their bodies aren't read."""
        head = window.get(0, 12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            return "not RIFF" if head[:4] != b"RIFF" else "not WAVE", None, None, None, None
        at, start = 12, b""
        while at + 8 <= window.size:
            name, size = struct.unpack("<4sI", window.get(at, 8))
            if name == b"fmt ":
                start = window.get(at, 8 + size) if at + 8 + size <= window.size else start
            if name == b"data" or (name == b"fmt " and not start):
                break
            at += 8 + size + size % 2
        tail = window.get(at, 8) if at + 8 <= window.size else b""
        start += b"\0" * (len(start) % 2)
        error, channels, rate, _, known, _ = files.wav_fields(memoryview(b"RIFF\0\0\0\0WAVE" + start + tail))
        return error, channels, rate, at + 8, known


class WaveSource(DataSource):
    """Blocks of interleaved 16-bit samples of WAV files; position is a block's first frame. A file that is none gives one row with an error.

    A file that ends before the samples it declares gives what there is, and a row with an error after them.
    """

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return WAVE_SCHEMA

    def reader(self, schema) -> _WaveReader:
        return _WaveReader(self.options)


def records_of(window: _Window) -> Iterator[tuple]:
    """(record, final_range, payload, error) of a file of records; none is held but the one that is read."""
    at, n = 0, 0
    while at < window.size:
        head = window.get(at, 8)
        if len(head) < 8:
            yield n, None, None, "unexpected end"
            return
        size, final = struct.unpack(">II", head)
        payload = window.get(at + 8, size)
        yield n, final, payload, "unexpected end" if len(payload) < size else None
        at, n = at + 8 + size, n + 1


class _RecordsReader(_RangeReader):
    schema, splits = RECORD_SCHEMA, False

    def rows(self, part: Range, file) -> Iterator[tuple]:
        return records_of(_Window(file, part.size))


class RecordsSource(DataSource):
    """Records of files: big-endian length and range words, then the packet; an empty packet is a lost one."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> _RecordsReader:
        return _RecordsReader(self.options)


class _Bytes:
    """Bytes in memory, as _Window reads files."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


@udtf(returnType="record: bigint, final_range: bigint, payload: binary, error: string")
class PacketRecords:
    """The records of a binary value, as a table function: packet_records(content). Null and empty values have none."""

    def eval(self, content: bytes):
        if content:
            yield from records_of(_Window(_Bytes(bytes(content)), len(content)))


def register(spark: SparkSession) -> None:
    """Makes the sources and the table function packet_records known to a session."""
    for source in (PagesSource, WaveSource, RecordsSource):
        spark.dataSource.register(source)
    spark.udtf.register("packet_records", PacketRecords)
