"""Files of samples, pages and records as DataFrames, and pages back to files.

A file is a row of Spark's binaryFile source, so paths are any that Spark reads. Samples are columns; pages, records and
the chunks of WAV files, whose places follow from one another, are walked once for each file.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import container as c, ordered
from ..storage import written

PAGE_SCHEMA = "path string, page long, flags int, granule long, serial long, sequence long, segments array<int>, body binary, error string"
#: Of pages that are made, bytes in a batch.
BATCH_BYTES = 8 << 20
RECORD_SCHEMA = "path string, record long, final_range long, payload binary, error string"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files that path names."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def samples_of(content: Column) -> Column:
    """Little-endian 16-bit samples of a binary column; an odd last byte is dropped."""
    b = c.bytes_of(content)
    pairs = F.call_function("div", F.size(b), F.lit(2)).cast("int")
    value = lambda i: F.get(b, 2 * i) + 256 * F.get(b, 2 * i + 1)
    signed = lambda v: F.when(v >= 32768, v - 65536).otherwise(v).cast("short")
    return F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: signed(value(i)))).otherwise(F.array().cast("array<smallint>"))


def unpacked(content: Column) -> Column:
    """samples_of for long contents: an Arrow column at a time, null for null."""

    @F.arrow_udf("array<smallint>")
    def unpack(contents: pa.Array) -> pa.Array:
        pieces = [b"" if x is None else x[: len(x) // 2 * 2] for x in contents.to_pylist()]
        ends = np.cumsum([0, *(len(p) // 2 for p in pieces)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(pieces), "<i2")), mask=contents.is_null())

    return unpack(content)


def _walk(files: DataFrame, schema: str, rows) -> DataFrame:
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [(n, arrow[t]) for n, t in (f.split(" ") for f in schema.split(", "))]

    def run(batches):
        for batch in batches:
            for path, content in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                found: list[tuple] = []
                for row in rows(content.as_py() or b""):
                    found.append((path.as_py(), *row))
                    if len(found) == 1024:
                        yield table(found)
                        found = []
                yield table(found)

    def table(found):
        return pa.record_batch([pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return files.mapInArrow(run, schema)


def _pages(data: bytes) -> Iterator[tuple]:
    at, n = 0, 0
    while at < len(data):
        head = data[at : at + 27]
        if len(head) < 27 or head[:4] != b"OggS" or head[4]:
            yield n, None, None, None, None, None, None, "not a page" if head[:4] != b"OggS" else "unexpected end" if len(head) < 27 else "unknown version"
            return
        flags, granule, serial, sequence, crc, count = struct.unpack("<BqIIIB", head[5:])
        segments = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(segments)
        error = "no segments" if not count else "unexpected end" if end > len(data) else None
        if error is None and c.checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            error = "bad checksum"
        yield n, flags, granule, serial, sequence, [*segments], data[at + 27 + count : end], error
        if error in ("no segments", "unexpected end"):
            return
        at, n = end, n + 1


def read_pages(files: DataFrame) -> DataFrame:
    """Pages (PAGE_SCHEMA) of files (path, content); error tells why a page is unsound, null if it isn't. An empty file has none."""
    return _walk(files, PAGE_SCHEMA, _pages)


def _records(data: bytes) -> Iterator[tuple]:
    at, n = 0, 0
    while at < len(data):
        if len(data) - at < 8:
            yield n, None, None, "unexpected end"
            return
        size, final = struct.unpack(">II", data[at : at + 8])
        payload = data[at + 8 : at + 8 + size]
        yield n, final, payload, "unexpected end" if len(payload) < size else None
        at, n = at + 8 + size, n + 1


def read_records(files: DataFrame) -> DataFrame:
    """Records (RECORD_SCHEMA) of files (path, content): big-endian length and range words, then the packet; an empty packet is a lost one."""
    return _walk(files, RECORD_SCHEMA, _records)


def packets_of(pages: DataFrame) -> DataFrame:
    """(path, serial, packet, size, granule) of every packet that ends on sound pages, header packets included.

    A packet is a run of segments up to one below 255; its number is how many have ended before, so pieces on several
    pages meet by a running sum over (path, serial), as granule is the position of the page the packet ends on.
    """
    seg = pages.where("error is null").select("path", "serial", "page", "granule", F.posexplode("segments").alias("i", "size"))
    along = Window.partitionBy("path", "serial").orderBy("page", "i")
    seg = seg.withColumn("packet", F.coalesce(F.sum(F.when(F.col("size") < 255, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = seg.groupBy("path", "serial", "packet").agg(F.sum("size").alias("size"), F.min("size").alias("least"), F.max_by("granule", F.struct("page", "i")).alias("granule"))
    return out.where("least < 255").drop("least")


def _along_pages(pages: DataFrame, order: str) -> DataFrame:
    """Sound pages of each (path, serial) up to its first end page, with the packets ended before and the openings through each.

    An opening is a page that doesn't go on with a packet. Sums run within chunks of 4096 page numbers or 16 MB of offsets,
    and over the chunks' sums.
    """
    flag = lambda bit: (F.col("flags").bitwiseAND(bit) != 0).cast("long")
    ended = F.size(F.filter("segments", lambda n: n < 255)).cast("long")
    rows = pages.where("error is null").withColumns({"_ended": ended, "_opens": 1 - flag(1), "_last": flag(4)})
    rows = rows.withColumn("_chunk", F.shiftright(F.col(order).cast("long"), 24 if order == "offset" else 12))
    terms = ("_ended", "_opens", "_last")
    chunks = rows.groupBy("path", "serial", "_chunk").agg(*(F.sum(t).alias(f"{t}_sum") for t in terms))
    before = Window.partitionBy("path", "serial").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("path", "serial", "_chunk", *(F.coalesce(F.sum(f"{t}_sum").over(before), F.lit(0)).alias(f"{t}_sum") for t in terms))
    upto = Window.partitionBy("path", "serial", "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{t}_upto": F.col(f"{t}_sum") + F.sum(t).over(upto) for t in terms}
    rows = rows.join(chunks, ["path", "serial", "_chunk"]).withColumns(sums)
    rows = rows.where(F.col("_last_upto") - F.col("_last") == 0)
    return rows.select(*pages.columns, (F.col("_ended_upto") - F.col("_ended")).alias("_before"), F.col("_opens_upto").alias("_openings"))


def _spans(segments: Column) -> Column:
    """array<struct<begin: int, n: int>>: the bytes of a page's body of each piece that ends a packet; the aggregation runs over ends only."""
    ends = F.array_compact(F.transform(segments, lambda n, i: F.when(n < 255, i)))

    def after(a: Column, i: Column) -> Column:
        n = 255 * (i - a["at"] - 1) + F.get(segments, i)
        return F.struct(F.concat(a["spans"], F.array(F.struct(a["begin"].alias("begin"), n.alias("n")))).alias("spans"), (a["begin"] + n).alias("begin"), i.alias("at"))

    none = F.array().cast("array<struct<begin: int, n: int>>")
    return F.aggregate(ends, F.struct(none.alias("spans"), F.lit(0).alias("begin"), F.lit(-1).alias("at")), after, lambda a: a["spans"])


def packets_with_payloads(pages: DataFrame, order: str = "page") -> DataFrame:
    """(path, serial, packet, granule, payload) of every packet, put together from its pieces on pages that follow in `order`.

    pages are those of read_pages, or of the source "pages" with order="offset". A page that doesn't go on with a packet
    drops one that was left open before it; a page that goes on with one although none is open begins a packet. Unsound
    pages and what follows a stream's end page are left out. packet counts the ended packets from 0, headers included;
    granule is the position of the page the packet ends on, null for a page without one (-1). A packet's pieces meet in one
    task, a stream's pages don't.

    pages are read twice. First the pages' numbers are written down, and the pieces at their two ends, which other pages may
    go on with. Then each page is moved once, as it is, to its number; only pieces at the ends are grouped by packet.
    """
    sound = pages.where("error is null").withColumn("granule", F.when(F.col("granule") != -1, F.col("granule")))
    goes_on, first, size = F.col("flags").bitwiseAND(1), F.col("first"), F.size("segments")
    piece = lambda begin, n: F.substring(F.col("body"), begin + 1, n)

    # of each page the end of a packet from pages before, and the begin of one that goes on after it; k: the packets ended before on the page
    ends = F.transform("segments", lambda n: n < 255)
    pages_ends = sound.withColumns({"first": F.array_position(ends, True).cast("int"), "after": F.array_position(F.reverse(ends), True).cast("int")})
    left = F.when(first == 0, F.octet_length("body")).otherwise(255 * (F.col("after") - 1))
    head = F.when((goes_on == 1) & (first > 0), F.struct(F.lit(0).alias("k"), F.lit(True).alias("ends"), piece(F.lit(0), 255 * (first - 1) + F.get("segments", first - 1)).alias("piece")))
    tail = F.when(left > 0, F.struct(F.size(F.filter("segments", lambda n: n < 255)).alias("k"), F.lit(False).alias("ends"), piece(F.octet_length("body") - left, left).alias("piece")))
    light = pages_ends.select("path", "serial", order, "flags", "granule", "segments", "error", F.array_compact(F.array(head, tail)).alias("edges"))
    known = _along_pages(written(light), order)

    # pieces of an open packet share the packets ended before them and the openings; a later opening leaves it without an end
    edges = known.select("path", "serial", "_before", "_openings", F.col(order).alias("at"), "granule", F.explode("edges").alias("e"))
    over = edges.groupBy("path", "serial", (F.col("_before") + F.col("e.k")).alias("packet"), "_openings").agg(F.array_sort(F.collect_list(F.struct("at", "e.piece", "e.ends", "granule"))).alias("x"))
    last = F.element_at("x", -1)
    payload = F.unhex(F.array_join(F.transform("x.piece", lambda b: F.hex(b)), ""))
    over = over.where(last["ends"]).select("path", "serial", "packet", last["granule"].alias("granule"), payload.alias("payload"))

    inner = F.slice(F.transform(_spans(F.col("segments")), lambda s, i: F.struct(i.alias("k"), piece(s["begin"], s["n"]).alias("payload"))), goes_on + 1, size)
    some = F.size(F.filter("segments", lambda n: n < 255)) > goes_on  # whether a packet lies on the page only
    numbered = sound.where(some).join(known.select("path", "serial", order, "_before").hint("shuffle_hash"), ["path", "serial", order])
    within = numbered.select("path", "serial", "granule", "_before", F.explode(inner).alias("x"))
    return within.select("path", "serial", (F.col("_before") + F.col("x.k")).alias("packet"), "granule", "x.payload").unionByName(over)


def streams(pages: DataFrame, order: str = "page") -> DataFrame:
    """A row for each (path, serial): n_pages, n_packets (headers left out), head and tags as parsed, final_granule, n_samples, error.

    final_granule is the last position up to the end page, null without one; n_samples is what it leaves after the pre-skip.
    error is the first that holds: the first page doesn't begin a stream, no identification header, no comment header, or
    what their parsing finds.
    """
    known = _along_pages(pages, order)
    end = F.col("flags").bitwiseAND(4) != 0
    facts = known.groupBy("path", "serial").agg(
        F.count("*").alias("n_pages"), F.min_by(F.col("flags").bitwiseAND(2) != 0, order).alias("begins"), F.max(end).alias("over"),
        F.max_by(F.when(F.col("granule") != -1, F.col("granule")), F.when(F.col("granule") != -1, F.col(order))).alias("last"),
    )
    packets = packets_with_payloads(pages, order)
    first = lambda n: F.max(F.when(F.col("packet") == n, F.col("payload")))
    found = packets.groupBy("path", "serial").agg(F.count("*").alias("n"), first(0).alias("p0"), first(1).alias("p1"))
    rows = facts.join(found, ["path", "serial"], "left").withColumn("head", c.parse_head(F.col("p0"))).withColumn("tags", c.parse_tags(F.col("p1")))
    error = (
        F.when(~F.col("begins"), "first page begins no stream").when(F.col("p0").isNull(), "ended before identification header").when(F.col("head.error").isNotNull(), F.col("head.error"))
        .when(F.col("p1").isNull(), "ended before comment header").otherwise(F.col("tags.error"))
    )
    final = F.when(F.col("over"), F.col("last"))
    return rows.select(
        "path", "serial", "n_pages", F.greatest(F.coalesce("n", F.lit(0)) - 2, F.lit(0)).alias("n_packets"), "head", "tags", final.alias("final_granule"),
        (final - F.col("head.pre_skip")).alias("n_samples"), error.alias("error"),
    )


def _in_batches(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of BATCH_BYTES in the last column at most, and a row more."""
    table = lambda: pa.record_batch([pa.array([r[i] for r in found], f.type) for i, f in enumerate(kind)], schema=kind)
    found, held = [], 0
    for row in rows:
        found.append(row)
        held += len(row[-1])
        if held >= BATCH_BYTES:
            yield table()
            found, held = [], 0
    yield table()


def _paged(packets: Iterator[tuple]) -> Iterator[tuple]:
    """(stream, page, content) of packets (stream, serial, granule, payload) that come a stream after another, in order."""
    now: tuple = ()  # stream and serial
    page, goes_on, granule, table, body = 0, False, -1, bytearray(), []

    def content(is_last: bool) -> tuple:
        flags = (1 if goes_on else 0) | (2 if page == 0 else 0) | (4 if is_last else 0)
        head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, now[1], page)
        rest = bytes([len(table)]) + table + b"".join(body)
        return now[0], page, head + struct.pack("<I", c.checksum(head + bytes(4) + rest)) + rest

    for stream, serial, position, data in packets:
        if now != (stream, serial):
            if now:
                yield content(True)
            now, page, goes_on, granule, table, body = (stream, serial), 0, False, -1, bytearray(), []
        at, left = 0, len(data) // 255 + 1
        while left:
            if len(table) == 255:  # a full page isn't its stream's last once more comes
                yield content(False)
                page, goes_on, granule, table, body = page + 1, at > 0, -1, bytearray(), []
            n = min(left, 255 - len(table))
            body.append(data[at : at + 255 * n])
            at, left = at + 255 * n, left - n
            table += b"\xff" * n
            if not left:
                table[-1], granule = len(data) % 255, position
    if now:
        yield content(True)


def pages(packets: DataFrame, stream: str, order: list[str], payload: str, granule: str, serial: Column | None = None) -> DataFrame:
    """(stream, page, content): serialised pages of each stream's packets in order, 255 segments a page at most.

    order must tell a stream's packets apart. Flags mark a stream's first page, its last, and pages that go on with a packet. serial is
    the stream's number of 32 bits, from the column stream; a hash of it if none is given. Packets without a payload are left out.

    A packet is moved once, to the task that makes its stream's pages; they leave it in order, as the sink takes them.
    """
    moved = packets.select(*dict.fromkeys((stream, *order, granule, payload))).where(F.col(payload).isNotNull())
    moved = moved.repartition(F.col(stream)).sortWithinPartitions(F.col(stream).asc_nulls_first(), *ordered.ascending(order))
    rows = moved.select(F.col(stream).alias("stream"), F.col(granule).cast("long").alias("granule"), F.col(payload).cast("binary").alias("data"))
    number = F.pmod(F.xxhash64("stream"), F.lit(1 << 32)) if serial is None else serial
    rows = rows.select("stream", number.cast("long").alias("serial"), "granule", "data")

    def run(batches):
        batches = iter(batches)
        if (head := next(batches, None)) is None:
            return
        kind = pa.schema([("stream", head.schema.field(0).type), ("page", pa.int64()), ("content", pa.binary())])

        def packets():
            for batch in itertools.chain([head], batches):
                for i, (key, number, position) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True)):
                    yield key, number, position, batch.column(3)[i].as_py()

        yield from _in_batches(_paged(packets()), kind)

    return rows.mapInArrow(run, f"stream {rows.schema['stream'].dataType.simpleString()}, page long, content binary")


WAV_SCHEMA = "error string, channels long, rate long, data_at long, data_bytes long, n_samples long"


def wav_fields(data: memoryview) -> tuple:
    """The values of WAV_SCHEMA of a file's bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return ("not RIFF" if data[:4] != b"RIFF" else "not WAVE", *[None] * 5)
    at, channels, rate = 12, None, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if name == b"data":
            if channels is None:
                break
            known = None if size in (0, 0xFFFFFFFF) else size
            return None, channels, rate, at, known, known and known // (2 * channels)
        if name == b"fmt ":
            if size < 16 or at + size > len(data):
                return "no format", *[None] * 5
            tag, channels, rate, bits = struct.unpack_from("<HHI6xH", data, at)
            if tag == 0xFFFE:  # extensible: the tag is the first word of the SubFormat
                if size < 40:
                    return "no format", channels, rate, None, None, None
                (tag,) = struct.unpack_from("<H", data, at + 24)
            error = "not 16-bit PCM" if tag != 1 or bits != 16 else "no channels" if not channels else "no rate" if not rate else None
            if error:
                return error, channels, rate, None, None, None
        at += size + size % 2
    return "no format" if channels is None else "no data", channels, rate, None, None, None


def wav_header(content: Column) -> Column:
    """struct(error, channels, rate, data_at, data_bytes, n_samples) of a WAV file: its chunks are walked up to the data.

    data_bytes is what the file declares, null if that is 0 or 0xFFFFFFFF (unknown). A null content is an empty one.
    """
    kind = pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split(" ") for f in WAV_SCHEMA.split(", "))])

    @F.arrow_udf(f"struct<{WAV_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def walked(contents: pa.Array) -> pa.Array:
        rows = [wav_fields(memoryview(x.as_buffer() or b"")) for x in contents]
        return pa.array([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    return walked(content)


def wav_seconds(header: Column) -> Column:
    """How long the samples of a wav_header play; null if their number isn't known or there is no rate."""
    return header["n_samples"].cast("double") / F.nullif(header["rate"], F.lit(0).cast("long"))
