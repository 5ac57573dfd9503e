"""Page container arithmetic: lacing, pages, positions, headers and checksums as columns."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Samples before the first audible one at 48 kHz, the header's magic strings, the checksum's polynomial.
PRE_SKIP, HEAD_MAGIC, TAGS_MAGIC, POLYNOMIAL = 312, "OpusHead", "OpusTags", 0x04C11DB7


def lacing(n: Column) -> Column:
    """Segment lengths of a packet of n bytes."""
    return F.concat(F.array_repeat(F.lit(255).cast("long"), F.call_function("div", n, F.lit(255).cast("long")).cast("int")), F.array(n % 255))


def segments(n: Column) -> Column:
    return F.call_function("div", n, F.lit(255).cast("long")) + 1


#: Each byte with its bits in reverse order.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The container's CRC-32 of bytes: most significant bit first, from 0 and without a final inversion.

    It is the common CRC-32, which goes by least significant bits, of bytes and in a result that are turned around.
    """
    plain = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(plain.to_bytes(4, "little").translate(REVERSED), "big")


def bytes_of(data: Column) -> Column:
    """The bytes of a binary or string column as array<int>."""
    hexed = F.split(F.regexp_replace(F.hex(data), "(..)", "$1,"), ",")
    return F.transform(F.slice(hexed, 1, F.greatest(F.size(hexed) - 1, F.lit(0))), lambda h: F.conv(h, 16, 10).cast("int"))


def page_crc(data: Column) -> Column:
    """checksum of a binary or string column, of any length, null for null."""
    order = [b for b in range(256) if REVERSED[b] != b]
    text = F.decode(data.cast("binary"), "ISO-8859-1")
    turned = F.encode(F.translate(text, "".join(map(chr, order)), "".join(chr(REVERSED[b]) for b in order)), "ISO-8859-1")
    # four bytes of ones before the data take the common checksum's first value to 0
    x = F.crc32(F.concat(F.lit(b"\xff" * 4), turned)).bitwiseXOR(F.lit(0xFFFFFFFF))
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        m = F.lit(mask).cast("long")
        x = F.shiftleft(x.bitwiseAND(m), shift).bitwiseOR(F.shiftright(x, shift).bitwiseAND(m))
    return x


def little_endian(x: Column, n: int) -> Column:
    """A number as n little-endian bytes in hex."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(n)])


def number(hexed: Column, offset: int, n: int) -> Column:
    """The number in n little-endian bytes at a byte offset of a hex string."""
    parts = [F.conv(F.substring(hexed, 1 + 2 * (offset + i), 2), 16, 10).cast("long") * (1 << (8 * i)) for i in range(n)]
    return sum(parts[1:], parts[0])


def head(channels: Column, rate: Column, gain: Column) -> Column:
    """The identification header in hex: version 1, mapping family 0."""
    return F.concat(F.hex(F.lit(HEAD_MAGIC)), F.lit("01"), little_endian(channels, 1), F.lit("3801"), little_endian(rate, 4), little_endian(gain, 2), F.lit("00"))


def tags(vendor: Column, comments: Column) -> Column:
    """The comment header in hex: every string after its length."""
    one = lambda s: F.concat(little_endian(F.octet_length(s), 4), F.hex(s))
    return F.concat(F.hex(F.lit(TAGS_MAGIC)), one(vendor), little_endian(F.size(comments), 4), F.array_join(F.transform(comments, one), ""))


#: Bytes of an identification header without a mapping table; the parts of its fields.
HEAD_BYTES = 19
HEAD_KIND = "error:string,version:int,channels:int,pre_skip:int,rate:bigint,gain:int,family:int,streams:int,coupled:int,mapping:binary"
TAGS_KIND = "error:string,vendor:binary,comments:array<binary>"


def parse_head(data: Column) -> Column:
    """struct<HEAD_KIND> of an identification header; error is the first check that fails, null if none does.

    A sound header's mapping table (streams, coupled, a byte for each channel) is null for family 0. Fields of an unsound one
    are null. Bytes after the header are ignored; a null packet is an empty one.
    """
    data = F.coalesce(data, F.lit(b""))
    hexed, n = F.hex(F.substring(data, 1, 21)), F.octet_length(data)
    version, channels, gain, family = number(hexed, 8, 1), number(hexed, 9, 1), number(hexed, 16, 2), number(hexed, 18, 1)
    error = (
        F.when(n < HEAD_BYTES, "too short").when(F.substring(data, 1, 8) != F.lit(HEAD_MAGIC.encode()), "bad magic").when(version >= 16, "unsupported version")
        .when(channels == 0, "no channels").when((family == 0) & (channels > 2), "too many channels").when((family != 0) & (n < HEAD_BYTES + 2 + channels), "mapping table truncated")
    )
    good, table = error.isNull(), error.isNull() & (family != 0)
    fields = [version, channels, number(hexed, 10, 2), number(hexed, 12, 4), F.when(gain >= 32768, gain - 65536).otherwise(gain), family]
    mapped = [number(hexed, 19, 1), number(hexed, 20, 1), F.substring(data, F.lit(22), channels.cast("int"))]
    names = [f.split(":")[0] for f in HEAD_KIND.split(",")]
    values = [error, *(F.when(good, f) for f in fields), *(F.when(table, f) for f in mapped)]
    return F.struct(*(v.alias(name) for v, name in zip(values, names, strict=True))).cast(f"struct<{HEAD_KIND}>")


def _tags(data: bytes) -> dict:
    """Every length is held against what is left; bytes after the last comment are ignored."""
    if len(data) < 12:
        return {"error": "too short"}
    if data[:8] != TAGS_MAGIC.encode():
        return {"error": "bad magic"}
    size = int.from_bytes(data[8:12], "little")
    at = 12 + size
    if at > len(data):
        return {"error": "vendor overruns packet"}
    vendor, comments = data[12:at], []
    if at + 4 > len(data):
        return {"error": "missing comment count"}
    count, at = int.from_bytes(data[at : at + 4], "little"), at + 4
    for i in range(count):
        if at + 4 > len(data):
            return {"error": f"comment {i} length truncated"}
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4 + size
        if at > len(data):
            return {"error": f"comment {i} overruns packet"}
        comments.append(data[at - size : at])
    return {"vendor": vendor, "comments": comments}


def parse_tags(data: Column) -> Column:
    """struct<TAGS_KIND> of a comment header: vendor and comments as bytes in order, or the first length that overruns the packet.

    A packet says how many comments it holds and how long each is, so it is walked once; nothing is read or kept beyond its
    end, whatever it says. A null packet is an empty one.
    """
    kind = pa.struct([("error", pa.string()), ("vendor", pa.binary()), ("comments", pa.list_(pa.binary()))])

    @F.arrow_udf(f"struct<{TAGS_KIND}>")
    def walked(packets: pa.Array) -> pa.Array:
        return pa.array([_tags(x.as_py() or b"") for x in packets], kind)

    return walked(data)
