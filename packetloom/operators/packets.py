"""Parsing and re-framing of packets as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import header as h
from . import ordered, rates
from .container import bytes_of

#: The longest frame, in bytes, and the longest packet, in samples at 48 kHz.
MOST_FRAME, MOST_SAMPLES = 1275, 5760


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _byte(data: Column, at: Column) -> Column:
    """The byte at an offset of a binary column, null beyond its end."""
    return F.conv(F.nullif(F.hex(F.substring(data, at.cast("int") + 1, F.lit(1))), F.lit("")), 16, 10).cast("long")


def parse(data: Column, self_delimited: bool = False) -> Column:
    """struct(error, sizes, offset, padding) of a packet given as a binary column.

    sizes are the frames' lengths, offset is where the first begins, padding the bytes after the last. error is null if
    the packet is valid, else `empty` or `invalid` (sizes and offset are then not to be used); a null packet is empty.
    Only the two first bytes, the padding's fields and the frames' length fields are looked at, not the frames.
    """
    long = lambda x: F.lit(x).cast("long")
    none = F.array().cast("array<bigint>")
    state = "struct<at:bigint,left:bigint,sizes:array<bigint>,bad:boolean>"

    def head(x):
        code, count = x["toc"].bitwiseAND(3), h.frame_count(x["toc"], x["second"])
        vbr = F.coalesce(x["second"].bitwiseAND(128) != 0, F.lit(False))
        padded = (code == 3) & F.coalesce(x["second"].bitwiseAND(64) != 0, F.lit(False))
        # padding: each byte of 255 stands for 254 and another byte; the first other byte, after `full` of them, ends the field
        rest = F.decode(F.substring(data, F.lit(3), F.octet_length(data)), "ISO-8859-1")
        full = F.when(padded, (F.length(rest) - F.length(F.ltrim(rest, F.lit("\u00ff")))).cast("long"))
        return F.struct(x["n"].alias("n"), code.alias("code"), count.alias("count"), vbr.alias("vbr"), padded.alias("padded"), full.alias("full"), _byte(data, 2 + full).alias("stop"), (count * h.samples_per_frame(x["toc"])).alias("samples"))

    def begin(x):
        at = F.when(x["code"] != 3, 1).when(~x["padded"], 2).otherwise(3 + x["full"])
        left = F.when(x["code"] != 3, x["n"] - 1).when(~x["padded"], x["n"] - 2).otherwise(x["n"] - 3 - 255 * x["full"] - x["stop"])
        bad = ((x["code"] == 3) & ((x["n"] < 2) | (x["count"] == 0) | (x["samples"] > MOST_SAMPLES))) | (x["padded"] & x["stop"].isNull()) | (left < 0)
        bad = F.coalesce(bad, F.lit(True))
        fields = F.when(bad, 0).when((x["code"] == 2) | ((x["code"] == 3) & x["vbr"]), x["count"] - 1).otherwise(0) + int(self_delimited)
        return F.struct(x.alias("head"), F.coalesce(at, x["n"]).cast("long").alias("at"), F.coalesce(left, long(0)).cast("long").alias("left"), bad.alias("bad"), fields.cast("long").alias("fields"))

    def read(x):
        # the bytes of the length fields, two at most for each
        region = F.when(x["fields"] > 0, bytes_of(F.substring(data, x["at"].cast("int") + 1, (2 * x["fields"]).cast("int")))).otherwise(F.array().cast("array<int>"))

        def fields(region):
            def field(s, _):
                i = (s["at"] - x["at"]).cast("int")
                first = F.get(region, i).cast("long")
                size = F.when(first >= 252, 4 * F.get(region, i + 1).cast("long") + first).otherwise(first)
                used = F.when(first >= 252, 2).otherwise(1)
                wrong = s["bad"] | size.isNull() | (s["left"] < used) | (size > s["left"] - used)
                return F.struct((s["at"] + used).alias("at"), (s["left"] - used).alias("left"), F.concat(s["sizes"], F.array(F.coalesce(size, long(0)))).alias("sizes"), wrong.alias("bad")).cast(state)

            start = F.struct(x["at"].alias("at"), x["left"].alias("left"), none.alias("sizes"), x["bad"].alias("bad")).cast(state)
            return F.aggregate(F.when(x["fields"] > 0, F.sequence(long(1), x["fields"])).otherwise(none), start, field)

        return _let(_let(region, fields), lambda s: finish(x["head"], s))

    def finish(x, s):
        total = F.aggregate(s["sizes"], long(0), lambda a, v: a + v)
        some = F.greatest(x["count"], long(1))
        equal = (x["code"] == 1) | ((x["code"] == 3) & ~x["vbr"])
        if self_delimited:  # the last field is that of the last frame, or of all if they are equal
            last = F.element_at(s["sizes"], -1)
            sizes = F.when(equal, F.array_repeat(last, some.cast("int"))).otherwise(s["sizes"])
            used = F.when(equal, last * x["count"]).otherwise(total)
            wrong = s["bad"] | (used > s["left"]) | (last > MOST_FRAME)
        else:
            share, rest = F.call_function("div", s["left"], some), s["left"] - total
            sizes = F.when(equal, F.array_repeat(share, some.cast("int"))).otherwise(F.concat(s["sizes"], F.array(rest)))
            used = s["left"]
            wrong = s["bad"] | (rest < 0) | (equal & (s["left"] % some != 0)) | (F.when(equal, share).otherwise(rest) > MOST_FRAME)
        error = F.when(x["n"] == 0, "empty").when(wrong, "invalid")
        return F.struct(error.alias("error"), F.when(error.isNull(), sizes).alias("sizes"), s["at"].alias("offset"), (x["n"] - s["at"] - used).alias("padding"))

    n = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    first = F.struct(n.alias("n"), _byte(data, F.lit(0)).alias("toc"), _byte(data, F.lit(1)).alias("second"))
    return _let(_let(_let(first, head), begin), read)


def frames(data: Column, parsed: Column) -> Column:
    """The frames of a valid packet as array<binary>, by what parse found; null if it is invalid. Empty frames are empty."""
    state = "struct<at:bigint,out:array<binary>>"
    start = F.struct(parsed["offset"].alias("at"), F.array().cast("array<binary>").alias("out")).cast(state)
    piece = lambda s, size: F.substring(data, (s["at"] + 1).cast("int"), size.cast("int"))
    return F.aggregate(parsed["sizes"], start, lambda s, size: F.struct((s["at"] + size).alias("at"), F.concat(s["out"], F.array(piece(s, size))).alias("out")).cast(state))["out"]


def packed_size(sizes: Column) -> Column:
    """struct(code, header, total): how frames of these lengths make one packet, by the shortest framing."""
    n = F.size(sizes)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    fields = F.aggregate(F.slice(sizes, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + F.when(x < 252, 1).otherwise(2))
    same = F.size(F.array_distinct(sizes)) == 1
    code = F.when(n == 1, 0).when((n == 2) & same, 1).when(n == 2, 2).otherwise(3)
    head = F.when(code <= 1, F.lit(1).cast("long")).when(code == 2, 1 + fields).when(same, F.lit(2).cast("long")).otherwise(2 + fields)
    return F.struct(code.alias("code"), head.alias("header"), (head + total).alias("total"))


def padding_fields(pad: Column) -> Column:
    """struct(full, last): bytes of 255 and the value of the byte after them that describe pad bytes of padding."""
    full = F.call_function("div", pad - 1, F.lit(255).cast("long"))
    return F.struct(full.alias("full"), (pad - 255 * full - 1).alias("last"))


def _size_hex(n: Column) -> Column:
    """A frame's length as its one- or two-byte field, in hex."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    first = 252 + n.bitwiseAND(3)
    return F.when(n < 252, byte(n)).otherwise(F.concat(byte(first), byte(F.shiftright(n - first, 2))))


def emit(toc: Column, frames: Column, begin: Column | None = None, end: Column | None = None, *, most: Column | None = None, pad: bool | Column = False, self_delimited: bool | Column = False) -> Column:
    """struct(error, data): frames begin to end (exclusive; all by default) as one packet with the header of toc.

    The framing is the shortest: one frame, two equal ones, two, or a counted list whose lengths are told unless they are
    equal. most is the longest packet allowed, pad fills the packet up to it with zeros, which only a counted list can
    carry. self_delimited tells the last frame's length too. error is `bad range` or `too small`; frames that are null or
    longer than MOST_FRAME give `bad frames`. parse of the data gives the frames.
    """
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    pad, self_delimited = flag(pad), flag(self_delimited)
    begin, end = F.lit(0) if begin is None else begin, F.size(frames) if end is None else end
    wrong = F.coalesce((begin < 0) | (begin >= end) | (end > F.size(frames)), F.lit(True))

    def measured(x):
        sizes = F.transform(x["f"], lambda b: F.octet_length(b).cast("long"))
        return F.struct(x["f"].alias("f"), sizes.alias("sizes"))

    def framed(x):
        n, last = F.size(x["f"]), F.element_at(x["sizes"], -1)
        own = F.when(self_delimited, F.when(last >= 252, 2).otherwise(1)).otherwise(0).cast("long")
        same = F.size(F.array_distinct(x["sizes"])) == 1
        fields = F.aggregate(F.slice(x["sizes"], 1, n - 1), F.lit(0).cast("long"), lambda a, v: a + F.when(v < 252, 1).otherwise(2))
        frames_total = F.aggregate(x["sizes"], F.lit(0).cast("long"), lambda a, v: a + v)
        short = packed_size(x["sizes"])
        listed = 2 + F.when(same, F.lit(0).cast("long")).otherwise(fields) + frames_total + own
        return F.struct(
            x["f"].alias("f"), x["sizes"].alias("sizes"), n.alias("n"), last.alias("last"), same.alias("same"), short["code"].alias("code"), (short["total"] + own).alias("short"),
            listed.alias("listed"), F.coalesce(most.cast("long") if most is not None else short["total"] + own, F.lit(0).cast("long")).alias("most"),
        )

    def written(x):
        counted = (x["n"] > 2) | (pad & (x["short"] < x["most"]))
        filled = F.when(counted & pad, F.greatest(x["most"] - x["listed"], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
        field = padding_fields(filled)
        byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
        code = F.when(counted, 3).otherwise(x["code"])
        count = x["n"] + F.when(x["same"], 0).otherwise(128) + F.when(filled > 0, 64).otherwise(0)
        described = F.when(filled > 0, F.concat(F.repeat(F.lit("FF"), field["full"].cast("int")), byte(field["last"]))).otherwise("")
        sized = F.when((code == 2) | ((code == 3) & ~x["same"]), F.slice(x["sizes"], 1, x["n"] - 1)).otherwise(F.array().cast("array<bigint>"))
        rest = F.when(filled > 0, F.repeat(F.lit("00"), (filled - field["full"] - 1).cast("int"))).otherwise("")
        hexed = F.concat(
            byte(toc.bitwiseAND(252) + code), F.when(code == 3, byte(count)).otherwise(""), described, F.array_join(F.transform(sized, _size_hex), ""), F.when(self_delimited, _size_hex(x["last"])).otherwise(""),
            F.array_join(F.transform(x["f"], lambda b: F.hex(b)), ""), rest,
        )
        small = F.when(counted, x["listed"]).otherwise(x["short"]) > x["most"]
        bad = F.exists(x["sizes"], lambda v: v.isNull() | (v > MOST_FRAME))
        error = F.when(F.coalesce(bad, F.lit(True)), "bad frames").when(small, "too small")
        return F.struct(error.alias("error"), F.when(error.isNull(), F.unhex(hexed)).alias("data"))

    none = F.struct(F.lit("bad range").alias("error"), F.lit(None).cast("binary").alias("data"))
    chosen = F.slice(frames, begin.cast("int") + 1, (end - begin).cast("int"))
    return F.when(wrong, none).otherwise(_let(_let(_let(F.struct(F.when(wrong, F.slice(frames, 1, 0)).otherwise(chosen).alias("f")), measured), framed), written))


def merge(packets: Column, self_delimited: bool = False) -> Column:
    """struct(error, toc, frames) of packets (array<binary>) whose frames are put behind each other.

    error is `invalid` if one of them isn't valid, if headers differ in more than the count code, or if more than 120 ms come
    together; `empty` if there are none. Use emit to write toc and frames.
    """
    packets = F.coalesce(packets, F.array().cast("array<binary>"))
    each = F.transform(packets, lambda d: F.struct(d.alias("d"), parse(d, self_delimited).alias("x")))
    state = "struct<error:string,toc:bigint,frames:array<binary>>"

    def add(s, e):
        toc = _byte(e["d"], F.lit(0))
        all_ = F.concat(s["frames"], frames(e["d"], e["x"]))
        wrong = s["error"].isNotNull() | e["x"]["error"].isNotNull() | (F.coalesce(s["toc"], toc).bitwiseAND(252) != toc.bitwiseAND(252)) | (F.size(all_) * h.samples_per_frame(toc) > MOST_SAMPLES)
        wrong = F.coalesce(wrong, F.lit(True))
        bad = F.struct(F.lit("invalid").alias("error"), F.lit(None).cast("bigint").alias("toc"), F.array().cast("array<binary>").alias("frames")).cast(state)
        return F.when(wrong, bad).otherwise(F.struct(F.lit(None).cast("string").alias("error"), F.coalesce(s["toc"], toc).alias("toc"), all_.alias("frames")).cast(state))

    start = F.struct(F.lit(None).cast("string").alias("error"), F.lit(None).cast("bigint").alias("toc"), F.array().cast("array<binary>").alias("frames")).cast(state)
    found = F.aggregate(each, start, add)
    return _let(found, lambda s: F.struct(F.when(s["error"].isNull() & s["toc"].isNull(), "empty").otherwise(s["error"]).alias("error"), s["toc"].alias("toc"), s["frames"].alias("frames")))


def pad(data: Column, length: Column) -> Column:
    """struct(error, data): a packet grown to exactly `length` bytes; one of that length is left as it is.

    error is `invalid` if the packet isn't valid, `bad length` if it is empty or longer.
    """
    n = F.coalesce(F.octet_length(data), F.lit(0))
    none = F.lit(None).cast("binary")

    def grown(x):
        return F.when(x["error"].isNotNull(), F.struct(F.lit("invalid").alias("error"), none.alias("data"))).otherwise(emit(_byte(data, F.lit(0)), frames(data, x), most=length, pad=True))

    kept = F.struct(F.lit(None).cast("string").alias("error"), data.alias("data"))
    return F.when((n < 1) | (n > length), F.struct(F.lit("bad length").alias("error"), none.alias("data"))).when(n == length, kept).otherwise(_let(parse(data), grown))


def regroup(frames: DataFrame, stream: str, order: list[str], most_samples: int = MOST_SAMPLES) -> DataFrame:
    """Packets of consecutive frames (stream, toc, size, samples) of one stream and header; none longer than most_samples.

    order begins with a timestamp. One row (stream, first, toc, n_frames, code, header, total) a packet, first being the row number of its first frame.
    A run of one header is told by the number of its first row, so each packet is a group of bounded size.
    """
    rows = ordered.along(frames, stream, order, {"n": F.lit(1)}, {"before": "toc"})
    fresh = ~F.coalesce(F.col("before") == F.col("toc"), F.lit(False))
    rows = rates.hysteresis(rows, stream, order, F.when(fresh, F.col("n")), 1, "start")
    per = F.greatest(F.lit(1).cast("long"), F.call_function("div", F.lit(most_samples).cast("long"), F.col("samples")))
    rows = rows.withColumn("packet", F.call_function("div", F.col("n") - F.col("start"), per))
    grouped = rows.groupBy(stream, "start", "packet").agg(F.min("n").alias("first"), F.min("toc").alias("toc"), F.array_sort(F.collect_list(F.struct("n", "size"))).alias("f"))
    x = packed_size(F.col("f.size"))
    return grouped.select(stream, "first", "toc", F.size("f").alias("n_frames"), x["code"].alias("code"), x["header"].alias("header"), x["total"].alias("total"))
