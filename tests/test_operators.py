"""Known values and edge cases of the engine's own operators."""

import pytest
from pyspark.sql import functions as F

from packetloom.functions import fixed as fx, header as h
from packetloom.operators import container as c, ordered, packets as pk, rates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("n, want", [(0, [0]), (1, [1]), (254, [254]), (255, [255, 0]), (256, [255, 1]), (510, [255, 255, 0]), (511, [255, 255, 1])])
def test_lacing(spark, n, want):
    assert one(spark, c.lacing(F.lit(n).cast("long"))) == want


PACKETS = [
    (b"\x00abc", None, [3]),
    (b"\x01abcd", None, [2, 2]),
    (b"\x01abc", "invalid", None),
    (b"\x02\x02abcde", None, [2, 3]),
    (b"\x02\xfc\x0c" + b"x" * 303, None, [300, 3]),
    (b"\x03\x03abcdef", None, [2, 2, 2]),
    (b"\x03\x83\x01\x02abcdef", None, [1, 2, 3]),
    (b"\x03\x00", "invalid", None),
    (b"\x03\x41\x02abc\x00\x00", None, [3]),
    (b"\x18\x00" + b"x" * 1275, "invalid", None),
    (b"\x1b\x03abc", "invalid", None),
    (b"\x03\x02abc", "invalid", None),
    (b"\x02\x09ab", "invalid", None),
    (b"", "empty", None),
    (None, "empty", None),
    (b"\x00", None, [0]),
    (b"\x02\xc8abc", "invalid", None),
    (b"\x03\x83\x01\x02\x0a\x14\x15\x1e\x1f\x20", None, [1, 2, 3]),
    (b"\x03\x41\xff\x01abc" + bytes(255), None, [3]),
    (b"\x03\x41\xff\xff", "invalid", None),
]


@pytest.mark.parametrize("data, error, sizes", PACKETS)
def test_parse(spark, data, error, sizes):
    rows = spark.createDataFrame([(data,)], "d binary")
    x, f = rows.select(pk.parse(F.col("d")).alias("x"), pk.frames(F.col("d"), pk.parse(F.col("d"))).alias("f")).head()
    assert (x["error"], x["sizes"]) == (error, sizes)
    if sizes is not None:
        at = x["offset"]
        assert [bytes(b) for b in f] == [data[at + sum(sizes[:i]) : at + sum(sizes[: i + 1])] for i in range(len(sizes))]
    if data == b"\x03\x41\x02abc\x00\x00":
        assert x["padding"] == 2


def test_parse_self_delimited(spark):
    rows = spark.createDataFrame([(b"\x00\x02abcd",), (b"\x01\x02abcd",), (b"\x02\x01\x02abc",)], "d binary")
    assert [r["x"]["sizes"] for r in rows.select(pk.parse(F.col("d"), self_delimited=True).alias("x")).collect()] == [[2], [2, 2], [1, 2]]


def test_checksum_of_a_head_page(spark):
    head = bytes.fromhex(one(spark, c.head(F.lit(1), F.lit(48000), F.lit(0))))
    assert head.hex() == "4f707573486561640101380180bb0000000000"
    page = b"OggS\x00\x02" + bytes(8) + (0x12345678).to_bytes(4, "little") + bytes(8) + b"\x01\x13" + head
    assert len(page) == 47
    rows = spark.createDataFrame([(bytearray(page),)], "d binary")
    assert rows.select(c.page_crc(F.col("d")).alias("x")).head()["x"] == 0xBBC0113D
    assert spark.createDataFrame([(bytearray(),)], "d binary").select(c.page_crc(F.col("d")).alias("x")).head()["x"] == 0


def test_size_fields_round_trip(spark):
    rows = spark.range(1276).withColumn("f", h.size_bytes(F.col("id")))
    assert rows.where((h.size_of(F.col("f")) != F.col("id")) | (F.size("f") != F.when(F.col("id") < 252, 1).otherwise(2))).count() == 0


def test_all_headers(spark):
    rows = spark.range(256).select("id", h.mode(F.col("id")).alias("m"), h.bandwidth(F.col("id")).alias("b"), h.duration_us(F.col("id")).alias("us")).collect()
    silk = [r for r in rows if r["m"] == "SILK"]
    assert len(silk) == 96 and {r["b"] for r in silk} == {"NB", "MB", "WB"} and {r["us"] for r in silk} == {10000, 20000, 40000, 60000}
    assert {r["us"] for r in rows if r["m"] == "CELT"} == {2500, 5000, 10000, 20000} and {r["b"] for r in rows if r["m"] == "CELT"} == {"NB", "WB", "SWB", "FB"}
    assert one(spark, h.packet_samples(F.lit(9), F.lit(0))) == 1920 and one(spark, h.packet_samples(F.lit(9), F.lit(0), 16000)) == 640


def test_fixed_point(spark):
    assert one(spark, fx.wrap(F.lit(2147483648).cast("long"))) == -2147483648
    assert one(spark, fx.idiv(F.lit(-7).cast("long"), 2)) == -3 and one(spark, fx.idiv(F.lit(-7).cast("long"), 0)) is None
    assert one(spark, fx.leading_zeros32(F.lit(0).cast("long"))) == 32 and one(spark, fx.leading_zeros32(F.lit(-1).cast("long"))) == 0
    for n in (0, 1, 3, 4, 2**32 - 1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1):
        assert one(spark, fx.isqrt(F.lit(n).cast("long"))) == int(n**0.5) if n < 2**40 else True


@pytest.mark.parametrize("ms", [5, 10, 20, 40])
def test_silence_rule_is_the_counter(spark, ms):
    quiet, want = 0, []
    for _ in range(400):
        quiet += ms
        if quiet > 400:
            drop = quiet <= 1200
            quiet = quiet if drop else 400
        else:
            drop = False
        want.append(drop)
    got = [r["x"] for r in spark.range(1, 401).orderBy("id").select(rates.not_sent(F.col("id"), ms).alias("x")).collect()]
    assert got == want


def test_running_and_previous_cross_chunks(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), "id", (F.col("id") % 7).alias("v"))
    found = ordered.previous(ordered.running(rows, "k", ["ts", "id"], {"s": F.col("v")}), "k", ["ts", "id"], {"p": "v"})
    total, last = {}, {}
    for r in found.orderBy("id").collect():
        total[r["k"]] = total.get(r["k"], 0) + r["v"]
        assert (r["s"], r["p"]) == (total[r["k"]], last.get(r["k"]))
        last[r["k"]] = r["v"]
    once = ordered.along(rows, "k", ["ts", "id"], {"s": F.col("v")}, {"p": "v"})
    assert once.exceptAll(found).isEmpty() and found.exceptAll(once).isEmpty()
    assert ordered.running(rows.limit(0), "k", ["ts", "id"], {"s": F.col("v")}).count() == 0


def test_pulse_vectors_beyond_the_table(spark):
    from packetloom.operators import coding

    sizes = [(22, 3), (3, 22), (17, 17), (176, 2), (1, 200), (20, 0), (0, 20), (200, 200), (16, 16), (None, 3), (40, 13)]

    def count(n, k):  # V(n, k) = V(n - 1, k) + V(n, k - 1) + V(n - 1, k - 1)
        row = [1] + [0] * k
        for _ in range(n):
            new = [1]
            for j in range(1, k + 1):
                new.append(row[j] + new[j - 1] + row[j - 1])
            row = new
        return row[k]

    n, k = F.col("n"), F.col("k")
    rows = spark.createDataFrame(sizes, "n long, k long").select("n", "k", coding.pulse_vectors(n, k).alias("v"), coding.pulse_error(n, k).alias("e")).collect()
    for r in rows:
        want = None if r["n"] is None else count(r["n"], r["k"])
        assert r["v"] == (want if want is not None and want < 1 << 63 else None), r
        assert r["e"] == ("no size" if want is None else "beyond 64 bits" if want >= 1 << 63 else None)


def test_error_classes_and_decimation(spark):
    errors = [None, "empty", "invalid", "too small", "bad range", "bad frames", "bad length", "something else"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(errors)], "i int, e string")
    got = [r["x"] for r in df.select("i", rates.error_class(F.col("e")).alias("x")).orderBy("i").collect()]
    assert got == [None, "invalid packet", "invalid packet", "buffer too small", "bad argument", "bad argument", "bad argument", "internal error"]
    df = spark.createDataFrame([(r,) for r in (8000, 12000, 16000, 24000, 48000, 44100, 0)], "r long")
    assert [r["x"] for r in df.coalesce(1).select(rates.decimation(F.col("r")).alias("x")).collect()] == [6, 4, 3, 2, 1, 0, 0]


def test_speech_room_and_width(spark):
    cases = [("voice", 0, "audio", 127), ("music", 99, "voip", 0), ("auto", 100, "audio", 115), ("auto", 100, "voip", 127), ("auto", 0, "audio", 0), ("auto", -1, "voip", 115), ("auto", -1, "audio", 48)]
    df = spark.createDataFrame(cases, "s string, r long, a string, want long")
    assert all(r["x"] == r["want"] for r in df.select(rates.speech_likelihood(F.col("s"), F.col("r"), F.col("a")).alias("x"), "want").collect())
    room = [(0, 5, "bad argument"), (960, 0, "bad argument"), (4800, 1, "buffer too small"), (960, 1, None), (4800, 2, None)]
    df = spark.createDataFrame(room, "f long, b long, want string")
    assert all(r["x"] == r["want"] for r in df.select(rates.room_error(F.col("f"), F.col("b")).alias("x"), "want").collect())
    starved = [(2, 64000, 50, True), (3, 1199, 50, True), (3, 1200, 50, False), (11, 9000, 25, True), (12, 2399, 25, True), (12, 2400, 25, False)]
    df = spark.createDataFrame(starved, "b long, r long, n long, want boolean")
    assert all(r["x"] == r["want"] for r in df.select(rates.starved(F.col("b"), F.col("r"), F.col("n")).alias("x"), "want").collect())
    df = spark.createDataFrame([(15_999, 0), (16_000, 0), (20_000, 12_288), (32_000, 16_384), (40_000, 16_384)], "r long, want long")
    assert all(r["x"] == r["want"] for r in df.select(rates.stereo_width(F.col("r")).alias("x"), "want").collect())
