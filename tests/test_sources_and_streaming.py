"""Files are read back as they were written, and the streamed census equals the batch one."""

import struct
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from packetloom.sources import files, fixtures
from packetloom.streaming import census

SF = "/root/testdata/sf0.001"


def test_pages_round_trip(spark):
    p = fixtures.packets(spark, SF).where("stream_id < 40").withColumn("data", F.encode(F.repeat(F.lit("x"), F.col("n_bytes").cast("int")), "UTF-8"))
    written = files.pages(p, "stream_id", ["ts", "event_id"], "data", "event_id")
    joined = written.groupBy("stream_id" if "stream_id" in written.columns else "stream").agg(F.array_sort(F.collect_list(F.struct("page", "content"))).alias("x")).collect()
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    for r in joined:
        (folder / f"{r[0]}.ogg").write_bytes(b"".join(x["content"] for x in r["x"]))
    read = files.read_pages(files.read_binary(spark, str(folder)))
    assert read.where("error is not null").count() == 0
    assert read.where(F.col("flags").bitwiseAND(2) != 0).count() == read.where(F.col("flags").bitwiseAND(4) != 0).count() == len(joined)
    sizes = sorted((int(Path(r["path"]).stem), r["packet"], r["size"]) for r in files.packets_of(read).collect())
    want, at = [], {}
    for r in p.orderBy("stream_id", "ts", "event_id").collect():
        want.append((r["stream_id"], at.get(r["stream_id"], 0), r["n_bytes"]))
        at[r["stream_id"]] = at.get(r["stream_id"], 0) + 1
    assert sizes == want


def test_broken_pages_and_records(spark):
    rows = [("a", b""), ("b", b"OggS"), ("c", b"junk" * 10), ("d", b"OggS\x01" + bytes(30)), ("e", b"OggS" + bytes(23)), ("f", b"OggS\x00\x00" + bytes(20) + b"\x01\x03abc")]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    assert {r["path"]: r["error"] for r in files.read_pages(df).collect()} == {"b": "unexpected end", "c": "not a page", "d": "unknown version", "e": "no segments", "f": "bad checksum"}
    data = struct.pack(">II", 3, 7) + b"abc" + struct.pack(">II", 0, 9) + struct.pack(">II", 5, 1) + b"xy"
    df = spark.createDataFrame([("r", bytearray(data)), ("s", bytearray(b"\0")), ("t", None)], "path string, content binary")
    got = [(r["path"], r["record"], r["final_range"], r["error"]) for r in files.read_records(df).orderBy("path", "record").collect()]
    assert got == [("r", 0, 7, None), ("r", 1, 9, None), ("r", 2, 1, "unexpected end"), ("s", 0, None, "unexpected end")]


def test_wav_and_samples(spark):
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 44100, 44100 * 4, 4, 16)
    body = struct.pack("<hhhh", 1, -2, 32767, -32768)
    wav = b"RIFF" + struct.pack("<I", 99) + b"WAVE" + fmt + b"LIST" + struct.pack("<I", 2) + b"xx" + b"data" + struct.pack("<I", 8) + body
    df = spark.createDataFrame([(bytearray(wav),), (bytearray(b"RIFX"),), (bytearray(wav.replace(struct.pack("<I", 8) + body, b"\xff\xff\xff\xff")),)], "content binary").coalesce(1)
    a, b, u = [r["x"] for r in df.select(files.wav_header(F.col("content")).alias("x")).collect()]
    assert (a["error"], a["channels"], a["rate"], a["data_bytes"], a["n_samples"]) == (None, 2, 44100, 8, 2) and wav[a["data_at"] :] == body
    assert b["error"] == "not RIFF" and u["data_bytes"] is None
    seconds = [r["x"] for r in df.select(files.wav_seconds(files.wav_header(F.col("content"))).alias("x")).collect()]
    assert seconds == [2 / 44100, None, None]
    s = spark.createDataFrame([(bytearray(body + b"z"),), (bytearray(),)], "c binary").coalesce(1).select(files.samples_of(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in s] == [[1, -2, 32767, -32768], []]


def test_wav_chunks_are_walked(spark):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    fmt = lambda tag, bits=16, channels=1, rate=8000, rest=b"": chunk(b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, 0, 0, bits) + rest)
    wide = lambda tag: struct.pack("<HHIH", 22, 16, 0, tag) + bytes(14)
    data = chunk(b"data", b"\1\0\2\0")
    cases = [
        ([fmt(1), chunk(b"bext", bytes(70_001)), data], None), ([chunk(b"JUNK", bytes(29)), fmt(1), data], None), ([fmt(1), chunk(b"LIST", b"INFOdata" + b"\xff" * 9), data], None),
        ([fmt(0xFFFE, rest=wide(1)), data], None), ([fmt(0xFFFE, rest=wide(3)), data], "not 16-bit PCM"), ([fmt(0xFFFE), data], "no format"), ([fmt(3, 32), data], "not 16-bit PCM"), ([fmt(1, 24), data], "not 16-bit PCM"),
        ([fmt(1, channels=0), data], "no channels"), ([fmt(1, rate=0), data], "no rate"), ([data, fmt(1)], "no format"), ([fmt(1), chunk(b"LIST", b"data")], "no data"), ([fmt(1), b"LIST\xff\xff\xff\x7f", data], "no data"), ([], "no format"),
    ]
    files_of = [b"RIFF" + bytes(4) + b"WAVE" + b"".join(parts) for parts, _ in cases]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files_of)] + [(len(cases), None)], "i int, content binary")
    got = [r["x"] for r in df.select("i", files.wav_header(F.col("content")).alias("x")).orderBy("i").collect()]
    assert [g["error"] for g in got] == [e for _, e in cases] + ["not RIFF"]
    for f, g in zip(files_of, got, strict=False):
        if g["error"] is None:
            assert (g["channels"], g["rate"], g["data_at"], g["data_bytes"], g["n_samples"]) == (1, 8000, len(f) - 4, 4, 2)


def test_streamed_census_is_the_batch_one(spark):
    packets = fixtures.packets(spark, SF)
    folder = tempfile.mkdtemp(prefix="spark-")
    packets.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(packets.schema).parquet(f"{folder}/in")
    q = census.windowed_census(stream, late="3650 days").writeStream.format("memory").queryName("census").outputMode("complete").option("checkpointLocation", f"{folder}/state").start()
    q.processAllAvailable()
    q.stop()
    got, want = (sorted(map(tuple, df.collect())) for df in (spark.table("census"), census.windowed_census(packets)))
    assert got == want and got
