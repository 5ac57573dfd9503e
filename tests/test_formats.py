"""Data sources, the page sink, packets from pages and header parsing: cut in any way they give the same rows."""

import random
import struct
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packetloom.operators import container as c
from packetloom.plans import container_queries
from packetloom.sources import files, formats


@pytest.fixture(scope="module")
def session(spark):
    formats.register(spark)
    return spark


def page(serial, sequence, packets_or_segments, flags=0, granule=0, body=None):
    """A page of whole packets, or of given segments and body."""
    if body is None:
        body = b"".join(packets_or_segments)
        segments = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets_or_segments)
    else:
        segments = bytes(packets_or_segments)
    head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, serial, sequence)
    return head + struct.pack("<I", c.checksum(head + bytes(4) + bytes([len(segments)]) + segments + body)) + bytes([len(segments)]) + segments + body


def folder(**contents):
    path = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, data in contents.items():
        (path / name.replace("__", ".")).write_bytes(data)
    return str(path)


def read(session, path, **options):
    return session.read.format("pages").options(**options).load(path)


def test_the_checksum(session):
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = ((crc << 1) ^ (c.POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    datas = [b"", b"\0", b"\0" * 9, b"\xff" * 7, bytes(range(256)), "é page".encode() * 5]
    assert [c.checksum(d) for d in datas] == [slow(d) for d in datas]
    df = session.createDataFrame([(i, bytearray(d)) for i, d in enumerate(datas)] + [(99, None)], "i int, d binary")
    assert [r.x for r in df.select("i", c.page_crc(F.col("d")).alias("x")).orderBy("i").collect()] == [*map(slow, datas), None]


def test_a_large_file_is_read_by_several_tasks(session):
    """100 MB of pages, some of whose packets hold pages themselves: the rows of one task, and of many."""
    random_ = random.Random(1)
    inner = page(9, 0, [b"inner"]) * 30
    parts = []
    for n in range(1600):
        parts.append(page(n % 3, n, [random_.randbytes(random_.randint(0, 40_000)), inner if n % 7 == 0 else b"OggS" * (n % 900), random_.randbytes(20_000)], granule=n))
    data = b"".join(parts)
    while len(data) < 100 << 20:
        data += data
    path = folder(a__ogg=data)
    one = read(session, path, splitBytes=str(1 << 40))
    many = read(session, path)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 1 and len(data) >= 100 << 20
    sums = [F.count("*"), F.sum("offset"), F.sum(F.xxhash64("flags", "granule", "serial", "sequence", "segments", "body") % 1_000_003), F.count("error")]
    assert one.agg(*sums).head() == many.agg(*sums).head()
    assert one.count() == len(data) // len(b"".join(parts)) * 1600


@pytest.mark.parametrize("split", [29, 97, 1000, 65_307, 1 << 30])
def test_any_cut_gives_the_same_rows(session, split):
    good = [page(1, n, [bytes([n]) * (n * 37)], granule=n) for n in range(12)]
    bad = bytearray(good[5])
    bad[40] ^= 1
    data = b"".join(good[:3]) + b"junk OggS junk" + b"".join(good[3:5]) + bytes(bad) + good[6] + b"OggS\x01" + bytes(40) + good[7] + b"OggS" + bytes(23) + good[8] + good[9][:-3]
    if split < 97:
        data = data[:700]
    rows = [tuple(r) for r in read(session, folder(x__ogg=data), splitBytes=str(split)).orderBy("offset").collect()]
    if split >= 97:
        assert [(r.sequence if isinstance(r, dict) else r[5], r[8]) for r in rows] == [
            (0, None), (1, None), (2, None), (None, "not a page"), (3, None), (4, None), (5, "bad checksum"), (6, None), (None, "unknown version"), (7, None), (0, "no segments"), (8, None), (9, "unexpected end"),
        ]
        assert [r[5] for r in rows if r[8] is None] == [0, 1, 2, 3, 4, 6, 7, 8]
    whole = [tuple(r) for r in read(session, folder(x__ogg=data)).orderBy("offset").collect()]
    assert [r[1:] for r in rows] == [r[1:] for r in whole] and rows


def test_folders_empty_files_and_names(session):
    path = folder(a__ogg=page(1, 0, [b"x"]), b__ogg=b"", _hidden=b"junk", c__ogg=page(2, 0, [b"y"]))
    (Path(path) / "deep").mkdir()
    (Path(path) / "deep" / "d.ogg").write_bytes(page(3, 0, [b"z"]))
    assert sorted(r.serial for r in read(session, path).collect()) == [1, 2, 3]
    assert [r.serial for r in read(session, f"file://{path}/c.ogg").collect()] == [2]
    assert read(session, folder()).collect() == []


def audio(n):
    return [bytes([k % 251]) * (k * 113 % 1400) for k in range(n)]


def stream(serial, packets, tags=(), head=b"OpusHead\x01\x02\x38\x01\x80\xbb\0\0\0\0\0"):
    vendor = b"maker"
    comment = b"OpusTags" + struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(tags)) + b"".join(struct.pack("<I", len(t)) + t for t in tags)
    out = page(serial, 0, [head], flags=2) + page(serial, 1, [comment])
    for k, p in enumerate(packets):
        out += page(serial, 2 + k, [p], flags=4 if k == len(packets) - 1 else 0, granule=960 * (k + 1))
    return out


def test_packets_over_pages(session):
    long, short = bytes(range(256)) * 400, b"short"
    k = len(long)
    pieces = [long[: 255 * 255], long[255 * 255 :]]
    rest = [255] * (len(pieces[1]) // 255) + [len(pieces[1]) % 255]
    data = page(1, 0, [b"begin"], flags=2) + page(1, 1, [255] * 255, body=pieces[0], granule=-1) + page(2, 0, [b"other"], flags=2) + page(1, 2, rest + [5], flags=1, granule=7, body=pieces[1] + short)
    # a stale packet: opened, then a page that doesn't go on; then a page that goes on with none; then an end and what follows it
    data += page(1, 3, [255], body=b"s" * 255) + page(1, 4, [b"fresh"], granule=8) + page(1, 5, [4], flags=1, body=b"tail", granule=9) + page(1, 6, [255, 0], body=b"q" * 255, flags=4, granule=10) + page(1, 7, [b"late"])
    path = folder(x__ogg=data)
    want = [(1, 0, 0, b"begin"), (1, 1, 7, long), (1, 2, 7, short), (1, 3, 8, b"fresh"), (1, 4, 9, b"tail"), (1, 5, 10, b"q" * 255), (2, 0, 0, b"other")]
    for split in ("9000", "99999999"):
        got = files.packets_with_payloads(read(session, path, splitBytes=split), "offset").orderBy("serial", "packet").collect()
        assert [(r.serial, r.packet, r.granule, bytes(r.payload)) for r in got] == want and k > 65_025
    whole = files.packets_with_payloads(files.read_pages(files.read_binary(session, path))).orderBy("serial", "packet").collect()
    assert [(r.serial, r.packet, r.granule, bytes(r.payload)) for r in whole] == want
    assert files.packets_with_payloads(read(session, folder()), "offset").collect() == []


def test_streams(session):
    good, cut = stream(1, audio(9), [b"TITLE=x", b"", "é".encode()]), stream(3, audio(1))
    data = good + stream(2, audio(2), head=b"OpusHead\x10\x02" + bytes(9)) + cut[: len(page(3, 0, [b"OpusHead\x01\x02\x38\x01\x80\xbb\0\0\0\0\0"]))] + page(4, 1, [b"x"]) + page(5, 0, [], flags=2, body=b"")
    got = {r.serial: r for r in files.streams(read(session, folder(x__ogg=data)), "offset").collect()}
    assert (got[1].n_pages, got[1].n_packets, got[1].final_granule, got[1].n_samples, got[1].error) == (11, 9, 8640, 8640 - 312, None)
    assert (got[1].head.channels, got[1].head.rate, got[1].head.mapping) == (2, 48000, None)
    assert [bytes(x) for x in got[1].tags.comments] == [b"TITLE=x", b"", "é".encode()] and bytes(got[1].tags.vendor) == b"maker"
    assert {s: r.error for s, r in got.items()} == {1: None, 2: "unsupported version", 3: "ended before comment header", 4: "first page begins no stream"}
    assert got[3].final_granule is None and got[3].n_samples is None


def test_identification_headers(session):
    base = bytes.fromhex("4f707573486561640101380180bb0000000000")
    family = b"OpusHead\x01\x03" + bytes(8) + b"\x01\x02\x01\x00\x01\x02"
    cases = [
        (base, None), (base + b"more", None), (base[:18], "too short"), (None, "too short"), (b"OpusHeaD" + base[8:], "bad magic"), (base[:8] + b"\x10" + base[9:], "unsupported version"), (base[:8] + b"\x0f" + base[9:], None),
        (base[:9] + b"\0" + base[10:], "no channels"), (base[:9] + b"\3" + base[10:], "too many channels"), (family, None), (family[:-1], "mapping table truncated"),
    ]
    df = session.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "i int, d binary")
    got = [r.x for r in df.select("i", c.parse_head(F.col("d")).alias("x")).orderBy("i").collect()]
    assert [g.error for g in got] == [e for _, e in cases]
    assert (got[0].version, got[0].channels, got[0].pre_skip, got[0].rate, got[0].gain, got[0].family, got[0].streams) == (1, 1, 312, 48000, 0, 0, None)
    assert (got[9].streams, got[9].coupled, bytes(got[9].mapping)) == (2, 1, b"\0\1\2") and got[2].channels is None
    negative = session.createDataFrame([(bytearray(base[:16] + struct.pack("<h", -300) + b"\0"),)], "d binary").select(c.parse_head(F.col("d")).alias("x")).head().x
    assert negative.gain == -300


def test_comment_headers(session):
    tags = lambda vendor, comments, count=None, rest=b"": b"OpusTags" + struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(comments) if count is None else count) + b"".join(struct.pack("<I", len(t)) + t for t in comments) + rest
    whole = tags(b"vendor!", [b"A=1", b"", b"\xff\0"])
    cases = [
        (whole, None), (whole + b"padding", None), (tags(b"", []), None), (None, "too short"), (whole[:11], "too short"), (b"opusTags" + whole[8:], "bad magic"), (b"OpusTags" + struct.pack("<I", 0xFFFFFFFF) + bytes(40), "vendor overruns packet"),
        (whole[:19], "missing comment count"), (whole[:23], "comment 0 length truncated"), (whole[:28], "comment 0 overruns packet"), (whole[:-1], "comment 2 overruns packet"), (tags(b"", [b"x"], 0xFFFFFFFF), "comment 1 length truncated"),
        (b"OpusTags" + struct.pack("<III", 0, 1, 0xFFFFFFF0), "comment 0 overruns packet"),
    ]
    df = session.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "i int, d binary")
    got = [r.x for r in df.select("i", c.parse_tags(F.col("d")).alias("x")).orderBy("i").collect()]
    assert [g.error for g in got] == [e for _, e in cases]
    assert bytes(got[0].vendor) == b"vendor!" and [bytes(x) for x in got[0].comments] == [b"A=1", b"", b"\xff\0"] and got[2].comments == [] and got[3].vendor is None


def test_the_sink_commits_whole_files(session):
    rows = [(s, n, bytearray(page(s, n, [bytes([s, n])], flags=2 if n == 0 else 0))) for s in range(7) for n in range(s + 1)]
    df = session.createDataFrame(rows, "stream long, page long, content binary")
    path = folder(old__ogg=page(99, 0, [b"old"]))
    ordered = df.repartition(3, "stream").sortWithinPartitions("stream", "page")
    ordered.write.format("pages").mode("append").save(path)
    got = sorted((r.serial, r.sequence, bytes(r.body)) for r in read(session, path).collect())
    assert got == sorted([(s, n, bytes([s, n])) for s, n, _ in rows] + [(99, 0, b"old")])
    ordered.write.format("pages").mode("overwrite").save(path)
    assert sorted((r.serial, r.sequence) for r in read(session, path).collect()) == sorted((s, n) for s, n, _ in rows)
    before = sorted(p.name for p in Path(path).iterdir())
    for broken in (df.repartition(1).orderBy(F.desc("page")), df.where("page > 0"), df.select("page", "stream", "content")):
        with pytest.raises(Exception, match="come in order|are written from"):
            broken.write.format("pages").mode("append").save(path)
    assert sorted(p.name for p in Path(path).iterdir()) == before and not any(p.is_dir() for p in Path(path).iterdir())


@pytest.mark.parametrize("split", ["50", "1001", "99999999"])
def test_wave_files_are_read_by_ranges(session, split):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    fmt = struct.pack("<HHIIHH", 1, 2, 44100, 44100 * 4, 4, 16)
    samples = [k * 7919 % 65536 - 32768 for k in range(20_001)]
    body = struct.pack(f"<{len(samples)}h", *samples)
    wav = lambda data: b"RIFF" + bytes(4) + b"WAVE" + chunk(b"LIST", b"INFO\0") + chunk(b"fmt ", fmt) + data
    path = folder(a__wav=wav(chunk(b"data", body) + chunk(b"LIST", b"after")) if split != "50" else wav(chunk(b"data", body[:803])), b__wav=b"RIFX", c__wav=wav(b"data\xff\xff\xff\xff" + body[:42]), d__wav=wav(struct.pack("<4sI", b"data", 400) + body[:42]), e__wav=wav(b""))
    got = {}
    for r in session.read.format("wave").option("splitBytes", split).load(path).orderBy("position").collect():
        got.setdefault(Path(r.path).name, []).append(r)
    whole = {name: [x for r in rows if r.error is None for x in r.samples] for name, rows in got.items()}
    n = 20_000 if split != "50" else 400
    assert whole == {"a.wav": samples[:n], "b.wav": [], "c.wav": samples[:20], "d.wav": samples[:20], "e.wav": []}
    at = 0
    for r in got["a.wav"]:
        assert (r.position, r.channels, r.rate, r.error) == (at, 2, 44100, None)
        at += len(r.samples) // 2
    assert {name: [r.error for r in rows if r.error] for name, rows in got.items()} == {"a.wav": [], "b.wav": ["not RIFF"], "c.wav": [], "d.wav": ["unexpected end"], "e.wav": ["no data"]}


def test_records_by_source_and_table_function(session):
    data = struct.pack(">II", 3, 7) + b"abc" + struct.pack(">II", 0, 0xFFFFFFFF) + struct.pack(">II", 5, 1) + b"xy"
    path = folder(r=data, s=b"\0", t=b"")
    want = [(0, 7, b"abc", None), (1, 0xFFFFFFFF, b"", None), (2, 1, b"xy", "unexpected end")]
    plain = lambda rows: [(r.record, r.final_range, None if r.payload is None else bytes(r.payload), r.error) for r in rows]
    assert plain(session.read.format("records").load(f"{path}/r").orderBy("record").collect()) == want
    assert plain(session.read.format("records").load(path).where("path like '%/s'").collect()) == [(0, None, None, "unexpected end")]
    files.read_binary(session, path).createOrReplaceTempView("f")
    rows = session.sql("SELECT f.path, r.* FROM f, LATERAL packet_records(f.content) AS r ORDER BY path, record").collect()
    assert plain(rows) == [*want, (0, None, None, "unexpected end")]


def test_written_pages_take_less_room_than_what_they_hold(session):
    """container_packets stores its pages compressed, and what it shuffled for them is gone once they are written."""
    shuffled = lambda: {*Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data")}
    known, before = shuffled(), session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = container_queries._written(session, "/root/testdata/sf0.01")
    paths = [r.path for r in pages.select("path").distinct().collect()]
    held = pages.agg(F.sum(F.octet_length("body")).alias("n")).head().n
    assert held > 7_000_000 and sum(Path(p).stat().st_size for p in paths) < held / 10
    assert not [f for f in shuffled() - known if f.exists() and f.stat().st_size > 100_000]
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_packets_are_moved_once_into_pages(session):
    p = session.range(9).select((F.col("id") % 2).alias("s"), F.col("id").alias("o"), F.lit(b"x").alias("payload"))
    assert files.pages(p, "s", ["o"], "payload", "o")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def walked(pages):
    """Packets (serial, packet, granule, payload) of pages (serial, flags, granule, segments, body, error) of one file in order."""
    state, out = {}, []
    for serial, flags, granule, segments, body, error in pages:
        s = state.setdefault(serial, {"n": 0, "open": b"", "over": False})
        if error or s["over"]:
            continue
        s["open"] = s["open"] if flags & 1 else b""
        at = 0
        for size in segments:
            s["open"] += body[at : at + size]
            at += size
            if size < 255:
                out.append((serial, s["n"], None if granule == -1 else granule, s["open"]))
                s["n"], s["open"] = s["n"] + 1, b""
        s["over"] = bool(flags & 4)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_pages_give_the_packets_of_a_walk(session, seed):
    """Pages of any flags and segments, dealt out in any way."""
    random_ = random.Random(seed)
    rows = []
    for at in range(400):
        segments = [random_.choice((255, 255, 0, 7, 254)) for _ in range(random_.randint(1, random_.choice((1, 3, 40, 255))))]
        segments = [255] * len(segments) if random_.random() < 0.2 else segments
        flags = random_.choice((0, 0, 1, 1, 1)) | (4 if random_.random() < 0.01 else 0)
        rows.append((random_.randint(0, 4), flags, random_.choice((-1, at)), segments, random_.randbytes(sum(segments)), "bad checksum" if random_.random() < 0.05 else None))
    made = session.createDataFrame([("f", at, f, g, s, at, x, bytearray(b), e) for at, (s, f, g, x, b, e) in enumerate(rows)], files.PAGE_SCHEMA)
    got = files.packets_with_payloads(made.repartition(7)).collect()
    assert sorted((r.serial, r.packet, r.granule, bytes(r.payload)) for r in got) == walked(rows)


def test_pages_of_any_packets_come_as_the_sink_takes_them(session):
    """Null and empty payloads, lengths about the marks, null streams and times: read back as they were."""
    lengths = [0, 1, 254, 255, 256, 65_024, 65_025, 65_026, 130_050, 200_000, 3]
    rows = [(s, None if n % 4 == 3 else n, n, None if n == 5 and s == 2 else bytearray(bytes([n + (s or 0)]) * lengths[(n + (s or 0)) % len(lengths)])) for s in (None, 1, 2, 3) for n in range(12)]
    df = session.createDataFrame(rows, "s long, t long, n long, data binary").repartition(5)
    for options in ({}, {"compression": "zstd"}):
        path = folder()
        files.pages(df, "s", ["t", "n"], "data", "n", serial=F.coalesce("stream", F.lit(9))).write.format("pages").options(**options).mode("append").save(path)
        got = files.packets_with_payloads(read(session, path, splitBytes="70000"), "offset").collect()
        want = []
        for s in (None, 1, 2, 3):
            own = sorted((r for r in rows if r[0] == s and r[3] is not None), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
            want += [(s or 9, k, bytes(r[3])) for k, r in enumerate(own)]
        assert sorted((r.serial, r.packet, bytes(r.payload)) for r in got) == sorted(want)
    text = session.createDataFrame([(1, 0, "é" * 300)], "s long, n long, data string")
    assert [len(r.content) for r in files.pages(text, "s", ["n"], "data", "n").collect()] == [27 + 3 + 600]


@pytest.mark.parametrize("split", ["1001", "300000", "1048576", "99999999"])
def test_compressed_files_are_read_by_ranges(session, split):
    """As what they decompress to; any reader of zstd reads them too, and a file that is only named so is read as it is."""
    import pyarrow as pa

    random_ = random.Random(2)
    n = 20 if split == "1001" else 900
    rows = [(1, k, bytearray(page(1, k, [random_.randbytes(random_.randint(0, 6000))], granule=k))) for k in range(n)]
    df = session.createDataFrame(rows, "stream long, page long, content binary").coalesce(1).sortWithinPartitions("page")
    path = folder(old__ogg=page(2, 0, [b"old"]))
    df.write.format("pages").option("compression", "zstd").mode("append").save(path)
    (name,) = Path(path).glob("*.zst")
    data = b"".join(bytes(r[2]) for r in rows)
    assert pa.CompressedInputStream(pa.OSFile(str(name)), "zstd").read() == data and (n < 100 or len(data) > 2 << 20)
    got = read(session, path, splitBytes=split)
    assert split == "99999999" or got.rdd.getNumPartitions() == -(-len(data) // int(split)) + 1
    key = lambda rows: [(r.offset, r.sequence, r.error, None if r.body is None else bytes(r.body)) for r in rows]
    raw = read(session, folder(x__ogg=data)).orderBy("offset").collect()
    assert key(got.where("serial = 1").orderBy("offset").collect()) == key(raw) and got.count() == n + 1
    assert [r.serial for r in read(session, folder(**{"x__ogg__zst": page(5, 0, [b"plain"])})).collect()] == [5]
    with pytest.raises(Exception, match="compression is none or zstd"):
        df.write.format("pages").option("compression", "gzip").mode("append").save(path)
