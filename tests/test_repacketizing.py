"""Packets written as bytes: what is emitted parses to the frames it was made of, in every framing."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import packets as pk

THREE = bytes([0x03, 0x83, 1, 2, 10, 20, 21, 30, 31, 32])  # frames of 1, 2 and 3 bytes


def of(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def frames_of(spark, datas, self_delimited=False):
    x = pk.parse(F.col("d"), self_delimited)
    both = F.struct(x["error"].alias("error"), pk.frames(F.col("d"), x).alias("f"), x["padding"].alias("padding"))
    return [(r["error"], [bytes(b) for b in r["f"] or []], r["padding"]) for r in of(spark, [(None if d is None else bytearray(d),) for d in datas], "d binary", both)]


def emitted(spark, rows, **kinds):
    """rows of (toc, frames, begin, end, most)."""
    column = pk.emit(F.col("toc"), F.col("f"), F.col("b"), F.col("e"), most=F.col("m"), **kinds)
    rows = [(t, f and [bytearray(x) if x is not None else None for x in f], b, e, m) for t, f, b, e, m in rows]
    return [(r["error"], None if r["data"] is None else bytes(r["data"])) for r in of(spark, rows, "toc long, f array<binary>, b int, e int, m int", column)]


def by_hand(toc, frames, most, pad, own):
    """A packet written byte by byte."""
    size = lambda n: bytes([n]) if n < 252 else bytes([252 + (n & 3), (n - 252 - (n & 3)) >> 2])
    same, n = len({len(f) for f in frames}) == 1, len(frames)
    tail = size(len(frames[-1])) if own else b""
    body = b"".join(frames)
    short = {1: bytes([toc & 252]), 2: bytes([toc & 252 | 1]) if same else bytes([toc & 252 | 2]) + size(len(frames[0]))}.get(n)
    if short is not None and not (pad and len(short + tail + body) < most):
        out = short + tail + body
        return out if len(out) <= most else None
    fields = b"" if same else b"".join(size(len(f)) for f in frames[:-1])
    left = most - 2 - len(fields + tail + body)
    if left < 0:
        return None
    if not (pad and left):
        return bytes([toc & 252 | 3, n | (0 if same else 128)]) + fields + tail + body
    full = (left - 1) // 255
    return bytes([toc & 252 | 3, n | (0 if same else 128) | 64]) + b"\xff" * full + bytes([left - 255 * full - 1]) + fields + tail + body + bytes(left - full - 1)


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("pad", [False, True])
def test_every_framing(spark, pad, own):
    lists = [[b"abc"], [b""], [b"ab", b"cd"], [b"a", b"bcd"], [b"x" * 252, b"y" * 1275], [b"q"] * 6, [b"1", b"22", b"333"], [b"z" * 300, b"", b"z" * 251], [bytes([k]) * k for k in range(10)]]
    rows = [(toc, f, 0, len(f), most) for f in lists for toc in (0x00, 0x80, 0xFF) for most in (1, sum(map(len, f)) + 2, sum(map(len, f)) + 9, sum(map(len, f)) + 300, 3000)]
    got = emitted(spark, rows, pad=pad, self_delimited=own)
    want = [by_hand(t, f, m, pad, own) for t, f, _, _, m in rows]
    assert [d for _, d in got] == want and [e for e, _ in got] == ["too small" if w is None else None for w in want]
    valid = [(w, f) for w, (t, f, *_) in zip(want, rows, strict=True) if w is not None and t == 0x80]  # 2.5 ms, so that all durations do
    for (w, f), (error, found, padding) in zip(valid, frames_of(spark, [w for w, _ in valid], own), strict=True):
        assert (error, found) == (None, f)
        assert (padding > 0) <= pad and (not pad or len(w) == 1 or padding == 0 or w[1] & 64)


def test_ranges(spark):
    [(_, f, _)] = frames_of(spark, [THREE])
    cases = [(0, 1), (0, 2), (1, 3), (0, 3)]
    got = emitted(spark, [(3, f, b, e, 64) for b, e in cases])
    assert [x for _, x, _ in frames_of(spark, [d for _, d in got])] == [f[b:e] for b, e in cases]
    wrong = [(0, 0), (-1, 1), (1, 1), (0, 4), (2, 1), (None, 1)]
    assert emitted(spark, [(3, f, b, e, 64) for b, e in wrong] + [(3, None, 0, 1, 64), (3, [], 0, 0, 64)]) == [("bad range", None)] * 8
    assert emitted(spark, [(0, [b"a", None], 0, 2, 64), (0, [b"a" * 1276], 0, 1, 2000), (0, [b"123"], 0, 1, 2), (0, [b"123"], 0, 1, None)]) == [("bad frames", None), ("bad frames", None), ("too small", None), ("too small", None)]


def merged(spark, lists, **kinds):
    column = pk.merge(F.col("p"), **kinds)
    return [(r["error"], r["toc"], [bytes(x) for x in r["frames"]]) for r in of(spark, [(p and [bytearray(x) if x is not None else None for x in p],) for p in lists], "p array<binary>", column)]


def test_merging(spark):
    sixty = b"\x18\x01"  # one frame of 60 ms
    lists = [[b"\0\1\2", b"\0\3\4"], [THREE, b"\x01\x05\x06", b"\0"], [b"\0\1\2", b"\x08\3\4"], [sixty] * 2, [sixty] * 3, [None], [b"\3"], [], None, [b"\0\1"] * 6, [b"\0\1"] * 12, [b"\0\1"] * 13]
    got = merged(spark, lists)
    assert got[0] == (None, 0, [b"\1\2", b"\3\4"]) and got[1] == (None, 3, [b"\x0a", b"\x14\x15", b"\x1e\x1f\x20", b"\5", b"\6", b""])
    assert [g[0] for g in got] == [None, None, "invalid", None, "invalid", "invalid", "invalid", "empty", "empty", None, None, "invalid"]
    assert len(got[10][2]) == 12 and got[4][2] == []
    # self-delimited there and back
    [(_, f, _)] = frames_of(spark, [THREE])
    [(error, data)] = emitted(spark, [(3, f, 0, 3, 64)], self_delimited=True)
    assert error is None and merged(spark, [[data]], self_delimited=True) == [(None, 3, f)]


def test_padding(spark):
    cases = [(b"\0\1\2\3", 20), (b"\0\1\2\3", 600), (b"\0\1\2\3", 5), (b"\0\1\2\3", 4), (b"\0\1\2\3", 3), (b"", 5), (None, 5), (b"\3", 9), (THREE, 11), (THREE, 266), (THREE, 267), (b"\1\1\1\2\2", 12)]
    got = of(spark, [(None if d is None else bytearray(d), n) for d, n in cases], "d binary, n int", pk.pad(F.col("d"), F.col("n")))
    assert [g["error"] for g in got] == [None, None, None, None, "bad length", "bad length", "bad length", "invalid", None, None, None, None]
    for (d, n), g in zip(cases, got, strict=True):
        if g["error"] is None:
            assert len(g["data"]) == n and frames_of(spark, [bytes(g["data"])])[0][:2] == (None, frames_of(spark, [d])[0][1])
    assert bytes(got[3]["data"]) == cases[3][0] and got[0]["data"][0] == 3
