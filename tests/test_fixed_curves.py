"""Fixed-point roots, reciprocals, powers and quotients against plain integer versions and against what they stand for."""

import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions import fixed as fx


def w(x, bits=32):
    return (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def vs(x, s):
    return x >> s if s >= 0 else w(x << -s)


def q15(a, b):
    return a * b >> 15


def rounded(x, s):
    return x + (1 << s - 1) >> s


def horner(n, c, bits=16):
    t = c[-1]
    for i in range(len(c) - 2, -1, -1):
        t = w(c[i] + q15(n, t), 16 if i else bits)
    return t


def rsqrt(x):
    n = w(x - 32768, 16)
    r = horner(n, fx.RSQRT)
    r2 = q15(r, r)
    y = w(2 * w(q15(r2, n) + r2 - 16384, 16), 16)
    return w(r + q15(r, w(q15(y, w(q15(y, 12288) - 16384, 16)), 16)), 16)


def sqrt(x):
    if x == 0 or x >= 1 << 30:
        return 32767 if x else 0
    k = (x.bit_length() - 1 >> 1) - 7
    return vs(horner(w(vs(x, 2 * k) - 32768, 16), fx.SQRT, 32), 7 - k)


def cosine(x):
    def part(a):
        s = w(rounded(a * a, 15), 16)
        t = w(fx.COS[1] + rounded(fx.COS[2] * s, 15), 16)
        t = w(fx.COS[0] + rounded(s * t, 15), 16)
        return 1 + min(32766, 32767 - s + rounded(s * t, 15))

    x &= 0x1FFFF
    x = (1 << 17) - x if x > 1 << 16 else x
    if x & 0x7FFF:
        return part(x) if x < 1 << 15 else -part(65536 - x)
    return 0 if x & 0xFFFF else -32767 if x else 32767


def reciprocal(x):
    i = x.bit_length() - 1
    n = w(vs(x, i - 15) - 32768, 16)
    r = horner(n, fx.RCP)
    r = w(r - q15(r, w(q15(r, n) + w(r - 32768, 16), 16)), 16)
    r = w(r - (1 + q15(r, w(q15(r, n) + w(r - 32768, 16), 16))), 16)
    return vs(r, i - 16)


def exp2(x):
    k = x >> 10
    return 0x7F000000 if k > 14 else 0 if k < -15 else vs(horner(w(x - 1024 * k << 4, 16), fx.EXP2), -k - 2)


def log2(x):
    if x == 0:
        return -32767
    i = x.bit_length() - 1
    return w(1024 * (i - 13) + (horner(w(vs(x, i - 15) - 49152, 16), fx.LOG2) >> 4), 16)


def quotient(a, b):
    s = b.bit_length() - 30
    a, b = vs(a, s), vs(b, s)
    r = w(rounded(reciprocal(w(rounded(b, 16), 16)), 3), 16)
    q = w(r * a >> 15)
    q = w(q + w(4 * w(r * w(rounded(a, 2) - (q * b >> 31)) >> 15)))
    return (1 << 31) - 1 if q >= 1 << 29 else 1 - (1 << 31) if q <= -(1 << 29) else 4 * q


def rough_sqrt(x):
    if x <= 0:
        return 0
    lz = 32 - x.bit_length()
    frac = vs(x, 24 - lz) & 127
    y = (32768 if lz % 2 else 46214) >> (lz >> 1)
    return y + (y * 213 * frac >> 16)


def saturated(x, s):
    if s >= 0:
        return x >> s if s < 32 else 0
    return max(-(1 << 31) >> -s, min((1 << 31) - 1 >> -s, x)) << -s


def room(x):
    return 31 - abs(x).bit_length()


def towards_zero(a, b):
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def quotient_q(a, b, q):
    x, y = w(a << room(a)), w(b << room(b))
    r = w(towards_zero((1 << 29) - 1, y >> 16), 16)
    first = x * r >> 16
    left = w(x - w(8 * (y * first >> 32)))
    return saturated(w(first + (left * r >> 16)), 29 + room(a) - room(b) - q)


def inverse_q(b, q):
    y = w(b << room(b))
    r = w(towards_zero((1 << 29) - 1, y >> 16), 16)
    error = w(8 * ((1 << 29) - (y * r >> 16)))
    return saturated(w(w(r << 16) + (error * r >> 16)), 61 - room(b) - q)


R = random.Random(5)
WORDS = [0, 1, 2, 3, 127, 128, 255, 256, 16383, 16384, 32767, 32768, 65535, 65536, (1 << 30) - 1, 1 << 30, (1 << 31) - 1] + [R.randrange(1 << R.randrange(1, 32)) for _ in range(400)]


@pytest.mark.parametrize(
    ("name", "plain", "inputs"),
    [
        ("rsqrt", rsqrt, [16384, 32768, 65535, *(R.randrange(16384, 65536) for _ in range(400))]), ("sqrt", sqrt, WORDS), ("cosine", cosine, [*range(-3, 3), *range(32766, 32770), *range(65534, 65539), *range(131070, 131075), *(R.randrange(-(1 << 20), 1 << 20) for _ in range(400))]),
        ("reciprocal", reciprocal, [x for x in WORDS if x]), ("exp2", exp2, [*range(-20, 20), -32768, 32767, -16385, -16384, 15359, 15360, *(R.randrange(-32768, 32768) for _ in range(400))]), ("log2", log2, WORDS), ("rough_sqrt", rough_sqrt, [-5, *WORDS]),
    ],
)
def test_curves(spark, name, plain, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x long")
    assert [r.y for r in df.select("i", getattr(fx, name)(F.col("x")).alias("y")).orderBy("i").collect()] == [plain(x) for x in inputs]


def test_quotients(spark):
    some = [x for x in WORDS if 0 < x < 1 << 31][::4]
    pairs = [(s * a, t * b, q) for a, b, s, t, q in zip(some, reversed(some), [1, -1] * 99, [1, 1, -1, -1] * 50, [0, 8, 16, 24, 29] * 40, strict=False)] + [(0, 5, 9), (5, 1, 30), (-5, 1, 30)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long, q long")
    a, b, q = F.col("a"), F.col("b"), F.col("q")
    rows = df.select("i", fx.quotient_q(a, b, q).alias("d"), fx.inverse_q(b, q + 1).alias("v"), fx.quotient(a, F.abs(b)).alias("f")).orderBy("i").collect()
    assert [r.d for r in rows] == [quotient_q(*p) for p in pairs]
    assert [r.v for r in rows] == [inverse_q(y, k + 1) for _, y, k in pairs]
    assert [r.f for r in rows] == [quotient(x, abs(y)) for x, y, _ in pairs]
    zero = df.limit(1).select(fx.quotient_q(a, F.lit(0), 3).alias("d"), fx.inverse_q(F.lit(0), 3).alias("v"), fx.quotient(a, F.lit(0)).alias("f"), fx.reciprocal(F.lit(0)).alias("r")).head()
    assert tuple(zero) == (None,) * 4


def test_they_are_near_what_they_stand_for():
    assert all(abs(sqrt(x) - math.sqrt(x)) <= 0.001 * math.sqrt(x) + 1 for x in WORDS if x < 1 << 30)
    assert all(abs(rsqrt(x) / 16384 - 1 / math.sqrt(x / 65536)) < 1e-3 for x in range(16384, 65536, 97))
    assert all(abs(cosine(x) / 32768 - math.cos(math.pi * x / 65536)) < 2e-3 for x in range(0, 1 << 18, 997))
    assert all(abs(log2(x) / 1024 - math.log2(x / 16384)) < 0.01 for x in WORDS if x)
    assert all(abs(exp2(x) / 65536 - 2 ** (x / 1024)) < 0.002 * 2 ** (x / 1024) + 1e-4 for x in range(-8000, 15000, 37))
    assert all(abs(rough_sqrt(x) - math.sqrt(x)) < 0.1 * math.sqrt(x) for x in WORDS if x > 300)
    assert all(abs(quotient_q(a, b, 16) - (a << 16) / b) < abs(a / b) * 65536 * 1e-4 + 2 for a, b in ((7, 3), (-1000, 77), (123456, -9), (5, 100000)))


def log_tan(s, c):
    part = lambda v: (v.bit_length() * 2048) + rounded((v << 15 - v.bit_length()) * (7932 + rounded((v << 15 - v.bit_length()) * -2597, 15)), 15)
    return part(s) - part(c)


def angle_cos(x):
    s = w(4096 + x * x >> 13, 16)
    t = -7651 + rounded(s * (8277 + rounded(-626 * s, 15)), 15)
    return 1 + w(32767 - s + rounded(s * t, 15), 16)


def atan(x):
    if abs(x) == 1 << 30:
        return x // 2
    square, t = w(2 * x) * x >> 31, 0
    for c in reversed(fx.ATAN):
        t = square * w(c + t) >> 31
    return 1367130551 * w(x + (w(2 * x) * t >> 31)) >> 31


def atan2(y, x):
    if x == y == 0:
        return 0
    return atan(quotient(y, x) >> 1) if y < x else (1 << 30) - atan(quotient(x, y) >> 1)


def acos(x):
    a = abs(x)
    t = w(a >> 15, 16)
    out = ((((762 * t >> 14) - 3308) * t >> 14) + 25726) * sqrt(max(0, (1 << 30) - 2 * a)) >> 16
    return 25736 - out if x < 0 else out


def test_angles(spark):
    angles = [*range(64, 16321, 53), 65, 16319, 16320]
    unit = [0, 1, -1, 1 << 30, -(1 << 30), (1 << 30) - 1, *(R.randrange(-(1 << 30), 1 << 30) for _ in range(300))]
    pairs = [(0, 0), (0, 5), (5, 0), (7, 7), *((R.randrange(1 << 30), R.randrange(1, 1 << R.randrange(1, 31))) for _ in range(300))]
    df = spark.createDataFrame([(i, a, u // 2, u, *p) for i, (a, u, p) in enumerate(zip(angles, unit, pairs, strict=False))], "i int, a long, h long, u long, y long, x long")
    found = df.select(
        "a", "u", "h", "x", "y", fx.angle_cosine(F.col("a")).alias("c"), fx.log2_tangent(fx.angle_cosine(16384 - F.col("a")), fx.angle_cosine(F.col("a"))).alias("l"), fx.arc_tangent(F.col("u")).alias("t"), fx.angle_of(F.col("y"), F.col("x")).alias("p"),
        fx.arc_cosine(F.col("h")).alias("k"), fx.weights(F.col("x"), F.col("y")).alias("w"),
    ).collect()
    assert len(found) > 200
    assert [r.c for r in spark.range(3).select(fx.angle_cosine(F.when(F.col('id') == 0, 63).when(F.col('id') == 1, 16321)).alias('c')).collect()] == [None] * 3
    for r in found:
        assert (r.c, r.l, r.t, r.p, r.k) == (angle_cos(r.a), log_tan(angle_cos(16384 - r.a), angle_cos(r.a)), atan(r.u), atan2(r.y, r.x), acos(r.h))
        more = min(r.x, r.y) // 3
        at = (1 + max(r.x, r.y) + more).bit_length() - 15
        assert r.w == [w(vs(r.x + more, at), 16), w(vs(r.y + more, at), 16)]
        assert abs(r.t / (1 << 30) - math.atan(r.u / (1 << 30)) * 2 / math.pi) < 1e-4
        assert r.x + r.y == 0 or abs(r.p / (1 << 30) - math.atan2(r.y, r.x) * 2 / math.pi) < 1e-3
        assert abs(r.k / 8192 - math.acos(r.h / (1 << 29))) < 0.01 and abs(r.c / 32768 - math.cos(math.pi / 2 * r.a / 16384)) < 1e-3
