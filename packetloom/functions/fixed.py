"""Fixed-point primitives as expressions on BIGINT columns. Wrapping and saturation are explicit, so ANSI mode never raises."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def wrap(x: Column, bits: int = 32) -> Column:
    """The low bits of x as a signed number."""
    return F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits)


def sat(x: Column, low: int, high: int) -> Column:
    return F.greatest(_c(low), F.least(_c(high), x))


def sat16(x: Column) -> Column:
    return sat(x, -32768, 32767)


def sat32(x: Column) -> Column:
    return sat(x, -(1 << 31), (1 << 31) - 1)


def round_shift(x: Column, s: int) -> Column:
    return F.shiftright(x + (1 << (s - 1)), s) if s > 0 else x


def signed_shift(x: Column, s: int) -> Column:
    """Right by s, or left by -s with wrapping."""
    return F.shiftright(x, s) if s >= 0 else wrap(F.shiftleft(x, -s))


def mul_shift(a: Column, b: Column, s: int, rounded: bool = False) -> Column:
    return round_shift(a * b, s) if rounded else F.shiftright(a * b, s)


def idiv(a: Column, b: Column | int) -> Column:
    """Division truncating toward zero; null where b is zero."""
    return F.call_function("div", a.cast("long"), F.nullif(_c(b), _c(0)))


def bit_length(x: Column) -> Column:
    """Bits of a non-negative number, 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x))).cast("long")


def ilog2(x: Column) -> Column:
    return bit_length(x) - 1


def isqrt(x: Column) -> Column:
    """Floor square root, put right after the double's."""
    r = F.floor(F.sqrt(x.cast("double"))).cast("long")
    return F.when(r * r > x, r - 1).when((r + 1) * (r + 1) <= x, r + 1).otherwise(r)


def leading_zeros32(x: Column) -> Column:
    return 32 - bit_length(x.bitwiseAND(F.lit(0xFFFFFFFF)))


def rotate_right32(x: Column, s: int) -> Column:
    u = x.bitwiseAND(F.lit(0xFFFFFFFF))
    s %= 32
    return wrap(F.shiftright(u, s).bitwiseOR(F.shiftleft(u, 32 - s)).bitwiseAND(F.lit(0xFFFFFFFF)))


def random_step(seed: Column) -> Column:
    """One step of the linear congruential generator 196314165 * x + 907633515 modulo 2**32."""
    return wrap(wrap(seed) * 196314165 + 907633515)


def limit(x: Column, a: Column, b: Column) -> Column:
    """x between two bounds given in either order."""
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), x))


def _curve(frac: Column, factor: int) -> Column:
    """A parabola over 7 fractional bits that bends a straight line toward the logarithm or its inverse."""
    return frac + F.shiftright(frac * (128 - frac) * factor, 16)


def log128(x: Column) -> Column:
    """About 128 times the base-2 logarithm of a positive number."""
    lz = leading_zeros32(x)
    left = F.greatest(lz - 24, F.lit(0).cast("long"))
    frac = F.when(lz >= 24, x * F.pow(F.lit(2.0), left).cast("long")).otherwise(F.call_function("div", x, F.pow(F.lit(2.0), F.greatest(24 - lz, F.lit(0).cast("long"))).cast("long"))).bitwiseAND(F.lit(127).cast("long"))
    return _curve(frac, 179) + (31 - lz) * 128


def exp128(x: Column) -> Column:
    """About 2 to the power of x / 128; 0 below 0, the largest 32-bit number from 3967 on."""
    whole = F.pow(F.lit(2.0), F.least(F.greatest(F.shiftright(x, 7), F.lit(0).cast("long")), F.lit(31).cast("long"))).cast("long")
    bend = _curve(x.bitwiseAND(F.lit(127).cast("long")), -174)
    out = F.when(x < 2048, whole + F.shiftright(whole * bend, 7)).otherwise(whole + F.shiftright(whole, 7) * bend)
    return F.when(x < 0, F.lit(0).cast("long")).when(x >= 3967, F.lit(2**31 - 1).cast("long")).otherwise(out)


# Coefficients, in the number's own scale, of the polynomials below, lowest power first.
RSQRT = (23557, -13490, 6713)
SQRT = (23171, 11574, -2901, 1592, -1002, 336)
COS = (-7651, 8277, -626)
RCP = (30840, -15420)
EXP2 = (16383, 22804, 14819, 10204)
LOG2 = (-6801 + 8, 15746, -5217, 2545, -1401)
SQRT_STEPS = (32768, 46214, 213)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shift(x: Column, s: Column | int) -> Column:
    """Right by s, or left by -s, to 32 bits."""
    s = _c(s)
    right = F.call_function("shiftright", x, F.greatest(F.least(s, _c(62)), _c(0)).cast("int"))
    left = F.call_function("shiftleft", x, F.greatest(F.least(-s, _c(62)), _c(0)).cast("int"))
    return F.when(s >= 0, right).otherwise(wrap(left))


def _q15(a: Column | int, b: Column | int) -> Column:
    return F.shiftright(_c(a) * _c(b), 15)


def polynomial(n: Column, coefficients: tuple[int, ...], bits: int = 16) -> Column:
    """A polynomial of a Q15 number by Horner's rule: every product drops 15 bits, every sum is wrapped to 16 bits, the last to `bits`."""
    out = _c(coefficients[-1])
    for i, c in enumerate(reversed(coefficients[:-1]), 2):
        out = wrap(c + _q15(n, out), bits if i == len(coefficients) else 16)
    return out


def rsqrt(x: Column) -> Column:
    """About 1 / sqrt(x), Q16 from 0.25 to 1 in, Q14 out: a parabola and one step of second order."""

    def refined(v):
        r, n = v["r"], v["n"]
        square = _q15(r, r)
        y = wrap(2 * wrap(_q15(square, n) + square - 16384, 16), 16)
        return let(y, lambda y: wrap(r + _q15(r, wrap(_q15(y, wrap(_q15(y, 12288) - 16384, 16)), 16)), 16))

    n = wrap(_c(x) - 32768, 16)
    return let(F.struct(n.alias("n"), polynomial(n, RSQRT).alias("r")), refined)


def sqrt(x: Column) -> Column:
    """About the square root of a non-negative number in any even scale, in half of it; 32767 from 2^30 on."""
    x = _c(x)
    k = F.shiftright(ilog2(F.greatest(x, _c(1))), 1) - 7
    root = shift(polynomial(wrap(shift(x, 2 * k) - 32768, 16), SQRT, 32), 7 - k)
    return F.when(x == 0, _c(0)).when(x >= 1 << 30, _c(32767)).otherwise(root)


def cosine(x: Column) -> Column:
    """About the cosine of x half turns, Q16 in, Q15 out."""

    def quarter(a):
        def curve(s):
            inner = _c(COS[2])
            for c in (COS[1], COS[0]):
                inner = wrap(c + round_shift(inner * s, 15), 16)
            return 1 + F.least(_c(32766), 32767 - s + round_shift(s * inner, 15))

        return let(wrap(round_shift(a * a, 15), 16), curve)

    x = _c(x).bitwiseAND(_c(0x1FFFF))
    x = F.when(x > 1 << 16, (1 << 17) - x).otherwise(x)

    def whole(x):
        edge = F.when(x.bitwiseAND(_c(0xFFFF)) != 0, _c(0)).when(x != 0, _c(-32767)).otherwise(_c(32767))
        turned = F.when(x < 1 << 15, quarter(x)).otherwise(-quarter(65536 - x))
        return F.when(x.bitwiseAND(_c(0x7FFF)) != 0, turned).otherwise(edge)

    return let(x, whole)


def reciprocal(x: Column) -> Column:
    """About 1 / x for a positive number, Q15 in, Q16 out: a line and two Newton steps."""

    def steps(v):
        n = v["n"]
        left = lambda r: wrap(_q15(r, n) + wrap(r - 32768, 16), 16)
        once = wrap(v["r"] - _q15(v["r"], left(v["r"])), 16)
        return let(once, lambda r: wrap(r - (1 + _q15(r, left(r))), 16))

    x = _c(x)
    i = ilog2(F.greatest(x, _c(1)))
    n = wrap(shift(x, i - 15) - 32768, 16)
    return F.when(x > 0, shift(let(F.struct(n.alias("n"), polynomial(n, RCP).alias("r")), steps), i - 16))


def exp2(x: Column) -> Column:
    """About 2^x, Q10 in, Q16 out; 0 below -15, the largest part of 32 bits from 15 on."""
    x = _c(x)
    whole = F.shiftright(x, 10)
    part = polynomial(wrap(16 * (x - 1024 * whole), 16), EXP2)
    return F.when(whole > 14, _c(0x7F000000)).when(whole < -15, _c(0)).otherwise(shift(part, -whole - 2))


def log2(x: Column) -> Column:
    """About log2(x) of a positive number, Q14 in, Q10 out; -32767 for 0."""
    x = _c(x)
    i = ilog2(F.greatest(x, _c(1)))
    part = polynomial(wrap(shift(x, i - 15) - 32768 - 16384, 16), LOG2)
    return F.when(x == 0, _c(-32767)).otherwise(wrap(1024 * (i - 13) + F.shiftright(part, 4), 16))


def quotient(a: Column, b: Column) -> Column:
    """About a / b in Q31 for positive b, saturated: a 16-bit reciprocal and one step on the remainder."""
    by = lambda r, v: wrap(F.shiftright(r * v, 15))
    at = ilog2(F.greatest(_c(b), _c(1))) - 29

    def divided(v):
        near = reciprocal(wrap(round_shift(v["b"], 16), 16))
        return let(wrap(round_shift(near, 3), 16), lambda r: let(by(r, v["a"]), lambda q: wrap(q + wrap(4 * by(r, wrap(round_shift(v["a"], 2) - F.shiftright(q * v["b"], 31)))))))

    q = let(F.struct(shift(_c(a), at).alias("a"), shift(_c(b), at).alias("b")), divided)
    most = (1 << 31) - 1
    return F.when(_c(b) > 0, let(q, lambda q: F.when(q >= 1 << 29, _c(most)).when(q <= -(1 << 29), _c(-most)).otherwise(4 * q)))


def rough_sqrt(x: Column) -> Column:
    """The square root within a tenth: by leading zeros and a line over the seven bits after the first."""
    x = _c(x)
    positive = F.greatest(x, _c(1))
    lz = leading_zeros32(positive)
    frac = shift(positive, 24 - lz).bitwiseAND(_c(127))
    even, odd = SQRT_STEPS[1], SQRT_STEPS[0]
    y = F.call_function("shiftright", F.when(lz % 2 == 1, _c(odd)).otherwise(_c(even)), F.shiftright(lz, 1).cast("int"))
    return F.when(x <= 0, _c(0)).otherwise(let(y, lambda y: y + F.shiftright(y * SQRT_STEPS[2] * frac, 16)))


def _headroom(x: Column) -> Column:
    return leading_zeros32(F.abs(_c(x))) - 1


def _scaled(x: Column, s: Column) -> Column:
    """Right by s (0 from 32 on), or left by -s, saturated."""
    left = F.least(F.greatest(-s, _c(0)), _c(31)).cast("int")
    up = F.call_function("shiftleft", F.greatest(F.call_function("shiftright", _c(-(1 << 31)), left), F.least(F.call_function("shiftright", _c((1 << 31) - 1), left), x)), left)
    return F.when(s < 0, up).when(s < 32, shift(x, s)).otherwise(_c(0))


def quotient_q(a: Column, b: Column, q: Column | int) -> Column:
    """About (a << q) / b of 32-bit numbers, saturated; null where b is 0."""
    room = F.struct(_headroom(a).alias("a"), _headroom(b).alias("b"))
    start = let(room, lambda h: F.struct((29 + h["a"] - h["b"]).alias("at"), shift(_c(a), -h["a"]).alias("a"), shift(_c(b), -h["b"]).alias("b")))

    def divided(v):
        inverse = wrap(idiv(_c(((1 << 31) - 1) >> 2), F.shiftright(v["b"], 16)), 16)

        def refined(r):
            first = F.shiftright(v["a"] * r, 16)
            left = lambda f: wrap(v["a"] - wrap(8 * F.shiftright(v["b"] * f, 32)))
            return let(first, lambda f: wrap(f + F.shiftright(left(f) * r, 16)))

        return _scaled(let(inverse, refined), v["at"] - _c(q))

    return F.when(_c(b) != 0, let(start, divided))


def inverse_q(b: Column, q: Column | int) -> Column:
    """About (1 << q) / b of a 32-bit number, saturated; null where b is 0."""
    start = let(_headroom(b), lambda h: F.struct((61 - h).alias("at"), shift(_c(b), -h).alias("b")))

    def inverted(v):
        def refined(r):
            error = wrap(8 * ((1 << 29) - F.shiftright(v["b"] * r, 16)))
            return wrap(wrap(r * 65536) + F.shiftright(error * r, 16))

        return _scaled(let(wrap(idiv(_c(((1 << 31) - 1) >> 2), F.shiftright(v["b"], 16)), 16), refined), v["at"] - _c(q))

    return F.when(_c(b) != 0, let(start, inverted))


# Coefficients of the angles below; those of the arc tangent stand in rising scales from Q31 on.
ANGLE_COS, ANGLE_LOG = (-7651, 8277, -626), (7932, -2597)
ATAN = (-715791936, 857391616, -1200579328, 1682636672, -1985085440, 1583306112, -598602432)
ATAN_TURN, ACOS = 1367130551, (25726, -3308, 762)


def _r15(a: Column | int, b: Column | int) -> Column:
    return round_shift(_c(a) * _c(b), 15)


def _q31(a: Column | int, b: Column | int) -> Column:
    return F.shiftright(_c(a) * _c(b), 31)


def angle_cosine(x: Column) -> Column:
    """The cosine in Q15 of an angle from 64 to 16320 (16384 is a right one), alike to the last bit everywhere; null for others."""

    def curve(s):
        inner = _c(ANGLE_COS[2])
        for c in (ANGLE_COS[1], ANGLE_COS[0]):
            inner = c + _r15(inner, s)
        return 1 + wrap(32767 - s + _r15(s, inner), 16)

    return F.when(_c(x).between(64, 16320), let(wrap(F.shiftright(4096 + _c(x) * _c(x), 13), 16), curve))


def log2_tangent(sine: Column, cosine: Column) -> Column:
    """About log2(sine / cosine) in Q11, of two positive Q15 numbers."""

    def part(v):
        n = bit_length(v)
        top = F.call_function("shiftleft", v, F.greatest(15 - n, _c(0)).cast("int"))
        return n * 2048 + let(top, lambda t: _r15(t, ANGLE_LOG[0] + _r15(t, ANGLE_LOG[1])))

    return part(_c(sine)) - part(_c(cosine))


def arc_tangent(x: Column) -> Column:
    """About atan(x) * 2 / pi in Q30, of a Q30 number from -1 to 1."""

    def curve(square):
        inner = _c(0)
        for c in reversed(ATAN):
            inner = _q31(square, wrap(c + inner))
        return _q31(ATAN_TURN, wrap(_c(x) + _q31(wrap(2 * _c(x)), inner)))

    edge = 1 << 30
    return F.when(_c(x) == edge, _c(edge >> 1)).when(_c(x) == -edge, _c(-(edge >> 1))).otherwise(let(_q31(wrap(2 * _c(x)), x), curve))


def angle_of(y: Column, x: Column) -> Column:
    """About the angle of (x, y) in the first quarter, as a part of a right one in Q30; 0 for (0, 0)."""
    small, large = F.least(_c(x), _c(y)), F.greatest(_c(x), _c(y))
    part = arc_tangent(F.shiftright(quotient(small, large), 1))
    return F.when((_c(x) == 0) & (_c(y) == 0), _c(0)).when(_c(y) < _c(x), part).otherwise((1 << 30) - part)


def arc_cosine(x: Column) -> Column:
    """About acos(x) in Q13, of a Q29 number from -1 to 1."""
    size = F.abs(_c(x))

    def curve(t):
        inner = F.shiftright(ACOS[2] * t, 14) + ACOS[1]
        inner = F.shiftright(inner * t, 14) + ACOS[0]
        return F.shiftright(inner * sqrt(F.greatest((1 << 30) - 2 * size, _c(0))), 16)

    found = let(wrap(F.shiftright(size, 15), 16), curve)
    return F.when(_c(x) < 0, 25736 - found).otherwise(found)


def weights(a: Column, b: Column) -> Column:
    """array of two weights of at most 15 bits, as two energies are to each other, both raised by a third of the smaller."""
    more = F.call_function("div", F.least(_c(a), _c(b)), _c(3))
    at = ilog2(1 + F.greatest(_c(a), _c(b)) + more) - 14
    return F.array(*(wrap(shift(_c(v) + more, at), 16) for v in (a, b)))
