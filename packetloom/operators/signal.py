"""Vector kernels on arrays of whole numbers, and per-frame measures of samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..functions import fixed as fx


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def inner(x: Column, y: Column) -> Column:
    """The inner product of two arrays."""
    return total(F.zip_with(x, y, lambda a, b: a * b))


def autocorrelation(x: Column, lag: int) -> Column:
    return inner(F.slice(x, 1, F.greatest(F.size(x) - lag, F.lit(0))), F.slice(x, 1 + lag, F.greatest(F.size(x) - lag, F.lit(0))))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0).cast("long"))


def l1(x: Column) -> Column:
    return total(F.transform(x, lambda v: F.abs(v)))


def haar(x: Column) -> Column:
    """Sums, then differences of neighbours, each scaled by 0.7071 in Q15 with rounding."""
    half = F.sequence(F.lit(0), F.call_function("div", F.size(x), F.lit(2)).cast("int") - 1)
    scaled = lambda v: fx.round_shift(v * 23170, 15)
    a, b = lambda i: scaled(F.get(x, 2 * i)), lambda i: scaled(F.get(x, 2 * i + 1))
    return F.concat(F.transform(half, lambda i: a(i) + b(i)), F.transform(half, lambda i: a(i) - b(i)))


def _carried(x: Column, step: int, pick) -> Column:
    """For each place what `pick` leaves of its value and the place before's, moved by step: one pass over the array."""
    state = "struct<last:bigint,out:array<bigint>>"
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out")).cast(state)

    def put(done, v):
        now = F.coalesce(pick(done["last"] + step, v), v)
        return F.struct(now.alias("last"), F.concat(done["out"], F.array(now)).alias("out")).cast(state)

    return F.aggregate(x, start, put, lambda s: s["out"])


def masking(x: Column, up: int, down: int) -> Column:
    """max over i of x[i] less `up` a step upward and `down` a step downward, for every place: what each is masked by."""
    most = lambda a, v: F.when(a.isNotNull(), F.greatest(a, v))
    above = F.reverse(_carried(F.reverse(x), -down, most))
    return F.zip_with(_carried(x, -up, most), above, lambda a, b: F.greatest(a, b))


def energy(x: Column) -> Column:
    """The mean of squares, rounded down; sums stay far below 63 bits for 16-bit samples."""
    return F.call_function("div", inner(x, x), F.greatest(F.size(x).cast("long"), F.lit(1).cast("long")))


def resampler(rate_in: Column, rate_out: Column) -> Column:
    """The kind of conversion between two rates."""
    return (
        F.when(rate_in == rate_out, "copy").when(rate_out == 2 * rate_in, "up2").when(rate_out > rate_in, "up_fir")
        .when(4 * rate_out == 3 * rate_in, "down_3_4").when(3 * rate_out == 2 * rate_in, "down_2_3").when(2 * rate_out == rate_in, "down_1_2")
        .when(3 * rate_out == rate_in, "down_1_3").when(4 * rate_out == rate_in, "down_1_4").when(6 * rate_out == rate_in, "down_1_6").otherwise("unsupported")
    )


def resampler_step(rate_in: Column, rate_out: Column) -> Column:
    """Input samples for each output sample in Q16, rounded up."""
    base = F.shiftleft(F.call_function("div", F.shiftleft(rate_in, 14), rate_out), 2)
    short = F.call_function("div", rate_in * 65536 + rate_out - 1, rate_out)
    return F.greatest(base, short)


def crossfade(x: Column, y: Column) -> Column:
    """From x to y by a squared ramp in Q15, one weight for each place."""
    n = F.size(x)
    ramp = lambda i: F.call_function("div", (i.cast("long") + 1) * 32767, n.cast("long"))
    weight = lambda i: F.shiftright(ramp(i) * ramp(i), 15)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftright(weight(i) * F.get(y, i) + (32767 - weight(i)) * F.get(x, i), 15))


def tilt(x: Column) -> Column:
    """How much more lies at high places than at low ones: the sum of x[i] * (2 + 2 i - n)."""
    return total(F.transform(x, lambda v, i: v * (2 + 2 * i - F.size(x)).cast("long")))


def rise_limited(x: Column, step: int) -> Column:
    """x with no place more than step above the one before."""
    return _carried(x, step, lambda a, v: F.when(a.isNotNull(), F.least(a, v)))


def powers(x: Column, n: int) -> Column:
    """The power of each of the n // 2 + 1 bins of n whole numbers: a discrete Fourier transform with a table in Q14."""
    table = lambda f, k: F.array(*[F.lit(round(f(2 * math.pi * k * i / n) * 16384)).cast("long") for i in range(n)])
    part = lambda f, k: F.shiftright(inner(x, table(f, k)), 14)
    return F.array(*[part(math.cos, k) * part(math.cos, k) + part(math.sin, k) * part(math.sin, k) for k in range(n // 2 + 1)])


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def median5(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """The third of five: neither the least nor the greatest of two pairs is it, so the median of what is left."""
    low, high = F.greatest(F.least(a, b), F.least(d, e)), F.least(F.greatest(a, b), F.greatest(d, e))
    return median3(low, high, c)


def sliding_median(x: Column) -> Column:
    """The median of each place and two on either side; of the three outermost for the two places at either end.

    Three and four places have the median of the outermost three everywhere; fewer are left as they are.
    """
    n, at = F.size(x), lambda i: F.get(x, i)
    ends = lambda i: F.when(i < 2, median3(at(F.lit(0)), at(F.lit(1)), at(F.lit(2)))).otherwise(median3(at(n - 3), at(n - 2), at(n - 1)))
    inner_ = lambda i: median5(*(at(i + k) for k in range(-2, 3)))
    return F.when(n < 3, x).otherwise(F.transform(x, lambda _, i: F.when((i < 2) | (i >= n - 2), ends(i)).otherwise(inner_(i))))
