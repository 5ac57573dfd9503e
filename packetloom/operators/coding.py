"""Entropy coder arithmetic on short symbol arrays, and counts of pulse vectors."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from ..functions import fixed as fx

#: The coder's first range, the range it stays above, and its first count of bits.
FIRST_RANGE, LEAST_RANGE, FIRST_BITS = 1 << 31, 1 << 23, 33


def range_after(symbols: Column, bits: int) -> Column:
    """struct(rng, used): a range coder's range, and the bits it has used, after an array of (low, high) in 1 << bits.

    The range follows from the symbols alone, so no bytes need be made to know it.
    """
    state = "struct<rng:bigint,total:bigint>"

    def step(s, x):
        r = F.shiftright(s["rng"], bits)
        rng = F.when(x["low"] > 0, r * (x["high"] - x["low"])).otherwise(s["rng"] - r * ((1 << bits) - x["high"]))
        shifts = F.when(rng > LEAST_RANGE, 0).when(rng > LEAST_RANGE >> 8, 1).when(rng > LEAST_RANGE >> 16, 2).otherwise(3).cast("long")
        scale = F.element_at(F.array(*[F.lit(1 << 8 * i).cast("long") for i in range(4)]), (shifts + 1).cast("int"))
        return F.struct((rng * scale).alias("rng"), (s["total"] + 8 * shifts).alias("total")).cast(state)

    start = F.struct(F.lit(FIRST_RANGE).cast("long").alias("rng"), F.lit(FIRST_BITS).cast("long").alias("total")).cast(state)
    done = F.aggregate(symbols, start, step)
    return F.element_at(F.transform(F.array(done), lambda s: F.struct(s["rng"].alias("rng"), (s["total"] - fx.bit_length(s["rng"])).alias("used"))), 1)


def pulse_vectors(n: Column, k: Column, most: int = 16) -> Column:
    """How many vectors of n whole numbers have magnitudes that add up to k; null if that is beyond 64 bits or n or k is null.

    A table serves n and k up to `most`; beyond, terms follow from one another in whole numbers, up to min(n, k) of them.
    """
    choose = F.array(*[F.array(*[F.lit(comb(a, b)).cast("long") for b in range(most + 1)]) for a in range(most + 1)])
    c = lambda a, b: F.get(F.get(choose, a.cast("int")), b.cast("int"))
    upto = F.sequence(F.lit(1).cast("long"), F.greatest(F.least(n, k), F.lit(1).cast("long")))
    some = F.aggregate(upto, F.lit(0).cast("long"), lambda s, i: s + F.pow(F.lit(2.0), i).cast("long") * c(n, i) * c(k - 1, i - 1))
    return F.when(k == 0, F.lit(1).cast("long")).when((n <= most) & (k <= most), some).otherwise(F.udf(_pulses, LongType())(n.cast("long"), k.cast("long")))


def _pulses(n, k):
    if n is None or k is None or n < 0 or k < 0:
        return None
    total = term = 0
    for i in range(1, min(n, k) + 1):
        # 2**i * C(n, i) * C(k - 1, i - 1) from the term before
        term = 2 * n if i == 1 else term * 2 * (n - i + 1) * (k - i + 1) // (i * (i - 1))
        total += term
        if total >= 1 << 63:
            return None
    return total


def pulse_error(n: Column, k: Column) -> Column:
    """Why pulse_vectors has no number for n and k, null if it has one."""
    return F.when(n.isNull() | k.isNull() | (n < 0) | (k < 0), "no size").when(pulse_vectors(n, k).isNull(), "beyond 64 bits")
