"""The first byte of a packet (mode, bandwidth, duration, channels, frame count code) and its length fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BANDWIDTHS = ("NB", "MB", "WB", "SWB", "FB")


def config(toc: Column) -> Column:
    return F.shiftright(toc, 3)


def mode(toc: Column) -> Column:
    return F.when(toc.bitwiseAND(128) != 0, "CELT").when(toc.bitwiseAND(96) == 96, "Hybrid").otherwise("SILK")


def bandwidth_rank(toc: Column) -> Column:
    """0 to 4 in the order of BANDWIDTHS."""
    two = F.shiftright(toc, 5).bitwiseAND(3)
    return (
        F.when(toc.bitwiseAND(128) != 0, F.when(two == 0, 0).otherwise(two + 1))
        .when(toc.bitwiseAND(96) == 96, F.when(toc.bitwiseAND(16) != 0, 4).otherwise(3))
        .otherwise(two)
        .cast("int")
    )


def bandwidth(toc: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDWIDTHS)), bandwidth_rank(toc) + 1)


def samples_per_frame(toc: Column, rate: int = 48000) -> Column:
    s = F.shiftright(toc, 3).bitwiseAND(3)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (s + 1).cast("int"))
    return (
        F.when(toc.bitwiseAND(128) != 0, pick([(rate << k) // 400 for k in range(4)]))
        .when(toc.bitwiseAND(96) == 96, F.when(toc.bitwiseAND(8) != 0, rate // 50).otherwise(rate // 100))
        .otherwise(pick([rate // 100, rate // 50, rate // 25, rate * 60 // 1000]))
        .cast("long")
    )


def duration_us(toc: Column) -> Column:
    return F.call_function("div", samples_per_frame(toc) * 125, F.lit(6).cast("long"))


def duration_text(us: Column) -> Column:
    whole = F.call_function("div", us, F.lit(1000).cast("long"))
    return F.concat(whole.cast("string"), F.when(us % 1000 != 0, F.concat(F.lit("."), F.call_function("div", us % 1000, F.lit(100).cast("long")).cast("string"))).otherwise(""), F.lit("ms"))


def channels(toc: Column) -> Column:
    return F.when(toc.bitwiseAND(4) != 0, 2).otherwise(1)


def frame_count(toc: Column, second: Column) -> Column:
    """Frames by the header alone, not validated."""
    code = toc.bitwiseAND(3)
    return F.when(code == 0, F.lit(1)).when(code == 3, second.bitwiseAND(63)).otherwise(F.lit(2)).cast("long")


def packet_samples(toc: Column, second: Column, rate: int = 48000) -> Column:
    """Samples of a packet; null above 120 ms."""
    n = frame_count(toc, second) * samples_per_frame(toc, rate)
    return F.when(n * 25 <= rate * 3, n)


def size_bytes(size: Column) -> Column:
    """A frame length as one or two bytes."""
    low = 252 + size.bitwiseAND(3)
    return F.when(size < 252, F.array(size)).otherwise(F.array(low, F.shiftright(size - low, 2)))


def size_of(data: Column) -> Column:
    """The length that one or two bytes say; null if a byte is missing."""
    first = F.get(data, F.lit(0))
    return F.when(first < 252, first).otherwise(4 * F.get(data, F.lit(1)) + first)


def make_toc(mode_code: Column, rate: Column, bandwidth: Column, n_channels: Column) -> Column:
    """The first byte for mode (0 SILK, 1 Hybrid, 2 CELT), frames a second, bandwidth rank and channels."""
    period = F.when(rate >= 400, 0).when(rate >= 200, 1).when(rate >= 100, 2).when(rate >= 50, 3).when(rate >= 25, 4).otherwise(5).cast("long")
    bandwidth = bandwidth.cast("long")
    body = (
        F.when(mode_code == 0, F.shiftleft(bandwidth, 5).bitwiseOR(F.shiftleft(period - 2, 3)))
        .when(mode_code == 2, F.lit(128).cast("long").bitwiseOR(F.shiftleft(F.greatest(bandwidth - 1, F.lit(0).cast("long")), 5)).bitwiseOR(F.shiftleft(period, 3)))
        .otherwise(F.lit(96).cast("long").bitwiseOR(F.shiftleft(bandwidth - 3, 4)).bitwiseOR(F.shiftleft(period - 2, 3)))
    )
    return body.bitwiseOR(F.when(n_channels == 2, F.lit(4)).otherwise(F.lit(0)).cast("long")).bitwiseAND(F.lit(255).cast("long"))
