"""Rate, frame size and channel decisions. Divisions truncate toward zero, in the order that the results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import idiv
from . import ordered

AUTO, MAX = -1000, -1


def bits_to_rate(bits: Column, frame: Column, rate: int = 48000) -> Column:
    return idiv(bits * idiv(F.lit(6 * rate), frame), 6)


def rate_to_bits(bitrate: Column, frame: Column, rate: int = 48000) -> Column:
    return idiv(bitrate * 6, idiv(F.lit(6 * rate), frame))


def effective_rate(asked: Column, frame: Column, channels: Column, most_bytes: int, rate: int = 48000) -> Column:
    """AUTO and MAX stand for rates of their own; none exceeds what the buffer holds."""
    wish = F.when(asked == AUTO, idiv(F.lit(60 * rate), frame) + rate * channels).when(asked == MAX, 1_500_000).otherwise(asked)
    return F.least(wish, bits_to_rate(F.lit(8 * most_bytes).cast("long"), frame, rate))


def constant_bytes(bitrate: Column, frame: Column, most_bytes: int = 1276) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(idiv(rate_to_bits(bitrate, frame) + 4, 8), F.lit(most_bytes).cast("long")))


def equivalent_rate(bitrate: Column, channels: Column, frame: Column, vbr: Column, mode: Column, complexity: Column, loss: Column) -> Column:
    """mode: 0 SILK, 1 Hybrid, 2 CELT."""
    fps = idiv(F.lit(48000), frame)
    e = F.when(fps > 50, bitrate - (40 * channels + 20) * (fps - 50)).otherwise(bitrate)
    e = F.when(vbr == 0, e - idiv(e, 12)).otherwise(e)
    e = idiv(e * (90 + complexity), 100)
    low = F.when(complexity < 2, idiv(e * 4, 5)).otherwise(e)
    return F.when(mode == 2, F.when(complexity < 5, idiv(e * 9, 10)).otherwise(e)).otherwise(low - idiv(low * loss, 6 * loss + 10))


def frame_size(at_hand: Column, choice: Column, rate: int = 48000) -> Column:
    """choice 0: what is at hand; 1 to 5: 2.5 to 40 ms; 6 to 9: 60 to 120 ms. -1 if that is illegal or more than at hand."""
    legal = [rate * k // 400 for k in (1, 2, 4, 8, 16, 24, 32, 40, 48)]
    size = F.when(choice == 0, at_hand).when(choice <= 5, F.element_at(F.array(*[F.lit(rate // 400 << k) for k in range(5)]), F.greatest(choice, F.lit(1)).cast("int"))).otherwise((choice - 3) * (rate // 50))
    return F.when((at_hand < rate // 400) | (size > at_hand) | ~size.isin(legal), F.lit(-1)).otherwise(size).cast("long")


def hysteresis(rows: DataFrame, key: str, order: list[str], sure: Column, first: int, name: str) -> DataFrame:
    """rows with a decision that is `sure` where that is not null, else the key's last one, else `first`."""
    cut = rows.withColumn("_sure", sure).withColumn("_chunk", ordered._chunk(order[0], ordered.CHUNK_SECONDS))
    chunks = cut.groupBy(key, "_chunk").agg(F.max_by("_sure", F.when(F.col("_sure").isNotNull(), ordered.place(order))).alias("_l"))
    before = Window.partitionBy(key).orderBy(*ordered.ascending(["_chunk"])).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(F.col(key).alias("_own_key"), F.col("_chunk").alias("_own_chunk"), F.last("_l", ignorenulls=True).over(before).alias("_b"))
    within = Window.partitionBy(key, "_chunk").orderBy(*ordered.ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, F.col(key).eqNullSafe(F.col("_own_key")) & F.col("_chunk").eqNullSafe(F.col("_own_chunk")))
    return joined.select(*rows.columns, F.coalesce(F.last("_sure", ignorenulls=True).over(within), "_b", F.lit(first)).alias(name))


def silence_runs(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with run: silent rows of the key since its last row that isn't, this one included; 0 if it isn't silent."""
    counted = ordered.running(rows, key, order, {"_quiet": F.col("silent").cast("int")})
    marked = hysteresis(counted, key, order, F.when(~F.col("silent"), F.col("_quiet")), 0, "_base")
    return marked.select(*rows.columns, F.when(F.col("silent"), F.col("_quiet") - F.col("_base")).otherwise(F.lit(0)).cast("long").alias("run"))


def not_sent(run: Column, frame_ms: int) -> Column:
    """Whether the run-th silent frame in a row is left out: after 400 ms for 800 ms at a time, with one frame between."""
    n0, n1 = 400 // frame_ms, 800 // frame_ms
    return (run > n0) & ((run - n0 - 1) % (n1 + 1) < n1)


# What is known of a signal or an application as a likelihood of speech from 0 to 127, and the largest packet.
SPEECH, MUSIC, CALL, MIXED, MOST_MIXED, MOST_PACKET = 127, 0, 115, 48, 115, 1276


def speech_likelihood(signal: Column, ratio: Column, application: Column) -> Column:
    """How much of a signal is speech: what is told of it (`voice`, `music`), else a ratio in percent (-1: unknown), else by the application.

    application: `voip` or `audio`; audio is never held for more than nine tenths speech.
    """
    by_ratio = F.shiftright(ratio * 327, 8)
    known = F.when(application == "audio", F.least(by_ratio, F.lit(MOST_MIXED))).otherwise(by_ratio)
    return F.when(signal == "voice", SPEECH).when(signal == "music", MUSIC).when(ratio >= 0, known).when(application == "voip", CALL).otherwise(MIXED).cast("long")


def starved(most_bytes: Column, bitrate: Column, frames_a_second: Column) -> Column:
    """Whether there is so little room that a packet can tell no more than its header."""
    slow = (frames_a_second < 50) & ((most_bytes * frames_a_second < 300) | (bitrate < 2400))
    return (most_bytes < 3) | (bitrate < 24 * frames_a_second) | slow


def room_error(frame: Column, room: Column, rate: int = 48000) -> Column:
    """Why a frame can't be coded into `room` bytes: `bad argument`, `buffer too small` (100 ms into one byte), or null."""
    most = F.least(F.lit(6 * MOST_PACKET), room)
    return F.when((frame <= 0) | (most <= 0), "bad argument").when((most == 1) & (frame * 10 == rate), "buffer too small")


def stereo_width(rate: Column) -> Column:
    """How wide the stereo image stays at an equivalent rate, Q14: all from 32 kbit/s, none below 16."""
    return F.when(rate > 32000, 16384).when(rate < 16000, 0).otherwise(16384 - idiv(2048 * (32000 - rate), rate - 14000)).cast("long")


def decimation(rate: Column) -> Column:
    """48 kHz by a rate that divides it; 0 for one that isn't supported."""
    return F.when(rate.isin(8000, 12000, 16000, 24000, 48000), idiv(F.lit(48000), rate)).otherwise(0).cast("long")


def error_class(error: Column) -> Column:
    """What a user is told of a detailed error: `bad argument`, `buffer too small`, `invalid packet`, else `internal error`; null for none."""
    kinds = {
        "bad argument": ["bad argument", "bad range", "bad length", "bad frames"], "buffer too small": ["buffer too small", "too small"], "invalid packet": ["invalid", "empty", "invalid_packet", "invalid packet"],
    }
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, ours in kinds.items():
        out = out.when(error.isin(*ours), name)
    return out.otherwise("internal error")
