"""Frames of a fixed size from bytes that come in chunks of any size, and correlation over lags along a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import ordered
from .container import PRE_SKIP

#: Rows whose products with the rows after them one group of the lag sums holds.
SPAN = 1024


def frames(chunks: DataFrame, stream: str, order: list[str], data: str, frame_bytes: int) -> DataFrame:
    """(stream, frame, n_bytes, content): each stream's bytes in order, cut every frame_bytes; the last frame is filled up with zeros.

    n_bytes is what of a frame was there. Chunks may be empty or null, and longer or shorter than a frame; any cutting of the
    same bytes gives the same frames. Pieces of a chunk go to the frames they overlap, so no stream is brought together. order
    must tell a stream's chunks apart; those that tie fail the job.
    """
    if frame_bytes < 1:
        raise ValueError("a frame takes a byte at least")
    size, place = F.octet_length(data), [F.col(c).alias(f"_at{i}") for i, c in enumerate(order)]
    rows = chunks.where(size > 0).select(F.col(stream).alias("stream"), *place, F.col(data).alias("_data"))
    order = [f"_at{i}" for i in range(len(order))]
    # only lengths are put in order; the bytes move once, to their frames
    sizes = rows.groupBy("stream", *order).agg(F.sum(F.octet_length("_data")).alias("_n"), F.count("*").alias("_many"))
    sizes = sizes.withColumn("_n", F.when(F.col("_many") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("chunks of a stream tie in order"))))
    ends = ordered.sums(ordered.dealt(sizes, "stream", order), "stream", order, {"_end": F.col("_n")}).select(*(F.col(c).alias(f"_own_{c}") for c in ("stream", *order)), "_end")
    match = F.lit(True)
    for c in ("stream", *order):
        match = match & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    rows = rows.join(ends, match).select("stream", "_end", "_data")
    begin, end = F.col("_end") - F.octet_length("_data"), F.col("_end")
    size = F.lit(frame_bytes).cast("long")
    over = F.sequence(F.call_function("div", begin, size), F.call_function("div", end - 1, size))
    pieces = rows.select("stream", begin.alias("begin"), "_end", "_data", F.explode(over).alias("frame"))
    low, high = F.greatest("begin", F.col("frame") * size), F.least("_end", (F.col("frame") + 1) * size)
    piece = F.substring(F.col("_data"), (low - F.col("begin") + 1).cast("int"), (high - low).cast("int"))
    whole = pieces.select("stream", "frame", low.alias("at"), piece.alias("piece")).groupBy("stream", "frame").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("x"))
    hexed = F.array_join(F.transform("x.piece", lambda b: F.hex(b)), "")
    return whole.select(F.col("stream").alias(stream), "frame", (F.length(hexed) / 2).cast("long").alias("n_bytes"), F.unhex(F.rpad(hexed, 2 * frame_bytes, "0")).alias("content"))


def coverage(found: DataFrame, stream: str, frame_bytes: int, sample_bytes: int, rate: int) -> DataFrame:
    """A row for each stream of frames(): n_frames, silent_frames, source and coded samples at 48 kHz, granule, error.

    The end position is the source's samples after the pre-skip; where the frames cover less than that, a silent one follows.
    error tells of a last sample that is cut; positions are null then.
    """
    ratio, frame = 48_000 // rate, frame_bytes // sample_bytes * (48_000 // rate)
    if frame_bytes % sample_bytes or 48_000 % rate:
        raise ValueError("a frame holds whole samples, and rates divide 48000")
    totals = found.groupBy(stream).agg(F.sum("n_bytes").alias("n"), F.count("*").alias("n_frames"))
    good = F.col("n") % sample_bytes == 0
    source = F.call_function("div", F.col("n"), F.lit(sample_bytes).cast("long")) * ratio
    short = F.greatest(source + PRE_SKIP - F.col("n_frames") * frame, F.lit(0))
    silent = F.ceil(short / frame)
    error = F.when(~good, "trailing bytes are no whole sample")
    columns = {"silent_frames": silent, "source": source, "coded": (F.col("n_frames") + silent) * frame, "granule": source + PRE_SKIP}
    return totals.select(stream, "n_frames", *(F.when(good, c.cast("long")).alias(n) for n, c in columns.items()), error.alias("error"))


def lag_sums(rows: DataFrame, key: str, order: list[str], value: str, first: int, last: int) -> DataFrame:
    """(key, lag, n, xy, xx, yy) for lags first to last: sums over a key's rows i of x[i] x[i + lag], x[i]^2 and x[i + lag]^2.

    Rows are numbered along their key and grouped by SPAN; each group also gets the `last` rows that follow it, so its work is
    SPAN times the lags, and rows are copied 1 + last / SPAN times. Null values count as 0. Sums of 16-bit values are exact
    up to 2^33 rows of a key. Keys of no more than `first` rows have no pairs and no rows.
    """
    if not 0 <= first <= last:
        raise ValueError("lags go from 0 on, upward")
    cut = ordered.dealt(rows.select(key, *order, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_v")), key, order)
    numbered = ordered.sums(cut, key, order, {"_n": F.lit(1)}).withColumn("_i", F.col("_n") - 1)
    own = F.call_function("div", F.col("_i"), F.lit(SPAN).cast("long"))
    from_ = F.greatest(F.call_function("div", F.greatest(F.col("_i") - last, F.lit(0).cast("long")), F.lit(SPAN).cast("long")), F.lit(0).cast("long"))
    groups = numbered.select(key, "_i", "_v", F.explode(F.sequence(from_, own)).alias("g")).groupBy(key, "g").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("x"))
    x = F.col("x._v")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)

    def sums(lag):
        n = F.greatest(F.least(F.size(x) - lag, F.lit(SPAN)), F.lit(0))
        a, b = F.slice(x, 1, n), F.slice(x, lag + 1, n)
        return F.struct(lag.alias("lag"), n.cast("long").alias("n"), total(F.zip_with(a, b, lambda p, q: p * q)).alias("xy"), total(F.transform(a, lambda p: p * p)).alias("xx"), total(F.transform(b, lambda q: q * q)).alias("yy"))

    each = groups.select(key, F.inline(F.transform(F.sequence(F.lit(first), F.lit(last)), sums))).where("n > 0")
    return each.groupBy(key, F.col("lag").cast("long").alias("lag")).agg(*(F.sum(c).alias(c) for c in ("n", "xy", "xx", "yy")))


def best_lags(found: DataFrame, key: str, most: int = 2) -> DataFrame:
    """The `most` lags of each key with positive xy and the largest xy^2 / yy, ties to the smaller lag: key, rank (from 1), lag, xy, yy."""
    score = F.col("xy").cast("double") * F.col("xy") / F.col("yy")
    row = F.struct((-score).alias("s"), "lag", "xy", "yy")
    kept = found.where("xy > 0").groupBy(key).agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("x"))  # a row for each lag
    return kept.select(key, F.posexplode("x").alias("rank", "x")).select(key, (F.col("rank") + 1).alias("rank"), "x.lag", "x.xy", "x.yy")
