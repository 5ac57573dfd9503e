"""How near one stream of samples is to another: an error weighed by what the first one masks.

Both streams are cut into frames of 480 samples at 48 kHz, every 120 samples. Each frame's spectrum is held against the
other's, after band energies of the reference have been added to both: spread over neighbouring bands, over later frames and
over the other channel. The spread over frames halves with each, so a run of frames can be worked on by itself if the
frames of WARM_UP before it are worked on too: what came before these has gone down by 2^-126 of itself, far below what
a double tells. Streams are cut into such runs, each with the samples of both sides that it needs, so that a stream of
any length is many tasks; the runs' errors are summed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Samples of a frame and between frames at 48 kHz, the places in a spectrum where bands begin and end, the
#: power that is added to every place, bands that are compared at each rate, and the shares that are spread.
FRAME, STEP, FLOOR = 480, 120, 100_000.0
EDGES = (0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 68, 80, 96, 120, 156, 200)
BANDS = {8000: 13, 12000: 15, 16000: 17, 24000: 19, 48000: 21}
UPWARD, DOWNWARD, ONWARD, ACROSS, MASKED = 0.1, 0.03, 0.5, 0.01, 0.1
#: Places where decoders are free to choose count less, by these factors.
CROSSOVER = {79: 0.1, 80: 0.01, 81: 0.1}

#: Frames in a run, and before it.
RUN, WARM_UP = 512, 128


def _spectra(samples: np.ndarray, frame: int, step: int, bins: int) -> np.ndarray:
    """Power of each frame, place and channel of samples (time x channel)."""
    window = 0.5 - 0.5 * np.cos(2 * math.pi / (frame - 1) * np.arange(frame))
    cut = np.lib.stride_tricks.sliding_window_view(samples, frame, axis=0)[::step]  # frame x channel x time
    scale = FRAME / frame
    return np.abs(np.fft.rfft(cut * window, axis=2)[:, :, :bins].transpose(0, 2, 1) * scale) ** 2 + FLOOR


def _masks(power: np.ndarray) -> np.ndarray:
    """What each frame, band and channel of the reference masks."""
    bands = np.stack([power[:, a:b].mean(axis=1) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)], axis=1)
    for b in range(1, bands.shape[1]):
        bands[:, b] += UPWARD * bands[:, b - 1]
    for b in range(bands.shape[1] - 2, -1, -1):
        bands[:, b] += DOWNWARD * bands[:, b + 1]
    for t in range(len(bands)):
        if t:
            bands[t] += ONWARD * bands[t - 1]
        if bands.shape[2] == 2:
            bands[t] += ACROSS * bands[t, :, ::-1]
    return bands


def frame_errors(x: np.ndarray, y: np.ndarray, rate: int, skip: int) -> np.ndarray:
    """The weighed error of each frame of y (at rate) against x (48 kHz), both time x channel; the first skip frames only lead in."""
    n, ratio = BANDS[rate], 48_000 // rate
    most = EDGES[n]
    power = _spectra(x, FRAME, STEP, EDGES[-1])
    masks = MASKED * np.repeat(_masks(power)[:, :n], np.diff(EDGES)[:n], axis=1)
    one, two = power[:, :most] + masks, _spectra(y, FRAME // ratio, STEP // ratio, most) + masks
    one[1:], two[1:] = one[1:] + one[:-1], two[1:] + two[:-1]  # of two frames together
    share = (two / one)[skip:]
    error = share - np.log(share) - 1
    for place, factor in CROSSOVER.items():
        if place < most:
            error[:, place] *= factor
    # below 48 kHz the last 300 Hz may differ; at 12 kHz the last band leaves out as much by itself
    error[:, most if rate in (12000, 48000) else most - 3 :] = 0
    bands = np.add.reduceat(error.sum(axis=2), EDGES[:n], axis=1) / (np.diff(EDGES)[:n] * x.shape[1])
    return ((bands**2).sum(axis=1) / (len(EDGES) - 1)) ** 4


def _pieces(blocks: DataFrame, stream: str, position: str, samples: str, channels: int, ratio: int, side: int) -> DataFrame:
    """(stream, run, side, at, piece): what each run of frames needs of a side's blocks; times count samples at 48 kHz."""
    span = RUN * STEP
    begin, n = F.col(position) * ratio, F.ceil(F.size(samples) / channels) * ratio
    first = F.greatest(F.floor((begin - (FRAME - STEP)) / span), F.lit(0))
    last = F.ceil((begin + n + WARM_UP * STEP) / span) - 1
    rows = blocks.where(F.size(samples) > 0).select(F.col(stream).alias("stream"), F.col(position).alias("at"), F.col(samples).alias("x"), F.explode(F.sequence(first, F.greatest(first, last))).alias("run"))
    low = F.greatest(F.call_function("div", F.greatest((F.col("run") * RUN - WARM_UP) * STEP, F.lit(0)), F.lit(ratio).cast("long")) - F.col("at"), F.lit(0))
    high = F.call_function("div", (F.col("run") + 1) * span + FRAME - STEP, F.lit(ratio).cast("long")) - F.col("at")
    piece = F.slice("x", (low * channels + 1).cast("int"), (F.greatest(high - low, F.lit(0)) * channels).cast("int"))
    return rows.select("stream", "run", F.lit(side).alias("side"), (F.col("at") + low).alias("at"), piece.cast("array<smallint>").alias("piece")).where(F.size("piece") > 0)


def _lengths(blocks: DataFrame, stream: str, position: str, samples: str, channels: int, name: str) -> DataFrame:
    """(stream, name, name_whole): a side's samples a channel, and whether its blocks follow one another."""
    n = F.size(samples).cast("long")
    end = F.max(F.col(position) * channels + n)
    sound = (F.sum(n) == end) & (F.min(position) == 0) & (F.max(F.when(n > 0, F.col(position))) * channels + F.max_by(n, F.when(n > 0, F.col(position))) == end)
    total = F.floor(F.sum(n) / channels)
    return blocks.groupBy(F.col(stream).alias("stream")).agg(total.alias(name), F.coalesce(sound | (F.sum(n) == 0), F.lit(False)).alias(f"{name}_whole"))


def quality(error: Column) -> Column:
    """The quality in percent (100: no difference) of a mean error: 16th root, then logarithms."""
    return 100 * (1 - 0.5 * F.log1p(F.pow(error, F.lit(1 / 16))) / math.log(1.13))


def compare(reference: DataFrame, test: DataFrame, *, stream: str = "stream", position: str = "position", samples: str = "samples", channels: int = 2, rate: int = 48_000) -> DataFrame:
    """A row for each stream of either side: stream, n_frames, weighted_error, quality (percent), passed (quality >= 0), error.

    Both sides are blocks of interleaved 16-bit samples, position being a block's first sample of each channel, as the source
    "wave" gives them. The reference is stereo at 48 kHz, and is mixed to one channel if `channels` is 1; the test has
    `channels` and `rate`. error is `blocks overlap or leave gaps`, `sample counts do not match` (a stream that one side
    lacks has none there) or `insufficient sample data` (under a frame); the other columns are null then. Samples beyond the
    last whole one of all channels, and after the last whole frame, are left out. A null stream is one like others.
    """
    if rate not in BANDS:
        raise ValueError("rate must be 8000, 12000, 16000, 24000 or 48000")
    if channels not in (1, 2):
        raise ValueError("channels must be 1 or 2")
    ratio = 48_000 // rate
    lengths = [_lengths(reference, stream, position, samples, 2, "n_x"), _lengths(test, stream, position, samples, channels, "n_y").withColumnRenamed("stream", "other")]
    both = lengths[0].join(lengths[1], F.col("stream").eqNullSafe(F.col("other")), "full")
    has = [F.col(f"{n}_whole").isNotNull() for n in ("n_x", "n_y")]
    n_x, n_y = (F.coalesce(n, F.lit(0)) for n in ("n_x", "n_y"))
    error = (
        F.when(~F.coalesce("n_x_whole", F.lit(True)) | ~F.coalesce("n_y_whole", F.lit(True)), "blocks overlap or leave gaps").when(n_x != n_y * ratio, "sample counts do not match")
        .when(n_x < FRAME, "insufficient sample data")
    )
    both = both.select(F.when(has[0], F.col("stream")).otherwise(F.col("other")).alias("stream"), error.alias("error"), F.when(error.isNull(), F.floor((n_x - FRAME + STEP) / STEP)).alias("n_frames"))

    pieces = _pieces(reference, stream, position, samples, 2, 1, 0).union(_pieces(test, stream, position, samples, channels, ratio, 1))
    # a run's own samples tell how many frames it has, so that runs move no more after they are gathered
    runs = pieces.groupBy("stream", "run").agg(F.array_sort(F.collect_list(F.struct("side", "at", "piece"))).alias("p"))
    name = runs.schema["stream"]

    def work(batches):
        for batch in batches:
            out = []
            for run, parts in zip(*(batch.column(i) for i in (1, 2)), strict=True):
                parts, sides = parts.values, []
                which = parts.field("side").to_numpy()
                for side, width in ((0, 2), (1, channels)):
                    lists = parts.field("piece").filter(pa.array(which == side))
                    flat = lists.flatten().to_numpy().astype(np.float64)
                    sides.append(flat[: len(flat) // width * width].reshape(-1, width))
                x, y = sides
                if channels == 1:
                    x = x.mean(axis=1, keepdims=True)
                skip = min(run.as_py() * RUN, WARM_UP)
                n = min((len(x) - FRAME) // STEP + 1, skip + RUN)
                if n <= skip or len(y) < ((n - 1) * STEP + FRAME) // ratio:  # nothing of its own, or streams of unequal length
                    out.append(0.0)
                    continue
                x, y = x[: (n - 1) * STEP + FRAME], y[: ((n - 1) * STEP + FRAME) // ratio]
                out.append(float(frame_errors(x, y, rate, skip).sum()))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=["stream", "errors"])

    found = runs.mapInArrow(work, f"stream {name.dataType.simpleString()}, errors double")
    sums = found.groupBy(F.col("stream").alias("known")).agg(F.sum("errors").alias("errors"))
    mean = F.col("errors") / F.col("n_frames")
    joined = both.join(sums, F.col("stream").eqNullSafe(F.col("known")), "left").withColumn("quality", quality(mean))
    return joined.select(F.col("stream").alias(stream), "n_frames", F.pow(mean, F.lit(1 / 16)).alias("weighted_error"), "quality", (F.col("quality") >= 0).alias("passed"), "error")
