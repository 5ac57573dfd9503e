"""The packet census over a stream of packets, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import header as h


def windowed_census(packets: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Packets, bytes and samples by mode in windows of event time, over a streaming or batch frame (ts, event_id, toc, n_bytes).

    Packets more than `late` behind the newest are left out in a stream, and state older than that is dropped; a packet
    that arrives again within that time counts once. State grows with windows and modes, and with packets only as far
    back as `late`.
    """
    packets = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    once = packets.withWatermark("ts", late).dropDuplicates(["event_id", "ts"])
    toc = F.col("toc")
    return once.groupBy(F.window("ts", window).alias("w"), h.mode(toc).alias("mode")).agg(
        F.count("*").alias("n_packets"), F.sum("n_bytes").alias("n_bytes"), F.sum(h.samples_per_frame(toc)).alias("n_samples")
    ).select(F.col("w.start").alias("start"), "mode", "n_packets", "n_bytes", "n_samples")
