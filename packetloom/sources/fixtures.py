"""Adapters that read the tables as signal data: packets, samples, band vectors, payloads and rate sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a packet stream: stream_id, ts, event_id, toc, b1 (second byte), n_bytes."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("stream_id"), "ts", "event_id", (F.col("event_id") % 256).alias("toc"),
        (F.col("event_id") * 7 % 256).alias("b1"), (1 + F.col("event_id") % 1275).alias("n_bytes"),
    )


def packet_bytes(packets: DataFrame) -> DataFrame:
    """packets with data: toc, b1, then (7 event_id + 31 i) % 256 at each offset i, a cycle of 256 bytes that is cut out."""
    cycle = F.lit(bytes(31 * i % 256 for i in range(256)) * 6)
    one = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    begin = (2 + F.col("event_id") * (7 * pow(31, -1, 256) % 256)) % 256 + 1
    second = F.when(F.col("n_bytes") > 1, one(F.col("b1"))).otherwise(F.lit(b""))
    rest = F.substring(cycle, begin.cast("int"), F.greatest(F.col("n_bytes") - 2, F.lit(0)).cast("int"))
    return packets.withColumn("data", F.concat(one(F.col("toc")), second, rest))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value as 16-bit samples: stream_id, ts, event_id, x, silent."""
    e = table(spark, sf_dir, "events")
    x = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(F.col("value") * 64).cast("long") - 16384))
    return e.select(F.col("user_id").alias("stream_id"), "ts", "event_id", x.alias("x"), (F.col("event_type") == "error").alias("silent"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors of whole numbers in Q14: vec_id, label, x."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * 16384).cast("long")).alias("x"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as payloads: doc_id, source, n (UTF-8 bytes)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a sweep of encoder settings: bitrate, frame (samples at 48 kHz), channels, complexity, loss, vbr, mode."""
    i = table(spark, sf_dir, "lineitem")
    frame = F.element_at(F.array(*[F.lit(n) for n in (120, 240, 480, 960, 1920, 2880, 960)]), F.col("l_linenumber")).cast("long")
    return i.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").cast("long").alias("bitrate"), frame.alias("frame"),
        (1 + F.col("l_suppkey") % 2).alias("channels"), (F.col("l_partkey") % 11).alias("complexity"), (F.col("l_orderkey") % 101).alias("loss"),
        (F.col("l_partkey") % 2).alias("vbr"), (F.col("l_orderkey") % 3).alias("mode"),
    )
