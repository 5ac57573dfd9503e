"""The smoother in blocks, along a stream and row by row is one and the same."""

import random
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.operators import smoothing
from packetloom.streaming import smoothing as streamed


def plain(rows, share, first):
    out, levels = {}, defaultdict(lambda: first)
    for k, _, i, t in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        levels[k] = levels[k] if t is None else levels[k] + ((t - levels[k]) * share >> 16)
        out[i] = levels[k]
    return out


@pytest.mark.parametrize("share", [1, 983, 20_000, 65_535])
def test_summaries_follow_every_level(share):
    r = random.Random(share)
    for n in (0, 1, 40, 3000, 9000):
        targets = [r.choice([r.randint(-(1 << 31), (1 << 31) - 1), r.randint(-1000, 1000), 5]) for _ in range(n)]
        least, more = smoothing.summary(targets, share)
        assert len(more) <= max(n, 1)
        assert least is None or more == sorted(more)
        for level in (smoothing.LOW, smoothing.HIGH, 0, -1, *(r.randint(smoothing.LOW, smoothing.HIGH) for _ in range(20)), *(x + d for x in (more if least is not None else [])[:5] for d in (-1, 0))):
            want = level
            for t in targets:
                want = smoothing.step(want, t, share)
            assert smoothing.followed(level, least, more, share) == want
    if share == 983:
        assert smoothing.summary([7] * 9000, share)[0] is not None  # long runs are told by what they reach


@pytest.mark.parametrize("share", [983, 20_000])
def test_blocks_equal_row_by_row(spark, share):
    r = random.Random(share)
    rows = [(r.choice(["hot"] * 7 + ["a", "b", None]), r.choice([None, *range(300)]), i, r.choice([None, *[r.randint(-(1 << 20), 1 << 20)] * 9])) for i in range(9000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    found = smoothing.smooth(spark.createDataFrame(rows, "k string, at long, i long, t long").repartition(3), "k", ["at", "i"], F.col("t"), share, 77, "level")
    assert found.columns == ["k", "at", "i", "t", "level"]
    got = {x.i: x.level for x in found.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows, share, 77)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, 1 << 31)], "k string, i long, t long")
    assert smoothing.smooth(df.where("false"), "k", ["i"], F.col("t"), 983, 0, "level").collect() == []
    with pytest.raises(Exception, match="too large"):
        smoothing.smooth(df, "k", ["i"], F.col("t"), 983, 0, "level").collect()
    for share, first in ((0, 0), (65_536, 0), (5, 1 << 31)):
        with pytest.raises(ValueError):
            smoothing.smooth(df, "k", ["i"], F.col("t"), share, first, "level")


def test_stream_equals_batch(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), i, i, r.randint(-50_000, 50_000) if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at long, i long, t long")
    folder = tempfile.mkdtemp(prefix="spark-")
    for n in range(3):  # batches in order
        df.where(f"i div 200 = {n}").coalesce(1).write.parquet(f"{folder}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streamed.PROVIDER)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        q = streamed.smoothed(stream, "k", ["i"], "t", 983, 5).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {x.i: x.level for x in spark.read.parquet(f"{folder}/out").collect()} == plain(rows, 983, 5)
