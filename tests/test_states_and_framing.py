"""State along streams, frames from chunks, lags and medians: against plain loops, however rows are dealt and chunks are cut."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.operators import framing, ordered, signal as sg, states


@pytest.fixture
def many_blocks(spark):
    """Enough shuffle partitions to cut small streams into many blocks."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def streams(spark, n, seed):
    """Most rows in one stream, some without a stream or a time."""
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, *range(40)]), i, r.randint(-12_000, 14_000) if r.random() > 0.05 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at long, i long, x long").repartition(5)


def along(rows):
    found = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        found[row[0]].append(row)
    return found


def test_rungs_equal_a_plain_fold(many_blocks):
    spark, thresholds, margins = many_blocks, [-9000, -3000, 0, 4000, 11000], [400, 250, 150, 300, 7000]
    rows, df = streams(spark, 700, 1)
    got = {r.i: r.rung for r in states.fold(df, "k", ["at", "i"], states.rungs(F.col("x"), thresholds, margins), 6, 2, "rung").collect()}
    want = {}
    for stream in along(rows).values():
        last = 2
        for _, _, i, x in stream:
            if x is not None:
                rung = next((k for k in range(5) if x < thresholds[k]), 5)
                if rung > last and x < thresholds[last] + margins[last]:
                    rung = last
                if rung < last and x > thresholds[last - 1] - margins[last - 1]:
                    rung = last
                last = rung
            want[i] = last
    assert got == want and len(set(want.values())) == 6
    assert ordered.dealt(df, "k", ["at", "i"]).where("k = 'hot'").select("_block").distinct().count() > 5


def test_bandwidths_equal_a_plain_ladder(many_blocks):
    spark = many_blocks
    r = random.Random(2)
    rows = [("s" if r.random() < 0.7 else "t", i, r.randint(7_000, 17_000) if r.random() > 0.03 else None, r.randint(0, 127)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, rate long, voice long")
    got = {x.i: x.rank for x in states.fold(df, "k", ["i"], states.bandwidths(F.col("rate"), F.col("voice")), 6, states.FRESH, "rank").collect()}
    want = {}
    for k in "st":
        last = None
        for _, i, rate, voice in (x for x in rows if x[0] == k):
            if rate is not None:
                share = lambda v, m, voice=voice: m + (voice * voice * (v - m) >> 14)
                rank = 4
                while rank > 0:
                    (v, w), (m, n) = states.VOICE[rank - 1], states.MUSIC[rank - 1]
                    least = share(v, m)
                    if last is not None:
                        least += -share(w, n) if last >= rank else share(w, n)
                    if rate >= least:
                        break
                    rank -= 1
                last = 2 if rank == 1 else rank
            want[i] = states.FRESH if last is None else last
    assert got == want and {0, 2, 3, 4} <= set(want.values())
    rates = [4000, 8000, 12000, 16000, 24000, 48000]
    df = spark.createDataFrame([(b, h) for b in range(5) for h in rates], "b int, h int")
    assert {(x.b, x.h): x.y for x in df.withColumn("y", states.audible(F.col("b"), F.col("h"))).collect()} == {
        (b, h): {0: 0, 1: 2}.get(m := min(b, {4000: 0, 8000: 0, 12000: 1, 16000: 2, 24000: 3, 48000: 4}[h]), m) for b in range(5) for h in rates
    }


def test_fold_of_nothing_and_of_wrong_states(spark):
    _, df = streams(spark, 3, 1)
    step = states.rungs(F.col("x"), [0], [1])
    assert states.fold(df.where("false"), "k", ["at", "i"], step, 2, 0, "s").collect() == []
    with pytest.raises(ValueError):
        states.fold(df, "k", ["at", "i"], step, 2, 2, "s")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_chunks_give_the_same_frames(many_blocks, seed):
    spark, r = many_blocks, random.Random(seed)
    data = {"a": r.randbytes(5003), "b": r.randbytes(96), "c": b"", None: r.randbytes(50)}
    rows = []
    for name, d in data.items():
        cuts = sorted(r.randint(0, len(d)) for _ in range(60 if seed == 1 else 3))
        rows += [(name, k, bytearray(d[x:y]) if k % 9 or d[x:y] else None) for k, (x, y) in enumerate(itertools.pairwise([0, *cuts, len(d)]))]
    r.shuffle(rows)
    found = framing.frames(spark.createDataFrame(rows, "s string, i long, d binary").repartition(4), "s", ["i"], "d", 96)
    got = {(x.s, x.frame): (x.n_bytes, bytes(x.content)) for x in found.collect()}
    assert got == {(n, k): (len(d[96 * k : 96 * k + 96]), d[96 * k : 96 * k + 96].ljust(96, b"\0")) for n, d in data.items() for k in range(-(-len(d) // 96))}
    cover = {x.s: tuple(x)[1:] for x in framing.coverage(found, "s", 96, 4, 24_000).collect()}
    # 24 samples a frame, 48 of them at 48 kHz; the end position is that of the source and the pre-skip
    assert cover["b"] == (1, 7, 48, 48 * 8, 48 + 312, None) and cover["a"] == (53, None, None, None, None, "trailing bytes are no whole sample") and "c" not in cover
    assert cover["b"][3] >= cover["b"][4]
    with pytest.raises(Exception, match="tie in order"):
        framing.frames(spark.createDataFrame([("a", 1, bytearray(b"x")), ("a", 1, bytearray(b"y"))], "s string, i long, d binary"), "s", ["i"], "d", 9).collect()
    with pytest.raises(ValueError):
        framing.frames(found, "s", ["frame"], "content", 0)
    with pytest.raises(ValueError):
        framing.coverage(found, "s", 97, 4, 24_000)


def test_lags_equal_plain_sums(many_blocks, monkeypatch):
    monkeypatch.setattr(framing, "SPAN", 16)
    rows, df = streams(many_blocks, 400, 3)
    got = {(x.k, x.lag): (x.n, x.xy, x.xx, x.yy) for x in framing.lag_sums(df, "k", ["at", "i"], "x", 0, 21).collect()}
    want = {}
    for k, stream in along(rows).items():
        v = [x or 0 for *_, x in stream]
        for lag in range(22):
            a, b = v[: max(len(v) - lag, 0)], v[lag:]
            if a:
                want[k, lag] = (len(a), sum(p * q for p, q in zip(a, b, strict=True)), sum(p * p for p in a), sum(q * q for q in b))
    assert got == want
    best = {(x.k, x["rank"]): (x.lag, x.xy, x.yy) for x in framing.best_lags(framing.lag_sums(df, "k", ["at", "i"], "x", 2, 21), "k").collect()}
    for k in ("hot", "a", "b", None):
        order = sorted((-(xy * xy) / yy, lag, xy, yy) for (name, lag), (_, xy, _, yy) in want.items() if name == k and lag >= 2 and xy > 0)
        assert [best[k, n + 1] for n in range(min(2, len(order)))] == [o[1:] for o in order[:2]]


def test_medians(spark):
    r = random.Random(4)
    rows = [[r.randint(-5, 5) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 6, 21, 21)] + [list(p) for p in itertools.permutations([1, 2, 2, 4, 5])]
    mid = lambda x: sorted(x)[len(x) // 2]
    want = [x if len(x) < 3 else [mid(x[:3]) if i < 2 else mid(x[-3:]) if i >= len(x) - 2 else mid(x[i - 2 : i + 3]) for i in range(len(x))] for x in rows]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<long>")
    assert [x.y for x in df.withColumn("y", sg.sliding_median(F.col("x"))).orderBy("i").collect()] == want
