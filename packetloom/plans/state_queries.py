"""Queries along streams: decisions with a memory, frames from chunks, correlation over lags, quality of one stream against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..operators import comparison, framing, signal as sg, smoothing, states
from ..sources import files, fixtures
from ..streaming import census
from .base import BANDS, HEADERS, PACKETS, SAMPLES, query

ORDER = ["ts", "event_id"]
#: A ladder for 16-bit samples.
STEPS, MARGINS = [-9000, -3000, 0, 4000, 11000], [400, 250, 150, 300, 700]


def _ladder(rank: int, sign: str) -> str:
    """The rate that a bandwidth takes in SQL, with its hysteresis added or taken off."""
    (v, w), (m, k) = states.VOICE[rank - 1], states.MUSIC[rank - 1]
    share = lambda a, b: f"({b} + ((voice * voice * {a - b}) >> 14))"
    return share(v, m) + (f" {sign} {share(w, k)}" if sign else "")


def _choice(fresh: str, last: str) -> str:
    parts = [f"WHEN rate >= CASE WHEN {fresh} THEN {_ladder(b, '')} WHEN {last} >= {b} THEN {_ladder(b, '-')} ELSE {_ladder(b, '+')} END THEN {max(b, 2)}" for b in range(4, 0, -1)]
    return f"CASE {' '.join(parts)} ELSE 0 END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS stream_id, event_id, 8500 + (CAST(floor(value * 64) AS BIGINT) * 13 + event_id) % 7000 AS rate, event_id % 128 AS voice, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT e.stream_id, e.event_id, e.n, CAST({_choice('TRUE', '0')} AS INTEGER) AS rank FROM e WHERE n = 1
  UNION ALL SELECT e.stream_id, e.event_id, e.n, CAST({_choice('FALSE', 'r.rank')} AS INTEGER) FROM r JOIN e ON e.stream_id IS NOT DISTINCT FROM r.stream_id AND e.n = r.n + 1)
SELECT stream_id, event_id, rank AS bandwidth_rank, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 <= 2 THEN least(rank, 2) WHEN event_id % 5 = 3 THEN least(rank, 3) ELSE rank END AS audible_rank FROM r""")
def bandwidth_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bandwidth that every packet's rate asks for, by a ladder whose steps depend on the stream's last choice, and what its sample rate carries."""
    i = F.col("event_id")
    rate = 8500 + (F.floor(F.col("value") * 64).cast("long") * 13 + i) % 7000
    rows = fixtures.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", rate.alias("rate"), (i % 128).alias("voice"))
    found = states.fold(rows, "stream_id", ORDER, states.bandwidths(F.col("rate"), F.col("voice")), 6, states.FRESH, "bandwidth_rank")
    hertz = F.element_at(F.array(*map(F.lit, (8000, 12000, 16000, 24000, 48000))), (i % 5 + 1).cast("int"))
    return found.select("stream_id", "event_id", "bandwidth_rank", states.audible(F.col("bandwidth_rank"), hertz).alias("audible_rank"))


def _rung(last: str) -> str:
    reached = "len(list_filter(range(5), lambda k: x >= t[k + 1]))"  # thresholds ascend
    return f"CASE WHEN {reached} > {last} AND x < t[{last} + 1] + m[{last} + 1] THEN {last} WHEN {reached} < {last} AND x > t[{last}] - m[{last}] THEN {last} ELSE {reached} END"


@query(f"""WITH RECURSIVE {SAMPLES}, e AS (SELECT stream_id, event_id, x, {STEPS} AS t, {MARGINS} AS m, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS n FROM x),
r AS (SELECT e.stream_id, e.event_id, e.n, CAST({_rung('2')} AS INTEGER) AS rung FROM e WHERE n = 1
  UNION ALL SELECT e.stream_id, e.event_id, e.n, CAST({_rung('r.rung')} AS INTEGER) FROM r JOIN e ON e.stream_id IS NOT DISTINCT FROM r.stream_id AND e.n = r.n + 1)
SELECT stream_id, event_id, rung FROM r""")
def threshold_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rung of a ladder of levels that every sample is on, with a margin for leaving the last one."""
    rows = fixtures.samples(spark, sf_dir).select("stream_id", "ts", "event_id", "x")
    found = states.fold(rows, "stream_id", ORDER, states.rungs(F.col("x"), STEPS, MARGINS), len(STEPS) + 1, 2, "rung")
    return found.select("stream_id", "event_id", "rung")


@query(f"""WITH RECURSIVE {SAMPLES}, e AS (SELECT stream_id, event_id, CASE WHEN silent THEN NULL ELSE x * 256 END AS t, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS n FROM x),
r AS (SELECT stream_id, event_id, n, CAST(coalesce(floor(t * 983 / 65536.0), 0) AS BIGINT) AS level FROM e WHERE n = 1
  UNION ALL SELECT e.stream_id, e.event_id, e.n, CAST(r.level + coalesce(floor((e.t - r.level) * 983 / 65536.0), 0) AS BIGINT) FROM r JOIN e ON e.stream_id IS NOT DISTINCT FROM r.stream_id AND e.n = r.n + 1)
SELECT stream_id, event_id, level FROM r""")
def smoothed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's level, moved toward its samples by 1.5 % a step in whole numbers; silent rows leave it."""
    rows = fixtures.samples(spark, sf_dir)
    found = smoothing.smooth(rows, "stream_id", ORDER, F.when(~F.col("silent"), F.col("x") * 256), 983, 0, "level")
    return found.select("stream_id", "event_id", "level")


@query(f"""WITH {PACKETS}, {HEADERS} SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, mode, count(*) AS n_packets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(spf) AS BIGINT) AS n_samples FROM h WHERE ts IS NOT NULL GROUP BY ALL""")
def streamed_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly packet census by mode, made by a streaming query over the table's files and read when it has come to their end."""
    events = fixtures.table(spark, sf_dir, "events")
    packets = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    i = F.col("event_id")
    packets = packets.select("ts", "event_id", (i % 256).alias("toc"), (1 + i % 1275).alias("n_bytes"))
    folder = storage.scratch(spark)
    counted = census.windowed_census(packets, late="36500 days")
    done = counted.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state")
    done.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out")


@query("""WITH s AS (SELECT source, string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY doc_id) AS h FROM documents GROUP BY source),
f AS (SELECT source, unnest(range(0, (len(h) + 1919) // 1920)) AS frame, h FROM s)
SELECT source, CAST(frame AS BIGINT) AS frame, CAST(len(substr(h, 1920 * frame + 1, 1920)) // 2 AS BIGINT) AS n_bytes, md5(rpad(substr(h, 1920 * frame + 1, 1920), 1920, '0')) AS content_md5 FROM f""")
def chunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of every source as one stream of bytes, cut into frames of 960 bytes across documents."""
    chunks = fixtures.table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("data"))
    found = framing.frames(chunks, "source", ["doc_id"], "data", 960)
    return found.select("source", "frame", "n_bytes", F.md5(F.hex("content").cast("binary")).alias("content_md5"))


@query("""WITH s AS (SELECT source, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n FROM documents GROUP BY source HAVING sum(octet_length(encode(coalesce(text, '')))) > 0),
k AS (SELECT source, n, (n + 3839) // 3840 AS frames, n // 4 AS src FROM s)
SELECT source, CAST(frames AS BIGINT) AS n_frames, CASE WHEN n % 4 = 0 THEN CAST((greatest(src + 312 - frames * 960, 0) + 959) // 960 AS BIGINT) END AS silent_frames, CASE WHEN n % 4 = 0 THEN src END AS source_samples,
  CASE WHEN n % 4 = 0 THEN CAST((frames + (greatest(src + 312 - frames * 960, 0) + 959) // 960) * 960 AS BIGINT) END AS coded, CASE WHEN n % 4 = 0 THEN src + 312 END AS granule, CASE WHEN n % 4 <> 0 THEN 'trailing bytes are no whole sample' END AS error FROM k""")
def frame_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 20 ms that every source's bytes fill as stereo samples at 48 kHz, the silent one after them, and the end position."""
    chunks = fixtures.table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("data"))
    found = framing.frames(chunks, "source", ["doc_id"], "data", 3840)
    covered = framing.coverage(found.withColumnRenamed("source", "stream"), "stream", 3840, 4, 48_000)
    return covered.withColumnRenamed("source", "source_samples").withColumnRenamed("stream", "source")


@query(f"""WITH {SAMPLES}, n AS (SELECT stream_id, x, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS i FROM x),
s AS (SELECT a.stream_id, b.i - a.i AS lag, sum(a.x * b.x) AS xy, sum(b.x * b.x) AS yy FROM n AS a JOIN n AS b ON a.stream_id = b.stream_id AND b.i BETWEEN a.i + 2 AND a.i + 24 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY CAST(xy AS DOUBLE) * CAST(xy AS DOUBLE) / CAST(yy AS DOUBLE) DESC, lag) AS rank FROM s WHERE xy > 0)
SELECT stream_id, CAST(rank AS INTEGER) AS rank, CAST(lag AS BIGINT) AS lag, CAST(xy AS BIGINT) AS xy, CAST(yy AS BIGINT) AS yy FROM r WHERE rank <= 2""")
def lag_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lags from 2 to 24 at which every stream of samples is most like itself."""
    found = framing.lag_sums(fixtures.samples(spark, sf_dir), "stream_id", ORDER, "x", 2, 24)
    return framing.best_lags(found, "stream_id")


@query(f"""WITH {BANDS}, m AS (SELECT vec_id, list_transform(range(len(x)), lambda i: CASE WHEN len(x) < 3 THEN x[i + 1] WHEN i < 2 THEN list_sort(x[1 : 3])[2] WHEN i >= len(x) - 2 THEN list_sort(x[len(x) - 2 : len(x)])[2] ELSE list_sort(x[i - 1 : i + 3])[3] END) AS y FROM v)
SELECT vec_id, array_to_string(y, ',') AS medians FROM m""")
def band_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding median of every vector's levels."""
    return fixtures.bands(spark, sf_dir).select("vec_id", F.array_join(sg.sliding_median(F.col("x")).cast("array<string>"), ",").alias("medians"))


@query()
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as stereo samples, against themselves with their low bits taken off, or mixed to one channel at 16 kHz."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("position"), files.unpacked(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("samples"))
    step = F.pow(F.lit(2), F.col("doc_id") % 13).cast("int")
    coarse = docs.withColumn("samples", F.transform("samples", lambda x: (x - F.pmod(x.cast("int"), step)).cast("short")))
    thirds = F.sequence(F.lit(0), F.call_function("div", F.size("samples"), F.lit(6)).cast("int") - 1)
    mixed = F.transform(thirds, lambda i: F.call_function("div", F.get("samples", 6 * i).cast("int") + F.get("samples", 6 * i + 1), F.lit(2)).cast("short"))
    thin = docs.withColumn("samples", F.when(F.size("samples") >= 6, mixed).otherwise(F.array().cast("array<smallint>")))
    one = lambda df: df.where("doc_id % 2 = 1")
    two = lambda df: df.where("doc_id % 2 = 0")
    kinds = {"stream": "doc_id"}
    found = comparison.compare(two(docs), two(coarse), **kinds).union(comparison.compare(one(docs), one(thin), channels=1, rate=16_000, **kinds))
    return found.select("doc_id", F.col("n_frames").cast("long").alias("n_frames"), F.round("quality", 6).alias("quality"), "passed", "error")
