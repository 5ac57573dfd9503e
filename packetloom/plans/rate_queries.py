"""Queries that decide rates, frame sizes, headers and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import header as h
from ..operators import rates as r
from ..sources import fixtures
from .base import PACKETS, RATES, query

_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_K = _KEYS.split(", ")


@query(f"""WITH {RATES}, b AS (SELECT *, CASE WHEN complexity = 0 THEN 60 * 48000 // frame + 48000 * channels WHEN complexity = 10 THEN 1500000 ELSE bitrate END AS asked FROM r)
SELECT {_KEYS}, bitrate * 6 // (288000 // frame) AS bits, (bitrate * 6 // (288000 // frame)) * (288000 // frame) // 6 AS back, CAST(least(asked, 1276 * 8 * (288000 // frame) // 6) AS BIGINT) AS effective,
  greatest(1, least((bitrate * 6 // (288000 // frame) + 4) // 8, 1276)) AS cbr_bytes FROM b""")
def bit_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a frame, the rate they give back, the effective rate and constant-rate bytes of every setting."""
    x = fixtures.rates(spark, sf_dir)
    frame, rate, bits = F.col("frame"), F.col("bitrate"), r.rate_to_bits(F.col("bitrate"), F.col("frame"))
    asked = F.when(F.col("complexity") == 0, F.lit(-1000).cast("long")).when(F.col("complexity") == 10, F.lit(-1).cast("long")).otherwise(rate)
    return x.select(*_K, bits.alias("bits"), r.bits_to_rate(bits, frame).alias("back"), r.effective_rate(asked, frame, F.col("channels"), 1276).alias("effective"), r.constant_bytes(rate, frame).alias("cbr_bytes"))


@query(f"""WITH {RATES}, a AS (SELECT *, 48000 // frame AS fps FROM r), b AS (SELECT *, CASE WHEN fps > 50 THEN bitrate - (40 * channels + 20) * (fps - 50) ELSE bitrate END AS e1 FROM a),
c AS (SELECT *, CASE WHEN vbr = 0 THEN e1 - trunc(e1 / 12.0)::BIGINT ELSE e1 END AS e2 FROM b), d AS (SELECT *, trunc(e2 * (90 + complexity) / 100.0)::BIGINT AS e3 FROM c),
e AS (SELECT *, CASE WHEN mode = 2 THEN CASE WHEN complexity < 5 THEN trunc(e3 * 9 / 10.0)::BIGINT ELSE e3 END ELSE CASE WHEN complexity < 2 THEN trunc(e3 * 4 / 5.0)::BIGINT ELSE e3 END END AS e4 FROM d)
SELECT {_KEYS}, CASE WHEN mode = 2 THEN e4 ELSE e4 - trunc(e4 * loss / (6 * loss + 10.0))::BIGINT END AS equivalent FROM e""")
def equivalent_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting's rate as that of 20 ms frames at full complexity with a variable rate."""
    cols = [F.col(c) for c in ("bitrate", "channels", "frame", "vbr", "mode", "complexity", "loss")]
    return fixtures.rates(spark, sf_dir).select(*_K, r.equivalent_rate(*cols).alias("equivalent"))


@query(f"""WITH {RATES}, a AS (SELECT *, 48000 // frame AS fps, CASE mode WHEN 0 THEN bitrate % 3 WHEN 1 THEN 3 + bitrate % 2 ELSE [0, 2, 3, 4][bitrate % 4 + 1] END AS bw, CASE WHEN frame IN (120, 240) THEN 2 WHEN mode = 1 AND frame > 960 THEN 2 WHEN mode = 2 AND frame > 960 THEN 0 ELSE mode END AS m FROM r),
p AS (SELECT *, CASE WHEN m = 0 THEN least(bw, 2) WHEN m = 1 THEN greatest(bw, 3) ELSE CASE WHEN bw = 1 THEN 2 ELSE bw END END AS b, CASE WHEN fps >= 400 THEN 0 WHEN fps >= 200 THEN 1 WHEN fps >= 100 THEN 2 WHEN fps >= 50 THEN 3 WHEN fps >= 25 THEN 4 ELSE 5 END AS period FROM a)
SELECT {_KEYS}, CAST((CASE m WHEN 0 THEN (b << 5) | ((period - 2) << 3) WHEN 2 THEN 128 | (greatest(b - 1, 0) << 5) | (period << 3) ELSE 96 | ((b - 3) << 4) | ((period - 2) << 3) END | CASE WHEN channels = 2 THEN 4 ELSE 0 END) & 255 AS BIGINT) AS toc FROM p""")
def generated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first byte that every setting's packets begin with, its mode made legal for its frame size."""
    x, frame, mode = fixtures.rates(spark, sf_dir), F.col("frame"), F.col("mode")
    bw = F.when(mode == 0, F.col("bitrate") % 3).when(mode == 1, 3 + F.col("bitrate") % 2).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 3, 4))), (F.col("bitrate") % 4 + 1).cast("int")).cast("long"))
    m = F.when(frame < 480, 2).when((mode == 1) & (frame > 960), 2).when((mode == 2) & (frame > 960), 0).otherwise(mode)
    b = F.when(m == 0, F.least(bw, F.lit(2).cast("long"))).when(m == 1, F.greatest(bw, F.lit(3).cast("long"))).otherwise(F.when(bw == 1, 2).otherwise(bw))
    return x.select(*_K, h.make_toc(m, F.call_function("div", F.lit(48000).cast("long"), frame), b, F.col("channels")).alias("toc"))


@query(f"""WITH {RATES}, a AS (SELECT *, l_orderkey % 10 AS choice FROM r), b AS (SELECT *, CASE WHEN choice = 0 THEN frame WHEN choice <= 5 THEN 120 << (choice - 1) ELSE (choice - 3) * 960 END AS size FROM a)
SELECT {_KEYS}, CAST(CASE WHEN frame < 120 OR size > frame OR size NOT IN (120, 240, 480, 960, 1920, 2880, 3840, 4800, 5760) THEN -1 ELSE size END AS BIGINT) AS frame_size FROM b""")
def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legal frame size for a wish and the samples at hand, or -1."""
    return fixtures.rates(spark, sf_dir).select(*_K, r.frame_size(F.col("frame"), F.col("l_orderkey") % 10).alias("frame_size"))


@query(f"""WITH {PACKETS}, d AS (SELECT stream_id, ts, event_id, CASE WHEN n_bytes > 700 THEN 2 WHEN n_bytes < 500 THEN 1 END AS sure FROM p)
SELECT stream_id, event_id, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS channels FROM d""")
def channel_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of every packet by its size against thresholds a step apart; between them the last decision stays."""
    rows = fixtures.packets(spark, sf_dir)
    return r.hysteresis(rows, "stream_id", ["ts", "event_id"], F.when(F.col("n_bytes") > 700, 2).when(F.col("n_bytes") < 500, 1), 2, "channels").select("stream_id", "event_id", "channels")


@query("""WITH e AS (SELECT user_id AS stream_id, ts, event_id, event_type = 'error' OR event_id % 2 = 0 AS silent FROM events), n AS (SELECT *, row_number() OVER w AS i, sum(CASE WHEN silent THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS island FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN silent THEN sum(CASE WHEN silent THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, island ORDER BY i) ELSE 0 END AS run FROM n)
SELECT stream_id, event_id, CAST(run AS BIGINT) AS run, run > 1 AND (run - 2) % 3 < 2 AS dropped FROM k""")
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length so far of every run of silent frames of 400 ms, and whether the frame need not be sent."""
    e = fixtures.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", ((F.col("event_type") == "error") | (F.col("event_id") % 2 == 0)).alias("silent"))
    runs = r.silence_runs(e, "stream_id", ["ts", "event_id"])
    return runs.select("stream_id", "event_id", "run", r.not_sent(F.col("run"), 400).alias("dropped"))


@query(f"""WITH {RATES}, e AS (SELECT *, 48000 // frame AS fps, l_partkey % 9 - 1 AS room, ['voice', 'music', 'auto'][l_orderkey % 3 + 1] AS signal, l_suppkey % 102 - 1 AS ratio, CASE WHEN l_partkey % 2 = 0 THEN 'voip' ELSE 'audio' END AS application, bitrate % 40000 AS r FROM r),
b AS (SELECT *, CASE signal WHEN 'voice' THEN 127 WHEN 'music' THEN 0 ELSE CASE WHEN ratio >= 0 THEN CASE WHEN application = 'audio' THEN least((ratio * 327) >> 8, 115) ELSE (ratio * 327) >> 8 END WHEN application = 'voip' THEN 115 ELSE 48 END END AS speech,
  CASE WHEN room <= 0 THEN 'bad argument' WHEN room = 1 AND frame * 10 = 48000 THEN 'buffer too small' END AS error FROM e)
SELECT l_orderkey, l_linenumber, CAST(speech AS BIGINT) AS speech, room < 3 OR r < 24 * fps OR (fps < 50 AND (room * fps < 300 OR r < 2400)) AS is_starved, error AS room_error,
  CAST(CASE WHEN r > 32000 THEN 16384 WHEN r < 16000 THEN 0 ELSE 16384 - (2048 * (32000 - r)) // (r - 14000) END AS BIGINT) AS width FROM b""")
def rate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much speech every setting stands for, whether its packets have room for more than a header, why they have none, and the stereo width its rate leaves."""
    t = fixtures.rates(spark, sf_dir)
    signal = F.element_at(F.array(*map(F.lit, ("voice", "music", "auto"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    application = F.when(F.col("l_partkey") % 2 == 0, "voip").otherwise("audio")
    room, low, fps = F.col("l_partkey") % 9 - 1, F.col("bitrate") % 40000, F.call_function("div", F.lit(48000).cast("long"), F.col("frame"))
    return t.select(
        "l_orderkey", "l_linenumber", r.speech_likelihood(signal, F.col("l_suppkey") % 102 - 1, application).alias("speech"), r.starved(room, low, fps).alias("is_starved"),
        r.room_error(F.col("frame"), room).alias("room_error"), r.stereo_width(low).alias("width"),
    )
