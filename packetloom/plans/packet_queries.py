"""Queries over packet headers, parsing, re-framing and their census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import header as h
from ..operators import ordered, packets as pk
from ..sources import fixtures
from .base import HEADERS, PACKETS, query


@query(f"WITH {PACKETS}, {HEADERS} SELECT event_id, toc >> 3 AS config, mode, bw AS bandwidth_rank, ['NB','MB','WB','SWB','FB'][bw + 1] AS bandwidth, spf AS samples, spf * 125 // 6 AS duration_us, CAST(spf * 125 // 6 // 1000 AS VARCHAR) || CASE WHEN spf * 125 // 6 % 1000 <> 0 THEN '.' || CAST(spf * 125 // 6 % 1000 // 100 AS VARCHAR) ELSE '' END || 'ms' AS duration, ch AS channels, toc & 3 AS code FROM h")
def packet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of every packet's first byte."""
    toc = F.col("toc")
    return fixtures.packets(spark, sf_dir).select(
        "event_id", h.config(toc).alias("config"), h.mode(toc).alias("mode"), h.bandwidth_rank(toc).alias("bandwidth_rank"), h.bandwidth(toc).alias("bandwidth"),
        h.samples_per_frame(toc).alias("samples"), h.duration_us(toc).alias("duration_us"), h.duration_text(h.duration_us(toc)).alias("duration"), h.channels(toc).alias("channels"), toc.bitwiseAND(3).alias("code"),
    )


@query(f"WITH {PACKETS}, {HEADERS} SELECT event_id, frames, CASE WHEN frames * spf <= 5760 THEN frames * spf END AS samples, CASE WHEN frames * (spf // 3) * 25 <= 16000 * 3 THEN frames * (spf // 3) END AS samples_16k, CASE WHEN frames * spf > 5760 OR frames = 0 THEN 'invalid_packet' END AS error_code FROM h")
def packet_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame counts and durations by the header, at two rates; packets over 120 ms or without frames are errors."""
    toc, b1 = F.col("toc"), F.col("b1")
    n, all_ = h.frame_count(toc, b1), h.frame_count(toc, b1) * h.samples_per_frame(toc)
    return fixtures.packets(spark, sf_dir).select(
        "event_id", n.alias("frames"), h.packet_samples(toc, b1).alias("samples"), h.packet_samples(toc, b1, 16000).alias("samples_16k"), F.when((all_ > 5760) | (n == 0), "invalid_packet").alias("error_code")
    )


@query(f"WITH {PACKETS} SELECT event_id, CASE WHEN n_bytes < 252 THEN CAST(n_bytes AS VARCHAR) ELSE CAST(252 + (n_bytes & 3) AS VARCHAR) || ',' || CAST((n_bytes - 252 - (n_bytes & 3)) >> 2 AS VARCHAR) END AS field, n_bytes AS size FROM p")
def size_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every length as its one- or two-byte field, and read back."""
    field = h.size_bytes(F.col("n_bytes"))
    return fixtures.packets(spark, sf_dir).select("event_id", F.array_join(field.cast("array<string>"), ",").alias("field"), h.size_of(field).alias("size"))


#: Every packet of PACKETS parsed: b holds its bytes, r its frames, the last one's length, what is read (z) and whether it is bad.
_PARSED = f"""WITH {PACKETS}, {HEADERS},
b AS (SELECT *, list_transform(range(n_bytes), lambda i: CASE i WHEN 0 THEN toc WHEN 1 THEN b1 ELSE (event_id * 7 + i * 31) % 256 END) AS d FROM h),
-- padding: leading 255s, then one byte
q AS (SELECT *, toc & 3 AS code, (toc & 3 = 3 AND n_bytes >= 2 AND b1 & 64 <> 0) AS padded, len(list_filter(range(2, n_bytes), lambda i: d[i + 1] <> 255)) AS others, list_filter(range(2, n_bytes), lambda i: d[i + 1] <> 255)[1] AS stop FROM b),
w AS (SELECT *, CASE WHEN code <> 3 THEN 1 WHEN NOT padded THEN 2 ELSE stop + 1 END AS at0,
  CASE WHEN code <> 3 THEN n_bytes - 1 WHEN NOT padded THEN n_bytes - 2 ELSE n_bytes - 2 - (stop - 2) * 255 - 1 - d[stop + 1] END AS left0,
  (code = 3 AND (n_bytes < 2 OR frames = 0 OR frames * spf > 5760)) OR (padded AND others = 0) AS bad0 FROM q),
f AS (SELECT *, CASE WHEN code = 2 THEN 1 WHEN code = 3 AND b1 & 128 <> 0 AND NOT bad0 THEN greatest(frames - 1, 0) ELSE 0 END AS k FROM w),
s AS (SELECT event_id, list_reduce(list_prepend({{'at': at0, 'left': left0, 'sum': CAST(0 AS BIGINT), 'bad': bad0 OR left0 < 0, 'v': CAST([] AS BIGINT[])}},
    list_transform(range(k), lambda i: {{'at': at0, 'left': left0, 'sum': CAST(0 AS BIGINT), 'bad': FALSE, 'v': CAST([] AS BIGINT[])}})),
    lambda a, _: {{'at': a.at + CASE WHEN d[a.at + 1] >= 252 THEN 2 ELSE 1 END, 'left': a.left - CASE WHEN d[a.at + 1] >= 252 THEN 2 ELSE 1 END,
      'sum': a.sum + coalesce(CASE WHEN d[a.at + 1] >= 252 THEN 4 * d[a.at + 2] + d[a.at + 1] ELSE d[a.at + 1] END, 0),
      'bad': a.bad OR coalesce(a.left < CASE WHEN d[a.at + 1] >= 252 THEN 2 ELSE 1 END OR (CASE WHEN d[a.at + 1] >= 252 THEN 4 * d[a.at + 2] + d[a.at + 1] ELSE d[a.at + 1] END) > a.left - CASE WHEN d[a.at + 1] >= 252 THEN 2 ELSE 1 END, TRUE),
      'v': list_append(a.v, CAST(coalesce(CASE WHEN d[a.at + 1] >= 252 THEN 4 * d[a.at + 2] + d[a.at + 1] ELSE d[a.at + 1] END, 0) AS BIGINT))}}) AS z FROM f),
e AS (SELECT f.event_id, f.frames, f.code, z, CASE WHEN f.code = 1 OR (f.code = 3 AND f.b1 & 128 = 0) THEN z.left // greatest(f.frames, 1) ELSE z.left - z.sum END AS last,
  (f.code = 1 OR (f.code = 3 AND f.b1 & 128 = 0)) AS even, f.n_bytes FROM f JOIN s USING (event_id)),
r AS (SELECT *, z.bad OR z.left - z.sum < 0 OR (even AND z.left % greatest(frames, 1) <> 0) OR last > 1275 AS bad FROM e)"""


@query(f"""{_PARSED} SELECT event_id, CASE WHEN bad THEN 'invalid' END AS error, CASE WHEN NOT bad THEN CAST(frames AS BIGINT) END AS n_frames, CASE WHEN NOT bad THEN CAST(last AS BIGINT) END AS last_size, CASE WHEN NOT bad THEN CAST(n_bytes - z.at - z.left AS BIGINT) END AS padding FROM r""")
def packet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full parse of every packet: frames, last frame, padding, or why it is invalid."""
    made = fixtures.packet_bytes(fixtures.packets(spark, sf_dir)).select("event_id", pk.parse(F.col("data")).alias("x"))
    good = F.col("x.error").isNull()
    return made.select("event_id", F.col("x.error").alias("error"), F.when(good, F.size("x.sizes").cast("long")).alias("n_frames"), F.element_at("x.sizes", -1).alias("last_size"), F.when(good, F.col("x.padding")).alias("padding"))


#: Every valid packet's frames: their lengths (sizes), where each begins after the first (starts), and the bytes of the packet (d).
_FRAMES = f"""{_PARSED},
g0 AS (SELECT event_id, frames AS n, z.at AS off, CASE WHEN even THEN list_transform(range(frames), lambda i: CAST(last AS BIGINT)) ELSE list_append(z.v, CAST(last AS BIGINT)) END AS sizes FROM r WHERE NOT bad),
g AS (SELECT g0.*, b.d, b.toc, list_transform(range(n), lambda i: CAST(coalesce(list_sum(sizes[1 : i]), 0) AS BIGINT)) AS starts FROM g0 JOIN b USING (event_id)),
x AS (SELECT *, list_transform(range(n), lambda i: array_to_string(list_transform(list_slice(d, off + starts[i + 1] + 1, off + starts[i + 1] + sizes[i + 1]), lambda v: printf('%02X', CAST(v AS INTEGER))), '')) AS h FROM g)"""


@query(f"{_FRAMES} SELECT event_id, CAST(n AS BIGINT) AS n_frames, md5(array_to_string(h, '|')) AS frames_md5 FROM x")
def packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid packet's frames cut out: how many there are, and a digest of all their bytes in hex, one frame after the other."""
    made = fixtures.packet_bytes(fixtures.packets(spark, sf_dir)).withColumn("x", pk.parse(F.col("data"))).where("x.error is null")
    cut = made.select("event_id", pk.frames(F.col("data"), F.col("x")).alias("f"))
    return cut.select("event_id", F.size("f").cast("long").alias("n_frames"), F.md5(F.array_join(F.transform("f", lambda b: F.hex(b)), "|").cast("binary")).alias("frames_md5"))


_FIELD = "CASE WHEN {0} < 252 THEN printf('%02X', CAST({0} AS INTEGER)) ELSE printf('%02X%02X', CAST(252 + ({0} & 3) AS INTEGER), CAST(({0} - 252 - ({0} & 3)) >> 2 AS INTEGER)) END"


@query(f"""{_FRAMES},
c AS (SELECT event_id, toc, event_id % n AS b, event_id % n + 1 + event_id // 7 % (n - event_id % n) AS e, event_id % 3 = 0 AS pad, event_id % 5 = 0 AS own, 1200 + event_id % 400 AS most, sizes, h FROM x),
l AS (SELECT event_id, toc, pad, own, most, e - b AS n, sizes[b + 1 : e] AS s, h[b + 1 : e] AS h FROM c),
m AS (SELECT *, len(list_distinct(s)) = 1 AS same, CAST(list_sum(s) AS BIGINT) AS total, s[n] AS last, array_to_string(list_transform(s[1 : n - 1], lambda v: {_FIELD.format('v')}), '') AS fields FROM l),
o AS (SELECT *, CASE WHEN own THEN {_FIELD.format('last')} ELSE '' END AS tail FROM m),
w2 AS (SELECT *, CASE WHEN n = 1 OR same THEN 1 ELSE 1 + len(fields) // 2 END + total + len(tail) // 2 AS short, 2 + CASE WHEN same THEN 0 ELSE len(fields) // 2 END + total + len(tail) // 2 AS listed FROM o),
k AS (SELECT *, n > 2 OR (pad AND short < most) AS counted FROM w2),
p2 AS (SELECT *, CASE WHEN counted AND pad THEN greatest(most - listed, 0) ELSE 0 END AS filled FROM k),
q2 AS (SELECT *, CASE WHEN filled > 0 THEN (filled - 1) // 255 ELSE 0 END AS f255, CASE WHEN counted THEN listed ELSE short END > most AS small FROM p2),
y AS (SELECT event_id, small, printf('%02X', CAST((toc & 252) + CASE WHEN counted THEN 3 WHEN n = 1 THEN 0 WHEN same THEN 1 ELSE 2 END AS INTEGER))
  || CASE WHEN counted THEN printf('%02X', CAST(n + CASE WHEN same THEN 0 ELSE 128 END + CASE WHEN filled > 0 THEN 64 ELSE 0 END AS INTEGER)) ELSE '' END
  || CASE WHEN filled > 0 THEN repeat('FF', CAST(f255 AS BIGINT)) || printf('%02X', CAST(filled - 255 * f255 - 1 AS INTEGER)) ELSE '' END
  || CASE WHEN NOT same THEN fields ELSE '' END || tail || array_to_string(h, '') || CASE WHEN filled > 0 THEN repeat('00', CAST(filled - f255 - 1 AS BIGINT)) ELSE '' END AS hex FROM q2)
SELECT event_id, CASE WHEN small THEN 'too small' END AS error, CASE WHEN NOT small THEN CAST(len(hex) // 2 AS BIGINT) END AS n_bytes, CASE WHEN NOT small THEN md5(hex) END AS data_md5 FROM y""")
def packet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of every valid packet's frames written as a packet of its own: some filled up with padding, some self-delimited, some too long for their place."""
    i = F.col("event_id")
    made = fixtures.packet_bytes(fixtures.packets(spark, sf_dir)).withColumn("x", pk.parse(F.col("data"))).where("x.error is null")
    cut = made.withColumn("f", pk.frames(F.col("data"), F.col("x"))).withColumn("n", F.size("f")).withColumn("b", (i % F.col("n")).cast("int"))
    end = F.col("b") + 1 + (F.call_function("div", i, F.lit(7).cast("long")) % (F.col("n") - F.col("b"))).cast("int")
    out = cut.select("event_id", pk.emit(F.col("toc"), F.col("f"), F.col("b"), end, most=1200 + i % 400, pad=i % 3 == 0, self_delimited=i % 5 == 0).alias("y"))
    return out.select("event_id", F.col("y.error").alias("error"), F.octet_length("y.data").cast("long").alias("n_bytes"), F.md5(F.hex("y.data").cast("binary")).alias("data_md5"))


@query(f"""WITH {PACKETS}, {HEADERS} SELECT mode, bw AS bandwidth_rank, ch AS channels, CAST(grouping(mode) * 4 + grouping(bw) * 2 + grouping(ch) AS BIGINT) AS level, count(*) AS n_packets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(frames) AS BIGINT) AS n_frames,
  CAST(sum(CASE WHEN frames * spf <= 5760 THEN frames * spf END) AS BIGINT) AS n_samples FROM h GROUP BY CUBE (mode, bw, ch)""")
def census_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet census over all subsets of mode, bandwidth and channels; level has a bit for each that is summed over."""
    toc, b1 = F.col("toc"), F.col("b1")
    rows = fixtures.packets(spark, sf_dir).select(
        h.mode(toc).alias("mode"), h.bandwidth_rank(toc).alias("bandwidth_rank"), h.channels(toc).alias("channels"), "n_bytes", h.frame_count(toc, b1).alias("frames"), h.packet_samples(toc, b1).alias("samples")
    )
    return rows.cube("mode", "bandwidth_rank", "channels").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_packets"), F.sum("n_bytes").alias("n_bytes"), F.sum("frames").alias("n_frames"), F.sum("samples").alias("n_samples")
    )


@query(f"""WITH {PACKETS}, {HEADERS}, c AS (SELECT stream_id, event_id, ts, 252 & toc AS t, n_bytes, spf FROM h),
a AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(t) OVER w = t THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY n) AS run FROM a),
g AS (SELECT *, (row_number() OVER (PARTITION BY stream_id, run ORDER BY n) - 1) // greatest(1, 5760 // spf) AS packet FROM b),
m AS (SELECT stream_id, run, packet, min(n) AS first, min(t) AS toc, list(n_bytes ORDER BY n) AS sizes FROM g GROUP BY ALL),
k AS (SELECT *, len(sizes) AS n_frames, len(list_distinct(sizes)) = 1 AS same, CAST(list_sum(list_transform(sizes[:-2], lambda x: CASE WHEN x < 252 THEN 1 ELSE 2 END)) AS BIGINT) AS fields, CAST(list_sum(sizes) AS BIGINT) AS total FROM m),
o AS (SELECT *, CASE WHEN n_frames = 1 THEN 0 WHEN n_frames = 2 AND same THEN 1 WHEN n_frames = 2 THEN 2 ELSE 3 END AS code FROM k)
SELECT stream_id, first, toc, n_frames, code, CASE WHEN code <= 1 THEN 1 WHEN code = 2 THEN 1 + fields WHEN same THEN 2 ELSE 2 + fields END AS header, total + CASE WHEN code <= 1 THEN 1 WHEN code = 2 THEN 1 + fields WHEN same THEN 2 ELSE 2 + fields END AS total FROM o""")
def repacketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's frames regrouped into packets of up to 120 ms with one header, by the shortest framing."""
    p = fixtures.packets(spark, sf_dir)
    frames = p.select("stream_id", "ts", "event_id", F.col("toc").bitwiseAND(252).alias("toc"), F.col("n_bytes").alias("size"), h.samples_per_frame(F.col("toc")).alias("samples"))
    return pk.regroup(frames, "stream_id", ["ts", "event_id"])


@query(f"WITH {PACKETS}, d AS (SELECT event_id, n_bytes, 1500 - n_bytes AS pad FROM p) SELECT event_id, pad, (pad - 1) // 255 AS full_bytes, pad - 255 * ((pad - 1) // 255) - 1 AS last_byte, n_bytes + pad AS padded FROM d")
def packet_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padding fields that grow every packet to 1500 bytes."""
    pad = 1500 - F.col("n_bytes")
    x = pk.padding_fields(pad)
    return fixtures.packets(spark, sf_dir).select("event_id", pad.alias("pad"), x["full"].alias("full_bytes"), x["last"].alias("last_byte"), (F.col("n_bytes") + pad).alias("padded"))


@query(f"WITH {PACKETS}, {HEADERS} SELECT mode, bw AS bandwidth_rank, spf AS samples, ch AS channels, count(*) AS n_packets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, max(n_bytes) AS largest, CAST(sum(frames) AS BIGINT) AS n_frames, CAST(sum(CASE WHEN frames * spf <= 5760 THEN frames * spf END) AS BIGINT) AS n_samples, count(*) FILTER (toc & 3 = 3) AS n_code3 FROM h GROUP BY ALL")
def packet_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, bytes, frames and samples by mode, bandwidth, frame size and channels."""
    toc, b1 = F.col("toc"), F.col("b1")
    keys = [h.mode(toc).alias("mode"), h.bandwidth_rank(toc).alias("bandwidth_rank"), h.samples_per_frame(toc).alias("samples"), h.channels(toc).alias("channels")]
    return fixtures.packets(spark, sf_dir).groupBy(*keys).agg(
        F.count("*").alias("n_packets"), F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("largest"), F.sum(h.frame_count(toc, b1)).alias("n_frames"),
        F.sum(h.packet_samples(toc, b1)).alias("n_samples"), F.count_if(toc.bitwiseAND(3) == 3).alias("n_code3"),
    )


@query(f"WITH {PACKETS}, {HEADERS}, c AS (SELECT toc >> 3 AS config, mode, count(*) AS n FROM h GROUP BY ALL) SELECT config, mode, n, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS percent FROM c")
def config_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each configuration; the total is that of at most 32 counted rows."""
    c = fixtures.packets(spark, sf_dir).groupBy(h.config(F.col("toc")).alias("config"), h.mode(F.col("toc")).alias("mode")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query(f"WITH {PACKETS}, {HEADERS}, l AS (SELECT mode, lag(mode) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS before FROM h) SELECT before AS mode_before, mode AS mode_after, count(*) AS n FROM l WHERE before <> mode GROUP BY ALL")
def mode_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often streams change from one mode to another."""
    p = fixtures.packets(spark, sf_dir).withColumn("mode", h.mode(F.col("toc")))
    found = ordered.previous(p.select("stream_id", "ts", "event_id", "mode"), "stream_id", ["ts", "event_id"], {"mode_before": "mode"})
    return found.where("mode_before <> mode").groupBy("mode_before", F.col("mode").alias("mode_after")).agg(F.count("*").alias("n"))


@query(f"WITH {PACKETS}, {HEADERS} SELECT stream_id, count(*) AS n_packets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(spf) AS BIGINT) AS n_samples, CAST(sum(n_bytes) * 8 * 48000 // sum(spf) AS BIGINT) AS bits_per_second FROM h GROUP BY stream_id")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, samples and mean bit rate of every stream."""
    found = fixtures.packets(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n_packets"), F.sum("n_bytes").alias("n_bytes"), F.sum(h.samples_per_frame(F.col("toc"))).alias("n_samples"))
    return found.withColumn("bits_per_second", F.call_function("div", F.col("n_bytes") * 8 * 48000, F.col("n_samples")))
