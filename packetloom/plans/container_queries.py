"""Queries over pages, positions, headers and records of the container formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..functions import header as h
from ..operators import container as c, ordered
from ..sources import files, fixtures, formats
from .base import HEADERS, PACKETS, query

ORDER = ["ts", "event_id"]


@query("SELECT doc_id, n, CAST(n // 255 + 1 AS BIGINT) AS n_segments, n % 255 AS last_segment, CAST((n // 255) // 255 + 1 AS BIGINT) AS n_pages FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)")
def packet_lacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and pages that every document takes as a packet of its own."""
    n, k = F.col("n"), c.segments(F.col("n"))
    found = fixtures.payloads(spark, sf_dir).withColumn("l", c.lacing(n))
    return found.select("doc_id", "n", F.size("l").cast("long").alias("n_segments"), F.element_at("l", -1).alias("last_segment"), (F.call_function("div", k - 1, F.lit(255).cast("long")) + 1).alias("n_pages"))


@query(f"""WITH {PACKETS}, s AS (SELECT *, n_bytes // 255 + 1 AS k, sum(n_bytes // 255 + 1) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS upto FROM p)
SELECT stream_id, event_id, CAST(k AS BIGINT) AS n_segments, CAST((upto - k) // 255 AS BIGINT) AS first_page, CAST((upto - 1) // 255 AS BIGINT) AS last_page, (upto - k) // 255 < (upto - 1) // 255 AS is_continued FROM s""")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, of 255 segments each, that every packet of a stream lies on."""
    k = c.segments(F.col("n_bytes"))
    rows = ordered.running(fixtures.packets(spark, sf_dir).withColumn("n_segments", k), "stream_id", ORDER, {"upto": F.col("n_segments")})
    page = lambda x: F.call_function("div", x, F.lit(255).cast("long"))
    first, last = page(F.col("upto") - F.col("n_segments")), page(F.col("upto") - 1)
    return rows.select("stream_id", "event_id", "n_segments", first.alias("first_page"), last.alias("last_page"), (first < last).alias("is_continued"))


@query(f"""WITH {PACKETS}, s AS (SELECT *, n_bytes // 255 + 1 AS k, sum(n_bytes // 255 + 1) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS upto FROM p),
g AS (SELECT stream_id, unnest(range(CAST(upto - k AS BIGINT), CAST(upto AS BIGINT))) AS no, unnest(list_transform(range(CAST(k AS BIGINT)), lambda i: CASE WHEN i < k - 1 THEN 255 ELSE n_bytes % 255 END)) AS size FROM s)
SELECT stream_id, CAST(no // 255 AS BIGINT) AS page, count(*) AS n_segments, CAST(sum(size) AS BIGINT) AS body, count(*) FILTER (size < 255) AS n_packets_end, no // 255 = 0 AS is_first FROM g GROUP BY ALL""")
def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every stream: segments, body bytes and packets that end on it."""
    rows = ordered.running(fixtures.packets(spark, sf_dir).withColumn("k", c.segments(F.col("n_bytes"))), "stream_id", ORDER, {"upto": F.col("k")})
    seg = rows.select("stream_id", F.posexplode(c.lacing(F.col("n_bytes"))).alias("i", "size"), (F.col("upto") - F.col("k")).alias("base"))
    page = F.call_function("div", F.col("base") + F.col("i"), F.lit(255).cast("long")).alias("page")
    out = seg.groupBy("stream_id", page).agg(F.count("*").alias("n_segments"), F.sum("size").alias("body"), F.count_if(F.col("size") < 255).alias("n_packets_end"))
    return out.withColumn("is_first", F.col("page") == 0)


@query(f"""WITH {PACKETS}, {HEADERS}, g AS (SELECT *, CAST(sum(spf) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS BIGINT) AS granule, CAST(sum(spf) OVER (PARTITION BY stream_id) AS BIGINT) AS total FROM h)
SELECT stream_id, event_id, granule, greatest(granule - 312, 0) - greatest(granule - spf - 312, 0) AS audible, granule = total AS is_last FROM g""")
def granule_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet's end position, its samples after the pre-skip, and whether it ends its stream."""
    p = fixtures.packets(spark, sf_dir).withColumn("spf", h.samples_per_frame(F.col("toc")))
    rows = ordered.running(p, "stream_id", ORDER, {"granule": F.col("spf")})
    totals = p.groupBy(F.col("stream_id").alias("_own")).agg(F.sum("spf").alias("total"))
    heard = lambda x: F.greatest(x - c.PRE_SKIP, F.lit(0).cast("long"))
    return rows.join(totals, F.col("stream_id").eqNullSafe(F.col("_own"))).select("stream_id", "event_id", "granule", (heard(F.col("granule")) - heard(F.col("granule") - F.col("spf"))).alias("audible"), (F.col("granule") == F.col("total")).alias("is_last"))


@query(f"WITH {PACKETS}, s AS (SELECT stream_id, count(*) AS source FROM p GROUP BY ALL) SELECT stream_id, source, greatest(1, (source + 312 + 959) // 960) AS n_frames, greatest(1, (source + 312 + 959) // 960) * 960 AS coded, greatest(1, (source + 312 + 959) // 960) * 960 - source - 312 AS trimmed FROM s")
def end_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 20 ms that a stream of one sample a row needs with its pre-skip, and what the end position trims."""
    s = fixtures.packets(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("source"))
    n = F.greatest(F.lit(1).cast("long"), F.call_function("div", F.col("source") + c.PRE_SKIP + 959, F.lit(960).cast("long")))
    return s.select("stream_id", "source", n.alias("n_frames"), (n * 960).alias("coded"), (n * 960 - F.col("source") - c.PRE_SKIP).alias("trimmed"))


@query(f"""WITH {PACKETS}, s AS (SELECT *, CAST(sum(8 + n_bytes) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS BIGINT) AS upto FROM p)
SELECT stream_id, event_id, upto - 8 - n_bytes AS record_at, upto - n_bytes AS payload_at, upto AS next_at FROM s""")
def record_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of every packet in a file of records with a length and a range word before each."""
    rows = ordered.running(fixtures.packets(spark, sf_dir), "stream_id", ORDER, {"next_at": 8 + F.col("n_bytes")})
    return rows.select("stream_id", "event_id", (F.col("next_at") - 8 - F.col("n_bytes")).alias("record_at"), (F.col("next_at") - F.col("n_bytes")).alias("payload_at"), "next_at")


_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b << 24 AS BIGINT), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda r, i: xor((r << 1) & 4294967295, CASE WHEN r & 2147483648 <> 0 THEN 79764919 ELSE 0 END)))"


@query(f"""WITH t AS (SELECT {_TABLE} AS t), u AS (SELECT page_id, regexp_extract_all(hex(encode(coalesce(html, ''))), '..') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS n_bytes, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(h, lambda x: CAST('0x' || x AS BIGINT))),
  lambda c, b: xor((c << 8) & 4294967295, t.t[xor(c >> 24, b) + 1])) AS crc FROM u, t""")
def page_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container's checksum of every page's whole html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return fixtures.table(spark, sf_dir, "pages").select("page_id", F.octet_length(html).cast("long").alias("n_bytes"), c.page_crc(html).alias("crc"))


_PAYLOADS = "p AS (SELECT coalesce(user_id, 4294967295) AS stream_id, ts, event_id, repeat(CAST(event_id AS VARCHAR) || ',', 1 + event_id % 300) AS payload FROM events)"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read back by ranges from files that hold every event's number, repeated, as a packet of its user's stream."""
    payload = F.encode(F.repeat(F.concat(F.col("event_id").cast("string"), F.lit(",")), (1 + F.col("event_id") % 300).cast("int")), "UTF-8")
    p = fixtures.table(spark, sf_dir, "events").select(F.coalesce("user_id", F.lit((1 << 32) - 1)).alias("stream_id"), "ts", "event_id", payload.alias("payload"))
    pages = files.pages(p, "stream_id", ORDER, "payload", "event_id", serial=F.col("stream"))
    formats.register(spark)
    folder = storage.scratch(spark)
    with storage.frugal(spark):
        pages.write.format("pages").option("compression", "zstd").mode("append").save(folder)
    return spark.read.format("pages").load(folder)


@query(f"""WITH {_PAYLOADS}, s AS (SELECT *, octet_length(encode(payload)) AS n, row_number() OVER w - 1 AS packet, sum(octet_length(encode(payload)) // 255 + 1) OVER w AS upto FROM p WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id))
SELECT stream_id AS serial, CAST(packet AS BIGINT) AS packet, last_value(event_id) OVER (PARTITION BY stream_id, (upto - 1) // 255 ORDER BY packet ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS granule, CAST(n AS BIGINT) AS n_bytes, sha256(payload) AS payload_sha256 FROM s""")
def container_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as pages by the sink, read by the source in ranges, and put together again."""
    found = files.packets_with_payloads(_written(spark, sf_dir), "offset")
    return found.select("serial", "packet", "granule", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("payload_sha256"))


@query("""WITH x AS (SELECT c_custkey, c_custkey % 9 AS kind, 1 + c_custkey % 2 AS ch, [8000, 12000, 16000, 24000, 48000][c_nationkey % 5 + 1] AS rate, c_custkey % 512 AS gain FROM customer),
e AS (SELECT *, CASE kind WHEN 1 THEN 'too short' WHEN 2 THEN 'bad magic' WHEN 3 THEN 'unsupported version' WHEN 4 THEN 'no channels' WHEN 5 THEN 'too many channels' WHEN 6 THEN 'mapping table truncated' END AS error, kind = 7 AS mapped FROM x)
SELECT c_custkey, error, CASE WHEN error IS NULL THEN CASE WHEN mapped THEN 3 ELSE ch END END AS channels, CASE WHEN error IS NULL THEN 312 END AS pre_skip, CASE WHEN error IS NULL THEN rate END AS rate, CASE WHEN error IS NULL THEN gain END AS gain,
  CASE WHEN error IS NULL THEN CASE WHEN mapped THEN 1 ELSE 0 END END AS family, CASE WHEN mapped THEN 2 END AS streams, CASE WHEN mapped THEN 1 END AS coupled, CASE WHEN mapped THEN '000102' END AS mapping FROM e""")
def parsed_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identification header for every customer, most of them spoiled in some way, parsed with the first failing check."""
    t, kind = fixtures.table(spark, sf_dir, "customer"), F.col("c_custkey") % 9
    rate = F.element_at(F.array(*map(F.lit, (8000, 12000, 16000, 24000, 48000))), F.col("c_nationkey") % 5 + 1)
    whole = c.head(1 + F.col("c_custkey") % 2, rate, F.col("c_custkey") % 512)
    put = lambda at, value: F.concat(F.substring(F.col("w"), 1, 2 * at), F.lit(value), F.substring(F.col("w"), 2 * at + 1 + len(value), 99))
    table = lambda tail: F.concat(F.substring(F.col("w"), 1, 18), F.lit("03"), F.substring(F.col("w"), 21, 16), F.lit("01" + tail))
    spoiled = (
        F.when(kind == 1, F.substring(F.col("w"), F.lit(1), (2 * (F.col("c_custkey") % 19)).cast("int"))).when(kind == 2, put(0, "6F")).when(kind == 3, put(8, "1F")).when(kind == 4, put(9, "00")).when(kind == 5, put(9, "03"))
        .when(kind == 6, table("02010001")).when(kind == 7, table("0201000102FFFF")).when(kind == 8, F.concat(F.col("w"), F.lit("ABCD"))).otherwise(F.col("w"))
    )
    x = t.withColumn("w", whole).select("c_custkey", c.parse_head(F.unhex(spoiled)).alias("x"))
    return x.select("c_custkey", *(f"x.{n}" for n in ("error", "channels", "pre_skip", "rate", "gain", "family", "streams", "coupled")), F.hex("x.mapping").alias("mapping"))


@query("""WITH x AS (SELECT p_partkey, 'TITLE=' || p_name AS a, 'GENRE=' || p_type AS b FROM part),
n AS (SELECT *, octet_length(encode(a)) AS na, octet_length(encode(b)) AS nb FROM x), l AS (SELECT *, p_partkey * 7 % (44 + na + nb) AS cut FROM n),
e AS (SELECT *, CASE WHEN cut < 12 THEN 'too short' WHEN cut < 22 THEN 'vendor overruns packet' WHEN cut < 26 THEN 'missing comment count' WHEN cut < 30 THEN 'comment 0 length truncated' WHEN cut < 30 + na THEN 'comment 0 overruns packet'
  WHEN cut < 34 + na THEN 'comment 1 length truncated' WHEN cut < 34 + na + nb THEN 'comment 1 overruns packet' END AS error FROM l)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN 'packetloom' END AS vendor, CASE WHEN error IS NULL THEN a || '|' || b END AS comments FROM e""")
def parsed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment header for every part, cut off at some byte, parsed with the first length that overruns it."""
    comments = F.array(F.concat(F.lit("TITLE="), "p_name"), F.concat(F.lit("GENRE="), "p_type"))
    made = fixtures.table(spark, sf_dir, "part").select("p_partkey", F.unhex(c.tags(F.lit("packetloom"), comments)).alias("d"))
    end = (F.col("p_partkey") * 7 % (F.octet_length("d") + 10)).cast("int")
    x = made.select("p_partkey", c.parse_tags(F.substring(F.col("d"), F.lit(1), end)).alias("x"))
    text = F.array_join(F.transform("x.comments", lambda b: F.decode(b, "UTF-8")), "|")
    return x.select("p_partkey", "x.error", F.decode("x.vendor", "UTF-8").alias("vendor"), text.alias("comments"))


@query("""WITH x AS (SELECT c_custkey, 1 + c_custkey % 2 AS ch, [8000, 12000, 16000, 24000, 48000][c_nationkey % 5 + 1] AS rate, c_custkey % 512 AS gain FROM customer)
SELECT c_custkey, '4F70757348656164' || '01' || printf('%02X', CAST(ch AS INTEGER)) || '3801' || printf('%02X%02X%02X%02X', rate & 255, (rate >> 8) & 255, (rate >> 16) & 255, (rate >> 24) & 255) || printf('%02X%02X', CAST(gain & 255 AS INTEGER), CAST(gain >> 8 AS INTEGER)) || '00' AS head, ch AS channels, CAST(rate AS BIGINT) AS rate, gain, CAST(312 AS BIGINT) AS pre_skip FROM x""")
def identification_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identification header for every customer, and its fields read back."""
    t = fixtures.table(spark, sf_dir, "customer")
    rate = F.element_at(F.array(*map(F.lit, (8000, 12000, 16000, 24000, 48000))), F.col("c_nationkey") % 5 + 1)
    made = t.select("c_custkey", c.head(1 + F.col("c_custkey") % 2, rate, F.col("c_custkey") % 512).alias("head"))
    x = F.col("head")
    return made.select("c_custkey", "head", c.number(x, 9, 1).alias("channels"), c.number(x, 12, 4).alias("rate"), c.number(x, 16, 2).alias("gain"), c.number(x, 10, 2).alias("pre_skip"))


@query("""WITH x AS (SELECT p_partkey, hex(encode('packetloom')) AS v, ['TITLE=' || p_name, 'GENRE=' || p_type] AS t FROM part),
le AS (SELECT *, list_transform(t, lambda s: printf('%02X%02X0000', CAST(octet_length(encode(s)) & 255 AS INTEGER), CAST(octet_length(encode(s)) >> 8 AS INTEGER)) || hex(encode(s))) AS l FROM x)
SELECT p_partkey, '4F70757354616773' || '0A000000' || v || '02000000' || l[1] || l[2] AS tags FROM le""")
def comment_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment header for every part."""
    t = fixtures.table(spark, sf_dir, "part")
    comments = F.array(F.concat(F.lit("TITLE="), "p_name"), F.concat(F.lit("GENRE="), "p_type"))
    return t.select("p_partkey", c.tags(F.lit("packetloom"), comments).alias("tags"))


@query("""WITH x AS (SELECT o_orderkey, 1 + o_custkey % 3 AS ch, [8000, 11025, 16000, 44100, 48000][o_orderkey % 5 + 1] AS rate, o_orderkey % 60 AS ms, o_custkey % 13 AS complexity, o_orderkey % 120 AS loss, o_custkey % 30 AS depth FROM orders)
SELECT o_orderkey, CASE WHEN rate NOT IN (8000, 12000, 16000, 24000, 48000) THEN 'invalid_rate' WHEN ch NOT IN (1, 2) THEN 'invalid_channels' WHEN CASE WHEN ms = 0 THEN 20 ELSE ms END NOT IN (20, 40, 60, 80, 100, 120) THEN 'invalid_frame_duration'
  WHEN complexity > 10 THEN 'invalid_complexity' WHEN loss > 100 THEN 'invalid_loss' WHEN depth < 8 OR depth > 24 THEN 'invalid_depth' END AS error_code,
  CAST(greatest(500, least(750000 * ch, CAST(trunc(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT))) AS BIGINT) AS bitrate, rate // 400 + rate // 250 AS lookahead FROM x JOIN orders USING (o_orderkey)""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of every configuration, its clamped bit rate and its delay."""
    ch, ms = 1 + F.col("o_custkey") % 3, F.col("o_orderkey") % 60
    rate = F.element_at(F.array(*map(F.lit, (8000, 11025, 16000, 44100, 48000))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    error = (
        F.when(~rate.isin(8000, 12000, 16000, 24000, 48000), "invalid_rate").when(~ch.isin(1, 2), "invalid_channels")
        .when(~F.coalesce(F.nullif(ms, F.lit(0)), F.lit(20)).isin(20, 40, 60, 80, 100, 120), "invalid_frame_duration").when(F.col("o_custkey") % 13 > 10, "invalid_complexity")
        .when(F.col("o_orderkey") % 120 > 100, "invalid_loss").when(~(F.col("o_custkey") % 30).between(8, 24), "invalid_depth")
    )
    bitrate = F.greatest(F.lit(500).cast("long"), F.least(750000 * ch, F.col("o_totalprice").cast("decimal(18,2)").cast("long")))
    delay = F.call_function("div", rate, F.lit(400)) + F.call_function("div", rate, F.lit(250))
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", error.alias("error_code"), bitrate.alias("bitrate"), delay.alias("lookahead"))
