"""Queries over samples, band vectors and fixed-point primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed as fx
from ..operators import coding, ordered, signal as sg
from ..sources import files, fixtures
from .base import BANDS, SAMPLES, query


@query(f"""WITH {SAMPLES}, a AS (SELECT event_id, x, CAST(event_id * 2654435761 % 4294967296 - 2147483648 AS BIGINT) AS w FROM x)
SELECT event_id, CASE WHEN w >= 0 THEN w // 128 ELSE -((-w + 127) // 128) END AS shr7, CASE WHEN w + 64 >= 0 THEN (w + 64) // 128 ELSE -((-(w + 64) + 127) // 128) END AS pshr7,
  CAST((w * 3 % 4294967296 + 4294967296 + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS wrap3, greatest(-32768, least(32767, w)) AS sat16, greatest(-2147483648, least(2147483647, w * 2)) AS sat32,
  CAST(floor(x * x / 32768.0) AS BIGINT) AS q15, CAST(floor((x * 12345 + 16384) / 32768.0) AS BIGINT) AS p15, CAST(trunc(w / 7::DECIMAL(20,0)) AS BIGINT) AS div7 FROM a""")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts, wrapping, saturation and products of every sample and a scrambled word."""
    w = F.col("event_id") * 2654435761 % 4294967296 - 2147483648
    rows = fixtures.samples(spark, sf_dir).withColumn("w", w)
    w, x = F.col("w"), F.col("x")
    return rows.select(
        "event_id", F.shiftright(w, 7).alias("shr7"), fx.round_shift(w, 7).alias("pshr7"), fx.wrap(w * 3).alias("wrap3"), fx.sat16(w).alias("sat16"), fx.sat32(w * 2).alias("sat32"),
        fx.mul_shift(x, x, 15).alias("q15"), fx.mul_shift(x, F.lit(12345), 15, rounded=True).alias("p15"), fx.idiv(w, 7).alias("div7"),
    )


@query("""WITH a AS (SELECT event_id, CAST(event_id * 2654435761 % 4294967296 AS BIGINT) AS u FROM events), b AS (SELECT *, CASE WHEN u = 0 THEN 0 ELSE length(bin(u)) END AS bits FROM a)
SELECT event_id, CAST(bits AS BIGINT) AS bits, CAST(32 - bits AS BIGINT) AS clz, CAST(floor(sqrt(u)) AS BIGINT) AS root, CAST((((u >> 5) | ((u & 31) << 27)) + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS ror5,
  CAST((((CAST(u AS HUGEINT) * 196314165 + 907633515) % 4294967296) + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS next_random, greatest(-100, least(100, u % 301 - 150)) AS limited FROM b""")
def integer_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit lengths, roots, rotations, random steps and limits of scrambled words."""
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("u"))
    u = F.col("u")
    return rows.select(
        "event_id", fx.bit_length(u).alias("bits"), fx.leading_zeros32(u).alias("clz"), fx.isqrt(u).alias("root"), fx.rotate_right32(u, 5).alias("ror5"), fx.random_step(u).alias("next_random"),
        fx.limit(u % 301 - 150, F.lit(100).cast("long"), F.lit(-100).cast("long")).alias("limited"),
    )


@query(f"""WITH {BANDS}, h AS (SELECT *, list_transform(range(len(x) // 2), lambda i: CAST(floor((x[2*i+1] * 23170 + 16384) / 32768.0) AS BIGINT)) AS a, list_transform(range(len(x) // 2), lambda i: CAST(floor((x[2*i+2] * 23170 + 16384) / 32768.0) AS BIGINT)) AS b FROM v)
SELECT vec_id, CAST(list_sum(list_transform(x, lambda e: e * e)) AS BIGINT) AS energy, CAST(list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])) AS BIGINT) AS lag1, CAST(list_sum(list_transform(x, lambda e: abs(e))) AS BIGINT) AS l1,
  list_max(list_transform(x, lambda e: abs(e))) AS peak, CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] + b[i]))) AS BIGINT) + CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) AS BIGINT) AS haar_l1 FROM h""")
def band_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy, correlation, magnitudes and the Haar transform's magnitude of every band vector."""
    x = F.col("x")
    return fixtures.bands(spark, sf_dir).select("vec_id", sg.inner(x, x).alias("energy"), sg.autocorrelation(x, 1).alias("lag1"), sg.l1(x).alias("l1"), sg.peak(x).alias("peak"), sg.l1(sg.haar(x)).alias("haar_l1"))


@query(f"""WITH {BANDS}, e AS (SELECT vec_id, unnest(x) AS m, unnest(range(len(x))) AS j FROM v),
w AS (SELECT vec_id, j, greatest(max(m + 200 * j) OVER (PARTITION BY vec_id ORDER BY j) - 200 * j, max(m - 300 * j) OVER (PARTITION BY vec_id ORDER BY j DESC) + 300 * j) AS k, m FROM e)
SELECT vec_id, CAST(sum(k) AS BIGINT) AS masking, count(*) FILTER (k > m) AS n_masked, max(k - m) AS deepest FROM w GROUP BY vec_id""")
def masking_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far and where every band vector is masked by its neighbours."""
    rows = fixtures.bands(spark, sf_dir).withColumn("m", sg.masking(F.col("x"), 200, 300))
    gap = F.zip_with("m", "x", lambda a, b: a - b)
    return rows.select("vec_id", sg.total(F.col("m")).alias("masking"), F.size(F.filter(gap, lambda g: g > 0)).cast("long").alias("n_masked"), F.array_max(gap).alias("deepest"))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) - 1) // 8 AS frame FROM x)
SELECT stream_id, CAST(frame AS BIGINT) AS frame, count(*) AS n, max(abs(x)) AS peak, max(abs(x)) = 0 AS is_silent, CAST(sum(x * x) // count(*) AS BIGINT) AS energy FROM n GROUP BY ALL""")
def frame_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, silence and mean energy of every stream's frames of eight samples."""
    rows = ordered.running(fixtures.samples(spark, sf_dir), "stream_id", ["ts", "event_id"], {"i": F.lit(1)})
    frame = F.call_function("div", F.col("i") - 1, F.lit(8).cast("long")).alias("frame")
    out = rows.groupBy("stream_id", frame).agg(F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("s"))
    return out.select("stream_id", "frame", "n", "peak", (F.col("peak") == 0).alias("is_silent"), F.call_function("div", F.col("s"), F.col("n")).alias("energy"))


@query(f"WITH {SAMPLES} SELECT stream_id, event_id, x + coalesce(lag(x) OVER (PARTITION BY stream_id ORDER BY ts, event_id), 0) AS averaged FROM x")
def frame_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample plus its stream's original sample before it."""
    rows = ordered.previous(fixtures.samples(spark, sf_dir), "stream_id", ["ts", "event_id"], {"before": "x"})
    return rows.select("stream_id", "event_id", (F.col("x") + F.coalesce("before", F.lit(0))).alias("averaged"))


@query("""WITH r AS (SELECT unnest([8000, 12000, 16000, 24000, 48000]) AS hz), x AS (SELECT o_orderkey, [8000, 12000, 16000, 24000, 48000][o_orderkey % 5 + 1] AS a, [8000, 12000, 16000, 24000, 48000][o_custkey % 5 + 1] AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = b THEN 'copy' WHEN b = 2 * a THEN 'up2' WHEN b > a THEN 'up_fir' WHEN 4 * b = 3 * a THEN 'down_3_4' WHEN 3 * b = 2 * a THEN 'down_2_3' WHEN 2 * b = a THEN 'down_1_2' WHEN 3 * b = a THEN 'down_1_3' WHEN 4 * b = a THEN 'down_1_4' WHEN 6 * b = a THEN 'down_1_6' ELSE 'unsupported' END AS kind,
  CAST((CAST(a AS BIGINT) * 65536 + b - 1) // b AS BIGINT) AS step FROM x""")
def resamplers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion between every order's pair of rates, and its step."""
    hz = F.array(*[F.lit(r).cast("long") for r in (8000, 12000, 16000, 24000, 48000)])
    a, b = F.element_at(hz, (F.col("o_orderkey") % 5 + 1).cast("int")), F.element_at(hz, (F.col("o_custkey") % 5 + 1).cast("int"))
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", sg.resampler(a, b).alias("kind"), sg.resampler_step(a, b).alias("step"))


@query("""WITH h AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '....'), lambda x: CAST('0x' || x[3 : 4] || x[1 : 2] AS BIGINT)) AS u FROM documents),
x AS (SELECT doc_id, list_transform(u, lambda v: CASE WHEN v >= 32768 THEN v - 65536 ELSE v END) AS x FROM h)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_samples, CAST(coalesce(list_sum(x), 0) AS BIGINT) AS total, CAST(coalesce(list_sum(list_transform(x, lambda v: v * v)), 0) AS BIGINT) AS energy, CAST(coalesce(list_max(list_transform(x, lambda v: abs(v))), 0) AS BIGINT) AS peak FROM x""")
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes unpacked as 16-bit samples, an odd byte dropped: how many, their sum, that of their squares, and their peak."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", files.unpacked(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("array<bigint>").alias("x"))
    x = F.col("x")
    return docs.select("doc_id", F.size(x).cast("long").alias("n_samples"), sg.total(x).alias("total"), sg.inner(x, x).alias("energy"), sg.peak(x).alias("peak"))


@query("""WITH a AS (SELECT event_id, CAST(1 + event_id * 2654435761 % 2147483647 AS BIGINT) AS u, event_id * 7919 % 4200 - 100 AS e FROM events), b AS (SELECT *, 32 - length(bin(u)) AS lz, e & 127 AS g, CAST(1 AS BIGINT) << greatest(0, least(31, e // 128)) AS whole FROM a),
c AS (SELECT *, (CASE WHEN lz >= 24 THEN u << (lz - 24) ELSE u >> (24 - lz) END) & 127 AS f, g + CAST(floor(g * (128 - g) * -174 / 65536.0) AS BIGINT) AS bend FROM b)
SELECT event_id, CAST(f + ((f * (128 - f) * 179) >> 16) + (31 - lz) * 128 AS BIGINT) AS log128, CAST(CASE WHEN e < 0 THEN 0 WHEN e >= 3967 THEN 2147483647 WHEN e < 2048 THEN whole + ((whole * bend) >> 7) ELSE whole + (whole >> 7) * bend END AS BIGINT) AS exp128 FROM c""")
def logarithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point logarithms and powers of scrambled words."""
    e = F.col("event_id")
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", (1 + e * 2654435761 % 2147483647).alias("u"), (e * 7919 % 4200 - 100).alias("e"))
    return rows.select("event_id", fx.log128(F.col("u")).alias("log128"), fx.exp128(F.col("e")).alias("exp128"))


def _q15(a: str, b: str) -> str:
    return f"CAST(floor(({a}) * ({b}) / 32768.0) AS BIGINT)"


def _p15(a: str, b: str) -> str:
    return f"CAST(floor((({a}) * ({b}) + 16384) / 32768.0) AS BIGINT)"


def _moved(x: str, s: str) -> str:
    """Right by s in SQL, or left by -s."""
    return f"CASE WHEN {s} >= 0 THEN CAST(floor({x} / power(2, {s})) AS BIGINT) ELSE CAST({x} AS BIGINT) * CAST(power(2, -({s})) AS BIGINT) END"


def _horner(n: str, coefficients: tuple[int, ...]) -> str:
    out = str(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"{c} + {_q15(n, out)}"
    return out


@query(f"""WITH {SAMPLES}, v AS (SELECT event_id, x, abs(x) * 32767 + 1 AS v FROM x), i AS (SELECT *, length(bin(v)) - 1 AS i FROM v),
n AS (SELECT *, (i >> 1) - 7 AS k, {_moved('v', '(i - 15)')} AS top, (x + 32768) * 4 AS turn FROM i),
a AS (SELECT *, {_moved('v', '(2 * k)')} - 32768 AS sn, top - 49152 AS ln, top - 32768 AS rn, CASE WHEN turn % 131072 > 65536 THEN 131072 - turn % 131072 ELSE turn % 131072 END AS t0, CAST(floor(x / 1024.0) AS BIGINT) AS e FROM n),
b AS (SELECT *, {_horner('rn', fx.RCP)} AS r0, CASE WHEN t0 < 32768 THEN t0 ELSE 65536 - t0 END AS q FROM a),
c AS (SELECT *, r0 - {_q15('r0', _q15('r0', 'rn') + ' + r0 - 32768')} AS r1, {_p15('q', 'q')} AS q2 FROM b),
d AS (SELECT *, r1 - 1 - {_q15('r1', _q15('r1', 'rn') + ' + r1 - 32768')} AS r2, 1 + least(32766, 32767 - q2 + {_p15('q2', f"{fx.COS[0]} + {_p15('q2', f'{fx.COS[1]} + ' + _p15(str(fx.COS[2]), 'q2'))}")}) AS w FROM c)
SELECT event_id, CASE WHEN v >= 1073741824 THEN 32767 ELSE {_moved(f"({_horner('sn', fx.SQRT)})", '(7 - k)')} END AS root, 1024 * (i - 13) + CAST(floor(({_horner('ln', fx.LOG2)}) / 16.0) AS BIGINT) AS logarithm, {_moved('r2', '(i - 16)')} AS inverse,
  CASE WHEN t0 % 32768 <> 0 THEN CASE WHEN t0 < 32768 THEN w ELSE -w END WHEN t0 = 32768 THEN 0 WHEN t0 = 0 THEN 32767 ELSE -32767 END AS cosine,
  CASE WHEN e > 14 THEN 2130706432 WHEN e < -15 THEN 0 ELSE {_moved(f"({_horner('((x - 1024 * e) * 16)', fx.EXP2)})", '(-e - 2)')} END AS power,
  (CASE WHEN i % 2 = 0 THEN 32768 ELSE 46214 END >> ((31 - i) >> 1)) + (((CASE WHEN i % 2 = 0 THEN 32768 ELSE 46214 END >> ((31 - i) >> 1)) * 213 * (({_moved('v', '(i - 7)')}) & 127)) >> 16) AS rough FROM d""")
def fixed_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point roots, logarithms, reciprocals, cosines and powers of every sample, or of its magnitude spread over 30 bits."""
    x = F.col("x")
    rows = fixtures.samples(spark, sf_dir).select("event_id", "x", (F.abs(x) * 32767 + 1).alias("v"))
    v = F.col("v")
    return rows.select(
        "event_id", fx.sqrt(v).alias("root"), fx.log2(v).alias("logarithm"), fx.reciprocal(v).alias("inverse"), fx.cosine((x + 32768) * 4).alias("cosine"), fx.exp2(x).alias("power"), fx.rough_sqrt(v).alias("rough")
    )


def _angle_cosine(x: str) -> str:
    """SQL of a struct's steps: the square, then the curve over it."""
    square = f"((4096 + ({x}) * ({x})) >> 13)"
    a, b, c = fx.ANGLE_COS
    r15 = lambda p, q: f"((({p}) * ({q}) + 16384) >> 15)"
    return f"(32768 - {square} + {r15(square, f'{a} + ' + r15(square, f'{b} + ' + r15(str(c), square)))})"


def _log_part(v: str) -> str:
    """SQL of a number's logarithm, from its top 15 bits t."""
    a, b = fx.ANGLE_LOG
    top = f"({v} << (15 - length(bin({v}))))"
    return f"(length(bin({v})) * 2048 + (({top} * ({a} + (({top} * {b} + 16384) >> 15)) + 16384) >> 15))"


def _atan_steps() -> str:
    """SQL of the arc tangent's curve, one CTE a step, from columns u and q (its square)."""
    steps, last = [], "0"
    for i, c in enumerate(reversed(fx.ATAN)):
        steps.append(f"t{i} AS (SELECT *, (q * ({c} + {last})) >> 31 AS i{i} FROM {f't{i - 1}' if i else 'q'})")
        last = f"i{i}"
    return ",\n".join(steps)


@query(f"""WITH {SAMPLES}, a AS (SELECT event_id, x, 64 + abs(x) % 16257 AS a, CAST(x AS BIGINT) * 32768 AS u FROM x),
c AS (SELECT *, {_angle_cosine('a')} AS c, {_angle_cosine('16384 - a')} AS s FROM a), q AS (SELECT *, ((2 * u) * u) >> 31 AS q FROM c),
{_atan_steps()}
SELECT event_id, c AS cosine, s AS sine, CAST({_log_part('s')} - {_log_part('c')} AS BIGINT) AS log_tangent,
  CASE WHEN x = -32768 THEN -536870912 ELSE ({fx.ATAN_TURN} * (u + (((2 * u) * i{len(fx.ATAN) - 1}) >> 31))) >> 31 END AS arc_tangent FROM t{len(fx.ATAN) - 1}""")
def fixed_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-exact cosines, sines and the logarithm of their ratio for every sample as an angle, and its arc tangent."""
    x = F.col("x")
    rows = fixtures.samples(spark, sf_dir).select("event_id", "x", (64 + F.abs(x) % 16257).alias("a"))
    c, s = fx.angle_cosine(F.col("a")), fx.angle_cosine(16384 - F.col("a"))
    return rows.select("event_id", c.alias("cosine"), s.alias("sine"), fx.log2_tangent(s, c).alias("log_tangent"), fx.arc_tangent(x * 32768).alias("arc_tangent"))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS i FROM x)
SELECT stream_id, event_id, CAST(min(abs(x) - 16 * i) OVER (PARTITION BY stream_id ORDER BY i) + 16 * i AS BIGINT) AS background FROM n""")
def background_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's background: at most 16 above the one before, and never above the sample's magnitude."""
    rows = ordered.running(fixtures.samples(spark, sf_dir), "stream_id", ["ts", "event_id"], {"i": F.lit(1)})
    low = ordered.running_min(rows, "stream_id", ["ts", "event_id"], F.abs("x") - 16 * F.col("i"), "low")
    return low.select("stream_id", "event_id", (F.col("low") + 16 * F.col("i")).alias("background"))


@query(f"""WITH {BANDS}, m AS (SELECT vec_id, x, len(x) AS n, list_reverse(x) AS y FROM v),
f AS (SELECT vec_id, x, n, list_transform(range(n), lambda i: CAST(floor((((i + 1) * 32767 // n) * ((i + 1) * 32767 // n) // 32768 * y[i + 1] + (32767 - ((i + 1) * 32767 // n) * ((i + 1) * 32767 // n) // 32768) * x[i + 1]) / 32768.0) AS BIGINT)) AS faded FROM m)
SELECT vec_id, CAST(list_sum(list_transform(range(1, n + 1), lambda i: faded[i] * i)) AS BIGINT) AS faded, CAST(list_sum(list_transform(range(n), lambda i: x[i + 1] * (2 + 2 * i - n))) AS BIGINT) AS tilt,
  CAST(list_sum(list_transform(range(n), lambda j: list_min(list_transform(range(j + 1), lambda i: x[i + 1] - 150 * i)) + 150 * j)) AS BIGINT) AS limited,
  list_sum(list_transform(range(n // 2), lambda i: abs(x[2 * i + 1]) + abs(x[2 * i + 2]))) * 181 < list_sum(list_transform(range(n // 2), lambda i: abs(x[2 * i + 1] + x[2 * i + 2]) + abs(x[2 * i + 1] - x[2 * i + 2]))) * 128 AS is_dual FROM f""")
def band_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossfades, tilt, limited rises, and whether a pair of channels is coded apart, for every band vector."""
    x, n = F.col("x"), F.size("x")
    pairs = F.sequence(F.lit(0), F.call_function("div", n, F.lit(2)).cast("int") - 1)
    a, b = lambda i: F.get(x, 2 * i), lambda i: F.get(x, 2 * i + 1)
    apart = sg.total(F.transform(pairs, lambda i: F.abs(a(i)) + F.abs(b(i))))
    joint = sg.total(F.transform(pairs, lambda i: F.abs(a(i) + b(i)) + F.abs(a(i) - b(i))))
    return fixtures.bands(spark, sf_dir).select(
        "vec_id", sg.total(F.transform(sg.crossfade(x, F.reverse(x)), lambda v, i: v * (i + 1))).alias("faded"), sg.tilt(x).alias("tilt"), sg.total(sg.rise_limited(x, 150)).alias("limited"), (apart * 181 < joint * 128).alias("is_dual")
    )


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) - 1 AS i FROM x), g AS (SELECT stream_id, CAST(i // 8 AS BIGINT) AS frame, list(x ORDER BY i) AS v FROM n GROUP BY ALL), f AS (SELECT stream_id, frame, list_concat(v, list_transform(range(8 - len(v)), lambda i: CAST(0 AS BIGINT))) AS v FROM g),
p AS (SELECT stream_id, frame, k, CAST(floor(list_sum(list_transform(range(8), lambda i: v[i + 1] * CAST(round(cos(2 * pi() * k * i / 8) * 16384) AS BIGINT))) / 16384.0) AS BIGINT) AS c, CAST(floor(list_sum(list_transform(range(8), lambda i: v[i + 1] * CAST(round(sin(2 * pi() * k * i / 8) * 16384) AS BIGINT))) / 16384.0) AS BIGINT) AS s FROM f, range(5) AS t(k))
SELECT stream_id, frame, k AS bin, c * c + s * s AS power FROM p""")
def frame_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum of every frame of eight samples, a stream's last one filled up with zeros."""
    rows = ordered.running(fixtures.samples(spark, sf_dir), "stream_id", ["ts", "event_id"], {"i": F.lit(1)})
    frames = rows.groupBy("stream_id", F.call_function("div", F.col("i") - 1, F.lit(8).cast("long")).alias("frame")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("f"))  # of eight
    full = frames.select("stream_id", "frame", F.concat("f.x", F.array_repeat(F.lit(0).cast("long"), 8 - F.size("f"))).alias("v"))
    return full.select("stream_id", "frame", F.posexplode(sg.powers(F.col("v"), 8)).alias("bin", "power")).withColumn("bin", F.col("bin").cast("long"))


_STEP = "CASE WHEN b > 0 THEN (a.rng >> 8) * 16 ELSE a.rng - (a.rng >> 8) * 240 END"


@query(f"""WITH y AS (SELECT event_id, list_transform(range(8), lambda j: event_id * (j + 3) % 16 * 16) AS low FROM events),
z AS (SELECT event_id, list_reduce(list_prepend({{'rng': CAST(2147483648 AS BIGINT), 'total': CAST(33 AS BIGINT), 'low': CAST(0 AS BIGINT)}}, list_transform(low, lambda l: {{'rng': CAST(0 AS BIGINT), 'total': CAST(0 AS BIGINT), 'low': CAST(l AS BIGINT)}})),
  lambda a, x: {{'rng': {_STEP.replace('b > 0', 'x.low > 0')} * CASE WHEN {_STEP.replace('b > 0', 'x.low > 0')} > 8388608 THEN 1 WHEN {_STEP.replace('b > 0', 'x.low > 0')} > 32768 THEN 256 ELSE 65536 END,
    'total': a.total + CASE WHEN {_STEP.replace('b > 0', 'x.low > 0')} > 8388608 THEN 0 WHEN {_STEP.replace('b > 0', 'x.low > 0')} > 32768 THEN 8 ELSE 16 END, 'low': CAST(0 AS BIGINT)}}) AS s FROM y)
SELECT event_id, s.rng AS rng, CAST(s.total - length(bin(s.rng)) AS BIGINT) AS used FROM z""")
def range_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range coder's state after eight symbols of every packet."""
    e = F.col("event_id")
    symbols = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct((e * (j + 3) % 16 * 16).alias("low"), (e * (j + 3) % 16 * 16 + 16).alias("high")))
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", symbols.alias("symbols"))
    return rows.select("event_id", coding.range_after(F.col("symbols"), 8).alias("x")).select("event_id", "x.rng", "x.used")


@query("""WITH a AS (SELECT event_id, 1 + event_id % 12 AS n, event_id % 13 AS k FROM events)
SELECT event_id, CAST(CASE WHEN k = 0 THEN 1 ELSE list_sum(list_transform(range(1, least(n, k) + 1), lambda i: power(2, i) * factorial(CAST(n AS INTEGER)) / factorial(CAST(i AS INTEGER)) / factorial(CAST(n - i AS INTEGER)) * factorial(CAST(k - 1 AS INTEGER)) / factorial(CAST(i - 1 AS INTEGER)) / factorial(CAST(k - i AS INTEGER)))) END AS BIGINT) AS n_vectors FROM a""")
def pulse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the codebook that every packet's numbers of places and pulses call for."""
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 12).alias("n"), (F.col("event_id") % 13).alias("k"))
    return rows.select("event_id", coding.pulse_vectors(F.col("n"), F.col("k")).alias("n_vectors"))
