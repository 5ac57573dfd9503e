"""Secret scans by two character Markov models (operator 6).

Three patterns find what looks like a secret by its form. Values they find are also the labelled samples that a
first-order character model of random strings is trained on, beside one of the ordinary identifiers around them. Any
other long run of identifier characters whose log-likelihood ratio favours random strings is a further finding.

Everything is DataFrame functions. Places come from the pieces that splitting by a pattern leaves between its matches,
by running sums that are taken in chunks, so that the work grows in proportion to a text's findings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns, by kind, and the least length of what must be long.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
RANDOM = "random"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
IDENTIFIER = r"[A-Za-z0-9+/_=-]"
#: Runs of identifier characters of this length are judged by the models.
LEAST_RUN = 16
#: Log-likelihood ratio of a whole run, in bits, from which it is random: it outweighs odds of one secret in a million runs.
LEAST_BITS = 20.0
#: Elements of an array that are summed one after another, and code points of a text that are redacted at once.
CHUNK, PIECE = 128, 8192
#: Pieces whose spans are looked for together.
GROUP = 64
_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, op, first: int) -> Column:
    """op (a sum, maximum or minimum) over each whole number of an array and all before it, in chunks."""
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(first))

    def fold(xs: Column, begin: Column) -> Column:
        return F.aggregate(xs, begin, lambda done, x: F.concat(done, F.array(op(last(done), x).cast("int"))))

    def chunks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: fold(F.slice(xs, i * CHUNK + 1, CHUNK), F.array().cast("array<int>")))

    def joined(parts: Column) -> Column:
        before = fold(F.transform(parts, last), F.array(F.lit(first)))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda part, b: F.transform(part, lambda x: op(b, x).cast("int"))))

    return _let(_let(values, chunks), joined)


def _matches(text: Column, pattern: str) -> Column:
    """(start, string) of the leftmost matches of a pattern; code points."""

    def placed(found: Column) -> Column:
        before = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
        ends = _running(F.zip_with(before, found, lambda g, m: g + F.length(m)), lambda a, b: a + b, 0)
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), m.alias("string")))

    none = F.array().cast("array<struct<start:int,string:string>>")
    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _as_spans(matches: Column, kind_no: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["string"])).alias("end"))).cast(_SPAN)


def _spans(text: Column, pattern: str, kind_no: int, kind: str, group: int, least: int) -> Column:
    """Spans of the leftmost matches of a pattern whose group has the least length; code points, end exclusive."""
    value = lambda m: F.regexp_extract(m["string"], pattern, group) if group else m["string"]
    return _as_spans(F.filter(_matches(text, pattern), lambda m: F.length(value(m)) >= least), kind_no, kind)


def base_spans(text: Column) -> Column:
    """Spans of all kinds of patterns, in order of start and kind."""
    return F.array_sort(F.concat(*[_spans(text, pattern, i, kind, group, least) for i, (kind, pattern, group, least) in enumerate(KINDS)]))


def _outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: by the farthest end of others from before, and the next start after."""
    far = 1 << 30
    tagged = F.concat(F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(0).alias("mine"), o.alias("span"))), F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("mine"), s.alias("span"))))

    def judged(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: F.when(e["mine"] == 0, e["span"]["end"]).otherwise(-1)), F.greatest, -1)
        ahead = F.reverse(_running(F.reverse(F.transform(events, lambda e: F.when(e["mine"] == 0, e["at"]).otherwise(far))), F.least, far))
        rows = F.arrays_zip(events.alias("e"), reach.alias("reach"), ahead.alias("ahead"))
        clear = F.filter(rows, lambda r: (r["e"]["mine"] == 1) & (r["reach"] <= r["e"]["at"]) & (r["ahead"] >= r["e"]["span"]["end"]))
        return F.transform(clear, lambda r: r["e"]["span"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(_let(F.array_sort(tagged), judged))


def _long(strings: Column, least: int) -> Column:
    return F.filter(strings, lambda s: F.length(s) >= least)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 5000) -> list[float]:
    """The log-likelihood ratio, in bits, of each pair of neighbours, row by row over the alphabet and one place for the rest.

    Labelled strings: values and access keys that the patterns find are random (hexadecimal runs aren't taken: their sixteen
    characters say nothing of others), runs of four or more identifier characters elsewhere are ordinary.
    They are taken from about sample_rows documents at most, chosen by a hash of the id. Counts by label and pair (at most
    twice the table) reach the driver. Without samples, as of an empty table, every pair is as likely as any other. Null and
    empty texts give no samples; repeated rows count each time; documents that share an id are all taken or none.
    """
    rows = docs.count()
    some = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if rows > sample_rows:
        some = some.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * (sample_rows / rows)))
    values = F.concat(*[_long(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), least) for kind, pattern, group, least in KINDS if kind != "hex"])
    rest = F.col("text")
    for _, pattern, _, _ in KINDS:
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(IDENTIFIER + "{4,}+"), F.lit(0))
    both = some.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), values.alias("strings")), F.struct(F.lit(0).alias("label"), words.alias("strings")))).alias("x"))
    strings = both.select("x.label", F.explode("x.strings").alias("string"))
    chars = strings.select("label", F.split("string", "").alias("c"))
    pairs = chars.select("label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: F.concat(a, b))).alias("pair"))
    k = len(ALPHABET) + 1
    counts = [[[0.5] * k for _ in range(k)] for _ in range(2)]
    for r in pairs.groupBy("label", "pair").count().collect():
        if len(r["pair"]) == 2:
            a, b = (ALPHABET.find(c) % k for c in r["pair"])
            counts[r["label"]][a][b] += r["count"]
    ordinary, random = ([[n / sum(row) for n in row] for row in table] for table in counts)
    return [round(math.log2(random[a][b] / ordinary[a][b]), 3) for a in range(k) for b in range(k)]


def _bits(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token, summed over its pairs of neighbours."""
    k = len(ALPHABET) + 1
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("bits"))

    def step(done: Column, c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c)
        place = F.when(at == 0, F.lit(k - 1)).otherwise(at - 1)
        more = F.when(done["before"] < 0, F.lit(0.0)).otherwise(F.get(ratios, done["before"] * k + place))
        return F.struct(place.alias("before"), (done["bits"] + more).alias("bits"))

    return F.aggregate(F.split(token, ""), start, step, lambda x: x["bits"])


def scan(docs: DataFrame, table: list[float], *, text_col: str = "text") -> DataFrame:
    """docs with the columns base_spans and spans added: arrays of (start, kind_no, kind, end) in order of start and kind.

    base_spans are the patterns' findings, leftmost and non-overlapping within a kind; spans adds runs of at least
    LEAST_RUN identifier characters with a letter, clear of base spans, that the models call random. Null and empty texts
    have none. Whole texts are scanned, of any length. Rows may repeat and ids may be null or tied; no rows give none.
    Columns of docs named like the new ones are replaced. Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("base_spans", "spans")
    runs = _matches(text, IDENTIFIER + f"{{{LEAST_RUN},}}+")
    judged = _as_spans(F.filter(runs, lambda m: m["string"].rlike("[A-Za-z]") & (_bits(m["string"], table) >= LEAST_BITS)), len(KINDS), RANDOM)
    found = docs.withColumn("base_spans", base_spans(text))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", _outside(judged, F.col("base_spans")))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, or run of overlapping spans, replaced by a mark; spans in order of start.

    The text is cut into pieces in one pass; each is written by itself, from the spans that reach it, which are looked for
    among those of its GROUP of pieces. A span that goes on from one piece to the next is marked where it begins.
    """
    reach = lambda low, high, some: F.filter(some, lambda s: (s["start"] < high) & (s["end"] > low))

    def piece(part: Column, i: Column, some: Column) -> Column:
        low, high = i * PIECE, (i + 1) * PIECE

        def step(done: Column, s: Column) -> Column:
            begin, end = F.greatest(s["start"] - low, F.lit(0)), F.least(s["end"] - low, F.lit(PIECE))
            before = F.substr(part, done["at"] + 1, F.greatest(begin - done["at"], F.lit(0)))
            # a mark where a span begins that no span before it reaches
            opens = (s["start"] >= low) & (s["start"] >= done["reach"])
            out = F.concat(done["out"], before, F.when(opens, F.lit(mark)).otherwise(F.lit("")))
            return F.struct(F.greatest(done["at"], end).alias("at"), F.greatest(done["reach"], s["end"]).alias("reach"), out.alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("reach"), F.lit("").alias("out"))
        return F.aggregate(reach(low, high, some), start, step, lambda x: F.concat(x["out"], F.substr(part, x["at"] + 1, F.lit(PIECE))))

    def group(pieces: Column, g: Column) -> Column:
        mine = reach(g * GROUP * PIECE, (g + 1) * GROUP * PIECE, spans)
        write = lambda some: F.array_join(F.transform(F.slice(pieces, g * GROUP + 1, F.lit(GROUP)), lambda part, j: piece(part, g * GROUP + j, some)), "")
        return _let(mine, write)

    def whole(pieces: Column) -> Column:
        groups = F.sequence(F.lit(0), F.floor(F.greatest(F.size(pieces) - 1, F.lit(0)) / GROUP).cast("int"))
        return F.array_join(F.transform(groups, lambda g: group(pieces, g)), "")

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(cut, whole)).otherwise(text)
