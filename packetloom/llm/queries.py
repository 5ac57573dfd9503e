"""The registered queries of this subpackage: thin contracts over its operators, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, html, langid, neardup, quality, runs, secrets, sharding, tokencount, topk, trie
from .jobs import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with all benchmark items."""
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS g FROM b, unnest(range(0, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw), unnest(range(0, len(w) - n + 1)) AS t(p) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""


#: Shards of the sharding query, and slots of its table.
SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 8191


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


OP2_SQL = f"""
WITH RECURSIVE s AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({len(SHARDS)}) AS t(i)),
p AS (SELECT list(CAST('0x' || substr(md5('offset:' || name), 1, 15) AS BIGINT) % {SLOTS} ORDER BY i) AS o,
             list(CAST('0x' || substr(md5('skip:' || name), 1, 15) AS BIGINT) % {SLOTS - 1} + 1 ORDER BY i) AS k FROM s),
f(turn, slots, slot) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: FALSE), CAST(NULL AS BIGINT) FROM p
  UNION ALL
  SELECT turn + 1, list_transform(slots, lambda x, i: x OR i - 1 = c), c
  FROM (SELECT f.turn, f.slots, list_filter(list_transform(range({SLOTS}), lambda j: (p.o[f.turn % {len(SHARDS)} + 1] + j * p.k[f.turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda c: NOT f.slots[c + 1])[1] AS c
        FROM f, p WHERE f.turn < {SLOTS})),
t AS (SELECT slot, (turn - 1) % {len(SHARDS)} AS shard FROM f WHERE turn > 0),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(shard AS INTEGER) AS shard FROM d JOIN t USING (slot)
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: A document with more tokens than this is over the limit.
TOKEN_LIMIT = 4096


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    found = tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    counts = [secrets.count_kind(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def digests(tokens: DataFrame) -> DataFrame:
    """Digests of (doc_id, ids, decoded)."""
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digests(bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that a quarter of the documents is held out from."""
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(part != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted in windows and read back."""
    said = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    written = chat.windows(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(said))
    fresh = F.slice(chat.read_back(F.col("formatted")), F.col("n_context") + 1, F.col("n_turns"))
    read = written.select(
        "conv_id", "window", F.size(fresh).alias("n"), F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        chat.learned(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("size"),
    )
    # the digests are of whole conversations, so their texts meet here
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("x"), F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"))
    loss = F.array_join(F.col("x.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("x.turns"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<|turn|>' || replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')
         || '<|text|>' || replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') || '<|end|>' AS written FROM c),
s AS (SELECT *, CAST(ceil(strlen(written) / 4.0) AS BIGINT) AS size, row_number() OVER w AS rank FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
y AS (SELECT *, max(CASE WHEN rank = 1 AND role = 'system' AND 2 * size <= 1792 THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM s),
p AS (SELECT *, 1792 - sys AS stride, rank = 1 AND sys > 0 AS leads, sum(size) OVER (PARTITION BY conv_id ORDER BY rank) - size - sys AS b FROM y),
l AS (SELECT *, length(written) AS chars, CASE WHEN leads THEN 1 ELSE 2 * ((b + size - 1) // stride) + CASE WHEN b // stride < (b + size - 1) // stride THEN 0 ELSE 1 END END AS win FROM p),
w AS (SELECT conv_id, win, min(b) AS start, min(rank) AS first, bool_or(size > stride) AS long, bool_or(size > stride) AND max(size) <= 2048 AND max(sys) + max(size) > 2048 AS alone FROM l GROUP BY ALL),
again AS (SELECT l.conv_id, sum(l.chars) AS chars FROM l JOIN w ON l.conv_id = w.conv_id AND l.rank < w.first AND ((l.leads AND NOT w.alone) OR (NOT l.leads AND l.b + 256 >= w.start AND NOT w.long)) GROUP BY ALL),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY rank) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM l GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(t.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars FROM t LEFT JOIN again USING (conv_id)
"""


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model that a third of the documents is held out from."""
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    rows = cut(quality.measure(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(rows.where(part != 1).join(labels, "doc_id"))
    found = quality.score(rows, model)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that they share beginnings."""
    return trie.prefix_trie(*trie.spliced(trie.ranked(_table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH RECURSIVE tab AS (SELECT list(CAST(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY i) AS t FROM range(256) AS r(i)),
c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM c),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS head,
  xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda s, b: xor(s // 256, tab.t[xor(s, b) % 256 + 1]))) % 9 AS h
  FROM ids, tab),
hn AS (SELECT h.conv_id, h.head, h.h, least(h.h, count(c.rank)) AS n FROM h LEFT JOIN c ON c.conv_id = h.head GROUP BY h.conv_id, h.head, h.h),
b AS (SELECT hn.conv_id, c.rank, c.role, c.text FROM hn JOIN c ON c.conv_id = hn.head AND c.rank <= hn.h
  UNION ALL SELECT hn.conv_id, c.rank - hn.h + hn.n, c.role, c.text FROM hn JOIN c ON c.conv_id = hn.conv_id AND c.rank > hn.h),
m(conv_id, depth, path, bytes) AS (SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM ids
  UNION ALL SELECT b.conv_id, b.rank, sha256(m.path || ':' || length(b.role) || ':' || b.role || b.text), CAST(strlen(b.text) AS BIGINT) FROM m JOIN b ON b.conv_id = m.conv_id AND b.rank = m.depth + 1),
o AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS (SELECT node, depth, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM o GROUP BY ALL),
p AS (SELECT n.*, o.node AS parent FROM n LEFT JOIN o ON o.conv_id = n.node AND o.depth = n.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k USING (node, depth)),
s AS (SELECT o.node, o.depth, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((q.n_convs - 1) * q.bytes) AS saved FROM q JOIN o ON o.conv_id = q.node AND o.depth <= q.depth GROUP BY ALL)
SELECT q.node AS conv_id, q.depth, q.parent AS parent_conv_id, CAST(q.n_convs AS BIGINT) AS n_convs, CAST(q.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(q.ended) AS ends_sha256 FROM q JOIN s ON s.node = q.node AND s.depth = q.depth
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, repeats made at the end of some."""
    found = runs.find_runs(runs.planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontamination, op2_sharding, op3_html_extraction, op4_token_counts, op5_top_k, op6_secret_scan, op7_near_duplicates, op8_bpe_round_trip, op9_language_id, op10_chat_format, op11_quality, op12_prefix_trie, op13_periodic_runs]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_sharding": OP2_SQL, "op5_top_k": OP5_SQL, "op10_chat_format": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op7_near_duplicates": OP7_SQL}
