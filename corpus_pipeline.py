"""A training-corpus pipeline in five stages, each one operator of packetloom.llm applied to what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm import bpe, decontaminate, langid, neardup, secrets
from packetloom.llm.jobs import broadcast_if_small, cut, folder
from packetloom.llm.queries import digests

#: Removed ids are broadcast up to this many, else joined by a shuffle.
MOST_BROADCAST_ROWS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous; a missing lang is filled in. Text without letters goes."""
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    found = langid.identify(docs, model).where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id. Documents without an id or words have no group.

    Of rows that share the id, the one whose text is smallest by its bytes stays, ties by the other columns in their order,
    nulls last for texts and first for others.
    """
    removed = cut(neardup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(broadcast_if_small(removed, MOST_BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    repeated = broadcast_if_small(repeated, MOST_BROADCAST_ROWS)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("text").isNull().alias("none"), "text", *others)
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
    once = once.select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty, or none, lie in windows of benchmark items."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=others)
    return found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    found = secrets.scan(docs, secrets.train(docs))
    hit = F.size("spans") > 0
    text = secrets.redact(F.col("text"), F.col("spans"))
    clean = found.withColumn("n_chars", F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text)
    return clean.select(*docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and digests of its ids and of what they decode to."""
    return digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. Results between stages stay in the session's spark.checkpoint.dir."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
