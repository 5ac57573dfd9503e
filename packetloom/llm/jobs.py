"""Small helpers that several operators share: reliable cut points, size checks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession) -> str:
    """A new folder name below the session's spark.checkpoint.dir, which all machines share.

    Only where that is unset (tests on one machine) it lies in a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage: written as a table in the shared folder and read again.

    A lost executor then costs a re-read. Unlike a checkpoint, the table has known sizes, is read by columns and carries
    no constraints of the plan before it, which grow with every further cut of an iteration.
    """
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most most_rows; else Spark shuffles both sides.

    df should have been cut before, for it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): one row (node, component) for each node, component its smallest node.

    Each round hooks every node to its smallest neighbour, shortens the resulting paths, and contracts the graph to
    edges between what is left, so both nodes and edges shrink geometrically. Minima are partial aggregates and all
    else are joins, so a node with very many edges is no single task's burden. Empty edges give an empty result.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        for _ in range(2):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        hooks = cut(hooks)
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "up")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        a = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(a, "a").join(b, "b").where("ua <> ub")
        edges = cut(edges.select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut(labels)


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) known before, joined by more edges (a, b); nodes may be new. Each is its smallest node's."""
    if known.isEmpty():
        return components(edges)
    left, right = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    between = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    labels = components(between)
    if labels.isEmpty():
        return known
    step = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
    moved = known.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return cut(moved.union(labels.join(known, "node", "left_anti").select("node", "component")))
