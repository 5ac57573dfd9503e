"""Prefix trie of conversations by the Euler-tour technique (operator 12).

A node is a distinct sequence of first turns. It is told by sums over its turns of digests that cover a turn's place,
role and text, so that prefix sums along a conversation name all its nodes at once. Each node has an arc that enters it
and one that leaves it; an arc's successor follows from first children, next siblings and parents. The tour's list is
ranked by contraction: in every round the arcs whose random priority is below both neighbours' leave the list, which
shortens it by a third; the few that remain are ranked in one walk, and the others, round by round backwards, from their
successors. Prefix sums over the arcs in order of their positions then give, as a difference between a node's two arcs,
the leaves and savings of its subtree. Every step is a join or an aggregation of evenly dealt rows: siblings are ordered
by ranges, positions by blocks of equal size, so that neither a long conversation nor a node with very many children or
members is one task's burden.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .chat import turns
from .jobs import cut

#: Turns of a conversation, and positions of the tour, whose sums one task takes at once.
BLOCK = 1 << 14
#: A list of this many arcs is ranked in one walk; a list keeps its two ends.
WALK = 1 << 12

_KEY = [f"k{i}" for i in range(4)]
_ROUNDS = 200


def ranked(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, rank (from 1), role, text: turns go by turn, null first, ties by role, then text; null roles and texts are empty.

    Rows without an id take no part. Repeated rows are turns of their own.
    """
    rows = conversations.where(F.col(id_col).isNotNull())
    return turns(rows, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col).select("conv", "rank", "role", "text")


def spliced(rows: DataFrame, *, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they share beginnings, from ranked() rows: the new rows, and all ids (conv).

    Conversation c gets the first h turns of conversation c - c % family (all if it has fewer, none if it isn't there), then
    its own after its first h; h = crc32(c) % most. An id may be left without turns.
    """
    rows = cut(rows)
    convs = rows.select("conv").distinct()
    h = F.crc32(F.col("conv").cast("string")) % most
    heads = rows.where(F.col("rank") < most).select(F.col("conv").alias("head"), "rank", "role", "text")
    convs = cut(convs.select("conv", (F.col("conv") - F.col("conv") % family).alias("head"), h.alias("h")))
    taken = convs.join(heads, "head").where("rank <= h").select("conv", "rank", "role", "text")
    found = heads.groupBy("head").agg(F.count("*").alias("n"))
    lengths = convs.join(found, "head", "left").select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("n"))
    own = rows.join(lengths, "conv").where("rank > h").select("conv", (F.col("rank") - F.col("h") + F.col("n")).alias("rank"), "role", "text")
    return taken.union(own), convs.select("conv")


def _members(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, the node's key k0.., its parent's key p0.., bytes of the last text, and whether the conversation ends there."""
    digest = F.sha2(F.concat_ws(":", F.col("rank").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    pieces = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(k) for i, k in enumerate(_KEY)]
    rows = rows.select("conv", "rank", F.octet_length("text").cast("long").alias("bytes"), F.floor((F.col("rank") - 1) / BLOCK).alias("block"), *pieces)
    sums = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), *(F.sum(k).alias(f"s{k}") for k in _KEY))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", F.sum("n").over(Window.partitionBy("conv")).alias("n"), *(F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"s{k}") for k in _KEY))
    within = Window.partitionBy("conv", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    through = [(F.col(f"s{k}") + F.sum(k).over(within)).alias(f"t{k}") for k in _KEY]
    found = rows.join(sums, ["conv", "block"]).select("conv", "rank", "bytes", "n", *_KEY, *through)
    keys, parents = [F.col(f"t{k}").alias(k) for k in _KEY], [(F.col(f"t{k}") - F.col(k)).alias(f"p{i}") for i, k in enumerate(_KEY)]
    found = found.select("conv", F.col("rank").alias("depth"), *keys, *parents, "bytes", (F.col("rank") == F.col("n")).alias("ends"))
    some = rows.where("rank = 1").select("conv", F.lit(False).alias("ends"))
    zero = F.lit(0).cast("long")
    root = convs.join(some, "conv", "left").select("conv", zero.alias("depth"), *(zero.alias(k) for k in _KEY), *(zero.alias(f"p{i}") for i in range(4)), zero.alias("bytes"), F.coalesce("ends", F.lit(True)).alias("ends"))
    return cut(found.union(root))


def _nodes(members: DataFrame) -> DataFrame:
    """A row for each node, numbered, siblings side by side: id, block, depth, its and its parent's key, conv (smallest member), n, bytes."""
    known = [F.min(c).alias(c) for c in ("p0", "p1", "p2", "p3", "bytes")]  # the same for all members
    nodes = members.groupBy("depth", *_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), *known)
    nodes = nodes.repartitionByRange("depth", "p0", "p1", "p2", "p3", "conv")
    return cut(nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id()))


def _linked(nodes: DataFrame) -> DataFrame:
    """nodes with parent, parent_conv, before and after (sibling ids), first and last (child ids), n_children."""
    parent = ["depth", "p0", "p1", "p2", "p3"]
    children = nodes.where("depth > 0")
    # siblings may fill many blocks: their links are found within a block, and between blocks from a row for each
    spans = children.groupBy(*parent, "block").agg(F.min_by("id", "conv").alias("low"), F.max_by("id", "conv").alias("high"), F.count("*").alias("n"))
    order = Window.partitionBy(*parent).orderBy("block")
    spans = spans.select(*parent, "block", "low", "high", "n", F.lag("high").over(order).alias("left"), F.lead("low").over(order).alias("right"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(f"p{i}") for i, k in enumerate(_KEY)), F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
    spans = cut(spans.join(above, parent))
    families = spans.groupBy(F.col("parent").alias("id")).agg(F.min_by("low", "block").alias("first"), F.max_by("high", "block").alias("last"), F.sum("n").alias("n_children"))
    near = Window.partitionBy(*parent, "block").orderBy("conv")
    children = children.join(spans.select(*parent, "block", "left", "right", "parent", "parent_conv"), [*parent, "block"])
    children = children.withColumn("before", F.coalesce(F.lag("id").over(near), "left")).withColumn("after", F.coalesce(F.lead("id").over(near), "right"))
    shown = ["id", "depth", "conv", "n", "bytes", *_KEY]
    none = F.lit(None).cast("long")
    root = nodes.where("depth = 0").select(*shown, *(none.alias(c) for c in ("parent", "parent_conv", "before", "after")))
    linked = children.select(*shown, "parent", "parent_conv", "before", "after").union(root).join(families, "id", "left")
    return cut(linked.withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _arcs(nodes: DataFrame) -> DataFrame:
    """The tour as a list: id (2 * node enters it, 2 * node + 1 leaves it), prev and next (null at the ends)."""
    enter, leave = 2 * F.col("id"), 2 * F.col("id") + 1
    arcs = F.array(
        F.struct(enter.alias("id"), F.coalesce(2 * F.col("before") + 1, 2 * F.col("parent")).alias("prev"), F.coalesce(2 * F.col("first"), leave).alias("next")),
        F.struct(leave.alias("id"), F.coalesce(2 * F.col("last") + 1, enter).alias("prev"), F.coalesce(2 * F.col("after"), 2 * F.col("parent") + 1).alias("next")),
    )
    return nodes.select(F.inline(arcs))


def rank_list(arcs: DataFrame, walk: int = WALK) -> DataFrame:
    """(id, rank) of a list (id, prev, next) whose ends are null: how many arcs follow one, itself included.

    The list may also be several lists; each is ranked by itself. At most `walk` arcs are ranked in one task; above that
    a round takes out about a third of those that are left, so there are some 2.5 ln(arcs / walk) rounds of shrinking size.
    """

    def low(salt: int) -> Column:
        key = [F.struct(F.xxhash64(F.lit(salt), c).alias("hash"), F.col(c).alias("id")) for c in ("id", "prev", "next")]
        return F.col("prev").isNotNull() & F.col("next").isNotNull() & (key[0] < key[1]) & (key[0] < key[2])

    rest, rounds = cut(arcs.select("id", "prev", "next", F.lit(1).cast("long").alias("w"))), []
    none = F.lit(None).cast("long")
    while rest.count() > walk:
        if len(rounds) == _ROUNDS:
            raise RuntimeError(f"the list did not shrink to {walk} arcs in {_ROUNDS} rounds")
        out = low(len(rounds))
        gone = rest.where(out)
        stay = rest.where(~out).select("id", "prev", "next", "w", none.alias("new_prev"), none.alias("new_next"))
        ahead = gone.select(F.col("prev").alias("id"), none.alias("prev"), none.alias("next"), "w", none.alias("new_prev"), F.col("next").alias("new_next"))
        behind = gone.select(F.col("next").alias("id"), none.alias("prev"), none.alias("next"), F.lit(0).cast("long").alias("w"), F.col("prev").alias("new_prev"), none.alias("new_next"))
        told = stay.union(ahead).union(behind).groupBy("id").agg(*(F.max(c).alias(c) for c in ("prev", "next", "new_prev", "new_next")), F.sum("w").alias("w"))
        rest = cut(told.select("id", F.coalesce("new_prev", "prev").alias("prev"), F.coalesce("new_next", "next").alias("next"), "w"))
        rounds.append(gone.select("id", "next", "w"))

    def follow(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        ahead, ids, ranks = {i: (prev, w) for i, prev, _, w in rows}, [], []
        for last in (i for i, _, after, _ in rows if after is None):
            i, rank = last, 0
            while i is not None:  # from a list's last arc to its first
                prev, w = ahead[i]
                rank += w
                ids.append(i)
                ranks.append(rank)
                i = prev
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "rank": pa.array(ranks, pa.int64())})

    done = cut(rest.coalesce(1).mapInArrow(follow, "id long, rank long"))
    for gone in reversed(rounds):
        after = done.select(F.col("id").alias("next"), F.col("rank").alias("follow"))
        done = done.union(cut(gone.join(after, "next").select("id", (F.col("w") + F.col("follow")).alias("rank"))))
    return done


def _subtrees(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, n_leaves and saved of every node: what its subtree adds to the prefix sums between its two arcs."""
    own = F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("own")
    values = nodes.select((2 * F.col("id")).alias("id"), *own)  # an arc that enters a node carries its values
    rows = ranks.join(values, "id", "left").select("id", "rank", F.floor(F.col("rank") / BLOCK).alias("block"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("own", F.lit(0)).alias("own"))
    rows = cut(rows)
    # a row for each block of 2^14 positions: its sums, and those of groups of 2^14 blocks, are added up in two steps
    blocks = rows.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")).withColumn("top", F.floor(F.col("block") / BLOCK))
    tops = blocks.groupBy("top").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    ahead = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("top", F.coalesce(F.sum("leaf").over(ahead), F.lit(0)).alias("leaf1"), F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("own1"))
    ahead = Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("top", "block", F.coalesce(F.sum("leaf").over(ahead), F.lit(0)).alias("leaf0"), F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("own0"))
    blocks = blocks.join(tops, "top").select("block", (F.col("leaf0") + F.col("leaf1")).alias("leaf0"), (F.col("own0") + F.col("own1")).alias("own0"))
    through = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(blocks, "block").select("id", (F.col("leaf0") + F.sum("leaf").over(through)).alias("leaf"), (F.col("own0") + F.sum("own").over(through)).alias("own"))
    # ranks count from the tour's end, so a node's entering arc has the larger sums; the leaving arc carries nothing
    sign = F.when(F.col("id") % 2 == 0, 1).otherwise(-1)
    return sums.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(F.sum(sign * F.col("leaf")).alias("n_leaves"), F.sum(sign * F.col("own")).alias("saved"))


def _endings(members: DataFrame) -> DataFrame:
    """ends_sha256 of every node at which conversations end: the digest of their ids in order, comma-joined.

    Ids are written out in ranges of even size; one task then reads a node's texts of ids in order, which such a digest
    asks for, and holds one of them at a time.
    """
    node = ["depth", *_KEY]
    ends = members.where("ends").select(*node, "conv").repartitionByRange(*node, "conv").withColumn("block", F.spark_partition_id())
    parts = cut(ends.groupBy(*node, "block").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))

    def digest(batches):
        at, found = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            out = []
            for key, ids in zip(rows, batch.column(6), strict=True):
                if key == at:
                    found.update(b"," + ids.as_py().encode())
                    continue
                if at is not None:
                    out.append((*at, found.hexdigest()))
                at, found = key, hashlib.sha256(ids.as_py().encode())
            yield told(out)
        if at is not None:
            yield told([(*at, found.hexdigest())])

    def told(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=[*node, "ends_sha256"])

    dealt = parts.repartition(*node).sortWithinPartitions(*node, "block").select(*node, "block", "ids")
    return dealt.mapInArrow(digest, ", ".join(f"{c} long" for c in node) + ", ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame | None = None, *, walk: int = WALK) -> DataFrame:
    """A row for each node of the trie of ranked() rows (conv, rank without gaps from 1, role, text).

    conv_id (smallest member) and depth name a node; parent_conv_id with depth - 1 names its parent (null at the root);
    n_convs, n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, bytes of
    each node's last text times its members beyond the first), ends_sha256 (digest of the ids, ascending and comma-joined,
    of conversations that end here). convs may add ids (conv) without turns; they are members of the root and end there.
    Turns are equal if role and text are. No conversations give no rows.
    """
    convs = rows.select("conv").distinct() if convs is None else convs.select("conv").union(rows.select("conv")).distinct()
    members = _members(rows, convs)
    nodes = _linked(_nodes(members))
    trees = _subtrees(nodes, rank_list(_arcs(nodes), walk))
    found = nodes.join(trees, "id").join(_endings(members), ["depth", *_KEY], "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
