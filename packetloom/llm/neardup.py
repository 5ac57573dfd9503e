"""MinHash near-dedup by an LSH forest (operator 7).

Each document's set of word shingles becomes a one-permutation MinHash signature: the smallest hash of each of 256
bins, 16 bits of it, empty bins filled from the document's own full bins by a rank table that is the same everywhere. A
tree is one order of signature positions. Its labels are the raw positions in that order, range-sorted over the cluster,
so that texts with a long common prefix stand beside one another and no region of equal prefixes is gathered in one task.

A region, the texts that agree in a tree's first positions, is as deep as it needs to be. At the first depth, a region
of a few texts makes all of them candidates of one another. In a larger one each text is a candidate of its neighbours
of longest common prefix; if these don't connect the region, its texts go on to a forest of more depth, with as many more
trees as hold the recall, where texts that share less fall apart. What is left after the deepest forest is compared in
blocks of bounded size, without candidates.

Candidates are compared by signature, then on full shingle sets: first every text's best partner, then those pairs that
the links found so far leave unconnected. Exact copies are folded to one representative before all this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .jobs import broadcast_if_small, components, cut, extended

BINS = 256
#: How often a pair at the similarity asked for may share no region of any tree, at most.
MISSED = 6e-6

#: Trees a forest may have; deeper ones are not grown.
MOST_TREES = 512
#: Trees of a forest whose crowded regions pair neighbours: enough to connect copies of one text, in proportion to their number.
CHAINS = 8
#: Positions of a label beyond the depth of its forest, for the order of neighbours within a region.
MORE = 4

_random = np.random.default_rng(20)
#: RANK[e, f]: how early the full bin f is in line to fill the empty bin e.
RANK = _random.random((BINS, BINS)).astype(np.float32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text of fewer words, the whole sequence as one."""
    words = tx.Words(data, offsets, tx.NONSPACE)
    hashes = words.hashes()
    shingles = tx.rolling(hashes, size)
    for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if high - low >= size:
            found = np.sort(shingles[low : high - size + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        else:
            yield tx.rolling(hashes[low:high], high - low) if high > low else hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """256 positions of 16 bits of a sorted, non-empty set of 64-bit hashes."""
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[first]
    out = np.zeros(BINS, dtype=np.uint16)
    out[full] = (shingles[first] >> np.uint64(20)).astype(np.uint16)
    if len(full) < BINS:
        empty = np.ones(BINS, dtype=bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[full[RANK[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def forests(percent: int) -> list[tuple[int, int]]:
    """(depth, trees) of the forests, from the first on: each misses at most MISSED of the pairs at the similarity.

    The first depth is the largest up to 4 that 64 trees hold; the others are two and three times that.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    need = lambda depth: ceil(log(MISSED) / log(1 - min(percent / 100, 0.99) ** depth))
    first = next((d for d in (4, 3, 2) if need(d) <= 64), 1)
    return [(d, max(32, need(d))) for d in (first, 2 * first, 3 * first) if d == first or need(d) <= MOST_TREES]


def least_agreeing(percent: int) -> float:
    """The share of positions in which two sets of the similarity agree at least, but for about once in 10**10 times.

    At 0.75 sets agree in 192 of 256 positions, give or take 7. Above, the share is that of 0.75 in proportion, which is less.
    """
    bound = lambda s: s - 6.5 * (s * (1 - s) / BINS) ** 0.5
    return min(bound(percent / 100), bound(0.75) * percent / 75)


def orders(depth: int, trees: int) -> np.ndarray:
    """For each tree the positions of its labels: chunks of random permutations, so that trees of one share none."""
    random, width = np.random.default_rng([20, depth]), min(depth + MORE, BINS)
    each = BINS // width
    return np.concatenate([random.permutation(BINS)[: each * width].reshape(each, width) for _ in range(-(-trees // each))])[:trees]


def labels(signatures: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each signature and tree, in this order, a label: two bytes of the tree's number, two of each position."""
    n, (trees, width) = len(signatures), places.shape
    out = np.empty((n, trees, width + 1), dtype=">u2")
    out[:, :, 0] = np.arange(trees)
    out[:, :, 1:] = signatures[:, places]
    return out.view(np.uint8).reshape(n * trees, 2 * (width + 1))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    """A binary column whose values all have one width, as rows of numbers."""
    data, offsets = tx.buffers(column)
    return data.reshape(len(offsets) - 1, width).view(kind)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: id, n_shingles, the set's 128-bit identity (null if empty), its signature."""

    def run(batches):
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            for low, high in tx.chunks(offsets):
                sets = list(shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size))
                yield pa.record_batch(
                    {
                        "id": batch.column(0).slice(low, high - low).cast(pa.int64()),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_id": pa.array([_identity(s) if len(s) else None for s in sets], pa.binary()),
                        "signature": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    }
                )

    return docs.mapInArrow(run, "id long, n_shingles long, set_id binary, signature binary")


def _identity(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _labelled(nodes: DataFrame, places: np.ndarray) -> DataFrame:
    """(label, node) for each tree of each row (node, signature)."""

    def run(batches):
        for batch in batches:
            signed, nodes = _matrix(batch.column(1), 2 * BINS, np.uint16), batch.column(0).to_numpy()
            for low in range(0, len(nodes), 256):
                part = nodes[low : low + 256]
                yield pa.record_batch({"label": _binary(labels(signed[low : low + 256], places)), "node": pa.array(np.repeat(part, len(places)))})

    return nodes.mapInArrow(run, "label binary, node long")


def regions(label: np.ndarray, node: np.ndarray, prefix: int, few: int, near: int, at_border: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) among sorted labels, and which rows lie in crowded regions.

    A region is a run of labels with equal first `prefix` bytes. One of at most `few` rows pairs all of them; a larger
    one, or the first or last if it is at a border, is crowded and, in the first CHAINS trees, pairs each row with the `near`
    rows before it.
    """
    n = len(node)
    fresh = np.append(True, (label[1:, :prefix] != label[:-1, :prefix]).any(axis=1)) if n else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    crowded = sizes > few
    if n:
        crowded[0] |= at_border[0]
        crowded[-1] |= at_border[1]
    tree = label[starts, 0].astype(np.int64) << 8 | label[starts, 1] if n else starts
    reach = np.repeat(np.where(crowded, np.where(tree < CHAINS, near, 0), few), sizes)
    place = np.arange(n) - np.repeat(starts, sizes)
    a, b = [], []
    for shift in range(1, max(few, near + 1)):
        later = np.flatnonzero((place >= shift) & (reach >= shift))
        if not len(later) and shift > near:
            break
        a.append(node[later])
        b.append(node[later - shift])
    a, b = np.concatenate([*a, node[:0]]), np.concatenate([*b, node[:0]])
    return np.maximum(a, b), np.minimum(a, b), np.repeat(crowded, sizes)


def _neighbours(sorted_rows: DataFrame, prefix: int, few: int, near: int) -> DataFrame:
    """Of rows (label, node) sorted in each partition: candidates (a, b), and rows (region, a) of crowded regions.

    The regions at both ends of a partition count as crowded, for others may hold the rest of them. No more than a batch and
    a few rows are held.
    """

    def run(batches):
        label, node, border = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column(1).to_numpy()
            rows = _matrix(batch.column(0), len(batch.column(0)[0].as_py()))
            label, node = (rows, here) if label is None else (np.concatenate([label, rows]), np.concatenate([node, here]))
            changes = np.flatnonzero((label[1:, :prefix] != label[:-1, :prefix]).any(axis=1))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if last:
                yield from found(label[:last], node[:last], border, False)
                label, node, border = label[last:], node[last:], False
            if len(node) > few + near:  # the region that goes on is crowded: keep only what the next rows are paired with
                yield from found(label, node, True, True)
                label, node, border = label[-near:].copy(), node[-near:].copy(), True
        if node is not None:
            yield from found(label, node, border, True)

    def found(label, node, first, last):
        a, b, crowded = regions(label, node, prefix, few, near, (first, last))
        if len(a):
            yield pa.record_batch({"region": pa.nulls(len(a), pa.binary()), "a": pa.array(a), "b": pa.array(b)})
        if crowded.any():
            yield pa.record_batch({"region": _binary(label[crowded, :prefix]), "a": pa.array(node[crowded]), "b": pa.array(node[crowded])})

    return sorted_rows.mapInArrow(run, "region binary, a long, b long")


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = b.searchsorted(a)
    shared = int(np.count_nonzero(b.take(at, mode="clip") == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _close(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """(a, b, agree) of the pairs whose signatures agree in at least that share of positions."""

    def run(batches):
        for batch in batches:
            left, right = (_matrix(batch.column(i), 2 * BINS, np.uint16) for i in (2, 3))
            agree = np.count_nonzero(left == right, axis=1)
            some = pa.array(agree >= least * BINS)
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "agree": pa.array(agree.astype(np.int32))}).filter(some)

    left, right = (signatures.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}")) for x in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, agree int")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full shingle sets."""

    def run(batches):
        for batch in batches:
            same = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(same, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verify(percent: int, least: float):
    """Links of one group: the members of block i against those of block j of a family; enough to connect what is linked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "node"], kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        signed = np.array([signature(s) for s in sets])
        nodes, block, n = group["node"].to_numpy(), group["block"].to_numpy(), len(group)
        one = group["i"].iloc[0] == group["j"].iloc[0]
        sizes = np.array([len(s) for s in sets])
        # what is connected already starts so
        parent = np.unique(group["component"].to_numpy(), return_index=True)[1][np.unique(group["component"].to_numpy(), return_inverse=True)[1]]
        found = []
        for x in range(n - 1):
            others = np.arange(x + 1, n)
            if not one:
                others = others[block[others] != block[x]]
            others = others[(100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])) & (parent[others] != parent[x])]
            if not len(others):
                continue
            agree = np.count_nonzero(signed[others] == signed[x], axis=1)
            close = agree >= least * BINS
            others = others[close][np.argsort(-agree[close], kind="stable")]
            for y in others.tolist():
                top, other = _find(parent, x), _find(parent, y)
                if top != other and _linked(sets[x], sets[y], percent):
                    parent[max(top, other)] = min(top, other)
                    found.append((nodes[x], nodes[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _sets_of(nodes: DataFrame, firsts: DataFrame, source: DataFrame, words: int, broadcast_rows: int) -> DataFrame:
    """(node, shingles) of the nodes, from the texts of their representatives."""
    wanted = cut(firsts.select("node", "rep", "set_id").join(nodes, "node", "left_semi"))
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    texts = source.join(F.broadcast(ids) if wanted.count() <= broadcast_rows else ids, "id", "left_semi").select("text")

    def run(batches):
        for batch in batches:
            data, offsets = tx.buffers(batch.column(0))
            for low, high in tx.chunks(offsets):
                sets = list(shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words))
                yield pa.record_batch({"set_id": pa.array(map(_identity, sets), pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    found = texts.mapInArrow(run, "set_id binary, shingles binary").join(wanted, "set_id").select("node", "shingles")
    return cut(found.dropDuplicates(["node"]))


def _connected(pairs: DataFrame, firsts: DataFrame, source: DataFrame, known: DataFrame, percent: int, words: int, broadcast_rows: int) -> DataFrame:
    """The components known before, joined by what links the candidate pairs hold."""
    pairs = pairs.where("a <> b").distinct()
    close = cut(_close(pairs if known.isEmpty() else _apart(pairs, known), firsts, least_agreeing(percent)))
    if close.isEmpty():
        return known
    nodes = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    sets = _sets_of(nodes, firsts, source, words, broadcast_rows)
    best = close.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b")).union(close.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b"))
    known = extended(known, _exact(best.distinct(), sets, percent))
    return extended(known, _exact(_apart(close.select("a", "b"), known), sets, percent))


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components of known (node, component); a node without one is its own."""
    left, right = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75, words: int = 5,
    depths: list[tuple[int, int]] | None = None, few: int = 32, near: int = 1, block: int = 1024, settle: int = 8192, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row (id_col, n_shingles, component_id) for each row of docs; component_id is the smallest id of its component.

    Words are what ASCII white space separates, A-Z lower-cased; a document's set holds its distinct runs of `words`
    words, or its whole sequence if it has fewer. Two documents are linked if 100 * |intersection| >= percent * |union|.
    `depths` are (depth, trees) of the forests, derived from percent unless given: a pair at that similarity shares a
    region of some tree of each but for MISSED of the times. A region of at most `few` texts pairs all of them, in a
    larger one each is paired with its `near` neighbours, in CHAINS trees; texts of larger regions that this leaves unconnected go on to
    the next forest. After the last, or as soon as no more than `settle` are left, for which another forest would be more
    work, they are compared in blocks of at most about `block` texts and 8 MB of sets, which misses none.

    Texts that are null, empty or white space have the empty set and no links: their component is their own id. Rows
    that share an id are one document holding several texts: they link through the id and get the same component.
    A null id gets a null component and links nothing. No rows give no rows; other columns are ignored. A text
    of any length is read whole; only its own set, and that of one other, must fit a task. Order and ties of rows do not
    change the result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(_signatures(source, words))
    known = signed.where("id is not null and set_id is not null")

    # exact copies: one node for each distinct set
    firsts = known.groupBy("set_id").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min_by("signature", "id").alias("signature"))
    firsts = cut(firsts.withColumn("node", F.monotonically_increasing_id()))

    # rows of one id with several sets hang together through that id
    several = known.groupBy("id").agg(F.min(F.xxhash64("set_id")).alias("low"), F.max(F.xxhash64("set_id")).alias("high")).where("low <> high")
    owned = known.select("id", "set_id").distinct().join(several.select("id"), "id", "left_semi").join(firsts.select("set_id", "node"), "set_id")
    joined = components(owned.join(owned.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b"))

    todo = firsts.select("node", "signature")
    for depth, trees in depths or forests(percent):
        labelled = _labelled(todo, orders(depth, trees))
        ranged = labelled.repartitionByRange("label", "node").sortWithinPartitions("label", "node")
        found = cut(_neighbours(ranged, 2 + 2 * depth, few, near))
        joined = _connected(found.where("region is null").select("a", "b"), firsts, source, joined, percent, words, broadcast_rows)
        # crowded regions whose texts aren't all connected: each text with the region's smallest
        crowded = found.where("region is not null").select("region", F.col("a").alias("node"))
        component = F.coalesce("component", "node")
        open_ = crowded.join(joined, "node", "left").groupBy("region").agg(F.min("node").alias("hub"), F.min(component).alias("low"), F.max(component).alias("high"))
        open_ = cut(open_.where("low < high").select("region", "hub"))
        edges = cut(crowded.join(broadcast_if_small(open_, broadcast_rows), "region").select("node", "hub").distinct())
        left = edges.select("node").distinct()
        if left.count() <= settle:
            break
        todo = firsts.select("node", "signature").join(left, "node", "left_semi")
    if not edges.isEmpty():
        # families: what open regions hold together, in blocks of bounded size; each pair of blocks is a group
        families = components(edges.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "family")
        members = cut(families.join(joined, "node", "left").join(firsts.select("node", "n_shingles"), "node").select("node", "family", F.coalesce("component", "node").alias("component"), "n_shingles"))
        sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / (1 << 20))).cast("int").alias("blocks"))
        sets = _sets_of(members.select("node"), firsts, source, words, broadcast_rows)
        placed = members.join(sizes, "family").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        groups = spread.select("node", "family", "component", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        joined = extended(joined, groups.groupBy("family", "i", "j").applyInPandas(_verify(percent, least_agreeing(percent)), "a long, b long"))

    # from nodes to documents: a component is called by its smallest id
    named = firsts.select("set_id", "rep", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = cut(named.join(joined.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("low")))
    reps = named.join(broadcast_if_small(lowest, broadcast_rows), "component", "left").select("set_id", F.coalesce("low", "rep").alias("component_id"))
    # a row without a set gets a key of its own, so that these don't meet in one task
    rows = signed.select("id", "n_shingles", F.coalesce("set_id", F.unhex(F.hex(F.xxhash64("id")))).alias("set_id"))
    out = rows.join(reps, "set_id", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)
