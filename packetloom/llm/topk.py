"""Exact top-k inner-product search by dual cover trees (operator 5).

Distinct vectors are dealt into cells around pivots, as many as the table asks for, and cells into blocks of bounded
size. Every block of candidates and every group of queries holds a cover tree: a node's children stand around vectors of
its own, chosen one after the other as the farthest from those before, at least a step apart from each other, and cover
all of the node within that step. The step is at most half the node's radius; where the vectors are so spread that this
would take too many children, it is what MOST_CHILDREN of them reach, and the tree has more levels instead. A pair of nodes is dropped if the
largest inner product that centres and radii allow is below the worst k-th score of any query in the group's node; what
that leaves is held, by the same radius, against each query's own k-th score. Else the wider node is split, and pairs of
leaves are scored. A first round searches each query's own cell, so that the second knows a k-th score to prune whole
cells with. Results of all blocks are merged by a ranked window, whose first half runs before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .jobs import cut

LEAF = 64
#: Children of a node, and numbers of a table of vectors by cells that a task holds at once.
MOST_CHILDREN, STRIP = 64, 1 << 21


class CoverTree:
    """Nodes in arrays: rows[low[i]:high[i]] are the vectors below node i; a ball around centre[i] with radius[i] covers them.

    cover[i] is the vector that node i grew around and step[i] how far its children's reach (0 without children): all below
    a child lie within the step of its vector, and children's vectors are at least the step apart. The ball kept of each
    node for pruning is the one around its mean.
    """

    def __init__(self, vectors: np.ndarray):
        self.rows = np.arange(len(vectors))
        self.low, self.high, self.centre, self.radius, self.children, self.cover, self.step = [], [], [], [], [], [], []
        self._build(vectors)

    def _add(self, vectors: np.ndarray, low: int, high: int, cover: int) -> int:
        own = vectors[self.rows[low:high]]
        centre = own.mean(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.centre.append(centre)
        # a little more than the radius, for a mean is rounded
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9)
        self.children.append([])
        self.cover.append(cover)
        self.step.append(0.0)
        return len(self.low) - 1

    def _build(self, vectors: np.ndarray) -> None:
        todo = [self._add(vectors, 0, len(vectors), 0)] if len(vectors) else []
        while todo:
            node = todo.pop()
            low, high, cover = self.low[node], self.high[node], self.cover[node]
            if high - low <= LEAF:
                continue
            # the farthest is the next: what is left to reach never grows, so all chosen are at least as far apart
            rows = self.rows[low:high]
            nearest, owner, centres = ((vectors[rows] - vectors[cover]) ** 2).sum(axis=1), np.zeros(high - low, np.int64), [cover]
            reach = nearest.max()
            if reach == 0:
                continue
            while len(centres) < 2 or (nearest.max() > reach / 4 and len(centres) < min(MOST_CHILDREN, (high - low) // 16)):
                centres.append(int(rows[nearest.argmax()]))
                apart = ((vectors[rows] - vectors[centres[-1]]) ** 2).sum(axis=1)
                closer = apart < nearest
                nearest[closer], owner[closer] = apart[closer], len(centres) - 1
            self.step[node] = float(np.sqrt(nearest.max()))
            self.rows[low:high] = rows[np.argsort(owner, kind="stable")]
            ends = low + np.cumsum(np.bincount(owner, minlength=len(centres)))
            for c, a, b in zip(centres, [low, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b > a:
                    child = self._add(vectors, a, b, c)
                    self.children[node].append(child)
                    todo.append(child)


def search(queries: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], k: int, floor: np.ndarray, scored: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best ids among vectors, if at least its floor; ids[i] are vector i's, ascending.

    scored, if given, is added the number of pairs that were scored. Scores tie in favour of the smaller id. Vectors hold whole numbers whose products are exact in doubles.
    """
    left, right = CoverTree(queries), CoverTree(vectors)
    norm_q = np.sqrt((queries**2).sum(axis=1))
    centres_q, centres_v = np.array(left.centre), np.array(right.centre)
    apart_q, apart_v = np.sqrt((centres_q**2).sum(axis=1)), np.sqrt((centres_v**2).sum(axis=1))
    # ids and vectors in the tree's order, so that a leaf's are a slice
    ordered = [ids[r] for r in right.rows]
    counts = np.array([len(x) for x in ordered])
    flat, begin, placed = np.concatenate(ordered), np.append(0, counts.cumsum()), vectors[right.rows]
    single = bool((counts == 1).all())
    best_score, best_id = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    worst = floor.astype(np.float64).copy()

    def bound(a: int, b: int) -> float:
        ra, rb = left.radius[a], right.radius[b]
        return float(centres_q[a] @ centres_v[b]) + apart_q[a] * rb + apart_v[b] * ra + ra * rb

    todo = [(bound(0, 0), 0, 0)]
    while todo:
        most, a, b = todo.pop()
        mine = left.rows[left.low[a] : left.high[a]]
        if most < worst[mine].min() - 1e-6:
            continue
        # the same radius against each query by itself
        mine = mine[queries[mine] @ centres_v[b] + norm_q[mine] * right.radius[b] >= worst[mine] - 1e-6]
        if not len(mine):
            continue
        split_a, split_b = left.children[a], right.children[b]
        if split_a and (not split_b or left.radius[a] > right.radius[b]):
            pairs = [(bound(x, b), x, b) for x in split_a]
        elif split_b:
            pairs = [(bound(a, y), a, y) for y in split_b]
        else:
            low, high = right.low[b], right.high[b]
            scores = queries[mine] @ placed[low:high].T
            if scored is not None:
                scored.append(scores.size)
            if not single:
                scores = np.repeat(scores, counts[low:high], axis=1)
            query, vector = np.nonzero(scores >= worst[mine][:, None])
            if len(query):
                # what passes, and what these queries hold, in order of query, score and id; the first k of each stay
                some = np.unique(query)
                held = np.repeat(some, k)
                who = np.concatenate([held, query])
                all_scores = np.concatenate([best_score[mine[some]].ravel(), scores[query, vector]])
                all_ids = np.concatenate([best_id[mine[some]].ravel(), flat[begin[low] + vector]])
                order = np.lexsort((all_ids, -all_scores, who))
                start = np.searchsorted(who[order], some)
                first = order[(start[:, None] + np.arange(k)).ravel()].reshape(len(some), k)
                best_score[mine[some]], best_id[mine[some]] = all_scores[first], all_ids[first]
                worst[mine[some]] = np.maximum(worst[mine[some]], all_scores[first][:, -1])
            continue
        pairs.sort()  # the most promising is taken first
        todo += pairs
    query, place = np.nonzero((best_score > -np.inf) & (best_score >= floor[:, None]))
    return query, best_id[query, place], best_score[query, place]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    if (column.map(len) == width).all():
        return np.stack(column.to_numpy())
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _strips(rows: int, cells: int) -> list[slice]:
    """Ranges of rows whose table by cells holds STRIP numbers at most."""
    step = max(1, STRIP // max(cells, 1))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _searched(k: int):
    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        width = max(map(len, [*queries["v"], *vectors["v"]]))
        q, v = _matrix(queries["v"], width), _matrix(vectors["v"], width)
        found = search(q, v, [np.asarray(x, np.int64) for x in vectors["ids"]], k, queries["floor"].to_numpy(np.float64))
        return pd.DataFrame({"q": queries["q"].to_numpy()[found[0]], "vec_id": found[1], "score": found[2].astype(np.int64)})

    return run


def _groups(centres: np.ndarray, sizes: dict[int, int], group: int) -> tuple[list[int], list[int]]:
    """For each cell its first group and number of groups. Cells with few queries share a group with cells near them."""
    first, many = [0] * len(centres), [1] * len(centres)
    left, at, used, now = set(range(len(centres))), 0, 0, 0
    while left:
        left.remove(at)
        n = sizes.get(at, 0)
        if used and used + n > group:
            now, used = now + 1, 0
        first[at], many[at] = now, max(1, -(-n // group))
        used += n
        if many[at] > 1:
            now, used = now + many[at], 0
        if left:
            rest = np.array(sorted(left))
            at = int(rest[((centres[rest] - centres[at]) ** 2).sum(axis=1).argmin()])
    return first, many


def _ranked(results: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(
    embeddings: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, cells: int = 4096, block: int = 4096, group: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query holds, the k other rows of largest inner product.

    Components become floor(scale * x) first; ties go to the smaller id; a query with fewer than k other rows gets them
    all. Rows whose vector is null or holds a null or non-finite component, or whose id is null, take no part. Shorter
    vectors count as if filled with zeros. Rows that repeat an id count once; of different vectors the smallest counts, compared
    component by component. No rows give none; other columns are ignored. Whole components must stay below 2**23, so that
    scores are exact in doubles: a larger one, which would make any score that it enters inexact, fails the job with an error.

    Equal vectors are one candidate that holds its k + 1 smallest ids, all that any query can need. Pivots are at
    most `cells` vectors, about one for every half a block; blocks and groups hold about `block` and `group` vectors,
    and what every task gets is one group and one block. A block is copied once for each group that may find something in
    its cell, which is one copy of a vector for about `group` scores.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), is_query.alias("is_query"))
    rows = rows.withColumn("v", F.when(F.exists("v", lambda x: F.abs(x) >= 2**23), F.raise_error(F.lit("a component is too large"))).otherwise(F.col("v")))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("is_query").alias("is_query"))
    ranked = rows.select("id", "v").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    cells = max(1, min(cells, distinct.count() // (block // 2)))
    pivots = [np.array(r["v"]) for r in distinct.select("v").orderBy(F.xxhash64("v")).limit(cells).collect()]  # bounded by cells
    if not pivots:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    width = max(map(len, pivots))
    centres = np.zeros((len(pivots), width))
    for i, p in enumerate(pivots):
        centres[i, : len(p)] = p

    @F.pandas_udf("struct<cell:int,apart:double,norm:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        size = max(width, max(map(len, v)))
        m, c = _matrix(v, size), np.pad(centres, ((0, 0), (0, size - width)))
        norms, own = (m**2).sum(axis=1), (c**2).sum(axis=1)
        best, least = np.zeros(len(m), np.int32), np.zeros(len(m))
        for strip in _strips(len(m), len(c)):
            apart = norms[strip, None] - 2 * m[strip] @ c.T + own
            best[strip] = apart.argmin(axis=1)
            least[strip] = apart.min(axis=1)
        return pd.DataFrame({"cell": best, "apart": np.sqrt(np.maximum(least, 0)), "norm": np.sqrt(norms)})

    placed = cut(distinct.withColumn("x", nearest("v")).select("v", "ids", "x.*"))
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()  # at most `cells` rows
    blocks = {r["cell"]: -(-r["n"] // block) for r in about}
    radius = {r["cell"]: r["radius"] for r in about}
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
    in_block = F.pmod(F.xxhash64("v"), F.get(numbers(blocks.get(c, 1) for c in range(len(pivots))), F.col("cell"))).cast("int")
    candidates = placed.select("v", "ids", "cell", in_block.alias("block"))

    # one query for each distinct vector that any query row has; its floor is what the round before has found
    asked = cut(rows.where("is_query").select("id", F.col("v").alias("v")).distinct())
    queries = cut(placed.join(asked.select("v").distinct(), "v", "left_semi").withColumn("q", F.element_at("ids", 1)).select("q", "v", "cell", "norm"))
    deal = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
    first_group, groups = _groups(centres, deal, group)
    place = lambda xs: F.get(numbers(xs), F.col("cell"))
    in_group = (place(first_group) + F.pmod(F.xxhash64("q"), place(groups))).cast("int")
    queries = queries.withColumn("group", in_group).withColumn("home", F.col("cell"))

    def sought(routed: DataFrame) -> DataFrame:
        """Results of queries routed to (cell, block), each group of queries against each block."""
        pairs = routed.select(F.col("group").alias("group2"), F.col("cell").alias("cell2"), F.col("block").alias("block2")).distinct()
        here = candidates.select(F.col("v").alias("v2"), "ids", F.col("cell").alias("cell1"), F.col("block").alias("block1"))
        copies = here.join(pairs, (F.col("cell1") == F.col("cell2")) & (F.col("block1") == F.col("block2"))).select(F.col("v2").alias("v"), "ids", "group2", "cell2", "block2")
        left, right = routed.groupBy("group", "cell", "block"), copies.groupBy("group2", "cell2", "block2")
        return left.cogroup(right).applyInPandas(_searched(k + 1), "q long, vec_id long, score long")

    block_counts = numbers(blocks.get(c, 0) for c in range(len(pivots)))
    each_block = lambda cell: F.sequence(F.lit(0), F.get(block_counts, cell) - 1)
    first = cut(_ranked(sought(queries.withColumn("floor", F.lit(float("-inf"))).withColumn("block", F.explode(each_block(F.col("cell"))))), k + 1))
    floors = first.groupBy("q").agg(F.when(F.count("*") == k + 1, F.min("score")).cast("double").alias("floor"))
    bounded = queries.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    @F.pandas_udf("array<int>")
    def reachable(v: pd.Series, norm: pd.Series, floor: pd.Series, home: pd.Series) -> pd.Series:
        size = max(width, max(map(len, v)))
        m, c = _matrix(v, size), np.pad(centres, ((0, 0), (0, size - width)))
        norm, floor, home = norm.to_numpy(), floor.to_numpy(), home.to_numpy()
        wide, none = np.array([radius.get(i, -np.inf) for i in range(len(c))]), [i for i in range(len(c)) if i not in radius]
        found = []
        for strip in _strips(len(m), len(c)):
            most = m[strip] @ c.T + norm[strip, None] * wide
            most[:, none] = -np.inf
            most[np.arange(len(most)), home[strip]] = -np.inf
            found += [np.flatnonzero(x).astype(np.int32) for x in (most >= floor[strip, None] - 1e-6) & (most > -np.inf)]
        return pd.Series(found)

    routed = bounded.withColumn("cell", F.explode(reachable("v", "norm", "floor", "home"))).withColumn("block", F.explode(each_block(F.col("cell"))))
    merged = cut(_ranked(first.select("q", "vec_id", "score").union(sought(routed)), k + 1).drop("rank"))
    by_vector = queries.select("q", "v").join(asked, "v").select("q", F.col("id").alias("query_id"))
    own = by_vector.join(merged, "q").where("vec_id <> query_id").drop("q").withColumnRenamed("query_id", "q")
    return _ranked(own, k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
