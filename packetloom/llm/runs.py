"""Periodic runs of words (operator 13).

A run is a stretch of words that repeats itself with some period and that no neighbouring word extends. Each run of
smallest period q ends in a square, two equal halves of q words, that the next word breaks: in the suffix array its two
halves' suffixes lie in different children of one LCP interval of depth q. So every interval is asked, for each suffix i
of all children but its largest, whether the suffixes i + depth and i - depth are in the interval too, by their places
in the inverse array; no tree is built. Such a square is then moved left word by word as long as it stays one, which
gives the run's start, and squares that end at one word and belong to one run are merged.

Only repeats count that a wanted run must hold: a run of at least min_length words and min_exponent periods holds, for
some multiple of its period from `least_depth` on, two adjacent halves that long. So the array is made of the suffixes
whose first least_depth words occur twice in their text, and of those that comparing them needs. Suffixes are sorted by
doubling; the ranks of all rounds give the lengths of common prefixes. Texts are worked on by the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import text as tx

#: Suffixes that the membership test looks at in one step, and words that are copied in one step; only memory depends on them.
STEP = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_depth(min_length: int, min_exponent: int) -> int:
    """The most words t so that in every wanted run of period q two halves of ceil(t / q) periods are adjacent."""
    fits = lambda t: all(2 * -(-t // q) * q <= max(min_length, min_exponent * q) for q in range(1, t))
    return next(t for t in range(max(min_length, 2) // 2, 0, -1) if fits(t))


class _Suffixes:
    """Sorted suffixes whose first `depth` words occur twice in their text, and the lengths of their common prefixes.

    words holds numbers of words, texts apart from each other by depth zeros at least, which no word is.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, twice: np.ndarray, depth: int):
        self.at = at = np.union1d(twice, twice + depth)
        self.number = np.full(len(words) + depth, -1, np.int32)  # of the suffix at a word
        self.number[at] = np.arange(len(at), dtype=np.int32)
        keys = [words[at + k] for k in range(depth - 1, -1, -1)] + [text[at]]
        order = np.lexsort(keys)
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = self._ranks(order, new, np.arange(len(at)))
        first, levels, length = rank, [], depth
        while True:
            levels.append((length, rank))
            sizes = np.bincount(rank, minlength=len(at))
            open_ = np.flatnonzero(sizes[rank[order]] > 1)  # places in the order, those of a group side by side
            if not len(open_):
                break
            suffix = order[open_]
            key = rank[suffix].astype(np.int64) * (len(at) + 1) + rank[self.number[at[suffix] + length]]
            by = np.argsort(key, kind="stable")
            order[open_], key = suffix[by], key[by]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[order[open_]] = self._ranks(np.arange(len(key)), new, open_)
            length *= 2
        self.order, self.place = order, rank  # all ranks differ now
        self.common = np.zeros(len(at) + 1, np.int64)  # with the suffix before; the last is a sentinel
        near = np.flatnonzero(first[order][1:] == first[order][:-1]) + 1
        x, y = at[order[near - 1]], at[order[near]]
        begin = x.copy()
        for length, ranks in reversed(levels):
            same = ranks[self.number[x]] == ranks[self.number[y]]
            x[same] += length
            y[same] += length
        going = np.ones(len(x), bool)
        for _ in range(depth - 1):
            going &= (words[x] == words[y]) & (words[x] > 0)
            x[going] += 1
            y[going] += 1
        self.common[near] = x - begin

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The rank of a group is the place of its first member."""
        out = np.empty(len(order), np.int32)
        out[order] = places[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return out

    def children(self) -> tuple[np.ndarray, ...]:
        """Of all LCP intervals, the children but one largest: depth, the interval's range and the child's range of places."""
        common = self.common.tolist()
        n = len(common)
        before, lower, upper, last = [0] * n, [0] * n, [0] * n, [True] * n
        stack: list[int] = []
        for j, length in enumerate(common):
            while stack and common[stack[-1]] > length:
                upper[stack.pop()] = j
            if not length:
                stack = [j]
                continue
            top = stack[-1]
            before[j] = top
            if common[top] == length:
                lower[j], last[top] = lower[top], False
            else:
                lower[j] = top
            stack.append(j)
        split = np.flatnonzero(self.common)
        before, lower, upper, last = (np.array(a)[split] for a in (before, lower, upper, last))
        depth = self.common[split]
        end = split[last]
        depth, lower, upper = np.append(depth, depth[last]), np.append(lower, lower[last]), np.append(upper, upper[last])
        low, high = np.append(before, end), np.append(split, upper[len(split) :])
        by = np.lexsort((high - low, upper, lower))  # the largest child is the last of its interval
        small = np.zeros(len(by), bool)
        small[:-1] = (lower[by][1:] == lower[by][:-1]) & (upper[by][1:] == upper[by][:-1])
        by = by[small]
        return depth[by], lower[by], upper[by], low[by], high[by]


def _squares(found: _Suffixes, depth: int, cubes: bool) -> np.ndarray:
    """(end, half) of the squares that the next word breaks, sorted; of halves of 2 * depth - 1 words and more only if cubes follow."""
    length, lower, upper, low, high = found.children()
    sums = np.append(0, np.cumsum(high - low))
    out, begin = [np.zeros((0, 2), np.int64)], 0
    while begin < len(length):
        stop = max(begin + 1, int(np.searchsorted(sums, sums[begin] + STEP, side="right")) - 1)
        child = np.repeat(np.arange(begin, stop), (high - low)[begin:stop])
        place = np.arange(len(child)) - (sums[child] - sums[begin]) + low[child]
        i, half = found.at[found.order[place]], length[child]
        for other, start in ((i + half, i), (i - half, i - half)):
            inside = _member(found, other, lower[child], upper[child])
            inside &= ~_member(found, other, low[child], high[child])
            p, q = start[inside], half[inside]
            if cubes:
                kept = (q < 2 * depth - 1) | _member(found, p - q, lower[child][inside], upper[child][inside])
                p, q = p[kept], q[kept]
            out.append(np.stack([p + 2 * q, q], axis=1))
        begin = stop
    return np.unique(np.concatenate(out), axis=0)


def _member(found: _Suffixes, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    number = found.number[np.clip(at, 0, len(found.number) - 1)]
    place = found.place[number]
    return (at >= 0) & (number >= 0) & (place >= low) & (place < high)


def _rotations(words: np.ndarray, start: int, half: int) -> int:
    """By how many words a square can be moved left and stay one."""
    moved, step = 0, 16
    while True:
        step = min(step, start - moved)
        a = words[start - moved - step : start - moved]
        differs = np.flatnonzero((a != words[start + half - moved - step : start + half - moved]) | (a == 0))
        if len(differs):
            return moved + step - 1 - int(differs[-1])
        moved, step = moved + step, 2 * step


def _period(words: np.ndarray, start: int, end: int, period: int) -> int:
    """The smallest period of a stretch that has this one at least twice."""
    for q in range(1, period // 2 + 1):
        if period % q == 0 and np.array_equal(words[start : end - q], words[start + q : end]):
            return q
    return period


def runs_of(words: np.ndarray, text: np.ndarray, grams: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) of all runs, sorted by start, then period. Zeros part the texts; grams tells equal least_depth words."""
    depth = least_depth(min_length, min_exponent)
    whole = np.flatnonzero((words[: len(grams)] > 0) & (words[depth - 1 : depth - 1 + len(grams)] > 0))
    key = grams[whole] + tx.mix(text[whole].astype(np.uint64))
    by = np.argsort(key)
    equal = key[by][1:] == key[by][:-1]
    twice = np.unique(whole[by[np.append(np.flatnonzero(equal), np.flatnonzero(equal) + 1)]])
    if not len(twice):
        return np.zeros((0, 3), np.int64)
    squares = _squares(_Suffixes(words, text, twice, depth), depth, min_exponent > 2)
    out, i = [], 0
    groups = np.searchsorted(squares[:, 0], np.unique(squares[:, 0]), side="right")
    for stop in groups.tolist():
        while i < stop:
            end, half = squares[i].tolist()
            start = end - 2 * half
            start -= _rotations(words, start, half)
            period = _period(words, start, end, half) if half < 2 * depth - 1 else half
            if end - start >= max(min_length, min_exponent * period):
                out.append((start, end - start, period))
            # squares of the same end with halves up to the run's length less this half are of the same run
            i += int(np.searchsorted(squares[i:stop, 1], end - start - half, side="right"))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _joined(words: tx.Words, kept: np.ndarray) -> bytes:
    """The kept words joined by one space."""
    parts = []
    for begin in range(0, len(kept), STEP // 16):
        some = kept[begin : begin + STEP // 16]
        starts, sizes = words.starts[some], words.ends[some] - words.starts[some] + 1
        sums = np.cumsum(sizes)
        source = np.arange(sums[-1]) + np.repeat(starts - (sums - sizes), sizes)
        source[sums - 1] = 0
        part = words.data[source]
        part[sums - 1] = 32
        parts.append(part.tobytes())
    return b"".join(parts)[:-1]


def _chunk(data: np.ndarray, offsets: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: the number of words, its runs (with the text's number before), and its words without repeats."""
    words, depth = tx.Words(data, offsets, tx.NONSPACE, tx.AS_IS), least_depth(min_length, min_exponent)
    n = np.diff(words.bounds)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) + depth * (text + 1)
    size = len(text) + depth * (len(n) + 2)
    hashes, numbers, texts = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    hashes[place] = words.hashes()
    numbers[place] = np.unique(hashes[place], return_inverse=True)[1] + 1
    texts[:] = np.searchsorted(words.bounds[1:] + depth * (np.arange(len(n)) + 2), np.arange(size), side="right")
    found = runs_of(numbers, texts, tx.rolling(hashes, depth), min_length, min_exponent)
    owner = texts[found[:, 0]]
    first = found[:, 0] - depth * (owner + 1)  # among the words of all texts
    dropped = np.zeros(len(text) + 1, np.int64)
    np.add.at(dropped, first + found[:, 2], 1)
    np.add.at(dropped, first + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    edges = np.searchsorted(kept, words.bounds)
    joined = [_joined(words, kept[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return n, np.column_stack([owner, first - words.bounds[owner], found[:, 1:]]), joined


def find_runs(docs: DataFrame, *, text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """docs with n_words, runs and collapsed added, one row for each row; all other columns stay.

    Words are what ASCII white space parts, numbered from 0. runs holds (start, length, period) of every run of min_length
    words and min_exponent periods at least, by start, then period, its period the smallest. collapsed has the words
    joined by one space, but for those that lie in some run after its first period. A null or empty text has no words, no
    runs and an empty collapsed text. Rows may repeat and are each worked on alone; no rows give none. Columns of docs
    named like the new ones are replaced. A text of any length is worked on whole, in one task: some 200 bytes of memory
    for each of its words that lies in a repeat.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run takes two words and two periods at least")
    docs = docs.drop(*(c for c in ("n_words", "runs", "collapsed") if c != text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = tx.buffers(batch.column(at))
            for low, high in tx.chunks(offsets):
                n, found, joined = _chunk(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], min_length, min_exponent)
                bounds = np.searchsorted(found[:, 0], np.arange(high - low + 1))
                runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)
                part = batch.slice(low, high - low)
                columns = [*part.columns, pa.array(n, pa.int64()), runs, pa.array(joined, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, names=[*part.schema.names, "n_words", "runs", "collapsed"])

    row = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    schema = StructType([*docs.schema.fields]).add("n_words", LongType()).add("runs", ArrayType(row)).add("collapsed", StringType())
    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period, ties to the smallest start, then period; null without runs."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (y > x), b).otherwise(a)  # runs come by start, then period

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def planted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with a repeat made at the end of about a tenth of the texts: those whose h = crc32(id) ends in 0.

    With g = h div 10 and n words, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    Other texts, and those without words, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.withColumn("_words", words).withColumn("_n", F.size("_words")).withColumn("_g", F.floor(h / 10))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    index = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    text = F.when(F.col("_n") > 0, F.array_join(F.transform(index, lambda i: F.get("_words", i)), " ")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).drop("_words", "_n", "_g", "_a", "_p")
