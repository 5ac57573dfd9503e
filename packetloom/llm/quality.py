"""Quality scores by Bradley-Terry pairwise ranking (operator 11).

A text is described by a few numbers about its characters, words and lines. In a preference pair a text of label 1 beats
one of label 0; that it does so with probability sigmoid(w * (difference of their numbers)) is fitted by Newton's method
on the logistic loss. Labelled rows are dealt into parts of about PART_ROWS; within a part each row meets ROUNDS rows
of the other label, so there are at most ROUNDS pairs a row. Spark sums the parts' gradients in every step, as whole
numbers, so that the result doesn't depend on their order. The threshold is the quantile of the labelled rows' scores
that tells the labels apart best; a text's score is the probability that it beats a text at the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

from . import text as tx
from .jobs import cut

PART_ROWS, ROUNDS, STEPS = 1024, 8, 8
#: Quantiles of the labelled rows' scores among which the threshold is chosen, and the bins in which they are counted.
QUANTILES, BINS, BIN_WIDTH = 1000, 4096, 1 / 32
#: Weight of the squared weights beside the pairs' mean loss.
RIDGE = 1e-3
_FIXED = float(1 << 24)  # sums are in whole numbers of this part
_LIMIT = 6.0  # standard deviations beyond which a number counts as this

_CLASS = np.full(256, 5, dtype=np.int64)  # symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = 6  # marks of ordinary sentences

NUMBERS = (
    "log_bytes", "log_words", "lower", "upper", "digits", "beyond_ascii", "symbols", "marks", "mean_word", "long_words", "capital_words", "symbol_words", "letterless_words",
    "distinct_words", "repeated_words", "distinct_pairs", "mean_line", "distinct_lines", "entropy",
)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has; owners ascend."""
    if not len(keys):
        return np.zeros(n)
    key = keys + tx.mix(owner.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    return np.bincount(owner[first], minlength=n).astype(float)


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The NUMBERS of consecutive whole texts, a row for each; those of an empty text are all 0."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASS[data]
    counts = np.bincount(owner * 7 + kinds, minlength=7 * n).reshape(n, 7).astype(float)
    shown = np.maximum(counts[:, 1:].sum(axis=1), 1)
    words = tx.Words(data, offsets, tx.NONSPACE)
    n_words = np.diff(words.bounds)
    some = np.maximum(n_words, 1)
    of = np.repeat(np.arange(n), n_words)

    def share(which: np.ndarray) -> np.ndarray:
        return np.bincount(of[which], minlength=n) / some

    def within(kind: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(kind))
        return sums[words.ends] - sums[words.starts]

    length = words.ends - words.starts
    letters = within((kinds == 1) | (kinds == 2) | (kinds == 4))
    capital, symbols = within(kinds == 2), within(kinds == 5)
    hashes = words.hashes() if len(of) else np.zeros(0, np.uint64)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) + 1
    pairs = tx.rolling(hashes, 2)
    inner = np.flatnonzero(of[1:] == of[:-1])
    lines = tx.Words(data, offsets, _NOT_NEWLINE)
    n_lines = np.maximum(np.diff(lines.bounds), 1)
    line_of = np.repeat(np.arange(n), np.diff(lines.bounds))
    hist = np.bincount(owner * 256 + words._lower, minlength=256 * n).reshape(n, 256) / np.maximum(sizes, 1)[:, None]
    columns = [
        np.log1p(sizes), np.log1p(n_words), *(counts[:, k] / shown for k in range(1, 7)), np.bincount(of, length, n) / some, share(length > 20), share((capital > 1) & (2 * capital > letters)),
        share(symbols > 0), share(letters == 0), _distinct(hashes, of, n) / some, share(again), _distinct(pairs[inner], of[inner], n) / np.maximum(n_words - 1, 1),
        np.log1p(n_words / n_lines), _distinct(lines.hashes() if len(line_of) else np.zeros(0, np.uint64), line_of, n) / n_lines, -(hist * np.log2(np.where(hist > 0, hist, 1))).sum(axis=1),
    ]
    out = np.column_stack(columns)
    out[sizes == 0] = 0
    return out


_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[[10, 13]] = False


def _described(texts: pa.Array) -> np.ndarray:
    data, offsets = tx.buffers(texts)
    parts = [describe(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in tx.chunks(offsets)]
    return np.concatenate([np.zeros((0, len(NUMBERS))), *parts])


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the column numbers (the NUMBERS of the whole text, as bytes) in place of the text; all other columns stay.

    A null text counts as empty. Texts may be of any length; rows may repeat; no rows give none. This is the one pass over
    the texts: train and score take what it gives, which is some 150 bytes a row. A column of docs named numbers is replaced.
    """
    docs = docs.drop(*(["numbers"] if text_col != "numbers" else []))
    at = docs.columns.index(text_col)
    names = [n for n in docs.columns if n != text_col]

    def run(batches):
        for batch in batches:
            numbers = pa.array([row.tobytes() for row in _described(batch.column(at))], pa.binary())
            yield pa.record_batch([*(batch.column(n) for n in names), numbers], names=[*names, "numbers"])

    return docs.mapInArrow(run, StructType([f for f in docs.schema.fields if f.name != text_col]).add("numbers", BinaryType()))


def _parts(batch: pa.RecordBatch):
    """(good: bool array, numbers: a row for each labelled row) of every part of a batch."""
    for labels, numbers in zip(batch.column(0), batch.column(1), strict=True):
        yield np.array(labels.as_py(), np.int64) == 1, np.frombuffer(b"".join(numbers.as_py())).reshape(-1, len(NUMBERS))


def standard(numbers: np.ndarray, model: Model) -> np.ndarray:
    return np.clip((numbers - model.mean) / model.scale, -_LIMIT, _LIMIT)


def pairs(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (winner, loser) pairs of a part: in each of ROUNDS rounds every row of the more frequent label meets one of the other."""
    wins, loses = np.flatnonzero(good), np.flatnonzero(~good)
    most = max(len(wins), len(loses)) if len(wins) and len(loses) else 0
    i = np.arange(most)
    out = [(wins[(i + k * (len(wins) < len(loses))) % len(wins)], loses[(i + k * (len(wins) >= len(loses))) % len(loses)]) for k in range(ROUNDS if most else 0)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in out)]), np.concatenate([none, *(b for _, b in out)])


def _sums(parts: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all parts of f(good, numbers), `size` numbers; each task sums its own first. The driver gets `size` rows."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for good, numbers in _parts(batch):
                total += np.round(f(good, numbers) * _FIXED).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(some), "v": pa.array(total[some])})

    out = np.zeros(size)
    for k, v in parts.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[k] = v / _FIXED
    return out


def train(rows: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model of all measured rows whose label is 0 or 1. Rows may repeat; each counts; a null id is one like others.

    Without rows of both labels there is nothing to rank: all weights are 0 and every text scores a half. The driver
    gets sums of fixed size only, whatever the number of rows.
    """
    d = len(NUMBERS)
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), "numbers").where("label in (0, 1)")
    tie = F.xxhash64("id", F.md5("numbers"))
    rows = cut(rows.select(tie.alias("tie"), "label", "numbers"))
    n_parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = rows.groupBy(F.pmod(F.xxhash64(F.lit(11), "tie"), F.lit(n_parts)).alias("part"))
    packed = dealt.agg(F.array_sort(F.collect_list(F.struct("tie", "label", "numbers"))).alias("x"))
    parts = cut(packed.select(F.transform("x", lambda r: r["label"]).alias("labels"), F.col("x.numbers").alias("numbers")))

    moments = _sums(parts, lambda good, x: np.concatenate([[len(x), good.sum()], x.sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * d)
    n, n_good = moments[:2]
    mean = moments[2 : 2 + d] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + d :] / max(n, 1) - mean * mean, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(d))
    if not 0 < n_good < n:
        return model

    upper = np.triu_indices(d)
    for _ in range(STEPS):

        def step(good, numbers, model=model):
            x = standard(numbers, model)
            win, lose = pairs(good)
            apart = x[win] - x[lose]
            p = 1 / (1 + np.exp(np.clip(apart @ model.weights, -30, 30)))
            return np.concatenate([[len(win)], p @ apart, ((apart * (p * (1 - p))[:, None]).T @ apart)[upper]])

        found = _sums(parts, step, 1 + d + len(upper[0]))
        if not found[0]:
            break
        curve = np.zeros((d, d))
        curve[upper] = found[1 + d :] / found[0]
        curve = curve + np.triu(curve, 1).T + RIDGE * np.eye(d)
        move = np.linalg.solve(curve, found[1 : 1 + d] / found[0] - RIDGE * model.weights)
        weights = model.weights + move / max(1.0, np.abs(move).max())  # at most 1 a step: far steps overshoot where labels are told apart fully
        model = Model(model.mean, model.scale, np.round(weights, 9))
    return Model(model.mean, model.scale, model.weights, _threshold(parts, model))


def _threshold(parts: DataFrame, model: Model) -> float:
    """Of the quantiles of the labelled rows' scores the one that most rows are on the right side of; ties to the lowest."""

    def count(good, numbers):
        place = np.clip(np.floor(standard(numbers, model) @ model.weights / BIN_WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)
        return np.bincount(place * 2 + good, minlength=2 * BINS)

    found = _sums(parts, count, 2 * BINS).reshape(BINS, 2)
    below = np.vstack([np.zeros(2), np.cumsum(found, axis=0)])  # of bins before a bin
    places = np.searchsorted(below.sum(axis=1), np.arange(QUANTILES + 1) / QUANTILES * found.sum())
    places = np.unique(np.clip(places, 0, BINS))
    right = below[places, 0] + found[:, 1].sum() - below[places, 1]
    # the middle of bins that hold no row, for any edge among them is the same quantile
    first = int(places[right.argmax()])
    empty = np.flatnonzero(found[:first].sum(axis=1))
    return float(((first + (empty[-1] + 1 if len(empty) else first)) / 2 - BINS // 2) * BIN_WIDTH)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Measured rows with the column score, from 0 to 1 (higher, better), in place of their numbers; all other columns stay.

    Rows may repeat; no rows give none. A column of rows named score is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop("score")
    names = [n for n in rows.columns if n != "numbers"]

    def run(batches):
        model = shared.value
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column("numbers").to_pylist())).reshape(-1, len(NUMBERS))
            margin = standard(numbers, model) @ model.weights - model.threshold
            found = pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.record_batch([*(batch.column(n) for n in names), found], names=[*names, "score"])

    return rows.mapInArrow(run, StructType([f for f in rows.schema.fields if f.name != "numbers"]).add("score", DoubleType()))
