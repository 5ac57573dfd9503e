"""Language ID by error-correcting output codes (operator 9).

Every language gets a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the languages
whose bit is 1 from those whose bit is 0. Its weights are log-odds of n-gram counts, which Spark sums over all training
rows. A second pass measures how often each classifier is right on each language. Decoding sums, over the bits, the
loss of a classifier's margin against a codeword's bit, weighted by that accuracy; the codeword of least loss wins, and
a text whose two best codewords are nearly as good is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from . import text as tx
from .jobs import cut

FEATURES = 1 << 14
#: Languages whose counts a task holds at once (of FEATURES numbers each) before it passes them on.
LANGUAGES_HELD = 256
#: Mean log-odds of an n-gram times this is a margin of about 1 for a text of plain words.
SHARPNESS = 4.0

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all distinct splits up to 5 languages, else the best of seeded draws."""
    if n <= 5:
        splits = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** max(n - 1, 0) - 1)]
        return np.array(splits, np.float32).T.reshape(n, len(splits))
    bits, random = max(15, 4 * int(np.ceil(np.log2(n)))), np.random.default_rng(9)
    if n > 1000:  # words of 4 bits for each that n needs are far apart as they are drawn; only equal ones are drawn anew
        codes = random.choice(np.array([-1, 1], np.float32), (n, bits))
        while len(again := np.setdiff1d(np.arange(n), np.unique(codes, axis=0, return_index=True)[1])):
            codes[again] = random.choice(np.array([-1, 1], np.float32), (len(again), bits))
        return codes
    best, most = None, -1
    for _ in range(200):
        codes = random.choice(np.array([-1, 1], np.float32), (n, bits))
        if (np.abs(codes.sum(axis=0)) == n).any():
            continue
        apart = int(((bits - codes @ codes.T) / 2 + bits * np.eye(n)).min())
        if apart > most:
            best, most = codes, apart
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three bytes (letters lower-cased, all else a space), and each text's range of them."""
    folded = _FOLD[data].astype(np.uint32)
    n = len(folded)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    padded = np.append(folded, [32, 32]).astype(np.uint32)
    one, two = padded[1 : n + 1].copy(), padded[2 : n + 2].copy()
    ends = offsets[1:]
    ends = ends[ends > offsets[:-1]]
    one[ends - 1], two[ends - 1] = 32, 32
    two[np.maximum(ends - 2, 0)] = 32
    three = (folded << np.uint32(16)) | (one << np.uint32(8)) | two
    dull = (folded == 32) & (one == 32)
    hashed = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    keep = np.flatnonzero(~dull)
    return hashed[keep].astype(np.int64), np.searchsorted(keep, offsets)


def _margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text and bit: the classifier's mean log-odds, sharpened."""
    found, bounds = features(data, offsets)
    counts = np.diff(bounds)
    out = np.zeros((len(counts), weights.shape[1]), np.float64)
    some = np.flatnonzero(counts)
    if len(some):
        for b in range(weights.shape[1]):
            out[some, b] = np.add.reduceat(weights[:, b][found], bounds[:-1][some])
        out[some] *= SHARPNESS / counts[some][:, None]
    return out


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows (lang, text); each task sums before the shuffle."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(sums) > LANGUAGES_HELD:
                yield from passed(sums)
                sums = {}
            data, offsets = tx.buffers(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for low, high in tx.chunks(offsets):
                found, bounds = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                which = np.repeat(names[low:high], np.diff(bounds))
                for name in set(names[low:high]):
                    total = sums.setdefault(name, np.zeros(FEATURES, np.int64))
                    total += np.bincount(found[which == name], minlength=FEATURES)
        yield from passed(sums)

    def passed(sums):
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([name] * len(some), pa.string()), "feature": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    return rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def _right(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, bit, n, right): on how many rows of a language each classifier has the codeword's bit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        number = {x: i for i, x in enumerate(model.languages)}
        seen, right = np.zeros(len(number), np.int64), np.zeros(model.codes.shape, np.int64)
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for low, high in tx.chunks(offsets):
                margin = _margins(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], model.weights)
                mine = langs[low:high]
                np.add.at(seen, mine, 1)
                np.add.at(right, mine, (margin * model.codes[mine] > 0).astype(np.int64))
        lang, bit = np.indices(right.shape).reshape(2, -1)
        yield pa.record_batch({"lang": pa.array(lang.astype(np.int32)), "bit": pa.array(bit.astype(np.int32)), "n": pa.array(seen[lang]), "hits": pa.array(right.ravel())})

    return rows.mapInArrow(run, "lang int, bit int, n long, hits long").groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows whose text and language are known. Rows may repeat; each counts. No rows give a model of no languages.

    Spark sums counts to shares of each side of each bit, so that the driver gets FEATURES rows of two numbers a bit, and
    beside them the names, codewords and accuracies of the languages: a few hundred bytes for each distinct label, of
    which there may be any number that this lets the driver hold.
    """
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    codes = codewords(len(languages))
    bits = codes.shape[1] if languages else 0
    weights = np.zeros((FEATURES, bits), np.float32)
    if bits:
        counts = cut(_counts(rows))
        # each language weighs the same in its side of a bit, however many rows it has; a feature it lacks counts a half
        totals = counts.groupBy("lang").agg((F.sum("n") + F.lit(0.5 * FEATURES)).alias("total"))
        words = rows.sparkSession.createDataFrame([(x, "".join("1" if b > 0 else "0" for b in code)) for x, code in zip(languages, codes, strict=True)], "lang string, word string")
        rest = {r["lang"]: 0.5 / r["total"] for r in totals.collect()}  # a row for each language
        joined = counts.join(totals, "lang").join(words, "lang").withColumn("share", F.col("n") / F.col("total"))
        sides = [F.sum(F.when(F.substring("word", b + 1, 1) == side, F.col("share")).otherwise(0.0)).alias(f"s{side}_{b}") for side in "10" for b in range(bits)]
        both = np.zeros((2, bits, FEATURES))
        for r in joined.groupBy("feature").agg(*sides).collect():  # FEATURES rows at most
            both[:, :, r["feature"]] = np.array(r[1:]).reshape(2, bits)
        least = np.array([rest.get(x, 1 / FEATURES) for x in languages])
        for side, sign in enumerate((1, -1)):
            both[side] += (np.maximum(codes.T * sign, 0) @ least)[:, None]
        both /= both.sum(axis=2, keepdims=True)
        # rounded, for sums of shares depend on their order in the last digits
        weights = np.ascontiguousarray(np.round(np.log(both[0]) - np.log(both[1]), 6).T, dtype=np.float32)
    model = Model(languages, codes, weights)
    trust = np.ones(codes.shape)
    if codes.size:
        for r in _right(rows, model).collect():
            trust[r["lang"], r["bit"]] = (r["hits"] + 1) / (r["n"] + 2)
        model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of margins: the language of least weighted loss, a score from 0 to 1, and how close the next one is (0: as good)."""
    n = len(margins)
    if model.codes.size == 0:
        return np.zeros(n, np.int64), np.ones(n), np.ones(n)
    loss = np.stack([(np.logaddexp(0, -margins * code) * trust).sum(axis=1) for code, trust in zip(model.codes, model.trust, strict=True)], axis=1)
    order = np.sort(loss, axis=1)
    best = loss.argmin(axis=1)
    power = np.exp(-(loss - order[:, :1]) * 4)
    return best, 1 / power.sum(axis=1), (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1], 1e-12)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least_gap: float = 0.02) -> DataFrame:
    """docs with the columns lang_pred, score and ambiguous added, one row for each row; all other columns stay.

    A text that is null or has no letter gets `und`, score 0 and ambiguous false, as does every text if the model holds no
    language. ambiguous: the two best codewords' losses differ by under least_gap of the larger; ties go to the language
    first in order. Whole texts are read, of any length. Rows may repeat and ids may be null or tied; no rows give none.
    Columns of docs named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = tx.buffers(batch.column(at))
            for low, high in tx.chunks(offsets):
                margin = _margins(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], model.weights)
                best, score, gap = decode(margin, model)
                names = pa.array([model.languages[i] for i in best] if model.languages else ["und"] * (high - low), pa.string())
                part = batch.slice(low, high - low)
                columns = [*part.columns, names, pa.array(score), pa.array(gap < least_gap)]
                yield pa.record_batch(columns, names=[*part.schema.names, "lang_pred", "score", "ambiguous"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    found = docs.mapInArrow(run, schema)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & (F.lit(len(model.languages)) > 0)
    return found.withColumns(
        {
            "lang_pred": F.when(letters, F.col("lang_pred")).otherwise("und"),
            "score": F.when(letters, F.col("score")).otherwise(0.0),
            "ambiguous": letters & F.col("ambiguous"),
        }
    )
