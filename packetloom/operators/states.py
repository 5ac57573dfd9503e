"""Decisions that depend on the one before, along streams of any length.

A decision with few possible values is a map from the last value to the next. Maps of consecutive rows make one map, so
each block of a stream's rows is folded for all values it might begin with, the blocks' maps tell what each really begins
with, and the rows pick theirs. No stream is a single task's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..storage import written
from . import ordered

#: For each step of bandwidth (medium, wide, superwide, full) the rate it takes and its hysteresis, for
#: voice and for music, alike for one and two channels.
VOICE = ((9000, 700), (9000, 700), (13500, 1000), (14000, 2000))
MUSIC = ((9000, 700), (9000, 700), (11000, 1000), (12000, 2000))
#: The state before a stream's first decision, after the five bandwidths.
FRESH = 5


def fold(rows: DataFrame, key: str, order: list[str], step: Column, n_states: int, first: int, name: str) -> DataFrame:
    """rows with the column `name`: the state after each row of its key, in order, beginning with `first`.

    step is an array<int> of the next state for each of n_states states; null leaves the state as it is. order must tell a
    key's rows apart; null keys are a key. Rows are dealt in blocks of even size, so that a key's rows are many tasks'.
    """
    if not 0 <= first < n_states:
        raise ValueError("the first state must be one of n_states")
    same = F.array(*[F.lit(s) for s in range(n_states)])
    cut = ordered.dealt(rows.withColumn("_step", F.coalesce(step.cast("array<int>"), same)), key, order)
    cut = cut.repartition(key, "_block").sortWithinPartitions(key, "_block", *ordered.ascending(order))
    columns, at, group = cut.columns, cut.columns.index("_step"), [cut.columns.index(key), cut.columns.index("_block")]

    def run(batches):
        state, last = np.arange(n_states), None
        for batch in batches:
            steps = batch.column(at).flatten().to_numpy().reshape(-1, n_states)
            out = np.empty_like(steps)
            for i, now in enumerate(zip(*(batch.column(g).to_pylist() for g in group), strict=True)):
                if now != last:
                    state, last = np.arange(n_states), now
                state = steps[i][state]
                out[i] = state
            states = pa.ListArray.from_arrays(np.arange(0, out.size + 1, n_states, dtype=np.int32), pa.array(out.ravel(), pa.int32()))
            yield pa.record_batch([*batch.columns[:at], states, *batch.columns[at + 1 :]], names=columns)

    schema = StructType([f if f.name != "_step" else StructType().add("_step", ArrayType(IntegerType())).fields[0] for f in cut.schema.fields])
    found = written(cut.mapInArrow(run, schema))
    ends = found.groupBy(key, "_block").agg(F.max_by("_step", ordered.place(order)).alias("m"))
    begin = F.struct(F.lit(first).alias("s"), F.array().cast("array<struct<b:int,s:int>>").alias("out"))
    walk = lambda a, e: F.struct(F.get(e["m"], a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(e["_block"].alias("b"), a["s"].alias("s")))).alias("out"))
    known = ends.groupBy(F.col(key).alias("_own")).agg(F.array_sort(F.collect_list(F.struct("_block", "m"))).alias("x"))  # a map for each block
    known = known.select("_own", F.inline(F.aggregate("x", begin, walk, lambda a: a["out"])))
    joined = found.join(known, F.col(key).eqNullSafe(F.col("_own")) & (F.col("_block") == F.col("b")))
    return joined.select(*rows.columns, F.get("_step", F.col("s")).alias(name))


def rungs(value: Column, thresholds: list[int], margins: list[int]) -> Column:
    """The step of a ladder: how many thresholds from the first on the value reaches, but no change from the last rung within its margin.

    Rising takes the margin above the last rung's next threshold, falling the margin below its own. The states are 0 to
    len(thresholds); a null value gives null.
    """
    n = len(thresholds)
    reached = F.lit(n)
    for k in range(n - 1, -1, -1):
        reached = F.when(value < thresholds[k], k).otherwise(reached)

    def after(last: int) -> Column:
        kept = F.lit(False)
        if last < n:
            kept = kept | ((reached > last) & (value < thresholds[last] + margins[last]))
        if last > 0:
            kept = kept | ((reached < last) & (value > thresholds[last - 1] - margins[last - 1]))
        return F.when(kept, last).otherwise(reached)

    return F.when(value.isNotNull(), F.array(*[after(last) for last in range(n + 1)]))


def bandwidths(rate: Column, voice: Column) -> Column:
    """The step of the choice of bandwidth (ranks 0 to 4, never 1) by equivalent rate; voice is how much of it is speech, 0 to 127.

    The state FRESH, before the first choice, knows no hysteresis. A null rate gives null.
    """
    share = lambda v, m: m + F.shiftright(voice * voice * (v - m), 14)
    steps = [(share(F.lit(v[0]), m[0]), share(F.lit(v[1]), m[1])) for v, m in zip(VOICE, MUSIC, strict=True)]

    def after(last: int) -> Column:
        chosen = F.lit(0)
        for rank in range(1, 5):
            least, margin = steps[rank - 1]
            if last != FRESH:
                least = least - margin if last >= rank else least + margin
            chosen = F.when(rate >= least, max(rank, 2)).otherwise(chosen)
        return chosen

    return F.when(rate.isNotNull(), F.array(*[after(last) for last in range(FRESH + 1)]))


def audible(rank: Column, rate: Column) -> Column:
    """A bandwidth no wider than a sample rate can carry; medium becomes wide."""
    most = F.when(rate <= 8000, 0).when(rate <= 12000, 1).when(rate <= 16000, 2).when(rate <= 24000, 3).otherwise(4)
    least = F.least(rank, most)
    return F.when(least == 1, 2).otherwise(least)
