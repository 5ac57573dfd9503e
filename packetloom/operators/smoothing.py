"""An integer exponential smoother along streams of any length, exact to the last bit.

Each step moves the level toward a target by a share in Q16, rounded down. The rounding keeps steps from being composed
as formulas, but a step never lets a higher level fall below a lower one, and brings two levels together. So a
long run of rows maps all levels there are to a few neighbouring ones: it is told by the least of them and by the levels
from which each next one is reached, found by going back through the steps. A short run is told by its targets. What
blocks of a stream tell is followed in order, which gives each block's first level, and then all rows are smoothed at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from . import ordered

#: Levels and targets lie within these bounds.
LOW, HIGH, ONE = -(1 << 31), (1 << 31) - 1, 1 << 16


def step(level: int, target: int, share: int) -> int:
    return level + ((target - level) * share >> 16)


def summary(targets: list[int], share: int) -> tuple[int | None, list[int]]:
    """(least level, the levels from which each next one is reached) after these targets, or (None, targets) if that is shorter."""
    low, high = LOW, HIGH
    for t in targets:
        low, high = step(low, t, share), step(high, t, share)
    if high - low > len(targets):
        return None, targets
    reached = np.arange(low + 1, high + 1, dtype=np.int64)
    for t in reversed(targets):
        # the least level whose step is at least this one
        reached = -((t * share - reached * ONE) // (ONE - share))
    return low, reached.tolist()


def followed(level: int, least: int | None, more: list[int], share: int) -> int:
    """The level after a run that summary tells of."""
    if least is None:
        for t in more:
            level = step(level, t, share)
        return level
    return least + int(np.searchsorted(more, level, side="right"))


def smooth(rows: DataFrame, key: str, order: list[str], target: Column, share: int, first: int, name: str) -> DataFrame:
    """rows with the column `name`: the level after each row of its key in order, beginning with `first`.

    level += (target - level) * share >> 16. A null target leaves the level as it is. Targets and `first` must fit 32 bits;
    others fail the job. order must tell a key's rows apart; null keys are a key. Rows are dealt in blocks of even size; a
    block sends on no more numbers than it has rows, and a long one some 65536 / share.
    """
    if not 0 < share < ONE or not LOW <= first <= HIGH:
        raise ValueError("share must lie between 0 and 65536, and the first level within 32 bits")
    target = target.cast("long")
    wide = F.when((target < LOW) | (target > HIGH), F.raise_error(F.lit("a target is too large"))).otherwise(target)
    dealt = ordered.dealt(rows.withColumn("_target", wide), key, order)
    cut = dealt.repartition(key, "_block").sortWithinPartitions(key, "_block", *ordered.ascending(order))
    kind = dealt.schema[key].dataType.simpleString()
    columns = cut.columns

    def runs(batches, at):
        """(batch, first row, end, whether the run goes on from the batch before) of rows of one key and block."""
        last = None
        for batch in batches:
            keys = list(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    yield batch, begin, i, keys[begin] == last
                    last, begin = keys[begin], i

    def tell(batches):
        held, now = [], None
        for batch, begin, end, goes_on in runs(batches, (0, 1)):
            if not goes_on:
                yield from told(now, held)
                now, held = (batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py()), []
            held += [t for t in batch.column(2).slice(begin, end - begin).to_pylist() if t is not None]
        yield from told(now, held)

    def told(now, held):
        if now is not None:
            least, more = summary(held, share)
            yield pa.record_batch([pa.array([now[0]], keys_type), pa.array([now[1]], pa.int32()), pa.array([least], pa.int64()), pa.array([more], pa.list_(pa.int64()))], names=["_own", "b", "least", "more"])

    keys_type = _arrow(dealt.schema[key].dataType)
    summaries = cut.select(key, "_block", "_target").mapInArrow(tell, f"_own {kind}, b int, least long, more array<long>")
    gathered = summaries.groupBy("_own").agg(F.array_sort(F.collect_list(F.struct("b", "least", "more"))).alias("x"))

    def follow(batches):
        for batch in batches:
            own, block, level = [], [], []
            for k, blocks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = first
                for one in blocks:
                    own.append(k)
                    block.append(one["b"].as_py())
                    level.append(now)
                    now = followed(now, one["least"].as_py(), one["more"].as_py(), share)
            yield pa.record_batch([pa.array(own, keys_type), pa.array(block, pa.int32()), pa.array(level, pa.int64())], names=["_own", "b", "_level"])

    starts = gathered.mapInArrow(follow, f"_own {kind}, b int, _level long")
    joined = dealt.join(starts, F.col(key).eqNullSafe(F.col("_own")) & (F.col("_block") == F.col("b"))).select(*columns, "_level")
    joined = joined.repartition(key, "_block").sortWithinPartitions(key, "_block", *ordered.ascending(order))
    at = {c: i for i, c in enumerate(joined.columns)}
    kept = [c for c in rows.columns if c != name]

    def work(batches):
        now, out, held = None, [], None
        for batch, begin, end, goes_on in runs(batches, (at[key], at["_block"])):
            if held is not None and batch is not held:
                yield done(held, out)
                out = []
            held = batch
            if not goes_on:
                now = batch.column(at["_level"])[begin].as_py()
            for t in batch.column(at["_target"]).slice(begin, end - begin).to_pylist():
                now = now if t is None else step(now, t, share)
                out.append(now)
        if held is not None:
            yield done(held, out)

    def done(batch, out):
        return pa.record_batch([*(batch.column(at[c]) for c in kept), pa.array(out, pa.int64())], names=[*kept, name])

    return joined.mapInArrow(work, StructType([f for f in rows.schema.fields if f.name != name]).add(name, LongType()))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
