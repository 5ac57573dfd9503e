"""The smoother of operators.smoothing over a stream: one level for each key, kept from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.smoothing import ONE, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Smoother(StatefulProcessor):
    def __init__(self, order: list[str], target: str, share: int, first: int):
        self.order, self.target, self.share, self.first = order, target, share, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(self.order)
        level = self.level.get()[0] if self.level.exists() else self.first
        out = []
        for t in found[self.target]:
            level = level if pd.isna(t) else step(level, int(t), self.share)
            out.append(level)
        self.level.update((level,))
        yield found.assign(level=out)

    def close(self) -> None:
        pass


def smoothed(stream: DataFrame, key: str, order: list[str], target: str, share: int, first: int) -> DataFrame:
    """The stream's rows with the column level: the level after each row of its key, as smooth gives it over all rows so far.

    Rows of one batch go by order; those of a later batch come after them, so what arrives late counts when it arrives.
    State is one number a key, and stays. The session's state store must be PROVIDER.
    """
    if not 0 < share < ONE:
        raise ValueError("share must lie between 0 and 65536")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name != "level") + ", level long"
    return stream.drop("level").groupBy(key).transformWithStateInPandas(_Smoother(order, target, share, first), schema, "Append", "None")
