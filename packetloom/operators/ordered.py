"""Running sums and previous rows along each stream, in two levels.

A stream is cut into chunks of time. Windows run within a chunk, and over the chunks' totals or last rows, so a stream
that holds most rows is spread over as many tasks as it has chunks. A null key is a stream like any other, and null
times are a chunk of their own, after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written

CHUNK_SECONDS = 86_400


def _chunk(order: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(order).cast("timestamp")) / (seconds * 1_000_000))


def ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def place(order: list[str]) -> Column:
    """A value that compares as rows do in ascending order."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])


def along(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], columns: dict[str, str], seconds: int = CHUNK_SECONDS) -> DataFrame:
    """rows with running sums and columns of the row before, in one pass over the chunks and one over the rows.

    A column for each of sums: its total over the key's rows up to and including this one; null terms count as 0. For each
    new name in columns: the value of a column in the key's row before, null in its first. order begins with a timestamp
    and must tell a key's rows apart.
    """
    terms = {f"_t_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()}
    cut = rows.withColumn("_chunk", _chunk(order[0], seconds)).withColumns(terms)
    found = [F.sum(f"_t_{n}").alias(f"_s_{n}") for n in sums]
    found += [F.max_by(F.struct(*[F.col(c).alias(f"_l_{n}") for n, c in columns.items()]), place(order)).alias("_l")] if columns else []
    chunks = cut.groupBy(key, "_chunk").agg(*found)
    over = Window.partitionBy(key).orderBy(*ascending(["_chunk"]))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums] + ([F.lag("_l").over(over).alias("_p")] if columns else [])
    carried = chunks.select(F.col(key).alias("_own_key"), F.col("_chunk").alias("_own_chunk"), *carried)
    joined = cut.join(carried, F.col(key).eqNullSafe(F.col("_own_key")) & F.col("_chunk").eqNullSafe(F.col("_own_chunk")))
    within = Window.partitionBy(key, "_chunk").orderBy(*ascending(order))
    upto, first = within.rowsBetween(Window.unboundedPreceding, 0), F.row_number().over(within) == 1
    totals = [(F.col(f"_b_{n}") + F.sum(f"_t_{n}").over(upto)).alias(n) for n in sums]
    return joined.select(*rows.columns, *totals, *[F.when(first, F.col(f"_p._l_{n}")).otherwise(F.lag(c).over(within)).alias(n) for n, c in columns.items()])


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], seconds: int = CHUNK_SECONDS) -> DataFrame:
    """rows with a column for each of sums, as along gives them."""
    return along(rows, key, order, sums, {}, seconds)


def previous(rows: DataFrame, key: str, order: list[str], columns: dict[str, str], seconds: int = CHUNK_SECONDS) -> DataFrame:
    """rows with columns of the key's row before, as along gives them."""
    return along(rows, key, order, {}, columns, seconds)


def running_min(rows: DataFrame, key: str, order: list[str], value: Column, name: str, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """rows with the least value of the key's rows up to and including this one."""
    cut = rows.withColumn("_value", value).withColumn("_chunk", _chunk(order[0], seconds))
    lows = cut.groupBy(key, "_chunk").agg(F.min("_value").alias("_low"))
    before = Window.partitionBy(key).orderBy(*ascending(["_chunk"])).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(F.col(key).alias("_own_key"), F.col("_chunk").alias("_own_chunk"), F.min("_low").over(before).alias("_base"))
    within = Window.partitionBy(key, "_chunk").orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(lows, F.col(key).eqNullSafe(F.col("_own_key")) & F.col("_chunk").eqNullSafe(F.col("_own_chunk")))
    return joined.select(*rows.columns, F.least(F.min("_value").over(within), "_base").alias(name))


def dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with _block, written once: ranges of even size of all rows by key and order, whatever the order counts.

    A key's rows lie in blocks that follow one another, so a key with a third of all rows is a third of all blocks. Rows of
    one key that tie in order go to one block, so order should tell a key's rows apart.
    """
    ranges = rows.repartitionByRange(F.col(key).asc_nulls_first(), *ascending(order))
    return written(ranges.withColumn("_block", F.spark_partition_id()))


def sums(rows: DataFrame, key: str, order: list[str], terms: dict[str, Column]) -> DataFrame:
    """Rows of dealt with a column for each of terms: its total over the key's rows up to and including this one."""
    rows = rows.withColumns({f"_t_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in terms.items()})
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(*(F.sum(f"_t_{n}").alias(f"_s_{n}") for n in terms))
    blocks = blocks.select(F.col(key).alias("_own_key"), F.col("_block").alias("_own_block"), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in terms))
    joined = rows.join(blocks, F.col(key).eqNullSafe(F.col("_own_key")) & (F.col("_block") == F.col("_own_block")))
    upto = Window.partitionBy(key, "_block").orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = {n: F.col(f"_b_{n}") + F.sum(f"_t_{n}").over(upto) for n in terms}
    return joined.withColumns(totals).drop("_own_key", "_own_block", *(f"_{x}_{n}" for n in terms for x in "tb"))
