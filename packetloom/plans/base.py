"""Registration of queries with their DuckDB SQL, and SQL for the virtual inputs of sources.fixtures."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

PACKETS = "p AS (SELECT user_id AS stream_id, ts, event_id, event_id % 256 AS toc, event_id * 7 % 256 AS b1, 1 + event_id % 1275 AS n_bytes FROM events)"
SAMPLES = "x AS (SELECT user_id AS stream_id, ts, event_id, greatest(-32768, least(32767, CAST(floor(value * 64) AS BIGINT) - 16384)) AS x, event_type = 'error' AS silent FROM events)"
BANDS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 16384) AS BIGINT)) AS x FROM embeddings)"
RATES = (
    "r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT) AS bitrate, CAST([120, 240, 480, 960, 1920, 2880, 960][l_linenumber] AS BIGINT) AS frame, "
    "1 + l_suppkey % 2 AS channels, l_partkey % 11 AS complexity, l_orderkey % 101 AS loss, l_partkey % 2 AS vbr, l_orderkey % 3 AS mode FROM lineitem)"
)
#: Header fields of p.toc and p.b1: mode, bw (rank), spf (samples a frame at 48 kHz), ch, frames.
HEADERS = """h AS (SELECT *, CASE WHEN toc & 128 <> 0 THEN 'CELT' WHEN toc & 96 = 96 THEN 'Hybrid' ELSE 'SILK' END AS mode,
  CASE WHEN toc & 128 <> 0 THEN CASE WHEN (toc >> 5) & 3 = 0 THEN 0 ELSE ((toc >> 5) & 3) + 1 END WHEN toc & 96 = 96 THEN CASE WHEN toc & 16 <> 0 THEN 4 ELSE 3 END ELSE (toc >> 5) & 3 END AS bw,
  CASE WHEN toc & 128 <> 0 THEN 120 << ((toc >> 3) & 3) WHEN toc & 96 = 96 THEN CASE WHEN toc & 8 <> 0 THEN 960 ELSE 480 END WHEN (toc >> 3) & 3 = 3 THEN 2880 ELSE 480 << ((toc >> 3) & 3) END AS spf,
  CASE WHEN toc & 4 <> 0 THEN 2 ELSE 1 END AS ch,
  CASE toc & 3 WHEN 0 THEN 1 WHEN 3 THEN b1 & 63 ELSE 2 END AS frames FROM p)"""


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep
