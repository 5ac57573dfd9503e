"""Every registered query of the engine's own operators against its SQL."""

import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from packetloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, oracle, name):
    ours, theirs = oracle(spark, QUERIES[name], SQL[name])
    assert len(ours) == len(theirs) > 0
    assert ours == theirs


def test_what_sql_cannot_express():
    """These are held against plain versions in tests of their own."""
    assert QUERIES.keys() - SQL.keys() == {"stream_quality"}


ALONG = ["page_layout", "page_table", "granule_positions", "record_offsets", "repacketize", "mode_transitions", "channel_hysteresis", "silence_runs", "frame_energies", "frame_averages", "frame_spectra", "background_levels", "bandwidth_ladder", "threshold_steps", "container_packets", "smoothed_levels"]


@pytest.fixture(scope="module")
def with_nulls(spark):
    """Tables of which events has null streams and null times."""
    folder = tempfile.mkdtemp(prefix="spark-")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    i = F.col("event_id")
    some = e.withColumn("user_id", F.when(i % 7 != 0, F.col("user_id"))).withColumn("ts", F.when(i % 5 != 0, F.col("ts")))
    some.coalesce(1).write.parquet(f"{folder}/written")
    from pathlib import Path

    shutil.copy(next(Path(f"{folder}/written").glob("*.parquet")), f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ALONG)
def test_null_streams_and_times_match_sql(spark, oracle, with_nulls, name):
    ours, theirs = oracle(spark, QUERIES[name], SQL[name], with_nulls)
    assert ours == theirs and ours
