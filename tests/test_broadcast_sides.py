"""Whatever sizes the optimiser takes tables for: what can be broadcast in loads and plans has a row a symbol, or fewer."""

import pytest

from pyspark.sql import functions as F

from barloom import registry
from barloom.functions import calendars
from barloom.operators import bars, gaps
from barloom.sources import store
from tests.test_broadcasts import D, broadcast_rows


@pytest.fixture
def everything_small(spark):
    """All tables count as small enough, so every side that may be broadcast is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100g")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def symbols(spark) -> int:
    return registry.hourly(spark, D, "user").select("symbol").distinct().count()


@pytest.mark.parametrize("name", ["job_load_issues", "s8_stored_provenance", "job_load_again", "n5_normalise_library"])
def test_neither_bars_nor_grids_can_be_broadcast(spark, everything_small, name):
    assert broadcast_rows(spark, lambda: registry.queries()[name](spark, D).collect()) <= max(symbols(spark), store.BUCKETS)


def test_covered_chunks_can_not_be_broadcast(spark, everything_small):
    h = store.materialised(registry.hourly(spark, D, "user"))
    want = store.materialised(registry.windows(h))
    path = store.scratch(spark, "bars")
    store.write(h, path, "crypto", "1h", "events")
    life = spark.createDataFrame([], "symbol string, ipo_date timestamp, delist_date timestamp")
    run = lambda: gaps.plan(store.read(spark, path), want, life).collect()
    assert broadcast_rows(spark, run) <= max(symbols(spark), store.BUCKETS)


def test_grids_of_snaps_can_not_be_broadcast(spark, everything_small):
    h = store.materialised(registry.hourly(spark, D, "user").withColumn("ingest_seq", F.unix_micros("ts")))
    grid = calendars.continuous_grid(registry.windows(h), registry.HOUR)
    for run in (lambda: bars.snap(h, grid, registry.HOUR), lambda: bars.snap_daily(h, grid)):
        assert broadcast_rows(spark, lambda: run().collect()) <= store.BUCKETS
