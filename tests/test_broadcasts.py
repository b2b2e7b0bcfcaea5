"""What is broadcast, and so comes to the driver, is what was measured to be small, never a grid or the days of ranges."""

import pytest

from barloom import registry

D = "/root/testdata/sf0.001"


def broadcast_rows(spark, run) -> int:
    """The most rows that a broadcast of run()'s queries had."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    runs = store.executionsList()
    for i in range(before, runs.size()):
        at = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() != "BroadcastExchange":
                continue
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["n5_normalise_library", "job_load", "job_load_issues", "s8_stored_provenance", "job_load_again"])
def test_no_grid_is_broadcast(spark, name):
    rows = broadcast_rows(spark, lambda: registry.queries()[name](spark, D).collect())
    # The bars themselves are some tens of kB here; their grid has eleven times as many rows.
    assert rows <= registry.hourly(spark, D, "user").count()
