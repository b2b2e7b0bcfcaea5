"""What is made beside the input grows no faster than the input."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import registry
from barloom.operators import analytics, blocks, gaps, validate

D = "/root/testdata/sf0.001"


def test_ledger_lines_are_handed_on_together():
    """A frame for many gaps, in order; a gap of many rows ends its frame."""
    asked = pd.DataFrame({"symbol": [f"U{k}" for k in range(25)], "gap_start": pd.Timestamp(0), "gap_end": pd.Timestamp(1)})

    def fetch(symbol, start, end):
        if symbol == "U3":
            raise KeyError("unknown")
        return pd.DataFrame({"close": [1.0] * (200 if symbol == "U4" else 2)})

    columns = ["symbol", "gap_start", "gap_end", "status", "rows", "tries", "error", "data"]
    frames = list(gaps._fetched(fetch, ["close"], columns, 4, 0.0, 0.0, 0.0, (TimeoutError,), at_a_time=10)(iter([asked[:7], asked[7:]])))
    assert [len(f) for f in frames] == [5, 10, 10]
    lines = pd.concat(frames)
    assert list(lines["symbol"]) == list(asked["symbol"]) and all(len(d) == n for d, n in zip(lines["data"], lines["rows"]))
    assert list(lines["status"]) == ["failed" if s == "U3" else "fetched" for s in asked["symbol"]] and lines["rows"].sum() == 200 + 23 * 2


@pytest.mark.parametrize("name", ["w1_moving_averages", "w2_crossover"])
def test_few_closes_are_repeated(spark, monkeypatch, name):
    made = []

    def halo(*args):
        made.append(blocks.with_halo(*args))
        return made[-1]

    monkeypatch.setattr(analytics, "with_halo", halo)
    registry.queries()[name](spark, D)
    n = made[0].groupBy("_halo").count().collect()
    assert sum(r["count"] for r in n if r["_halo"]) <= sum(r["count"] for r in n if not r["_halo"]) / 10


def test_spans_give_what_months_give(spark):
    """Some spans are cut within the bars; closes before the cut count."""
    b = registry.daily(spark, D)
    months, cut = (analytics.crossover(analytics.moving_averages(b, block=k), block=k) for k in (None, blocks.span(registry.DAY, most=500)))
    as_set = lambda df: {(r["symbol"], r["ts"], r["sma20"] and round(r["sma20"], 6), r["sma50"] and round(r["sma50"], 6), r["position"], r["signal"]) for r in df.collect()}
    assert b.groupBy("symbol").agg(F.count_distinct(blocks.span(registry.DAY, most=500)).alias("n")).agg(F.max("n")).first()[0] > 1
    assert as_set(months) == as_set(cut)


def test_rename_report_orders_named_tickers_only(spark):
    """Ticks of other tickers are left where they are read: of 1,000 ticks none but theirs is shuffled."""
    out = registry.queries()["a11_rename_report"](spark, D)
    out.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = store.executionsList().apply(store.executionsList().size() - 1).executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    metrics = [node.metrics() for node in (nodes.apply(k) for k in range(nodes.size())) if node.name() == "Exchange"]
    ids = [m.apply(k).accumulatorId() for m in metrics for k in range(m.size()) if m.apply(k).name() == "shuffle records written"]
    written = [int(values.get(i).get().replace(",", "")) for i in ids if values.get(i).isDefined()]
    assert written and max(written) <= 2 * 720  # the hours of two tickers


def test_audit_report_by_order_of_arrival(spark):
    p = registry.padded(spark, D).withColumn("ingest_seq", F.unix_micros("ts"))
    grid = registry.calendars.continuous_grid(registry.windows(p), registry.HOUR)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    made = plan(validate.audit_report(p, grid, registry.HOUR, in_time=True))
    # The order of arrival shows what repeats a time, so no second shuffle looks for it.
    assert "row_number" not in made
    both = {tuple(r) for r in validate.audit_report(p, grid, registry.HOUR).collect()}
    assert both == {tuple(r) for r in validate.audit_report(p, grid, registry.HOUR, in_time=True).collect()}
