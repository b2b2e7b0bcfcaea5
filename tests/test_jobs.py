"""Jobs and streams from end to end, and every registered query."""

import random
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import registry
from barloom.functions import calendars
from barloom.jobs.audit import audit_library
from barloom.jobs.get_data import get_data
from barloom.jobs.load import grid_for, load, load_batch, load_issues, loads, on_grid
from barloom.jobs.normalise import normalise_library
from barloom.operators import gaps
from barloom.schema import BARS, MINUTE, RAW
from barloom.sources import store
from barloom.streaming.live import ingest, live_bars
from tests.test_bars import linear, raw, values, window

SF = "/root/testdata/sf0.001"


def test_load_is_idempotent(spark, tmp_path):
    path, start = f"{tmp_path}/s", datetime(2024, 1, 2, 10)
    landed = raw(spark, linear(200, start=start, symbol="BTCUSDT"))
    req = window(spark, start, start + timedelta(minutes=239), "BTCUSDT")
    life = spark.createDataFrame([], "symbol string, ipo_date timestamp, delist_date timestamp")
    todo = gaps.plan(store.read(spark, path), req, life)
    assert load(landed, todo, path, "crypto", "1m", "x").count() == 1
    first = values(store.read(spark, path), "ts", "close", "volume")
    assert len(first) == 240 and store.read(spark, path).where("volume = 0").count() == 40
    assert gaps.plan(store.read(spark, path), req, life).count() == 0
    load(landed, todo, path, "crypto", "1m", "x")
    assert values(store.read(spark, path), "ts", "close", "volume") == first


def test_normalise_and_audit(spark):
    rows = linear(30, symbol="A") + linear(20, symbol="B")
    rows[35] = (*rows[35][:6], None, rows[35][7])
    out, report = normalise_library(raw(spark, rows), "1m")
    assert {r["symbol"]: (r["rows_in"], r["rows_out"], r["status"]) for r in report.collect()} == {"A": (30, 30, "ok"), "B": (20, 0, "error")}
    profiles, found = audit_library(out.withColumn("ingest_seq", F.unix_micros("ts")), calendars.continuous_grid(window(spark, datetime(2024, 1, 2, 14, 30), datetime(2024, 1, 2, 15), "A"), MINUTE), MINUTE)
    assert values(found, "category", "n_bars") == [("missing_bars", 1)] and profiles.first()["health"] == "clean"


def test_streams(spark, tmp_path):
    ticks = spark.createDataFrame([("A", datetime(2024, 1, 1, 0, m, s), float(m * 60 + s), 1.0) for m in range(30) for s in (5, 40)], "symbol string, ts timestamp, price double, size double")
    ticks.coalesce(1).write.parquet(f"{tmp_path}/ticks")
    stream = live_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = values(spark.read.parquet(f"{tmp_path}/out"), "ts", "open", "close", "volume")
    assert got[0] == (datetime(2024, 1, 1), 5.0, 40.0, 2.0) and len(got) == 19
    seen = f"{tmp_path}/seen"
    raw(spark, linear(10)).write.parquet(f"{tmp_path}/land")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, f"{tmp_path}/land", RAW, f"{tmp_path}/c2", lambda df, n: df.write.mode("append").parquet(seen)).awaitTermination()
    assert spark.read.parquet(seen).count() == 10


def test_partitions_do_not_matter(spark):
    for name in ("a5_snap_nearest", "g1_hourly_gaps", "v15_audit"):
        results = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, registry.queries()[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert results[0] == results[1] and results[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_load_keeps_issues_and_fills_known_symbols(spark, tmp_path):
    path, start = f"{tmp_path}/s", datetime(2024, 1, 2, 10)
    rows = linear(10, start=start, symbol="A") + linear(10, start=start, symbol="B")
    rows[13] = (*rows[13][:6], None, rows[13][7])
    both = window(spark, start, start + timedelta(minutes=9), "A").unionByName(window(spark, start, start + timedelta(minutes=9), "B"))
    todo = both.selectExpr("symbol", "start_ts AS gap_start", "end_ts AS gap_end")
    assert [r["symbol"] for r in load(raw(spark, rows), todo, path, "crypto", "1m", "x", note="n").collect()] == ["A"]
    assert values(load_issues(spark, path), "symbol", "category", "n_bars") == [("B", "null_volume", 1)]
    # Nothing lands any more: A is known and gets bars without trades, B isn't and gets none.
    later = both.selectExpr("symbol", "end_ts + interval 1 minute AS gap_start", "end_ts + interval 5 minutes AS gap_end")
    load(raw(spark, rows).limit(0), later, path, "crypto", "1m", "x")
    assert {r["symbol"] for r in store.read(spark, path).collect()} == {"A"}
    assert store.read(spark, path).where("close is null and volume = 0").count() == 5
    assert loads(spark, path).count() == 2 and {r["note"] for r in loads(spark, path).collect()} == {"n", None}


def test_issues_end_with_the_first_check_that_fails(spark):
    rows = {symbol: linear(10, step=300, symbol=symbol) for symbol in "ABC"}
    for symbol in "BC":  # a traded bar without its open
        rows[symbol][4] = (*rows[symbol][4][:2], None, *rows[symbol][4][3:])
    early = rows["C"][2]
    rows["C"].append((early[0], early[1] + timedelta(minutes=2), *early[2:7], 99))
    rows["C"] = [(*r[:7], n) for n, r in enumerate(sorted(rows["C"], key=lambda r: r[1]))]
    first, last = rows["A"][0][1], rows["A"][-1][1]
    asked = window(spark, first, last, "A").unionByName(window(spark, first, last, "B")).unionByName(window(spark, first, last, "C"))
    made, found = on_grid(raw(spark, sum(rows.values(), [])), grid_for(asked, "5m"), "5m", True)
    assert {r["symbol"] for r in made.collect()} == {"A"} and made.count() == 10
    # B's open is found wanting again before it is stored; C has ended with its spacing by then.
    assert values(found, "symbol", "category", "severity", "n_bars") == [
        ("B", "partial_prices", "warning", 1),
        ("B", "traded_without_prices", "error", 1),
        ("C", "bad_spacing", "error", 2),
        ("C", "partial_prices", "warning", 1),
    ]


def test_updates_at_once_and_broken_ones(spark, tmp_path):
    path, key = f"{tmp_path}/s", ("crypto", "1m", "x")
    january, march = datetime(2024, 1, 2), datetime(2024, 3, 2)
    store.write(raw(spark, linear(20, start=january) + linear(20, start=march)), path, *key)

    def change(start):
        store.update(raw(spark, linear(3, start=start, base=500.0)), window(spark, start, start + timedelta(minutes=2), "AAPL"), path, *key)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(change, (january, march)))
    assert store.read(spark, path).count() == 40 and store.read(spark, path).where("close >= 500").count() == 6
    # Writers that were broken off before their commit.
    new = store.with_partitions(raw(spark, linear(4, start=march, base=900.0)), *key)
    store._write_version(new, path, "a")
    new.write.parquet(f"{path}/data/version=b")
    assert store.recover(spark, path) == 2 and store.recover(spark, path) == 0
    assert store.read(spark, path).count() == 40 and store.read(spark, path).where("close >= 900").count() == 0
    assert store.vacuum(spark, path) == 2 and store.vacuum(spark, path) == 0 and store.read(spark, path).count() == 40


def test_update_changes_nothing_beside_its_ranges(spark, tmp_path):
    """Random updates, some with rows outside of their ranges, against a dict."""
    path, key, r = f"{tmp_path}/s", ("crypto", "1h", "x"), random.Random(2)
    start = datetime(2024, 1, 30)
    at = lambda n: start + timedelta(hours=n)
    held = {}
    for step in range(8):
        ranges = [(s, at(a), at(a + r.randint(0, 30))) for s in ("A", "B") for a in r.sample(range(120), r.randint(0, 2))]
        new = {(s, at(n)): float(step) for s in ("A", "B", "C") for n in r.sample(range(150), 60)}
        rows = spark.createDataFrame([(s, t, v, v, v, v, 1.0) for (s, t), v in new.items()], BARS)
        store.update(rows, spark.createDataFrame(ranges, "symbol string, start_ts timestamp, end_ts timestamp"), path, *key)
        inside = lambda k: any(s == k[0] and a <= k[1] <= b for s, a, b in ranges)  # noqa: E731, B023
        held = {k: v for k, v in held.items() if not inside(k)} | {k: v for k, v in new.items() if inside(k)}
        got = store.read(spark, path).select("symbol", "ts", "close").collect()
        assert {(g["symbol"], g["ts"]): g["close"] for g in got} == held and len(got) == len(held)


def test_readers_keep_what_they_began_with(spark, tmp_path):
    path, key = f"{tmp_path}/s", ("crypto", "1m", "x")
    start = datetime(2024, 1, 2)
    store.write(raw(spark, linear(20, start=start)), path, *key)
    before = store.read(spark, path)
    store.update(raw(spark, linear(20, start=start, base=500.0)), window(spark, start, start + timedelta(minutes=19), "AAPL"), path, *key)
    assert before.where("close >= 500").count() == 0 and before.count() == 20
    assert store.read(spark, path).where("close >= 500").count() == 20
    # Two writers that read the same folder: the second one is told.
    base = store.head(spark, path)
    store.delete_symbol(spark, path, "AAPL", *key)
    touched = store.touched_folders(window(spark, start, start, "AAPL"), *key)
    with pytest.raises(store.Conflict):
        store._commit(spark, path, "late", None, touched, base)
    assert store.read(spark, path).count() == 0
    # A version is committed once.
    new, all_ = raw(spark, linear(5, start=start)), window(spark, start, start + timedelta(minutes=9), "AAPL")
    assert store.update(new, all_, path, *key, version="v1") and not store.update(new.limit(0), all_, path, *key, version="v1")
    assert store.read(spark, path).count() == 5


def test_batches_merge(spark, tmp_path):
    path, start = f"{tmp_path}/s", datetime(2024, 1, 2)
    rows = linear(8, start=start)
    load_batch(raw(spark, rows), path, "crypto", "1m", "x", batch="b0")
    load_batch(raw(spark, [rows[2], rows[6]]), path, "crypto", "1m", "x", batch="b1")
    assert store.read(spark, path).where("volume > 0").count() == 8
    load_batch(raw(spark, linear(3, start=start + timedelta(minutes=12))), path, "crypto", "1m", "x", batch="b2")
    load_batch(raw(spark, linear(3, start=start + timedelta(minutes=12), base=900.0)), path, "crypto", "1m", "x", batch="b2")
    got = store.read(spark, path)
    assert got.count() == 15 and got.where("volume > 0").count() == 11 and got.where("close > 800").count() == 0


def test_get_data_stops_at_the_ceiling(spark, tmp_path):
    path, start = f"{tmp_path}/s", datetime(2024, 1, 2)
    bars, ask = raw(spark, linear(200, start=start, symbol="BTCUSDT")), window(spark, start, start + timedelta(minutes=180), "BTCUSDT")
    none = spark.createDataFrame([], "symbol string, ipo_date timestamp, delist_date timestamp")
    rates, asked = spark.createDataFrame([("BTCUSDT", 100.0)], "symbol string, rate double"), []

    def source(gaps):
        asked.append(gaps.count())
        return bars

    call = lambda ceiling: get_data(ask, path, "crypto", "1m", "x", source, none, bars.limit(0), rates, ceiling)
    with pytest.raises(ValueError, match="ceiling"):
        call(1.0)
    assert store.read(spark, path).count() == 0 and asked == []
    got, planned = call(100.0)
    assert got.count() == 181 and planned.count() == 1
    got, planned = call(100.0)
    assert got.count() == 181 and planned.count() == 0 and asked == [1]
    bad = window(spark, start, start, "BTCUSDT")
    with pytest.raises(ValueError, match="start is not before end"):
        get_data(bad, path, "crypto", "1m", "x", source, none, bars.limit(0))


def test_plans_follow_no_symbol_alone(spark):
    """A symbol's rows are dealt by month or block of arrival; what goes by symbol alone is a row or two of each."""
    for name in ("v13_raw_issues", "w1_moving_averages", "w4_forward_fill", "a2_rollup_guard"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
        assert windows and sum("_block" in w or "ts" in w or "bar" in w for w in windows) >= 1


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    path = f"{tmp_path}/s"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.write(raw(spark, linear(4000)), path, "crypto", "1m", "x")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = store.listing(spark, path)
    assert sizes.count() > 1 and sizes.select(*store.PARTITIONS).distinct().count() == 1
    assert store.library_size(sizes).first() == store.library_size(store.files(spark, path)).first()
