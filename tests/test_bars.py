"""Bar operators on small literal bars."""

import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import calendars, normalize
from barloom.operators import analytics, bars, gaps, profile, validate
from barloom.schema import BARS, MINUTE, RAW, RESOLUTIONS, library_name, micros
from barloom.sources import store

T0 = datetime(2024, 1, 2, 14, 30)


def linear(n=10, step=60, start=T0, base=100.0, volume=1000.0, symbol="AAPL"):
    return [(symbol, start + timedelta(seconds=step * i), base + 0.1 * i, base + 0.1 * i + 0.5, base + 0.1 * i - 0.5, base + 0.1 * i + 0.2, volume, i) for i in range(n)]


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW).repartition(3)


def grid(spark, times, symbol="AAPL"):
    return spark.createDataFrame([(symbol, t) for t in times], "symbol string, ts timestamp")


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- names and normalisation


def test_schema(spark):
    assert micros("5m") == 300_000_000
    with pytest.raises(ValueError):
        micros("2m")
    assert spark.range(1).select(library_name("equity", "1m", "x").alias("n")).first()["n"] == "equity-1m-x"


def test_klines_keep_first(spark):
    rows = [("BTCUSDT", 0, ["1704153660000", "2", "3", "1", "2.5", "7", "x"]), ("BTCUSDT", 1, ["1704153600000", "1", "2", "0.5", "1.5", "9", "x"]), ("BTCUSDT", 2, ["1704153600000", "8", "8", "8", "8", "8", "x"])]
    out = normalize.keep_first(normalize.from_klines(spark.createDataFrame(rows, "symbol string, ingest_seq bigint, k array<string>")))
    assert values(out, "ts", "open", "volume") == [(datetime(2024, 1, 2), 1.0, 9.0), (datetime(2024, 1, 2, 0, 1), 2.0, 7.0)]


def test_klines_with_bad_numbers_fail(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        normalize.from_klines(spark.createDataFrame([("X", 0, ["1", "oops", "1", "1", "1", "1"])], "symbol string, ingest_seq bigint, k array<string>")).collect()


def test_aggregates(spark):
    page = '{"results":[{"t":1704153600000,"o":1,"h":2,"l":0.5,"c":1.5,"v":9,"vw":3,"n":2}],"next_url":"u"}'
    out = normalize.from_aggregates(spark.createDataFrame([("AAPL", page)], "symbol string, json string"))
    assert values(out, "symbol", "ts", "close", "volume", "ingest_seq") == [("AAPL", datetime(2024, 1, 2), 1.5, 9.0, 0)]


def test_capitalised_and_local_time(spark):
    df = spark.createDataFrame([("A", datetime(2024, 1, 2, 9, 30), 1.0, 2.0, 0.5, float("nan"), 9.9, 100)], "symbol string, Date timestamp, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint")
    out = normalize.from_capitalised(df, zone="America/New_York")
    assert out.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert values(out, "ts", "close", "volume") == [(T0, None, 100.0)]
    with pytest.raises(ValueError):
        normalize.to_canonical(df.drop("Open"))
    with pytest.raises(ValueError):
        normalize.from_lowercase(df)


@pytest.mark.parametrize("symbol,want", [("BTC-USD", "BTCUSDT"), ("ETH-USD", "ETHUSDT"), ("BTC-USDT", "BTCUSDT"), ("BTCUSD", "BTCUSDT"), ("btc-usd", "BTCUSDT"), ("BTC-EUR", "BTCEUR")])
def test_crypto_symbol(spark, symbol, want):
    assert spark.range(1).select(normalize.crypto_symbol(F.lit(symbol)).alias("s")).first()["s"] == want


def test_symbols(spark):
    for s, ok in [("...", False), ("???", False), ("---", False), ("  ", False), ("@#$", False), ("AAPL", True), ("BRK.B", True), ("BRK B", True), ("ES.n.0", True), ("123", True)]:
        assert spark.range(1).select(normalize.valid_symbol(F.lit(s)).alias("v")).first()["v"] is ok
    lines = spark.createDataFrame([(0, "aapl, msft # old"), (1, "# none"), (2, ""), (3, "MSFT,, brk.b ")], "line int, value string")
    assert [r["symbol"] for r in normalize.parse_symbols(lines).orderBy("place").collect()] == ["AAPL", "MSFT", "BRK.B"]
    plan = spark.createDataFrame([("A", T0, T0), ("--", T0, T0 + timedelta(1)), ("B", T0, T0 + timedelta(1))], "symbol string, start_ts timestamp, end_ts timestamp")
    assert {r["symbol"]: r["problem"] for r in normalize.check_request(plan).collect()} == {"A": "start is not before end", "--": "invalid symbol", "B": None}


# --- calendars


def test_sessions(spark):
    days = {r["session_date"]: (r["open_ts"], r["close_ts"]) for r in calendars.nyse_sessions(spark, date(2023, 1, 1), date(2024, 12, 31)).collect()}
    assert len([d for d in days if d.year == 2024]) == 252 and len([d for d in days if d.year == 2023]) == 250
    assert days[date(2024, 1, 2)] == (T0, datetime(2024, 1, 2, 21)) and days[date(2024, 7, 2)][0] == datetime(2024, 7, 2, 13, 30)
    assert days[date(2024, 11, 29)][1] == datetime(2024, 11, 29, 18) and days[date(2024, 7, 3)][1] == datetime(2024, 7, 3, 17) and days[date(2024, 12, 24)][1] == datetime(2024, 12, 24, 18)
    assert not {date(2024, 1, 1), date(2024, 3, 29), date(2024, 5, 27), date(2024, 6, 19), date(2023, 1, 2), date(2023, 4, 7)} & days.keys()


def window(spark, start, end, symbol="A"):
    return spark.createDataFrame([(symbol, start, end)], "symbol string, start_ts timestamp, end_ts timestamp")


def test_grids(spark):
    s = calendars.nyse_sessions(spark, date(2024, 1, 1), date(2024, 1, 5))
    day = window(spark, datetime(2024, 1, 2), datetime(2024, 1, 2))
    assert [calendars.exchange_grid(day, s, RESOLUTIONS[r]).count() for r in ("1m", "1h", "1d")] == [391, 7, 1]
    assert calendars.exchange_grid(window(spark, datetime(2024, 1, 1), datetime(2024, 1, 1)), s, MINUTE).count() == 0
    assert calendars.exchange_grid(window(spark, T0, T0 + timedelta(minutes=9)), s, MINUTE).count() == 10
    assert calendars.continuous_grid(window(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 23)), RESOLUTIONS["1h"]).count() == 24
    assert calendars.continuous_grid(window(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 59)), MINUTE).count() == 60
    assert calendars.hourly_chunks(window(spark, datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 2, 10))).count() == 3
    assert calendars.session_chunks(window(spark, datetime(2024, 1, 1), datetime(2024, 1, 3)), s).count() == 2


# --- bars


def test_rollup(spark):
    b = raw(spark, linear())
    assert values(bars.rollup(b, RESOLUTIONS["5m"]), "ts", "open", "close", "volume")[1] == (T0 + timedelta(minutes=5), 100.5, 101.10000000000001, 5000.0)
    one = bars.rollup(b, RESOLUTIONS["15m"]).first()
    assert (one["open"], one["high"], one["low"], one["volume"]) == (100.0, 101.4, 99.5, 10000.0)
    holes = raw(spark, [("A", T0, None, None, None, None, 0.0, 0), ("A", T0 + timedelta(minutes=1), 5.0, 6.0, 4.0, 5.5, 2.0, 1), ("B", T0, None, None, None, None, 0.0, 0)])
    assert values(bars.rollup(holes, RESOLUTIONS["5m"]), "symbol", "open", "close", "volume") == [("A", 5.0, 5.5, 2.0)]
    assert bars.rollup_if_finer(b, MINUTE).count() == 10 and bars.rollup_if_finer(b, RESOLUTIONS["1h"]).count() == 1


def test_snap(spark):
    hours = [T0 + timedelta(hours=i) for i in range(7)]
    at = lambda *times: raw(spark, [("AAPL", t, 1.0, 1.0, 1.0, float(i), 1.0, i) for i, t in enumerate(times)])
    snapped = lambda b: values(bars.snap(b, grid(spark, hours), RESOLUTIONS["1h"]), "ts", "close")
    assert snapped(at(datetime(2024, 1, 2, 14))) == [(T0, 0.0)]
    assert snapped(at(datetime(2024, 1, 2, 15))) == [(hours[1], 0.0)]  # ties go to the later
    assert snapped(at(datetime(2024, 1, 2, 6))) == [(datetime(2024, 1, 2, 6), 0.0)]
    assert snapped(at(datetime(2024, 1, 2, 14, 20), datetime(2024, 1, 2, 14, 25))) == [(datetime(2024, 1, 2, 14, 25), 1.0), (T0, 0.0)]
    days = bars.snap_daily(raw(spark, [("AAPL", datetime(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 0), ("AAPL", datetime(2024, 1, 6), 1.0, 1.0, 1.0, 2.0, 1.0, 1)]), grid(spark, [T0]))
    assert values(days, "ts", "close") == [(T0, 1.0), (datetime(2024, 1, 6), 2.0)]


def test_reindex_and_boundary(spark):
    times = [T0 + timedelta(minutes=i) for i in range(12)]
    out = bars.reindex(raw(spark, linear(10)), grid(spark, times))
    assert out.count() == 12 and out.where("volume = 0 and close is null").count() == 2
    assert bars.boundary_mismatches(out, grid(spark, times)).count() == 0
    assert bars.boundary_mismatches(raw(spark, linear(10)), grid(spark, times)).count() == 1


def test_align(spark):
    two = raw(spark, linear(3) + linear(2, symbol="MSFT", start=T0 + timedelta(minutes=2)))
    wide = bars.align(two, ["MSFT", "AAPL"])
    assert wide.columns[1:6] == [f"AAPL_{f}" for f in ("close", "high", "low", "open", "volume")] and wide.count() == 4
    assert wide.where("MSFT_volume is null").count() == 2
    assert values(bars.to_long(wide, ["AAPL", "MSFT"]), "symbol", "ts", "close") == values(two, "symbol", "ts", "close")
    assert bars.align(two, ["AAPL"]).columns[1] == "AAPL_open" and bars.field_of(wide, "close").columns == ["ts", "AAPL", "MSFT"]


def test_stitch(spark):
    renames = spark.createDataFrame([("META", "FB", T0, T0 + timedelta(minutes=4))], "canonical string, alias string, valid_from timestamp, valid_to timestamp")
    both = raw(spark, linear(10, symbol="FB") + [("META", T0, None, None, None, None, 0.0, 0)])
    out = bars.stitch(both, renames)
    assert out.where("symbol = 'META'").count() == 5 and out.where("symbol = 'META' and volume = 0").count() == 0


# --- gaps


def test_gaps(spark):
    req = window(spark, datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 16), "AAPL")
    none = spark.createDataFrame([], BARS)
    assert values(gaps.hourly_gaps(none, req), "gap_start", "gap_end") == [(datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 16))]
    half = raw(spark, linear(150, start=datetime(2024, 1, 2, 10)))
    assert values(gaps.hourly_gaps(half, req), "gap_start", "gap_end") == [(datetime(2024, 1, 2, 13), datetime(2024, 1, 2, 16))]
    assert gaps.hourly_gaps(raw(spark, linear(360, start=datetime(2024, 1, 2, 10))), req).count() == 0
    on_hour = raw(spark, [("AAPL", datetime(2024, 1, 2, 12), 1.0, 1.0, 1.0, 1.0, 1.0, 0)])
    assert values(gaps.hourly_gaps(on_hour, req), "gap_start", "gap_end") == [(datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 11)), (datetime(2024, 1, 2, 13), datetime(2024, 1, 2, 16))]
    assert values(gaps.hourly_gaps(on_hour, req, inclusive_end=False), "gap_start")[0] == (datetime(2024, 1, 2, 10),)
    s = calendars.nyse_sessions(spark, date(2024, 1, 1), date(2024, 1, 31))
    week = window(spark, datetime(2024, 1, 2), datetime(2024, 1, 9), "AAPL")
    assert values(gaps.session_gaps(raw(spark, linear(5)), week, s), "gap_start") == [(datetime(2024, 1, 3),), (datetime(2024, 1, 8),)]


def test_plan_and_lifecycle(spark):
    req = window(spark, datetime(2024, 1, 2), datetime(2024, 1, 4), "AAPL").unionByName(window(spark, datetime(2024, 1, 2), datetime(2024, 1, 4), "---"))
    life = spark.createDataFrame([("AAPL", datetime(2024, 1, 3), None)], "symbol string, ipo_date timestamp, delist_date timestamp")
    none = spark.createDataFrame([], BARS)
    assert values(gaps.plan(none, req, life), "symbol", "gap_start") == [("AAPL", datetime(2024, 1, 3))]
    gone = spark.createDataFrame([("AAPL", None, datetime(2024, 1, 1))], "symbol string, ipo_date timestamp, delist_date timestamp")
    assert gaps.plan(none, req, gone).count() == 0
    rates = spark.createDataFrame([("AAPL", 2.0)], "symbol string, rate double")
    assert gaps.check_cost(gaps.plan(none, req, life), rates, 2.0) == 2.0
    with pytest.raises(ValueError):
        gaps.check_cost(gaps.plan(none, req, life), rates, 1.9)
    symbols = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "symbol string")
    cached = spark.createDataFrame([("A", None, None)], "symbol string, ipo_date timestamp, delist_date timestamp")
    ref = spark.createDataFrame([("A", T0, T0), ("B", T0, None)], "symbol string, ipo_date timestamp, delist_date timestamp")
    got = {r["symbol"]: (r["ipo_date"], r["source"]) for r in gaps.bootstrap_lifecycle(symbols, cached, ref, raw(spark, linear(2, symbol="C"))).collect()}
    assert got == {"A": (None, "cached"), "B": (T0, "reference"), "C": (T0, "discovered"), "D": (None, "unknown")}


def test_null_grids(spark):
    g = grid(spark, [T0], "OLD").unionByName(grid(spark, [T0], "NEW"))
    out = gaps.null_grids(g, spark.createDataFrame([], BARS), grid(spark, [], "OLD").unionByName(grid(spark, [T0 - timedelta(1)], "OLD")))
    assert values(out, "symbol", "volume", "close") == [("OLD", 0.0, None)]


def test_fetch_retries(spark, tmp_path):
    mark = str(tmp_path / "tried")

    def fetch(symbol, start, end):
        import os

        import pandas as pd

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError
        return pd.DataFrame({"symbol": [symbol], "ts": [start]})

    g = spark.createDataFrame([("A", T0, T0)], "symbol string, gap_start timestamp, gap_end timestamp")
    ledger = gaps.fetch_gaps(g, fetch, "symbol string, ts timestamp", f"{tmp_path}/ledger", first_wait=0.01).collect()
    assert [(r["status"], r["rows"], r["tries"]) for r in ledger] == [("fetched", 1, 2)]
    assert gaps.fetched_rows(spark, f"{tmp_path}/ledger", "symbol string, ts timestamp").count() == 1


# --- checks and profiles


def found(spark, rows, stage="audit", length=MINUTE):
    return {(r["category"], r["severity"]): r["n_bars"] for r in validate.issues(raw(spark, rows), length, stage).collect()}


def spoil(**change):
    rows = linear()
    names = ("symbol", "ts", "open", "high", "low", "close", "volume", "ingest_seq")
    rows[3] = tuple(change.get(n, v) for n, v in zip(names, rows[3]))
    return rows


def test_issues(spark):
    assert found(spark, linear()) == {} == found(spark, linear(), "raw") == found(spark, [], "raw")
    assert found(spark, linear() + [(*linear()[0][:7], 10)], "raw") == {("duplicate_ts", "error"): 1, ("not_increasing", "error"): 1, ("bad_spacing", "error"): 1}
    assert found(spark, linear(), length=RESOLUTIONS["1h"]) == {("bad_spacing", "error"): 9}
    assert found(spark, spoil(volume=None)) == {("null_volume", "error"): 1}
    assert found(spark, spoil(volume=-100.0)) == {("negative_volume", "error"): 1} and found(spark, spoil(volume=-100.0), "storage") == {}
    assert found(spark, spoil(open=None)) == {("traded_without_prices", "error"): 1} and found(spark, spoil(open=None), "raw") == {("partial_prices", "warning"): 1}
    assert found(spark, spoil(volume=0.0), "storage") == {("prices_without_trade", "error"): 1}
    assert found(spark, spoil(high=50.0, low=200.0)) == {("price_order", "error"): 1}
    assert found(spark, spoil(low=-1.0)) == {("negative_price", "warning"): 1}
    assert found(spark, spoil(volume=0.0, open=None, high=None, low=None, close=None)) == {}
    short = raw(spark, linear(step=30) + spoil(volume=None))
    assert [r["category"] for r in validate.issues(short, MINUTE, "raw", ("bad_spacing",)).collect()] == ["bad_spacing"]
    assert validate.issues(raw(spark, linear()).drop("volume"), MINUTE, "raw").first()["category"] == "no_volume_column"
    with pytest.raises(ValueError):
        validate.issues(raw(spark, linear()).drop("open"), MINUTE, "storage")
    with pytest.raises(ValueError, match="null_volume"):
        validate.require(validate.issues(raw(spark, spoil(volume=None)), MINUTE, "raw"))


def test_grid_issues_and_quarantine(spark):
    g = grid(spark, [T0 + timedelta(minutes=i) for i in range(10)])
    short = validate.audit(raw(spark, linear(5)), g, MINUTE)
    assert values(short, "category", "severity", "n_bars") == [("missing_bars", "error", 5)]
    assert values(validate.audit(raw(spark, linear(12)), g, MINUTE), "category", "severity", "n_bars") == [("extra_bars", "warning", 2)]
    assert validate.audit(raw(spark, []), g, MINUTE).count() == 1 and validate.audit(raw(spark, []), grid(spark, []), MINUTE).count() == 0
    good, bad = validate.quarantine(raw(spark, linear(5) + linear(3, symbol="B")), short)
    assert {r["symbol"] for r in good.collect()} == {"B"} and bad.count() == 5
    assert validate.by_category(short).count() == 1


def test_profile(spark):
    rows = linear(10) + linear(4, symbol="B") + [("B", T0 + timedelta(minutes=4), None, None, None, None, 0.0, 4)]
    symbols = spark.createDataFrame([("AAPL",), ("B",), ("C",)], "symbol string")
    p = profile.profile(raw(spark, rows), symbols)
    assert values(p, "symbol", "total_bars", "null_bars", "data_bars", "first_bar") == [("AAPL", 10, 0, 10, T0), ("B", 5, 1, 4, T0), ("C", 0, 0, 0, None)]
    assert profile.overview(p).first()[:2] == (3, 15)
    assert values(profile.with_health(p), "symbol", "health") == [("AAPL", "clean"), ("B", "critical"), ("C", "empty")]
    assert profile.health_counts(p).first().asDict() == {"clean": 1, "good": 0, "warning": 0, "critical": 1}
    assert [r["symbol"] for r in profile.ranking(p).collect()] == ["B", "AAPL", "C"] and [r["symbol"] for r in profile.ranking(p, "total_bars", 1).collect()] == ["AAPL"]


# --- analytics


def test_analytics(spark):
    days = raw(spark, linear(60, step=86400))
    sma = analytics.crossover(analytics.moving_averages(days))
    rows = sma.orderBy("ts").collect()
    assert rows[18]["sma20"] is None and abs(rows[19]["sma20"] - 101.15) < 1e-9 and rows[48]["position"] == 0 and rows[49]["signal"] == 1 and rows[50]["signal"] == 0
    assert abs(analytics.return_stats(days).first()["mean_return"] - 0.00097) < 1e-4
    g = grid(spark, [T0 + timedelta(days=i) for i in range(-1, 62)])
    filled = {r["ts"]: r for r in analytics.forward_fill(days.drop("ingest_seq"), g).collect()}
    assert filled[T0 - timedelta(1)]["close"] is None and filled[T0 + timedelta(61)]["open"] == filled[T0 + timedelta(59)]["close"] and filled[T0 + timedelta(61)]["volume"] == 0
    held = spark.createDataFrame([("AAPL", 2)], "symbol string, quantity int")
    assert analytics.portfolio_values(days, held).count() == 60
    quotes = spark.createDataFrame([("A", T0, 1.0, 2.0), ("A", T0 + timedelta(minutes=5), 1.0, 4.0)], "symbol string, ts timestamp, bid double, ask double")
    mean = values(analytics.decayed_spread(quotes, spark.createDataFrame([("A", 0.5)], "symbol string, tick_size double")), "ts", "mean")
    assert abs(mean[1][1] - (6 + 0.5 * 2) / 1.5) < 1e-9


def test_decayed_spread_by_buckets(spark):
    r = random.Random(2)
    data = []
    for symbol in "AB":
        at = T0 - timedelta(days=20_000)
        for k in range(400):
            at += timedelta(seconds=r.choice([0, 1, 50, 900, 7000])) + (timedelta(days=30) if k % 90 == 89 else timedelta(0))
            data.append((symbol, at, 1.0, None if r.random() < 0.1 or k % 90 < 3 else 1 + r.random()))
    quotes = spark.createDataFrame(data, "symbol string, ts timestamp, bid double, ask double").repartition(5)
    out = analytics.decayed_spread(quotes, spark.createDataFrame([("A", 0.5), ("B", 0.25)], "symbol string, tick_size double"))
    got = out.toPandas().sort_values(["symbol", "ts", "spread"]).reset_index(drop=True)
    assert len(got) == len(data)
    for _, one in got.groupby("symbol"):
        times = pd.to_datetime(one["ts"]).astype("datetime64[ns]")
        pd.testing.assert_series_equal(one["mean"], one["spread"].ewm(halflife="5min", times=times).mean(), check_names=False, rtol=1e-9)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "broadcast" not in plan.split("== Analyzed")[0]


# --- store


def test_store(spark, tmp_path):
    path, key = f"{tmp_path}/s", ("equity", "1m", "x")
    store.write(raw(spark, linear(100, start=datetime(2024, 1, 2, 9))), path, *key)
    assert store.read(spark, path, ["AAPL"], datetime(2024, 1, 2, 9, 35), datetime(2024, 1, 2, 9, 44)).count() == 10
    assert store.read(spark, path, ["MSFT"]).count() == 0 and store.read(spark, f"{tmp_path}/none").count() == 0
    plan = store.read(spark, path, ["AAPL"], datetime(2024, 1, 2, 9, 35), columns=["ts", "close"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "open" not in plan.split("ReadSchema")[1]
    assert store.library_size(store.files(spark, path)).first()["segments"] == 1


def test_range_update(spark, tmp_path):
    path, key = f"{tmp_path}/s", ("equity", "1m", "x")
    store.write(raw(spark, linear(10) + linear(5, symbol="B") + linear(3, start=datetime(2024, 2, 1))), path, *key)
    new = raw(spark, linear(3, start=T0 + timedelta(minutes=5), base=200.0))
    ranges = window(spark, T0 + timedelta(minutes=5), T0 + timedelta(minutes=7), "AAPL")
    for _ in range(2):  # again changes nothing
        store.update(new, ranges, path, *key)
        got = {r["ts"]: r["close"] for r in store.read(spark, path, ["AAPL"]).collect()}
        assert len(got) == 13 and got[T0] == 100.2 and got[T0 + timedelta(minutes=5)] == 200.2
    assert store.read(spark, path, ["B"]).count() == 5
    # An emptied month goes.
    store.update(new.limit(0), window(spark, datetime(2024, 2, 1), datetime(2024, 2, 2), "AAPL"), path, *key)
    assert store.read(spark, path, ["AAPL"]).count() == 10
    store.delete_symbol(spark, path, "AAPL", *key)
    assert {r["symbol"] for r in store.list_symbols(store.read(spark, path)).collect()} == {"B"}


def test_compact(spark, tmp_path):
    path, key = f"{tmp_path}/s", ("equity", "1m", "x")
    store.write(raw(spark, linear(500)), path, *key, rows_per_file=25)
    before = values(store.read(spark, path), "ts", "close")
    assert {r["status"] for r in store.compact(spark, path, dry_run=True).collect()} == {"would_defrag"}
    done = store.compact(spark, path, symbols=spark.createDataFrame([("ZZZ",)], "symbol string")).collect()
    assert {(r["status"], r["segments_before"], r["segments_after"]) for r in done} == {("defragmented", 20, 1), ("missing", None, None)}
    assert values(store.read(spark, path), "ts", "close") == before
    assert {r["status"] for r in store.compact(spark, path).collect()} == {"ok"}
