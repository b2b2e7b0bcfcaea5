"""Every registered query of the bar library with its SQL twin, over bars derived from the given tables.

events are ticks: symbol = event_type (or U and the user's number), price = value, size = 1. lineitem gives daily ticks:
symbol = S and the supplier's number, price = extended price / quantity, size = quantity.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import calendars, normalize
from barloom.operators import analytics, bars, blocks, gaps, profile, validate
from barloom.schema import BARS, FIELDS, RESOLUTIONS, calendar_of, library_name, provider_intervals
from barloom.sources import store

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR, DAY = RESOLUTIONS["1h"], RESOLUTIONS["1d"]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- inputs ---------------------------------------------------------------------------------------------------------


def ticks(spark: SparkSession, d: str, by: str = "event_type") -> DataFrame:
    symbol = F.col("event_type") if by == "event_type" else F.concat(F.lit("U"), F.col("user_id"))
    return spark.read.parquet(f"{d}/events.parquet").select(symbol.alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("ingest_seq"))


def daily_ticks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"))


def hourly(spark: SparkSession, d: str, by: str = "event_type") -> DataFrame:
    return bars.ticks_to_bars(ticks(spark, d, by), HOUR)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return bars.ticks_to_bars(daily_ticks(spark, d), DAY, order=("ts", "ingest_seq"))


def windows(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def sessions(spark: SparkSession, d: str, make: Callable = calendars.nyse_sessions) -> DataFrame:
    """Sessions over the dates of events; two dates come to the driver."""
    ends = ticks(spark, d).agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return make(spark, *ends) if ends[0] else calendars.no_sessions(spark)


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of users, spoilt by rule, with arrival order."""
    h = F.hour("ts")
    b = hourly(spark, d, "user").withColumn("ingest_seq", F.unix_micros("ts"))
    spoilt = b.withColumns({
        "volume": F.when(h == 3, None).when(h == 4, -1.0).when(h == 5, 0.0).otherwise(F.col("volume")),
        "open": F.when(h == 6, None).otherwise(F.col("open")),
        "high": F.when(h == 7, F.col("low") - 1).otherwise(F.col("high")),
        "low": F.when(h == 8, F.lit(-5.0)).otherwise(F.col("low")),
    })
    return spoilt.unionByName(spoilt.where(h == 9).withColumn("ingest_seq", F.col("ingest_seq") + 1))


def ntz(df: DataFrame) -> DataFrame:
    """Times without zone, as the SQL side has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _bars(name: str, source: str, unit: str, key: str = "ts") -> str:
    return f"{name} AS (SELECT symbol, date_trunc('{unit}', ts) AS ts, arg_min(price, {key}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {key}) AS close, sum(size) AS volume FROM {source} GROUP BY 1, date_trunc('{unit}', ts))"


TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price, 1.0 AS size FROM events)"
TICKS_U = "ticks AS (SELECT 'U' || user_id AS symbol, ts, value AS price, 1.0 AS size FROM events)"
TICKS_D = "ticks AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"
H1, H1U = f"{TICKS}, {_bars('h', 'ticks', 'hour')}", f"{TICKS_U}, {_bars('h', 'ticks', 'hour')}"
D1 = f"{TICKS_D}, {_bars('d', 'ticks', 'day', 'seq')}"
WINDOWS = "w AS (SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts FROM h GROUP BY symbol)"
GRID = f"{WINDOWS}, g AS (SELECT symbol, unnest(generate_series(start_ts, end_ts, INTERVAL 1 HOUR)) AS ts FROM w)"
PADDED = f"{GRID}, p AS (SELECT g.symbol, g.ts, open, high, low, close, coalesce(volume, 0) AS volume FROM g LEFT JOIN h ON g.symbol = h.symbol AND g.ts = h.ts)"
#: Weekdays but for the New York exchange's holidays in winter (New Year, Martin Luther King, Presidents' Day); hours of standard time.
XNYS = """sessions AS (SELECT s::DATE AS session_date, s + INTERVAL 870 MINUTE AS open_ts, s + INTERVAL 1260 MINUTE AS close_ts
    FROM (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS s FROM events)
    WHERE isodow(s) < 6 AND NOT (month(s) = 1 AND day(s) = 1) AND NOT (month(s) IN (1, 2) AND isodow(s) = 1 AND day(s) BETWEEN 15 AND 21))"""
XGRID = f"{WINDOWS}, {XNYS}, x AS (SELECT symbol, unnest(generate_series(open_ts, close_ts, INTERVAL 1 HOUR)) AS ts FROM w JOIN sessions ON session_date BETWEEN start_ts::DATE AND end_ts::DATE), xg AS (SELECT x.symbol, x.ts FROM x JOIN w USING (symbol) WHERE x.ts BETWEEN start_ts AND end_ts)"
DIRTY = """s AS (SELECT symbol, ts, CASE WHEN hour(ts) = 6 THEN NULL ELSE open END AS open, CASE WHEN hour(ts) = 7 THEN low - 1 ELSE high END AS high,
    CASE WHEN hour(ts) = 8 THEN -5.0 ELSE low END AS low, close,
    CASE WHEN hour(ts) = 3 THEN NULL WHEN hour(ts) = 4 THEN -1.0 WHEN hour(ts) = 5 THEN 0.0 ELSE volume END AS volume, epoch_us(ts) AS seq FROM h),
  r AS (SELECT * FROM s UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM s WHERE hour(ts) = 9),
  m AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) > 1 AS duplicate,
      coalesce(ts < lag(ts) OVER (PARTITION BY symbol ORDER BY seq), false) AS backward,
      coalesce(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY seq) < INTERVAL 1 HOUR, false) AS short,
      open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AS priced,
      coalesce(open, high, low, close) IS NOT NULL AS any_price FROM r)"""
_ORDER = "priced AND NOT (open BETWEEN low AND high AND close BETWEEN low AND high)"
_BASE = [("duplicate_ts", "error", "duplicate"), ("not_increasing", "error", "backward"), ("bad_spacing", "error", "short"), ("null_volume", "error", "volume IS NULL")]
_STAGES = {
    "raw": [*_BASE, ("price_order", "error", _ORDER), ("partial_prices", "warning", "volume > 0 AND NOT priced")],
    "storage": [*_BASE, ("price_order", "error", f"volume > 0 AND {_ORDER}"), ("traded_without_prices", "error", "volume > 0 AND NOT priced"), ("prices_without_trade", "error", "volume = 0 AND any_price")],
    "audit": [*_BASE, ("price_order", "error", _ORDER), ("traded_without_prices", "error", "volume > 0 AND NOT priced"), ("prices_without_trade", "error", "volume = 0 AND any_price"), ("negative_volume", "error", "volume < 0"), ("negative_price", "warning", "least(open, high, low, close) < 0")],
}


def _issues(stage: str) -> str:
    return " UNION ALL ".join(f"SELECT symbol, '{s}' AS severity, '{n}' AS category, count(*) AS n_bars, min(ts) AS first_ts FROM m WHERE {c} GROUP BY symbol" for n, s, c in _STAGES[stage])


_GRID_ISSUES = """SELECT symbol, 'error' AS severity, 'missing_bars' AS category, count(*) AS n_bars, min(ts) AS first_ts FROM g ANTI JOIN r USING (symbol, ts) GROUP BY symbol
  UNION ALL SELECT symbol, 'warning', 'extra_bars', count(DISTINCT ts), min(ts) FROM r ANTI JOIN g USING (symbol, ts) GROUP BY symbol"""
AUDIT = f"WITH {H1U}, {GRID}, {DIRTY}, found AS ({_issues('audit')} UNION ALL {_GRID_ISSUES})"
PROFILE = f"WITH {H1U}, {PADDED}, pr AS (SELECT symbol, min(ts) AS first_bar, max(ts) AS last_bar, count(*) AS total_bars, count(*) FILTER (volume = 0) AS null_bars, count(*) FILTER (volume <> 0) AS data_bars, sum(volume) AS total_volume FROM p GROUP BY symbol)"


def padded(spark: SparkSession, d: str, by: str = "user") -> DataFrame:
    h = hourly(spark, d, by)
    return bars.reindex(h, calendars.continuous_grid(windows(h), HOUR))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(padded(spark, d))


def found_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.audit(dirty(spark, d), calendars.continuous_grid(windows(hourly(spark, d, "user")), HOUR), HOUR)


def exchange_hours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = hourly(spark, d)
    return h, calendars.exchange_grid(windows(h), sessions(spark, d), HOUR)


# --- normalisation --------------------------------------------------------------------------------------------------


@query("SELECT 'C' || event_id AS symbol, date_trunc('millisecond', ts) AS ts, value AS open, value + 1 AS high, value - 1 AS low, value AS close, 2.0 AS volume FROM events")
def n1_klines(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    fields = [F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.col("value") + 1, F.col("value") - 1, F.col("value"), F.lit(2.0)]
    return ntz(normalize.from_klines(e.select(F.concat(F.lit("C"), "event_id").alias("symbol"), F.array(*[c.cast("string") for c in fields]).alias("k"))))


@query("SELECT 'C' || user_id AS symbol, date_trunc('millisecond', ts) AS ts, value AS open, value AS high, value AS low, value AS close, 3.0 AS volume, 0 AS ingest_seq FROM events")
def n2_aggregates(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    one = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), *[F.col("value").alias(k) for k in "ohlc"], F.lit(3.0).alias("v"), F.lit(7).alias("n"))
    pages = e.select(F.concat(F.lit("C"), "user_id").alias("symbol"), F.to_json(F.struct(F.array(one).alias("results"), F.lit("x").alias("next_url"))).alias("json"))
    return ntz(normalize.from_aggregates(pages))


@query("SELECT 'S' || l_suppkey AS symbol, timezone('UTC', timezone('America/New_York', l_shipdate + INTERVAL 570 MINUTE)) AS ts, l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low, l_extendedprice AS close, CAST(l_quantity AS DOUBLE) AS volume FROM lineitem")
def n3_capitalised_local_time(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    local = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + 570 * 60_000_000)
    raw = rows.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), local.alias("Date"), *[F.col("l_extendedprice").alias(c) for c in ("Open", "High", "Low", "Close", "Adj Close")], F.col("l_quantity").alias("Volume"))
    return ntz(normalize.from_capitalised(raw, zone="America/New_York"))


@query("SELECT 'E' || event_type AS symbol, ts, value AS open, value AS high, value AS low, value AS close, 1.0 AS volume FROM events")
def n4_lowercase(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return ntz(normalize.from_lowercase(e.select(F.concat(F.lit("E"), "event_type").alias("symbol"), F.col("ts").alias("ts_event"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume"))))


@query("SELECT symbol, ts, price, size, seq AS ingest_seq FROM (SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS size, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1")
def n8_keep_first(spark, d):
    return ntz(normalize.keep_first(daily_ticks(spark, d)))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'C' || c_custkey || 'USDT' WHEN c_custkey % 3 = 1 THEN 'C' || c_custkey || 'USDT' ELSE 'C' || c_custkey END AS crypto, 'B ' || c_custkey AS venue, c_custkey % 5 <> 0 AS valid, epoch_ms(TIMESTAMP '2024-01-02' + to_seconds(c_custkey)) AS ms FROM customer")
def n9_symbols(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    raw = F.concat(F.lit("c"), "c_custkey", F.element_at(F.array(F.lit("-usd"), F.lit("-usdt"), F.lit("-")), (F.col("c_custkey") % 3 + 1).cast("int")))
    odd = F.when(F.col("c_custkey") % 5 == 0, "-.-").otherwise(F.col("c_custkey").cast("string"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-02").cast("timestamp")) + F.col("c_custkey"))
    return c.select("c_custkey", normalize.crypto_symbol(raw).alias("crypto"), normalize.venue_symbol(F.concat(F.lit("B."), "c_custkey"), "ARCX.PILLAR").alias("venue"), normalize.valid_symbol(odd).alias("valid"), normalize.epoch_millis(at).alias("ms"))


@query("SELECT upper(w) AS symbol, CAST(min(s_suppkey) AS BIGINT) AS line FROM (SELECT s_suppkey, unnest(['a' || s_nationkey, 'b' || s_suppkey]) AS w FROM supplier) GROUP BY 1")
def n12_symbol_list(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lines = s.select(F.col("s_suppkey").cast("long").alias("line"), F.concat(F.lit(" a"), "s_nationkey", F.lit(", ,b"), "s_suppkey", F.lit("  # a, comment")).alias("value"))
    return normalize.parse_symbols(lines).select("symbol", "place.line")


@query(f"""WITH {TICKS_U}, {_bars('h', 'ticks', 'hour')}, {GRID}
    SELECT symbol, count(h.ts) AS rows_in, CASE WHEN bool_or(symbol LIKE '%3') THEN 0 ELSE count(*) END AS rows_out, CASE WHEN bool_or(symbol LIKE '%3') THEN 'error' ELSE 'ok' END AS status FROM g LEFT JOIN h USING (symbol, ts) GROUP BY symbol""")
def n5_normalise_library(spark, d):
    from barloom.jobs.normalise import normalise_library

    raw = hourly(spark, d, "user").select("symbol", F.unix_micros("ts").alias("ingest_seq"), F.col("ts").alias("Date"), *[F.col(f).alias(f.capitalize()) for f in FIELDS])
    spoilt = raw.withColumn("Volume", F.when(~F.col("symbol").like("%3"), F.col("Volume")))
    return normalise_library(spoilt, "1h", time="Date")[1]


@query("SELECT p.provider, p.resolution, p.native, p.native <> p.resolution AS needs_rollup, n FROM (SELECT 'databento' AS provider, unnest(['1m', '5m', '15m', '1h', '4h', '1d']) AS resolution, unnest(['1m', '1m', '1m', '1h', '1h', '1d']) AS native UNION ALL SELECT 'yfinance', unnest(['1m', '5m', '15m', '1h', '4h', '1d']), unnest(['1m', '5m', '15m', '1h', '1h', '1d']) UNION ALL SELECT unnest(['binance', 'massive']), r, r FROM (SELECT unnest(['1m', '5m', '15m', '1h', '4h', '1d']) AS r)) p JOIN (SELECT ['databento', 'yfinance', 'binance', 'massive'][CAST(c_custkey % 4 AS INTEGER) + 1] AS provider, ['1m', '5m', '15m', '1h', '4h', '1d'][CAST(c_custkey % 6 AS INTEGER) + 1] AS resolution, count(*) AS n FROM customer GROUP BY 1, 2) c ON c.provider = p.provider AND c.resolution = p.resolution")
def n11_provider_intervals(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % n + 1).cast("int"))
    asked = spark.read.parquet(f"{d}/customer.parquet").select(pick(["databento", "yfinance", "binance", "massive"], 4).alias("provider"), pick(["1m", "5m", "15m", "1h", "4h", "1d"], 6).alias("resolution"))
    return asked.groupBy("provider", "resolution").agg(F.count("*").alias("n")).join(F.broadcast(provider_intervals(spark)), ["provider", "resolution"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'invalid symbol' WHEN c_custkey % 3 = 0 THEN 'start is not before end' END AS problem FROM customer")
def n14_request_check(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    start = F.timestamp_seconds(F.col("c_custkey"))
    plan = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "-.-").otherwise("A").alias("symbol"), start.alias("start_ts"), F.when(F.col("c_custkey") % 3 == 0, start).otherwise(F.timestamp_seconds(F.col("c_custkey") + 60)).alias("end_ts"))
    return normalize.check_request(plan).select("c_custkey", "problem")


@query("SELECT 'C' || event_id AS symbol, date_trunc('millisecond', ts) AS ts, value AS open, value AS high, value AS low, value AS close, 1.0 AS volume, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' ELSE 'parquet' END AS kind FROM events")
def s10_landed_files(spark, d):
    from barloom.sources.landing import read_landed

    e = spark.read.parquet(f"{d}/events.parquet")
    price = [F.col("value").alias(f) for f in ("open", "high", "low", "close")]
    rows = e.select("event_id", F.concat(F.lit("C"), "event_id").alias("symbol"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), *price, F.lit(1.0).alias("volume"))
    out = None
    for k, kind in enumerate(("json", "csv", "parquet")):
        path = store.scratch(spark, f"landed-{kind}")
        w = rows.where(F.col("event_id") % 3 == k).drop("event_id").write.format(kind)
        (w.option("header", "true") if kind == "csv" else w).save(path)
        got = read_landed(spark, path, kind, BARS).where("ingest_seq.row >= 0").drop("ingest_seq").withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return ntz(out)


# --- calendars ------------------------------------------------------------------------------------------------------


@query(f"WITH {XNYS} SELECT 'XNYS' AS mic, CAST(session_date AS VARCHAR) AS session_date, open_ts, close_ts, (SELECT count(*) FROM events WHERE ts BETWEEN open_ts AND close_ts) AS events FROM sessions")
def c4_sessions(spark, d):
    e = ticks(spark, d).withColumn("session_date", F.to_date("ts"))
    joined = sessions(spark, d).join(e, "session_date", "left")
    return ntz(joined.groupBy("mic", "session_date", "open_ts", "close_ts").agg(F.count_if(F.col("ts").between(F.col("open_ts"), F.col("close_ts"))).alias("events")).withColumn("session_date", F.col("session_date").cast("string")))


@query("""WITH days AS (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS s FROM events),
    sessions AS (SELECT s::DATE AS session_date, s - INTERVAL 1 HOUR AS open_ts, s + CASE WHEN month(s) IN (1, 2) AND isodow(s) = 1 AND day(s) BETWEEN 15 AND 21 THEN INTERVAL 18 HOUR ELSE INTERVAL 22 HOUR END AS close_ts FROM days WHERE isodow(s) < 6 AND NOT (month(s) = 1 AND day(s) = 1))
    SELECT 'CME' AS mic, CAST(session_date AS VARCHAR) AS session_date, open_ts, close_ts, (SELECT count(*) FROM events WHERE ts BETWEEN open_ts AND close_ts) AS events FROM sessions""")
def c4_cme_sessions(spark, d):
    # A session spans two dates of UTC, so ticks meet the sessions of their own date and of the next.
    e = ticks(spark, d).withColumn("session_date", F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))))
    joined = sessions(spark, d, calendars.cme_sessions).join(e, "session_date", "left")
    return ntz(joined.groupBy("mic", "session_date", "open_ts", "close_ts").agg(F.count_if(F.col("ts").between(F.col("open_ts"), F.col("close_ts"))).alias("events")).withColumn("session_date", F.col("session_date").cast("string")))


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'equity' WHEN 1 THEN 'crypto' ELSE 'futures' END AS asset, CASE c_custkey % 3 WHEN 0 THEN 'XNYS' WHEN 2 THEN 'CME' END AS mic, count(*) AS n FROM customer GROUP BY ALL")
def c7_calendar_of_asset(spark, d):
    asset = F.element_at(F.array(F.lit("equity"), F.lit("crypto"), F.lit("futures")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select(asset.alias("asset")).withColumn("mic", calendar_of(F.col("asset"))).groupBy("asset", "mic").agg(F.count("*").alias("n"))


@query(f"WITH {H1}, {WINDOWS}, {XNYS}, n AS (SELECT symbol, unnest(generate_series(open_ts, close_ts, INTERVAL 1 HOUR)) AS ts FROM w JOIN sessions ON session_date BETWEEN start_ts::DATE AND end_ts::DATE) SELECT 'equity' AS asset, symbol, count(*) AS bars FROM n JOIN w USING (symbol) WHERE ts BETWEEN start_ts AND end_ts GROUP BY symbol UNION ALL SELECT 'crypto', symbol, 1 + date_diff('hour', start_ts, end_ts) FROM w")
def c7_grid_of_asset(spark, d):
    from barloom.jobs.load import grid_of_asset

    w = windows(hourly(spark, d))
    each = [grid_of_asset(w, asset, "1h").groupBy("symbol").agg(F.count("*").alias("bars")).withColumn("asset", F.lit(asset)) for asset in ("equity", "crypto")]
    return each[0].unionByName(each[1])


@query(f"WITH {H1}, {XGRID} SELECT * FROM xg")
def c1_exchange_grid(spark, d):
    return ntz(exchange_hours(spark, d)[1])


@query(f"WITH {H1U}, {GRID} SELECT * FROM g")
def c3_continuous_grid(spark, d):
    return ntz(calendars.continuous_grid(windows(hourly(spark, d, "user")), HOUR))


@query(f"WITH {TICKS_U}, w AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM ticks GROUP BY symbol), c AS (SELECT symbol, b, unnest(generate_series(date_trunc('hour', a), b - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS chunk_start FROM w WHERE a < b) SELECT symbol, chunk_start, least(chunk_start + INTERVAL 1 HOUR, b) AS chunk_end FROM c")
def c6_hourly_chunks(spark, d):
    return ntz(calendars.hourly_chunks(windows(ticks(spark, d, "user"))))


# --- bars -----------------------------------------------------------------------------------------------------------


@query(f"WITH {H1} SELECT * FROM h")
def a3_ticks_to_bars(spark, d):
    return ntz(hourly(spark, d))


@query(f"WITH {D1} SELECT * FROM d")
def a3_daily_bars(spark, d):
    return ntz(daily(spark, d))


@query(f"WITH {TICKS}, {_bars('h', 'ticks', 'hour')} SELECT * FROM h")
def a1_rollup(spark, d):
    return ntz(bars.rollup(bars.ticks_to_bars(ticks(spark, d), RESOLUTIONS["1m"]), HOUR))


@query(f"""WITH {H1U}, sp AS (SELECT symbol, median(gap) AS m FROM (SELECT symbol, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM h) GROUP BY symbol),
    f AS (SELECT h.*, coalesce(m < 14400000000, false) AS finer FROM h JOIN sp USING (symbol))
    SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM f WHERE finer GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts)
    UNION ALL SELECT symbol, ts, open, high, low, close, volume FROM f WHERE NOT finer""")
def a2_rollup_guard(spark, d):
    return ntz(bars.rollup_if_finer(hourly(spark, d, "user"), RESOLUTIONS["4h"]))


@query(f"""WITH {TICKS}, {_bars('h', 'ticks', 'day')}, {XNYS} SELECT symbol, coalesce(open_ts, ts) AS ts, open, high, low, close, volume FROM h LEFT JOIN sessions ON session_date = ts::DATE""")
def a4_snap_daily(spark, d):
    b = bars.ticks_to_bars(ticks(spark, d), DAY)
    w = windows(b).withColumns({"start_ts": F.date_trunc("day", "start_ts"), "end_ts": F.date_trunc("day", "end_ts")})
    grid = calendars.exchange_grid(w, sessions(spark, d), DAY)
    return ntz(bars.snap_daily(b.withColumn("ingest_seq", F.unix_micros("ts")), grid).drop("ingest_seq"))


@query(f"""WITH {H1}, {XGRID}, near AS (SELECT h.*, xg.ts AS grid_ts, row_number() OVER (PARTITION BY h.symbol, h.ts ORDER BY abs(epoch_us(h.ts) - epoch_us(xg.ts)), xg.ts DESC) AS k
      FROM h LEFT JOIN xg ON h.symbol = xg.symbol AND abs(epoch_us(h.ts) - epoch_us(xg.ts)) <= 1800000000),
    one AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY symbol, grid_ts ORDER BY ts) AS k FROM near WHERE k = 1),
    moved AS (SELECT symbol, ts AS was, CASE WHEN grid_ts IS NOT NULL AND k = 1 THEN grid_ts ELSE ts END AS ts, open, high, low, close, volume FROM one)
    SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY was) AS k FROM moved) WHERE k = 1""")
def a5_snap_nearest(spark, d):
    h, grid = exchange_hours(spark, d)
    return ntz(bars.snap(h.withColumn("ingest_seq", F.unix_micros("ts")), grid, HOUR).drop("ingest_seq"))


@query(f"WITH {H1U}, {PADDED} SELECT * FROM p")
def a7_reindex(spark, d):
    return ntz(padded(spark, d))


@query(f"WITH {H1}, {XGRID}, b AS (SELECT symbol, min(ts) AS actual_start, max(ts) AS actual_end FROM h GROUP BY symbol), e AS (SELECT symbol, min(ts) AS expected_start, max(ts) AS expected_end FROM xg GROUP BY symbol) SELECT * FROM b JOIN e USING (symbol) WHERE actual_start <> expected_start OR actual_end <> expected_end")
def a8_boundary(spark, d):
    return ntz(bars.boundary_mismatches(*exchange_hours(spark, d)))


#: All event types of the table.
_NAMES = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {H1} SELECT ts, {', '.join(f'any_value({f}) FILTER (symbol = {s!r}) AS {s}_{f}' for s in _NAMES for f in sorted(FIELDS))} FROM h GROUP BY ts")
def a9_align(spark, d):
    return ntz(bars.align(hourly(spark, d), _NAMES))


@query(f"WITH {H1} SELECT * FROM h")
def a10_wide_to_long(spark, d):
    return ntz(bars.to_long(bars.align(hourly(spark, d), _NAMES), _NAMES))


@query(f"WITH {H1U}, both_ AS (SELECT *, 0 AS own FROM h UNION ALL SELECT * REPLACE ('NEW' AS symbol), 1 FROM h WHERE symbol = 'U1' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') SELECT symbol, ts, open, high, low, close, volume FROM both_")
def a11_rename_stitch(spark, d):
    renames = spark.createDataFrame([("NEW", "U1", datetime(2024, 1, 5), datetime(2024, 1, 20))], "canonical string, alias string, valid_from timestamp, valid_to timestamp")
    return ntz(bars.stitch(hourly(spark, d, "user"), renames))


@query(f"""WITH {H1U}, {PADDED}, b AS (SELECT count(*) AS n, count(*) FILTER (volume = 0) AS z FROM p WHERE symbol = 'U2'),
    moved AS (SELECT ts FROM h WHERE symbol = 'U1' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'),
    after AS (SELECT ts, volume FROM p WHERE symbol = 'U2' AND ts NOT IN (SELECT ts FROM moved) UNION ALL SELECT ts, 1.0 FROM moved)
    SELECT 'U2' AS symbol, n AS bars_before, z AS null_before, (SELECT count(*) FROM after) AS bars_after, (SELECT count(*) FROM after WHERE volume = 0) AS null_after, z - (SELECT count(*) FROM after WHERE volume = 0) AS fixed FROM b""")
def a11_rename_report(spark, d):
    renames = spark.createDataFrame([("U2", "U1", datetime(2024, 1, 5), datetime(2024, 1, 20))], "canonical string, alias string, valid_from timestamp, valid_to timestamp")
    old = bars.ticks_to_bars(bars.of_tickers(ticks(spark, d, "user"), renames), HOUR)
    before = bars.reindex(old, calendars.continuous_grid(windows(old), HOUR))
    both = before.where("symbol <> 'U1'").unionByName(old.where("symbol = 'U1'"))
    return bars.stitch_report(before, bars.stitch(both, renames), renames)


# --- gaps -----------------------------------------------------------------------------------------------------------

_REQ = "req AS (SELECT DISTINCT symbol, TIMESTAMP '2024-01-03 10:20:00' AS start_ts, TIMESTAMP '2024-01-12 07:30:00' AS end_ts FROM h)"
_GAPS = f"""{H1U}, {_REQ}, ins AS (SELECT h.symbol, h.ts FROM h JOIN req USING (symbol) WHERE h.ts BETWEEN start_ts AND end_ts),
    c0 AS (SELECT symbol, end_ts, unnest(generate_series(date_trunc('hour', start_ts), end_ts - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS s FROM req),
    ch AS (SELECT symbol, s, least(s + INTERVAL 1 HOUR, end_ts) AS e FROM c0),
    miss AS (SELECT ch.* FROM ch WHERE symbol IN (SELECT symbol FROM ins) AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.symbol = ch.symbol AND ins.ts BETWEEN ch.s AND ch.e)),
    isl AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY s) AS island FROM (SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY symbol ORDER BY s) + INTERVAL 1 MICROSECOND OR lag(e) OVER (PARTITION BY symbol ORDER BY s) IS NULL THEN 1 ELSE 0 END AS n FROM miss)),
    gaps AS (SELECT symbol, min(s) AS gap_start, max(e) AS gap_end FROM isl GROUP BY symbol, island UNION ALL SELECT symbol, start_ts, end_ts FROM req WHERE symbol NOT IN (SELECT symbol FROM ins))"""


def requests(df: DataFrame) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp")
    return df.select("symbol").distinct().withColumns({"start_ts": at("2024-01-03 10:20:00"), "end_ts": at("2024-01-12 07:30:00")})


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def g1_hourly_gaps(spark, d):
    h = hourly(spark, d, "user")
    return ntz(gaps.hourly_gaps(h, requests(h)))


@query(f"""WITH {H1U}, {XNYS}, {_REQ}, ins AS (SELECT h.symbol, h.ts FROM h JOIN req USING (symbol) WHERE h.ts BETWEEN start_ts AND end_ts),
    ch AS (SELECT symbol, session_date::TIMESTAMP AS s, session_date::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS e FROM req JOIN sessions ON session_date BETWEEN start_ts::DATE AND end_ts::DATE),
    miss AS (SELECT ch.* FROM ch WHERE symbol IN (SELECT symbol FROM ins) AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.symbol = ch.symbol AND ins.ts BETWEEN ch.s AND ch.e)),
    isl AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY s) AS island FROM (SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY symbol ORDER BY s) + INTERVAL 1 MICROSECOND OR lag(e) OVER (PARTITION BY symbol ORDER BY s) IS NULL THEN 1 ELSE 0 END AS n FROM miss))
    SELECT symbol, min(s) AS gap_start, max(e) AS gap_end FROM isl GROUP BY symbol, island UNION ALL SELECT symbol, start_ts, end_ts FROM req WHERE symbol NOT IN (SELECT symbol FROM ins)""")
def g2_session_gaps(spark, d):
    h = hourly(spark, d, "user")
    return ntz(gaps.session_gaps(h, requests(h), sessions(spark, d)))


_LIFE = "life AS (SELECT 'U' || c_custkey AS symbol, TIMESTAMP '2024-01-01' + to_hours(c_custkey) AS ipo_date, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-11' END AS delist_date FROM customer)"


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    ipo = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("c_custkey") * 3600)
    return c.select(F.concat(F.lit("U"), "c_custkey").alias("symbol"), ipo.alias("ipo_date"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-11").cast("timestamp")).alias("delist_date"))


@query(f"WITH {H1U}, {_REQ}, {_LIFE} SELECT symbol, greatest(start_ts, coalesce(ipo_date, start_ts)) AS start_ts, least(end_ts, coalesce(delist_date, end_ts)) AS end_ts FROM req LEFT JOIN life USING (symbol) WHERE greatest(start_ts, coalesce(ipo_date, start_ts)) < least(end_ts, coalesce(delist_date, end_ts))")
def g4_clamp(spark, d):
    return ntz(gaps.clamp(requests(hourly(spark, d, "user")), lifecycle(spark, d)))


@query(f"WITH {_GAPS}, sp AS (SELECT symbol, min(gap_start) AS gap_start, max(gap_end) AS gap_end FROM gaps GROUP BY symbol) SELECT symbol, gap_start, gap_end, round((epoch_us(gap_end) - epoch_us(gap_start)) / 86400000000 * coalesce(rate, 0), 6) AS cost FROM sp LEFT JOIN (SELECT 'U' || c_custkey AS symbol, c_custkey % 7 + 0.5 AS rate FROM customer) USING (symbol)")
def g5_cost(spark, d):
    h = hourly(spark, d, "user")
    rates = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("U"), "c_custkey").alias("symbol"), (F.col("c_custkey") % 7 + 0.5).alias("rate"))
    return ntz(gaps.cost(gaps.hourly_gaps(h, requests(h)), rates).withColumn("cost", F.round("cost", 6)))


@query(f"WITH {H1U}, {GRID} SELECT symbol, ts, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS close, 0.0 AS volume FROM g WHERE symbol NOT IN (SELECT symbol FROM h WHERE ts < TIMESTAMP '2024-01-02') AND symbol IN (SELECT symbol FROM h WHERE ts > TIMESTAMP '2024-01-20')")
def g6_null_grids(spark, d):
    h = hourly(spark, d, "user")
    return ntz(gaps.null_grids(calendars.continuous_grid(windows(h), HOUR), h.where("ts < timestamp'2024-01-02'"), h.where("ts > timestamp'2024-01-20'")))


@query(f"""WITH {H1U}, {_LIFE}, cached AS (SELECT symbol, CAST(NULL AS TIMESTAMP) AS ipo, CAST(NULL AS TIMESTAMP) AS gone FROM (SELECT DISTINCT symbol FROM h) WHERE symbol LIKE '%1'), f AS (SELECT symbol, min(ts) AS first_bar FROM h GROUP BY symbol), ref AS (SELECT * FROM life WHERE symbol LIKE '%2')
    SELECT f.symbol, CASE WHEN c.symbol IS NOT NULL THEN c.ipo ELSE coalesce(ref.ipo_date, first_bar) END AS ipo_date, CASE WHEN c.symbol IS NOT NULL THEN c.gone ELSE ref.delist_date END AS delist_date,
      CASE WHEN c.symbol IS NOT NULL THEN 'cached' WHEN ref.ipo_date IS NOT NULL THEN 'reference' ELSE 'discovered' END AS source FROM f LEFT JOIN cached c ON c.symbol = f.symbol LEFT JOIN ref ON ref.symbol = f.symbol""")
def g7_bootstrap_lifecycle(spark, d):
    h = hourly(spark, d, "user")
    cached = h.select("symbol").distinct().where("symbol like '%1'").selectExpr("symbol", "cast(null as timestamp) as ipo_date", "cast(null as timestamp) as delist_date")
    return ntz(gaps.bootstrap_lifecycle(h, cached, lifecycle(spark, d).where("symbol like '%2'"), h))


@query("SELECT 'K' || o_custkey AS symbol, arg_max(o_orderdate, o_orderkey) AS ipo_date, CAST(NULL AS TIMESTAMP) AS delist_date, to_timestamp(max(o_orderkey)) AT TIME ZONE 'UTC' AS discovered_at FROM orders GROUP BY 1")
def g8_upsert_lifecycle(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("K"), "o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ipo_date"), F.lit(None).cast("timestamp").alias("delist_date"), F.timestamp_seconds("o_orderkey").alias("discovered_at"), "o_orderkey")
    old, new = o.where("o_orderkey % 2 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 1").drop("o_orderkey")
    return ntz(gaps.upsert_lifecycle(old, new))


@query(f"WITH {D1} SELECT symbol, min(ts) AS first_bar FROM d GROUP BY symbol")
def g9_first_bars(spark, d):
    return ntz(gaps.first_bars(daily(spark, d)))


# --- checks and profiles --------------------------------------------------------------------------------------------


@query(f"WITH {H1U}, {DIRTY} {_issues('raw')}")
def v13_raw_issues(spark, d):
    return ntz(validate.issues(dirty(spark, d), HOUR, "raw"))


@query(f"WITH {H1U}, {DIRTY} {_issues('storage')}")
def v14_storage_issues(spark, d):
    return ntz(validate.issues(dirty(spark, d), HOUR, "storage"))


@query(f"{AUDIT} SELECT * FROM found")
def v15_audit(spark, d):
    return ntz(found_issues(spark, d))


@query(f"{AUDIT} SELECT category, count(*) AS issues, CAST(sum(n_bars) AS BIGINT) AS n_bars, count(DISTINCT symbol) AS symbols FROM found GROUP BY category")
def p7_issue_totals(spark, d):
    return profile.issue_totals(found_issues(spark, d))


@query(f"{AUDIT}, n AS (SELECT symbol, count(*) AS issues, coalesce(sum(n_bars) FILTER (category = 'missing_bars'), 0) AS missing FROM found GROUP BY symbol) SELECT e.symbol, expected, found_ AS found, coalesce(issues, 0) AS issues, CAST(coalesce(missing, 0) AS BIGINT) AS missing_bars, issues IS NULL AS is_clean FROM (SELECT symbol, count(*) AS expected FROM g GROUP BY symbol) e JOIN (SELECT symbol, count(*) AS found_ FROM r GROUP BY symbol) f USING (symbol) LEFT JOIN n USING (symbol)")
def v15_report(spark, d):
    return validate.audit_report(dirty(spark, d), calendars.continuous_grid(windows(hourly(spark, d, "user")), HOUR), HOUR)


@query(f"WITH {H1U}, {PADDED} SELECT symbol, count(*) AS expected, count(*) AS found, 0 AS issues, 0 AS missing_bars, true AS is_clean FROM p GROUP BY symbol")
def v16_clean_symbols(spark, d):
    p = padded(spark, d)
    return validate.audit_report(p.withColumn("ingest_seq", F.unix_micros("ts")), calendars.continuous_grid(windows(p), HOUR), HOUR, in_time=True)


@query(f"WITH {H1U} SELECT symbol, 'error' AS severity, 'no_volume_column' AS category, count(*) AS n_bars, min(ts) AS first_ts FROM h GROUP BY symbol")
def v7_schema(spark, d):
    return ntz(validate.issues(hourly(spark, d, "user").drop("volume"), HOUR, "raw"))


@query(f"{AUDIT} SELECT category, symbol, CAST(sum(n_bars) AS BIGINT) AS n_bars FROM found GROUP BY ALL")
def p7_affected_symbols(spark, d):
    return profile.affected_symbols(found_issues(spark, d))


@query(f"{AUDIT}, pr AS (SELECT symbol, count(*) AS n FROM r GROUP BY symbol) SELECT count(*) AS symbols, CAST(sum(n) AS BIGINT) AS total_bars, CAST(sum(n) * 10 AS BIGINT) AS size_bytes, (SELECT count(DISTINCT symbol) FROM found) AS symbols_with_issues FROM pr")
def p4_summary(spark, d):
    b = dirty(spark, d)
    sizes = b.groupBy("symbol").agg((F.count("*") * 10).alias("size_bytes"))
    return profile.overview(profile.profile(b, sizes=sizes, found=found_issues(spark, d))).select("symbols", "total_bars", "size_bytes", "symbols_with_issues")


@query(f"WITH {H1}, {PADDED} SELECT symbol, min(ts) AS first_bar, max(ts) AS last_bar, count(*) AS total_bars, count(*) FILTER (volume = 0) AS null_bars, count(*) FILTER (volume <> 0) AS data_bars, sum(volume) AS total_volume FROM p GROUP BY symbol")
def p1_profile(spark, d):
    return ntz(profile.profile(padded(spark, d, "event_type")).drop("size_bytes", "issue_count"))


@query(f"{PROFILE} SELECT count(*) AS symbols, CAST(sum(total_bars) AS BIGINT) AS total_bars, min(first_bar) AS first_bar, max(last_bar) AS last_bar FROM pr")
def p3_overview(spark, d):
    return ntz(profile.overview(profiles(spark, d)).select("symbols", "total_bars", "first_bar", "last_bar"))


@query(f"{PROFILE} SELECT symbol, round(null_bars / total_bars, 9) AS null_share, CASE WHEN null_bars = 0 THEN 'clean' WHEN null_bars / total_bars < 0.01 THEN 'good' WHEN null_bars / total_bars < 0.05 THEN 'warning' ELSE 'critical' END AS health FROM pr")
def p5_health(spark, d):
    return profile.with_health(profiles(spark, d)).select("symbol", F.round("null_share", 9).alias("null_share"), "health")


@query(f"{PROFILE} SELECT count(*) FILTER (null_bars = 0) AS clean, count(*) FILTER (null_bars > 0 AND null_bars / total_bars <= 0.01) AS good, count(*) FILTER (null_bars / total_bars > 0.01 AND null_bars / total_bars <= 0.05) AS warning, count(*) FILTER (null_bars / total_bars > 0.05) AS critical FROM pr")
def p6_health_counts(spark, d):
    return profile.health_counts(profiles(spark, d))


@query(f"{PROFILE} SELECT symbol, total_bars FROM pr ORDER BY total_bars DESC, symbol LIMIT 20")
def p8_ranking(spark, d):
    return profile.ranking(profiles(spark, d), "total_bars", 20).select("symbol", "total_bars")


@query("SELECT event_type AS provider, 'U' || user_id AS symbol, count(*) AS rows, count(DISTINCT ts::DATE) AS fetches, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL")
def p9_load_counters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("provider"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.to_date("ts").alias("fetch_id"), F.length("props").alias("b"))
    return profile.load_counters(e, bytes_col="b")


# --- store ----------------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, d: str, rows_per_file: int = 0) -> str:
    path = store.scratch(spark, "bars")
    store.write(hourly(spark, d), path, "crypto", "1h", "events", rows_per_file)
    return path


@query(f"WITH {H1} SELECT symbol, ts, close FROM h WHERE symbol IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-09 17:00:00'")
def s1_read_range(spark, d):
    return ntz(store.read(spark, _stored(spark, d), ["click", "view"], datetime(2024, 1, 5, 3), datetime(2024, 1, 9, 17), ["symbol", "ts", "close"], "crypto", "1h", "events"))


_UPDATED = "SELECT symbol, ts, open, high, low, CASE WHEN symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-08' THEN close + 1 ELSE close END AS close, volume FROM h WHERE NOT (symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-08' AND hour(ts) % 2 = 1)"


@query(f"WITH {H1} {_UPDATED}")
def s3_range_update(spark, d):
    path = _stored(spark, d)
    new = hourly(spark, d).where("symbol = 'click' and ts between timestamp'2024-01-04' and timestamp'2024-01-08' and hour(ts) % 2 = 0").withColumn("close", F.col("close") + 1)
    ranges = spark.createDataFrame([("click", datetime(2024, 1, 4), datetime(2024, 1, 8))], "symbol string, start_ts timestamp, end_ts timestamp")
    store.update(new, ranges, path, "crypto", "1h", "events")
    return ntz(store.read(spark, path))


@query(f"WITH {H1} SELECT * FROM h WHERE symbol <> 'click'")
def s4_delete_symbol(spark, d):
    path = _stored(spark, d)
    store.delete_symbol(spark, path, "click", "crypto", "1h", "events")
    return ntz(store.read(spark, path))


@query(f"WITH {H1U}, wanted AS (SELECT 'U' || c_custkey AS symbol FROM customer) SELECT symbol, symbol IN (SELECT symbol FROM h) AS there, 'crypto-1h-events' AS library FROM wanted")
def s6_wanted_symbols(spark, d):
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("U"), "c_custkey").alias("symbol"))
    return store.wanted_and_there(wanted, hourly(spark, d, "user")).withColumn("library", library_name("crypto", "1h", "events"))


@query(f"WITH {H1} SELECT 'crypto-1h-events' AS library, symbol, min(ts) AS range_start, max(ts) AS range_end, 'events' AS provider FROM h GROUP BY symbol")
def s8_provenance(spark, d):
    return ntz(store.provenance(hourly(spark, d), "crypto-1h-events", "events").drop("loaded_at", "note"))


@query(f"WITH {H1} SELECT * FROM h")
def m2_compact_keeps_rows(spark, d):
    path = _stored(spark, d, 50)
    store.compact(spark, path)
    return ntz(store.read(spark, path))


# --- analytics ------------------------------------------------------------------------------------------------------

_SMA = f"""{D1}, a AS (SELECT symbol, ts, close, CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma20, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma50 FROM d
    WINDOW w20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING))"""


@query(f"WITH {_SMA} SELECT symbol, ts, round(sma20, 6) AS sma20, round(sma50, 6) AS sma50 FROM a")
def w1_moving_averages(spark, d):
    return ntz(analytics.moving_averages(daily(spark, d), block=blocks.span(DAY)).select("symbol", "ts", F.round("sma20", 6).alias("sma20"), F.round("sma50", 6).alias("sma50")))


@query(f"WITH {_SMA}, p AS (SELECT *, CASE WHEN sma20 > sma50 THEN 1 WHEN sma20 < sma50 THEN -1 ELSE 0 END AS position FROM a) SELECT symbol, ts, position, coalesce(position - lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0) AS signal FROM p")
def w2_crossover(spark, d):
    return ntz(analytics.crossover(analytics.moving_averages(daily(spark, d), block=blocks.span(DAY)), block=blocks.span(DAY)).select("symbol", "ts", "position", "signal"))


@query(f"WITH {D1}, r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM d) SELECT symbol, round(avg(ret), 9) AS mean_return, round(stddev_samp(ret), 9) AS std_return FROM r GROUP BY symbol")
def w3_return_stats(spark, d):
    return analytics.return_stats(daily(spark, d), blocks.span(DAY)).select("symbol", F.round("mean_return", 9).alias("mean_return"), F.round("std_return", 9).alias("std_return"))


@query(f"WITH {H1U}, {GRID}, f AS (SELECT g.symbol, g.ts, open, high, low, close, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS lc FROM g LEFT JOIN h ON g.symbol = h.symbol AND g.ts = h.ts) SELECT symbol, ts, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, coalesce(close, lc) AS close, coalesce(volume, 0) AS volume FROM f")
def w4_forward_fill(spark, d):
    h = hourly(spark, d, "user")
    return ntz(analytics.forward_fill(h, calendars.continuous_grid(windows(h), HOUR)))


@query("WITH t AS (SELECT event_type AS publisher, 'U' || user_id AS symbol, ts, value FROM events) SELECT publisher, symbol, date_trunc('day', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t GROUP BY 1, 2, date_trunc('day', ts)")
def w5_resample_by_two_keys(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("publisher"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    hours = bars.ticks_to_bars(t, HOUR, ("publisher", "symbol"))
    return ntz(bars.rollup(hours, DAY, ("publisher", "symbol")))


@query(f"WITH {D1} SELECT CAST(ts::DATE AS VARCHAR) AS day, round(sum(close * (s_suppkey % 10 + 1)), 4) AS value FROM d JOIN supplier ON symbol = 'S' || s_suppkey GROUP BY 1")
def w6_portfolio(spark, d):
    held = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), (F.col("s_suppkey") % 10 + 1).alias("quantity"))
    return analytics.portfolio_values(daily(spark, d), held).select(F.col("day").cast("string").alias("day"), F.round("value", 4).alias("value"))


@query("""WITH v AS (SELECT l_partkey AS instrument, arg_max(l_quantity, (l_shipdate, l_orderkey, l_quantity)) AS volume FROM lineitem GROUP BY 1), j AS (SELECT instrument, volume, p_brand AS product, 0.01 AS tick_size FROM v JOIN part ON instrument = p_partkey),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY volume DESC, instrument) AS n FROM j) WHERE n = 1 ORDER BY volume DESC, product LIMIT 25)
    SELECT instrument, CAST(volume AS DOUBLE) AS volume, product, tick_size, median(l_quantity) AS median_size, round(median(l_discount / tick_size), 6) AS median_spread FROM b JOIN lineitem ON l_partkey = instrument GROUP BY ALL""")
def w7_liquid_universe(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    vol = li.select(F.col("l_partkey").alias("instrument"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey"), F.col("l_quantity").cast("double").alias("volume"))
    defs = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("instrument"), F.lit(0).alias("ts"), F.col("p_brand").alias("product"), F.lit(0.01).alias("tick_size"))
    quotes = li.select(F.col("l_partkey").alias("instrument"), F.lit(0.0).alias("bid"), F.col("l_discount").alias("ask"), F.col("l_quantity").alias("bid_size"), F.col("l_quantity").alias("ask_size"))
    return analytics.liquid_universe(vol, defs, quotes).withColumn("median_spread", F.round("median_spread", 6))


@query("""WITH c AS (SELECT event_type AS product, user_id % 6 AS contract, ts::DATE AS day, DATE '2024-01-10' + CAST(user_id % 6 * 5 AS INTEGER) AS expiry, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3, 4),
    p AS (SELECT *, lag(volume) OVER (PARTITION BY product, contract ORDER BY day) AS prior FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY product, day ORDER BY prior DESC NULLS LAST, expiry, contract) - 1 AS rank FROM p WHERE expiry >= day)
    SELECT product || '.v.' || rank AS symbol, CAST(day AS VARCHAR) AS day, contract, close FROM r WHERE rank < 2""")
def w8_continuous_contracts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("product"), (F.col("user_id") % 6).alias("contract"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), "value")
    c = e.groupBy("product", "contract", "day").agg(F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")).withColumn("expiry", F.date_add(F.lit("2024-01-10").cast("date"), (F.col("contract") * 5).cast("int"))).withColumn("open_interest", F.col("volume"))
    return analytics.continuous_contracts(c).withColumn("day", F.col("day").cast("string"))


#: Five hours are sixty half-lives: what is older weighs less than a double's last bit.
@query("""WITH q AS (SELECT event_type AS symbol, ts, value / 0.5 AS spread FROM events)
    SELECT a.symbol, a.ts, a.spread, round(sum(b.spread * pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / 3e8)) / sum(pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / 3e8)), 6) AS mean
    FROM q a JOIN q b ON a.symbol = b.symbol AND b.ts BETWEEN a.ts - INTERVAL 5 HOUR AND a.ts AND (b.ts < a.ts OR b.spread <= a.spread) GROUP BY ALL""")
def w9_decayed_spread(spark, d):
    t = ticks(spark, d)
    quotes = t.select("symbol", "ts", F.lit(0.0).alias("bid"), F.col("price").alias("ask"))
    out = analytics.decayed_spread(quotes, t.select("symbol").distinct().withColumn("tick_size", F.lit(0.5)))
    return ntz(out.withColumn("mean", F.round("mean", 6)))


@query("WITH t AS (SELECT 'U' || user_id AS symbol, count(*) AS n FROM events GROUP BY 1) SELECT symbol, n, c_mktsegment FROM t JOIN customer ON symbol = 'U' || c_custkey")
def w10_enrich(spark, d):
    master = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("U"), "c_custkey").alias("symbol"), "c_mktsegment")
    return analytics.enrich(ticks(spark, d, "user").groupBy("symbol").agg(F.count("*").alias("n")), master)


# --- jobs and streams -----------------------------------------------------------------------------------------------


@query(f"WITH {H1U}, {GRID} SELECT symbol, ts, CASE WHEN h.close IS NULL THEN 0.0 ELSE h.volume END AS volume, h.close FROM g LEFT JOIN h USING (symbol, ts)")
def job_load(spark, d):
    from barloom.jobs.load import load

    path, h = store.scratch(spark, "bars"), hourly(spark, d, "user")
    want = windows(h)
    todo = want.select("symbol", F.col("start_ts").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    load(h.withColumn("ingest_seq", F.unix_micros("ts")), todo, path, "crypto", "1h", "events")
    return ntz(store.read(spark, path, columns=["symbol", "ts", "volume", "close"]))


@query(f"WITH {H1U}, {GRID} SELECT count(*) AS bars, count(DISTINCT symbol) AS symbols, 0 AS gaps_left, count(*) FILTER (symbol LIKE '%7') AS null_bars FROM g")
def job_load_again(spark, d):
    """All symbols have a first bar; then a load for which nothing of some symbols lands: nothing is left to plan."""
    from barloom.jobs.load import load

    path, h = store.scratch(spark, "bars"), store.materialised(hourly(spark, d, "user").withColumn("ingest_seq", F.unix_micros("ts")))
    want = store.materialised(windows(h))
    first = want.select("symbol", F.col("start_ts").alias("gap_start"), F.col("start_ts").alias("gap_end"))
    load(h, first, path, "crypto", "1h", "events")
    todo = want.select("symbol", F.col("start_ts").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    load(h.where("symbol not like '%7'"), todo, path, "crypto", "1h", "events")
    life = spark.createDataFrame([], "symbol string, ipo_date timestamp, delist_date timestamp")
    stored = store.read(spark, path)
    left = gaps.plan(stored, want.where("start_ts < end_ts"), life)
    counts = stored.agg(F.count("*").alias("bars"), F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("symbol").like("%7") & F.col("close").isNull()).alias("null_bars"))
    return counts.crossJoin(left.agg(F.count("*").alias("gaps_left")))  # a row each


@query(f"WITH {H1U} SELECT symbol, 'error' AS severity, 'null_volume' AS category, count(*) AS n_bars, min(ts) AS first_ts, false AS stored FROM h WHERE symbol LIKE '%7' GROUP BY symbol")
def job_load_issues(spark, d):
    from barloom.jobs.load import load, load_issues

    path, h = store.scratch(spark, "bars"), hourly(spark, d, "user").withColumn("ingest_seq", F.unix_micros("ts"))
    todo = windows(h).select("symbol", F.col("start_ts").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    load(h.withColumn("volume", F.when(~F.col("symbol").like("%7"), F.col("volume"))), todo, path, "crypto", "1h", "events")
    there = store.list_symbols(store.read(spark, path)).withColumn("stored", F.lit(True))
    found = load_issues(spark, path).join(there, "symbol", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    return ntz(found.select("symbol", "severity", "category", "n_bars", "first_ts", "stored"))


@query(f"WITH {H1U}, {GRID} SELECT 'crypto-1h-events' AS library, symbol, start_ts AS range_start, end_ts AS range_end, 'events' AS provider, 'first' AS note FROM w")
def s8_stored_provenance(spark, d):
    from barloom.jobs.load import load, loads

    path, h = store.scratch(spark, "bars"), hourly(spark, d, "user").withColumn("ingest_seq", F.unix_micros("ts"))
    todo = windows(h).select("symbol", F.col("start_ts").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    load(h, todo, path, "crypto", "1h", "events", note="first")
    return ntz(loads(spark, path).drop("loaded_at", "load_id"))


@query(f"WITH {H1}, {GRID} SELECT symbol, ts, close, coalesce(volume, 0) AS volume FROM g LEFT JOIN h USING (symbol, ts)")
def st1_ingested_bars(spark, d):
    """Files of raw bars that land are loaded into the store by a stream."""
    from barloom.streaming.live import ingest_bars

    path, landing, state = (store.scratch(spark, n) for n in ("bars", "landing", "state"))
    hourly(spark, d).withColumn("ingest_seq", F.unix_micros("ts")).coalesce(1).write.parquet(landing)
    ingest_bars(spark, landing, BARS + ", ingest_seq bigint", state, path, "crypto", "1h", "events").awaitTermination()
    return ntz(store.read(spark, path, columns=["symbol", "ts", "close", "volume"]))


@query(f"WITH {TICKS}, {_bars('h', 'ticks', 'minute')} SELECT * FROM h WHERE ts + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)")
def st2_live_bars(spark, d):
    from barloom.streaming.live import live_bars

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    live = live_bars(stream.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size")))
    out = store.scratch(spark, "live")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return ntz(spark.read.parquet(out))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from barloom import registry_jobs  # noqa: F401  (adds its own)

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from barloom import registry_jobs  # noqa: F401

    return dict(SQL)
