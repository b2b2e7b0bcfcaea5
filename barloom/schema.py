"""Names, types and fixed dimensions of the bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
RAW = BARS + ", ingest_seq bigint"
SESSIONS = "mic string, session_date date, open_ts timestamp, close_ts timestamp"
GAPS = "symbol string, gap_start timestamp, gap_end timestamp"
LIFECYCLE = "symbol string, ipo_date timestamp, delist_date timestamp, discovered_at timestamp"

# Calendars of asset types, and bar lengths in microseconds.
CALENDARS = {"equity": "XNYS", "crypto": None, "futures": "CME"}
# The interval a provider has for each bar length; a shorter one than asked is rolled up here.
PROVIDER_INTERVALS = {
    "databento": {"1m": "1m", "5m": "1m", "15m": "1m", "1h": "1h", "4h": "1h", "1d": "1d"},
    "yfinance": {"1m": "1m", "5m": "5m", "15m": "15m", "1h": "1h", "4h": "1h", "1d": "1d"},
    "binance": {"1m": "1m", "5m": "5m", "15m": "15m", "1h": "1h", "4h": "4h", "1d": "1d"},
    "massive": {"1m": "1m", "5m": "5m", "15m": "15m", "1h": "1h", "4h": "4h", "1d": "1d"},
}
MINUTE = 60_000_000
RESOLUTIONS = {"1m": MINUTE, "5m": 5 * MINUTE, "15m": 15 * MINUTE, "1h": 60 * MINUTE, "4h": 240 * MINUTE, "1d": 1440 * MINUTE}


def micros(resolution: str) -> int:
    """Length of a bar; an unknown resolution is an error."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}")
    return RESOLUTIONS[resolution]


def provider_intervals(spark: SparkSession) -> DataFrame:
    """(provider, resolution, native, needs_rollup): a row for each pair, some dozens in all."""
    rows = [(p, r, native, native != r) for p, intervals in PROVIDER_INTERVALS.items() for r, native in intervals.items()]
    return spark.createDataFrame(rows, "provider string, resolution string, native string, needs_rollup boolean")


def calendar_of(asset: Column) -> Column:
    """Code of the calendar of an asset type; null for continuous trading, an unknown type is an error."""
    out = F.raise_error(F.concat(F.lit("unknown asset type "), F.coalesce(asset, F.lit("null")))).cast("string")
    for name, mic in CALENDARS.items():
        out = F.when(asset == name, F.lit(mic).cast("string")).otherwise(out)
    return out


def by_day(rows: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """rows (symbol, ts) that lie in a range (symbol, start_ts, end_ts; ends included) of their symbol: how = left_semi, or that don't: left_anti.

    Ranges are cut into days, so rows meet only those of their day, and one symbol's rows go to many tasks.
    """
    day = F.to_date("start_ts"), F.to_date("end_ts")
    days = ranges.where("start_ts <= end_ts").select("symbol", "start_ts", "end_ts", F.explode(F.sequence(*day)).alias("day"))
    hit = (rows["symbol"] == days["symbol"]) & (F.to_date(rows["ts"]) == days["day"]) & (rows["ts"] >= days["start_ts"]) & (rows["ts"] <= days["end_ts"])
    # The optimiser takes days for as small as the ranges they are cut from: without the hint they would be broadcast.
    return rows.join(days.hint("merge"), hit, how)


def library_name(asset: Column | str, resolution: Column | str, provider: Column | str) -> Column:
    return F.concat_ws("-", *[c if isinstance(c, Column) else F.lit(c) for c in (asset, resolution, provider)])


def floor_to(ts: Column, length: int) -> Column:
    """Start of the UTC-aligned bin of so many microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(length)))


def nan_to_null(df: DataFrame, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """No value is null everywhere here; NaN would count as the largest number."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in df.columns})
