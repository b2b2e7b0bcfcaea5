"""Trading sessions by rule, and the grids of bar times they give."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import CALENDARS, SESSIONS


def _easter(year: int) -> date:
    """Easter Sunday in the Gregorian calendar (the anonymous computus)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return date(year, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1)


def _weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month; n = -1: the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _observed(day: date) -> date:
    return day + timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


# Days without trading that no rule gives.
_CLOSED = {date(2001, 9, d) for d in (11, 12, 13, 14)} | {date(1994, 4, 27), date(2004, 6, 11), date(2007, 1, 2), date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9)}


def nyse_holidays(year: int) -> set[date]:
    new_year = date(year, 1, 1)
    days = {
        new_year + timedelta(new_year.weekday() == 6),
        _weekday(year, 2, 0, 3),
        _easter(year) - timedelta(2),
        _weekday(year, 5, 0, -1),
        _observed(date(year, 7, 4)),
        _weekday(year, 9, 0, 1),
        _weekday(year, 11, 3, 4),
        _observed(date(year, 12, 25)),
    }
    if year >= 1998:
        days.add(_weekday(year, 1, 0, 3))
    if year >= 2022:
        days.add(_observed(date(year, 6, 19)))
    return days


def nyse_sessions(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Sessions of the New York exchange from first to last: 09:30 to 16:00 there, to 13:00 on early closes; about 250 rows a year."""
    rows, day = [], first
    while day <= last:
        if day.weekday() < 5 and day not in nyse_holidays(day.year) | _CLOSED:
            after_thanks = day == _weekday(day.year, 11, 3, 4) + timedelta(1)
            early = after_thanks or (day.month, day.day) == (12, 24) or (day.month, day.day) == (7, 3)
            rows.append((day, "13:00:00" if early else "16:00:00"))
        day += timedelta(1)
    local = spark.createDataFrame(rows, "session_date date, closes string")
    at = lambda t: F.to_utc_timestamp(F.concat_ws(" ", F.col("session_date").cast("string"), t).cast("timestamp"), "America/New_York")
    return local.select(F.lit("XNYS").alias("mic"), "session_date", at(F.lit("09:30:00")).alias("open_ts"), at(F.col("closes")).alias("close_ts"))


def cme_holidays(year: int) -> set[date]:
    """Days without an equity futures session: New Year's Day, Good Friday and Christmas (a Sunday's holiday on Monday, a Saturday's not moved)."""
    days = {_easter(year) - timedelta(2)}
    for day in (date(year, 1, 1), date(year, 12, 25)):
        days.add(day + timedelta(day.weekday() == 6))
    return days


def cme_sessions(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Sessions of CME equity futures from first to last: from 17:00 in Chicago on the evening before to 16:00, to 12:00 on the
    other holidays of the New York exchange and its early closes; about 257 rows a year.

    A session goes by the date it closes on, so it spans two dates of UTC. Other hours can be given as a table instead.
    """
    rows, day = [], first
    while day <= last:
        if day.weekday() < 5 and day not in cme_holidays(day.year):
            after_thanks = day == _weekday(day.year, 11, 3, 4) + timedelta(1)
            short = day in nyse_holidays(day.year) or after_thanks or (day.month, day.day) in ((12, 24), (7, 3))
            rows.append((day, "12:00:00" if short else "16:00:00"))
        day += timedelta(1)
    local = spark.createDataFrame(rows, "session_date date, closes string")
    at = lambda d, t: F.to_utc_timestamp(F.concat_ws(" ", d.cast("string"), t).cast("timestamp"), "America/Chicago")
    return local.select(F.lit("CME").alias("mic"), "session_date", at(F.date_sub("session_date", 1), F.lit("17:00:00")).alias("open_ts"), at(F.col("session_date"), F.col("closes")).alias("close_ts"))


def sessions_of(spark: SparkSession, asset: str, first: date, last: date) -> DataFrame | None:
    """Sessions of an asset type's calendar; None for continuous trading. An unknown type is an error."""
    if asset not in CALENDARS:
        raise ValueError(f"unknown asset type {asset!r}")
    makers = {"XNYS": nyse_sessions, "CME": cme_sessions}
    return makers[CALENDARS[asset]](spark, first, last) if CALENDARS[asset] else None


def no_sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SESSIONS)


def _steps(start: Column, end: Column, length: int) -> Column:
    """Times from start to end, both included."""
    return F.transform(F.sequence(F.unix_micros(start), F.unix_micros(end), F.lit(length)), F.timestamp_micros)


def _months(windows: DataFrame) -> DataFrame:
    """windows with the months they reach into, dealt over tasks by symbol and month: a long window is no one task's work."""
    months = F.sequence(F.trunc("start_ts", "month"), F.trunc("end_ts", "month"), F.expr("interval 1 month"))
    cut = windows.where("start_ts <= end_ts").withColumn("_month", F.explode(months))
    # A given number of partitions stays as it is, while small ones would be put together again before they grow.
    return cut.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "_month")


def _days(windows: DataFrame) -> DataFrame:
    """windows with session_date: the dates from start's to end's."""
    first, last = F.greatest(F.to_date("start_ts"), "_month"), F.least(F.to_date("end_ts"), F.last_day("_month"))
    return _months(windows).withColumn("session_date", F.explode(F.sequence(first, last))).drop("_month")


def in_sessions(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """windows with the sessions whose dates lie from start's to end's: windows are cut into days, which meet sessions on the date.

    Sessions are a small table by nature (some hundred rows a year), so they are broadcast.
    """
    return _days(windows).join(F.broadcast(sessions), "session_date")


def _timed() -> Column:
    return (F.col("start_ts") != F.date_trunc("day", "start_ts")) | (F.col("end_ts") != F.date_trunc("day", "end_ts"))


def exchange_grid(windows: DataFrame, sessions: DataFrame, length: int) -> DataFrame:
    """(symbol, ts) for windows (symbol, start_ts, end_ts): each session's bars from open to close, both included.

    Sessions go by the dates of start and end; bars are cut to the window only where start or end has a time of day.
    """
    each = in_sessions(windows, sessions).withColumn("ts", F.explode(_steps(F.col("open_ts"), F.col("close_ts"), length)))
    return each.where(~_timed() | F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).select("symbol", "ts")


def continuous_grid(windows: DataFrame, length: int) -> DataFrame:
    """(symbol, ts) from start on, at every bar length, end included; a month at a time."""
    start, month = F.unix_micros("start_ts"), F.unix_micros(F.col("_month").cast("timestamp"))
    after = F.unix_micros(F.add_months("_month", 1).cast("timestamp")) - 1
    first = start + F.ceil(F.greatest(month - start, F.lit(0)) / F.lit(length)) * length
    last = F.least(F.unix_micros("end_ts"), after)
    pieces = _months(windows).select("symbol", first.cast("long").alias("_first"), last.alias("_last")).where("_first <= _last")
    return pieces.select("symbol", F.explode(F.sequence("_first", "_last", F.lit(length))).alias("m")).select("symbol", F.timestamp_micros("m").alias("ts"))


def grid_ranges(windows: DataFrame, length: int, sessions: DataFrame | None = None) -> DataFrame:
    """(symbol, start_ts, end_ts): the first and last grid time of each window; windows without any fall away.

    A window of dates stands for whole sessions, which may open on the evening before and close after the last date has
    begun, so what belongs to it goes by these times and not by its own ends. No grid is worked out for it.
    """
    if sessions is None:
        steps = F.floor((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(length))
        return windows.where("start_ts <= end_ts").select("symbol", "start_ts", F.timestamp_micros(F.unix_micros("start_ts") + steps * length).alias("end_ts"))
    opened, closed = F.unix_micros("open_ts"), F.unix_micros("close_ts")
    low = F.when(_timed(), F.greatest(F.unix_micros("start_ts") - opened, F.lit(0))).otherwise(F.lit(0))
    high = F.when(_timed(), F.least(F.unix_micros("end_ts"), closed)).otherwise(closed) - opened
    first, last = opened + F.ceil(low / F.lit(length)) * length, opened + F.floor(high / F.lit(length)) * length
    each = in_sessions(windows, sessions).select("symbol", "start_ts", "end_ts", first.cast("long").alias("_first"), last.cast("long").alias("_last")).where("_first <= _last")
    ends = each.groupBy("symbol", "start_ts", "end_ts").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return ends.select("symbol", F.timestamp_micros("_first").alias("start_ts"), F.timestamp_micros("_last").alias("end_ts"))


def hourly_chunks(requests: DataFrame) -> DataFrame:
    """(symbol, chunk_start, chunk_end): hours from the start's hour on, the last cut at end."""
    hour = 3_600_000_000
    whole = requests.where("start_ts < end_ts").select("symbol", F.date_trunc("hour", "start_ts").alias("start_ts"), F.timestamp_micros(F.unix_micros("end_ts") - 1).alias("end_ts"), F.col("end_ts").alias("_until"))
    first = F.greatest(F.col("start_ts"), F.col("_month").cast("timestamp"))
    last = F.least(F.unix_micros("end_ts"), F.unix_micros(F.add_months("_month", 1).cast("timestamp")) - 1)
    each = _months(whole).select("symbol", "_until", F.explode(F.sequence(F.unix_micros(first), last, F.lit(hour))).alias("m"))
    return each.select("symbol", F.timestamp_micros("m").alias("chunk_start"), F.least(F.timestamp_micros(F.col("m") + hour), "_until").alias("chunk_end"))


def session_spans(sessions: DataFrame) -> DataFrame:
    """(session_date, chunk_start, chunk_end): a session's UTC day, or its own hours if it opens on the day before."""
    day = F.col("session_date").cast("timestamp")
    over = F.col("open_ts") < day
    return sessions.select("session_date", F.when(over, F.col("open_ts")).otherwise(day).alias("chunk_start"), F.when(over, F.col("close_ts")).otherwise(F.timestamp_micros(F.unix_micros(day) + 86_400_000_000 - 1)).alias("chunk_end"))


def session_chunks(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(symbol, chunk_start, chunk_end): the span of each session from start's to end's date."""
    return in_sessions(requests.select("symbol", "start_ts", "end_ts"), session_spans(sessions)).select("symbol", "chunk_start", "chunk_end")
