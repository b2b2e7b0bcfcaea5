"""Incremental load: from a plan of gaps and landed vendor rows to stored bars and aligned reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.calendars import continuous_grid, exchange_grid, grid_ranges, sessions_of
from barloom.functions.normalize import keep_first
from barloom.operators.bars import reindex, rollup_if_finer, snap, snap_daily
from barloom.operators.gaps import null_grids
from barloom.operators.validate import ISSUES, issues, quarantine
from barloom.schema import FIELDS, by_day, micros
from barloom.sources.store import appended, is_committed, materialised, provenance, scratch_tables, spans, update

PROVENANCE = "library string, symbol string, range_start timestamp, range_end timestamp, provider string, loaded_at timestamp, note string, load_id string"
LOAD_ISSUES = ISSUES + ", loaded_at timestamp, load_id string"


def wanted_rows(landed: DataFrame, gaps: DataFrame, resolution: str = "1m", sessions: DataFrame | None = None) -> DataFrame:
    """Landed rows that belong to a gap of their symbol.

    Those in the gap itself, and with sessions also those from the first session's open (for daily bars its date) until a
    bar after the last one's close: a gap of dates stands for whole sessions.
    """
    windows = gaps.select("symbol", F.col("gap_start").alias("start_ts"), F.col("gap_end").alias("end_ts"))
    if sessions is not None:
        length, whole = micros(resolution), resolution == "1d"
        held = grid_ranges(windows, length, sessions)
        first = F.date_trunc("day", "start_ts") if whole else F.col("start_ts")
        last = F.unix_micros(F.date_trunc("day", "end_ts")) + 86_400_000_000 if whole else F.unix_micros("end_ts") + length
        windows = windows.unionByName(held.select("symbol", first.alias("start_ts"), F.timestamp_micros(last - 1).alias("end_ts")))
    return by_day(landed, windows, "left_semi")


def _ordered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ingest_seq", F.unix_micros("ts"))


#: What raw rows are held against before they are rolled up; of rows that repeat a time the first counts.
_AS_LANDED = ("not_increasing", "null_volume", "price_order", "partial_prices")


def on_grid(raw: DataFrame, grid: DataFrame, resolution: str, even: bool = False, keep: Callable[[DataFrame], DataFrame] = materialised) -> tuple[DataFrame, DataFrame]:
    """Raw bars rolled up, snapped and padded on a grid, and the issues, of which those of severity error kept their symbols out.

    Checked are raw rows as they came, the spacing once bars have the target's length, and what is to be stored. Rows
    that repeat a time are no issue, the first counts. A symbol's issues end with the first of these checks that finds an
    error. Two tables of bars are kept, rolled up and padded; all checks are one job over them, whose issues, which are
    few, are the third. even: whether the grid's times are all a bar apart, as they are on a continuous one.
    """
    length = micros(resolution)
    rolled = keep(rollup_if_finer(keep_first(raw), length))
    snapped = snap_daily(_ordered(rolled), grid) if resolution == "1d" else snap(_ordered(rolled), grid, length, length if even else None)
    padded = keep(reindex(snapped, grid.join(rolled.select("symbol").distinct(), "symbol", "left_semi")))
    checks = (issues(raw, 0, "raw", _AS_LANDED), issues(_ordered(rolled), length, "raw", ("bad_spacing",)), issues(_ordered(padded), length, "storage", in_time=True))
    each = keep(reduce(DataFrame.unionByName, [found.withColumn("_check", F.lit(n)) for n, found in enumerate(checks)]))
    ended = each.where("severity = 'error'").groupBy("symbol").agg(F.min("_check").alias("_ended"))
    found = each.join(ended, "symbol", "left").where("_ended is null or _check <= _ended").drop("_check", "_ended")
    return quarantine(padded, each)[0], found


def grid_for(requests: DataFrame, resolution: str, sessions: DataFrame | None = None) -> DataFrame:
    """Continuous if no sessions are given."""
    return continuous_grid(requests, micros(resolution)) if sessions is None else exchange_grid(requests, sessions, micros(resolution))


def sessions_for(requests: DataFrame, asset: str) -> DataFrame | None:
    """Sessions of the asset type's calendar from the requests' first date to the day after their last; None for continuous trading. Two dates come to the driver."""
    ends = requests.agg(F.to_date(F.min("start_ts")).alias("first"), F.date_add(F.to_date(F.max("end_ts")), 1).alias("last")).first()
    return sessions_of(requests.sparkSession, asset, ends["first"], ends["last"]) if ends["first"] else None


def grid_of_asset(requests: DataFrame, asset: str, resolution: str) -> DataFrame:
    """The grid by the asset type's calendar: sessions of its exchange over the requests' dates, or continuous."""
    return grid_for(requests, resolution, sessions_for(requests, asset))


def load(landed: DataFrame, gaps: DataFrame, path: str, asset: str, resolution: str, provider: str, sessions: DataFrame | None = None, note: str | None = None, load_id: str | None = None, better: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fill gaps from landed rows and store the bars; returns this load's provenance rows. Running it again changes no bar.

    What is replaced are the times of each gap's grid, so nothing else that is stored changes, on whatever calendar. A
    symbol with an error is left out, and its gaps stay; load_issues() says why. A symbol that has bars in the store but
    for which nothing landed gets bars without trades, so that its gaps aren't planned for ever; a new one gets none.
    Bars, provenance and issues take effect by one commit. load_id: a name for this load; one that was done already
    changes nothing. better: picks from what is stored there and what is new (update()'s keep_better).
    """
    spark, load_id = landed.sparkSession, load_id or uuid.uuid4().hex
    if is_committed(spark, path, load_id):
        return loads(spark, path).where(F.col("load_id") == load_id)
    windows = gaps.select("symbol", F.col("gap_start").alias("start_ts"), F.col("gap_end").alias("end_ts"))
    with scratch_tables(spark) as keep:
        grid = grid_for(windows, resolution, sessions)
        wanted = keep(wanted_rows(landed, gaps, resolution, sessions))
        made, found = on_grid(wanted, grid, resolution, sessions is None, keep)
        bars = made.select("symbol", "ts", *FIELDS).unionByName(null_grids(grid, wanted, spans(spark, path, asset, resolution, provider)))
        # One row per symbol: what is loaded, and whether it covers its grid.
        held = keep(provenance(bars, f"{asset}-{resolution}-{provider}", provider, note).withColumn("load_id", F.lit(load_id)))
        ends = grid.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        if not held.join(ends, "symbol").where("range_start <> first or range_end <> last").isEmpty():
            raise ValueError("bars don't cover their grid")
        done = grid_ranges(windows.join(held.select("symbol"), "symbol", "left_semi"), micros(resolution), sessions)
        beside = {"issues": found.withColumns({"loaded_at": F.current_timestamp(), "load_id": F.lit(load_id)}), "provenance": held}
        update(bars, done, path, asset, resolution, provider, beside, load_id, better)
    return loads(spark, path).where(F.col("load_id") == load_id)


def loads(spark: SparkSession, path: str) -> DataFrame:
    """Provenance of all loads into the store: a row per symbol and load."""
    return appended(spark, path, "provenance", PROVENANCE)


def load_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of all loads into the store: a row per symbol, category and load."""
    return appended(spark, path, "issues", LOAD_ISSUES)


def traded_first(both: DataFrame) -> DataFrame:
    """Of a stored and a new bar of one time the one that was traded, of two traded ones the new one."""
    traded = F.coalesce(F.col("volume") > 0, F.lit(False)) | F.col("close").isNotNull()
    best = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc(traded), F.desc("fresh")))
    return both.withColumn("_n", best).where("_n = 1").select("symbol", "ts", *FIELDS)


def load_batch(landed: DataFrame, path: str, asset: str, resolution: str, provider: str, sessions: DataFrame | None = None, batch: str | None = None) -> None:
    """Merge what landed into the store: what a stream of landed files hands on, batch by batch, late or out of order.

    A symbol's grid reaches from its first to its last row, and to the bars that are stored, so no hole stays between
    batches. A traded bar takes the place of one without trades, whichever came first, and of an older traded one; bars
    without trades replace none. Rows finer than the resolution are rolled up within their batch. batch: a name under
    which it is loaded once, however often it comes.
    """
    spark = landed.sparkSession
    if batch and is_committed(spark, path, batch):
        return
    with scratch_tables(spark) as keep:
        landed = keep(landed)
        stored = spans(spark, path, asset, resolution, provider)
        span = landed.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).join(stored, "symbol", "left")
        gaps = keep(span.select("symbol", F.least("first", "last_ts").alias("gap_start"), F.greatest("last", "first_ts").alias("gap_end")))
        load(landed, gaps, path, asset, resolution, provider, sessions, load_id=batch, better=traded_first)
