"""Bars from ticks and finer bars, on a grid, side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import month, with_before
from barloom.schema import FIELDS, PRICES, floor_to


def _first_last(value: str, order: list[str]) -> tuple[Column, Column]:
    """First and last value that is there; one order column keeps the aggregate a hash aggregate."""
    key = F.when(F.col(value).isNotNull(), F.col(order[0]) if len(order) == 1 else F.struct(*order))
    return F.min_by(value, key), F.max_by(value, key)


def ticks_to_bars(ticks: DataFrame, length: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Bars of ticks (ts, price, size): one shuffle, combined before it, so a busy symbol makes no large task."""
    first, last = _first_last("price", list(order))
    bars = ticks.groupBy(*keys, floor_to(F.col("ts"), length).alias("bar")).agg(first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("volume"))
    return bars.where("close is not null").withColumnRenamed("bar", "ts").select(*keys, "ts", *FIELDS)


def rollup(bars: DataFrame, length: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Coarser bars in UTC-aligned bins: first open, highest high, lowest low, last close, summed volume; bins without a close fall away."""
    first, last = _first_last("open", list(order))[0], _first_last("close", list(order))[1]
    out = bars.groupBy(*keys, floor_to(F.col("ts"), length).alias("bar")).agg(first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    return out.where("close is not null").withColumnRenamed("bar", "ts").select(*keys, "ts", *FIELDS)


def median_spacing(bars: DataFrame) -> DataFrame:
    """(symbol, spacing) in microseconds; null for a single bar.

    Spacings are found month by month and counted, so that of each symbol only its different ones meet in a task.
    """
    near = with_before(bars.select("symbol", "ts"), "ts", {"was": F.col("ts")}, month())
    gaps = near.groupBy("symbol", (F.unix_micros("ts") - F.unix_micros("was")).alias("gap")).agg(F.count("*").alias("n"))
    return gaps.groupBy("symbol").agg(F.percentile("gap", 0.5, F.col("n")).alias("spacing"))


def rollup_if_finer(bars: DataFrame, length: int) -> DataFrame:
    """Each symbol is rolled up only if the median of its spacings is below the length; other symbols' bars stay as they are. One shuffle for both."""
    finer = median_spacing(bars).select("symbol", F.coalesce(F.col("spacing") < length, F.lit(False)).alias("finer"))
    # Of a left join only the right side, a row a symbol, can be broadcast; of an inner one it may be the bars, which look small as files.
    flagged = bars.where("symbol is not null").join(finer, "symbol", "left").withColumn("finer", F.coalesce("finer", F.lit(False))).withColumns({"bar": F.when(F.col("finer"), floor_to(F.col("ts"), length)).otherwise(F.col("ts")), "row": F.when(~F.col("finer"), F.monotonically_increasing_id())})
    first, last = _first_last("open", ["ts"])[0], _first_last("close", ["ts"])[1]
    volume = F.when(F.col("finer"), F.coalesce(F.sum("volume"), F.lit(0.0))).otherwise(F.sum("volume"))
    out = flagged.groupBy("symbol", "bar", "finer", "row").agg(first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), volume.alias("volume"))
    return out.where("close is not null or not finer").select("symbol", F.col("bar").alias("ts"), *FIELDS)


def _taken(rows: DataFrame) -> DataFrame:
    """The first bar of each target takes it, later ones keep their own time; of equal times the first bar stays."""
    first = F.row_number().over(Window.partitionBy("symbol", "target").orderBy("ts", "ingest_seq"))
    moved = rows.withColumn("_n", first).withColumn("new_ts", F.when(F.col("target").isNotNull() & (F.col("_n") == 1), F.col("target")).otherwise(F.col("ts")))
    single = F.row_number().over(Window.partitionBy("symbol", "new_ts").orderBy("ts", "ingest_seq"))
    return moved.withColumn("_n", single).where("_n = 1").select("symbol", F.col("new_ts").alias("ts"), *FIELDS, "ingest_seq")


def snap_daily(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Daily bars at the last grid time of their UTC date; other dates keep their own time."""
    days = grid.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max("ts").alias("target"))
    # As in snap(): days of a grid look as small as the windows they come from.
    return _taken(bars.withColumn("day", F.to_date("ts")).join(days.hint("merge"), ["symbol", "day"], "left").drop("day"))


def snap(bars: DataFrame, grid: DataFrame, length: int, width: int | None = None) -> DataFrame:
    """Intraday bars at the nearest grid time within half the grid's median spacing (half a bar if the grid has one time); ties go to the later.

    An equi-join on time buckets of that spacing finds the nearest: a bar looks in its own bucket and those beside it, so
    no task needs all bars of a symbol, and the grid, mostly the larger side, is shuffled as it is. width: the spacing,
    where it is known to be the same for all symbols; else it is worked out from the grid.
    """
    if width is None:
        widths = median_spacing(grid).select("symbol", F.coalesce("spacing", F.lit(float(length))).alias("width"))
        # A left join, and a width that is never null, so that the grid can't become the side that is broadcast.
        own = F.coalesce("width", F.lit(float(length)))
        wide_bars, wide_grid = bars.join(widths, "symbol", "left"), grid.join(widths, "symbol", "left").withColumn("width", own)
    else:
        wide_bars, wide_grid = (df.withColumn("width", F.lit(float(width))) for df in (bars, grid))
    bucket = lambda by: F.floor(F.unix_micros("ts") / F.col("width") + by).alias("bucket")
    # A grid is exploded from a few windows, whose size is all the optimiser sees: without the hint it would be broadcast.
    near = wide_grid.select("symbol", F.col("ts").alias("grid_ts"), bucket(0)).hint("merge")
    # A bar whose symbol has no grid looks nowhere and keeps its time.
    looks = F.explode_outer(F.when(F.col("width").isNotNull(), F.array(bucket(-1), bucket(0), bucket(1)))).alias("bucket")
    keyed = wide_bars.select("symbol", "ts", *FIELDS, "ingest_seq", "width", looks)
    distance = F.abs(F.unix_micros("ts") - F.unix_micros("grid_ts"))
    best = keyed.join(near, ["symbol", "bucket"], "left").withColumn("distance", F.when(distance <= F.col("width") / 2, distance))
    # The nearest, and of two the later, as one number: fixed-size states keep the aggregation in place.
    rank = F.when(F.col("distance").isNotNull(), (F.col("grid_ts") >= F.col("ts")).cast("long") - 2 * F.col("distance"))
    chosen = best.groupBy("symbol", "ts", "ingest_seq").agg(*[F.first(f).alias(f) for f in FIELDS], F.max_by("grid_ts", rank).alias("target"))
    return _taken(chosen)


def reindex(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """A bar at each grid time: missing ones have volume 0 and no prices, those off the grid fall away."""
    # Bars may look small as files (few columns that are not null): without the hint they would be broadcast.
    return grid.join(bars.select("symbol", "ts", *FIELDS).hint("merge"), ["symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def boundary_mismatches(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Symbols whose first or last bar isn't the grid's; symbols that lack either side are left out."""
    ends = lambda df, p: df.groupBy("symbol").agg(F.min("ts").alias(f"{p}_start"), F.max("ts").alias(f"{p}_end"))
    return ends(bars, "actual").join(ends(grid, "expected"), "symbol").where("actual_start <> expected_start or actual_end <> expected_end")


def align(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """One row per time of any symbol, columns SYMBOL_field by symbol and field (in bar order for a single symbol); absent stays null.

    The symbols are given, so no pass is spent on finding them; for thousands of symbols stay with long rows.
    """
    fields = list(FIELDS) if len(symbols) == 1 else sorted(FIELDS)
    picked = bars.where(F.col("symbol").isin(symbols))
    cells = [F.first(F.when(F.col("symbol") == s, F.col(f)), ignorenulls=True).alias(f"{s}_{f}") for s in sorted(symbols) for f in fields]
    return picked.groupBy("ts").agg(*cells)


def field_of(wide: DataFrame, field: str) -> DataFrame:
    """One field of an aligned frame, a column per symbol."""
    return wide.select("ts", *[F.col(f"`{c}`").alias(c[: -len(field) - 1]) for c in wide.columns if c.endswith(f"_{field}")])


def to_long(wide: DataFrame, symbols: list[str]) -> DataFrame:
    """An aligned frame as bars; times a symbol has nothing at fall away."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{s}_{f}`").alias(f) for f in FIELDS]) for s in symbols])).alias("b")
    return wide.select("ts", each).select("b.symbol", "ts", *[f"b.{f}" for f in FIELDS]).where(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in FIELDS]))


def stitch(bars: DataFrame, renames: DataFrame) -> DataFrame:
    """Bars of former tickers under the new one, for renames (canonical, alias, valid_from, valid_to), which are few."""
    old = bars.join(F.broadcast(renames), (F.col("symbol") == F.col("alias")) & (F.col("ts") >= F.col("valid_from")) & (F.col("ts") <= F.col("valid_to")))
    moved = old.select(F.col("canonical").alias("symbol"), "ts", *FIELDS, F.lit(1).alias("_own"))
    both = bars.select("symbol", "ts", *FIELDS, F.lit(0).alias("_own")).unionByName(moved)
    # A moved bar replaces what the new ticker has at its time.
    best = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("_own"), *[F.col(p).desc_nulls_last() for p in PRICES]))
    return both.withColumn("_n", best).where("_n = 1").drop("_n", "_own")


def of_tickers(bars: DataFrame, renames: DataFrame) -> DataFrame:
    """Bars, or ticks, of the tickers, old and new, that renames name, which are few: stitch() changes no others, so its report needs no others."""
    named = renames.select(F.explode(F.array("canonical", "alias")).alias("symbol")).distinct()
    return bars.join(F.broadcast(named), "symbol", "left_semi")


def stitch_report(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    """(symbol, bars_before, null_before, bars_after, null_after, fixed) per canonical ticker of renames: bars without trades before and after stitch()."""
    named = renames.select(F.col("canonical").alias("symbol")).distinct()

    def counts(bars: DataFrame, when: str) -> DataFrame:
        mine = bars.join(F.broadcast(named), "symbol", "left_semi")  # as few as renames are
        return mine.groupBy("symbol").agg(F.count("*").alias(f"bars_{when}"), F.count_if(F.coalesce(F.col("volume"), F.lit(0.0)) == 0).alias(f"null_{when}"))

    out = named.join(counts(before, "before"), "symbol", "left").join(counts(after, "after"), "symbol", "left").fillna(0)
    return out.withColumn("fixed", F.col("null_before") - F.col("null_after"))
