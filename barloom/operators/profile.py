"""Profiles of stored symbols, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(bars: DataFrame, symbols: DataFrame | None = None, sizes: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Per symbol first and last bar, bars, bars without and with trades, volume, stored bytes and issues.

    Only symbol, ts and volume are read. With `symbols`, those without bars appear with nulls and zeros.
    """
    out = bars.groupBy("symbol").agg(F.min("ts").alias("first_bar"), F.max("ts").alias("last_bar"), F.count("*").alias("total_bars"), F.count_if(F.col("volume") == 0).alias("null_bars"), F.sum("volume").alias("total_volume"))
    if symbols is not None:
        out = symbols.select("symbol").distinct().join(out, "symbol", "left")
    out = out.fillna(0, ["total_bars", "null_bars", "total_volume"]).withColumn("data_bars", F.col("total_bars") - F.col("null_bars"))
    out = out.join(sizes.select("symbol", "size_bytes"), "symbol", "left") if sizes is not None else out.withColumn("size_bytes", F.lit(None).cast("long"))
    n = found.groupBy("symbol").agg(F.count("*").alias("issue_count")) if found is not None else None
    out = out.join(n, "symbol", "left") if n is not None else out.withColumn("issue_count", F.lit(0).cast("long"))
    return out.fillna(0, ["size_bytes", "issue_count"])


def overview(profiles: DataFrame) -> DataFrame:
    """One row: symbols, bars, range, bytes, symbols with issues."""
    return profiles.agg(F.count("*").alias("symbols"), F.coalesce(F.sum("total_bars"), F.lit(0)).alias("total_bars"), F.min("first_bar").alias("first_bar"), F.max("last_bar").alias("last_bar"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.count_if(F.col("issue_count") > 0).alias("symbols_with_issues"))


def health(null_bars: Column, total_bars: Column) -> Column:
    """Class of a symbol by its share of bars without trades; bounds are not included."""
    share = null_bars / total_bars
    return F.when(total_bars == 0, "empty").when(null_bars == 0, "clean").when(share < 0.01, "good").when(share < 0.05, "warning").otherwise("critical")


def with_health(profiles: DataFrame) -> DataFrame:
    share = F.when(F.col("total_bars") > 0, F.col("null_bars") / F.col("total_bars"))
    return profiles.withColumns({"null_share": share, "health": health(F.col("null_bars"), F.col("total_bars"))})


def health_counts(profiles: DataFrame) -> DataFrame:
    """One row of counts by class; upper bounds are included here, and symbols without bars count in none."""
    share = F.when(F.col("total_bars") > 0, F.col("null_bars") / F.col("total_bars"))
    return profiles.agg(F.count_if(share == 0).alias("clean"), F.count_if((share > 0) & (share <= 0.01)).alias("good"), F.count_if((share > 0.01) & (share <= 0.05)).alias("warning"), F.count_if(share > 0.05).alias("critical"))


def issue_totals(found: DataFrame) -> DataFrame:
    """(category, issues, n_bars, symbols), most frequent first; affected_symbols() says which symbols they are."""
    return found.groupBy("category").agg(F.count("*").alias("issues"), F.sum("n_bars").alias("n_bars"), F.count_distinct("symbol").alias("symbols")).orderBy(F.desc("issues"), "category")


def affected_symbols(found: DataFrame) -> DataFrame:
    """(category, symbol, n_bars): a row per symbol and category, not a list in one row, since thousands of symbols may share a category."""
    return found.groupBy("category", "symbol").agg(F.sum("n_bars").alias("n_bars"))


def ranking(profiles: DataFrame, by: str | None = None, top: int | None = None) -> DataFrame:
    """By issues, then bars without trades; or by a column; largest first, ties by symbol."""
    keys = ["issue_count", "null_bars"] if by is None else [by]
    out = profiles.orderBy(*[F.desc_nulls_last(k) for k in keys], "symbol")
    return out.limit(top) if top is not None else out


def load_counters(landed: DataFrame, keys: tuple[str, ...] = ("provider", "symbol"), bytes_col: str | None = None) -> DataFrame:
    """Rows, fetches and bytes of landed vendor rows by key."""
    size = F.sum(bytes_col) if bytes_col else F.lit(None).cast("long")
    return landed.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("fetch_id").alias("fetches"), size.alias("bytes"))
