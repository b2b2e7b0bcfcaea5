"""Bring a raw library of many symbols to canonical bars on their grids, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.normalize import keep_first, to_canonical
from barloom.jobs.load import grid_for, on_grid


def normalise_library(raw: DataFrame, resolution: str, sessions: DataFrame | None = None, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(bars, report): each symbol on the grid from its first to its last bar; report: symbol, rows_in, rows_out, status.

    A symbol that fails a check is left out with status error; the others go on.
    """
    rows = to_canonical(raw, time)
    if "ingest_seq" not in rows.columns:
        rows = rows.withColumn("ingest_seq", F.unix_micros("ts"))
    windows = rows.groupBy("symbol").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    bars, found = on_grid(keep_first(rows), grid_for(windows, resolution, sessions), resolution, sessions is None)
    n_in, n_out = rows.groupBy("symbol").agg(F.count("*").alias("rows_in")), bars.groupBy("symbol").agg(F.count("*").alias("rows_out"))
    bad = found.where("severity = 'error'").select("symbol").distinct().withColumn("bad", F.lit(True))
    status = F.when(F.col("bad"), "error").when(F.col("rows_out").isNull(), "skipped").otherwise("ok")
    report = n_in.join(n_out, "symbol", "left").join(bad, "symbol", "left").select("symbol", "rows_in", F.coalesce("rows_out", F.lit(0).cast("long")).alias("rows_out"), status.alias("status"))
    return bars, report
