"""Streams: landed vendor files into the store, and live bars of ticks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.jobs.load import load_batch
from barloom.operators.bars import _first_last
from barloom.sources.landing import OPTIONS


def live_bars(ticks: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, price, size), out once their window is over; later ticks are left to the batch load."""
    first, last = _first_last("price", ["ts"])
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", window).alias("w")).agg(first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def ingest(spark: SparkSession, landing: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], files_at_once: int = 1000, kind: str = "parquet") -> StreamingQuery:
    """All files that have landed since the last run (parquet, json or csv), handed with their number batch by batch to `each`.

    A batch that was broken off comes again under its number, so `each` must do nothing for a number it has done.
    """
    if kind not in OPTIONS:
        raise ValueError(f"unknown kind of file {kind!r}")
    stream = spark.readStream.schema(schema).options(**OPTIONS[kind]).option("maxFilesPerTrigger", files_at_once).format(kind).load(landing)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_bars(spark: SparkSession, landing: str, schema: str, checkpoint: str, path: str, asset: str, resolution: str, provider: str, sessions: DataFrame | None = None, files_at_once: int = 1000, kind: str = "parquet") -> StreamingQuery:
    """Landed files of raw bars (symbol, ts, the fields and ingest_seq) merged into the store, checked and put on their grid batch by batch.

    The commit of a batch carries its number and its stream's checkpoint, so each is stored once. Late files, files that
    overlap and files out of order end in the same bars as one file would, each time with the bar that came last.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()
    return ingest(spark, landing, schema, checkpoint, lambda df, n: load_batch(df, path, asset, resolution, provider, sessions, f"batch-{stream}-{n}"), files_at_once, kind)
