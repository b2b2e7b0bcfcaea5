"""Vendor rows to canonical bars: projections only, apart from keeping the first of repeated timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import FIELDS, nan_to_null


def utc(ts: Column, zone: str | Column | None = None) -> Column:
    """A zone-less time of a zone (UTC if none is given) as a UTC timestamp."""
    return F.to_utc_timestamp(ts.cast("timestamp"), zone) if zone is not None else ts.cast("timestamp")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_klines(rows: DataFrame, klines: str = "k") -> DataFrame:
    """Arrays of strings (opening time in ms, open, high, low, close, volume, …) to bars; a bad number is an error."""
    k = F.col(klines)
    named = {f: k[i + 1].cast("double") for i, f in enumerate(FIELDS)}
    return nan_to_null(rows.withColumns({"ts": F.timestamp_millis(k[0].cast("long")), **named}).drop(klines))


AGGREGATES = "struct<results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>,next_url:string>"


def from_aggregates(rows: DataFrame, json: str = "json") -> DataFrame:
    """JSON pages with results of t (ms), o, h, l, c and v to bars; other keys fall away, a page that is no JSON is an error."""
    pages = rows.withColumn("page", F.from_json(json, AGGREGATES, {"mode": "FAILFAST"}))
    flat = pages.select(*[c for c in rows.columns if c != json], F.posexplode("page.results").alias("ingest_seq", "r"))
    fields = {f: F.col(f"r.{k}") for f, k in zip(FIELDS, "ohlcv")}
    return nan_to_null(flat.withColumns({"ts": F.timestamp_millis("r.t"), **fields}).drop("r"))


def from_capitalised(rows: DataFrame, time: str = "Date", zone: str | Column | None = None) -> DataFrame:
    """Columns Open … Volume to bars; adjusted closes, dividends and splits fall away."""
    keep = [c for c in ("symbol", "ingest_seq") if c in rows.columns]
    return nan_to_null(rows.select(*keep, utc(F.col(time), zone).alias("ts"), *[F.col(f.capitalize()).cast("double").alias(f) for f in FIELDS]))


def from_lowercase(rows: DataFrame) -> DataFrame:
    """Columns that are canonical already; the time is ts_event, else ts_recv."""
    times = [F.col(c) for c in ("ts_event", "ts_recv", "ts") if c in rows.columns]
    if not times:
        raise ValueError("there is no time column")
    keep = [c for c in ("symbol", "ingest_seq") if c in rows.columns]
    return nan_to_null(rows.select(*keep, utc(F.coalesce(*times)).alias("ts"), *[F.col(f).cast("double").alias(f) for f in FIELDS]))


def to_canonical(rows: DataFrame, time: str = "ts") -> DataFrame:
    """A stored library's rows, raw or canonical already; other columns are an error."""
    if set(FIELDS) <= set(rows.columns):
        return from_lowercase(rows)
    if {f.capitalize() for f in FIELDS} <= set(rows.columns):
        return from_capitalised(rows, time)
    raise ValueError(f"columns of no known kind: {rows.columns}")


def keep_first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys (symbol and ts) the one that arrived first."""
    keys = keys or ("symbol", "ts")
    order = Window.partitionBy(*keys).orderBy("ingest_seq")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def crypto_symbol(symbol: Column) -> Column:
    """BTC-USD and its like as BTCUSDT."""
    plain = F.upper(F.replace(symbol, F.lit("-"), F.lit("")))
    return F.when(plain.rlike("USD$"), F.concat(plain, F.lit("T"))).otherwise(plain)


def venue_symbol(symbol: Column, dataset: Column | str, spaced: tuple[str, ...] = ("ARCX.PILLAR",)) -> Column:
    """Venues in `spaced` write a space where others write a dot."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    return F.when(dataset.isin(*spaced), F.translate(symbol, ".", " ")).otherwise(symbol)


def valid_symbol(symbol: Column) -> Column:
    """Whether it has a letter or digit."""
    return F.coalesce(symbol.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def parse_symbols(lines: DataFrame, text: str = "value", order: str = "line") -> DataFrame:
    """(symbol, place) of the symbols in lines: after # comes a comment, commas and lines divide, the first of equal ones counts."""
    bare = F.split(F.regexp_replace(text, "#.*", ""), ",")
    each = lines.select(F.col(order).alias("line"), F.posexplode(bare).alias("at", "raw")).select("line", "at", F.upper(F.trim("raw")).alias("symbol")).where("symbol <> ''")
    return each.groupBy("symbol").agg(F.min(F.struct("line", "at")).alias("place"))


def check_request(plan: DataFrame) -> DataFrame:
    """Requests (symbol, start_ts, end_ts) with what is wrong with them; null if nothing is."""
    return plan.withColumn("problem", F.when(~valid_symbol(F.col("symbol")), "invalid symbol").when(~F.coalesce(F.col("start_ts") < F.col("end_ts"), F.lit(False)), "start is not before end"))
