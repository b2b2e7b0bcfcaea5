"""What readers of bars compute: averages, signals, returns, filled bars, portfolios, universes, continuous contracts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import BLOCK, filled, month, with_before, with_halo
from barloom.schema import PRICES


def moving_averages(bars: DataFrame, sizes: tuple[int, ...] = (20, 50), block: Column | None = None) -> DataFrame:
    """Mean of the last n closes that are there, null until there are n; a symbol is worked off in blocks (months, if none are given), each with the closes before it.

    A block should hold many more rows than the largest size, which is what is repeated for it: span() for known bar lengths.
    """
    out = with_halo(bars.where("close is not null"), "ts", "close", max(sizes) - 1, month() if block is None else block)
    for n in sizes:
        w = Window.partitionBy("symbol", BLOCK).orderBy("ts").rowsBetween(1 - n, 0)
        out = out.withColumn(f"sma{n}", F.when(F.count("close").over(w) == n, F.avg("close").over(w)))
    return out.where("not _halo").drop("_halo", BLOCK)


def crossover(averaged: DataFrame, fast: str = "sma20", slow: str = "sma50", block: Column | None = None) -> DataFrame:
    """position: 1 where fast is above slow, -1 below, else 0; signal: its change since the bar before."""
    position = F.when(F.col(fast) > F.col(slow), 1).when(F.col(fast) < F.col(slow), -1).otherwise(0)
    out = with_before(averaged.withColumn("position", position), "ts", {"_was": F.col("position")}, month() if block is None else block)
    return out.withColumn("signal", F.coalesce(F.col("position") - F.col("_was"), F.lit(0))).drop("_was")


def returns(bars: DataFrame, block: Column | None = None) -> DataFrame:
    out = with_before(bars.where("close is not null"), "ts", {"_was": F.col("close")}, month() if block is None else block)
    return out.withColumn("ret", F.col("close") / F.col("_was") - 1).drop("_was")


def return_stats(bars: DataFrame, block: Column | None = None) -> DataFrame:
    return returns(bars, block).groupBy("symbol").agg(F.avg("ret").alias("mean_return"), F.stddev_samp("ret").alias("std_return"))


def forward_fill(bars: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars on a grid; where none is, all prices are the last close and the volume is 0. Each month gets the last close before it."""
    on = filled(grid.join(bars, [*keys, "ts"], "left"), "ts", "close", "_last", month(), keys)
    there = F.col("close").isNotNull()
    return on.withColumns({**{p: F.when(there, F.col(p)).otherwise(F.col("_last")) for p in PRICES}, "volume": F.when(there, F.col("volume")).otherwise(0.0)}).drop("_last")


def portfolio_values(bars: DataFrame, holdings: DataFrame) -> DataFrame:
    """(day, value): last close of each day times quantity, over holdings (symbol, quantity)."""
    closes = bars.where("close is not null").groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))
    return closes.join(holdings, "symbol").groupBy("day").agg(F.sum(F.col("close") * F.col("quantity")).alias("value"))


def latest(rows: DataFrame, key: str, by: str = "ts") -> DataFrame:
    """The last record of each key; of equal times the one with the largest record."""
    rest = [c for c in rows.columns if c not in (key, by)]
    best = rows.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("r"))
    return best.select(key, "r.*")


def liquid_universe(volumes: DataFrame, definitions: DataFrame, quotes: DataFrame, top: int = 25) -> DataFrame:
    """The instrument of each product with the most volume, the top products, with median quote size and spread in ticks.

    volumes (instrument, ts, volume); definitions (instrument, ts, product, tick_size); quotes (instrument, bid, ask,
    bid_size, ask_size).
    """
    joined = latest(volumes, "instrument").select("instrument", "volume").join(latest(definitions, "instrument").select("instrument", "product", "tick_size"), "instrument")
    first = F.row_number().over(Window.partitionBy("product").orderBy(F.desc("volume"), "instrument"))
    best = joined.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(F.desc("volume"), "product").limit(top)
    q = quotes.join(F.broadcast(best.select("instrument", "tick_size")), "instrument").groupBy("instrument").agg(F.percentile((F.col("bid_size") + F.col("ask_size")) / 2, 0.5).alias("median_size"), F.percentile((F.col("ask") - F.col("bid")) / F.col("tick_size"), 0.5).alias("median_spread"))
    return best.join(q, "instrument", "left")


def continuous_contracts(contracts: DataFrame, rule: str = "v", ranks: int = 2) -> DataFrame:
    """(symbol, day, contract, close): ROOT.rule.rank for contracts (product, contract, day, expiry, close, volume, open_interest).

    rule c: by expiry; v and n: by the volume or open interest of the contract's day before, the largest first. Prices
    are as traded.
    """
    prior = F.lag({"v": "volume", "n": "open_interest"}.get(rule, "volume")).over(Window.partitionBy("product", "contract").orderBy("day"))
    ranked = contracts.withColumn("_prior", prior)
    order = [F.asc("expiry")] if rule == "c" else [F.desc_nulls_last("_prior"), F.asc("expiry")]
    place = F.row_number().over(Window.partitionBy("product", "day").orderBy(*order, "contract")) - 1
    picked = ranked.where("expiry >= day").withColumn("rank", place).where(F.col("rank") < ranks)
    return picked.select(F.concat_ws(".", "product", F.lit(rule), "rank").alias("symbol"), "day", "contract", "close")


def decayed_spread(quotes: DataFrame, ticks: DataFrame, half_life: str = "5min") -> DataFrame:
    """(symbol, ts, spread, mean): spread in ticks and its mean with weights that halve with time, for irregular times.

    The mean runs over a symbol's quotes in order of ts, then spread, from the first one on; a null spread repeats the
    mean before it. Quotes are dealt out by symbol and bucket of twelve half-lives. One row of sums per bucket goes
    through a symbol in order and brings each bucket what came before it, so the whole history counts.
    """
    half = pd.Timedelta(half_life).value / 1000
    size = max(1, round(12 * half))
    spread = ((F.col("ask") - F.col("bid")) / F.col("tick_size")).cast("double")
    spreads = quotes.join(ticks, "symbol").select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.when(~F.isnan(spread), spread).alias("spread"))
    at = F.unix_micros("ts")
    keyed = spreads.withColumn("bucket", at - F.pmod(at, F.lit(size)))
    # Weights as seen from the end of the bucket: between 1 / 4096 and 1.
    keyed = keyed.withColumn("w", F.when(F.col("spread").isNotNull(), F.pow(F.lit(2.0), (at - F.col("bucket") - size) / half)))
    sums = keyed.where("bucket is not null").groupBy("symbol", "bucket").agg(F.coalesce(F.sum(F.col("spread") * F.col("w")), F.lit(0.0)).alias("num"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("den"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of all buckets before, as seen from the end of this one, and the mean there; rows come by symbol and time."""
        symbol, bucket, num, den, mean = None, 0, 0.0, 0.0, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.symbol != symbol:
                    symbol, bucket, num, den, mean = r.symbol, r.bucket, 0.0, 0.0, None
                fade = 2.0 ** ((bucket - r.bucket) / half)
                bucket, num, den = r.bucket, num * fade, den * fade
                out.append((symbol, bucket, num, den, mean))
                if r.den:
                    num, den = num + r.num, den + r.den
                    mean = num / den
            yield pd.DataFrame(out, columns=["symbol", "bucket", "old_num", "old_den", "old_mean"])

    before = sums.repartition("symbol").sortWithinPartitions("symbol", "bucket").mapInPandas(carry, "symbol string, bucket long, old_num double, old_den double, old_mean double")
    w = Window.partitionBy("symbol", "bucket").orderBy("ts", F.asc_nulls_last("spread")).rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumns({"num": F.sum(F.col("spread") * F.col("w")).over(w), "den": F.sum("w").over(w)}).join(before, ["symbol", "bucket"], "left")
    mean = F.when(F.col("den").isNull(), F.col("old_mean")).otherwise((F.col("num") + F.col("old_num")) / (F.col("den") + F.col("old_den")))
    return running.select("symbol", "ts", "spread", mean.alias("mean"))


def enrich(instruments: DataFrame, master: DataFrame, key: str = "symbol") -> DataFrame:
    return instruments.join(master, key)
