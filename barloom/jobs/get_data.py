"""From a request to bars: check, lifecycle, plan by calendar, cost, fetch, load and read, in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.normalize import check_request
from barloom.jobs.load import load, sessions_for
from barloom.operators.gaps import bootstrap_lifecycle, check_cost, clamp, plan
from barloom.schema import LIFECYCLE, by_day
from barloom.sources.store import append, appended, materialised, read


def lifecycles(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ipo_date, delist_date, discovered_at) as stored beside the bars: of each symbol the row that was found last."""
    rows = appended(spark, path, "lifecycle", LIFECYCLE)
    latest = rows.groupBy("symbol").agg(F.max_by(F.struct("ipo_date", "delist_date", "discovered_at"), "discovered_at").alias("r"))
    return latest.select("symbol", "r.*")


def learn_lifecycles(symbols: DataFrame, path: str, reference: DataFrame, daily: DataFrame) -> DataFrame:
    """Store lifecycles of the symbols that have none yet, from the vendor's table, else from their first daily bar; returns the new rows.

    A stored row counts even if its dates are null, and a symbol of which nothing is known gets such a row, so nobody is
    looked up twice.
    """
    spark = symbols.sparkSession
    cached = lifecycles(spark, path)
    made = bootstrap_lifecycle(symbols.join(cached, "symbol", "left_anti"), cached, reference, daily)
    new = made.select("symbol", "ipo_date", "delist_date", F.current_timestamp().alias("discovered_at"))
    append(new, path, "lifecycle")
    return made


def get_data(requests: DataFrame, path: str, asset: str, resolution: str, provider: str, source: Callable[[DataFrame], DataFrame], reference: DataFrame, daily: DataFrame, rates: DataFrame | None = None, ceiling: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, plan): the stored bars of requests (symbol, start_ts, end_ts) after what was missing has been loaded, and what that was.

    Requests that check_request() finds fault with end the job. Lifecycles are learnt once and stored; requests are cut
    to them. Missing are hours of continuous assets and sessions of the others. A plan that costs more than the ceiling
    is an error and loads nothing. source gives landed rows (with ingest_seq) for gaps (symbol, gap_start, gap_end): a
    table of landed files, or fetched rows. A second run over the same requests plans nothing and asks source nothing.
    """
    spark = requests.sparkSession
    bad = check_request(requests).where("problem is not null").select("symbol", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['symbol']}: {r['problem']}" for r in bad))
    learn_lifecycles(requests.select("symbol").distinct(), path, reference, daily)
    known, sessions = lifecycles(spark, path), sessions_for(requests, asset)
    have = read(spark, path, columns=["symbol", "ts"], asset=asset, resolution=resolution, provider=provider)
    todo = materialised(plan(have, requests, known, sessions))
    if not todo.isEmpty():
        if ceiling is not None:
            check_cost(todo, rates, ceiling)
        load(source(todo), todo, path, asset, resolution, provider, sessions, note="get_data")
    wanted = clamp(requests, known)
    return by_day(read(spark, path, asset=asset, resolution=resolution, provider=provider), wanted, "left_semi"), todo
