"""Registered queries of the store's sizes and compaction, of updates, loads, plans, fetches and merging streams."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendars
from barloom.operators import analytics, bars, gaps, profile
from barloom.registry import _REQ, AUDIT, D1, DAY, GRID, H1, HOUR, XNYS, _stored, daily, dirty, found_issues, hourly, ntz, query, sessions
from barloom.schema import BARS, FIELDS
from barloom.sources import store

_NO_LIFE = "symbol string, ipo_date timestamp, delist_date timestamp"


def _at(t: str):
    return F.lit(t).cast("timestamp")


# --- sizes and compaction -------------------------------------------------------------------------------------------


@query(f"WITH {H1} SELECT symbol, count(DISTINCT date_trunc('month', ts)) AS folders, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, true AS adds_up FROM h GROUP BY symbol")
def s7_sizes(spark, d):
    path = _stored(spark, d)
    sizes = store.symbol_sizes(store.files(spark, path))
    # Shares are rounded down once per symbol and file; what a listing of the files finds is the whole. Two single rows.
    whole = store.library_size(store.listing(spark, path)).select(F.col("size_bytes").alias("all_bytes"))
    sums = sizes.agg(F.sum("size_bytes").alias("sum_bytes"), F.sum("segments").alias("n")).crossJoin(F.broadcast(whole))
    check = sums.select((F.col("all_bytes") - F.col("sum_bytes")).between(0, F.col("n")).alias("adds_up"))
    return ntz(sizes.join(store.spans(spark, path).drop("rows"), "symbol").crossJoin(F.broadcast(check)).select("symbol", "folders", "rows", "first_ts", "last_ts", "adds_up"))


#: Files are cut at 50 rows, so each of a symbol's folders has a file for every 50 of its rows at least.
@query(f"WITH {H1}, m AS (SELECT symbol, date_trunc('month', ts) AS month, count(*) AS n FROM h GROUP BY ALL) SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(ceil(n / 1000)) AS BIGINT) AS needed, sum(ceil(n / 50)) > sum(ceil(n / 1000)) AS fragmented, true AS enough FROM m GROUP BY symbol")
def m1_fragmentation(spark, d):
    found = store.symbol_fragmentation(store.files(spark, _stored(spark, d, 50)), 1000)
    return found.select("symbol", "rows", "needed", "fragmented", (F.col("segments") >= F.ceil(F.col("rows") / 50)).alias("enough"))


@query(f"""WITH {H1}
    SELECT 'missing' AS status, (SELECT count(*) FROM customer) AS n, true AS fewer
    UNION ALL SELECT 'defragmented', count(*), true FROM (SELECT symbol, date_trunc('month', ts) FROM h GROUP BY ALL HAVING count(*) > 20) HAVING count(*) > 0
    UNION ALL SELECT 'ok', count(*), true FROM (SELECT symbol, date_trunc('month', ts) FROM h GROUP BY ALL HAVING count(*) <= 20) HAVING count(*) > 0""")
def m2_compact_statuses(spark, d):
    path = store.scratch(spark, "bars")
    # A provider of its own for each symbol, so that no file holds two.
    store.write_rows(store.with_partitions(hourly(spark, d), "crypto", "1h", "events").withColumn("provider", F.col("symbol")), path, 20)
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("U"), "c_custkey").alias("symbol"))
    done = store.status_counts(store.compact(spark, path, symbols=wanted))
    return done.select("status", "n", F.coalesce((F.col("segments_after") < F.col("segments_before")) | (F.col("status") == "ok"), F.lit(True)).alias("fewer"))


@query(f"""WITH {H1}, m AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(close) AS closes FROM h GROUP BY ALL)
    SELECT symbol, month, CASE WHEN n <= 30 THEN 'ok' WHEN symbol = 'click' THEN 'failed' ELSE 'defragmented' END AS status, n AS rows, round(closes, 6) AS closes FROM m WHERE symbol <> 'view'
    UNION ALL SELECT 'NONE', NULL, 'missing', 0, NULL""")
def m2_compact_symbols(spark, d):
    """Only wanted symbols are rewritten; what a copy doesn't bring through whole stays as it was."""
    path = _stored(spark, d, 30)
    wanted = store.list_symbols(store.files(spark, path)).where("symbol <> 'view'").unionByName(spark.createDataFrame([("NONE",)], "symbol string"))
    report = store.compact(spark, path, 1_000_000, symbols=wanted, only=True, copy=lambda rows: rows.where("symbol <> 'click' or hour(ts) <> 5"))
    after = store.load(spark, path).groupBy("symbol", "month").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 6).alias("closes"))
    return report.join(after, ["symbol", "month"], "left").select("symbol", "month", "status", F.coalesce("rows", F.lit(0)).alias("rows"), "closes")


# --- updates --------------------------------------------------------------------------------------------------------


@query(f"WITH {H1} SELECT * FROM h")
def s3_recovered_update(spark, d):
    """An update that was broken off before its commit has changed nothing; recover() takes away what it left."""
    path, h = _stored(spark, d), hourly(spark, d)
    store._write_version(store.with_partitions(h.withColumn("close", F.col("close") + 1), "crypto", "1h", "events"), path, "broken")
    if store.recover(spark, path) != 1 or store.recover(spark, path) != 0:
        raise ValueError("one write was broken off")
    return ntz(store.read(spark, path))


@query(f"WITH {H1} SELECT symbol, ts, open, high, low, CASE WHEN symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-08' THEN close + 1 ELSE close END AS close, volume FROM h")
def s3_update_beyond_ranges(spark, d):
    """New rows outside of the ranges, in their months and in others, change nothing; a range may reach into months without rows."""
    path, h = _stored(spark, d), hourly(spark, d)
    new = h.where("symbol = 'click'").withColumn("close", F.col("close") + 1)
    far = new.where("hour(ts) = 0").select("symbol", F.explode(F.array(*[F.add_months("ts", n).cast("timestamp") for n in (-1, 1, 12)])).alias("ts"), *FIELDS)
    ranges = spark.createDataFrame([("click", datetime(2024, 1, 4), datetime(2024, 1, 8)), ("click", datetime(2024, 5, 1), datetime(2024, 6, 1))], "symbol string, start_ts timestamp, end_ts timestamp")
    store.update(new.unionByName(far), ranges, path, "crypto", "1h", "events")
    return ntz(store.read(spark, path))


# --- streams --------------------------------------------------------------------------------------------------------


@query(f"WITH {H1}, {GRID} SELECT symbol, ts, CASE WHEN hour(ts) % 3 = 2 THEN close + 1 ELSE close END AS close, coalesce(volume, 0) AS volume FROM g LEFT JOIN h USING (symbol, ts)")
def st1_late_files(spark, d):
    """Three files: the month's second half, then every third hour of all of it with other closes, then the rest, out of order and overlapping."""
    from barloom.streaming.live import ingest_bars

    path, landing, state = (store.scratch(spark, n) for n in ("bars", "landing", "state"))
    h = store.materialised(hourly(spark, d).withColumn("ingest_seq", F.unix_micros("ts")))
    third = h.where("hour(ts) % 3 = 2").withColumns({f: F.col(f) + 1 for f in ("open", "high", "low", "close")})
    for part in (h.where("ts >= '2024-01-16'"), third, h.where("hour(ts) % 3 < 2 and ts < '2024-01-20'")):
        part.coalesce(1).write.mode("append").json(landing)
        ingest_bars(spark, landing, BARS + ", ingest_seq bigint", state, path, "crypto", "1h", "events", kind="json").awaitTermination()
    return ntz(store.read(spark, path, columns=["symbol", "ts", "close", "volume"]))


# --- loads ----------------------------------------------------------------------------------------------------------

#: Hours of CME sessions in standard time, evenings before included.
_CME = """cme AS (SELECT s::DATE AS session_date, s - INTERVAL 1 HOUR AS open_ts, s + CASE WHEN month(s) IN (1, 2) AND isodow(s) = 1 AND day(s) BETWEEN 15 AND 21 THEN INTERVAL 18 HOUR ELSE INTERVAL 22 HOUR END AS close_ts
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-25', INTERVAL 1 DAY)) AS s) WHERE isodow(s) < 6),
    cg AS (SELECT symbol, unnest(generate_series(open_ts, close_ts, INTERVAL 1 HOUR)) AS ts FROM cme, (SELECT DISTINCT symbol FROM h))"""


@query(f"WITH {H1}, {_CME} SELECT symbol, ts, close, coalesce(volume, 0) AS volume FROM cg LEFT JOIN h USING (symbol, ts)")
def job_load_futures(spark, d):
    """Two loads of dates that follow each other, the later one's first session opening on the evening before; the second comes twice."""
    from barloom.jobs.load import load

    path, h = store.scratch(spark, "bars"), store.materialised(hourly(spark, d).withColumn("ingest_seq", F.unix_micros("ts")))
    hours = calendars.cme_sessions(spark, date(2024, 1, 1), date(2024, 2, 2))
    for first, last in (("2024-01-03", "2024-01-19"), ("2024-01-20", "2024-01-25"), ("2024-01-20", "2024-01-25")):
        load(h, h.select("symbol").distinct().withColumns({"gap_start": _at(first), "gap_end": _at(last)}), path, "futures", "1h", "events", hours)
    return ntz(store.read(spark, path, columns=["symbol", "ts", "close", "volume"]))


def _half_past(h: DataFrame) -> DataFrame:
    """Bars of the exchange's hours, which begin at half past."""
    return h.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 1_800_000_000))


@query(f"""WITH {H1}, {XNYS}, one AS (SELECT symbol, unnest(generate_series(open_ts, close_ts, INTERVAL 1 HOUR)) AS grid_ts FROM sessions, (SELECT DISTINCT symbol FROM h) WHERE session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12')
    SELECT symbol, grid_ts AS ts, close, coalesce(volume, 0) AS volume, 1 AS copies FROM one LEFT JOIN (SELECT symbol, ts + INTERVAL 30 MINUTE AS grid_ts, close, volume FROM h) USING (symbol, grid_ts)""")
def job_load_equity_twice(spark, d):
    """Dates stand for whole sessions, the last one too; the second run changes no bar."""
    from barloom.jobs.load import load

    path, h = store.scratch(spark, "bars"), store.materialised(_half_past(hourly(spark, d).withColumn("ingest_seq", F.unix_micros("ts"))))
    todo = h.select("symbol").distinct().withColumns({"gap_start": _at("2024-01-08"), "gap_end": _at("2024-01-12")})
    for _ in range(2):
        load(h, todo, path, "equity", "1h", "events", calendars.nyse_sessions(spark, date(2024, 1, 1), date(2024, 1, 31)))
    return ntz(store.read(spark, path).groupBy("symbol", "ts").agg(F.max("close").alias("close"), F.max("volume").alias("volume"), F.count("*").cast("int").alias("copies")))


def _got(spark: SparkSession, d: str, asset: str, path: str) -> DataFrame:
    from barloom.jobs.get_data import get_data

    h = hourly(spark, d).withColumn("ingest_seq", F.unix_micros("ts"))
    h = _half_past(h) if asset == "equity" else h
    ask = h.select("symbol").distinct().withColumns({"start_ts": _at("2024-01-05"), "end_ts": _at("2024-01-10")})
    return get_data(ask, path, asset, "1h", "events", lambda gaps: h, spark.createDataFrame([], _NO_LIFE), bars.rollup(h, DAY), ask.select("symbol", F.lit(1.0).alias("rate")), 100.0)[1]


@query(f"""WITH {H1}, days AS (SELECT s FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10', INTERVAL 1 DAY)) AS s) WHERE isodow(s) < 6),
    grids AS (SELECT 'equity' AS asset, unnest(generate_series(s + INTERVAL 870 MINUTE, s + INTERVAL 1260 MINUTE, INTERVAL 1 HOUR)) AS ts FROM days
      UNION ALL SELECT 'futures', unnest(generate_series(s - INTERVAL 1 HOUR, s + INTERVAL 22 HOUR, INTERVAL 1 HOUR)) FROM days
      UNION ALL SELECT 'crypto', unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10', INTERVAL 1 HOUR))),
    n AS (SELECT asset, symbol, ts, ts - CASE asset WHEN 'equity' THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS was FROM grids, (SELECT DISTINCT symbol FROM h))
    SELECT asset, n.symbol, count(*) AS bars, count(h.ts) AS traded, round(sum(close), 4) AS closes, 0 AS planned_again FROM n LEFT JOIN h ON n.symbol = h.symbol AND n.was = h.ts GROUP BY ALL""")
def job_get_data(spark, d):
    """Request to bars for each kind of asset, twice; the second time nothing is left to plan."""
    out = None
    for asset in ("equity", "crypto", "futures"):
        path = store.scratch(spark, "bars")
        _got(spark, d, asset, path)
        again = _got(spark, d, asset, path).count()
        each = store.read(spark, path).groupBy("symbol").agg(F.count("*").alias("bars"), F.count("close").alias("traded"), F.round(F.sum("close"), 4).alias("closes"))
        each = each.withColumns({"asset": F.lit(asset), "planned_again": F.lit(again)})
        out = each if out is None else out.unionByName(each)
    return out


# --- plans, lifecycles, fetches -------------------------------------------------------------------------------------


@query(f"""WITH {H1}, {XNYS}, {_REQ}, ch AS (SELECT symbol, session_date::TIMESTAMP AS s, session_date::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS e FROM req JOIN sessions ON session_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'),
    isl AS (SELECT *, sum(CASE WHEN s > p + INTERVAL 1 MICROSECOND OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY s) AS island FROM (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY s) AS p FROM ch WHERE day(s) % 4 <> 0))
    SELECT symbol, min(s) AS gap_start, max(e) AS gap_end, 0 AS after_load FROM isl GROUP BY symbol, island""")
def g6_session_plan(spark, d):
    """Sessions without a bar, planned, loaded, and planned again: nothing is left."""
    from barloom.jobs.load import load

    path, h = store.scratch(spark, "bars"), hourly(spark, d)
    hours, life = sessions(spark, d), spark.createDataFrame([], _NO_LIFE)
    ask = h.select("symbol").distinct().withColumns({"start_ts": _at("2024-01-03"), "end_ts": _at("2024-01-12")})
    there = calendars.exchange_grid(ask, hours, HOUR).where("day(ts) % 4 = 0")
    store.write(there.withColumns({f: F.lit(1.0) for f in FIELDS}), path, "equity", "1h", "events")
    todo = store.materialised(gaps.plan(store.read(spark, path), ask, life, hours))
    load(h.withColumn("ingest_seq", F.unix_micros("ts")), todo, path, "equity", "1h", "events", hours)
    left = gaps.plan(store.read(spark, path), ask, life, hours).agg(F.count("*").cast("int").alias("after_load"))
    return ntz(todo.crossJoin(F.broadcast(left)))  # one row


@query(f"""WITH {D1}, f AS (SELECT symbol, min(ts) AS first_bar FROM d GROUP BY symbol)
    SELECT symbol, CASE WHEN symbol LIKE '%2' THEN TIMESTAMP '2020-01-01' ELSE first_bar END AS ipo_date, CASE WHEN symbol LIKE '%2' THEN TIMESTAMP '2024-01-01' END AS delist_date, 0 AS learnt_again FROM f
    UNION ALL SELECT 'UNKNOWN', NULL, NULL, 0""")
def g7_stored(spark, d):
    """Lifecycles learnt from the vendor's table or the first bar are stored; the next run learns nothing new."""
    from barloom.jobs.get_data import learn_lifecycles, lifecycles

    path, b = store.scratch(spark, "bars"), daily(spark, d)
    names = b.select("symbol").distinct().unionByName(spark.createDataFrame([("UNKNOWN",)], "symbol string"))
    vendor = names.where("symbol like '%2'").withColumns({"ipo_date": _at("2020-01-01"), "delist_date": _at("2024-01-01")})
    learn_lifecycles(names, path, vendor, b)
    again = learn_lifecycles(names, path, vendor.limit(0), b.limit(0))
    return ntz(lifecycles(spark, path).drop("discovered_at").withColumn("learnt_again", F.lit(again.count())))


@query("""WITH c AS (SELECT 'U' || c_custkey AS symbol, c_custkey AS k FROM customer)
    SELECT symbol, CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'fetched' END AS status, CASE WHEN k % 7 = 0 THEN 0 ELSE 2 END AS rows, CASE WHEN k % 7 = 0 THEN 1 WHEN k % 5 = 0 THEN 2 ELSE 1 END AS tries, CASE WHEN k % 7 = 0 THEN 'KeyError: unknown' END AS error, CASE WHEN k % 7 = 0 THEN 0 ELSE 2 END AS stored FROM c""")
def s11_fetch(spark, d):
    """A provider that fails for good for some symbols, and once for others; a second call asks only for what failed."""
    path = store.scratch(spark, "ledger")
    c = spark.read.parquet(f"{d}/customer.parquet")
    todo = c.select(F.concat(F.lit("U"), "c_custkey").alias("symbol"), _at("2024-01-01").alias("gap_start"), _at("2024-01-02").alias("gap_end"))
    seen: set[str] = set()

    def provider(symbol, start, end):
        import pandas as pd

        k = int(symbol[1:])
        if k % 7 == 0:
            raise KeyError("unknown")
        if k % 5 == 0 and symbol not in seen:
            seen.add(symbol)
            raise TimeoutError
        return pd.DataFrame({"symbol": symbol, "ts": [start, end], "close": [float(k), k + 0.5]})

    schema = "symbol string, ts timestamp, close double"
    for _ in range(2):
        ledger = gaps.fetch_gaps(todo, provider, schema, path, first_wait=0.0)
    rows = gaps.fetched_rows(spark, path, schema).groupBy("symbol").agg(F.count("*").alias("stored"))
    return ledger.join(rows, "symbol", "left").select("symbol", "status", F.col("rows").cast("int").alias("rows"), "tries", F.regexp_replace("error", "'", "").alias("error"), F.coalesce("stored", F.lit(0)).cast("int").alias("stored"))


# --- rules and orders -----------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_type AS product, user_id % 6 AS contract, ts::DATE AS day, DATE '2024-01-10' + CAST(user_id % 6 * 5 AS INTEGER) AS expiry, arg_max(value, ts) AS close, count(DISTINCT user_id) AS oi FROM events GROUP BY 1, 2, 3, 4),
    p AS (SELECT *, lag(oi) OVER (PARTITION BY product, contract ORDER BY day) AS prior FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY product, day ORDER BY expiry, contract) - 1 AS rc, row_number() OVER (PARTITION BY product, day ORDER BY prior DESC NULLS LAST, expiry, contract) - 1 AS rn FROM p WHERE expiry >= day)
    SELECT product || '.c.' || rc AS symbol, CAST(day AS VARCHAR) AS day, contract, close FROM r WHERE rc < 2 UNION ALL SELECT product || '.n.' || rn, CAST(day AS VARCHAR), contract, close FROM r WHERE rn < 2""")
def w8_calendar_and_interest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("product"), (F.col("user_id") % 6).alias("contract"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), "value", "user_id")
    c = e.groupBy("product", "contract", "day").agg(F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"), F.count_distinct("user_id").alias("open_interest")).withColumn("expiry", F.date_add(F.lit("2024-01-10").cast("date"), (F.col("contract") * 5).cast("int")))
    return analytics.continuous_contracts(c, "c").unionByName(analytics.continuous_contracts(c, "n")).withColumn("day", F.col("day").cast("string"))


@query(f"{AUDIT}, n AS (SELECT symbol, count(*) AS issue_count FROM found GROUP BY symbol), z AS (SELECT symbol, count(*) FILTER (volume = 0) AS null_bars FROM r GROUP BY symbol) SELECT symbol, coalesce(issue_count, 0) AS issue_count, null_bars FROM z LEFT JOIN n USING (symbol) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 30")
def p8_worst_symbols(spark, d):
    """The report's default order: symbols with most issues, then with most bars without trades."""
    profiles = profile.profile(dirty(spark, d), found=found_issues(spark, d))
    return profile.ranking(profiles, top=30).select("symbol", "issue_count", "null_bars")
