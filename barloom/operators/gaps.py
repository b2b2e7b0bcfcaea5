"""What bars are missing: coverage of chunks, gaps, clamped requests, plans and lifecycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from barloom.functions.calendars import hourly_chunks, session_chunks, session_spans
from barloom.functions.normalize import valid_symbol
from barloom.operators.blocks import islands, month
from barloom.schema import by_day


def clamp(requests: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Requests cut to their symbol's listing and delisting; what is empty then falls away."""
    known = lifecycle.select("symbol", "ipo_date", "delist_date")
    cut = requests.join(known, "symbol", "left").withColumns({"start_ts": F.greatest("start_ts", "ipo_date"), "end_ts": F.least("end_ts", "delist_date")})
    return cut.where("start_ts < end_ts").drop("ipo_date", "delist_date")


def hourly_gaps(bars: DataFrame, requests: DataFrame, inclusive_end: bool = True) -> DataFrame:
    """(symbol, gap_start, gap_end) for continuous trading: runs of hours without any stored bar.

    A chunk's ends count to it, so a bar on the hour covers two hours (one with inclusive_end=False). Bars outside the
    request don't count. A symbol without a bar in its request is one gap from start to end.
    """
    inside = by_day(bars.select("symbol", "ts"), requests, "left_semi")
    hour = F.date_trunc("hour", "ts")
    before = F.timestamp_micros(F.unix_micros(hour) - 3_600_000_000)
    keys = F.array(hour, before) if inclusive_end else F.array(hour)
    covers = inside.select("symbol", F.explode(F.when(hour == F.col("ts"), keys).otherwise(F.array(hour))).alias("chunk_start")).distinct()
    return _gaps(hourly_chunks(requests), covers, requests)


def session_gaps(bars: DataFrame, requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(symbol, gap_start, gap_end) for exchanges: runs of sessions without any stored bar; days beside a weekend are apart.

    A session stands for its UTC day, one that opens on the evening before for its own hours. Bars outside the request
    don't count; a request of dates holds all of its sessions.
    """
    spans = session_spans(sessions)
    over = not spans.where(F.col("chunk_start") < F.col("session_date").cast("timestamp")).isEmpty()
    dates = (F.col("start_ts") == F.date_trunc("day", "start_ts")) & (F.col("end_ts") == F.date_trunc("day", "end_ts"))
    first = F.date_sub(F.to_date("start_ts"), 1).cast("timestamp") if over else F.col("start_ts")
    last = F.timestamp_micros(F.unix_micros("end_ts") + 86_400_000_000 - 1)
    asked = requests.select("symbol", F.when(dates, first).otherwise(F.col("start_ts")).alias("start_ts"), F.when(dates, last).otherwise(F.col("end_ts")).alias("end_ts"))
    inside = by_day(bars.select("symbol", "ts"), asked, "left_semi")
    # A session of one day goes by its date; one of two may hold the bars of either.
    dates = F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1)) if over else F.array(F.to_date("ts"))
    near = inside.select("symbol", "ts", F.explode(dates).alias("session_date")).join(F.broadcast(spans), "session_date")
    covers = near.where(F.col("ts").between(F.col("chunk_start"), F.col("chunk_end"))).select("symbol", "chunk_start").distinct()
    stored = inside.select("symbol").distinct()
    return _gaps(session_chunks(requests, sessions), covers, requests, stored)


def _gaps(chunks: DataFrame, covers: DataFrame, requests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    stored = covers.select("symbol").distinct() if stored is None else stored
    # Covered chunks are as many as stored bars, which look small as files: without the hint they would be broadcast.
    missing = chunks.join(stored, "symbol", "left_semi").join(covers.hint("merge"), ["symbol", "chunk_start"], "left_anti")
    merged = islands(missing.select("symbol", F.col("chunk_start").alias("gap_start"), F.col("chunk_end").alias("gap_end")), "gap_start", "gap_end", month("gap_start"))
    whole = requests.join(stored, "symbol", "left_anti").select("symbol", F.col("start_ts").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    return merged.unionByName(whole)


def cost(gaps: DataFrame, rates: DataFrame) -> DataFrame:
    """(symbol, gap_start, gap_end, cost): the span of each symbol's gaps at its rate per day."""
    spans = gaps.groupBy("symbol").agg(F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end"))
    days = (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 86_400_000_000
    return spans.join(rates, "symbol", "left").select("symbol", "gap_start", "gap_end", (days * F.coalesce("rate", F.lit(0.0))).alias("cost"))


def check_cost(gaps: DataFrame, rates: DataFrame, ceiling: float) -> float:
    """The total cost; more than the ceiling is an error. One number comes to the driver."""
    total = cost(gaps, rates).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    if total > ceiling:
        raise ValueError(f"the plan costs {total:.2f}, the ceiling is {ceiling:.2f}")
    return total


def plan(bars: DataFrame, requests: DataFrame, lifecycle: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Gaps to load: valid symbols only, requests cut to lifecycles; by hours, or by the sessions given. A second run over loaded bars plans nothing."""
    wanted = clamp(requests.where(valid_symbol(F.col("symbol"))), lifecycle)
    return hourly_gaps(bars, wanted) if sessions is None else session_gaps(bars, wanted, sessions)


def null_grids(grid: DataFrame, loaded: DataFrame, existing: DataFrame) -> DataFrame:
    """Grid times of symbols that exist but got nothing: stored as bars without a trade. New symbols that got nothing store nothing."""
    empty = grid.join(loaded.select("symbol").distinct(), "symbol", "left_anti").join(existing.select("symbol").distinct(), "symbol", "left_semi")
    return empty.select("symbol", "ts", *[F.lit(None).cast("double").alias(p) for p in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))


def first_bars(daily: DataFrame) -> DataFrame:
    """(symbol, first_bar): the earliest daily bar of each symbol."""
    return daily.groupBy("symbol").agg(F.min("ts").alias("first_bar"))


def bootstrap_lifecycle(symbols: DataFrame, cached: DataFrame, reference: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, ipo_date, delist_date, source): a cached row counts even if its dates are null, then the vendor's, then the first bar."""
    c = cached.select("symbol", F.col("ipo_date").alias("c_ipo"), F.col("delist_date").alias("c_out"), F.lit(True).alias("hit"))
    r = reference.select("symbol", F.col("ipo_date").alias("r_ipo"), F.col("delist_date").alias("r_out"))
    all_ = symbols.select("symbol").distinct().join(c, "symbol", "left").join(r, "symbol", "left").join(first_bars(bars), "symbol", "left")
    pick = lambda a, b: F.when(F.col("hit"), a).otherwise(b)
    source = F.when(F.col("hit"), "cached").when(F.col("r_ipo").isNotNull(), "reference").when(F.col("first_bar").isNotNull(), "discovered").otherwise("unknown")
    return all_.select("symbol", pick(F.col("c_ipo"), F.coalesce("r_ipo", "first_bar")).alias("ipo_date"), pick(F.col("c_out"), F.col("r_out")).alias("delist_date"), source.alias("source"))


def upsert_lifecycle(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each symbol by discovered_at; of equal times the new one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("discovered_at"), F.desc("_new")))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_new")


#: Gaps whose lines are handed on together; fewer where they have more than ten rows each.
AT_A_TIME = 1_000
LEDGER = "symbol string, gap_start timestamp, gap_end timestamp, status string, rows long, tries int, error string"


def fetch_gaps(gaps: DataFrame, fetch: Callable, schema: str, path: str, at_once: int = 8, tries: int = 4, first_wait: float = 1.0, most_wait: float = 60.0, apart: float = 0.0, again: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)) -> DataFrame:
    """Fetch what a ledger at path hasn't got yet; (symbol, gap_start, gap_end, status, rows, tries, error) for all gaps.

    fetch(symbol, start, end) gives a pandas frame of the schema (with a column symbol). At most at_once calls run side
    by side (so many partitions), each at least `apart` seconds after the one before it in its task. Errors of the kinds
    in `again` are tried again after min(first_wait * 2**attempt, most_wait) seconds, `tries` times in all. What fails
    then, or at once for other errors, is a row of status failed and ends nothing.

    A gap's rows and its line in the ledger lie in one row of one file, so that both are there or neither. A call's file
    counts once its job is done; gaps of status fetched aren't asked for again by the next call, failed ones are.
    """
    spark = gaps.sparkSession
    kind = StructType.fromDDL(schema)
    out = StructType.fromDDL(LEDGER).add("data", ArrayType(kind))
    wanted = gaps.select("symbol", "gap_start", "gap_end").distinct()
    have = _ledger(spark, path, out)
    todo = wanted if have is None else wanted.join(have.where("status = 'fetched'"), ["symbol", "gap_start", "gap_end"], "left_anti")

    run = _fetched(fetch, kind.names, out.names, tries, first_wait, most_wait, apart, again)
    todo.repartition(at_once, "symbol", "gap_start").mapInPandas(run, out).write.mode("append").parquet(path)
    # Of several calls' lines the one that has rows counts.
    lines = _ledger(spark, path, out).join(wanted, ["symbol", "gap_start", "gap_end"], "left_semi")
    best = F.row_number().over(Window.partitionBy("symbol", "gap_start", "gap_end").orderBy(F.desc(F.col("status") == "fetched"), F.desc("tries")))
    return lines.drop("data").withColumn("_n", best).where("_n = 1").drop("_n")


def _fetched(fetch: Callable, fields: list[str], columns: list[str], tries: int, first_wait: float, most_wait: float, apart: float, again: tuple[type[BaseException], ...], at_a_time: int = AT_A_TIME) -> Callable:
    """A function from frames of gaps to frames of ledger lines, many lines a frame, as a frame of its own for each gap takes longer than its call here."""

    def run(frames: Iterator) -> Iterator:
        import time

        import pandas as pd

        last, lines, held = 0.0, [], 0
        for frame in frames:
            for gap in frame.itertuples(index=False):
                got, error, attempt = None, None, 0
                for attempt in range(1, tries + 1):
                    time.sleep(max(0.0, last + apart - time.monotonic()))
                    last = time.monotonic()
                    try:
                        got, error = fetch(gap.symbol, gap.gap_start, gap.gap_end), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if not isinstance(e, again):
                            break
                        if attempt < tries:
                            time.sleep(min(first_wait * 2 ** (attempt - 1), most_wait))
                data = got[fields].to_dict("records") if got is not None else []
                lines.append((gap.symbol, gap.gap_start, gap.gap_end, "failed" if error else "fetched", len(data), attempt, error, data))
                held += len(data)
                if len(lines) >= at_a_time or held >= 10 * at_a_time:
                    yield pd.DataFrame(lines, columns=columns)
                    lines, held = [], 0
        if lines:
            yield pd.DataFrame(lines, columns=columns)

    return run


def _ledger(spark, path: str, schema: StructType) -> DataFrame | None:
    from barloom.sources.store import exists

    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None


def fetched_rows(spark, path: str, schema: str) -> DataFrame:
    """All rows that fetch_gaps() has got at path, in the order of their gaps as ingest_seq; overlapping gaps repeat rows."""
    out = StructType.fromDDL(LEDGER).add("data", ArrayType(StructType.fromDDL(schema)))
    rows = _ledger(spark, path, out)
    if rows is None:
        rows = spark.createDataFrame([], out)
    flat = rows.where("status = 'fetched'").select("gap_start", F.posexplode("data").alias("_at", "_row"))
    return flat.select("_row.*", F.struct("gap_start", F.col("_at").alias("row")).alias("ingest_seq"))
