"""Checks of bars: before and after they are put on the grid, and of a whole stored library.

All checks of a symbol are conditional sums over one pass; only duplicates and the order need the bar before, which a
block of the order of arrival gets from the block before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import arrival, with_before
from barloom.schema import FIELDS, PRICES

ISSUES = "symbol string, severity string, category string, n_bars bigint, first_ts timestamp"


def _priced() -> Column:
    out = F.lit(True)
    for p in PRICES:
        out = out & F.col(p).isNotNull()
    return out


def _any_price() -> Column:
    return F.coalesce(*PRICES).isNotNull()


def _out_of_order() -> Column:
    inside = F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    return _priced() & ~inside


def marked(bars: DataFrame, length: int, in_time: bool = False) -> DataFrame:
    """bars (with ingest_seq) and what each breaks against the bar that came before it: duplicate, backward, short.

    The order of arrival is cut into blocks, of which each gets the last time of the one before. in_time: whether
    ingest_seq rises with ts, so that a bar that repeats a time comes right after it and no second shuffle looks for it.
    """
    out = with_before(bars, "ingest_seq", {"_was": F.col("ts")}, arrival(bars))
    same = Window.partitionBy("symbol", "ts").orderBy("ingest_seq")
    duplicate = F.coalesce(F.col("ts") == F.col("_was"), F.lit(False)) if in_time else F.row_number().over(same) > 1
    gap = F.unix_micros("ts") - F.unix_micros("_was")
    return out.withColumns({"duplicate": duplicate, "backward": F.coalesce(F.col("ts") < F.col("_was"), F.lit(False)), "short": F.coalesce(gap < length, F.lit(False))}).drop("_was")


#: Category, severity and condition of each kind of check.
def _checks(stage: str) -> list[tuple[str, str, Column]]:
    traded = F.col("volume") > 0
    order = _out_of_order() if stage != "storage" else _out_of_order() & traded
    out = [
        ("duplicate_ts", "error", F.col("duplicate")),
        ("not_increasing", "error", F.col("backward")),
        ("bad_spacing", "error", F.col("short")),
        ("null_volume", "error", F.col("volume").isNull()),
        ("price_order", "error", order),
    ]
    partial = traded & ~_priced()
    if stage == "raw":
        return [*out, ("partial_prices", "warning", partial)]
    out += [("traded_without_prices", "error", partial), ("prices_without_trade", "error", (F.col("volume") == 0) & _any_price())]
    if stage == "audit":
        out += [("negative_volume", "error", F.col("volume") < 0), ("negative_price", "warning", F.least(*PRICES) < 0)]
    return out


def issues(bars: DataFrame, length: int, stage: str, only: tuple[str, ...] | None = None, in_time: bool = False) -> DataFrame:
    """(symbol, severity, category, n_bars, first_ts) of all checks of a stage (raw, storage or audit) that any bar fails; no bars, no issues.

    only: the categories that are asked for; what the others need isn't worked out. in_time: as for marked().
    """
    if "volume" not in bars.columns:
        return bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.min("ts").alias("first_ts")).select("symbol", F.lit("error").alias("severity"), F.lit("no_volume_column").alias("category"), "n_bars", "first_ts")
    missing = [f for f in FIELDS if f not in bars.columns]
    if missing and stage == "storage":
        raise ValueError(f"columns are missing: {missing}")
    checks = [c for c in _checks(stage) if only is None or c[0] in only]
    sums = []
    for name, _, failed in checks:
        failed = F.coalesce(failed, F.lit(False))
        sums += [F.count_if(failed).alias(f"n_{name}"), F.min(F.when(failed, F.col("ts"))).alias(f"t_{name}")]
    wide = marked(bars, length, in_time).groupBy("symbol").agg(*sums)
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(n).alias("category"), F.col(f"n_{n}").alias("n_bars"), F.col(f"t_{n}").alias("first_ts")) for n, s, _ in checks])
    return wide.select("symbol", F.explode(rows).alias("i")).select("symbol", "i.*").where("n_bars > 0")


def grid_issues(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Missing grid times (error) and bars off the grid (warning) per symbol. One shuffle by (symbol, ts), no join."""
    both = bars.select("symbol", "ts", F.lit(1).alias("b"), F.lit(0).alias("g")).unionByName(grid.select("symbol", "ts", F.lit(0).alias("b"), F.lit(1).alias("g")))
    each = both.groupBy("symbol", "ts").agg(F.max("b").alias("b"), F.max("g").alias("g")).where("b <> g")
    out = each.groupBy("symbol", F.when(F.col("g") == 1, "missing_bars").otherwise("extra_bars").alias("category")).agg(F.count("*").alias("n_bars"), F.min("ts").alias("first_ts"))
    return out.select("symbol", F.when(F.col("category") == "missing_bars", "error").otherwise("warning").alias("severity"), "category", "n_bars", "first_ts")


def audit(bars: DataFrame, grid: DataFrame, length: int) -> DataFrame:
    """All issues of stored bars against the grid; a symbol without bars has its missing bars only."""
    return issues(bars, length, "audit").unionByName(grid_issues(bars, grid))


def audit_report(bars: DataFrame, grid: DataFrame, length: int, in_time: bool = False) -> DataFrame:
    """(symbol, expected, found, issues, missing_bars, is_clean) per symbol of bars or grid: how many bars there should be and are, and what audit() finds.

    A symbol with neither bars nor grid times doesn't appear; it is clean by nature. Both are counted by time once, for
    how many there are and for what is missing or extra alike. in_time: as for marked().
    """
    both = bars.select("symbol", "ts", F.lit(1).alias("b"), F.lit(0).alias("g")).unionByName(grid.select("symbol", "ts", F.lit(0).alias("b"), F.lit(1).alias("g")))
    each = both.groupBy("symbol", "ts").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    counts = each.groupBy("symbol").agg(F.sum("g").alias("expected"), F.sum("b").alias("found"), F.count_if(F.col("b") == 0).alias("missing_bars"), F.count_if(F.col("g") == 0).alias("_extra"))
    own = issues(bars, length, "audit", in_time=in_time).groupBy("symbol").agg(F.count("*").alias("issues"))
    n = F.coalesce("issues", F.lit(0)) + (F.col("missing_bars") > 0).cast("long") + (F.col("_extra") > 0).cast("long")
    return counts.join(own, "symbol", "left").select("symbol", "expected", "found", n.alias("issues"), "missing_bars").withColumn("is_clean", F.col("issues") == 0)


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("issues"), F.sum("n_bars").alias("n_bars"))


def quarantine(bars: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of symbols without errors, and those of symbols with any."""
    bad = found.where("severity = 'error'").select("symbol").distinct()
    return bars.join(bad, "symbol", "left_anti"), bars.join(bad, "symbol", "left_semi")


def require(found: DataFrame) -> None:
    """Errors end the job; a handful of rows say which."""
    some = found.where("severity = 'error'").limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r['symbol']}: {r['category']} ({r['n_bars']})" for r in some))
